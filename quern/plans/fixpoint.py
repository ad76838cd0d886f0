"""Recursive programs to their least fixpoint, semi-naively or naively."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.conjunctive import evaluate as run_query
from quern.plans.ir import RESERVED, Atom, Catalog, Lit, Program, ProgramError, Rule, Var
from quern.sources.scratch import written


#: Names of relations that `doubled` adds begin so.
CLOSURE = "closure_of_"
#: A relation as it was before the last round is read under its name after this.
BEFORE = RESERVED + RESERVED


@dataclass
class Fixpoint:
    """Derived relations, and the facts that were new in each round (the last round of each relation finds none)."""

    relations: Catalog
    rounds: int
    new_facts: list[dict[str, int]] = field(default_factory=list)


def doubled(program: Program, seeded: Collection[str] | None = None) -> Program:
    """Rewrite linear transitive closure, p(x,z) :- p(x,y), e(y,z) or p(x,z) :- e(x,y), p(y,z) beside p(x,y) :- e(x,y),
    so that it takes a logarithm of the rounds. The same facts follow.

    Where these two rules are all that p has, and it has no seeds, p is its own closure: p(x,z) :- p(x,y), p(y,z).
    Else p's facts need not be paths of e, so the closure of e becomes a relation of its own that the rule joins with.
    `seeded` names the relations with seeds; if it is None any may have some. Other rules stay as they are."""
    rules, closed = [], set()
    for r in program.rules:
        base = {q.body[0].relation for q in program.rules if q.relation == r.relation and len(q.body) == 1 and q.head == q.body[0].terms and len(set(q.head)) == 2 and all(isinstance(t, Var) for t in q.head)}
        edges = {a.relation for a in r.body} - {r.relation}
        if len(r.body) == 2 and len(edges) == 1 and edges <= base and _chains(r):
            (e,) = edges
            a, b = r.body
            if seeded is not None and r.relation not in seeded and sum(q.relation == r.relation for q in program.rules) == 2:
                r = Rule(r.relation, r.head, (Atom(r.relation, a.terms), Atom(r.relation, b.terms)))
            else:
                closed.add(e)
                r = Rule(r.relation, r.head, tuple(replace(x, relation=CLOSURE + e) if x.relation == e else x for x in r.body))
        rules.append(r)
    x, y, z = Var("x"), Var("y"), Var("z")
    for e in sorted(closed):
        c = CLOSURE + e
        rules += [Rule(c, (x, y), (Atom(e, (x, y)),)), Rule(c, (x, z), (Atom(c, (x, y)), Atom(c, (y, z))))]
    return Program(tuple(rules))


def _chains(r: Rule) -> bool:
    """Whether a rule's two atoms form a path from the first to the last variable of its head."""
    a, b = r.body
    terms = (*r.head, *a.terms, *b.terms)
    return len(r.head) == len(a.terms) == len(b.terms) == 2 and all(isinstance(t, Var) for t in terms) and a.terms[1] == b.terms[0] and r.head == (a.terms[0], b.terms[1]) and len({*a.terms, *b.terms}) == 3


def _head_names(program: Program, seeds: dict[str, DataFrame]) -> dict[str, list[str]]:
    names = {k: list(v.columns) for k, v in seeds.items()}
    for r in program.rules:
        if r.relation not in names:
            given = [t.name if isinstance(t, Var) else f"c{k}" for k, t in enumerate(r.head)]
            names[r.relation] = given if len(set(given)) == len(given) else [f"c{k}" for k in range(len(given))]
    return names


def evaluate(
    spark: SparkSession, program: Program, facts: Catalog, seeds: dict[str, DataFrame] | None = None,
    semi_naive: bool = True, max_rounds: int = 1000, double: bool = False,
) -> Fixpoint:
    """All facts that follow from `facts` and the derived relations' `seeds`.

    A round is one plan per relation: the union of its rules, minus what is known. Semi-naive rounds join each rule's
    derived atoms, one at a time, with what the last round found; atoms before that one read only what was known before
    it, so that no pair of new facts is joined twice. Rows are made distinct once a round, not rule by rule. New facts are written to the shared folder, which
    cuts the plan and outlives lost executors; as rounds don't overlap, a relation is the union of its files and is
    never rewritten or counted anew. Null is a value here: a fact that holds nulls is known once it was found, though a
    null joins nothing. `double` rewrites linear closures (see `doubled`). `max_rounds` guards programs that invent
    values for ever."""
    seeds = seeds or {}
    asked = program.derived()
    if double:
        program = doubled(program, seeds)
    program.check({k: len(v.columns) for k, v in {**facts, **seeds}.items()})
    derived, names = program.derived(), _head_names(program, seeds)
    if clash := [d for d in derived if d in facts]:
        raise ProgramError(f"{clash} are both given and derived; pass their rows as seeds")
    files: dict[str, list[str]] = {d: [] for d in derived}
    total: Catalog = Catalog({k: v for k, v in seeds.items() if k not in derived})
    delta: dict[str, DataFrame] = {}
    schema: dict[str, object] = {}
    stats: list[dict[str, int]] = []
    past: dict[str, list[str]] = {}

    def known(d: str) -> DataFrame | None:
        return spark.read.schema(schema[d]).parquet(*files[d]) if files[d] else None

    for d in derived:
        if d in seeds:
            path, rows = written(seeds[d].distinct(), "seed")
            schema[d] = rows.schema
            files[d].append(path)
            delta[d] = rows

    def earlier(a: str) -> DataFrame:
        """What was known before the last round found `delta`."""
        return spark.read.schema(schema[a]).parquet(*past[a]) if past[a] else spark.createDataFrame([], schema[a])

    def results(d: str, first: bool) -> list[DataFrame]:
        out = []
        for r in (r for r in program.rules if r.relation == d):
            own = [k for k, a in enumerate(r.body) if a.relation in derived]
            places = [None] if first or not semi_naive else own
            for at in places:
                before = [k for k in own if at is not None and k < at]
                name = lambda k, a: RESERVED + a.relation if k == at else BEFORE + a.relation if k in before else a.relation
                tables = Catalog({**facts, **total})
                if any(r.body[k].relation not in tables for k in before):
                    continue
                body = tuple(replace(a, relation=name(k, a)) for k, a in enumerate(r.body))
                for k in before:
                    tables[BEFORE + r.body[k].relation] = earlier(r.body[k].relation)
                used = {a.relation for a in body}
                if any(a in derived and a not in tables for a in used):
                    continue
                if at is not None:
                    if r.body[at].relation not in delta:
                        continue
                    tables[RESERVED + r.body[at].relation] = delta[r.body[at].relation]
                out.append(run_query(replace(r.query(), body=body), tables, names[d], distinct=False))
        return out

    for n in range(max_rounds):
        past = {d: files[d][:-1] if d in delta else files[d][:] for d in derived}
        total.update({d: k for d in derived if (k := known(d)) is not None})
        found: dict[str, DataFrame] = {}
        count: dict[str, int] = {}
        for d in derived:
            parts = results(d, first=n == 0)
            if not parts:
                continue
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionAll(p)
            if d in schema:
                rows = rows.select(*(F.col(f"`{c}`").cast(f.dataType).alias(c) for c, f in zip(rows.columns, schema[d], strict=True)))
            if d in total:
                old = total[d].select(*(F.col(f"`{c}`").alias(f"old_{k}") for k, c in enumerate(total[d].columns)))
                rows = rows.join(old, [F.col(f"`{c}`").eqNullSafe(F.col(f"old_{k}")) for k, c in enumerate(rows.columns)], "left_anti")
            path, rows = written(rows.distinct(), "round")
            schema.setdefault(d, rows.schema)
            if count_ := rows.count():
                count[d] = count_
                files[d].append(path)
                found[d] = rows
        stats.append({d: count.get(d, 0) for d in derived})
        delta = found
        if not found:
            break
    else:
        raise ProgramError(f"no fixpoint within {max_rounds} rounds")
    for d in derived:
        if d not in schema:  # no rule ever matched a type: the relation is empty
            raise ProgramError(f"nothing gives {d} its types: all its rules read relations without facts or types")
    empty = {d: spark.createDataFrame([], schema[d]) for d in derived if not files[d]}
    return Fixpoint(Catalog({d: empty[d] if d in empty else known(d) for d in asked}), len(stats), stats)


__all__ = ["Fixpoint", "doubled", "evaluate", "Lit"]
