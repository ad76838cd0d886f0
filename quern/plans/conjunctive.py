"""Conjunctive queries as DataFrame joins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.ir import Any, Atom, Catalog, Lit, Query, Var


def _column(df: DataFrame, k: int):
    return F.col(f"`{df.columns[k]}`")


def bind(atom: Atom, df: DataFrame, needed: set[str], distinct: bool = False) -> DataFrame:
    """One atom's matches: constants and repeated variables filter, needed variables become columns `v_<name>`. With
    `distinct`, rows that become equal because columns go are one, else they would multiply in every later join."""
    first: dict[str, int] = {}
    for k, t in enumerate(atom.terms):
        if isinstance(t, Lit):
            df = df.filter(_column(df, k) == F.lit(t.value))
        elif isinstance(t, Var):
            if t.name in first:
                df = df.filter(_column(df, k) == _column(df, first[t.name]))
            first.setdefault(t.name, k)
    out = df.select(*(_column(df, k).alias(f"v_{v}") for v, k in first.items() if v in needed))
    fewer = any(isinstance(t, Any) for t in atom.terms) or first.keys() - needed
    return out.distinct() if distinct and fewer and out.columns else out


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate of a relation's bytes, from its files and filters; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Estimated (compressed) bytes that one partition of a deduplicated relation may have.
PARTITION_BYTES = 16 << 20
#: From here on an estimate is Spark's stand-in for a size that it doesn't know.
UNKNOWN_BYTES = 1 << 50


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows. A large relation is dealt by `keys`, which it is joined on next, to partitions whose number grows
    with it, so that it crosses the network once and a task holds no more of a larger one."""
    size = size_of(df)
    n = size // PARTITION_BYTES + 1 if size < UNKNOWN_BYTES else 1
    if keys and n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(n, *keys)
    return df.distinct()


def cyclic(body: tuple[Atom, ...]) -> bool:
    """Whether atoms are left when those whose shared variables another atom holds are taken off one by one."""
    left = [a.variables() for a in body]
    while True:
        for k, a in enumerate(left):
            rest = left[:k] + left[k + 1 :]
            if not rest:
                return False
            if (shared := a & set().union(*rest)) == set() or any(shared <= b for b in rest):
                left = rest
                break
        else:
            return True


def measured_order(body: tuple[Atom, ...], catalog: Catalog) -> list[int]:
    """The order for a cyclic query: from the pair of atoms on, always the atom that makes the fewest rows, by counts of
    the atoms' rows and of their variables' values. Sizes alone don't tell a join of 4 rows a key from one of 1,000."""
    rows, values = [], []
    for a in body:
        df = bind(a, catalog.relation(a.relation), a.variables())
        if not df.columns:
            rows.append(1.0)
            values.append({})
            continue
        r = df.agg(F.count("*").alias("n"), *(F.approx_count_distinct(c).alias(c) for c in df.columns)).first()
        rows.append(float(max(r["n"], 1)))
        values.append({c: max(r[c], 1) for c in df.columns})

    def grown(n: float, known: dict[str, int], k: int) -> tuple[float, dict[str, int]]:
        n *= rows[k]
        for v in values[k].keys() & known.keys():
            n /= max(values[k][v], known[v])
        return n, {**known, **{v: min(c, known.get(v, c)) for v, c in values[k].items()}}

    every = range(len(body))
    order = list(min(((a, b) for a in every for b in every if a < b), key=lambda p: (not values[p[0]].keys() & values[p[1]].keys(), grown(rows[p[0]], values[p[0]], p[1])[0], p)))
    n, known = grown(rows[order[0]], values[order[0]], order[1])
    while len(order) < len(body):
        k = min((k for k in every if k not in order), key=lambda k: (not values[k].keys() & known.keys(), grown(n, known, k)[0], k))
        n, known = grown(n, known, k)
        order.append(k)
    return order


def determined(body: tuple[Atom, ...], catalog: Catalog, head: set[str], needed: set[str]) -> bool:
    """Whether the head's variables fix all others that atoms are joined on: trivially, or as the atoms' rows show, of
    which none may have the same values of what is fixed already and others of the rest."""
    known, tried = set(head), True
    while tried and not needed <= known:
        tried = False
        for a in sorted(body, key=lambda a: size_of(catalog.relation(a.relation))):
            mine = a.variables() & needed
            if mine <= known or not mine & known:
                continue
            rows = bind(a, catalog.relation(a.relation), mine).distinct()
            if rows.groupBy(*(f"v_{v}" for v in sorted(mine & known))).count().filter("count > 1").isEmpty():
                known |= mine
                tried = True
    return needed <= known


def join_order(body: tuple[Atom, ...], sizes: Mapping[str, int] | None = None) -> list[int]:
    """Most selective first (constants, then small relations, then few variables), then always an atom that shares a
    variable if one does: the one that shares most, of these the smallest."""
    size = sizes or {}
    rank = lambda k: (-sum(isinstance(t, Lit) for t in body[k].terms), size.get(body[k].relation, 0), len(body[k].variables()), k)
    left, bound, order = set(range(len(body))), set(), []
    while left:
        linked = [k for k in left if body[k].variables() & bound]
        pick = min(linked or left, key=lambda k: (-len(body[k].variables() & bound) if linked else 0, rank(k)))
        order.append(pick)
        left.discard(pick)
        bound |= body[pick].variables()
    return order


def evaluate(query: Query, catalog: Catalog, names: list[str] | None = None, distinct: bool = True) -> DataFrame:
    """The distinct rows of a query, as one lazy plan.

    Variables that nothing further on asks for are dropped at once; an atom that then adds no column is a semi-join,
    and one without variables is a gate on whether it matches at all. Catalyst picks the physical joins. The rows of a
    join are not held against each other where the head fixes all variables: it is then enough that the atoms' rows are
    distinct. That, and the order of a cyclic query, is found by jobs over single relations. Without `distinct` no such
    job is run and rows may repeat."""
    query.check(catalog.arity())
    wanted = {t.name for t in query.head if isinstance(t, Var)}
    shared_ = Counter(v for a in query.body for v in a.variables())
    joins = wanted | {v for v, n in shared_.items() if n > 1}
    if distinct and cyclic(query.body):
        order = measured_order(query.body, catalog)
    else:
        order = join_order(query.body, {a.relation: size_of(catalog.relation(a.relation)) for a in query.body} if len(query.body) > 1 else None)
    once = distinct and sum(bool(a.variables() & joins) for a in query.body) > 1 and determined(query.body, catalog, wanted, joins)
    out: DataFrame | None = None
    gates: list[DataFrame] = []
    for place, k in enumerate(order):
        atom = query.body[k]
        others = [query.body[j] for j in order if j != k]
        later = wanted | set().union(*(query.body[j].variables() for j in order[place + 1 :]), set())
        needed = wanted | set().union(*(a.variables() for a in others), set())
        bound = set().union(*(query.body[j].variables() for j in order[:place]), set())
        adds = (atom.variables() & needed) - bound
        matches = bind(atom, catalog.relation(atom.relation), needed, distinct=not once and bool(adds) and place < len(order) - 1)
        if once and adds:
            near = bound if place else set().union(*(query.body[j].variables() for j in order[1:2]), set())
            matches = deduplicated(matches, [c for c in matches.columns if c[2:] in near])
        if not matches.columns:
            source = bind_rows(atom, catalog.relation(atom.relation))
            gates.append(source.limit(1))
            continue
        if out is None:
            out = matches
        else:
            shared = [c for c in matches.columns if c in out.columns]
            new = [c for c in matches.columns if c not in out.columns]
            right = matches.select(*(F.col(c).alias(f"r_{c}") for c in matches.columns))
            on = [F.col(c) == F.col(f"r_{c}") for c in shared]
            if shared and not new:
                out = out.join(right, on, "left_semi")
            elif shared:
                joined = out.join(right, on, "inner")
                out = joined.select(*(F.col(c) for c in out.columns), *(F.col(f"r_{c}").alias(c) for c in new))
            else:
                out = out.crossJoin(right).select(*(F.col(c) for c in out.columns), *(F.col(f"r_{c}").alias(c) for c in new))
        keep = [c for c in out.columns if c[2:] in later]
        if keep and len(keep) < len(out.columns):
            out = out.select(*keep)
    if out is None:
        out = gates.pop(0)
    for g in gates:
        out = out.crossJoin(g.select(F.lit(1).alias("gate"))).drop("gate")
    names = names or [t.name if isinstance(t, Var) else f"c{k}" for k, t in enumerate(query.head)]
    picked = [(F.col(f"v_{t.name}") if isinstance(t, Var) else F.lit(t.value)).alias(n) for t, n in zip(query.head, names, strict=True)]
    return out.select(*picked) if once or not distinct else out.select(*picked).distinct()


def bind_rows(atom: Atom, df: DataFrame) -> DataFrame:
    """Rows that an atom without needed variables matches."""
    marked = bind(atom, df, atom.variables())
    if marked.columns:
        return marked.select(F.lit(1).alias("hit"))
    for k, t in enumerate(atom.terms):
        if isinstance(t, Lit):
            df = df.filter(_column(df, k) == F.lit(t.value))
    return df.select(F.lit(1).alias("hit"))
