"""Laws as queries for their counterexamples: antecedents join, consequents semi-join, what is left violates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.ir import Lit, Term, Var
from quern.plans.theory import Equal, Law, RuleAtom

RID = "_rid"


def _value(t: Term) -> Column:
    return F.col(f"`v_{t.name}`") if isinstance(t, Var) else F.lit(t.value)


def _matches(atom: RuleAtom, table: DataFrame) -> DataFrame:
    """Rows that an atom's constants and repeated variables allow, its variables as columns `v_<name>`. A row's id
    and a cell that holds the id are the same value."""
    data = [c for c in table.columns if c != RID]
    cells = [(F.col(f"`{data[k]}`"), t) for k, t in atom.values] + ([(F.col(RID), atom.row_id)] if atom.row_id else [])
    first: dict[str, Column] = {}
    for col, t in cells:
        if isinstance(t, Lit):
            table = table.filter(col.eqNullSafe(F.lit(t.value)))
        elif isinstance(t, Var):
            if t.name in first:
                table = table.filter(col.eqNullSafe(first[t.name]))
            first.setdefault(t.name, col)
    return table.select(*(c.alias(f"v_{v}") for v, c in first.items()), *([] if first else [F.lit(1).alias("hit")])).distinct()


def _join(rows: DataFrame, more: DataFrame, how: str) -> DataFrame:
    shared = [c for c in more.columns if c in rows.columns and c != "hit"]
    right = more.select(*(F.col(f"`{c}`").alias(f"r_{k}") for k, c in enumerate(more.columns)))
    cond = F.lit(True)
    for c in shared:
        cond = cond & F.col(f"`{c}`").eqNullSafe(F.col(f"r_{more.columns.index(c)}"))
    if how != "inner":
        if not shared:  # all or nothing: does the atom hold at all
            gate = right.limit(1).select(F.lit(1).alias("gate"))
            return rows.crossJoin(gate).drop("gate") if how == "left_semi" else rows.join(F.broadcast(gate), F.lit(True), "left_anti")
        return rows.join(right, cond, how)
    new = [c for c in more.columns if c not in rows.columns and c != "hit"]
    joined = rows.join(right, cond) if shared else rows.crossJoin(right)
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(f"r_{more.columns.index(c)}").alias(c) for c in new))


def bindings(law: Law, tables: Mapping[str, DataFrame]) -> DataFrame:
    """All distinct ways in which a law's antecedents hold; one row if it has none."""
    spark = next(iter(tables.values())).sparkSession
    rows: DataFrame | None = None
    for a in law.antecedents:
        if isinstance(a, RuleAtom):
            found = _matches(a, tables[a.entity])
            rows = found if rows is None else _join(rows, found, "inner")
    if rows is None:
        rows = spark.range(1).select(F.lit(1).alias("hit"))
    for a in law.antecedents:
        if isinstance(a, Equal):
            rows = rows.filter(_value(a.left).eqNullSafe(_value(a.right)))
    return rows.distinct()


def _equated(held: DataFrame, base: DataFrame, e: Equal, known: set[str]) -> DataFrame:
    """The matches of consequents for which an equality holds. A side that only the bindings know is brought in by a
    join on the other side's value."""
    outer = [t for t in (e.left, e.right) if isinstance(t, Var) and t.name in known and f"v_{t.name}" not in held.columns]
    if not outer:
        return held.filter(_value(e.left).eqNullSafe(_value(e.right)))
    own = e.right if outer[0] == e.left else e.left
    values = base.select(F.col(f"`v_{outer[0].name}`").alias("outer")).distinct()
    joined = held.join(values, _value(own).eqNullSafe(F.col("outer")))
    return joined.select(*(F.col(f"`{c}`") for c in held.columns), F.col("outer").alias(f"v_{outer[0].name}"))


def violations(law: Law, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The bindings of the antecedents for which some consequent does not hold.

    Consequent atoms may bring variables of their own: atoms that share such variables must hold together, for one
    choice of them, so they are joined before the bindings without a match are taken."""
    base = bindings(law, tables)
    known = {c[2:] for c in base.columns if c.startswith("v_")}
    bad: list[DataFrame] = []
    atoms = [a for a in law.consequents if isinstance(a, RuleAtom)]
    equals = [e for e in law.consequents if isinstance(e, Equal)]
    open_of = lambda x: (x.variables() if isinstance(x, RuleAtom) else {t.name for t in (x.left, x.right) if isinstance(t, Var)}) - known
    groups: list[list] = []
    for x in [*atoms, *equals]:
        mine, free = [x], set(open_of(x))
        rest = []
        for g in groups:
            if free & set().union(*map(open_of, g)):
                mine = g + mine
            else:
                rest.append(g)
        groups = [*rest, mine]
    for g in groups:
        if len(g) == 1 and isinstance(g[0], Equal):
            bad.append(base.filter(~_value(g[0].left).eqNullSafe(_value(g[0].right))))
            continue
        held: DataFrame | None = None
        for a in (a for a in g if isinstance(a, RuleAtom)):
            found = _matches(a, tables[a.entity])
            held = found if held is None else _join(held, found, "inner")
        for e in (e for e in g if isinstance(e, Equal)):
            held = _equated(held, base, e, known)
        bad.append(_join(base, held, "left_anti"))
    if not bad:
        return base.limit(0)
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    named = [F.col(f"`{c}`").alias(c[2:]) for c in out.columns if c.startswith("v_")]
    return out.distinct().select(*named) if named else out.distinct()


def key_violations(table: DataFrame, key: tuple[str, ...] | None) -> DataFrame:
    """Key values that several rows share, with their number; for an empty key, one line if there are two rows."""
    if key is None:
        return table.limit(0).select(F.lit(0).cast("long").alias("rows"))
    counted = table.groupBy(*(F.col(f"`{k}`") for k in key)).agg(F.count("*").alias("rows"))
    return counted.filter("`rows` > 1")
