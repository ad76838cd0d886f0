"""Structural identity: rows that say the same become one, and references follow, until nothing changes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import written


@dataclass(frozen=True)
class Referenced:
    """A table with a row id in `id_col`; `references` tells which columns hold ids of which table. Only tables with
    `consed` have their equal rows united; others just follow."""

    df: DataFrame
    id_col: str = "_rid"
    references: Mapping[str, str] | None = None
    consed: bool = True

    def values(self) -> list[str]:
        return [c for c in self.df.columns if c != self.id_col]


def class_map(table: Referenced) -> DataFrame:
    """(id, least): ids that give way to the smallest id among the rows with equal values.

    Two hashes of the values, 128 bits, find the rows that may have an equal; only their values are compared, so the
    values of all others never cross the network."""
    names = [f"k_{n}" for n in range(len(table.values()))]
    rows = table.df.select(F.col(f"`{table.id_col}`").alias("id"), *(F.col(f"`{c}`").alias(n) for c, n in zip(table.values(), names, strict=True)))
    if not names:
        least = rows.agg(F.min("id").alias("least"))
        return rows.crossJoin(least).filter(F.col("id") != F.col("least")).select("id", "least")
    hashed = rows.select("*", *(F.xxhash64(F.lit(s), *names).alias(f"h{s}") for s in (1, 2)))
    repeated = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("h1").alias("r1"), F.col("h2").alias("r2"))
    alike = hashed.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left_semi")
    first = alike.groupBy("h1", "h2", *names).agg(F.min("id").alias("least"))
    right = first.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), *(F.col(n).alias(f"f_{n}") for n in names), "least")
    same = (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"f_{n}"))
    return alike.join(right, same).filter(F.col("id") != F.col("least")).select("id", "least")


def follow(table: Referenced, maps: Mapping[str, DataFrame], own: DataFrame | None) -> DataFrame:
    """A table without the rows that gave way, and with references replaced by their classes' least ids. Rows of a table
    without ids are one where they become equal."""
    df = table.df
    if own is not None:
        df = df.join(own.select(F.col("id").alias("gone")), F.col(f"`{table.id_col}`") == F.col("gone"), "left_anti")
    for k, (c, m) in enumerate((c, maps[t]) for c, t in (table.references or {}).items() if t in maps):
        right = m.select(F.col("id").alias(f"from_{k}"), F.col("least").alias(f"to_{k}"))
        joined = df.join(right, F.col(f"`{c}`") == F.col(f"from_{k}"), "left")
        df = joined.select(*(F.coalesce(F.col(f"to_{k}"), F.col(f"`{c}`")).alias(c) if c == x else F.col(f"`{x}`") for x in df.columns))
    return df if table.id_col else df.distinct()


def canonical(tables: Mapping[str, Referenced], max_rounds: int = 100, moves: dict[str, list[DataFrame]] | None = None) -> dict[str, DataFrame]:
    """All tables after rounds of uniting and following. A round that displaces no id ends it; each is written to the
    shared folder. Key conflicts that uniting brings about are for the caller to find in the result. `moves` gets the
    (id, least) tables of each round, in order, by table: what became of displaced ids."""
    now = dict(tables)
    for _ in range(max_rounds):
        maps = {n: written(class_map(t), "classes")[1] for n, t in now.items() if t.consed}
        moved = {n: m for n, m in maps.items() if not m.isEmpty()}
        if not moved:
            return {n: t.df for n, t in now.items()}
        for n, m in moved.items() if moves is not None else ():
            moves.setdefault(n, []).append(m)
        now = {n: Referenced(written(follow(t, moved, moved.get(n)), "united")[1], t.id_col, t.references, t.consed) for n, t in now.items()}
    raise RuntimeError(f"identity did not settle within {max_rounds} rounds")
