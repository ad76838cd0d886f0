"""Seeded example relations for tests and benchmarks, made in the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(seed: int, what: str, below: int) -> Column:
    """A number below a bound, from the row's id, a seed and a name."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(below))


def triangles(spark: SparkSession, nodes: int, noise: int, planted: int, seed: int) -> dict[str, DataFrame]:
    """R_f(src, dst), R_g(src, dst) and R_h(src, dst): random edges, and `planted` closed triangles."""
    corner = [_draw(seed, f"corner{k}", nodes) for k in range(3)]
    out = {}
    for k, name in enumerate(("R_f", "R_g", "R_h")):
        rows = spark.range(noise).select(_draw(seed, f"{name}s", nodes).alias("src"), _draw(seed, f"{name}d", nodes).alias("dst"))
        out[name] = rows.unionAll(spark.range(planted).select(corner[k].alias("src"), corner[(k + 1) % 3].alias("dst"))).distinct()
    return out


def nested_terms(spark: SparkSession, classes: int, noise: int, planted: int, seed: int) -> dict[str, DataFrame]:
    """R_f(id, c1, c2) and R_g(id, c1) with `planted` matches of f(a, g(a))."""
    f = spark.range(noise).select(*(_draw(seed, f"f{k}", classes).alias(c) for k, c in enumerate(("id", "c1", "c2"))))
    g = spark.range(noise).select(*(_draw(seed, f"g{k}", classes).alias(c) for k, c in enumerate(("id", "c1"))))
    a, t, u = (_draw(seed, x, classes) for x in ("a", "t", "u"))
    more = spark.range(planted)
    return {
        "R_f": f.unionAll(more.select(t.alias("id"), a.alias("c1"), u.alias("c2"))).distinct(),
        "R_g": g.unionAll(more.select(u.alias("id"), a.alias("c1"))).distinct(),
    }


def chain(spark: SparkSession, length: int) -> DataFrame:
    return spark.range(max(0, length - 1)).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))


def dag(spark: SparkSession, nodes: int, edges: int, seed: int) -> DataFrame:
    """Edges from smaller to larger nodes."""
    rows = spark.range(edges).select(_draw(seed, "a", nodes).alias("a"), _draw(seed, "b", nodes).alias("b")).filter("a <> b")
    return rows.select(F.least("a", "b").alias("parent"), F.greatest("a", "b").alias("child")).distinct()
