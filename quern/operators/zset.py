"""Relations with signed multiplicities: a hidden weight column that every operator carries along."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalar import ExpressionError, Ref, Scope, Typed, columns_of, compile_expression, truthy

W = "__w"
#: Estimated bytes of the larger side of a theta join that one share of it may have, and most shares.
SHARE_BYTES, MOST_SHARES = 256 << 10, 64


def _shared_out(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides and a condition by which each pair meets once: the larger side's lines are dealt to shares, the other
    side goes to all of them, so that few keys with many lines each still keep all tasks at work. What goes to all is hashed
    task by task and never broadcast, as its size is no longer what it was."""
    sizes = [int(str(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for x in (left, right)]
    n = min(MOST_SHARES, max((x for x in sizes if x < 1 << 50), default=0) // SHARE_BYTES + 1)
    if n == 1:
        return left, right, F.lit(True)
    dealt = lambda x: x.withColumn("share", F.pmod(F.xxhash64(*(F.col(c) for c in x.columns)), F.lit(n)).cast("int"))
    whole = lambda x: x.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).hint("shuffle_hash")
    one, two = (dealt(left), whole(right)) if sizes[0] > sizes[1] else (whole(left), dealt(right))
    return one.withColumnRenamed("share", "l_share"), two.withColumnRenamed("share", "r_share"), F.col("l_share") == F.col("r_share")


@dataclass(frozen=True)
class ZSet:
    """Rows with a weight: n > 0 counts a row n times, n < 0 takes it away n times. The same row may stand in several
    lines until `consolidated` adds them up. `unsigned` names columns that hold unsigned numbers."""

    df: DataFrame
    unsigned: frozenset[str] = frozenset()
    alias: str | None = None
    single: Callable[[], bool] | None = field(default=None, compare=False)

    @staticmethod
    def of(df: DataFrame, unsigned: Sequence[str] = ()) -> ZSet:
        """A relation from plain rows, each once, or from rows that bring their weight in `__w`."""
        return ZSet(df if W in df.columns else df.withColumn(W, F.lit(1).cast("long")), frozenset(unsigned))

    @staticmethod
    def rows(spark: SparkSession, schema: str, rows: Sequence[tuple], weights: Sequence[int] | None = None) -> ZSet:
        weights = weights or [1] * len(rows)
        return ZSet(spark.createDataFrame([(*r, w) for r, w in zip(rows, weights, strict=True)], f"{schema}, {W} long"))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != W]

    def typed(self) -> dict[str, Typed]:
        return {k: v for k, v in columns_of(self.df.schema, self.unsigned).items() if k != W}

    def _with(self, df: DataFrame, unsigned: frozenset[str] | None = None) -> ZSet:
        return ZSet(df, self.unsigned if unsigned is None else unsigned)

    def compile(self, e: object, scope: Scope | None = None) -> Typed:
        got = compile_expression(e, self.typed(), scope)
        if not isinstance(got, Typed):
            raise ExpressionError("a column needs a scalar value")
        return got

    def aliased(self, alias: str) -> ZSet:
        """A name by which a join's attributes can qualify this relation's columns; it holds for that join only."""
        return ZSet(self.df, self.unsigned, alias)

    def consolidated(self) -> ZSet:
        """One line per row, without rows whose weights cancel out."""
        if self.single is not None and self.single():
            return self._with(self.df.filter(F.col(W) != 0))
        summed = self.df.groupBy(*(F.col(f"`{c}`") for c in self.columns)).agg(F.sum(W).alias(W))
        return self._with(summed.filter(F.col(W) != 0))

    def project(self, attributes: Mapping[str, object], scope: Scope | None = None) -> ZSet:
        """Computed columns; rows that become equal add up."""
        got = {n: self.compile(e, scope) for n, e in attributes.items()}
        return self._with(self.df.select(*(t.column.alias(n) for n, t in got.items()), F.col(W)), frozenset(n for n, t in got.items() if t.type == "uint"))

    def pick(self, columns: Mapping[str, str]) -> ZSet:
        """Columns under new names and in a new order, as they are."""
        if gone := [c for c in columns.values() if c not in self.columns]:
            raise ExpressionError(f"no columns {gone}")
        return self._with(self.df.select(*(F.col(f"`{c}`").alias(n) for n, c in columns.items()), F.col(W)), frozenset(n for n, c in columns.items() if c in self.unsigned))

    def select(self, condition: object, scope: Scope | None = None) -> ZSet:
        return self._with(self.df.filter(truthy(self.compile(condition, scope))))

    def _sides(self, other: ZSet, on: Sequence[tuple[object, object]], scope: Scope | None) -> tuple[DataFrame, DataFrame, Column | None]:
        """Both sides under names of their own, with their keys computed, and the condition."""
        keys = [(self.compile(a, scope), other.compile(b, scope)) for a, b in on]
        for a, b in keys:
            if a.type != b.type:
                raise ExpressionError(f"a join's keys need one type, not {a.type} and {b.type}")
        left = self.df.select(*(F.col(f"`{c}`").alias(f"l_{k}") for k, c in enumerate(self.columns)), *(a.column.alias(f"lk_{k}") for k, (a, _) in enumerate(keys)), F.col(W).alias("l_w"))
        right = other.df.select(*(F.col(f"`{c}`").alias(f"r_{k}") for k, c in enumerate(other.columns)), *(b.column.alias(f"rk_{k}") for k, (_, b) in enumerate(keys)), F.col(W).alias("r_w"))
        cond = None
        for k in range(len(keys)):
            c = F.col(f"lk_{k}").eqNullSafe(F.col(f"rk_{k}"))
            cond = c if cond is None else cond & c
        return left, right, cond

    def _joined(self, other: ZSet, joined: DataFrame, attributes: Mapping[str, object] | None, scope: Scope | None) -> ZSet:
        """Columns of a join: the left side's, then the right side's that don't share a name with one of the left;
        or `attributes`, which may qualify names by the sides' aliases."""
        names: dict[str, Typed] = {}
        for side, z in (("l", self), ("r", other)):
            for k, (c, t) in enumerate(z.typed().items()):
                col = Typed(F.col(f"{side}_{k}"), t.type)
                names.setdefault(c, col)
                if z.alias:
                    names[f"{z.alias}.{c}"] = col
        weight = (F.col("l_w") * F.col("r_w")).alias(W)
        if attributes is None:
            plain = {c: t for c, t in names.items() if "." not in c or c in self.columns + other.columns}
            return ZSet(joined.select(*(t.column.alias(c) for c, t in plain.items()), weight), frozenset(c for c, t in plain.items() if t.type == "uint"))
        got = {n: compile_expression(e, names, scope) for n, e in attributes.items()}
        return ZSet(joined.select(*(t.column.alias(n) for n, t in got.items()), weight), frozenset(n for n, t in got.items() if t.type == "uint"))

    def join(self, other: ZSet, on: Sequence[tuple[object, object]], attributes: Mapping[str, object] | None = None, scope: Scope | None = None) -> ZSet:
        """Equi-join on pairs of expressions, null equal to null; weights multiply. No pairs: the product."""
        left, right, cond = self._sides(other, on, scope)
        return self._joined(other, left.crossJoin(right) if cond is None else left.join(right, cond), attributes, scope)

    def product(self, other: ZSet, attributes: Mapping[str, object] | None = None, scope: Scope | None = None) -> ZSet:
        return self.join(other, [], attributes, scope)

    def theta_join(self, other: ZSet, condition: object, attributes: Mapping[str, object] | None = None, on: Sequence[tuple[object, object]] = (), scope: Scope | None = None) -> ZSet:
        """Pairs that meet a condition over both sides' columns (by alias where names clash). Equalities in `on` keep
        it a hash or merge join; without them Spark compares all pairs."""
        left, right, cond = self._sides(other, on, scope)
        names: dict[str, Typed] = {}
        for side, z in (("l", self), ("r", other)):
            for k, (c, t) in enumerate(z.typed().items()):
                names.setdefault(c, Typed(F.col(f"{side}_{k}"), t.type))
                if z.alias:
                    names[f"{z.alias}.{c}"] = Typed(F.col(f"{side}_{k}"), t.type)
        met = truthy(compile_expression(condition, names, scope))
        if cond is not None:
            left, right, share = _shared_out(left, right)
            cond = cond & share
        out = self._joined(other, left.join(right, met if cond is None else cond & met), attributes, scope)
        return replace(out, single=lambda: self._told_apart(other, attributes))

    def _told_apart(self, other: ZSet, attributes: Mapping[str, object] | None) -> bool:
        """Whether a join's plain columns tell each side's lines apart, so that no two pairs of lines make one row."""
        if attributes is None:
            mine, theirs = self.columns, [c for c in other.columns if c not in self.columns]
        else:
            mine, theirs = [], []
            for e in attributes.values():
                if not isinstance(e, Ref):
                    continue
                for z, into in ((self, mine), (other, theirs)):
                    name = e.name.removeprefix(f"{z.alias}.") if z.alias else e.name
                    if name in z.columns and (name != e.name or into is mine or e.name not in self.columns):
                        into.append(name)
                        break
        return all(cs and z.df.groupBy(*(F.col(f"`{c}`") for c in cs)).agg(F.count("*").alias("__n")).filter("__n > 1").isEmpty() for z, cs in ((self, mine), (other, theirs)))

    def anti_join(self, other: ZSet, on: Sequence[tuple[object, object]], scope: Scope | None = None) -> ZSet:
        """This side's rows whose key no row of the other side has, with their columns and weights."""
        left, right, cond = self._sides(other.consolidated(), on, scope)
        if cond is None:
            raise ExpressionError("an anti-join needs keys")
        keep = left.join(right.select(*(f"rk_{k}" for k in range(len(on)))), cond, "left_anti")
        return self._with(keep.select(*(F.col(f"l_{k}").alias(c) for k, c in enumerate(self.columns)), F.col("l_w").alias(W)))

    def semi_join(self, other: ZSet, on: Sequence[tuple[object, object]], scope: Scope | None = None) -> ZSet:
        left, right, cond = self._sides(other.consolidated(), on, scope)
        keep = left.join(right.select(*(f"rk_{k}" for k in range(len(on)))), cond, "left_semi")
        return self._with(keep.select(*(F.col(f"l_{k}").alias(c) for k, c in enumerate(self.columns)), F.col("l_w").alias(W)))

    def _aligned(self, other: ZSet) -> DataFrame:
        if len(self.columns) != len(other.columns):
            raise ExpressionError(f"{len(self.columns)} columns against {len(other.columns)}")
        return other.df.select(*(F.col(f"`{b}`").alias(a) for a, b in zip(self.columns, other.columns, strict=True)), W)

    def union(self, *others: ZSet) -> ZSet:
        """Weights add up; columns go by position, the first relation names them."""
        if not others:
            raise ExpressionError("a union needs two relations")
        df = self.df.select(*(F.col(f"`{c}`") for c in self.columns), W)
        for o in others:
            df = df.unionAll(self._aligned(o))
        return self._with(df).consolidated()

    def negated(self) -> ZSet:
        return self._with(self.df.withColumn(W, -F.col(W)))

    def difference(self, other: ZSet) -> ZSet:
        """Weights subtract and may become negative."""
        return self._with(self.df.select(*(F.col(f"`{c}`") for c in self.columns), W).unionAll(self._aligned(other.negated()))).consolidated()

    def distinct(self) -> ZSet:
        """Weight 1 for rows whose weight is positive."""
        return self._with(self.consolidated().df.filter(F.col(W) > 0).withColumn(W, F.lit(1).cast("long")))

    def intersect(self, other: ZSet) -> ZSet:
        """Rows that both sides hold, each once."""
        return self.distinct().semi_join(other.distinct(), [(Typed(F.col(f"`{a}`"), self.typed()[a].type), Typed(F.col(f"`{b}`"), other.typed()[b].type)) for a, b in zip(self.columns, other.columns, strict=True)])

    def table(self, rows: int = 20) -> str:
        """The first rows with their weights, as text."""
        return self.consolidated().df.select(F.col(W).alias("weight"), *(F.col(f"`{c}`") for c in self.columns))._show_string(rows, False)

    def weighted(self, name: str = "w") -> DataFrame:
        """Consolidated rows with their weight as an ordinary column."""
        return self.consolidated().df.withColumnRenamed(W, name)
