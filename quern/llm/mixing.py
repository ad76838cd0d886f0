"""Temperature mixing of sources: a bisected exponent over token shares, realised as budgeted block permutations.

Sources' totals stay a table. The exponent needs two sums over them (of the raised shares, and of these times their
logarithm), so a search narrows it by one job for many exponents at once; there may be any number of sources.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, materialise

#: Blocks of a source: each epoch permutes them, and the last, partial epoch takes whole blocks and a part of one.
BLOCKS = 1024
#: Totals of so many sources come to the driver for the search, and their plan is broadcast; more stay tables.
LOCAL_SOURCES = 10_000
#: Rows of one source that one task orders to find where a partial epoch ends; more are narrowed down first.
CUT_ROWS = 100_000
#: Exponents tried by one pass over the totals, and passes: the interval ends up 16 ** 10 times narrower.
_GRID, _PASSES = 16, 10
WORD = r"[^\x20\x09-\x0D]+"
_LOW = -(1 << 63)

#: For some exponents: the sum of (tokens / top) ** a, and of the same times the logarithm of tokens / top.
Sums = Callable[[Sequence[float]], list[tuple[float, float]]]


@dataclass(frozen=True)
class Corpus:
    """What a search knows of the sources with tokens: their number, largest and smallest tokens, all, and sums."""

    sources: int
    top: int
    least: int
    tokens: int
    sums: Sums

    def entropy(self, exponents: Sequence[float]) -> list[float]:
        return [math.log(s) - a * t / s for a, (s, t) in zip(exponents, self.sums(exponents), strict=True)]

    def whole(self, exponent: float, budget: int | None) -> float:
        """All tokens of the mix: the budget, or what lets every source be seen once at least."""
        return budget if budget is not None else max(0, math.ceil(self.sums([exponent])[0][0] * self.top - 1e-6)) if self.sources else 0

    def most_seen(self, exponents: Sequence[float], budget: int | None) -> list[float]:
        """How often the most repeated source, which is the smallest one, is seen."""
        r = self.least / self.top
        return [(budget / (s * self.least) if budget is not None else self.top / self.least) * r**a for a, (s, _) in zip(exponents, self.sums(exponents), strict=True)]


def of_totals(tokens: Sequence[int]) -> Corpus:
    n = np.array([x for x in tokens if x], float)
    log = np.log(n / n.max()) if len(n) else n

    def sums(exponents: Sequence[float]) -> list[tuple[float, float]]:
        raised = [np.exp(a * log) for a in exponents]
        return [(math.fsum(r), math.fsum(r * log)) for r in raised]

    return Corpus(len(n), int(n.max(initial=0)), int(n.min()) if len(n) else 0, int(n.sum()), sums)


def of_table(totals: DataFrame) -> Corpus:
    """The same for a table with a column n, which is not collected."""
    used = totals.filter("n > 0")
    k = used.agg(F.count("*").alias("k"), F.coalesce(F.max("n"), F.lit(0)).alias("top"), F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    log = F.log(F.col("n") / F.lit(float(max(1, k.top))))

    def sums(exponents: Sequence[float]) -> list[tuple[float, float]]:
        raised = [F.exp(log * a) for a in exponents]
        found = used.agg(*(F.sum(r) for r in raised), *(F.sum(r * log) for r in raised)).first()
        return list(zip(found[: len(raised)], found[len(raised) :], strict=True))

    return Corpus(k.k, int(k.top), int(k.least), int(k.n), sums)


def _last(holds: Callable[[Sequence[float]], list[bool]], low: float, high: float) -> float:
    """The largest number in [low, high] at which `holds` is true, given that it holds at low and then fails for good."""
    if holds([high])[0]:
        return high
    for _ in range(_PASSES):
        grid = [low + (high - low) * k / _GRID for k in range(1, _GRID)]
        good = sum(holds(grid))
        low, high = grid[good - 1] if good else low, grid[good] if good < len(grid) else high
    return low


def exponent_for(corpus: Corpus, target_entropy: float | None, max_epochs: float | None, budget: int | None) -> float:
    """Flatten as far as the target asks, but no further than the repetition limit allows.

    `target_entropy` is a share of the largest entropy there is, the logarithm of the number of sources. The largest
    exponent in [0, 1] that reaches it is taken. If at this exponent a source would be seen more than `max_epochs`
    times, the exponent rises to the least at which none is (to 1 if there is none below)."""
    if corpus.sources < 2:
        return 1.0
    goal = (target_entropy if target_entropy is not None else 1.0) * math.log(corpus.sources) - 1e-12
    flat = _last(lambda grid: [h >= goal for h in corpus.entropy(grid)], 0.0, 1.0)
    if max_epochs is None or corpus.most_seen([flat], budget)[0] <= max_epochs:
        return flat
    return 1.0 - _last(lambda grid: [x <= max_epochs for x in corpus.most_seen([1.0 - d for d in grid], budget)], 0.0, 1.0 - flat)


def planned(totals: DataFrame, target_entropy: float | None = 0.95, max_epochs: float | None = 1.5, budget: int | None = None) -> DataFrame:
    """What each source of `totals` (s, n) gets: (s, n, weight, budget, epochs, rest): `epochs` whole passes over it and
    `rest` tokens of a further one. Without a budget the whole is as large as lets every source be seen once at least,
    so no document is left out. Budgets are whole numbers and add up to the whole: what rounding leaves goes to the
    largest source. A source without tokens is passed over once; an empty table has no plan."""
    few = totals.limit(LOCAL_SOURCES + 1).count() <= LOCAL_SOURCES
    corpus = of_totals([int(r.n) for r in totals.select("n").collect()]) if few else of_table(totals)
    a = exponent_for(corpus, target_entropy, max_epochs, budget)
    whole = corpus.whole(a, budget)
    sums = corpus.sums([a])[0][0] if corpus.sources else 1.0
    n = F.col("n")
    weight = F.when(n > 0, F.exp(F.log(n / F.lit(float(max(1, corpus.top)))) * a) / sums).otherwise(0.0)
    given = totals.select("s", "n", weight.alias("weight")).withColumn("budget", F.floor(F.col("weight") * float(whole) + 1e-6).cast("long"))
    if budget is None:
        given = given.withColumn("budget", F.greatest("budget", "n"))
    else:
        left = budget - int(given.agg(F.coalesce(F.sum("budget"), F.lit(0))).first()[0])
        largest = given.orderBy(F.desc("n"), F.asc_nulls_last("s")).limit(1).select("s").collect() if corpus.sources else []
        if largest and left:
            given = given.withColumn("budget", F.col("budget") + F.when(F.col("s").eqNullSafe(F.lit(largest[0].s)), left).otherwise(0))
    epochs = F.when(n > 0, F.expr("budget div n")).otherwise(1).cast("int")
    return given.withColumn("epochs", epochs).withColumn("rest", F.when(n > 0, F.col("budget") % n).otherwise(0).cast("long"))


def _place(seed: int, epoch: Column, what: Column, source: Column) -> Column:
    """The place of a block or a row in an epoch's permutation of its source."""
    return F.xxhash64(F.lit(seed), epoch, source, what)


def _cuts(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Where partial epochs end, a row for each source that has one: (s, bk, b, rk). Blocks whose place is below `bk`
    come whole; of block `b` the rows up to place `rk`; null where there are none.

    rows: (s, b, i, n). The first block, in its order, that does not fit whole is found from sums by block, then the
    rows of it that fit: from sums by ranges of places, each a thousandth of the one before, until a range holds no more
    than CUT_ROWS rows, and row by row in that one. No window is larger than the ranges or CUT_ROWS, whatever a source
    holds; only rows that share one place (those of one id) stay together."""
    partial = plan.filter("rest > 0").select("s", "epochs", "rest")
    small = partial.limit(LOCAL_SOURCES + 1).count() <= LOCAL_SOURCES
    hint = F.broadcast if small else (lambda df: df)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    place = Window.partitionBy("s").orderBy("k")
    blocks = rows.groupBy("s", "b").agg(F.sum("n").alias("n"))
    asked = hint(partial.select(F.col("s").alias("ps"), "epochs", "rest"))
    ordered = blocks.join(asked, same("s", "ps")).select("s", "b", "n", "epochs", "rest", _place(seed, F.col("epochs"), F.col("b"), F.col("s")).alias("k"))
    over = ordered.withColumn("c", F.sum("n").over(place)).filter("c > rest")
    ends = over.groupBy("s").agg(F.min(F.struct("k", "b", (F.col("rest") - F.col("c") + F.col("n")).alias("room"), "epochs")).alias("x"))
    ends = materialise(ends.select("s", F.col("x.k").alias("bk"), F.col("x.b").alias("b"), F.col("x.room").alias("room"), F.col("x.epochs").alias("epochs")), "mix-blocks")
    at = hint(ends.select(F.col("s").alias("ps"), F.col("b").alias("pb"), "room", "epochs"))
    inside = rows.join(at, same("s", "ps") & (F.col("b") == F.col("pb"))).select("s", "n", "room", _place(seed, F.col("epochs"), F.col("i"), F.col("s")).alias("k"))
    inside = materialise(inside, "mix-rows").withColumn("done", F.lit(None).cast("long"))
    bits = 64
    while bits > 10 and (inside.groupBy("s").count().agg(F.max("count")).first()[0] or 0) > CUT_ROWS:
        bits -= 10
        cells = inside.groupBy("s", F.shiftright("k", bits).alias("k")).agg(F.sum("n").alias("n"), F.first("room").alias("room"), F.max("done").alias("done"))
        running = cells.withColumn("c", F.sum("n").over(place))
        state = running.groupBy("s").agg(
            F.min(F.when(F.col("c") > F.col("room"), F.struct("k", (F.col("room") - F.col("c") + F.col("n")).alias("left")))).alias("x"),
            F.max(F.when(F.col("c") <= F.col("room"), F.col("k"))).alias("whole"), F.max("done").alias("d"),
        )
        # `done`: the last place known to fit; the largest of a range that fits whole
        upto = F.when(F.col("whole").isNotNull(), F.call_function("shiftleft", F.col("whole") + 1, F.lit(bits)) - 1)
        narrowed = hint(state.select(F.col("s").alias("ps"), F.col("x.k").alias("cell"), F.col("x.left").alias("left"), F.coalesce(upto, "d").alias("now")))
        kept = inside.drop("done").join(narrowed, same("s", "ps") & (F.shiftright("k", bits) == F.col("cell")))
        inside = materialise(kept.select("s", "n", F.col("left").alias("room"), "k", F.col("now").alias("done")), "mix-rows")
    by_place = inside.groupBy("s", "k").agg(F.sum("n").alias("n"), F.first("room").alias("room"), F.max("done").alias("done"))
    fits = by_place.withColumn("c", F.sum("n").over(place)).groupBy("s").agg(F.coalesce(F.max(F.when(F.col("c") <= F.col("room"), F.col("k"))), F.max("done")).alias("rk"))
    joined = ends.join(hint(fits.withColumnRenamed("s", "fs")), same("s", "fs"), "left")
    return joined.select("s", "bk", "b", "rk")


def token_count(text_col: str = "text") -> Column:
    """The words of a text; none in a null one."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def column_names(columns: Sequence[str], prefix: str = "mix_") -> dict[str, str]:
    """The names of mixing's columns beside `columns`: none clashes."""
    return {k: fresh(columns, prefix + k) for k in ("tokens", "weight", "epoch", "block", "order")}


def mixed(
    docs: DataFrame, target_entropy: float | None = 0.95, max_epochs: float | None = 1.5, budget: int | None = None,
    seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prefix: str = "mix_",
    tokens_col: str | None = None,
) -> DataFrame:
    """`docs` with each row as often as its source's budget says, and columns <prefix>tokens (words), weight, epoch,
    block and order (see `column_names`, where `docs` has columns of these names). Sorting by <prefix>order interleaves
    the sources at their weights: within a source it goes epoch by epoch, in each through a permutation of the blocks,
    and of the rows in a block.

    The partial epoch takes whole blocks in its permuted order while they fit, and of the next one the rows that fit;
    rows with equal keys (repeated ids) go together. So no source exceeds its budget, but for sources that are seen
    once without a budget. A null source is a source of its own; null ids are one key; null texts have no tokens and
    follow their block; an empty table gives no rows. `tokens_col` names a column with the texts' tokens, if they are
    known: texts are then not read.
    """
    names = column_names(docs.columns, prefix)
    tokens = F.coalesce(F.col(tokens_col), F.lit(0)).cast("long") if tokens_col else token_count(text_col)
    block = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(BLOCKS)).cast("int")
    rows = materialise(docs.select(F.col(source_col).cast("string").alias("s"), block.alias("b"), F.col(id_col).alias("i"), tokens.alias("n")), "mix-counts")
    totals = materialise(rows.groupBy("s").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "mix-totals")
    plan = materialise(planned(totals.select("s", "n"), target_entropy, max_epochs, budget), "mix-plan")
    cuts = _cuts(rows, plan, seed)
    p = {k: fresh([*docs.columns, *names.values()], f"plan_{k}") for k in ("s", "w", "e", "bk", "b", "rk")}
    # a partial epoch that no block ends takes all blocks; one without tokens none
    whole = F.when(F.col("rest") > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(_LOW))
    ended = plan.join(cuts.withColumnRenamed("s", "cs"), F.col("s").eqNullSafe(F.col("cs")), "left")
    final = materialise(ended.select(F.col("s").alias(p["s"]), F.col("weight").alias(p["w"]), F.col("epochs").alias(p["e"]), F.coalesce("bk", whole).alias(p["bk"]), F.col("b").alias(p["b"]), F.col("rk").alias(p["rk"])), "mix-final")
    source, last = F.col(p["s"]), F.col(p["e"])
    on = F.col(source_col).cast("string").eqNullSafe(source)
    if totals.limit(LOCAL_SOURCES + 1).count() <= LOCAL_SOURCES:
        joined = docs.join(F.broadcast(final), on)
    else:  # sources with a good share of the rows are broadcast, there are few; no key of the other join is frequent
        share = rows.count() // LOCAL_SOURCES
        hot = materialise(totals.filter(F.col("rows") > share).select(F.col("s").alias("hot"), F.lit(True).alias("is_hot")), "mix-hot")
        mark = fresh([*docs.columns, *names.values()], "plan_hot")
        marked = docs.join(F.broadcast(hot.withColumnRenamed("is_hot", mark)), F.col(source_col).cast("string").eqNullSafe(F.col("hot")), "left").select(*(docs[c] for c in docs.columns), mark)
        heavy = final.join(F.broadcast(hot), F.col(p["s"]).eqNullSafe(F.col("hot")), "left_semi")
        joined = marked.filter(F.col(mark)).join(F.broadcast(heavy), on).drop(mark).unionAll(marked.filter(F.col(mark).isNull()).join(final, on).drop(mark))
    blk, epoch = F.col(names["block"]), F.col(names["epoch"])
    in_block = _place(seed, last, blk, source) < F.col(p["bk"])
    in_rows = (blk == F.col(p["b"])) & (_place(seed, last, F.col(id_col), source) <= F.col(p["rk"]))
    times = last + (in_block | F.coalesce(in_rows, F.lit(False))).cast("int")
    copies = F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>")))
    seen = joined.withColumn(names["block"], block).withColumn(names["tokens"], tokens).withColumn(names["epoch"], copies)
    unit = lambda h: h.cast("double") / float(1 << 64) + 0.5
    share = F.greatest(last + F.when(F.col(p["bk"]) == _LOW, 0.0).otherwise(unit(F.col(p["bk"]))), F.lit(1e-9))
    place = unit(_place(seed, epoch, blk, source)) + unit(_place(seed, epoch, F.col(id_col), source)) / float(BLOCKS * 1024)
    out = seen.withColumn(names["weight"], F.col(p["w"])).withColumn(names["order"], (epoch + place) / share)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *names.values())


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows that mixing deals out, with the columns of `docs` only."""
    return mixed(docs, **options).select(*(F.col(f"`{c}`") for c in docs.columns))
