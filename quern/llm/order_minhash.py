"""Order MinHash fingerprints: tuples of minimal, occurrence-numbered k-mers that keep their order in the text."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a k-mer, k-mers of a tuple, tuples of a fingerprint (each 32 bits, 8 hex digits).
K, TUPLE, SKETCHES = 10, 2, 48
_ROOM = 1 << 21  # elements of one block of permuted hashes: bounds memory for very long texts


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbered(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each k-mer and of how many like it stand before it. A shorter text is one k-mer."""
    k = min(K, len(codes))
    n = len(codes) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[j : j + n]
    h = _mixed(h + np.uint64(k))
    bits = np.uint64(max(1, n.bit_length()))
    keys = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    keys.sort()
    at = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    alike = keys >> bits
    new = np.r_[True, alike[1:] != alike[:-1]]
    place = np.arange(n)
    before = np.empty(n, np.uint64)
    before[at] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return _mixed(h + before * np.uint64(0xD1B54A32D192ED03))


def sketch(text: str) -> np.ndarray:
    """SKETCHES 32-bit values; all zero for an empty text."""
    if not text:
        return np.zeros(SKETCHES, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    full = _numbered(codes)
    short = (full >> np.uint64(32)).astype(np.uint32)
    n = len(full)
    draw = np.random.RandomState(20)
    times = draw.randint(0, 1 << 32, SKETCHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    masks = draw.randint(0, 1 << 32, SKETCHES, dtype=np.uint64).astype(np.uint32)
    chosen = np.full((TUPLE, SKETCHES), -1)
    step = max(1, _ROOM // n)
    for s in range(0, SKETCHES, step):
        order = (short[None, :] ^ masks[s : s + step, None]) * times[s : s + step, None]
        rows = np.arange(len(order))
        for t in range(min(TUPLE, n)):
            chosen[t, s : s + step] = least = order.argmin(axis=1)
            order[rows, least] = np.uint32(0xFFFFFFFF)
    chosen.sort(axis=0)
    out = np.full(SKETCHES, 0x2545F4914F6CDD1D, np.uint64)
    for t in range(TUPLE):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.where(chosen[t] >= 0, full[chosen[t]], np.uint64(0)))
    return (out >> np.uint64(32)).astype(np.uint32)


def hex_of(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of tuples that two fingerprints have in common: near 1 for a small edit distance."""
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many, or all, of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part, each part's documents in order and then the document that follows its last."""
    kinds = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    held: tuple | None = None
    for batch in batches:
        out: list[tuple] = []
        for part, follows, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if follows and (held is None or held[0] != part):
                continue  # a repeated row of the document that follows: the first was used
            mine = sketch(text)
            if held is not None:
                _, before, old, print_ = held
                edited = edited_text(old, text)
                changed = sketch(edited)
                out.append((before, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), hex_of(print_), hex_of(changed), likeness(print_, changed), likeness(print_, mine)))
            held = None if follows else (part, doc, text, mine)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds.types, strict=True)], schema=kinds)


@dataclass(frozen=True)
class Ranges:
    """Ranges of (id descending, null ids last; hash of the text), about as many rows in each. `bounds` are ids at which
    a range ends, ascending; an id that holds more rows than a range has `extra` ranges of its own, cut by the hash."""

    bounds: np.ndarray
    extra: np.ndarray
    of_null: int

    @staticmethod
    def of(cuts: list[float], null_share: float, parts: int) -> Ranges:
        """From quantiles of the ids, in which an id that holds many rows stands many times."""
        bounds, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        return Ranges(bounds, np.where(times > 1, times, 0), max(1, math.ceil(null_share * parts)))

    @property
    def count(self) -> int:
        return len(self.bounds) + 1 + int(self.extra.sum()) + self.of_null

    def place(self, ids: np.ndarray, null: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each row's range, in order."""
        above = np.r_[np.cumsum(self.extra[::-1])[::-1], 0]  # ranges of their own of the bounds from here on
        at = np.searchsorted(self.bounds, ids, side="right")
        slot = len(self.bounds) - at + above[at]
        h = hashes.view(np.uint64) ^ np.uint64(1 << 63)  # in the order of the signed numbers
        share = lambda n: ((h >> np.uint64(32)) * n.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        if len(self.bounds):
            low = np.maximum(at - 1, 0)
            own = np.where((at > 0) & (self.bounds[low] == ids), self.extra[low], 0)
            slot = slot + np.where(own > 0, 1 + share(own), 0)
        return np.where(null, self.count - self.of_null + share(np.full(len(ids), self.of_null)), slot)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit by the next document in descending order of ids.

    One row per document: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); null
    texts count as empty. Ids are whole numbers. Rows that repeat an id stand in the order of their texts' XXH64, rows
    with a null id come last, and the first document follows the last; a single document follows itself. The table is
    cut into ranges, also within an id that holds many rows; each range's first document also goes to the range before
    it, so texts cross the network once, and no task holds more than a range. Columns other than the two named are not
    read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    cuts = rows.approxQuantile("id", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    counted = rows.agg(F.count("*").alias("n"), F.count("id").alias("known")).first()
    ranges = Ranges.of(cuts, 1 - counted.known / max(1, counted.n), parts)

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        null = ids.is_null().to_numpy(zero_copy_only=False)
        return pa.array(ranges.place(ids.fill_null(0).to_numpy(zero_copy_only=False), null, hashes.to_numpy(zero_copy_only=False)).astype(np.int32))

    dealt = rows.withColumn("h", F.xxhash64("text")).withColumn("part", range_of("id", "h"))
    least = F.max(F.struct("id", F.bitwise_not("h").alias("back")))  # the first in order: the largest id, the least hash
    tops = dealt.groupBy("part").agg(least.alias("top")).orderBy("part").collect()  # one row per range
    before = [(r.part, r.top.id, ~r.top.back, tops[k - 1].part) for k, r in enumerate(tops)]
    first = F.broadcast(spark.createDataFrame(before, "p int, top long, top_h long, prior int"))
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("follows"))
    there = F.struct(F.col("prior").alias("part"), F.lit(True).alias("follows"))
    leads = F.col("id").eqNullSafe(F.col("top")) & (F.col("h") == F.col("top_h"))
    copies = F.when(leads, F.array(here, there)).otherwise(F.array(here))
    sent = dealt.join(first, F.col("part") == F.col("p")).select("id", "text", "h", F.explode(copies).alias("c")).select("c.part", "c.follows", "id", "text", "h")
    placed = sent.repartitionById(ranges.count, F.col("part"))
    ordered = placed.sortWithinPartitions("part", "follows", F.col("id").desc_nulls_last(), "h", "text")
    got = ordered.mapInArrow(_walk, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return got.withColumnRenamed("id", id_col)
