"""Extendible hashing into shards: a directory on hash bits in which only oversized buckets split on a further bit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise, utf8

#: Bits of the key's hash, and of a hash that tells rows with equal keys apart: the directory goes on to the latter.
KEY_BITS, ROW_BITS = 64, 64
#: Bits that a round looks ahead at most; each row of the round's totals is repeated so often.
LOOK_AHEAD = 12


def bits_of(hexadecimal: Column) -> Column:
    """The 64 binary digits of 16 hexadecimal ones."""
    return F.lpad(F.conv(hexadecimal, 16, 2), 64, "0")


def sharded(docs: DataFrame, limit_bytes: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (key, n_bytes, depth, shard).

    A shard is named by the bits that its rows' hashes begin with, `depth` of them: the fewest at which the bucket's
    bytes fit `limit_bytes`. Only a single row can be larger; it is a shard of its own. The key's hash is the front
    of its MD5 (a null key is hashed as such); rows with equal keys differ in further bits that their place in the
    written table gives, so that a key that holds most rows still splits. Null texts have no bytes; an empty table
    has no shards. A round sums all open buckets over the next bits at once, then goes on with the rows of buckets
    that are still too large: the rounds grow with the logarithm of the number of shards, and totals, not rows, are
    grouped. The directory stays a distributed table.
    """
    row = F.substring(F.md5(F.concat(F.lit("row"), F.monotonically_increasing_id().cast("string")).cast("binary")), 1, 16)
    key = F.substring(F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit("null")).cast("binary")), 1, 16)
    rows = materialise(
        docs.select(F.col(key_col).alias("k"), F.octet_length(utf8(text_col)).cast("long").alias("n_bytes"), F.concat(bits_of(key), bits_of(row)).alias("bits")), "shard-rows"
    )
    top = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    done = rows.limit(0).select("k", "n_bytes", F.lit(0).alias("depth"), F.lit("").alias("shard"))
    if top.bytes <= limit_bytes or top.n <= 1:
        return rows.select(F.col("k").alias(key_col), "n_bytes", F.lit(0).alias("depth"), F.lit("").alias("shard"))
    left, at, largest = rows, 0, top.bytes
    while largest and at < KEY_BITS + ROW_BITS:
        ahead = min(LOOK_AHEAD, max(1, math.ceil(math.log2(max(2.0, largest / max(1, limit_bytes)))) + 1), KEY_BITS + ROW_BITS - at)
        to = at + ahead
        cells = left.groupBy(F.substring("bits", 1, to).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        up = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(at + 1), F.lit(to))).alias("depth"))
        buckets = up.withColumn("bucket", F.expr("substring(cell, 1, depth)")).groupBy("depth", "bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        fits = buckets.filter((F.col("bytes") <= limit_bytes) | (F.col("n") == 1)).select(F.col("depth").alias("d"), F.col("bucket").alias("b"))
        found = up.join(fits, (F.col("depth") == F.col("d")) & (F.expr("substring(cell, 1, depth)") == F.col("b"))).groupBy("cell").agg(F.min("depth").alias("depth"))
        directory = materialise(cells.join(found, "cell", "left").select(F.col("cell").alias("c"), "depth", "bytes"), "directory")
        placed = left.join(directory.drop("bytes"), F.substring("bits", 1, to) == F.col("c")).drop("c")
        open_ = directory.filter("depth is null").agg(F.max("bytes").alias("most")).first().most
        done = done.unionAll(placed.filter("depth is not null").select("k", "n_bytes", "depth", F.expr("substring(bits, 1, depth)").alias("shard")))
        if open_ is None:
            break
        left, at, largest = materialise(placed.filter("depth is null").drop("depth"), "shard-rows"), to, open_
    return done.withColumnRenamed("k", key_col)
