"""What the operators of this package share: session settings, scratch tables, text access and components."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import scratch
from quern.sources.scratch import written

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds of very long texts.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Bound the batches of Arrow and of the parquet reader, so that a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared scratch folder and read it again: a cut of lineage that outlives lost executors."""
    path, out = written(df, label)
    out._quern_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a materialised table that nothing reads any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        scratch.discard(df.sparkSession, path)


def fresh(columns: Iterable[str], base: str) -> str:
    """A column name like `base` that clashes with none of `columns` (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def utf8(text: str | Column) -> Column:
    """The text's UTF-8 bytes, null as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("binary"), F.lit(b"").cast("binary"))


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo `modulus`; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of an edge list of longs.

    Alternating large-star and small-star contraction: every node hangs its larger neighbours, then its smaller
    ones, below the least node it knows, until a round changes nothing. Rounds grow with the logarithm of the
    largest component; every round is written to the shared folder, so a lost executor costs one round at most.
    Self-loops and repeated edges are allowed; an empty list gives an empty result.
    """
    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least.withColumnRenamed("u", "u2"), F.col("u") == F.col("u2"))
        if small:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        else:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = materialise(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u <> v").distinct(), "edges")
    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        new = materialise(star(star(now, False), True), "stars")
        after = state(new)
        discard(now)
        now = new
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, max_text_bytes: int,
    fold_of: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, data, label): at most `max_rows` labelled documents, those whose ids hash lowest, to fit a model on.

    Only the fit is bounded: `max_rows` ids, and of them the texts of at most `max_text_bytes`. `fold_of` (modulus,
    rest) leaves out ids whose fold has that rest. An id with labels that disagree is left out; of rows that repeat an
    id, the least text counts; ids and labels that are null don't count.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null")
    if fold_of:
        known = known.filter(fold("id", fold_of[0]) != fold_of[1])
    one = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    ids = one.select("id", "label").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc"), utf8(text_col).alias("data")).filter(F.octet_length("data") <= max_text_bytes)
    found = texts.join(F.broadcast(ids), F.col("doc") == F.col("id"))
    return found.groupBy("id", "label").agg(F.min("data").alias("data"))
