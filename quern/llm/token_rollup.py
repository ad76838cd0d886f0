"""Token totals by source, language and tokenizer version, kept up by signed deltas in idempotent batch commits."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Counting rules by version; a ledger can hold any others, as counts come to it as numbers.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}
DIMENSIONS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def token_count(version: str, text: Column) -> Column:
    """How many tokens a rule finds in a whole text; none in a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def counted(docs: DataFrame, versions: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens): a row per document and version, in one pass over the texts."""
    each = F.array(*(F.struct(F.lit(v).alias("tokenizer"), token_count(v, F.col(text_col)).alias("tokens")) for v in versions))
    return docs.select("doc_id", "source", "lang", F.explode(each).alias("c")).select("doc_id", "source", "lang", "c.*")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*DIMENSIONS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*DIMENSIONS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """What was counted leaves, what is counted now comes: equal rows cancel out in the totals."""
    return deletes(before).unionAll(inserts(after))


class TokenLedger:
    """A folder of committed batches, each the summed deltas of one batch id.

    A batch is summed before it is kept, so a group that holds most rows adds one row per task to the shuffle. Every
    attempt is written under a name of its own, then claims its batch id: a small file that names the attempt is put
    in place whole, by a link (local files) or a rename that refuse a target which is there. The first claim of an id
    stands; totals read only what a claim names. So a batch may be sent again after any failure, by several writers
    at once, too, and counts once; an attempt that was lost or late leaves rows that nobody reads. Null dimensions
    are a group of their own. The totals are sums, so batches may come in any order; groups that come to nothing are
    not listed, and without batches there are none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._local = self._fs.getScheme() == "file"
        for d in ("batches", "claims", "drafts"):
            self._fs.mkdirs(self._at(f"{self.path}/{d}"))

    def _marker(self, batch_id: str) -> str:
        return f"{self.path}/claims/{json.dumps(str(batch_id)).encode().hex()}"

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._at(self._marker(batch_id)))

    def _claim(self, batch_id: str, attempt: str) -> bool:
        draft, marker = self._at(f"{self.path}/drafts/{attempt}"), self._at(self._marker(batch_id))
        out = self._fs.create(draft)
        out.write(bytearray(attempt.encode()))
        out.close()
        try:
            if not self._local:
                return self._fs.rename(draft, marker)
            os.link(draft.toUri().getPath(), marker.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            self._fs.delete(draft, False)

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch's signed rows to the totals; False if its id was committed before."""
        if self.committed(batch_id):
            return False
        attempt = uuid.uuid4().hex
        summed = deltas.groupBy(*DIMENSIONS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        rows = summed.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in _SCHEMA.split(", ")), F.lit(attempt).alias("attempt"))
        rows.write.parquet(f"{self.path}/batches/{attempt}")
        if self._claim(batch_id, attempt):
            return True
        self._fs.delete(self._at(f"{self.path}/batches/{attempt}"), True)
        return False

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of all committed batches."""
        rows = self.spark.read.schema(f"{_SCHEMA}, attempt string").option("recursiveFileLookup", "true").parquet(f"{self.path}/batches")
        claims = self.spark.read.schema("value string").text(f"{self.path}/claims").withColumnRenamed("value", "attempt")
        summed = rows.join(claims, "attempt", "left_semi").groupBy(*DIMENSIONS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.filter("docs <> 0 OR tokens <> 0")
