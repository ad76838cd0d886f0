"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import compression_quality, decision_list, license_scan, lm_bloom, mixing, order_minhash, packing, sharding, simhash, token_rollup
from quern.llm.common import fold, materialise, table
from quern.sources.scratch import scratch_path


#: Close to equal shares, but no source more than one and a half times.
MIX = {"target_entropy": 0.9999, "max_epochs": 1.5}


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = materialise(docs.select("doc_id", "source", mixing.token_count("text").alias("tokens")), "mix-tokens")
    names = mixing.column_names(counted.columns)
    return mixing.mixed(counted, **MIX, tokens_col="tokens").select("doc_id", "source", *(F.col(n).alias(k) for k, n in names.items()))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compression_quality.fit_on(docs, table(spark, sf_dir, "labels"))
    got = compression_quality.scored(docs, model)
    return got.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "difference", "difference_score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op5_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.scored(table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.with_next(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), limit_bytes=1 << 20)


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.fit_on(docs, table(spark, sf_dir, "labels"))
    got = decision_list.judged(docs, rules)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: all documents come; toxic ones are withdrawn; bad ones are counted anew, now by the second rule
    under the first one's name; and the first batch is sent a second time, which must change nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counts = materialise(token_rollup.counted(docs, ("words-1", "words-2")), "token-counts")
    one_each = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = counts.join(one_each, "doc_id")
    ledger = token_rollup.TokenLedger(spark, scratch_path(spark, "ledger"))
    ledger.commit("load", token_rollup.inserts(counts))
    ledger.commit("withdraw", token_rollup.deletes(marked.filter("toxic = 1")))
    again = marked.filter("toxic = 0 and quality = 0")
    after = again.filter("tokenizer = 'words-2'").withColumn("tokenizer", F.lit("words-1"))
    ledger.commit("revise", token_rollup.revisions(again.filter("tokenizer = 'words-1'"), after))
    ledger.commit("load", token_rollup.inserts(counts))
    return ledger.totals()


QUERIES = {
    "op1_temperature_mixing": op1_temperature_mixing,
    "op2_compression_quality": op2_compression_quality,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_license_scan": op4_license_scan,
    "op5_lm_bloom": op5_lm_bloom,
    "op6_order_minhash": op6_order_minhash,
    "op7_simhash": op7_simhash,
    "op8_extendible_sharding": op8_extendible_sharding,
    "op9_decision_list": op9_decision_list,
    "op10_token_rollup": op10_token_rollup,
}
_COUNTS = r"""
    SELECT doc_id, source, lang,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n1,
           len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS n2
    FROM documents"""
SQL: dict[str, str] = {
    "op8_extendible_sharding": """
WITH d AS (
    SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
           lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS UBIGINT)), 32, '0') AS bits
    FROM documents),
e AS (
    SELECT doc_id, n_bytes, depth, substr(bits, 1, depth) AS shard,
           sum(n_bytes) OVER (PARTITION BY depth, substr(bits, 1, depth)) AS bytes,
           count(*) OVER (PARTITION BY depth, substr(bits, 1, depth)) AS n
    FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 31)))
SELECT doc_id, n_bytes, depth, shard FROM e WHERE bytes <= 1048576 OR n = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1""",
    "op10_token_rollup": f"""
WITH c AS ({_COUNTS}),
m AS (SELECT c.*, coalesce(l.toxic, 0) AS toxic, coalesce(l.quality, 1) AS quality
      FROM c LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
k AS (
    SELECT source, lang, 'words-1' AS tokenizer, CASE WHEN quality = 0 THEN n2 ELSE n1 END AS n FROM m WHERE toxic = 0
    UNION ALL SELECT source, lang, 'words-2', n2 FROM m WHERE toxic = 0)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM k GROUP BY ALL""",
}
