"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A template is a set of words; a block is a window of BLOCK consecutive words of a text. A block meets a template when it
holds at least `containment` of the template's distinct words. Only blocks that start at a template word are looked at:
any other window holds no more template words than the one that starts at its first template word.

Template words are ordered by how often the texts hold them, rarest first; a block is the sorted set of its template
words. A block that meets a template t must hold need(t) = ceil(containment * |t|) of its words, so
- prefix filter: it holds one of the first |t| - need(t) + 1 words of t in that order; an index of these words, joined
  with the words of the blocks, gives the candidates;
- length filter: it has need(t) words at all;
- positional filter: if the match stands at place i of t and at place j of the block, at most 1 + min(|t| - i - 1,
  |block| - j - 1) words can be common, counted from the first match on (an earlier match is a candidate of its own).
Candidates that pass are verified by counting the common words. No block that meets a template is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import materialise

#: The words of a text, and the phrases whose places are counted.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Words of a block, and the share of a template's words that it must hold.
BLOCK = 48
CONTAINMENT = 0.9
#: Rows of template words up to which these tables are broadcast; beyond, Spark chooses the join.
BROADCAST_ROWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHERS = "".join(map(chr, (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))


@dataclass(frozen=True)
class Template:
    label: str
    text: str


#: Notices by which licenses are commonly named; each is a set of words.
TEMPLATES = (
    Template("agpl", "licensed under the GNU Affero General Public License"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-4.0", "Creative Commons Attribution 4.0 International License"),
    Template("copyright", "Copyright notice and this permission notice shall be included in all copies"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "licensed under the GNU Lesser General Public License"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("public-domain", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """The lower-cased words (WORD) of a text, none of a null one: what is no word becomes a blank, A-Z lower case."""
    plain = F.translate(F.coalesce(text, F.lit("")), _OTHERS + _UPPER, " " * len(_OTHERS) + _LOWER)
    return F.array_remove(F.split(plain, " "), "")


def phrase_places(words: Column, phrase: str) -> Column:
    """The places (words from 0) where a phrase's words stand one after the other. Only texts that hold its first
    word are walked through."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        hit = F.lit(True)
        for k, p in enumerate(parts):
            hit = hit & (F.get(words, i + k) == p)
        return hit

    none = F.array().cast("array<int>")
    rare = max(parts, key=len)
    return F.when((last >= 0) & F.array_contains(words, rare), F.filter(F.sequence(F.lit(0), last), here)).otherwise(none)


@dataclass(frozen=True)
class Index:
    """The templates as tables, words by their rank: `sets` (template, label, n, need, ranks), `prefixes` (rank,
    template, place, n, need) and `ranks` (word, rank)."""

    sets: DataFrame
    prefixes: DataFrame
    ranks: DataFrame


def template_words(spark: SparkSession, templates: Sequence[Template]) -> dict[int, list[str]]:
    """The distinct words of each template. Templates come from the driver, so their words fit there."""
    rows = spark.createDataFrame([(k, t.text) for k, t in enumerate(templates)], "template int, text string")
    return {r.template: r.words for r in rows.select("template", F.array_distinct(words_of(F.col("text"))).alias("words")).collect() if r.words}


def index(spark: SparkSession, templates: Sequence[Template], words: Mapping[int, list[str]], times: Mapping[str, int], containment: float) -> Index:
    """Rank the templates' words by how often texts hold them, rarest first, and index the templates' prefixes."""
    vocabulary = {w for ws in words.values() for w in ws}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (times.get(w, 0), w)))}
    sets, prefixes = [], []
    for t, ws in words.items():
        ranks = sorted(rank[w] for w in ws)
        need = max(1, math.ceil(containment * len(ws) - 1e-9))
        sets.append((t, templates[t].label, len(ws), need, ranks))
        prefixes += [(r, t, i, len(ws), need) for i, r in enumerate(ranks[: len(ws) - need + 1])]
    tables = (
        spark.createDataFrame(sets, "template int, label string, n int, need int, ranks array<int>"),
        spark.createDataFrame(prefixes, "rank int, template int, place int, n int, need int"),
        spark.createDataFrame(list(rank.items()), "word string, rank int"),
    )
    small = sum(map(len, words.values())) <= BROADCAST_ROWS
    return Index(*(F.broadcast(t) if small else t for t in tables))


def blocks(hits: DataFrame, ix: Index) -> DataFrame:
    """(row, start, size, tokens): a block at each template word of the rows that hold a word of some prefix. `size` is
    its words, `tokens` the ranks of its template words in order. hits: (row, n_words, word, at), template words only."""
    ranked = hits.join(ix.ranks, "word").select("row", "n_words", "at", "rank")
    seeded = ranked.join(ix.prefixes.select("rank").distinct(), "rank", "left_semi").select("row").distinct()
    inside = Window.partitionBy("row").orderBy("at").rangeBetween(0, BLOCK - 1)
    held = ranked.join(seeded, "row", "left_semi").withColumn("tokens", F.array_sort(F.collect_set("rank").over(inside)))
    return held.select("row", F.col("at").alias("start"), F.least(F.lit(BLOCK), F.col("n_words") - F.col("at")).cast("int").alias("size"), "tokens")


def prefix_filtered(found: DataFrame, ix: Index) -> DataFrame:
    """The candidates: blocks with a word of a template's prefix, and where it stands in both (place, at)."""
    each = found.select("row", "start", "size", "tokens", F.posexplode("tokens").alias("at", "rank"))
    return each.join(ix.prefixes, "rank")


def length_filtered(candidates: DataFrame) -> DataFrame:
    return candidates.filter("least(size, size(tokens)) >= need")


def position_filtered(candidates: DataFrame) -> DataFrame:
    return candidates.filter("1 + least(n - place - 1, size(tokens) - at - 1) >= need")


def verified(candidates: DataFrame, ix: Index) -> DataFrame:
    """(row, start, label, share) of the blocks that hold enough of a template's words."""
    sets = ix.sets.select(F.col("template").alias("t"), "label", "ranks")
    counted = candidates.join(sets, F.col("template") == F.col("t")).withColumn("overlap", F.size(F.array_intersect("tokens", "ranks")))
    return counted.filter("overlap >= need").select("row", "start", "label", (F.col("overlap") / F.col("n")).alias("share"))


def read(docs: DataFrame, vocabulary: Iterable[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The one pass over the texts: a row per document with a number of its own (row), its counts of words and base
    phrases, and `hits`, the places of the vocabulary's words."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    places = {k: phrase_places(F.col("words"), p) for k, p in PHRASES.items()}
    every = F.concat(*places.values())
    known = sorted(vocabulary)
    hits = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(known), F.struct(w.alias("word"), i.alias("at")))))
    return materialise(base.select(
        "row", "id", F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(F.size(p) > 0, F.lit(k)) for k, p in places.items()))).alias("base"), hits.alias("hits"),
    ), "licenses")


def scan(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: (id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks).

    n_base, first_word and last_word count the places of PHRASES; base_labels names those found, labels also those of
    templates that some block meets, and score is the largest share of a template's words in such a block (1 if a base
    phrase is there, else 0). `blocks` lists (label, first word, share) of the best block of each label met, the first
    of several. Null and empty texts have no words, no labels and score 0; rows that repeat an id are each returned.
    Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    words = template_words(spark, templates)
    found = read(docs, {w for ws in words.values() for w in ws}, id_col, text_col)
    hits = found.select("row", "n_words", F.inline("hits"))
    ix = index(spark, templates, words, {r.word: r["count"] for r in hits.groupBy("word").count().collect()}, containment)
    met = verified(position_filtered(length_filtered(prefix_filtered(blocks(hits, ix), ix))), ix)
    best = met.groupBy("row", "label").agg(F.max(F.struct("share", (-F.col("start")).alias("back"))).alias("b"))
    listed = best.groupBy(F.col("row").alias("met_row")).agg(
        F.sort_array(F.collect_list(F.struct("label", (-F.col("b.back")).cast("long").alias("first_word"), F.col("b.share").alias("share")))).alias("blocks")
    )
    out = found.drop("hits").join(listed, F.col("row") == F.col("met_row"), "left")
    blocks_or_none = F.coalesce("blocks", F.array().cast("array<struct<label:string,first_word:bigint,share:double>>"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform(blocks_or_none, lambda b: b["label"]))))
    share = F.coalesce(F.array_max(F.transform(blocks_or_none, lambda b: b["share"])), F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(share).alias("score"), blocks_or_none.alias("blocks"),
    )
