import math
import re
from collections import Counter

from quern.llm import license_scan as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text):
    ws = words(text)
    places = {k: [i for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()] for k, p in L.PHRASES.items()}
    every = [i for p in places.values() for i in p]
    base = {k for k, p in places.items() if p}
    labels, share = set(base), 0.0
    for t in L.TEMPLATES:
        need = set(words(t.text))
        for s in (k for k, w in enumerate(ws) if w in need):
            held = len(need & set(ws[s : s + L.BLOCK]))
            if held >= math.ceil(L.CONTAINMENT * len(need) - 1e-9):
                labels.add(t.label)
                share = max(share, held / len(need))
    return (len(ws), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else share)


def rows_of(spark, docs):
    return Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in L.scan(docs).collect())


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = Counter((r.doc_id, *plain(r.text)) for r in docs.collect())
    assert rows_of(spark, docs) == want
    assert any(k[6] for k in want)


def test_planted_and_awkward_texts(spark):
    filler = "lorem ipsum dolor sit amet " * 30
    texts = [None, "", " ", "cc by", "CC BY cc by", "by cc", "All Rights Reserved. all rights reserved", "Éé cc, by\x00x", filler]
    texts += [filler[: 7 * k] + " " + t.text + " " + filler for k, t in enumerate(L.TEMPLATES)]
    texts += [" ".join(reversed(t.text.split())) for t in L.TEMPLATES] + [t.text.upper() for t in L.TEMPLATES]
    spread = " . x ".join(L.TEMPLATES[6].text.split())
    texts += [f"{filler[: 6 * k]} {spread} {filler}" for k in range(20)]
    texts += [t.text.rsplit(" ", 2)[0] for t in L.TEMPLATES] + ["word " * 30000 + "released under the MIT license"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(0, "cc by", 1), (None, "cc by", 1)], "doc_id long, text string, n_words int")
    want = Counter((i, *plain(t)) for i, t in [*enumerate(texts), (0, "cc by"), (None, "cc by")])
    assert rows_of(spark, docs) == want
    assert rows_of(spark, docs.limit(0)) == Counter()


def test_each_filter_leaves_fewer_candidates(spark):
    """On a whole table: pairs of blocks and templates that share a word, then those that each filter leaves."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ws = L.template_words(spark, L.TEMPLATES)
    hits = L.read(docs, {w for x in ws.values() for w in x}).selectExpr("row", "n_words", "inline(hits)")
    ix = L.index(spark, L.TEMPLATES, ws, {r.word: r["count"] for r in hits.groupBy("word").count().collect()}, L.CONTAINMENT)
    found = L.blocks(hits, ix)
    pairs = lambda df: df.select("row", "start", "template").distinct().count()
    sharing = pairs(found.selectExpr("row", "start", "explode(tokens) as rank").join(ix.sets.selectExpr("template", "explode(ranks) as rank"), "rank"))
    prefix = L.prefix_filtered(found, ix)
    length = L.length_filtered(prefix)
    position = L.position_filtered(length)
    steps = [sharing, pairs(prefix), pairs(length), pairs(position), L.verified(position, ix).select("row", "start", "label").distinct().count()]
    print("candidates", steps)
    assert steps == sorted(steps, reverse=True) and steps[0] > 4 * steps[1] > 4 * steps[3] and steps[4] > 0
    assert L.verified(prefix, ix).distinct().count() == L.verified(position, ix).distinct().count()  # none is lost


def test_no_python_on_the_path(spark, sf_dir):
    plan = L.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
