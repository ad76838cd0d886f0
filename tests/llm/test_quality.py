import zlib
from collections import Counter

from quern.llm import compression_quality as Q
from quern.llm import decision_list as D
from quern.llm.queries import op2_compression_quality, op9_decision_list

DATA = "/root/testdata/sf0.01"
AWKWARD = ["", None, " \n\t", "a", "a\n\na\n", "x y z x y z", "word " * 40000, "é$ü|ñ <b> #"]


def plain_statistics(text):
    text = text or ""
    blank = " \t\n\x0b\x0c\r"
    words, w = [], ""
    for ch in text + " ":
        if ch in blank:
            words += [w] if w else []
            w = ""
        else:
            w += ch
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(blank):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + list(enumerate(AWKWARD, 10**6))
    for i, t in rows:
        assert D.statistics((t or "").encode())[:5] == plain_statistics(t), i


def test_decision_list_query(spark):
    got = {r.doc_id: r for r in op9_decision_list(spark, DATA).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        want = plain_statistics(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.rule == 0)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = [(got[i].kept, q) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 3 == 1 and not got[i].base_failed]
    assert sum(k == (q == 1) for k, q in held) / len(held) > 0.95


def test_compression_query(spark):
    got = {r.doc_id: r for r in op2_compression_quality(spark, DATA).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i].predicted, got[i].difference_score, q) for i, q in labels.items() if got[i].held_out]
    assert sum(p == q for p, _, q in held) / len(held) > 0.93
    assert sum((d >= 0.5) == (q == 1) for _, d, q in held) / len(held) > 0.9  # the difference alone


def test_scores_against_sizes_by_hand(spark):
    """Differences and scores of a table from compressed sizes worked out apart."""
    import math

    import zstandard

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit_on(docs, labels)
    known = [zstandard.ZstdCompressionDict(d) for d in model.dictionaries]
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    logistic = lambda w, *x: 1 / (1 + math.exp(-max(-40, min(40, w[0] + sum(a * b for a, b in zip(w[1:], x, strict=True))))))
    for r in Q.scored(docs, model).collect():
        data = texts[r.doc_id]
        sizes = []
        for d in known:
            c = zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(data[k : k + 512])) for k in range(0, max(1, len(data)), 512)))
        difference, rate = (sizes[0] - sizes[1]) / sum(sizes), sum(sizes) / (2 * len(data) + 16)
        assert math.isclose(r.difference, difference, abs_tol=0.02)
        assert math.isclose(r.score, logistic(model.weights, r.difference, rate), abs_tol=0.02)
        assert math.isclose(r.difference_score, logistic(model.difference_weights, r.difference), rel_tol=1e-9)


def test_null_ids_are_not_held_out(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    docs.selectExpr("if(doc_id % 7 = 0, null, doc_id) as doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = op2_compression_quality(spark, str(tmp_path)).collect()
    assert len(rows) == 50 and all(r.held_out is False for r in rows if r.doc_id is None) and any(r.doc_id is None for r in rows)


def test_awkward_rows_are_scored_and_kept_whole(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(AWKWARD)] + [(0, "", "y"), (None, "b", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1)], "doc_id long, quality int")
    model, rules = Q.fit_on(docs, labels), D.fit_on(docs, labels)
    assert model.dictionaries is None and rules.rules == ()
    assert Q.scored(docs, model).count() == docs.count() == D.judged(docs, rules).count()
    assert Q.scored(docs.limit(0), model).count() == 0 == D.judged(docs.limit(0), rules).count()
    for kept in (Q.keep_good(docs, model), D.keep_good(docs, rules)):
        assert kept.columns == docs.columns
    assert D.keep_good(docs, rules).count() == 0  # short, or one word over and over


def test_learning_finds_a_planted_rule():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((900, 3))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] < 0.5)) | (x[:, 2] < 0.1)
    names = list(D.FEATURES)[:3]
    rules = D.learn(x, bad, names)
    said = np.zeros(900, bool)
    for rule in rules.rules:
        said |= np.logical_and.reduce([c.holds(x, names) for c in rule])
    assert (said == bad).mean() > 0.97


def test_scores_follow_the_dictionaries():
    good = [(2 * i, b"the quick brown fox jumps over the lazy dog and runs on " * 6 + str(i).encode(), 1) for i in range(60)]
    bad = [(2 * i + 1, b"$$$ WIN!!! ### CLICK*** HERE&&& %%% " * 8 + str(i).encode(), 0) for i in range(60)]
    mixed = [(k, t, y) for k, (_, t, y) in enumerate(x for p in zip(good[::2], good[1::2], bad[::2], bad[1::2], strict=True) for x in p)]
    model = Q.fit(mixed)
    assert model.features(b"a lazy dog jumps over the brown fox")[0] > 0 > model.features(b"CLICK*** WIN!!! ### HERE&&& $$$ %%%")[0]
    right = [(model.score(t) >= 0.5) == (y == 1) for _, t, y in mixed]
    assert all(right) and 0 <= model.score(b"") <= 1
