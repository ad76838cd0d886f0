import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import lm_bloom as M

WORD = re.compile("[^\x20\x09-\x0d]+")
END = object()
AWKWARD = [(i, t) for i, t in enumerate([None, "", " ", "a", "A b", "a b " * 2000, "é É é", "x y z", "x y z"])] + [(3, "a"), (None, "a b")]


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def stands_for(count):
    """The count that a quantised one is taken for."""
    if count == 0:
        return 0.0
    q = 1 + math.floor(2 * math.log2(count) + 1e-9)
    return {1: 1, 2: 1.4, 3: 2, 4: 3}.get(q, 2 ** ((q - 1) / 2) * 1.19)


def model(rows):
    """Plain counts: words, pairs, texts, and p(word | the one before)."""
    learnt = [tokens(x) for i, x in rows if not held(i)]
    c = Counter(t for ts in learnt for t in ts)
    pairs = Counter(p for ts in learnt for p in zip([None, *ts], ts, strict=False))
    mass = sum(stands_for(n) for n in c.values())

    def p(before, word):
        one = stands_for(c[word])
        single = (one + 0.1) / (mass + 0.1 * (len(c) + 1))
        context = len(learnt) if before is None else stands_for(c[before])
        two = min(stands_for(pairs[before, word]), one, context)
        return 0.15 * two / context + 0.85 * single if context else single

    return c, pairs, p


def plain(rows):
    c, _, p = model(rows)
    n, v = sum(c.values()), len(c)
    for i, x in rows:
        ts = tokens(x)
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        score = sum(math.log10(p(a, b)) for a, b in zip([None, *ts], ts, strict=False))
        yield i, held(i), len(ts), sum(c[t] > 0 for t in ts), n, base, score


def scores(docs, **options):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return sorted((tuple(r[k] for k in names) for r in M.scored(docs, **options).collect()), key=str)


def compare(got, rows, rel=1e-9):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(plain(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9, abs=1e-9)
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=rel, abs=1e-9)


@pytest.mark.parametrize("broadcast", [0, 1 << 30])
def test_whole_table_against_brute_force(spark, sf_dir, broadcast):
    """With more probes there are no false answers, so that scores are the plain ones; both ways are tried."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    compare(scores(docs, broadcast_bytes=broadcast, probes=24, load=0.5, part_bytes=1 << 16), rows)


def test_production_parameters(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = scores(docs)
    compare(got, rows, rel=0.02)  # false answers move a score a little
    assert got == scores(docs, broadcast_bytes=0)
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])  # pairs help on held-out texts


@pytest.mark.parametrize("broadcast", [0, 1 << 30])
def test_awkward_rows(spark, broadcast, monkeypatch):
    monkeypatch.setattr(M, "LOT_TOKENS", 1000)
    docs = spark.createDataFrame([(i, t, 1) for i, t in AWKWARD], "doc_id long, text string, score int")
    compare(scores(docs, broadcast_bytes=broadcast, probes=24, load=0.5), AWKWARD)
    assert M.scored(docs.limit(0), broadcast_bytes=broadcast).count() == 0
    named = M.scored(docs.selectExpr("concat('n', doc_id) as doc_id", "text"), broadcast_bytes=broadcast)
    assert {r.doc_id for r in named.collect()} == {None, *(f"n{i}" for i in range(9))}


def test_every_text_held_out(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(200) if held(i)], "doc_id long, text string")
    got = scores(docs, broadcast_bytes=0)
    assert {(g[2], g[3], g[4]) for g in got} == {(3, 0, 0)}
    assert [g[5] for g in got] == pytest.approx([0.0] * len(got), abs=1e-9)


def test_probabilities_sum_to_one(sf_dir):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    c, pairs, p = model([(r["doc_id"], r["text"]) for r in table])
    for before in [t for t, _ in c.most_common(20)] + [None]:
        after = {b for a, b in pairs if a == before}
        assert sum(p(before, w) for w in c) + p(before, object()) == pytest.approx(1, abs=0.03), (before, len(after))


def test_filter_gives_levels_back():
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    count = np.minimum(rng.zipf(1.5, len(hashes)), 10**6)
    parts = M._parts(hashes, 2)
    made = {p: M.segment(*((M._key(hashes[parts == p], 2, kind), count[parts == p]) for kind in (M.WORDS, M.PAIRS))) for p in range(4)}
    f = M.LogFrequencyFilter.of(2, made)
    for kind in (M.WORDS, M.PAIRS):
        got = f.levels_of(hashes, kind)
        assert (got >= M.level(count)).all() and (got == M.level(count)).mean() > 0.95
        assert (f.levels_of(rng.integers(0, 1 << 64, 20000, dtype=np.uint64), kind) > 0).mean() < 0.03
    bits = sum(int(M.level(count).sum()) for _ in range(2)) * M.PROBES / M.LOAD
    assert sum(map(len, made.values())) * 8 <= bits + 8 * 4
