import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from quern.llm import compression_quality, decision_list, mixing, simhash

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in C.STAGES] == ["quality classifier", "quality rules", "near-dedup", "mixing", "packing"]
    before = docs
    for k, (name, stage) in enumerate(C.STAGES[:-1]):
        after = stage(spark, before, DATA).cache()
        assert after.columns == docs.columns, name
        rows, was = after.collect(), {r.doc_id for r in before.collect()}
        assert all(r.text == texts[r.doc_id] for r in rows)
        if k < 3:
            assert Counter(r.doc_id for r in rows).most_common(1)[0][1] == 1 and {r.doc_id for r in rows} < was
        else:
            assert {r.doc_id for r in rows} == was
        before = after
    packed = C.STAGES[-1][1](spark, before, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.collect()}


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def first_of_each(texts):
    """{id: text} -> the ids that stay: the least of each group that links of 0.8 make."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if root[i] == i}


def test_run_against_brute_force(spark):
    """The whole pipeline on a whole table: every stage by plain code over what the one before it kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    model, rules = compression_quality.fit_on(docs, labels), decision_list.fit_on(docs, labels)
    good = {i: t for i, t in texts.items() if model.score((t or "").encode()) >= 0.5}
    clean = {}
    for i, t in good.items():
        stats = dict(zip(decision_list.STATS, decision_list.statistics((t or "").encode()), strict=True))
        value = {n: stats[part] / max(stats[whole], 1) for n, (part, whole) in decision_list.FEATURES.items()}
        hit = any(all(value[c.feature] > c.threshold if c.above else value[c.feature] <= c.threshold for c in rule) for rule in rules.rules)
        if stats["n_words"] >= 50 and 100 * stats["n_repeat_words"] <= 50 * stats["n_words"] and not hit:
            clean[i] = t
    kept = {i: clean[i] for i in first_of_each(clean)}
    assert len(texts) > len(good) > len(clean) > len(kept) > 0
    tokens = Counter()
    for i, t in kept.items():
        tokens[source[i]] += len((t or "").encode().split())
    plan = {r.s: r for r in mixing.planned(spark.createDataFrame(list(tokens.items()), "s string, n long")).collect()}
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for i, t in kept.items():
        got = [*ids.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(got) % 2048 or 2048
        starts = [0, *range(first, len(got), 2048)] if len(got) > 2048 else [0]
        pieces[i] = {(k, s, e - s, zlib.crc32(np.array(got[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(got)], strict=True))}
    rows = C.run(spark, DATA).collect()
    times = Counter((r.doc_id, r.piece) for r in rows)
    assert {i for i, _ in times} == set(kept)
    assert all((r.piece, r.start, r.length, r.ids_crc32) in pieces[r.doc_id] for r in rows)
    for i in kept:
        counts = {times[i, k] for k, *_ in pieces[i]}
        assert len(counts) == 1 and counts.pop() - plan[source[i]].epochs in (0, 1)
    used = Counter()
    for (i, k), n in times.items():
        used[source[i]] += n * len((kept[i] or "").encode().split()) if k == 0 else 0
    longest = max(len((t or "").encode().split()) for t in kept.values())
    assert all(plan[s].budget - longest <= used[s] <= plan[s].budget for s in plan)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


LONG = " ".join(f"w{k % 4999}x{k}" for k in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n"), (4, "one two three"), (5, LONG), (5, LONG), (6, LONG + " and more"), (7, "a b c d e f " * 40), (None, LONG), (8, " ".join(f"é{k}ß" for k in range(80)))]


@pytest.mark.parametrize("stage", [s for _, s in C.STAGES], ids=[n for n, _ in C.STAGES])
def test_stages_on_awkward_tables(spark, stage):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table, columns with names that stages
    use themselves."""
    extra = "mix_tokens long, mark string, compression_score double, text_stats string, node long, piece string, score double, band long"
    docs = spark.createDataFrame([(i, t, None, s, None, 1, "m", 0.5, "s", None, "p", 0.1, 3) for k, (i, t) in enumerate(ODD) for s in [None if k % 3 else "src"]], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    out = stage(spark, docs, DATA)
    rows = out.collect()
    if stage is C.pack:
        assert {r.doc_id for r in rows} == {i for i, _ in ODD} and sum(r.piece == 0 for r in rows) == len(ODD)
    else:
        assert out.columns == docs.columns and {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    if stage is C.near_dedup:  # null, empty and blank texts are one group; the long one and its extension another
        assert sorted((r.doc_id is None, r.doc_id) for r in rows) == [(False, 1), (False, 4), (False, 5), (False, 7), (False, 8), (True, None)]
    if stage is C.quality_rules:  # few words, or one phrase over and over
        assert {r.doc_id for r in rows} <= {5, 6, 8, None}
    if stage is C.mix_sources:
        assert {r.doc_id for r in rows} == {i for i, _ in ODD}
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_a_crowd_of_half_similar_texts_makes_few_pairs(spark, monkeypatch):
    """Copies of one text with a few to most words changed: the pairs across components stay few, and no link is lost."""
    import random

    rng = random.Random(5)
    base = [f"w{rng.getrandbits(40)}" for _ in range(150)]
    texts = {0: " ".join(base)}
    for k in range(1, 300):
        copy = list(base)
        for p in rng.sample(range(150), rng.choice((1, 2, 3, 4, 5, 6, 8, 10, 14, 20, 40))):
            copy[p] = f"new{rng.getrandbits(40)}"
        texts[k] = " ".join(copy)
    made, real = [], simhash._confirmed

    def counted(pairs, *rest):
        made.append(pairs.filter("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct().count())
        return real(pairs, *rest)

    monkeypatch.setattr(simhash, "_confirmed", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == first_of_each(texts)
    print("pairs by round", made)
    assert made[0] < 24 * 300 and sum(made[1:]) < 0.03 * 300 * 299 / 2  # of all pairs


@pytest.mark.parametrize("similar", [True, False])
def test_near_copies_meet_and_others_do_not(spark, similar):
    import random

    rng = random.Random(3)
    rows = []
    for g in range(12):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
        rows.append((2 * g, " ".join(words)))
        for _ in range(3 if similar else 150):
            words[rng.randrange(300)] = "new"
        rows.append((2 * g + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == ({2 * g for g in range(12)} if similar else set(range(24)))


def test_near_dedup_links_fingerprints_by_anchors_and_checks_them(spark, monkeypatch):
    """The first links of the stage connect what 3 bits of fingerprints do; those whose sets differ too much go."""
    import random
    import xxhash

    rng = random.Random(8)
    rows, unlike = [], []
    for _ in range(30):
        words = [f"w{rng.getrandbits(40)}" for _ in range(400)]
        rows += [" ".join(words), " ".join([*words, "tail"]), " ".join(["head", *words])]
        loop = " ".join([f"p{rng.getrandbits(40)}" for _ in range(5)] * 60)
        unlike += [len(rows), len(rows) + 1]  # one fingerprint or nearly, and few common shingles
        rows += [f"{loop} " + " ".join(f"u{rng.getrandbits(40)}" for _ in range(12)) for _ in range(2)]

    def fingerprint(text):
        w = text.encode().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(len(w) - 4)]
        return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t) for t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root = [root[j] if r == root[i] else r for r in root]
    asked, real = [], simhash._confirmed

    def recorded(pairs, *rest):
        asked.append([tuple(r) for r in pairs.collect()])
        return real(pairs, *rest)

    monkeypatch.setattr(simhash, "_confirmed", recorded)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id for r in C.near_dedup(spark, docs, DATA).collect()}
    assert kept == first_of_each(dict(enumerate(rows))) and set(unlike) <= kept
    nodes = [xxhash.xxh64_intdigest(np.unique(simhash.shingle_hashes(t.encode(), 5)).tobytes(), 7) for t in rows]
    signed = {n - (n >> 63 << 64): n for n in nodes}
    of = {n: n for n in nodes}
    for a, b in asked[0]:
        of = {n: of[signed[a]] if r == of[signed[b]] else r for n, r in of.items()}
    groups = lambda names: sorted(sorted(k for k, x in enumerate(names) if x == r) for r in set(names))
    assert groups([of[n] for n in nodes]) == groups(root) and len(set(root)) < len(rows) - 30


def test_pairs_that_become_rows_grow_with_a_crowd_and_not_its_square(spark, monkeypatch):
    """Half-similar texts in many components: each is held against a few others outside the buckets' tasks."""
    import random

    rng = random.Random(6)
    base = [f"w{rng.getrandbits(40)}" for _ in range(150)]
    texts = {}
    for k in range(400):
        copy = list(base)
        for p in rng.sample(range(150), rng.choice((3, 4, 5, 6))):
            copy[p] = f"other{p}-{rng.randrange(3)}"  # what is put in is shared, so no text rules itself out
        texts[k] = " ".join(copy)
    made, real = [], simhash._confirmed

    def counted(pairs, *rest):
        made.append(pairs.filter("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct().count())
        return real(pairs, *rest)

    monkeypatch.setattr(simhash, "_confirmed", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == first_of_each(texts)
    print("pairs as rows", made)
    assert sum(made) < 3 * 400


def test_scratch_tables_are_read_and_written_in_small_pieces(spark, tmp_path):
    """A task holds a row group whole: at 128 MB each, near-dedup ran out of a heap of 1 GB over 0.6 GB of documents."""
    import pyarrow.parquet as pq

    from quern.llm.common import materialise, tuned

    text = "concat_ws('', transform(sequence(1, 60), k -> sha2(concat(id, k), 256)))"
    out = materialise(tuned(spark).range(0, 12_000, 1, 1).selectExpr("id", f"{text} as text"), "wide")
    groups = [m.row_group(k).total_byte_size for f in out.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for k in range(m.num_row_groups)]
    assert sum(groups) > 40 << 20 and max(groups) < 16 << 20
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1000
