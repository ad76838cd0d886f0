import itertools
import random

import numpy as np
import pytest
import xxhash

from quern.llm import simhash
from quern.llm.common import connected_components

AWKWARD = ["", None, " \t\n", "one", "one two", "a b c", "A B C", "a b c", "x " * 5000, "é ü ñ " * 50]


def plain_print(text, width=3):
    words = (text or "").encode().lower().split()
    runs = [words[i : i + width] for i in range(len(words) - width + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_classes(prints, threshold=3):
    """prints: {id: fingerprint} -> {id: smallest id reachable}."""
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= threshold:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in prints}


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(docs).collect()}
    prints = {r.doc_id: plain_print(r.text) for r in docs.collect()}
    want = plain_classes(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_awkward_rows_and_clashing_names(spark):
    rows = [(i, t, i) for i, t in enumerate(AWKWARD)] + [(3, "one", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.classes(docs).collect())
    prints = {i: plain_print(t) for i, t in enumerate(AWKWARD)}
    want = plain_classes(prints)
    assert got == sorted([(i, f"{prints[i]:016x}", want[i]) for i in prints] + [(3, f"{prints[3]:016x}", want[3])])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_classes({i: plain_print(t, 5) for i, t in enumerate(AWKWARD)}).values()))


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "other words here now")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.classes(docs).collect()} == {(None, 5), (5, 5), (None, None)}
    assert simhash.keep_one(docs).count() == 3
    assert simhash.classes(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_links_on_planted_neighbours(spark, seed):
    rng = random.Random(seed)
    prints = [0, (1 << 64) - 1]
    for _ in range(40):
        base = rng.getrandbits(64)
        prints.append(base)
        for _ in range(rng.randrange(8)):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
            prints.append(base)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    found = connected_components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()
    got = {}
    for r in found:
        got.setdefault(r.root, set()).add(r.node % (1 << 64))
    want = {}
    for p, root in plain_classes({p: p for p in prints}).items():
        want.setdefault(root, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(70, 70), (80, 81), (81, 80)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {80: 80, 81: 80}


def plain_jaccard(one, two, width=5):
    a, b = ({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (one.split(), two.split()))
    return len(a & b) / len(a | b)


def changed(rng, words, runs):
    """A copy with `runs` words replaced, far enough apart to change five shingles each."""
    out = list(words)
    for p in rng.sample(range(1, len(words) // 6 - 1), runs):
        out[p * 6] = f"new{rng.getrandbits(40)}"
    return out


def test_isolated_pairs_from_080_to_090_all_link(spark):
    rng = random.Random(11)
    rows = []
    for g in range(400):
        words = [f"w{rng.getrandbits(40)}" for _ in range(320)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(changed(rng, words, rng.randrange(3, 8))))]
    likeness = [plain_jaccard(rows[2 * g][1], rows[2 * g + 1][1]) for g in range(400)]
    assert sum(0.8 <= x < 0.85 for x in likeness) > 50 and sum(0.85 <= x < 0.9 for x in likeness) > 50
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [2 * g + 1 in kept for g in range(400)] == [x < 0.8 for x in likeness]


def family(rng, *runs):
    """A text and one copy with each number of replaced words, at places of their own."""
    words = [f"w{rng.getrandbits(40)}" for _ in range(320)]
    places = rng.sample(range(1, 52), sum(runs))
    out = [" ".join(words)]
    for n in runs:
        copy = list(words)
        for p in places[:n]:
            copy[p * 6] = f"new{rng.getrandbits(40)}"
        del places[:n]
        out.append(" ".join(copy))
    return out


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.keep_one(docs).collect())


def test_link_beside_a_half_similar_text_is_not_lost(spark):
    rng = random.Random(12)
    texts = [t for _ in range(60) for t in family(rng, 6, 9, 10)]
    like = [plain_jaccard(texts[4 * g], texts[4 * g + k]) for g in range(60) for k in (1, 2, 3)]
    assert all((x >= 0.8) == (k % 3 == 0) for k, x in enumerate(like)) and min(like) > 0.7
    assert kept_of(spark, texts) == [i for i in range(240) if i % 4 != 1]


def test_texts_below_the_threshold_stay(spark):
    rng = random.Random(13)
    texts = [t for _ in range(150) for t in family(rng, rng.randrange(8, 11))]
    assert all(0.7 < plain_jaccard(texts[2 * g], texts[2 * g + 1]) < 0.8 for g in range(150))
    texts += family(rng, *[5] * 10)[1:]  # a template's texts, 0.71 of each other
    assert kept_of(spark, texts) == list(range(310))


def test_one_of_each_group_stays_where_ids_repeat(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g"
    rows = [(2, a), (5, a), (5, b), (7, b), (2, c), (2, c), (None, c)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(2, a), (5, b), (2, c), (None, c)], key=str)
