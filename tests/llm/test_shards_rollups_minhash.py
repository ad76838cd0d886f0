import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quern.llm import order_minhash as O
from quern.llm import sharding as S
from quern.llm import token_rollup as R
from quern.llm.queries import SQL, op8_extendible_sharding, op10_token_rollup
from quern.sources.scratch import scratch_path

DATA = "/root/testdata/sf0.001"


def bits(key):
    return f"{int(hashlib.md5(key.encode()).hexdigest()[:16], 16):064b}"


def check_shards(rows, limit):
    by = defaultdict(list)
    for r in rows:
        assert len(r.shard) == r.depth
        by[r.shard].append(r.n_bytes)
    names = sorted(by)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # no bucket within another
    assert all(sum(n) <= limit or len(n) == 1 for n in by.values())
    return by


def test_shards_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = S.sharded(docs, 20_000).collect()
    by = check_shards(rows, 20_000)
    sizes = {r.doc_id: len(r.text.encode()) for r in docs.collect()}
    assert {r.doc_id: r.n_bytes for r in rows} == sizes
    for r in rows:
        key = bits(str(r.doc_id))
        assert key.startswith(r.shard)
        parent = [n for i, n in sizes.items() if bits(str(i)).startswith(r.shard[:-1])]
        assert r.depth == 0 or sum(parent) > 20_000  # only oversized buckets split
    assert len(by) > 5


def test_a_hot_key_splits_and_awkward_rows(spark):
    docs = spark.createDataFrame([("hot", "x" * 100)] * 300 + [("k%d" % i, "y" * 50) for i in range(100)] + [(None, None), ("big", "z" * 9000), ("e", "")], "doc_id string, text string").withColumn("depth", F.lit(1))
    rows = S.sharded(docs, 1000).collect()
    assert len(rows) == 403
    by = check_shards(rows, 1000)
    assert any(n == [9000] for n in by.values())
    assert S.sharded(docs.limit(0), 1000).count() == 0
    assert {r.depth for r in S.sharded(docs, 10**9).collect()} == {0}


def test_queries_have_sql(spark):
    assert set(SQL) == {"op8_extendible_sharding", "op10_token_rollup"}
    assert op8_extendible_sharding(spark, DATA).columns == ["doc_id", "n_bytes", "depth", "shard"]
    assert op10_token_rollup(spark, DATA).columns == ["source", "lang", "tokenizer", "docs", "tokens"]


def test_ledger_is_idempotent_and_signed(spark):
    ledger = R.TokenLedger(spark, scratch_path(spark, "test-ledger"))
    assert ledger.totals().count() == 0
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (2, "c-d e", "s", None), (3, None, None, "en"), (4, "", "s", "en")], "doc_id long, text string, source string, lang string")
    counts = R.counted(docs, ("words-1", "words-2"))
    assert ledger.commit("one", R.inserts(counts)) and not ledger.commit("one", R.deletes(counts))
    total = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in ledger.totals().collect()}
    first = total()
    assert first == {("s", "en", "words-1"): (2, 2), ("s", "en", "words-2"): (2, 2), ("s", None, "words-1"): (1, 2), ("s", None, "words-2"): (1, 3), (None, "en", "words-1"): (1, 0), (None, "en", "words-2"): (1, 0)}
    more = counts.filter("doc_id = 2")
    assert ledger.commit("two", R.revisions(more, more.withColumn("tokens", F.col("tokens") + 5)))
    assert total()["s", None, "words-1"] == (1, 7)
    assert ledger.commit("three", R.deletes(counts.filter("doc_id = 3"))) and (None, "en", "words-1") not in total()
    again = R.TokenLedger(spark, ledger.path)
    assert again.committed("three") and not again.commit("two", R.inserts(counts)) and total() == {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in again.totals().collect()}
    assert ledger.commit("none", R.inserts(counts.limit(0)))


def test_two_writers_of_one_batch_count_once(spark, monkeypatch):
    """Both find the id free and write; the first claim stands, the other's rows are never read."""
    ledger = R.TokenLedger(spark, scratch_path(spark, "race"))
    docs = spark.createDataFrame([(1, "a b c", "s", "en")], "doc_id long, text string, source string, lang string")
    counts = R.counted(docs, ("words-1",))
    monkeypatch.setattr(R.TokenLedger, "committed", lambda self, batch_id: False)
    assert [R.TokenLedger(spark, ledger.path).commit("b", R.inserts(counts)) for _ in range(3)] == [True, False, False]
    assert [(r.docs, r.tokens) for r in ledger.totals().collect()] == [(1, 3)]
    # an attempt that was written and never claimed (its writer was lost) counts nothing
    R.inserts(counts).withColumn("attempt", F.lit("lost")).write.parquet(f"{ledger.path}/batches/lost")
    assert [(r.docs, r.tokens) for r in ledger.totals().collect()] == [(1, 3)]


def test_repeated_labels_withdraw_once(spark, tmp_path):
    docs = [(1, "a b", "en", "s"), (2, "c", "en", "s"), (3, "d e f", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (1, 1, 1), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.tokenizer: (r.docs, r.tokens) for r in op10_token_rollup(spark, str(tmp_path)).collect()}
    assert got == {"words-1": (2, 4), "words-2": (2, 4)}


def plain_numbered(text):
    k = min(O.K, len(text))
    seen = Counter()
    out = []
    for i in range(len(text) - k + 1):
        out.append((text[i : i + k], seen[text[i : i + k]]))
        seen[text[i : i + k]] += 1
    return out


def test_kmers_are_numbered_by_occurrence():
    rng = random.Random(1)
    for n in (1, 5, 10, 11, 40, 400):
        text = "".join(rng.choice("ab é") for _ in range(n))
        hashes = O._numbered(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64))
        want = plain_numbered(text)
        assert len(hashes) == len(want) == len(set(want)) == len(set(hashes.tolist()))


MASK = (1 << 64) - 1


def mix(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


def plain_fingerprint(text):
    """Order MinHash from its definition, in whole numbers: each k-mer, with the number of like ones before it, has a
    hash; a tuple takes the TUPLE least under its own permutation, in the order in which they stand in the text."""
    hashes = []
    for gram, before in plain_numbered(text) if text else []:
        h = 0
        for ch in gram:
            h = (h * 0x9E3779B97F4A7C15 + ord(ch)) & MASK
        hashes.append(mix((mix((h + len(gram)) & MASK) + before * 0xD1B54A32D192ED03) & MASK))
    draw = np.random.RandomState(20)
    times, masks = (draw.randint(0, 1 << 32, O.SKETCHES, dtype=np.uint64).tolist() for _ in range(2))
    out = ""
    for factor, mask in zip(times, masks, strict=True):
        order = sorted(range(len(hashes)), key=lambda i: (((hashes[i] >> 32) ^ mask) * (factor | 1) & 0xFFFFFFFF, i))
        value, chosen = 0x2545F4914F6CDD1D, sorted(order[: O.TUPLE])
        for i in [-1] * (O.TUPLE - len(chosen)) + chosen:
            value = mix((value * 0x9E3779B97F4A7C15 + (hashes[i] if i >= 0 else 0)) & MASK)
        out += f"{value >> 32:08x}" if text else "00000000"
    return out


def test_fingerprints_follow_edits():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300))
    other = " ".join("".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(300))
    like = lambda a, b: O.likeness(O.sketch(a), O.sketch(b))
    swapped = text[1000:] + text[:1000]
    assert like(text, text) == 1 and like(text, other) == 0 and like("", "") == 1 and like("", "a") == 0
    assert like(text, text[:500] + "x" + text[500:]) > 0.85 > like(text, text[:1000] + other[:1100]) > 0
    assert like(text, swapped) < like(text, text[:500] + "x" + text[500:])  # order counts


def plain_next(rows):
    """rows: (id, text) in any order -> Counter of (id, n_chars, sha of the edit)."""
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    order = sorted(((i is None, -(i or 0), signed(t or ""), t or "", i) for i, t in rows), key=lambda r: r[:3])
    out = Counter()
    for k, (*_, t, i) in enumerate(order):
        after = order[(k + 1) % len(order)][3]
        half = len(t) // 2
        out[i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    return out


def test_edits_by_the_next_document(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(7)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = O.with_next(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == plain_next(rows)
    texts = dict(rows)
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in sorted(got, key=lambda r: r.n_chars)[:25]:
        mine, follows = texts[r.doc_id][:], texts[after[r.doc_id]]
        half = len(mine) // 2
        prints = [plain_fingerprint(x) for x in (mine, mine[: len(mine) - half] + follows[:half], follows)]
        assert (r.fingerprint, r.edited_fingerprint) == tuple(prints[:2])
        cut = [[p[k : k + 8] for k in range(0, len(p), 8)] for p in prints]
        alike = [sum(a == b for a, b in zip(cut[0], other, strict=True)) / O.SKETCHES for other in cut[1:]]
        assert [r.near_edited, r.near_next] == alike


def test_ids_that_hold_many_rows_are_cut(spark):
    """A third of the rows have one id, a third none: their ranges are cut by the texts' hashes, in order."""
    rows = [(7, f"seven {k} " * 3) for k in range(120)] + [(None, f"none {k} " * 2) for k in range(120)] + [(k, f"k{k} x") for k in range(60)] + [(7, "same")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in O.with_next(docs).collect()) == plain_next(rows)
    ids = np.array([i if i is not None else 0 for i, _ in rows])
    null = np.array([i is None for i, _ in rows])
    hashes = np.array([xxhash.xxh64_intdigest(t.encode(), 42) for _, t in rows], np.uint64).view(np.int64)
    cuts = np.quantile(ids[~null], [k / 9 for k in range(1, 9)], method="lower").tolist()
    ranges = O.Ranges.of(cuts, null.mean(), 9)
    at = ranges.place(ids, null, hashes)
    assert at.min() >= 0 and at.max() < ranges.count
    order = sorted(range(len(rows)), key=lambda k: (null[k], -ids[k], hashes[k]))
    assert (np.diff(at[order]) >= 0).all()  # ranges follow the order
    spread = Counter(at[null].tolist()), Counter(at[(ids == 7) & ~null].tolist())
    assert len(spread[0]) >= 3 and max(spread[0].values()) < 80 and len(spread[1]) >= 3 and max(spread[1].values()) < 100


def test_edits_of_awkward_tables(spark):
    rows = [(5, None), (4, ""), (4, "dup"), (4, "dup"), (9, "é𝄞x y"), (2, "long " * 30000), (None, "n"), (None, "m")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, near_next double")
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in O.with_next(docs).collect()) == plain_next(rows)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in O.with_next(docs.limit(1)).collect()) == plain_next(rows[:1])
    assert O.with_next(docs.limit(0)).count() == 0
