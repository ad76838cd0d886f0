import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import packing as P

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = ["", None, " ", "a", "a  b \n\n c", "<|endoftext|> x", "a<|endoftext|><|endoftext|>b <|endoftext|", "日本語 텍스트 é", "word " * 9000, "\x00\x1c\x85 ", "'s 'll 12345 ..."]


def plain_pieces(text, most=2048):
    ids = Tokenizer.from_file(VOCABULARY)
    got = [*ids.encode(text or "", add_special_tokens=False).ids, 0]
    first = len(got) % most or most
    starts = [0, *range(first, len(got), most)] if len(got) > most else [0]
    return [(k, s, e - s, zlib.crc32(np.array(got[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(got)], strict=True))]


def check_layout(rows, most=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(by)


def test_pieces_and_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = P.pack_documents(docs, VOCABULARY).collect()
    want = [(r.doc_id, *p) for r in docs.collect() for p in plain_pieces(r.text)]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    used = check_layout(rows)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1


def test_awkward_documents(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(AWKWARD)] + [(3, "a", 1), (3, "a", 1), (None, "b", 1)], "doc_id long, text string, length int")
    rows = P.pack_documents(docs, VOCABULARY).collect()
    want = [(i, *p) for i, t in [*enumerate(AWKWARD), (3, "a"), (3, "a"), (None, "b")] for p in plain_pieces(t)]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    check_layout(rows)
    assert P.pack_documents(docs.limit(0), VOCABULARY).count() == 0


def test_groups_lose_no_piece(spark):
    rows = spark.range(500).selectExpr("id as row", "concat('d', id) as id", "0 as piece", "0L as start", "(id * 37) % 2000 + 1 as length", "id as ids_crc32")
    got = P.packed(rows, group_pieces=60).collect()
    assert sorted(r.id for r in got) == sorted(f"d{k}" for k in range(500))
    groups = len({r.sequence_id >> 32 for r in got})
    assert groups > 1 and check_layout(got) <= -(-sum(r.length for r in got) // 2048) + 3 * groups


@pytest.mark.parametrize("seed", range(4))
def test_local_search_empties_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 400, 120)
    loose = [[i] for i in range(120)]
    better = P.improve(loose, lengths, 1000, steps=5000)
    assert sorted(int(i) for b in better for i in b) == list(range(120))
    assert all(lengths[b].sum() <= 1000 for b in better)
    assert len(better) <= math.ceil(lengths.sum() / 1000) + 2
    assert len(P.improve(P.best_fit(lengths, 1000), lengths, 1000, None, None)) <= len(P.best_fit(lengths, 1000))


def test_each_step_raises_squared_fill_most():
    """One step at a time, against all moves and exchanges of the emptiest bin written out."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(5, 60, 14)
        bins = [b.tolist() for b in np.array_split(np.arange(14), 7)]
        if max(lengths[b].sum() for b in bins) > 130:
            continue
        after = P.improve(bins, lengths, 130, steps=1, items=None)
        fill = [int(lengths[b].sum()) for b in bins]
        a = min((k for k in range(7) if fill[k] < 130), key=lambda k: fill[k])
        squares = lambda shift, k: (fill[k] + shift) ** 2 + (fill[a] - shift) ** 2 - fill[k] ** 2 - fill[a] ** 2
        gains = []
        for give in (1, 1, 2):
            best = 0
            for k in range(7):
                if k == a or fill[k] < fill[a]:
                    continue
                for out in itertools.combinations(bins[a], give):
                    for back in [None] if not gains else bins[k]:
                        shift = int(lengths[list(out)].sum()) - (int(lengths[back]) if back is not None else 0)
                        if 0 < shift <= 130 - fill[k]:
                            best = max(best, squares(shift, k))
            gains.append(best)
        want = next((g for g in gains if g), 0)
        assert sum(int(lengths[b].sum()) ** 2 for b in after) - sum(f * f for f in fill) == want


def test_search_tries_every_item_of_a_bin():
    """Only the shortest of thirteen items fits anywhere."""
    lengths = np.array([60] * 12 + [40] + [960] * 30)
    after = P.improve([list(range(13)), *([k] for k in range(13, 43))], lengths, 1000)
    assert sorted(int(lengths[b].sum()) for b in after) == [720] + [960] * 29 + [1000]


def test_search_ends_only_when_no_step_gains():
    lengths = np.random.default_rng(1).integers(500, 900, 8192)
    fills = lambda bins: sorted(int(lengths[b].sum()) for b in bins)
    first = P.best_fit(lengths, 2048)
    after = P.improve(first, lengths, 2048)
    once_more = P.improve([b.tolist() for b in after], lengths, 2048, None, None)
    assert sorted(int(i) for b in after for i in b) == list(range(8192)) and fills(after)[-1] <= 2048
    assert len(after) < len(first) and fills(once_more) == fills(after)
