"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise
from quern.llm.tokens import token_ids, worker_encoding

SEQUENCE_TOKENS = 2048
END_ID = 0
#: About so many pieces are packed together: the bound of one packing task, whatever the table's size. A task leaves
#: one or two sequences underfull at most in practice, so the loss is about one sequence in several thousand.
GROUP_PIECES = 8192
#: Exchanges that the local search compares at once.
SEARCH_CELLS = 1 << 20


def cut(n_tokens: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, but for the first, which may be shorter."""
    first = n_tokens % most or most
    return [(0, min(first, n_tokens)), *((s, most) for s in range(first, n_tokens, most))]


def pieces(docs: DataFrame, vocabulary: str, most: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's ids and its closing END_ID.

    `vocabulary` is the path, on the driver, of a byte-level BPE file; its bytes (a few MB) go to the workers. A null
    or empty text is the closing id alone. Repeated rows give repeated pieces.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    key = hashlib.sha256(raw).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    end = END_ID.to_bytes(4, "little")

    @F.arrow_udf("array<struct<start:bigint,length:bigint,ids_crc32:bigint>>")
    def token_pieces(texts: pa.Array) -> pa.Array:
        encoding = worker_encoding(key, shared.value)
        offsets, rows = [0], []
        for t in texts.to_pylist():
            ids = memoryview(token_ids(encoding, t or "").tobytes() + end)
            rows += [(s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for s, n in cut(len(ids) // 4, most)]
            offsets.append(len(rows))
        table = np.array(rows, np.int64).reshape(-1, 3)
        inner = pa.StructArray.from_arrays([pa.array(table[:, k].copy()) for k in range(3)], ["start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)

    got = docs.select(F.col(id_col).alias("id"), token_pieces(F.coalesce(F.col(text_col), F.lit(""))).alias("p"))
    return got.select("id", F.posexplode("p").alias("piece", "p")).select("id", "piece", "p.*")


def best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Best-fit decreasing: each item, longest first, goes to the open bin that it fills most."""
    by_room: list[list[int]] = [[] for _ in range(most + 1)]
    open_rooms = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if n and fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = most, len(bins)
            bins.append([i])
        if left := room - n:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, most: int, steps: int | None = None, items: int | None = None) -> list[list[int]]:
    """Local search between underfull bins: the emptiest bin gives fuller ones tokens by a move, else by a one-for-one
    exchange, else by a two-for-one exchange; of each kind the step is taken that raises the sum of squared fills most,
    of all that there are. A bin that empties goes. A bin that can't gain waits until the others have been tried; all
    are tried again after any step. The sum only grows, so the search ends: at the lower bound, or when no underfull bin
    can gain. Callers may bound it to `steps` steps, and to the `items` longest items of the bin that gives."""
    size = np.asarray(lengths, np.int64)
    home = np.empty(len(size), np.int64)
    for k, b in enumerate(bins):
        home[b] = k
    fill = np.bincount(home, size, len(bins)).astype(np.int64)
    alive, stuck = np.ones(len(bins), bool), np.zeros(len(bins), bool)
    least, count, left = -(-int(fill.sum()) // most), len(bins), -1 if steps is None else steps
    gained = False
    while count > least and left:
        able = alive & ~stuck & (fill < most)
        if not able.any():
            if not gained:
                break
            stuck[:], gained = False, False
            continue
        left -= 1
        a = int(np.flatnonzero(able)[fill[able].argmin()])
        room = np.where(alive & (fill >= fill[a]), most - fill, 0)
        room[a] = 0
        mine = np.flatnonzero(home == a)
        if items is not None and len(mine) > items:
            mine = mine[np.argsort(-size[mine], kind="stable")[:items]]
        out, back, to = _move(size[mine], fill, room, a, most)
        if out is not None:
            out = [int(mine[out])]
        else:
            theirs = np.flatnonzero(room[home] > 0)
            mine = mine[np.argsort(size[mine], kind="stable")]
            same = np.r_[False, size[mine][1:] == size[mine][:-1]]
            pair = mine[~(same & np.r_[False, same[:-1]])]  # two of each size make all sums
            one, two = np.triu_indices(len(pair), 1)
            for gives in (mine[~same][:, None], np.stack([pair[one], pair[two]], axis=1)):
                sums, first = np.unique(size[gives].sum(axis=1), return_index=True)
                give, take = _exchange(sums, size[theirs], room[home[theirs]], fill[home[theirs]] - fill[a])
                if give >= 0:
                    out, back = gives[first[give]].tolist(), int(theirs[take])
                    to = int(home[back])
                    break
        if out is None:
            stuck[a] = True
            continue
        gain = int(size[out].sum() - (size[back] if back >= 0 else 0))
        home[out] = to
        if back >= 0:
            home[back] = a
        fill[a] -= gain
        fill[to] += gain
        gained = True
        if not (home == a).any():
            alive[a] = False
            count -= 1
    order = np.argsort(home, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []


def _move(sizes: np.ndarray, fill: np.ndarray, room: np.ndarray, a: int, most: int) -> tuple[int | None, int, int]:
    """The item of bin `a` to move, -1, and where to: the fullest bin that an item fits is the best one for it."""
    by_room = np.argsort(room, kind="stable")
    at = np.searchsorted(room[by_room], sizes)
    fits = (at < len(room)) & (sizes <= room.max(initial=0))
    if not fits.any():
        return None, -1, -1
    to = by_room[np.minimum(at, len(room) - 1)]
    raised = np.where(fits, sizes * (fill[to] - fill[a] + sizes), 0)
    best = int(raised.argmax())
    return (best, -1, int(to[best])) if raised[best] else (None, -1, -1)


def _exchange(sums: np.ndarray, sizes: np.ndarray, room: np.ndarray, above: np.ndarray) -> tuple[int, int]:
    """Which of `sums` to give for which of `sizes`, whose bins have `room` and are `above` the giver's fill; -1 if no
    exchange gains."""
    best, found = 0, (-1, -1)
    wide = max(1, SEARCH_CELLS // max(1, len(sizes)))
    for at in range(0, len(sums) if len(sizes) else 0, wide):
        shift = sums[at : at + wide, None] - sizes[None, :]
        raised = np.where((shift > 0) & (shift <= room), shift * (above + shift), 0)
        k = int(raised.argmax())
        if raised.flat[k] > best:
            best, found = int(raised.flat[k]), (at + k // len(sizes), k % len(sizes))
    return found


def packed(
    rows: DataFrame, most: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES,
    steps: int | None = None, items: int | None = None,
) -> DataFrame:
    """Add sequence_id and offset to (row, id, piece, start, length, ids_crc32), every row kept, `row` left out; `rows`
    is read twice.

    Pieces are dealt to groups by the hash of `row`, which tells all rows apart, about `group_pieces` to each; sequence
    ids hold the group and the bin. Pieces that repeat an id and number each get their own place."""
    groups = max(1, -(-rows.count() // group_pieces))
    kind = rows.schema["id"].dataType.simpleString()

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(batches)).sort_by([(c, "ascending") for c in ("length", "ids_crc32", "start", "row")]).drop_columns(["pack_group", "row"])
        lengths = part.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(improve(best_fit(lengths, most), lengths, most, steps, items)):
            sequence[b] = key[0].as_py() << 32 | k
            offset[b] = np.r_[0, lengths[b].cumsum()[:-1]]
        full = part.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from full.to_batches()

    dealt = rows.select("row", "id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("pack_group"))
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("pack_group").applyInArrow(pack, schema)


def pack_documents(
    docs: DataFrame, vocabulary: str, most: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text",
    steps: int | None = None, items: int | None = None,
) -> DataFrame:
    """One row per piece of every document: (id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are one piece of one token; repeated rows and null ids are each packed; ids of any type come
    back as they were; an empty table gives no pieces; columns other than the two named are not read."""
    found = materialise(pieces(docs, vocabulary, most, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return packed(found, most, steps=steps, items=items).withColumnRenamed("id", id_col)
