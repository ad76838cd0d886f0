"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has 64 bits; two fingerprints link when at most 3 bits differ. If 3 bits differ at most, one
of the two 32-bit halves differs in one bit at most. The anchors of a half are the words of a covering code with
radius 1 (the Hamming code on 31 bits, the last bit free): a half's nearest anchor, its home, is at most one bit
away, so a half that differs from it in one bit is within radius plus threshold, 1 + 1 = 2, of that same home. Every
fingerprint is therefore replicated to all anchors within 2 bits of each half (17 at most), and every home is compared
with what its anchor has gathered: no pair is lost, and pairs come from anchors, never from all rows.

`keep_one` asks for a similarity of the texts' sets of 5-word shingles, a Jaccard index of 0.8. Fingerprints of these
shingles are linked through the anchors as above, and every link is held against the exact sets. Texts that are just as
similar as asked differ in a sixth of a fingerprint's bits, too many for anchors, so the rest comes from BANDS bands of
BAND_ROWS minima of the set under hash functions: two texts at exactly 0.8 share no band in (1 - 0.8^4)^24 = 3.2e-6 of
all cases, and in fewer above. Each node of a band's bucket is held against the likeliest of its buckets' least nodes,
unless the anchors have joined them. Buckets that still hold several components are searched whole: in one task their
sets are held against each other, exactly, until no pair across components is left. Such pairs are counted where the
sets are and never become rows, so the rows of a group of half-similar texts grow with its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import connected_components, discard, fresh, materialise, utf8

#: Bits that may differ between linked fingerprints of 64 bits.
THRESHOLD = 3
#: For similarity: bands, and minima in each.
BANDS, BAND_ROWS = 24, 4
#: Two bits of each minimum are a text's sketch. Texts at 0.8 differ in 0.15 of its 96 places on average, and in more
#: than this many with a chance below 1e-7; a bucket's least node is tried up to here, the search of buckets tries all.
SKETCH_DIFFER = 36
#: Elements of posting lists that the search of a bucket adds up at once.
POSTINGS = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), np.uint64)
_FLIPS, _FACTORS = _SEEDS[0] * _GOLDEN, _SEEDS[1] * np.uint64(2) + np.uint64(1)
_EVEN = 0x5555555555555555
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_SHIFT = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, repeats included; of the whole sequence if it is shorter."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(r, 42) for r in runs), np.uint64, max(1, len(words) - width + 1))


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of `hashes`; 0 of none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 18):
        part = hashes[at : at + (1 << 18)].view(np.uint8).reshape(-1, 8)
        ones += (np.bincount((part + _SHIFT).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(sum(1 << int(j) for j in np.flatnonzero(2 * ones > n)))


def fingerprint_udf(width: int, words: int = 1):
    """A column of `words` longs; the hashes of further words are the first one's, mixed by a bijection."""
    @F.arrow_udf("array<bigint>")
    def simhash(texts: pa.Array) -> pa.Array:
        got = np.zeros((len(texts), words), np.uint64)
        for k, t in enumerate(texts.to_pylist()):
            h = shingle_hashes(t, width)
            for j in range(words):
                got[k, j] = majority(h)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * words), pa.array(got.ravel().view(np.int64)))

    return simhash(utf8("text_of_simhash"))


def _anchors(piece: Column, bits: int, digits: int, side: int) -> Column:
    """All anchors within 2 bits of a piece of `bits` bits, as structs (anchor, home): the words of the Hamming code on
    its first 2**digits - 1 bits, with any other bits."""
    n = (1 << digits) - 1
    low, free = piece.bitwiseAND(F.lit((1 << n) - 1)), piece.bitwiseAND(F.lit((1 << bits) - (1 << n)))
    bad = F.lit(0).cast("long")
    for k in range(digits):  # the positions, from 1, whose k-th binary digit is set: their parity
        mask = sum(1 << j for j in range(n) if (j + 1) >> k & 1)
        bad = bad + (F.bit_count(low.bitwiseAND(F.lit(mask))).cast("long") % 2) * (1 << k)
    tag = F.lit(side << bits).cast("long")

    def flip(x: Column, position: Column) -> Column:
        """Change the bit at a position from 1; nothing at 0."""
        return F.when(position > 0, x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int")))).otherwise(x)

    def row(word: Column, home: bool) -> Column:
        return F.struct(word.bitwiseOR(tag).alias("anchor"), F.lit(home).alias("home"))

    nearest = flip(low, bad)
    pairs = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")), lambda i: (bad != 0) & (i < i.bitwiseXOR(bad)))
    two = F.transform(pairs, lambda i: row(flip(flip(low, i), i.bitwiseXOR(bad)).bitwiseOR(free), False))
    one = F.array(row(nearest.bitwiseOR(free), True), *(row(nearest.bitwiseOR(free.bitwiseXOR(F.lit(1 << j))), False) for j in range(n, bits)))
    return F.concat(one, two)


def _linked(rows: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links within each anchor; rows (anchor, word, home, node) come sorted by anchor."""
    kept: list[tuple[np.ndarray, ...]] = []

    def emit(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        n = len(anchor)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, n])
        group = np.repeat(np.arange(len(first)), sizes)
        left = sizes - 1  # links that a group can still use
        left[np.add.reduceat(home.astype(np.int64), first) == 0] = 0 if n else left
        root, found_a, found_b = np.arange(n), [], []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        at, k = np.flatnonzero(left[group] > 0), 1
        while len(at):
            at = at[(at + k < n)]
            at = at[(group[at] == group[np.minimum(at + k, n - 1)]) & (left[group[at]] > 0)]
            near = at[(np.bitwise_count(fp[at] ^ fp[at + k]) <= threshold) & (home[at] | home[at + k]) & (root[at] != root[at + k])]
            for i in near.tolist():
                a, b = top(i), top(i + k)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    left[group[i]] -= 1
                    found_a.append(i)
                    found_b.append(i + k)
            if len(near):
                while (up := root[root]) is not None and (up != root).any():
                    root = up
            k += 1
        a, b = node[np.array(found_a, np.int64)], node[np.array(found_b, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in rows:
        part = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        kept.append((part[0], part[1].view(np.uint64), part[2].astype(bool), part[3]))
        if sum(len(x[0]) for x in kept) < 200_000 or kept[0][0][0] == part[0][-1]:
            continue
        whole = [np.concatenate(x) for x in zip(*kept, strict=True)]
        cut = int(np.searchsorted(whole[0], whole[0][-1]))
        yield emit(*(x[:cut] for x in whole))
        kept = [tuple(x[cut:] for x in whole)]
    if kept:
        yield emit(*(np.concatenate(x) for x in zip(*kept, strict=True)))


def _met(nodes: DataFrame, pieces: list[tuple[Column, Column, int, int]], threshold: int) -> DataFrame:
    """(a, b): nodes that link at some anchor. Pieces: (word, piece, bits, digits of the code)."""
    def with_word(word: Column, anchors: Column) -> Column:
        return F.transform(anchors, lambda x: F.struct(x["anchor"].alias("anchor"), word.alias("word"), x["home"].alias("home")))

    each = [with_word(word, _anchors(piece, bits, digits, side)) for side, (word, piece, bits, digits) in enumerate(pieces)]
    spread = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = spread.select("node", F.explode(F.concat(*each)).alias("n")).select("n.anchor", "n.word", "n.home", "node")
    forest = lambda rows: _linked(rows, threshold)
    return dealt.repartition("anchor").sortWithinPartitions("anchor", "word").mapInArrow(forest, "a bigint, b bigint")


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints of `prints` (fp), enough of them to connect every component."""
    nodes = prints.select(F.col("fp").alias("node")).distinct()
    word = F.col("node")
    halves = [word.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(word, 32)]
    return _met(nodes, [(word, h, 32, 5) for h in halves], THRESHOLD)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set of hashes under each of BANDS * BAND_ROWS functions; all ones of none."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[at : at + 512, None] ^ _FLIPS) * _FACTORS).min(axis=0), out=least)
    return least


def _longs(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel().view(np.int64)))


def minima_udf(width: int, text_col: str) -> Column:
    """A column of structs: node, which names the set of shingles, the text's fingerprint, the set's bands and sketch."""
    @F.arrow_udf("struct<node bigint, fp bigint, bands array<bigint>, sketch array<bigint>>")
    def signed(texts: pa.Array) -> pa.Array:
        node, fp = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
        least = np.zeros((len(texts), BANDS * BAND_ROWS), np.uint64)
        for k, t in enumerate(texts.to_pylist()):
            every = shingle_hashes(t, width)
            fp[k] = majority(every)
            h = np.unique(every)
            node[k] = xxhash.xxh64_intdigest(h.tobytes(), 7)
            least[k] = minima(h)
        bands = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(node), BANDS)) * _GOLDEN
        for r in range(BAND_ROWS):
            bands = (bands ^ least[:, r::BAND_ROWS]) * np.uint64(0xBF58476D1CE4E5B9)
            bands ^= bands >> np.uint64(29)
        places = (least >> np.uint64(20) & np.uint64(3)).reshape(len(node), 3, 32) << np.arange(0, 64, 2, dtype=np.uint64)
        sketch = np.bitwise_or.reduce(places, axis=2)
        return pa.StructArray.from_arrays([pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), _longs(bands), _longs(sketch)], ["node", "fp", "bands", "sketch"])

    return signed(utf8(text_col))


def _shingle_longs(width: int):
    @F.arrow_udf("array<bigint>")
    def shingle_longs(texts: pa.Array) -> pa.Array:
        sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts.to_pylist()]
        ends = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))

    return shingle_longs(utf8("text_of_simhash"))


def jaccard(one: np.ndarray, two: np.ndarray) -> float:
    """Of two sorted sets of longs; two empty ones are alike."""
    both = np.sort(np.concatenate([one, two]))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common) if len(both) else 1.0


def _jaccard(one: str, two: str) -> Column:
    @F.arrow_udf("double")
    def of_sets(one: pa.Array, two: pa.Array) -> pa.Array:
        sets = [np.split(x.flatten().to_numpy(), np.cumsum(pc.list_value_length(x).to_numpy())[:-1]) if len(x) else [] for x in (one, two)]
        return pa.array([jaccard(a, b) for a, b in zip(*sets, strict=True)], pa.float64())

    return of_sets(F.col(one), F.col(two))


def _sets_of(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the sorted set of each of `nodes` (node), made once from any of its texts. Here and below joins
    with wide rows are sort-merge joins at every size, so that what they move grows with the input and no faster."""
    needed = nodes.select(F.col("node").alias("needed")).distinct()
    one_each = texts.join(needed.hint("merge"), F.col("node") == F.col("needed"), "left_semi").dropDuplicates(["node"])
    return materialise(one_each.select("node", _shingle_longs(width).alias("shingles")), "shingles")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles are as similar as asked."""
    asked = materialise(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    nodes = asked.select(F.explode(F.array("a", "b")).alias("needed")).distinct()
    few = materialise(sets.join(nodes.hint("merge"), F.col("node") == F.col("needed"), "left_semi"), "shingles")
    one, two = (few.select(F.col("node").alias(f"node_{x}"), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    held = asked.join(one, F.col("a") == F.col("node_a")).join(two, F.col("b") == F.col("node_b"))
    out = materialise(held.filter(_jaccard("set_a", "set_b") >= similarity).select("a", "b"), "similar")
    discard(few)
    return out


def _near_prints(sketches: DataFrame) -> DataFrame:
    """(a, b): links between the nodes of `sketches` (node, fp) by their fingerprints: those of one fingerprint hang
    from its least node, and least nodes link where the anchors link their fingerprints."""
    leads = materialise(sketches.groupBy(F.col("fp").alias("of_fp")).agg(F.min("node").alias("lead")), "prints")
    same = sketches.join(leads, F.col("fp") == F.col("of_fp")).filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    one, two = (leads.select(F.col("of_fp").alias(f"fp_{x}"), F.col("lead").alias(f"lead_{x}")) for x in "ab")
    met = links(leads.select(F.col("of_fp").alias("fp")))
    far = met.join(one, F.col("a") == F.col("fp_a")).join(two, F.col("b") == F.col("fp_b"))
    return materialise(same.unionAll(far.select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))), "near-prints")


def _bucket_links(component: np.ndarray, node: np.ndarray, sizes: np.ndarray, flat: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links (a, b) that join the components of one bucket wherever two of its sets are as similar as asked. The sets
    are `sizes` elements each of `flat`. Overlaps are counted exactly, through lists of the sets that hold an element;
    elements of one set only are in no overlap and bound it."""
    _, of, times = np.unique(component, return_inverse=True, return_counts=True)
    # each pair across components has a member outside the largest, which comes last and is never gone through
    order = np.argsort(of == times.argmax(), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    root, node, sizes, outside = of[order], node[order], sizes[order], len(order) - int(times.max())
    _, element, held = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(rank, sizes[rank])
    shared = held[element] > 1
    row, element = row[shared], element[shared]
    common_at_most = np.bincount(row, minlength=len(node))
    by_row = np.argsort(row, kind="stable")
    elements, row_ends = element[by_row], common_at_most.cumsum()
    by_element = np.lexsort((row, element))
    holders, starts = row[by_element], np.searchsorted(element[by_element], np.arange(len(held) + 1))
    able = common_at_most >= similarity * sizes - 1e-9
    found_a, found_b = [], []
    for i in np.flatnonzero(able[:outside]).tolist():
        most = np.minimum(common_at_most[i], common_at_most[i + 1 :])
        open_ = able[i + 1 :] & (root[i + 1 :] != root[i]) & (most >= similarity * (sizes[i] + sizes[i + 1 :] - most) - 1e-6)
        if not open_.any():
            continue
        mine = elements[row_ends[i] - common_at_most[i] : row_ends[i]]
        from_, long_ = starts[mine], starts[mine + 1] - starts[mine]
        common = np.zeros(len(node), np.int64)
        for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(long_.cumsum() // POSTINGS)) + 1):
            n = long_[part]
            at = np.repeat(from_[part] - n.cumsum() + n, n) + np.arange(int(n.sum()))
            common += np.bincount(holders[at], minlength=len(node))
        both = common[i + 1 :]
        for j in (np.flatnonzero(open_ & (both / np.maximum(sizes[i] + sizes[i + 1 :] - both, 1) >= similarity)) + i + 1).tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                found_a.append(int(node[i]))
                found_b.append(int(node[j]))
    return found_a, found_b


def _across(rows: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of all buckets; rows (band, component, node, shingles) come sorted by band. One bucket is held
    at a time."""
    kept: list[tuple[np.ndarray, ...]] = []
    of_kept, found_a, found_b = None, [], []

    def close() -> None:
        if kept:
            a, b = _bucket_links(*(np.concatenate(x) for x in zip(*kept, strict=True)), similarity)
            found_a.extend(a)
            found_b.extend(b)
            kept.clear()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])
        found_a.clear()
        found_b.clear()
        return batch

    for batch in rows:
        if not batch.num_rows:
            continue
        band, component, node = (batch.column(k).to_numpy() for k in range(3))
        sizes, flat = pc.list_value_length(batch.column(3)).to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()
        ends = np.r_[0, sizes.cumsum()]
        cuts = np.flatnonzero(band[1:] != band[:-1]) + 1
        for start, end in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(band)].tolist(), strict=True):
            if of_kept != band[start]:
                close()
                of_kept = band[start]
            kept.append((component[start:end], node[start:end], sizes[start:end], flat[ends[start] : ends[end]]))
        if found_a:
            yield out()
    close()
    yield out()


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    several = placed.groupBy(F.col("band").alias("of_band")).agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    return placed.join(several, F.col("band") == F.col("of_band"), "left_semi")


def _in_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`nodes` with a column component: the least node that links (a, b) reach."""
    known = connected_components(edges).withColumnRenamed("node", "of")
    return nodes.join(known, F.col("of") == F.col("node"), "left").select(*nodes.columns, F.coalesce("root", "node").alias("component"))


def similar_links(marked: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): links between the nodes of `marked` (text_of_simhash, node, fp, bands, sketch) whose sets of shingles have
    a Jaccard index of `similarity` or more, enough of them to connect every component of the candidates."""
    texts = marked.select("node", "text_of_simhash")
    marks = (F.min("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    sketches = materialise(marked.groupBy("node").agg(*marks), "sketches")
    dealt = sketches.select("node", F.explode("bands").alias("band"))
    leads = dealt.groupBy(F.col("band").alias("of_band")).agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead <> last")
    met = materialise(dealt.join(leads, F.col("band") == F.col("of_band")).select("band", "node", "lead"), "bands")
    close = _near_prints(sketches.select("node", "fp"))
    sets = _sets_of(texts, met.select("node").unionAll(close.select("a")).unionAll(close.select("b")), width)
    near = _confirmed(close, sets, similarity)
    joined = materialise(_in_components(sketches.select("node", "sketch"), near), "joined")
    one, two = (joined.select(*(F.col(c).alias(f"{c}_{x}") for c in joined.columns)) for x in "ab")
    stars = met.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    seen = stars.join(one, F.col("a") == F.col("node_a")).join(two, F.col("b") == F.col("node_b")).filter("component_a <> component_b")
    differ = [F.col("sketch_a")[j].bitwiseXOR(F.col("sketch_b")[j]) for j in range(3)]
    places = sum((F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(_EVEN))) for d in differ), F.lit(0))
    likeliest = seen.select("a", "b", places.alias("places")).filter(F.col("places") <= SKETCH_DIFFER).groupBy("b").agg(F.min(F.struct("places", "a")).alias("best"))
    starred = _confirmed(likeliest.select("best.a", "b"), sets, similarity)
    member = _in_components(sketches.select("node"), near.unionAll(starred)).withColumnRenamed("node", "n")
    placed = materialise(_mixed(met.join(member, F.col("n") == F.col("node")).select("band", "component", "node")), "placed")
    whole = placed.join(sets.withColumnRenamed("node", "of").hint("merge"), F.col("of") == F.col("node")).select("band", "component", "node", "shingles")
    across = lambda rows: _across(rows, similarity)
    rest = materialise(whole.repartition("band").sortWithinPartitions("band").mapInArrow(across, "a bigint, b bigint"), "similar")
    for done in (met, placed, sketches, joined, close, sets):
        discard(done)
    return near.unionAll(starred).unionAll(rest)


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component_id) of all nodes (node, least): the least id that links reach."""
    joined = connected_components(edges).withColumnRenamed("node", "of")
    known = joined.join(nodes, F.col("of") == F.col("node")).select("node", "root", "least")
    lead = known.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component"))
    linked = known.join(lead, F.col("root") == F.col("r")).select(F.col("node").alias("of"), "component")
    return nodes.join(linked, F.col("node") == F.col("of"), "left").select("node", F.coalesce("component", "least").alias("component_id"))


def _printed(docs: DataFrame, id_col: str, text_col: str, width: int, words: int) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text_of_simhash"))
    return texts.select("id", fingerprint_udf(width, words).alias("fp"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: (id, fingerprint as 16 hex digits, component_id).

    Words are lower-cased (A-Z) runs of non-blank characters. A text with fewer words than `width` has one shingle,
    its whole word sequence; an empty or null text has fingerprint zero, which links like any other. A component's id
    is the smallest id that links reach. Rows with a null id get a fingerprint and a component, but no null id is a
    component's id unless all its ids are null. Repeated rows appear as often as they came; columns other than the
    two named are not read, whatever their names.
    """
    prints = materialise(_printed(docs, id_col, text_col, width, 1).select("id", F.col("fp")[0].alias("fp")), "simhash")
    nodes = prints.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("least"))
    every = materialise(_components(nodes, links(prints)), "classes")
    return prints.join(every, F.col("fp") == F.col("node")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` without all but one document of each group of similar ones: the one with the smallest id stays, whole.

    Fingerprints are linked through anchors and the links held against the exact sets; bands of minima find the rest.
    Texts link whose sets of `width`-word shingles have a Jaccard index of `similarity` or more; empty, null and short
    texts are treated as in `classes`. Of each group one row stays, also where rows of other groups have its id; of
    different texts of a group under its smallest id, the one with the least hash stays. Rows with a null id stay, as
    nothing names them. All columns are returned.
    """
    mark = fresh(docs.columns, "mark")
    marked = materialise(docs.withColumn(mark, minima_udf(width, text_col)), "marked")
    texts = marked.select(F.col(f"{mark}.node").alias("node"), F.col(id_col).alias("id"), F.col(text_col).alias("text_of_simhash"), f"{mark}.fp", f"{mark}.bands", f"{mark}.sketch")
    known = connected_components(similar_links(texts, width, similarity)).withColumnRenamed("node", "of")
    nodes = texts.filter("id is not null").groupBy("node").agg(F.min("id").alias("id"))
    rooted = nodes.join(known, F.col("node") == F.col("of"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("id", "node")).alias("first"))
    lead = materialise(rooted.select(F.col("first.id").alias("lead_id"), F.col("first.node").alias("lead_node")), "leads")
    mine = marked.select(F.col(mark).alias(mark), F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"))
    stay = mine.join(lead.hint("merge"), (F.col("id") == F.col("lead_id")) & (F.col(f"{mark}.node") == F.col("lead_node"))).dropDuplicates(["lead_id", "lead_node"])
    return stay.select("row.*").unionByName(marked.filter(F.col(id_col).isNull()).select(docs.columns))
