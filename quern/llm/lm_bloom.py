"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Training counts words and word pairs over all training texts. A count c becomes the level 1 + floor(2 log2 c), and the
filter holds (n-gram, 1), ..., (n-gram, level): asking for one level after the other until one is missing gives the
count back to half a power of two, and seldom more than that. The filter is cut into segments by the front bits of the
n-gram's hash, and each segment is as large as its n-grams need: nothing is ever left out.

A small filter (a bound on its size follows from the number of tokens) is broadcast, and texts are scored where they
are. A filter that grows with the corpus can't be; there, texts ask and segments answer. Texts are taken in lots. A lot
sends each segment the n-grams that fall there, with their counts in the lot's training texts; the segment adds up,
builds its bits, probes them, and sends back a level for each n-gram and the exact count of each word, which meet the
lot's texts again. So one shuffle both counts and asks, no key of it is frequent (a lot names an n-gram once), and what
a task holds is bounded by PART_BYTES of text in segments and LOT_TOKENS in lots, whatever the corpus.

Words are told apart by 48 bits of their hash beside those that name a segment, of which there are more in a larger
corpus: of ten million words two are taken for one with a chance below a thousandth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fold, materialise, utf8

#: A filter and word counts that take no more than this, by their bound, are broadcast.
BROADCAST_BYTES = 64 << 20
#: Bits set for each (n-gram, level), and the share of insertions to bits: about 45 % of bits set, 1 % false answers.
PROBES, LOAD = 6, 0.6
#: Weight of pairs against single words, and the constant added to counts.
PAIR_WEIGHT, ADDED = 0.15, 0.1
#: Tokens that a worker takes at once, and bytes of text for each segment.
LOT_TOKENS = 1 << 19
PART_BYTES = 2 << 20
WORDS, PAIRS = 0, 1
_END = np.uint64(xxhash.xxh64_intdigest(b"", 1))  # no word is empty
_START = np.uint64(xxhash.xxh64_intdigest(b"\n", 1))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x2545F4914F6CDD1D)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each token of a text: its lower-cased (A-Z) words, then the end."""
    words = data.lower().split()
    digest = xxhash.xxh64_intdigest
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter((digest(w, 1) for w in words), np.uint64, len(words))
    out[-1] = _END
    return out


def pair_hashes(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it; `first` marks where texts begin."""
    before = np.r_[_START, tokens[:-1]]
    before[first] = _START
    return _mixed(before * _A + tokens)


def level(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, 1 + np.floor(2 * np.log2(np.maximum(count, 1)) + 1e-9), 0).astype(np.int64)


#: What a level stands for: about the middle of the counts that have it.
LEVEL_COUNT = np.r_[0, 1, 1.4, 2, 3, [2 ** ((q - 1) / 2) * 1.19 for q in range(5, 130)]]
#: Bytes of a word's and of a pair's hash that are kept, after the bits that name the part.
_KEY_BYTES = (6, 5)


def _key(h: np.ndarray, bits: int, kind: int) -> np.ndarray:
    """The kept bits of a hash, after the bits that name its part."""
    return (h << np.uint64(bits)) >> np.uint64(64 - 8 * _KEY_BYTES[kind])


def _pack(x: np.ndarray, kind: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _KEY_BYTES[kind]].tobytes()


def _unpack(raw: bytes, kind: int) -> np.ndarray:
    n = _KEY_BYTES[kind]
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _positions(key: np.ndarray, kind: int, lev: np.ndarray | int, size: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    """Where the bits of (n-gram, level) stand in a segment of `size` bits."""
    g = _mixed(key * _A + np.asarray(lev, np.uint64) * _B + np.uint64(kind + 1) * _C)
    one, two = g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | np.uint64(1)
    for j in range(probes):
        yield (one + np.uint64(j) * two) % size


def segment(words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], probes: int = PROBES, load: float = LOAD) -> bytes:
    """Bits that hold the (key, count) n-grams of one part, all levels of all that occur."""
    held = [(key[count > 0], level(count[count > 0])) for key, count in (words, pairs)]
    size = -(-int(probes / load * sum(int(lev.sum()) for _, lev in held)) // 8) * 8
    bits = np.zeros(size, bool)
    for kind, (key, lev) in enumerate(held):
        q = 1
        while len(key):
            for pos in _positions(key, kind, q, np.uint64(size), probes):
                bits[pos.astype(np.int64)] = True
            key, lev = key[lev > q], lev[lev > q]
            q += 1
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass
class LogFrequencyFilter:
    """Segments side by side: bytes, and each segment's first bit and size in bits."""

    bits: int
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    probes: int = PROBES

    @staticmethod
    def of(bits: int, segments: dict[int, bytes], probes: int = PROBES) -> LogFrequencyFilter:
        size = np.zeros(1 << bits, np.uint64)
        for p, s in segments.items():
            size[p] = len(s) * 8
        data = b"".join(s for _, s in sorted(segments.items())) or b"\0"
        return LogFrequencyFilter(bits, np.frombuffer(data, np.uint8), np.cumsum(size) - size, size, probes)

    def levels(self, part: np.ndarray, key: np.ndarray, kind: int) -> np.ndarray:
        """The level of each n-gram, by asking for higher levels until one is missing; 0 for one not held."""
        found = np.zeros(len(key), np.int64)
        at, q = np.flatnonzero(self.size[part] > 0), 1
        while len(at) and q < len(LEVEL_COUNT):
            p, ok = part[at], np.ones(len(at), bool)
            for pos in _positions(key[at], kind, q, self.size[p], self.probes):
                pos += self.start[p]
                ok &= (self.data[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at = at[ok]
            found[at] = q
            q += 1
        return found

    def levels_of(self, h: np.ndarray, kind: int) -> np.ndarray:
        return self.levels(_parts(h, self.bits), _key(h, self.bits, kind), kind)


def _parts(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (id, held_out, data) in lots of about LOT_TOKENS tokens; a longer text is a lot of its own."""
    rows: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        sizes = pc.binary_length(batch.column("data")).to_numpy() // 5 + 1
        start = 0
        for k, size in enumerate(sizes.tolist()):
            if n and n + size > LOT_TOKENS:
                yield pa.Table.from_batches([*rows, batch.slice(start, k - start)])
                rows, n, start = [], 0, k
            n += size
        rows.append(batch.slice(start))
    if n:
        yield pa.Table.from_batches(rows)


def _tokens(lot: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of a lot's texts, one text after the other, and how many each text has."""
    texts = [token_hashes(x.as_py()) for x in lot.column("data")]
    return np.concatenate(texts), np.array([len(t) for t in texts])


def _asked(lot: pa.Table, bits: int) -> Iterator[tuple[int, dict[str, bytes]]]:
    """What a lot sends to each part: its n-grams in order of their hashes, and how often training texts hold them."""
    tokens, lengths = _tokens(lot)
    first = np.r_[0, lengths.cumsum()[:-1]]
    learnt = np.repeat(~lot.column("held_out").to_numpy(), lengths).astype(float)
    found = []
    for h in (tokens, pair_hashes(tokens, first)):
        every, inverse = np.unique(h, return_inverse=True)
        times = np.bincount(inverse, learnt, len(every)).astype("<u4")
        found.append((every, times, np.searchsorted(_parts(every, bits), np.arange((1 << bits) + 1))))
    (words, wc, wat), (pairs, pc, pat) = found
    for p in np.flatnonzero(np.diff(wat) + np.diff(pat)).tolist():
        w, x = slice(wat[p], wat[p + 1]), slice(pat[p], pat[p + 1])
        yield p, {"words": _pack(_key(words[w], bits, WORDS), WORDS), "word_counts": wc[w].tobytes(), "pairs": _pack(_key(pairs[x], bits, PAIRS), PAIRS), "pair_counts": pc[x].tobytes()}


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and where each given key stands among them."""
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(inverse, np.concatenate(counts), len(every)).astype(np.int64), inverse


_MESSAGE = "part long, lot long, words binary, word_counts binary, pairs binary, pair_counts binary"
_ANSWER = "lot long, part long, word_levels binary, word_counts binary, pair_levels binary, n long, v long, docs long, mass double, segment binary, words binary, filter_bytes long"
_TEXTS = "lot long, texts binary"
_FIELDS = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _record(ddl: str, rows: list[dict]) -> pa.RecordBatch:
    """A batch of rows by name; what a row lacks is null."""
    schema = pa.schema([(x.split()[0], _FIELDS[x.split()[1]]) for x in ddl.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The lots of a partition (column `at`) with numbers of their own."""
    for k, lot in enumerate(_lots(batches)):
        yield (lot.column("at")[0].as_py() << 32) + k, lot.drop_columns(["at"])


def _ask(bits: int) -> Callable:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, lot in _numbered(batches):
            rows: list[dict] = []
            for part, message in _asked(lot, bits):
                rows.append({"part": part, "lot": number, **message})
                if len(rows) == 256:
                    yield _record(_MESSAGE, rows)
                    rows = []
            yield _record(_MESSAGE, rows)

    return ask


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lots' texts, packed: the same lots that asked, as the partitions and their order are the same."""
    for number, lot in _numbered(batches):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, lot.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(lot)
        yield _record(_TEXTS, [{"lot": number, "texts": out.getvalue().to_pybytes()}])


def _answer(bits: int, keep_segment: bool, probes: int, load: float) -> Callable:
    """A segment sums what lots sent, builds its bits and answers from them. To be broadcast, it gives its bits and word
    counts instead."""
    def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lots, got = key[0].as_py(), [], {c: [] for c in ("words", "word_counts", "pairs", "pair_counts")}
        for b in batches:
            lots += b.column("lot").to_pylist()
            for w, wc, p, pc in zip(*(b.column(c).to_pylist() for c in got), strict=True):
                got["words"].append(_unpack(w, WORDS))
                got["pairs"].append(_unpack(p, PAIRS))
                got["word_counts"].append(np.frombuffer(wc, "<u4"))
                got["pair_counts"].append(np.frombuffer(pc, "<u4"))
        sizes = {c: np.cumsum([len(x) for x in got[c]]) for c in ("words", "pairs")}
        words, wc, w_at = _summed(got.pop("words"), got.pop("word_counts"))
        pairs, pc, p_at = _summed(got.pop("pairs"), got.pop("pair_counts"))
        made = segment((words, wc), (pairs, pc), probes, load)
        f = LogFrequencyFilter(bits, np.frombuffer(made or b"\0", np.uint8), np.zeros(1 << bits, np.uint64), np.full(1 << bits, len(made) * 8, np.uint64), probes)
        here = np.full(max(len(words), len(pairs)), part)
        wl = f.levels(here[: len(words)], words, WORDS).astype(np.uint8)
        known = wc > 0
        end = wc[words == _key(np.array([_END]), bits, WORDS)] if part == _parts(np.array([_END]), bits)[0] else wc[:0]
        totals = {"part": part, "n": int(wc.sum()), "v": int(known.sum()), "docs": int(end[0]) if len(end) else 0, "mass": float(LEVEL_COUNT[wl[known]].sum()), "filter_bytes": len(made)}
        if keep_segment:
            yield _record(_ANSWER, [totals | {"segment": made, "words": ((words[known] << np.uint64(64 - 8 * _KEY_BYTES[WORDS])) >> np.uint64(bits) | np.uint64(part << (64 - bits))).astype("<u8").tobytes(), "word_counts": wc[known].astype("<u8").tobytes()}])
            return
        yield _record(_ANSWER, [totals])
        pl = f.levels(here[: len(pairs)], pairs, PAIRS).astype(np.uint8)
        rows: list[dict] = []
        for k, lot in enumerate(lots):
            w, p = (at[(size[k - 1] if k else 0) : size[k]] for at, size in ((w_at, sizes["words"]), (p_at, sizes["pairs"])))
            rows.append({"lot": lot, "part": part, "word_levels": wl[w].tobytes(), "word_counts": wc[w].astype("<u8").tobytes(), "pair_levels": pl[p].tobytes()})
            if len(rows) == 1000:
                yield _record(_ANSWER, rows)
                rows = []
        if rows:
            yield _record(_ANSWER, rows)

    return answer


@dataclass(frozen=True)
class Totals:
    """What a model has learnt from: tokens, distinct words, texts, and the counts that levels stand for, summed."""

    n: int
    v: int
    docs: int
    mass: float


def probabilities(word: np.ndarray, pair: np.ndarray, context: np.ndarray, t: Totals) -> np.ndarray:
    """p(word | the one before) from quantised counts: a share of the pair's count in its context's, and the word's
    own with ADDED to every count. Single words sum to 1 over all known ones and one unknown one, but for false answers;
    the pairs of a context to within the fifth by which a level misses a count, so all of it to within 3 %."""
    single = (word + ADDED) / (t.mass + ADDED * (t.v + 1))
    pair = np.minimum(pair, np.minimum(word, context))
    return np.where(context > 0, PAIR_WEIGHT * pair / np.maximum(context, 1) + (1 - PAIR_WEIGHT) * single, single)


def _scores(lot: pa.Table, t: Totals, find: Callable) -> pa.RecordBatch:
    """The scores of a lot's texts. `find` gets the distinct words' and pairs' hashes, each in order, and gives the
    words' levels and exact counts and the pairs' levels."""
    tokens, lengths = _tokens(lot)
    first = np.r_[0, lengths.cumsum()[:-1]]
    of = np.repeat(np.arange(len(lengths)), lengths)
    words, w_at = np.unique(tokens, return_inverse=True)
    pairs, p_at = np.unique(pair_hashes(tokens, first), return_inverse=True)
    word_levels, exact, pair_levels = find(words, pairs)
    word = LEVEL_COUNT[word_levels][w_at]
    context = np.r_[0.0, word[:-1]]
    context[first] = t.docs
    p = probabilities(word, LEVEL_COUNT[pair_levels][p_at], context, t)
    base = np.log10(exact + ADDED) - np.log10(t.n + ADDED * (t.v + 1))
    columns = [lengths, np.bincount(of, exact[w_at] > 0, len(lengths)).astype(np.int64), np.bincount(of, base[w_at], len(lengths)), np.bincount(of, np.log10(p), len(lengths))]
    plain = lot.combine_chunks()
    return pa.RecordBatch.from_arrays([*(plain.column(c).combine_chunks() for c in ("id", "held_out")), *map(pa.array, columns)], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _repeatable(rows: DataFrame) -> bool:
    """Whether a plan gives the same partitions in the same order each time: it only reads files, row by row."""
    todo = [rows._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        children = plan.children()
        if plan.nodeName().split(" ")[0] not in ("Project", "Filter", "LogicalRelation", "Relation", "LocalRelation") and not plan.nodeName().startswith(("Relation", "Scan")):
            return False
        todo += [children.apply(k) for k in range(children.size())]
    return True


def scored(
    docs: DataFrame, held_out: tuple[int, int] = (10, 0), id_col: str = "doc_id", text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES, part_bytes: int = PART_BYTES, probes: int = PROBES, load: float = LOAD,
) -> DataFrame:
    """One row per document: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    The model and the base counts learn from rows whose id's fold is not the held-out one; a null id is never held
    out. base_score adds log10((c + 0.1) / (N + 0.1 (V + 1))) over tokens with exact counts; score is the filter
    model's log10 probability of the whole text. Null and empty texts have one token, the end. Repeated rows are each
    scored; ids of any type come back as they were; other columns are not read. Without training texts every count is
    0. Scores are the same whether the filter is broadcast or asked by segment.
    """
    spark = docs.sparkSession
    out_of = F.coalesce(fold(id_col, held_out[0]) == held_out[1], F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), out_of.alias("held_out"), utf8(text_col).alias("data"))
    rows = (rows if _repeatable(rows) else materialise(rows, "lm-texts")).withColumn("at", F.spark_partition_id())
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes")).first()
    bits = max(1, (size.bytes // part_bytes).bit_length())
    # a text of b bytes has b / 2 + 1 tokens at most; a token adds 1.5 levels to a word and to a pair, and a word count
    small = (size.bytes / 2 + size.n) * (2 * 1.5 * probes / load / 8 + 16) <= broadcast_bytes
    messages = rows.mapInArrow(_ask(bits), _MESSAGE)
    table = materialise(messages.groupBy("part").applyInArrow(_answer(bits, small, probes, load), _ANSWER), "lm-answers")
    sums = table.filter("n is not null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "docs", "mass"))).first()
    t = Totals(int(sums.n), int(sums.v), int(sums.docs), float(sums.mass))
    result = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    if small:
        found = table.filter("segment is not null").select("part", "segment", "words", "word_counts").collect()
        words, counts = (np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(r[c], "<u8") for r in found)]) for c in ("words", "word_counts"))
        order, drop = np.argsort(words), np.uint64(max(0, 64 - bits - 8 * _KEY_BYTES[WORDS]))
        shared = spark.sparkContext.broadcast((LogFrequencyFilter.of(bits, {r.part: bytes(r.segment) for r in found}, probes), words[order], counts[order].astype(np.int64)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, known, count = shared.value

            def find(words: np.ndarray, pairs: np.ndarray):
                kept = words >> drop << drop  # as many bits as segments keep
                at = np.minimum(np.searchsorted(known, kept), max(0, len(known) - 1))
                exact = np.where(known[at] == kept, count[at], 0) if len(known) else np.zeros(len(words), np.int64)
                return model.levels_of(words, WORDS), exact, model.levels_of(pairs, PAIRS)

            for lot in _lots(batches):
                yield _scores(lot, t, find)

        got = rows.mapInArrow(score, result)
    else:

        def score_lot(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts, answers = None, []
            for b in batches:
                for r in b.to_pylist():
                    if r["texts"] is not None:
                        texts = r["texts"]
                    else:
                        answers.append((r["part"], r["word_levels"], r["word_counts"], r["pair_levels"]))
            answers.sort()
            joined = [b"".join(a[k] for a in answers) for k in (1, 2, 3)]

            def find(words: np.ndarray, pairs: np.ndarray):
                wl, c, pl = (np.frombuffer(x, kind) for x, kind in zip(joined, (np.uint8, "<u8", np.uint8), strict=True))
                if len(wl) != len(words) or len(pl) != len(pairs):
                    raise RuntimeError(f"{len(wl)} and {len(pl)} answers for {len(words)} words and {len(pairs)} pairs of a lot")
                return wl, c.astype(np.int64), pl

            with pa.ipc.open_stream(texts) as s:
                yield _scores(s.read_all(), t, find)

        asked = table.filter("lot is not null").select("lot", "part", "word_levels", "word_counts", "pair_levels")
        packed = rows.mapInArrow(_texts, _TEXTS)
        got = asked.unionByName(packed, allowMissingColumns=True).groupBy("lot").applyInArrow(score_lot, result)
    return got.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(t.n).cast("long").alias("train_tokens"), "base_score", "score")
