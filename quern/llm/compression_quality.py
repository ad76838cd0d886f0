"""Quality score from compressed sizes under two zstandard dictionaries, one of good and one of bad labelled text."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, labelled_sample, utf8

#: A text is compressed in blocks of so many bytes, each on its own: else a long text teaches the compressor itself,
#: and the dictionaries no longer matter.
BLOCK_BYTES = 512
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: Bounds of the sample that the model is fitted on; scores cover every whole text.
FIT_ROWS = 4000
FIT_TEXT_BYTES = 64 << 10
_RIDGE = 1e-3


def _blocks(data: bytes) -> list[bytes]:
    return [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)] or [b""]


@dataclass
class CompressionClassifier:
    """How much smaller the good dictionary makes a text than the bad one, over the sum of both sizes (the difference),
    calibrated twice: `difference_score` = logistic(a + b difference), and `score`, which also sees that sum over twice
    the text's bytes (the rate, very low for what repeats itself).

    Without both dictionaries (no labels, or one class only) every score is `prior`, every difference 0."""

    dictionaries: tuple[bytes, bytes] | None
    weights: list[float]
    difference_weights: list[float]
    prior: float = 0.5
    _engines: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_engines": []}

    def sizes(self, data: bytes) -> tuple[int, int]:
        """Compressed bytes under the bad and the good dictionary."""
        if not self._engines:
            for raw in self.dictionaries:
                known = zstandard.ZstdCompressionDict(raw)
                known.precompute_compress(level=LEVEL)
                self._engines.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))
        bad, good = (e.compress for e in self._engines)
        parts = _blocks(data)
        return sum(len(bad(p)) for p in parts), sum(len(good(p)) for p in parts)

    def features(self, data: bytes) -> tuple[float, float]:
        bad, good = self.sizes(data)
        return (bad - good) / (bad + good), (bad + good) / (2 * len(data) + 16)

    def judge(self, data: bytes) -> tuple[float, float, float]:
        """(score, difference, difference_score) of a text."""
        if self.dictionaries is None:
            return self.prior, 0.0, self.prior
        x = self.features(data)
        return _logistic(self.weights, x), x[0], _logistic(self.difference_weights, x[:1])

    def score(self, data: bytes) -> float:
        return self.judge(data)[0]


def _logistic(weights: list[float], x: tuple[float, ...]) -> float:
    at = weights[0] + float(np.dot(weights[1:], x))
    return float(1 / (1 + np.exp(-np.clip(at, -40, 40))))


def _calibrated(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights (first the constant) of a logistic regression on standardised columns, a little ridged."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a, w = np.c_[np.ones(len(x)), (x - mean) / scale], np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + _RIDGE * np.eye(len(w)), a.T @ (y - p) - _RIDGE * w)
    return [float(w[0] - np.sum(w[1:] * mean / scale)), *map(float, w[1:] / scale)]


def _dictionary(texts: list[bytes], order: np.random.Generator) -> bytes:
    """A dictionary of texts whose shared lines count once: what many documents copy is no sign of their quality."""
    seen: set[bytes] = set()
    parts: list[bytes] = []
    for t in texts:
        new = [x for x in t.split(b"\n") if x not in seen]
        seen.update(new)
        parts += [p for p in _blocks(b"\n".join(new)) if p]
    order.shuffle(parts)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(parts)[:DICTIONARY_BYTES]


def fit(sample: list[tuple[int, bytes, int]]) -> CompressionClassifier:
    """Half of the (id, text, label 0 or 1) rows make the dictionaries, the other half the calibration."""
    rows = sorted(sample, key=lambda r: r[0])
    prior = (sum(r[2] for r in rows) + 1) / (len(rows) + 2)
    halves = [[r for k, r in enumerate(rows) if k % 2 == h] for h in (0, 1)]
    if any({r[2] for r in h} != {0, 1} for h in halves):
        return CompressionClassifier(None, [], [], prior)
    order = np.random.default_rng(7)
    model = CompressionClassifier(tuple(_dictionary([t for _, t, y in halves[0] if y == label], order) for label in (0, 1)), [], [])
    x, y = np.array([model.features(t) for _, t, _ in halves[1]]), np.array([y for *_, y in halves[1]], float)
    model.weights, model.difference_weights = _calibrated(x, y), _calibrated(x[:, :1], y)
    return model


def fit_on(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: tuple[int, int] | None = (3, 1), id_col: str = "doc_id", text_col: str = "text") -> CompressionClassifier:
    sample = labelled_sample(docs, labels, label_col, FIT_ROWS, FIT_TEXT_BYTES, held_out, id_col, text_col)
    return fit([(r.id, bytes(r.data), int(r.label != 0)) for r in sample.toLocalIterator()])


def score_column(model: CompressionClassifier, text_col: str = "text"):
    """A column of structs (score, difference, difference_score) of each whole text; null and empty texts score as an
    empty text."""
    names = ("score", "difference", "difference_score")

    @F.arrow_udf(f"struct<{','.join(f'{n}:double' for n in names)}>")
    def compression_score(texts: pa.Array) -> pa.Array:
        rows = np.array([model.judge(t) for t in texts.to_pylist()], float).reshape(-1, len(names))
        return pa.StructArray.from_arrays([pa.array(rows[:, k].copy()) for k in range(len(names))], list(names))

    return compression_score(utf8(text_col))


def scored(docs: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, difference, difference_score, predicted) of every row; repeated rows are scored alike and all
    returned, rows with a null id too; other columns are not read."""
    got = docs.select(F.col(id_col).alias("id"), score_column(model, text_col).alias("s")).select(F.col("id").alias(id_col), "s.*")
    return got.select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: CompressionClassifier, text_col: str = "text") -> DataFrame:
    """`docs` without the rows scored below 0.5; columns as they came, also such as share a name with one of a score."""
    mark = fresh(docs.columns, "compression_score")
    return docs.withColumn(mark, score_column(model, text_col)["score"]).filter(F.col(mark) >= 0.5).drop(mark)
