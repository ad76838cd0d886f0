"""Quality rules learned as a decision list: sequential covering over text statistics, emitted as Spark conditions."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, labelled_sample, utf8

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
_INNER = bytes(range(0x80, 0xC0))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")
#: What conditions are on: shares (of one statistic in another), so that a text's length alone decides nothing.
FEATURES = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "chars_per_word": ("word_chars", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
}
#: Bounds of the sample that rules are learned from; the rules apply to every whole text.
FIT_ROWS = 12000
FIT_TEXT_BYTES = 1 << 20


def statistics(data: bytes) -> tuple[int, ...]:
    """STATS of one text. Words are runs of non-blank characters; lines count if they hold a word; a word counts as
    repeated if it lies in a 3-word window that the text has twice or more."""
    words = data.split()
    n = len(words)
    less = lambda drop: len(data) - len(data.translate(None, drop))
    lines = [x for x in data.split(b"\n") if x.strip(BLANKS)]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            times = Counter(windows)
            end = 0
            for k, w in enumerate(windows):
                if times[w] > 1:
                    repeated += k + 3 - max(k, end)
                    end = k + 3
    return (
        n, len(data.translate(None, BLANKS + _INNER)), less(SYMBOLS), len(lines) - len(set(lines)), repeated,
        len(lines), less(bytes(range(0x41, 0x5B))), less(b"!?"), len(set(words)),
    )


def statistics_column(text: str | Column = "text") -> Column:
    """STATS of a text column as a struct; null counts as empty, with zeros throughout."""
    @F.arrow_udf(f"struct<{','.join(f'{s}:bigint' for s in STATS)}>")
    def text_statistics(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(STATS))
        return pa.StructArray.from_arrays([pa.array(rows[:, k].copy()) for k in range(len(STATS))], list(STATS))

    return text_statistics(utf8(text))


def feature(name: str, struct: str | None = None) -> Column:
    """A feature of STATS, which are columns, or fields of the column `struct`."""
    part, whole = (F.col(s) if struct is None else F.col(struct)[s] for s in FEATURES[name])
    return part / F.greatest(whole, F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, struct: str | None = None) -> Column:
        value = feature(self.feature, struct)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass(frozen=True)
class DecisionList:
    """Rules tried in order; a text is rejected by the first whose conditions all hold, else kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rule_column(self, struct: str | None = None) -> Column:
        """The number (from 1) of the first rule that holds, else 0, as one ordered conditional expression."""
        out = F.lit(0)
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            holds = rule[0].column(struct)
            for c in rule[1:]:
                holds = holds & c.column(struct)
            out = F.when(holds, k).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.4g}" for c in r) for r in self.rules)


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and bad[inside].sum() and (~bad)[inside].sum():
        p0, n0 = bad[inside].sum(), (~bad)[inside].sum()
        best: tuple[float, Condition | None] = (0.0, None)
        for k, name in enumerate(names):
            values = np.unique(x[inside, k])
            if len(values) < 2:
                continue
            middle = (values[1:] + values[:-1]) / 2
            at = np.searchsorted(middle, x[inside, k])
            p, n = (np.bincount(at[m], minlength=len(middle) + 1).cumsum()[:-1] for m in (bad[inside], ~bad[inside]))
            for above, ps, ns in ((False, p, n), (True, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - np.log2(p0 / (p0 + n0))), 0)
                if gain.max() > best[0] + 1e-9:
                    best = (float(gain.max()), Condition(name, above, float(middle[gain.argmax()])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x, names)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], most_conditions: int = 3, least_precision: float = 0.9, least_covered: int = 4, most_rules: int = 12) -> DecisionList:
    """Grow a rule on two thirds of the rows by information gain, prune its last conditions on the other third, keep
    it if it is right there often enough, take away what it covers, and go on. Rows with equal statistics count each."""
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    covers = lambda rule: np.logical_and.reduce([c.holds(x, names) for c in rule])
    while len(rules) < most_rules and (bad & left & ~third).any():
        grown = _grow(x[left & ~third], bad[left & ~third], names, most_conditions)
        if not grown:
            break
        scored = []
        for k in range(len(grown), 0, -1):
            c = covers(grown[:k]) & left
            p, n = (bad & c & third).sum(), (~bad & c & third).sum()
            scored.append(((p - n) / (p + n) if p + n else -1.0, p, k))
        k = max(scored)[2]
        c = covers(grown[:k]) & left
        if bad[c].sum() < least_covered or bad[c].mean() < least_precision:
            break
        rules.append(tuple(grown[:k]))
        left &= ~c
    return DecisionList(tuple(rules))


def fit_on(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: tuple[int, int] | None = (3, 1), id_col: str = "doc_id", text_col: str = "text") -> DecisionList:
    """Learn from the statistics of a bounded labelled sample; label 0 is bad. No labels, or one class: no rules."""
    sample = labelled_sample(docs, labels, label_col, FIT_ROWS, FIT_TEXT_BYTES, held_out, id_col, text_col)
    stats = sample.select("id", "label", statistics_column("data").alias("s")).select("id", "label", "s.*")
    rows = stats.select("id", "label", *(feature(n).cast("double").alias(n) for n in FEATURES)).toPandas().sort_values("id")
    return learn(rows[list(FEATURES)].to_numpy(float), (rows["label"] == 0).to_numpy(), list(FEATURES))


def judged(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, STATS, base_failed, rule, kept) of every row. An empty or null text has no words, so the base rule fails
    it; repeated rows are judged alike and all returned."""
    got = docs.select(F.col(id_col), statistics_column(text_col).alias("s")).select(id_col, "s.*")
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    got = got.select("*", base.alias("base_failed"), rules.rule_column().alias("rule"))
    return got.select("*", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that the base rule or the list rejects; columns as they came."""
    s = fresh(docs.columns, "text_stats")
    good = F.expr(f"{s}.n_words >= 50 AND 100 * {s}.n_repeat_words <= 50 * {s}.n_words") & (rules.rule_column(s) == 0)
    return docs.withColumn(s, statistics_column(text_col)).filter(good).drop(s)
