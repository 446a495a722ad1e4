"""Document statistics, and decision lists learned from them.

A decision list is found by sequential covering: grow a conjunction of thresholds by the
gain in information, prune it on rows kept apart, accept it while it is precise there,
remove what it covers, repeat. The list is small and is emitted as one chain of Spark
`when` expressions over the statistics, so that applying it needs no Python.

Defined cases. A null text has no words, lines or characters. Statistics of repeated rows
are equal. Learning ignores null labels; without rows of both classes the list is empty
and nothing is rejected by it. An empty table gives no rows. Other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks",
)
FEATURES = (
    "n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share",
    "distinct_share", "upper_share", "digit_share", "mark_share", "line_words",
)
#: Rows a list is learned from: a bounded sample in hash order of the id.
SAMPLE = 20_000

SPACES = bytes([0x20, *range(0x09, 0x0E)])
CONTINUED = bytes(range(0x80, 0xC0))
# Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?.,;:"


def _kept(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text. Words are runs of characters other than white space."""
    raw = text.encode() if text else b""
    words = raw.split()
    lines = raw.split(b"\n") if raw else []
    filled = [line for line in lines if line.strip()]
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    return (
        len(words),
        len(raw.translate(None, SPACES + CONTINUED)),
        _kept(raw, SYMBOLS),
        len(filled) - len(set(filled)),
        _repeated(ids, len(codes)),
        len(filled),
        len(codes),
        _kept(raw, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _kept(raw, b"0123456789"),
        _kept(raw, MARKS),
    )


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Places in windows of three that occur twice or more."""
    if len(ids) < 4:
        return 0
    if distinct < 2_000_000:  # three numbers fit in 63 bits
        windows = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pairs = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)[1]
        windows = pairs * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for j in range(3):
        covered[j : j + len(windows)] |= twice
    return int(covered.sum())


def document_statistics(
    docs: DataFrame, text_col: str = "text", carry: Sequence[str] | None = None
) -> DataFrame:
    """(row, COUNTS): `row` holds the columns `carry` of `docs`, all by default."""
    rows = docs.select(
        F.struct(*(carry or docs.columns)).alias("row"),
        F.col(text_col).cast("string").alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array(
                [text_counts(t.as_py()) for t in batch["text"]], np.int64
            ).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], *(pa.array(c) for c in table.T)], ["row", *COUNTS]
            )

    longs = [T.StructField(c, T.LongType()) for c in COUNTS]
    return rows.mapInArrow(count, T.StructType([rows.schema["row"], *longs]))


def feature_columns() -> dict[str, Column]:
    """FEATURES from COUNTS."""

    def per(top: str, bottom: str) -> Column:
        return F.col(top) / F.greatest(F.col(bottom), F.lit(1))

    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "distinct_share": per("n_distinct_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "digit_share": per("n_digits", "word_chars"),
        "mark_share": per("n_marks", "word_chars"),
        "line_words": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # the value is at least the threshold, else below it
    threshold: float

    def column(self) -> Column:
        value = feature_columns()[self.feature]
        return value >= self.threshold if self.above else value < self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        values = x[:, FEATURES.index(self.feature)]
        return values >= self.threshold if self.above else values < self.threshold


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects, otherwise the document is accepted."""

    rules: tuple[Rule, ...]

    def number(self) -> Column:
        """Number of the first rule that holds, from 1; null if none does."""
        chain = None
        for n, rule in enumerate(self.rules, 1):
            test = rule[0].column()
            for condition in rule[1:]:
                test = test & condition.column()
            chain = F.when(test, n) if chain is None else chain.when(test, n)
        return F.lit(None).cast("int") if chain is None else chain.cast("int")

    def rejects(self, x: np.ndarray) -> np.ndarray:
        return np.any([_covers(r, x) for r in self.rules] or np.zeros((1, len(x)), bool), axis=0)


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.all([c.holds(x) for c in rule], axis=0)


def _candidates(x: np.ndarray, cuts: int) -> list[Condition]:
    found = []
    for j, feature in enumerate(FEATURES):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1)[1:])):
            found += [Condition(feature, above, float(cut)) for above in (True, False)]
    return found


def _grow(x: np.ndarray, bad: np.ndarray, cuts: int, most: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < most and (bad[inside] == 0).any():
        positives = (bad & inside).sum()
        now = np.log2(positives / inside.sum())
        best, best_gain = None, 1e-9
        for condition in _candidates(x[inside & bad], cuts) + _candidates(x[inside], cuts):
            after = inside & condition.holds(x)
            p = (bad & after).sum()
            if p:
                gain = p * (np.log2(p / after.sum()) - now)
                if gain > best_gain:
                    best, best_gain = condition, gain
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The prefix with the best (p - n) / (p + n) on rows it was not grown on."""

    def worth(prefix: Rule) -> float:
        inside = _covers(prefix, x)
        return (2 * (bad & inside).sum() - inside.sum()) / max(1, inside.sum())

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())


def learn_rules(
    x: np.ndarray,
    bad: np.ndarray,
    precision: float = 0.9,
    cuts: int = 24,
    most_conditions: int = 4,
    most_rules: int = 16,
    seed: int = 7,
) -> DecisionList:
    """A list that rejects `bad` rows; every rule is at least so precise on unseen rows."""
    x, bad = np.asarray(x, float), np.asarray(bad, bool)
    to_grow = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        grow, test = left & to_grow, left & ~to_grow
        if not (bad & grow).any() or not (bad & test).any():
            break
        rule = _grow(x[grow], bad[grow], cuts, most_conditions)
        rule = _prune(rule, x[test], bad[test])
        if not rule:
            break
        inside = _covers(rule, x)
        hits = (bad & inside & test).sum()
        if not hits or hits < precision * (inside & test).sum():
            break
        rules.append(rule)
        left &= ~inside
    return DecisionList(tuple(rules))


def learn_from_labels(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    **options,
) -> DecisionList:
    """Learns to reject documents labelled 0 from at most `sample` labelled rows.

    The rows are the first in hash order of the id; only their statistics (ten numbers
    each) reach the driver.
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .dropna()
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "id"  # at most `sample` rows
    )
    counted = document_statistics(texts, carry=["id", "label"])
    rows = (
        counted.select("row.id", "row.label", *(c.alias(n) for n, c in feature_columns().items()))
        .orderBy(F.xxhash64("id"), *FEATURES, "label")
        .limit(sample)
        .collect()
    )
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    return learn_rules(x, np.array([r["label"] == 0 for r in rows], bool), **options)


def base_failed() -> Column:
    """Too short, or half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text",
          carry: Sequence[str] | None = None) -> DataFrame:
    """(row, COUNTS, base_failed, rule, kept)."""
    counted = document_statistics(docs, text_col, carry)
    return (
        counted.withColumn("base_failed", base_failed())
        .withColumn("rule", rules.number())
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
