"""Toxicity scores from subword bags.

A word is the average of the vectors of its character n-grams, so an unseen misspelling
or inflection is close to the words it shares n-grams with. A block of `BLOCK` words is
the average of its words and goes through a linear softmax; a document is toxic if any
of its blocks is (noisy or), so one insult in a long text is not averaged away. Vectors
and softmax are trained jointly in numpy, by Adam, on a bounded sample of labelled rows
inside one task. All arithmetic after training is linear, so a word needs one number.

Defined cases. A null or empty text has one block without words; its score is the bias.
Null labels are ignored; without rows of both classes every score is the prior of the
sample (0.5 without any). Repeated rows get equal scores. Empty tables give no rows.
Labels, ids and further columns are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.common import words_of

BUCKETS = 1 << 17  # `subwords` takes 17 bits of a product
DIMENSIONS = 8
BLOCK = 48
GRAMS = (3, 4, 5)
#: At most so many labelled rows of each class are learned from, in hash order of the id.
SAMPLE = 3_000
CACHED_WORDS = 400_000


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the marked words and of their character n-grams, in UTF-8 bytes, and
    for each the number of its word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [b"<" + w + b">" for w in words]
    lengths = np.array([len(m) for m in marked])
    number = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)[number]
    letters = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
    buckets = [np.array([zlib.crc32(m) % BUCKETS for m in marked], np.int64)]
    owners = [np.arange(len(words))]
    code = letters
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint64(257) + letters[n - 1 :]  # n letters fit in 64 bits
        if n in GRAMS:
            at = np.flatnonzero(np.arange(len(code)) + n <= ends[: len(code)])
            mixed = code[at] * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(64 - 17)).astype(np.int64))
            owners.append(number[at])
    return np.concatenate(buckets), np.concatenate(owners)


class Model:
    """The weight of every bucket, and a bias: `vectors @ (softmax[1] - softmax[0])`."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def to_bytes(self) -> bytes:
        return np.append(self.weights, np.float32(self.bias)).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        values = np.frombuffer(raw, np.float32)
        return cls(values[:-1], values[-1])


class _WordScores(dict):
    """Word to its number: the average weight of its subwords."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(float)

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            new = list(words)
        buckets, owner = subwords(new)
        sums = np.bincount(owner, self.weights[buckets], len(new))
        self.update(zip(new, (sums / np.bincount(owner, minlength=len(new))).tolist()))


def _document_score(block_logits: np.ndarray) -> float:
    return float(-np.expm1(-np.logaddexp(0, block_logits).sum()))


def _text_scores(scores: _WordScores, bias: float, texts: Sequence[str | None]) -> list[float]:
    if not scores.weights.any():  # nothing was learned
        return [_document_score(np.array([bias]))] * len(texts)
    lists = [words_of(t) for t in texts]
    scores.learn(set().union(*lists))
    return [_score(scores, bias, words) for words in lists]


def _score(scores: _WordScores, bias: float, words: list[bytes]) -> float:
    if not words:
        return _document_score(np.array([bias]))
    values = np.fromiter(map(scores.__getitem__, words), float, len(words))
    starts = np.arange(0, len(words), BLOCK)
    sizes = np.diff(np.append(starts, len(words)))
    return _document_score(np.add.reduceat(values, starts) / sizes + bias)


def train(
    texts: Sequence[str | None],
    toxic: Sequence[int],
    rounds: int = 150,
    min_docs: int = 3,
    rate: float = 0.2,
    decay: float = 1e-5,
    damping: float = 1e-4,
    seed: int = 7,
) -> Model:
    """Vectors and softmax of documents labelled 0 or 1."""
    y = np.asarray(toxic, bool)
    if not len(y) or y.all() or not y.any():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS), np.log(share / (1 - share)))
    numbers: dict[bytes, int] = {}
    word_at, block_sizes, doc_blocks = [], [], []
    for text in texts:
        words = words_of(text)
        word_at.append(
            np.fromiter(
                (numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)
            )
        )
        sizes = [min(BLOCK, len(words) - i) for i in range(0, len(words), BLOCK)] or [0]
        block_sizes += sizes
        doc_blocks.append(len(sizes))
    words = np.concatenate(word_at)
    sizes, per_doc = np.array(block_sizes), np.array(doc_blocks)
    block_of_word = np.repeat(np.arange(len(sizes)), sizes)
    doc_of_block = np.repeat(np.arange(len(y)), per_doc)
    gram_at, gram_word = subwords(list(numbers))
    gram_counts = np.maximum(np.bincount(gram_word, minlength=len(numbers)), 1)
    common = _document_counts(word_at, gram_at, gram_word) >= min_docs
    gram_word, gram_at = gram_word[common[gram_at]], gram_at[common[gram_at]]
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    largest = np.maximum(sizes, 1)

    rng = np.random.default_rng(seed)
    parameters = {
        "vectors": rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32),
        "softmax": rng.normal(0, 0.1, (2, DIMENSIONS)).astype(np.float32),
        "bias": np.array([2.0, -2.0], np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in parameters.items()}
    second = {k: np.zeros_like(v) for k, v in parameters.items()}
    for step in range(1, rounds + 1):
        vectors, softmax, bias = parameters.values()
        direction = softmax[1] - softmax[0]
        of_bucket = vectors @ direction
        of_word = np.bincount(gram_word, of_bucket[gram_at], len(numbers)) / gram_counts
        of_block = np.bincount(block_of_word, of_word[words], len(sizes)) / largest
        logits = of_block + bias[1] - bias[0]
        doubt = np.bincount(doc_of_block, np.logaddexp(0, logits), len(y))
        push = np.where(y, -1 / np.expm1(np.maximum(doubt, 1e-9)), 1.0) * weight
        at_block = push[doc_of_block] / (1 + np.exp(-logits))
        at_word = np.bincount(words, (at_block / largest)[block_of_word], len(numbers))
        at_bucket = np.bincount(gram_at, (at_word / gram_counts)[gram_word], BUCKETS)
        toward = vectors.T @ at_bucket
        gradients = {
            "vectors": at_bucket[:, None] * direction + decay * vectors,
            "softmax": np.stack([-toward, toward]) + decay * softmax,
            "bias": np.array([-at_block.sum(), at_block.sum()]),
        }
        for name, gradient in gradients.items():
            first[name] += 0.1 * (gradient - first[name])
            second[name] += 0.001 * (gradient**2 - second[name])
            move = first[name] / (1 - 0.9**step)
            move /= np.sqrt(second[name] / (1 - 0.999**step)) + damping
            parameters[name] -= (rate * move).astype(np.float32)
    vectors, softmax, bias = parameters.values()
    return Model(vectors @ (softmax[1] - softmax[0]), bias[1] - bias[0])


def _document_counts(
    word_at: list[np.ndarray], gram_at: np.ndarray, gram_word: np.ndarray
) -> np.ndarray:
    """Documents with each bucket. A bucket of one or two says nothing of others."""
    order = np.argsort(gram_word, kind="stable")
    gram_at, ends = gram_at[order], np.cumsum(np.bincount(gram_word))
    starts = np.append(0, ends[:-1])
    counts = np.zeros(BUCKETS, np.int32)
    for words in word_at:
        own = np.unique(words)
        sizes = ends[own] - starts[own]
        at = np.repeat(starts[own] - np.append(0, np.cumsum(sizes)[:-1]), sizes)
        counts[np.unique(gram_at[at + np.arange(sizes.sum())])] += 1
    return counts


def learn(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    **options,
) -> Model:
    """Learns from at most `sample` rows per class; the fit runs in one task."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna()
    chosen = None
    for label in (0, 1):
        part = (
            known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
        )
        chosen = part if chosen is None else chosen.union(part)
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(chosen), "id")  # at most twice `sample` rows
        .orderBy(F.xxhash64("id"), "id", "label", F.xxhash64("text"))
        .limit(2 * sample)
        .select("text", "label")
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch["text"].to_pylist()
            marks += batch["label"].to_pylist()
        model = train(texts, marks, **options)
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()])], ["model"])

    fitted = rows.coalesce(1).mapInArrow(fit, "model binary").collect()
    return Model.from_bytes(fitted[0]["model"]) if fitted else train([], [])


def score(
    docs: DataFrame, model: Model, text_col: str = "text", carry: Sequence[str] | None = None
) -> DataFrame:
    """(row, score, predicted): `row` holds the columns `carry` of `docs`, all by default."""
    rows = docs.select(
        F.struct(*(carry or docs.columns)).alias("row"),
        F.col(text_col).cast("string").alias("text"),
    )
    sent = docs.sparkSession.sparkContext.broadcast(model.to_bytes())  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.from_bytes(sent.value)
        scores = _WordScores(own.weights)
        for batch in batches:
            values = []
            for at in range(0, batch.num_rows, 256):  # bounds the words at hand
                texts = batch["text"].slice(at, 256).to_pylist()
                values += _text_scores(scores, own.bias, texts)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(values, pa.float64())], ["row", "score"]
            )

    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
