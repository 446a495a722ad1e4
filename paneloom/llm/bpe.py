"""Byte-level BPE with a public vocabulary: texts to ids and back.

A Python process reads the vocabulary once and keeps the ids of words it has met (a cache
bounded in bytes). A new word is merged on a contiguous array of part boundaries with the
rank of each adjacent pair: scan for the smallest rank, delete the boundary, refresh the
two neighbouring ranks. That is quadratic, so words above `SHORT` bytes use a heap over
linked parts; the merges, and so the ids, are the same.

Defined cases. Null is encoded like the empty text, to no ids, which decode to "". The
vocabulary's special strings in a text become their ids. Ids outside the vocabulary are
left out by decoding, bytes that are no UTF-8 become U+FFFD. Repeated rows get equal
results, an empty table none; other columns are carried in `row`.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORT = 128
#: Bound of the cache of words, in bytes as counted below.
CACHED_BYTES = 128 << 20
#: Words whose entry is larger are not kept.
CACHED_WORD = 600
#: Of a word's entry: the dictionary's slot, the string's and the tuple's own fields, and
#: ids that are objects of their own.
WORD_BYTES = 250
# Fixed value: the public pre-tokenizer's pattern.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# The same over texts of ASCII only, where the classes can be written out.
ASCII_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
NO_RANK = 1 << 40
NO_MERGE = NO_RANK << 32
LOW = (1 << 32) - 1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Words(dict):
    """Ids of the words met so far; a new one is merged. Words not met again while half of
    `CACHED_BYTES` is filled are forgotten."""

    def __init__(self, merged):
        super().__init__()
        self.merged, self.held, self.before = merged, 0, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.before.get(word) or self.merged(word)
        size = WORD_BYTES + 4 * len(word) + 8 * len(ids)
        if size <= CACHED_WORD:
            if self.held + size > CACHED_BYTES // 2:
                self.before = dict(self)
                self.clear()
                self.held = 0
            self.held += size
            self[word] = ids
        return ids


class Vocabulary:
    """What a task needs to encode and decode. A merge is one entry of a dictionary of
    whole numbers: left id and right id in the key, rank and merged id in the value."""

    def __init__(self, content: str):
        data = json.loads(content)
        letters = byte_letters()
        ids = data["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        alone = {b: ids.get(c) for c, b in letters.items()}
        self.byte_ids = [alone[b] for b in range(256)]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left] << 32 | ids[right]] = rank << 32 | ids[left + right]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")")
        self.find = regex.compile(PATTERN).findall
        self.find_ascii = re.compile(ASCII_PATTERN).findall
        self.words = Words(self.word)

    def word(self, word: str) -> tuple[int, ...]:
        parts = [self.byte_ids[b] for b in word.encode()]
        return tuple(self._short(parts) if len(parts) <= SHORT else self._long(parts))

    def _rank(self, left: int, right: int) -> int:
        return self.merges.get(left << 32 | right, NO_MERGE) >> 32

    def _short(self, parts: list[int]) -> list[int]:
        merge = self.merges.get
        # Rank and merged id of each adjacent pair; ranks differ, so the least has the least rank.
        pairs = [merge(a << 32 | b, NO_MERGE) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == NO_MERGE:
                break
            at = pairs.index(least)
            parts[at] = new = least & LOW
            del parts[at + 1], pairs[at]
            if at:
                pairs[at - 1] = merge(parts[at - 1] << 32 | new, NO_MERGE)
            if at < len(pairs):
                pairs[at] = merge(new << 32 | parts[at + 1], NO_MERGE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        queue = [
            (rank, i, parts[i], parts[i + 1])
            for i in range(n - 1)
            if (rank := self._rank(parts[i], parts[i + 1])) != NO_RANK
        ]
        heapq.heapify(queue)
        while queue:
            _, at, left, right = heapq.heappop(queue)
            nxt = after[at]
            if not alive[at] or nxt < 0 or parts[at] != left or parts[nxt] != right:
                continue
            parts[at] = self.merges[left << 32 | right] & LOW
            alive[nxt] = False
            after[at] = after[nxt]
            if after[at] >= 0:
                before[after[at]] = at
            for i in (before[at], at):
                j = after[i] if i >= 0 else -1
                if j >= 0 and (rank := self._rank(parts[i], parts[j])) != NO_RANK:
                    heapq.heappush(queue, (rank, i, parts[i], parts[j]))
        return [p for p, a in zip(parts, alive) if a]

    def encode(self, text: str) -> np.ndarray:
        ids: list[int] = []
        for piece in self.split.split(text) if self.special else [text]:
            if piece in self.special:
                ids.append(self.special[piece])
                continue
            find = self.find_ascii if piece.isascii() else self.find
            ids += chain.from_iterable(map(self.words.__getitem__, find(piece)))
        return np.array(ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join([self.bytes_of.get(i, b"") for i in ids.tolist()])
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _vocabulary(content: str) -> Vocabulary:
    """One per Python process, whose tasks share it and its cache."""
    return Vocabulary(content)


def _sent(spark, path: str):
    """The vocabulary file's text (about 1.5 MB), broadcast."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _ids(vocabulary: Vocabulary, texts: pa.Array) -> Iterator[np.ndarray]:
    return (vocabulary.encode(t.as_py() or "").astype("<u4") for t in texts)


def _with_text(docs: DataFrame, text_col: str, carry: Sequence[str] | None) -> DataFrame:
    return docs.select(
        F.struct(*(carry or docs.columns)).alias("row"),
        F.col(text_col).cast("string").alias("text"),
    )


def encode(
    docs: DataFrame,
    vocabulary: str,
    text_col: str = "text",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """(row, ids): `row` holds the columns `carry` of `docs`, all by default; `ids` are
    little-endian unsigned 32-bit numbers in one binary value."""
    sent = _sent(docs.sparkSession, vocabulary)
    rows = _with_text(docs, text_col, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent.value)
        for batch in batches:
            ids = [i.tobytes() for i in _ids(vocabulary, batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(ids, pa.binary())], ["row", "ids"]
            )

    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def round_trip(
    docs: DataFrame,
    vocabulary: str,
    text_col: str = "text",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """(row, ids, decoded): `encode` and `decode` in one step, so that a core holds one
    vocabulary in one Python process."""
    sent = _sent(docs.sparkSession, vocabulary)
    rows = _with_text(docs, text_col, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent.value)
        for batch in batches:
            raw, texts = [], []
            for ids in _ids(vocabulary, batch["text"]):
                raw.append(ids.tobytes())
                texts.append(vocabulary.decode(ids))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(raw, pa.binary()), pa.array(texts, pa.string())],
                ["row", "ids", "decoded"],
            )

    schema = T.StructType(
        [
            rows.schema["row"],
            T.StructField("ids", T.BinaryType()),
            T.StructField("decoded", T.StringType()),
        ]
    )
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds `decoded` to a table with `ids` as `encode` makes them; null ids decode to ""."""
    sent = _sent(encoded.sparkSession, vocabulary)
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent.value)
        for batch in batches:
            texts = [
                vocabulary.decode(np.frombuffer(i.as_py() or b"", "<u4")) for i in batch["ids"]
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(texts, pa.string())], [*names, "decoded"]
            )

    schema = T.StructType([*fields, T.StructField("decoded", T.StringType())])
    return encoded.select(names).mapInArrow(run, schema)
