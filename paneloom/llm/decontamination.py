"""Passages of benchmark items in documents.

A window is `n` consecutive words of an item, or all words of a shorter one. While the
items are small enough (`max_bytes`, counted first) they travel as a broadcast, and every task
makes the sorted set of its windows' hashes for one scan of the documents: a rolling hash of
word hashes finds places, the words themselves decide. Beyond that bound windows and
documents meet in a join on 128-bit window hashes instead; results are the same.

Defined cases. A null or empty text or item has no words and hits nothing. Rows that share
an item_id are parts of one item; a null item_id counts as one item named "". Repeated
documents get equal results. Empty tables give no hits or no rows. Other columns are
ignored or carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.common import row_keys, words_of

WINDOW = 13
#: Bytes of items that may be broadcast. A task needs about 10 bytes for each of them, for
#: the words' places and hashes and the windows' (50 a word of 5 bytes).
MAX_BYTES = 4 << 20
#: What an item counts beside its text.
ITEM_BYTES = 64
# Odd multipliers, which spread hashes of words over 64 bits.
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)


def benchmark_windows(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(item, window): every distinct window of every item, words joined by a space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                words = words_of(text)
                if words:
                    size = min(n, len(words))
                    own = {
                        b" ".join(words[i : i + size]).decode()
                        for i in range(len(words) - size + 1)
                    }
                    ids += [item] * len(own)
                    windows += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(windows, pa.string())], ["item", "window"]
            )

    rows = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
        F.col(text_col).cast("string").alias("text"),
    )
    return rows.mapInArrow(cut, "item string, window string").distinct()


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    n: int = WINDOW,
    max_bytes: int = MAX_BYTES,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """(row, n_words, n_hit, items, spans): `row` holds the columns `carry` of `docs`, all
    by default; `items` are ids in string order; `spans` are maximal runs [first, past
    last] of hit words."""
    rows = docs.select(
        F.struct(*(carry or docs.columns)).alias("row"),
        F.col(text_col).cast("string").alias("text"),
    )
    size = items.agg(
        F.sum(F.octet_length(F.col(item_text_col).cast("string")).cast("long")).alias("bytes"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if (size["bytes"] or 0) + ITEM_BYTES * size["n"] <= max_bytes:
        return _by_broadcast(rows, items, n, item_col, item_text_col)
    return _by_join(rows, benchmark_windows(items, n, item_col, item_text_col))


class _Windows:
    """Windows as places in the items' words, with a rolling hash to find them.

    Words are the interpreter's 64-bit hashes (the same within a process), a window is the
    rolled hash of its words; sorted hashes say where a window may stand, its words decide.
    """

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.items = [item for item, _ in items]
        words = [text.split(b" ") for _, text in items]
        self.text = b" ".join(text for _, text in items)
        lengths = np.fromiter((len(w) for own in words for w in own), np.int64)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        codes = self.codes([w for own in words for w in own])
        counts = np.array([len(own) for own in words], np.int64)
        firsts = np.cumsum(counts) - counts
        self.by_size: dict[int, tuple[np.ndarray, ...]] = {}
        for size in sorted({min(n, int(c)) for c in counts}):
            own = np.flatnonzero(counts == size if size < n else counts >= n)
            at = np.concatenate([firsts[i] + np.arange(counts[i] - size + 1) for i in own])
            item = np.repeat(own, counts[own] - size + 1)
            hashes = self.rolled(codes, size)[at]
            order = np.argsort(hashes, kind="stable")
            shift = np.uint64(64 - max(16, min(26, int(len(at) * 8).bit_length())))
            seen = np.zeros(1 << int(np.uint64(64) - shift), bool)
            seen[hashes >> shift] = True
            self.by_size[size] = (hashes[order], at[order], item[order], seen, shift)

    @staticmethod
    def codes(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)

    @staticmethod
    def rolled(codes: np.ndarray, size: int) -> np.ndarray:
        total = codes[: len(codes) - size + 1] * BASE
        for j in range(1, size):
            total = total * STEP + codes[j : len(codes) - size + 1 + j] * BASE
        return total

    def places(self, words: list[bytes]) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, size, numbers of the items) of every window that occurs."""
        codes, total = self.codes(words) * BASE, None
        for size in range(1, min(len(words), max(self.by_size, default=0)) + 1):
            here = codes[size - 1 :]
            total = here if total is None else total[:-1] * STEP + here
            if size not in self.by_size:
                continue
            hashes, at, item, seen, shift = self.by_size[size]
            maybe = np.flatnonzero(seen[total >> shift])
            low = np.searchsorted(hashes, total[maybe], "left")
            high = np.searchsorted(hashes, total[maybe], "right")
            for place, a, b in zip(maybe.tolist(), low.tolist(), high.tolist()):
                if a < b:
                    own = b" ".join(words[place : place + size])
                    found = {
                        int(item[k])
                        for k in range(a, b)
                        if self.text[self.starts[at[k]] : self.ends[at[k] + size - 1]] == own
                    }
                    if found:
                        yield place, size, found


def _merged(places: list[tuple[int, int]]) -> list[list[int]]:
    spans: list[list[int]] = []
    for first, end in sorted(places):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([first, end])
    return spans


def _by_broadcast(rows: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    known = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string")
    ).collect()  # at most `max_bytes`
    found = [(item, b" ".join(words_of(text))) for item, text in known]
    sent = rows.sparkSession.sparkContext.broadcast([x for x in found if x[1]])
    row_type = rows.schema["row"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Windows(sent.value, n)
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for text in batch["text"].to_pylist():
                words = words_of(text)
                found = list(known.places(words))
                merged = _merged([(at, at + size) for at, size, _ in found])
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in merged))
                items.append(sorted({known.items[i] for *_, own in found for i in own}))
                spans.append(merged)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(items, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                ["row", *HITS.names],
            )

    return rows.mapInArrow(scan, T.StructType([row_type, *HITS.fields]))


def _by_join(rows: DataFrame, windows: DataFrame) -> DataFrame:
    text = F.col("text")
    keyed = rows.select("row", "text", *row_keys(F.to_json("row"), text))
    sizes = sorted(  # one value per length of a window
        r[0] for r in windows.select(F.size(F.split("window", " "))).distinct().collect()
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["text"].to_pylist()):
                words = words_of(text)
                for size in sizes:
                    own = [
                        b" ".join(words[j : j + size]).decode()
                        for j in range(len(words) - size + 1)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch[k][i].as_py()] * len(own), pa.int64())
                         for k in ("k1", "k2")]
                        + [pa.array(np.arange(len(own), dtype=np.int32)),
                           pa.array(np.full(len(own), size, np.int32)),
                           pa.array(own, pa.string())],
                        ["k1", "k2", "at", "size", "window"],
                    )

    hashes = F.xxhash64("window").alias("h1"), F.xxhash64(F.lit(5), F.col("window")).alias("h2")
    places = (
        keyed.select("k1", "k2", "text")
        .mapInArrow(cut, "k1 long, k2 long, at int, size int, window string")
        .select("k1", "k2", "at", "size", *hashes)
    )
    grouped = windows.select("item", *hashes)
    found = (
        places.join(grouped, ["h1", "h2"])
        .groupBy("k1", "k2")
        .agg(
            F.sort_array(F.collect_set("item")).alias("items"),
            F.collect_set(F.array(F.col("at"), F.col("at") + F.col("size"))).alias("places"),
        )
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [len(words_of(t)) for t in batch["text"].to_pylist()]
            spans = [_merged(p or []) for p in batch["places"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(words, pa.int64()),
                 pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                 pa.array([x or [] for x in batch["items"].to_pylist()], pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                ["row", *HITS.names],
            )

    joined = keyed.join(found, ["k1", "k2"], "left").select("row", "text", "items", "places")
    return joined.mapInArrow(merge, T.StructType([rows.schema["row"], *HITS.fields]))


def is_contaminated():
    """At least one hit word, and at least one word in twenty."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def remove_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """`docs` without the contaminated ones, with the same columns."""
    return find_passages(docs, items, **options).filter(~is_contaminated()).select("row.*")


def remove_spans(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(row, clean_text): every text without its hit words; what stands between two words
    of a span goes as well. A null text stays null."""
    text_col = options.get("text_col", "text")
    found = find_passages(docs, items, **options).select(
        "row", "spans", F.col("row").getField(text_col).cast("string").alias("text")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch["text"].to_pylist(), batch["spans"].to_pylist())
            texts = [_without(t, s) if s else t for t, s in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(texts, pa.string())], ["row", "clean_text"]
            )

    schema = T.StructType([found.schema["row"], T.StructField("clean_text", T.StringType())])
    return found.mapInArrow(cut, schema)


def _without(text: str, spans: list[list[int]]) -> str:
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    parts, done = [], 0
    for first, end in spans:
        parts.append(raw[done : at[first][0]])
        done = at[end - 1][1]
    return b"".join([*parts, raw[done:]]).decode()
