"""Byte passages that occur more than once, by run-length indexes of what can repeat.

1. Every 200-byte window is named by the least hash of the 32-byte strings in it, so equal
   windows get equal names wherever they stand. Consecutive windows of a document with one
   name form a segment; every window lies in exactly one. Segments travel as hashes.
2. Sorted by (name, content), equal segments stand together: all their windows repeat.
   A name with only one segment holds no repeat, unless its naming string occurs twice in
   it. What is left are those, and names of several different segments; of equal ones a
   single copy goes on.
3. The bytes of those are grouped by name and indexed: suffixes sorted to a depth above
   the window, Burrows-Wheeler transform, runs. Only at borders of runs is a match length
   compared directly; from there the lengths are streamed through the text, as between
   borders they change by one per byte. A window repeats if its length reaches the window.
4. A name whose segments are too many bytes for one index is resolved by hashing each of
   its windows and counting them in a shuffle, which splits any group.

Segments are range-partitioned by (name, content, document), so no name or content is tied
to one task; at a border of partitions a segment simply goes on to step 3.

Defined cases. A null or empty text has no bytes. Repeated rows are places of their own,
so both lose everything if they are long enough. Texts shorter than the window lose
nothing. An empty table gives no rows. Other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.llm.common import shared_table, shuffle_tasks

WINDOW = 200
GRAM = 32
#: Bytes that are hashed, or indexed, at a time.
BATCH_BYTES = 1 << 20
#: A name with more segment bytes than this is resolved by counting its windows.
INDEX_BYTES = 1 << 22
#: Rows of one name, in a sorted partition, beyond which its head is given out.
HELD_ROWS = 100_000
MARK, CANDIDATE = 0, 1


def _mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (v ^ (v >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on; GRAM is a power of 2."""
    code = text.astype(np.uint64) + np.uint64(1)
    factor = 0x100000001B3
    size = 1
    while size < GRAM:
        code = code[:-size] * np.uint64(factor) + code[size:]
        factor = factor * factor % (1 << 64)
        size *= 2
    return _mixed(code)


def _sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def _loops(hashes, names, first, last, width) -> np.ndarray:
    """Whether a segment's naming string occurs twice in it. Only then can two of its own
    windows be equal."""
    edge = np.zeros(width - 1, np.uint64)
    highest = _sliding(np.maximum, np.concatenate([edge, names, edge]), width)
    named = np.flatnonzero(hashes == highest)  # places that name one of their windows
    low = np.searchsorted(named, first)
    count = np.searchsorted(named, last + width - 1, "right") - low
    owner = np.repeat(np.arange(len(first)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    equal = hashes[named[low[owner] + within]] == names[first][owner]
    return np.bincount(owner[equal], minlength=len(first)) > 1


def _segments(docs: DataFrame, window: int) -> DataFrame:
    """(name, content, k1, k2, start, n, loops): `n` windows of a document from `start` on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch["text"]]
            k1, k2 = (batch[c].to_numpy() for c in ("k1", "k2"))
            for chosen in _in_blocks([len(t) for t in texts], BATCH_BYTES):
                yield from cut_block([texts[i] for i in chosen], k1[chosen], k2[chosen])

    def cut_block(texts, k1, k2):
        joined = b"".join(texts)
        if len(joined) < window:
            return
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        hashes, width = gram_hashes(np.frombuffer(joined, np.uint8)), window - GRAM + 1
        names = _sliding(np.minimum, hashes, width)
        doc = np.repeat(np.arange(len(texts)), sizes)[: len(names)]
        inside = np.arange(len(names)) + window <= ends[doc]
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(names)))
        first, count = first[inside[first]], count[inside[first]]
        content = [
            xxhash.xxh3_64_intdigest(joined[a:b])
            for a, b in zip(first.tolist(), (first + count + (window - 1)).tolist())
        ]
        own = doc[first]
        loops = _loops(hashes, names, first, first + count - 1, width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[first].view(np.int64)),
             pa.array(np.array(content, np.uint64).view(np.int64)),
             pa.array(k1[own]), pa.array(k2[own]),
             pa.array((first - (ends - sizes)[own]).astype(np.int32)),
             pa.array(count.astype(np.int32)), pa.array(loops)],
            ["name", "content", "k1", "k2", "start", "n", "loops"],
        )

    return docs.select("k1", "k2", "text").mapInArrow(
        cut, "name long, content long, k1 long, k2 int, start int, n int, loops boolean"
    )


def _in_blocks(sizes: Sequence[int], most: int) -> Iterator[list[int]]:
    """Neighbouring numbers whose sizes add up to `most` or little more."""
    block, held = [], 0
    for i, size in enumerate(sizes):
        block.append(i)
        held += size
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def _sorted_out(
    batches: Iterator[pa.RecordBatch], held_rows: int = HELD_ROWS
) -> Iterator[pa.RecordBatch]:
    """MARK rows for segments with an equal one; CANDIDATE rows, one per content, for names
    with several contents or at an edge of the partition. Rows come sorted; `held_rows` is
    3 or more."""
    held: pa.Table | None = None
    edge, split = True, False  # split: other contents of the held name are given out
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            name = rows["name"].to_numpy()
            last = np.searchsorted(name, name[-1])  # the last name may go on
            if last:
                yield from _decided(rows.slice(0, last), edge or split, False)
                edge, split = False, False
            held = rows.slice(last)
            if held.num_rows > held_rows:  # a hot name; its head is settled, its last content held
                content = held["content"].to_numpy()
                cut = np.searchsorted(content, content[-1])
                if cut:
                    yield from _decided(held.slice(0, cut), True, True)
                    held, split = held.slice(cut), True
                else:  # one content: every row has an equal one
                    body = held.slice(0, held.num_rows - 2)
                    yield from _decided(body, False, False)
                    held = held.slice(held.num_rows - 2)
    if held is not None:
        yield from _decided(held, True, True)


def _decided(rows: pa.Table, first_open: bool, last_open: bool) -> Iterator[pa.RecordBatch]:
    name, content = (rows[c].to_numpy() for c in ("name", "content"))
    new_name = np.append(True, name[1:] != name[:-1])
    new = new_name | np.append(True, content[1:] != content[:-1])
    at = np.flatnonzero(new)
    equal = np.diff(np.append(at, len(name)))
    name_of = np.cumsum(new_name[at]) - 1
    contents = np.bincount(name_of)
    wanted = contents[name_of] > 1
    wanted |= rows["loops"].to_numpy()[at]
    wanted |= (name_of == 0) & first_open
    wanted |= (name_of == name_of[-1]) & last_open
    for kind, keep in ((MARK, np.flatnonzero(np.repeat(equal > 1, equal))),
                       (CANDIDATE, at[wanted])):
        if len(keep):
            out = rows.take(pa.array(keep)).drop_columns(["content", "loops"])
            out = out.append_column("kind", pa.array(np.full(len(keep), kind, np.int32)))
            yield from out.combine_chunks().to_batches()


# the index


def repeated_starts(segments: Sequence[bytes], window: int) -> list[np.ndarray]:
    """For each segment, the starts of its windows that occur elsewhere among the segments
    or elsewhere in it."""
    sizes = np.array([len(s) for s in segments])
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\x00".join([*segments, b""]), np.uint8).astype(np.uint16) + 2
    text[starts + sizes] = SEPARATOR
    lengths = _match_lengths(text, window)
    return [
        np.flatnonzero(lengths[a : a + max(n - window + 1, 0)] >= window)
        for a, n in zip(starts.tolist(), sizes.tolist())
    ]


def _match_lengths(text: np.ndarray, depth: int) -> np.ndarray:
    """For each position the longest match with another one, up to `depth`.

    A separator may be matched, which does not matter where a match of full depth is
    wanted inside a segment.
    """
    n = len(text)
    order, ranks = _suffix_order(text, depth)
    before = text[order - 1]  # the transform; position 0 is preceded by the last one
    border = np.append(True, before[1:] != before[:-1])  # heads of runs
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return np.maximum(
        _streamed(text, ranks, order, place, border, -1, depth),
        _streamed(text, ranks, order, place, np.append(border[1:], True), 1, depth),
    )


def _streamed(text, ranks, order, place, border, side, depth) -> np.ndarray:
    """Match lengths with the neighbour on one side in suffix order.

    Where the suffix at i + 1 is inside a run, i and i + 1 have the same neighbours, one
    byte apart: the length at i is one more. At the other positions, as many as there are
    runs, suffixes are compared.
    """
    n = len(text)
    sampled = np.append(border[place[1:]], True)
    at = np.flatnonzero(sampled)
    other = place[at] + side
    there = (other >= 0) & (other < n)
    known = np.zeros(len(at), np.int64)
    known[there] = _compared(text, ranks, at[there], order[other[there]], depth)
    positions = np.arange(n)
    following = np.searchsorted(at, positions)
    return np.minimum(known[following] + (at[following] - positions), depth)


SYMBOLS = 7  # 9-bit symbols in a 63-bit key; 0 stands for what is past the end
SEPARATOR = 1


def _suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """All suffixes sorted, and for 7, 14, 28 ... symbols up to `depth` a number that is
    equal where that many symbols are. Each round sorts only what is still tied."""
    n = len(text)
    padded = np.append(text, np.zeros(SYMBOLS, text.dtype)).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(SYMBOLS):
        key = (key << 9) | padded[j : j + n]
    order, at, size = np.arange(n), np.arange(n), SYMBOLS
    rank, ranks = np.zeros(n, np.int32), {}
    while True:
        sort = np.argsort(key)
        own, key = order[at][sort], key[sort]
        order[at] = own
        new = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(new, at, 0)) + 1
        if size <= depth:
            ranks[size] = rank
        at = at[~(new & np.append(new[1:], True))]  # the tied
        if not len(at):
            return order, ranks
        own = order[at]
        later = np.where(own + size < n, rank[np.minimum(own + size, n - 1)], 0)
        key = rank[own].astype(np.int64) * (n + 1) + later
        size *= 2


def _compared(text, ranks, a, b, depth) -> np.ndarray:
    """Equal symbols from a and b on, up to `depth`."""
    n = len(text)
    done = np.zeros(len(a), np.int64)
    for size in sorted(ranks, reverse=True):
        rank = np.append(ranks[size], -1)
        for _ in range(1 if size < max(ranks) else -(-depth // size)):
            i, j = np.minimum(a + done, n), np.minimum(b + done, n)
            done += size * ((rank[i] == rank[j]) & (i < n) & (j < n))
    ended = np.append(text.astype(np.int64), -1)
    going = np.ones(len(a), bool)
    for _ in range(SYMBOLS - 1):
        i, j = np.minimum(a + done, n), np.minimum(b + done, n)
        going &= (ended[i] == ended[j]) & (i < n) & (j < n)
        done += going
    return np.minimum(done, depth)


def _indexed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (name, k1, k2, start, bytes) sorted by name; whole names are indexed together."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        names = rows["name"].to_numpy()
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        sizes = np.array([len(b.as_py()) for b in rows["bytes"]], np.int64)
        sums = np.add.reduceat(sizes, first)[:-1]  # the last name may go on
        bounds = np.append(first, len(names))
        done = 0
        for block in _in_blocks(sums, BATCH_BYTES):
            if sums[block].sum() < BATCH_BYTES:
                break  # waits for more
            done = bounds[block[-1] + 1]
            yield from _index(rows.slice(bounds[block[0]], done - bounds[block[0]]), window)
        held = rows.slice(done)
    if held is not None:
        yield from _index(held, window)


def _index(rows: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    flags = repeated_starts(rows["bytes"].to_pylist(), window)
    row, start, count = [], [], []
    for i, at in enumerate(flags):
        if len(at):
            first = np.flatnonzero(np.append(True, np.diff(at) > 1))
            row += [i] * len(first)
            start.append(at[first])
            count.append(np.diff(np.append(first, len(at))))
    if row:
        taken = rows.take(pa.array(row))
        starts = taken["start"].to_numpy() + np.concatenate(start)
        yield pa.RecordBatch.from_arrays(
            [taken["k1"].combine_chunks(), taken["k2"].combine_chunks(),
             pa.array(starts.astype(np.int32)), pa.array(np.concatenate(count).astype(np.int32))],
            ["k1", "k2", "start", "n"],
        )


PLACE = "k1 long, k2 int, start int, n int"


def repeated_windows(
    docs: DataFrame, window: int = WINDOW, index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """(k1, k2, start, n): runs of windows that start elsewhere as well.

    `docs` has the columns k1, k2 and text, as `keyed` makes them.
    """
    if window <= GRAM:
        raise ValueError(f"the window must be longer than {GRAM} bytes")
    tasks = shuffle_tasks(docs.sparkSession)
    order = ["name", "content", "k1", "start"]
    sorted_out = shared_table(
        _segments(docs, window)
        .repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_sorted_out, f"name long, {PLACE}, kind int"),
        "segments",
    )
    marks = sorted_out.filter(F.col("kind") == MARK).select("k1", "k2", "start", "n")
    candidates = sorted_out.filter(F.col("kind") == CANDIDATE)
    weight = F.sum(F.col("n") + window).alias("weight")
    large = candidates.groupBy("name").agg(weight).filter(F.col("weight") > index_bytes)
    candidates = candidates.join(
        large.select("name", F.lit(True).alias("large")), "name", "left"
    )
    per_doc = candidates.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("name", "start", "n", "large")).alias("wanted")
    )
    one_each = docs.select("k1", "k2", "text").join(per_doc, ["k1", "k2"])
    cut = shared_table(
        one_each.dropDuplicates(["k1", "k2"]).mapInArrow(
            lambda batches: _cut_out(batches, window),
            "name long, k1 long, k2 int, start int, bytes binary, large boolean",
        ),
        "bytes",
    )
    indexed = (
        cut.filter(~F.col("large"))
        .repartition(tasks, "name")
        .sortWithinPartitions("name")
        .mapInArrow(lambda batches: _indexed(batches, window), PLACE)
    )
    return marks.union(indexed).union(_counted(cut.filter("large"), window))


def _cut_out(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    names = ["name", "k1", "k2", "start", "bytes", "large"]
    for batch in batches:
        rows = []
        for k1, k2, text, wanted in zip(*(batch[c].to_pylist() for c in
                                          ("k1", "k2", "text", "wanted"))):
            raw = (text or "").encode()
            for w in wanted:
                own = raw[w["start"] : w["start"] + w["n"] + window - 1]
                rows.append((w["name"], k1, k2, w["start"], own, bool(w["large"])))
        if rows:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(columns, names)


def _counted(segments: DataFrame, window: int) -> DataFrame:
    """The windows of segments that occur twice or more, by 128-bit hashes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch["bytes"][row].as_py()
                n = len(raw) - window + 1
                digests = b"".join(
                    [xxhash.xxh3_128_digest(raw[i : i + window]) for i in range(n)]
                )
                pairs = np.frombuffer(digests, np.int64).reshape(n, 2)
                start = batch["start"][row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
                     pa.array([batch["k1"][row].as_py()] * n, pa.int64()),
                     pa.array([batch["k2"][row].as_py()] * n, pa.int32()),
                     pa.array(np.arange(start, start + n, dtype=np.int32))],
                    ["w1", "w2", "k1", "k2", "start"],
                )

    windows = segments.mapInArrow(hashed, "w1 long, w2 long, k1 long, k2 int, start int")
    twice = windows.groupBy("w1", "w2").count().filter(F.col("count") > 1).select("w1", "w2")
    return windows.join(twice, ["w1", "w2"]).select(
        "k1", "k2", "start", F.lit(1).cast("int").alias("n")
    )


def _keys(id_col: Column, text: Column) -> tuple[Column, Column]:
    """96 bits that stand for (id, text)."""
    return F.xxhash64(id_col, text).alias("k1"), F.hash(text, id_col).alias("k2")


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] | None = None,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """(row, n_bytes, spans, kept): `row` holds the columns `carry` of `docs`, all by
    default; `spans` are the maximal removed runs [first, past last]; `kept` are the
    remaining bytes."""
    text = F.col(text_col).cast("string")
    keyed = docs.select(
        F.struct(*(carry or docs.columns)).alias("row"),
        F.coalesce(text, F.lit("")).alias("text"),
        *_keys(F.col(id_col), text),
    )
    per_doc = (
        repeated_windows(keyed, window, index_bytes)
        .groupBy("k1", "k2")
        # A set: repeated rows share their keys, and so have the same entries many times.
        .agg(F.collect_set(F.struct("start", "n")).alias("found"))
    )
    joined = keyed.join(per_doc, ["k1", "k2"], "left").select("row", "text", "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, found in zip(batch["text"], batch["found"].to_pylist()):
                raw = text.as_py().encode()
                own = _joined_spans(found or [], window)
                ends = [0, *(b for _, b in own)]
                starts = [*(a for a, _ in own), len(raw)]
                sizes.append(len(raw))
                spans.append(own)
                kept.append(b"".join([raw[a:b] for a, b in zip(ends, starts)]))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                ["row", "n_bytes", "spans", "kept"],
            )

    schema = T.StructType(
        [
            joined.schema["row"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    return joined.mapInArrow(cut, schema)


def _joined_spans(found: list[dict], window: int) -> list[list[int]]:
    spans: list[list[int]] = []
    for start, n in sorted((f["start"], f["n"]) for f in found):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], start + n + window - 1)
        else:
            spans.append([start, start + n + window - 1])
    return spans
