"""Lines that many documents share, found without moving text.

Line hashes are range-partitioned and sorted by hash, document, row and position, so the
occurrences of a line stream by in order, across as many tasks as a very common line needs,
also where they are all of one document. A task counts the documents of each hash as they
come. A hash that starts or ends a partition may go on in the next; for these the counts are
summed over tasks, less the documents that two neighbours have both counted (at most two
rows per task, hence broadcast). Rows of a line that too few documents hold too often are
not kept in memory but decided in the same way. The result is one compressed bitmap per
document that loses a line; texts are joined with it only to be cut.

Defined cases. A null or empty text is one empty line. Empty keys are never dropped.
Rows that share an id count as one document, null being an id of its own; each row still
gets its own result. Repeated rows get equal results. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm.common import (
    LOWER,
    UPPER,
    WHITE,
    id_and_text,
    row_keys,
    shared_table,
    shuffle_tasks,
)

DROP, OPEN, BORDER = 0, 1, 2
#: Rows of a line with too few documents that a task holds; beyond, they are decided by a join.
HELD = 50_000
WHITE_BYTES = WHITE.encode()
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def keep_bitmaps(
    docs: DataFrame,
    min_docs: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    held: int = HELD,
) -> DataFrame:
    """(k1, k2, n_lines, n_dropped, keep) for documents that lose a line.

    k1 and k2 are `row_keys` of the document; `keep` is a zlib-compressed bit per line,
    first line first.
    """
    lines = _line_hashes(id_and_text(docs, id_col, text_col))
    spark = docs.sparkSession
    order = ["h1", "h2", "id", "k1", "k2", "pos"]
    ranged = lines.repartitionByRange(shuffle_tasks(spark), *order).sortWithinPartitions(*order)
    kind = lines.schema["id"].dataType.simpleString()
    found = shared_table(
        ranged.mapInArrow(
            lambda batches: _shared_lines(
                batches, min_docs, TaskContext.get().partitionId(), held
            ),
            "kind int, h1 long, h2 long, docs long, part int, "
            f"first_id {kind}, last_id {kind}, k1 long, k2 long, pos int, n_lines int",
        ),
        "lines",
    )
    # At most two rows per task, and one per `held` rows.
    upto = Window.partitionBy("h1", "h2").orderBy("part")
    before = F.lag(F.struct("last_id")).over(upto)
    twice = before.isNotNull() & before["last_id"].eqNullSafe(F.col("first_id"))
    frequent = (
        found.filter(F.col("kind") == BORDER)
        .select("h1", "h2", (F.col("docs") - twice.cast("int")).alias("docs"))
        .groupBy("h1", "h2")
        .agg(F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_docs)
        .select("h1", "h2")
    )
    columns = ["k1", "k2", "n_lines", "pos"]
    dropped = (
        found.filter(F.col("kind") == DROP)
        .select(columns)
        .union(
            found.filter(F.col("kind") == OPEN)
            .join(F.broadcast(frequent), ["h1", "h2"])
            .select(columns)
        )
    )
    per_doc = dropped.groupBy("k1", "k2", "n_lines").agg(F.collect_set("pos").alias("lost"))
    return per_doc.mapInArrow(
        _bitmaps, "k1 long, k2 long, n_lines long, n_dropped long, keep binary"
    )


def _line_hashes(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, n_lines, pos, h1, h2) of every line that has a key."""
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, total, pos, digests = [], [], [], []
            for i, text in enumerate(batch["text"]):
                lines = (text.as_py() or "").encode().translate(LOWER_BYTES).split(b"\n")
                for at, line in enumerate(lines):
                    key = line.strip(WHITE_BYTES)
                    if key:
                        row.append(i)
                        total.append(len(lines))
                        pos.append(at)
                        digests.append(xxhash.xxh3_128_digest(key))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(at), batch["k1"].take(at), batch["k2"].take(at),
                 pa.array(total, pa.int32()), pa.array(pos, pa.int32()),
                 pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                ["id", "k1", "k2", "n_lines", "pos", "h1", "h2"],
            )

    keyed = docs.select("id", *row_keys(F.col("id"), F.col("text")), "text")
    return keyed.mapInArrow(
        cut, f"id {kind}, k1 long, k2 long, n_lines int, pos int, h1 long, h2 long"
    )


def _shared_lines(
    batches: Iterator[pa.RecordBatch], min_docs: int, part: int, most: int = HELD
) -> Iterator[pa.RecordBatch]:
    """Streams one sorted partition. The open run is held while it has too few documents and
    at most `most` rows; then its rows are given out as they come, to be dropped or, if it
    has too few documents still, to be decided by the sum of its documents."""
    held: pa.Table | None = None  # the open run, or only its last row once it is given out
    given = None  # how: DROP or OPEN
    before = 0  # documents of the open run that are no longer held
    first = True  # the open run is the partition's first
    start_id = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        else:
            start_id = rows["id"].slice(0, 1)
        skip = 0 if given is None else 1  # a held last row has been given out
        starts, docs = _runs(rows)
        docs[0] += before
        ends = np.append(starts[1:], rows.num_rows)
        out = []
        if len(starts) > 1:
            run, n = rows.slice(0, ends[0]), int(docs[0])
            kind = given if given is not None else DROP if n >= min_docs else OPEN
            if kind == DROP or first or given is not None:
                out.append(_rows(run.slice(skip), kind))
            if first or given == OPEN:
                out.append(_border(run, n, part, start_id))
            keep = np.repeat(docs[1:-1] >= min_docs, (ends - starts)[1:-1])
            closed = rows.slice(ends[0], len(keep))
            out.append(_rows(closed.filter(pa.array(keep, pa.bool_())), DROP))
            first, given, skip = False, None, 0
            start_id = rows["id"].slice(starts[-1], 1)
        last, n = rows.slice(starts[-1]), int(docs[-1])
        if given is None and (n >= min_docs or last.num_rows > most):
            given = DROP if n >= min_docs else OPEN
        if given is None:
            held, before = last, 0
        else:
            out.append(_rows(last.slice(skip), given))
            held, before = last.slice(last.num_rows - 1), n - 1
        yield from _batches(out)
    if held is not None:
        out = [_border(held, int(_runs(held)[1][0]) + before, part, start_id)]
        if given is None:
            out.append(_rows(held, OPEN))
        yield from _batches(out)


def _runs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal hashes, and the number of documents in each."""
    new = np.ones(rows.num_rows, bool)
    h1, h2 = (rows.column(c).to_numpy() for c in ("h1", "h2"))
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    ids = rows.column("id").combine_chunks().dictionary_encode()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    code = pc.fill_null(ids.indices, -1).to_numpy(zero_copy_only=False)
    new_doc = new.copy()
    new_doc[1:] |= code[1:] != code[:-1]
    starts = np.flatnonzero(new)
    return starts, np.add.reduceat(new_doc.astype(np.int64), starts)


NAMES = ["kind", "h1", "h2", "docs", "part", "first_id", "last_id", "k1", "k2", "pos", "n_lines"]


def _rows(rows: pa.Table, kind: int) -> pa.Table:
    n = rows.num_rows
    ids = pa.nulls(n, rows.schema.field("id").type)
    return pa.table(
        [pa.array(np.full(n, kind, np.int32)), rows["h1"], rows["h2"], pa.nulls(n, pa.int64()),
         pa.nulls(n, pa.int32()), ids, ids, rows["k1"], rows["k2"], rows["pos"], rows["n_lines"]],
        names=NAMES,
    )


def _border(run: pa.Table, docs: int, part: int, first_id: pa.ChunkedArray) -> pa.Table:
    one = run.slice(run.num_rows - 1, 1)
    return pa.table(
        [pa.array([BORDER], pa.int32()), one["h1"], one["h2"], pa.array([docs], pa.int64()),
         pa.array([part], pa.int32()), first_id, one["id"],
         pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
         pa.nulls(1, pa.int32())],
        names=NAMES,
    )


def _batches(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    for table in tables:
        if table.num_rows:
            yield from table.combine_chunks().to_batches()


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped, maps = [], []
        for n, lost in zip(batch["n_lines"].to_pylist(), batch["lost"]):
            at = lost.values.to_numpy()
            keep = np.ones(n, bool)
            keep[at] = False
            dropped.append(len(at))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch["k1"], batch["k2"], batch["n_lines"].cast(pa.int64()),
             pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())],
            ["k1", "k2", "n_lines", "n_dropped", "keep"],
        )


def cut_lines(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped): `row` holds all columns of `docs`.

    A document without a bitmap keeps its text; of a null text nothing, hence "", is kept.
    """
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *row_keys(F.col(id_col), F.col(text_col).cast("string")),
    )
    joined = keyed.join(bitmaps.select("k1", "k2", "n_dropped", "keep"), ["k1", "k2"], "left")
    cut = F.pandas_udf(_cut, "string")
    return joined.select(
        "row",
        F.when(F.col("keep").isNull(), F.col("text"))
        .otherwise(cut(F.when(F.col("keep").isNotNull(), F.col("text")), "keep"))
        .alias("kept_text"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
    )


def _cut(text: pd.Series, keep: pd.Series) -> pd.Series:
    def one(t, bits):
        if bits is None:
            return None
        lines = t.split("\n")
        kept = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
        return "\n".join([line for line, k in zip(lines, kept) if k])

    return text.combine(keep, one)


def drop_shared_lines(
    docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    return cut_lines(docs, keep_bitmaps(docs, min_docs, id_col, text_col), id_col, text_col)
