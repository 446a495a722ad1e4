"""Contiguous shards of nearly equal bytes, cut from global prefix sums.

Rows are range-partitioned by id and sorted. Each partition's total is known after one
aggregate; the totals before a partition are its offset, so every task numbers its own
rows and bytes without seeing another's. A row belongs to the shard whose equal share of
all bytes holds the row's middle byte, so shards differ by at most one row's size at
either cut.

Defined cases. A null text has no bytes (size 1); a null id sorts first. Repeated ids and
repeated rows are ordered by size, checksum and place in the input, so a hot id is spread
over as many partitions as its rows need. An empty table gives no rows. With fewer rows
than shards some shards stay empty. Input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paneloom.llm.common import shuffle_tasks, without
from paneloom.session import shared_folder

OUTPUTS = ("size", "text_crc32", "shard", "slot")


def assign_shards(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Id, carried columns, size, text_crc32, shard (0 to shards - 1) and slot (0 upwards
    in each shard, in id order)."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    spark = docs.sparkSession
    shared_folder(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = without(dict.fromkeys([id_col, *carry]), OUTPUTS)
    rows = docs.select(
        F.struct(*kept).alias("row"),
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["id", "size", "text_crc32", "place"]
    ranged = (
        rows.repartitionByRange(shuffle_tasks(spark), *order)
        .sortWithinPartitions(*order)
        .select("row", "size", "text_crc32", F.spark_partition_id().alias("part"))
        .checkpoint()
    )
    numbered = _numbered(ranged, shards)
    firsts = numbered.groupBy("shard").agg(F.min("n").alias("first"))  # one row per shard
    return numbered.join(F.broadcast(firsts), "shard").select(
        "row.*", "size", "text_crc32", "shard", (F.col("n") - F.col("first")).alias("slot")
    )


def _numbered(ranged: DataFrame, shards: int) -> DataFrame:
    """Each row with its number `n` over all rows and its shard."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = (  # one row per partition
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(everything).alias("all_bytes"),
        )
    )
    with_offsets = ranged.join(F.broadcast(offsets), "part")
    fields = [f for f in ranged.schema.fields if f.name != "part"]
    schema = T.StructType(
        [*fields, T.StructField("n", T.LongType()), T.StructField("shard", T.IntegerType())]
    )
    names = [f.name for f in fields]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            part = batch.column("part").to_numpy()
            size = batch.column("size").to_numpy()
            n, shard = np.empty(len(size), np.int64), np.empty(len(size), np.int32)
            for p in np.unique(part):  # one partition in practice
                at = np.flatnonzero(part == p)
                done = seen.get(p) or (
                    batch.column("bytes_before")[int(at[0])].as_py(),
                    batch.column("rows_before")[int(at[0])].as_py(),
                )
                total = batch.column("all_bytes")[int(at[0])].as_py()
                ends = done[0] + np.cumsum(size[at])
                middle = 2 * ends - size[at]  # twice the place of the middle
                shard[at] = (middle * shards) // (2 * total)
                n[at] = done[1] + np.arange(len(at))
                seen[p] = (int(ends[-1]), done[1] + len(at))
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n), pa.array(shard)], [*names, "n", "shard"]
            )

    return with_offsets.mapInArrow(number, schema)


def write_shards(
    docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """The documents as Parquet, a folder per shard, each sorted by slot within its files."""
    placed = assign_shards(docs, shards, id_col, text_col, carry=docs.columns)
    placed.write.partitionBy("shard").parquet(path)
