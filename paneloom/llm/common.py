"""Helpers that the text operators share."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.session import new_shared_path

# Fixed values of the contracts.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: bytes.translate table: A-Z lower-cased, everything outside words made a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A
    else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z lower-cased, as UTF-8."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_keys(id_col: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that stand for (id, text). Rows equal in both share them, which is
    harmless wherever the result is a function of id and text."""
    return (
        F.xxhash64(id_col, text).alias("k1"),
        F.xxhash64(F.lit(7), text, F.lit(11), id_col).alias("k2"),
    )


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns, so that further columns can't clash with ours."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the folder all executors share, and read again."""
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(columns: Sequence[str], taken: Sequence[str]) -> list[str]:
    lowered = {name.lower() for name in taken}
    return [name for name in columns if name.lower() not in lowered]


def in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """`df` range-partitioned and sorted by `order`, with `part`, the partition, and
    `place`, the row's number in it. Computed anew each time it is read: write it, or use
    it in one pass."""
    ranged = df.repartitionByRange(shuffle_tasks(df.sparkSession), *order)
    return ranged.sortWithinPartitions(*order).select(
        "*",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
    )
