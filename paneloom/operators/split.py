"""Exact repeatable splits and samples without sorting or moving the rows.

Rows are ordered by a hash of their identity and a seed. A part of exact size is
"the first so many rows of each class in that order", and that is the same as
"rows up to a cut". Only the cuts are computed:

1. count rows per (class, hash bucket): a pre-aggregated count over two columns;
2. per class find the bucket where the wanted number is reached;
3. order the rows of that one bucket and read off the cut.

The table itself is then split by a comparison with a broadcast of one row per
class. The wide rows are never shuffled, and no task sees a whole class.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneloom.functions import hash_rank_key
from paneloom.session import saved

# Four hex digits: 65,536 buckets per class.
BUCKET_DIGITS = 4
# A target with more values than this has no classes to keep in proportion; the
# check bounds what is broadcast.
MAX_CLASSES = 1000
IN_PART = "_in_part"


def _class_column(class_col: str | None) -> Column:
    return F.lit(0) if class_col is None else F.col(class_col)


def _rank_place(id_cols: Sequence[str], seed: int) -> Column:
    return F.struct(
        hash_rank_key(id_cols, seed).alias("h"), *(F.col(c) for c in id_cols)
    )


def class_cuts(
    df: DataFrame,
    id_cols: Sequence[str],
    class_col: str | None,
    wanted: Callable[[DataFrame], DataFrame],
    seed: int,
    sent: Callable[[DataFrame], DataFrame] = F.broadcast,
) -> DataFrame:
    """Per class the last place that belongs to the part, or null when all rows do.

    ``wanted`` turns the table (_class, _n) into (_class, _n, _want).
    Classes that give no row to the part do not appear.
    """
    narrow = df.select(
        _class_column(class_col).alias("_class"), _rank_place(id_cols, seed).alias("_place")
    ).withColumn("_bucket", F.substring("_place.h", 1, BUCKET_DIGITS))

    buckets = narrow.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_b"))
    quotas = wanted(buckets.groupBy("_class").agg(F.sum("_b").alias("_n")))
    quotas = quotas.where(F.col("_want") > 0).withColumnRenamed("_class", "_quota_class")

    upto = Window.partitionBy("_class").orderBy("_bucket")
    running = buckets.withColumn(
        "_before", F.sum("_b").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    ).fillna(0, ["_before"])
    reached = running.join(
        sent(quotas), F.col("_class").eqNullSafe(F.col("_quota_class"))
    ).where((F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_b") >= F.col("_want")))
    border = reached.select(
        "_quota_class",
        F.col("_bucket").alias("_border"),
        (F.col("_want") - F.col("_before")).cast("long").alias("_rest"),
    )

    in_border = narrow.join(
        sent(border),
        F.col("_class").eqNullSafe(F.col("_quota_class")) & (F.col("_bucket") == F.col("_border")),
    )
    ranked = in_border.withColumn(
        "_r", F.row_number().over(Window.partitionBy("_class").orderBy("_place"))
    ).withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("_class", "_place")))
    # A cut between two rows with one identity would not be a cut.
    unique = F.when(
        F.col("_same") > 1, F.raise_error(F.lit(f"{list(id_cols)} do not identify a row"))
    ).otherwise(F.lit(True))
    return (
        ranked.where((F.col("_r") == F.col("_rest")) & unique)
        .select("_quota_class", F.col("_place").alias("_cut"))
    )


def mark_part(
    df: DataFrame,
    id_cols: Sequence[str],
    class_col: str | None,
    wanted: Callable[[DataFrame], DataFrame],
    seed: int,
) -> DataFrame:
    """The table with a flag for the rows of the part. ``id_cols`` must identify a row."""
    few = (
        class_col is None
        or df.select(class_col).distinct().limit(MAX_CLASSES + 1).count() <= MAX_CLASSES
    )
    sent = F.broadcast if few else lambda table: table
    # One row per class, computed once for all that read a part of the table.
    cuts = saved(class_cuts(df, id_cols, class_col, wanted, seed, sent))
    placed = df.join(
        sent(cuts), _class_column(class_col).eqNullSafe(F.col("_quota_class")), "left"
    )
    within = _rank_place(id_cols, seed) <= F.col("_cut")
    return placed.withColumn(IN_PART, F.coalesce(within, F.lit(False))).drop("_quota_class", "_cut")


# --- sizes of the part -------------------------------------------------------


def share_of_each_class(share: float):
    """Rows whose rank (from 0) is below ``share`` times the class size."""
    return lambda sizes: sizes.withColumn(
        "_want", F.ceil(F.col("_n").cast("double") * F.lit(float(share))).cast("long")
    )


def largest_remainder(share: float):
    """ceil(share * all rows) in total, shared out by largest remainder; equal
    remainders favour the smaller class value."""

    def wanted(sizes: DataFrame) -> DataFrame:
        # One row per class, so these windows are over a handful of rows.
        whole = Window.partitionBy(F.lit(0))
        total = F.sum("_n").over(whole)
        part = F.ceil(total.cast("double") * F.lit(float(share)))
        # Whole numbers of 38 places: products of sizes leave 64 bits, and remainders
        # must be exact for ties.
        product = part.cast("decimal(19,0)") * F.col("_n").cast("decimal(19,0)")
        over = product % total.cast("decimal(19,0)")
        return (
            sizes.withColumn("_part", part)
            .withColumn("_over", over)
            .withColumn("_low", ((product - over) / total.cast("decimal(19,0)")).cast("long"))
            .withColumn("_left", F.col("_part") - F.sum("_low").over(whole))
            .withColumn(
                "_turn",
                F.row_number().over(whole.orderBy(F.desc("_over"), F.col("_class"))),
            )
            .select(
                "_class",
                "_n",
                (F.col("_low") + (F.col("_turn") <= F.col("_left")).cast("int"))
                .cast("long")
                .alias("_want"),
            )
        )

    return wanted


def at_most(rows: int):
    """Up to so many rows of each class."""
    return lambda sizes: sizes.withColumn("_want", F.least(F.col("_n"), F.lit(rows).cast("long")))


# --- the operators -----------------------------------------------------------


def stratified_split(
    df: DataFrame,
    id_cols: Sequence[str],
    target: str,
    valid_share: float = 0.2,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(train, valid); valid takes ceil(valid_share * n) rows of every class."""
    marked = mark_part(df, id_cols, target, share_of_each_class(valid_share), seed)
    return _parts(marked)


def sized_split(
    df: DataFrame,
    id_cols: Sequence[str],
    target: str | None,
    valid_share: float = 0.2,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(train, valid); valid takes ceil(valid_share * N) rows in all, shared over the
    classes by largest remainder, or over no classes when ``target`` is None."""
    marked = mark_part(df, id_cols, target, largest_remainder(valid_share), seed)
    return _parts(marked)


def _parts(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        marked.where(~F.col(IN_PART)).drop(IN_PART),
        marked.where(F.col(IN_PART)).drop(IN_PART),
    )


def sample_rows(df: DataFrame, id_cols: Sequence[str], rows: int, seed: int = 42) -> DataFrame:
    """Exactly ``rows`` rows (all, if there are fewer), without replacement."""
    return _parts(mark_part(df, id_cols, None, at_most(rows), seed))[1]


def sample_per_class(
    df: DataFrame, id_cols: Sequence[str], target: str, rows: int, seed: int = 42
) -> DataFrame:
    """At most ``rows`` rows of every class."""
    return _parts(mark_part(df, id_cols, target, at_most(rows), seed))[1]
