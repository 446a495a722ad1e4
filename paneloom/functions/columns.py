"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

MISSING = "Missing"


def ieee_divide(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` that yields inf or NaN instead of an error."""
    at_zero = (
        F.when(numerator > 0, F.lit(float("inf")))
        .when(numerator < 0, F.lit(float("-inf")))
        .when(numerator == 0, F.lit(float("nan")))
    )
    return F.when(denominator == 0, at_zero).otherwise(F.try_divide(numerator, denominator))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null, so that null rules apply to both."""
    floating = {
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(
        *(
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c)
            for c in df.columns
        )
    )


def missing_level(column: Column) -> Column:
    """A category as text; a null becomes a level of its own."""
    return F.coalesce(column.cast("string"), F.lit(MISSING))


def hash_rank_key(id_cols: Sequence[str], seed: int) -> Column:
    """Repeatable pseudo-random order of rows: md5 of the row's identity."""
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in id_cols), F.lit(str(seed))))


def slot_in(value: Column, cuts: Column, most: int) -> Column:
    """How many entries of the sorted array ``cuts`` are at or below ``value``.

    A binary search; ``most`` bounds the array length. For arrays that differ
    per row. Where the cuts are the same for all rows use ``operators.slots``.
    """
    steps = [1 << b for b in reversed(range(max(1, most.bit_length())))]
    return F.aggregate(
        F.array(*(F.lit(s) for s in steps)),
        F.lit(0),
        lambda reached, step: F.when(
            (reached + step <= F.size(cuts)) & (F.get(cuts, reached + step - 1) <= value),
            reached + step,
        ).otherwise(reached),
    )
