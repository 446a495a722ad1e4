"""Month-to-month features: differences of numbers, change flags of categories.

All look-back columns of a customer come from one window, that is one shuffle
and one sort however many columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneloom.operators.slices import HALO, LAST_SLICE, MAX_ROWS, SLICE, hot_customers
from paneloom.spec import CHANGED_SUFFIX, DIFF_SUFFIX, PanelSpec, require_columns

# Names of the row, the two rows before it and its place, as structs, after
# ``look_back``. One struct per row means three window functions in all.
ROW, BEFORE, BEFORE2 = "_row", "_before", "_before2"
FIRST, LAST = "_is_first", "_is_last"


def difference(name: str) -> Column:
    """Value minus the previous value; null where either is missing."""
    return F.col(f"{ROW}.`{name}`") - F.col(f"{BEFORE}.`{name}`")


def changed(name: str) -> Column:
    """1 where both values are known and differ, else 0."""
    differs = F.col(f"{ROW}.`{name}`") != F.col(f"{BEFORE}.`{name}`")
    return F.when(differs, 1).otherwise(0)


def look_back(df: DataFrame, spec: PanelSpec, lags: int, hot: bool = False) -> DataFrame:
    """Each row next to its predecessors, with flags for the first and last row."""
    keep = [spec.key, *([SLICE, LAST_SLICE, HALO] if hot else [])]
    held = [c for c in df.columns if c not in (SLICE, LAST_SLICE, HALO)]
    window = Window.partitionBy(spec.key, *([SLICE] if hot else [])).orderBy(
        *(F.col(f"{ROW}.`{c}`").asc_nulls_last() for c in spec.position)
    )
    packed = df.select(*keep, F.struct(*held).alias(ROW))
    looked = packed.select(
        *keep,
        ROW,
        F.lag(ROW, 1).over(window).alias(BEFORE),
        *([F.lag(ROW, 2).over(window).alias(BEFORE2)] if lags > 1 else []),
        F.lead(F.lit(True), 1, False).over(window).alias("_more"),
    )
    last = ~F.col("_more")
    if hot:
        # A slice after the first one starts with halo rows, so only the very
        # first row of the customer has no predecessor.
        looked = looked.where(~F.col(HALO))
        last &= F.col(SLICE) == F.col(LAST_SLICE)
    return (
        looked.withColumn(FIRST, F.col(BEFORE).isNull())
        .withColumn(LAST, last)
        .drop("_more", SLICE, LAST_SLICE, HALO)
    )


def temporal_table(
    statements: DataFrame, spec: PanelSpec, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """All statement columns, then a difference per number and a change flag per
    category."""
    require_columns(statements, [spec.key, *spec.position], "statement table")
    hot = hot_customers(statements, spec, max_rows)
    numerics = spec.numerics(statements)
    categories = spec.present_categoricals(statements)

    def features(looked: DataFrame) -> DataFrame:
        return looked.select(
            f"{ROW}.*",
            *(difference(c).alias(c + DIFF_SUFFIX) for c in numerics),
            *(changed(c).alias(c + CHANGED_SUFFIX) for c in categories),
        )

    if hot is None:
        return features(look_back(statements, spec, lags=1))
    return features(look_back(hot.ordinary(statements, spec), spec, lags=1)).unionByName(
        features(look_back(hot.sliced(statements, spec), spec, lags=1, hot=True))
    )

