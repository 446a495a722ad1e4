"""Column roles of a panel table: one row per (customer, period)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Default column names of the statement and label tables and the
# columns that hold categories (some of them are stored as numbers, so a column
# is a category by name, not by type).
CUSTOMER = "customer_ID"
PERIOD = "S_2"
TARGET = "target"
CATEGORICALS = (
    "B_30", "B_38", "D_114", "D_116", "D_117", "D_120",
    "D_126", "D_63", "D_64", "D_66", "D_68",
)

# Endings of the look-back columns.
DIFF_SUFFIX = "_diff1"
CHANGED_SUFFIX = "_changed"


@dataclass(frozen=True)
class PanelSpec:
    """Which column plays which role.

    ``tie`` lists further columns that order rows of one customer with the same
    period. Together ``key``, ``order`` and ``tie`` should identify a row: that
    makes every result repeatable and lets a very large customer be cut into
    slices (see ``operators.slices``).
    """

    key: str = CUSTOMER
    order: str = PERIOD
    tie: tuple[str, ...] = ()
    categoricals: tuple[str, ...] = CATEGORICALS
    target: str = TARGET

    @property
    def position(self) -> tuple[str, ...]:
        return (self.order, *self.tie)

    def present_categoricals(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c in self.categoricals]

    def numerics(self, df: DataFrame) -> list[str]:
        """Every column without another role; raises when one is not a number."""
        roles = {self.key, *self.position, *self.categoricals}
        names = [c for c in df.columns if c not in roles]
        wrong = [c for c in names if not isinstance(df.schema[c].dataType, T.NumericType)]
        if wrong:
            raise TypeError(f"not numeric and not listed as categorical: {wrong}")
        return names

    def position_tuple(self) -> Column:
        """The row's place in its customer's history as one comparable struct.

        Nulls come last, as in ``period_order``.
        """
        parts = []
        for i, c in enumerate(self.position):
            parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
        return F.struct(*parts)

    def period_order(self) -> list[Column]:
        return [F.col(c).asc_nulls_last() for c in self.position]


def require_columns(df: DataFrame, names, what: str = "table") -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}; it has {df.columns[:20]}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def feature_name(names: list[str], index: str = "feature") -> Column:
    """The name behind a feature's number. Long tables carry numbers, which shuffle
    and compare faster than names."""
    return F.get(F.array(*(F.lit(c) for c in names)), F.col(index)).alias("feature")


# Wide tables are aggregated in groups of columns: planning one aggregate over
# thousands of expressions takes longer than several passes that read, between them,
# every column once.
COLUMNS_PER_PASS = 200


def column_groups(columns: list[str], size: int = COLUMNS_PER_PASS) -> list[list[str]]:
    return [list(columns[i : i + size]) for i in range(0, len(columns), size)]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
