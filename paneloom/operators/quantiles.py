"""Exact interpolated quantiles and what is built on them.

Spark's own exact percentile holds all distinct values of a column in one task.
Here estimates narrow every wanted place down to a bracket of few values, whose rows
below and inside are counted exactly; only the values inside are grouped and ordered.
The estimates steer how many values that are, not the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneloom.spec import column_groups, numeric_columns, union_all

ACCURACY = 10_000
# Brackets with more rows than this are narrowed, as long as that makes them smaller.
MOST_ORDERED = 100_000
# Brackets (columns times shares) of one aggregate.
BRACKETS_PER_PASS = 400


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    shares: list[float],
    accuracy: int = ACCURACY,
    most_ordered: int = MOST_ORDERED,
) -> DataFrame:
    """(feature, share, value): the interpolated quantile of the known values, null
    for a column without any."""
    width = max(1, BRACKETS_PER_PASS // max(1, len(shares)))
    return union_all(
        [
            _exact_quantiles(df, group, shares, accuracy, most_ordered)
            for group in column_groups(columns, width)
        ]
    )


@dataclass(frozen=True)
class _Bracket:
    """Values from ``low`` to ``high`` (None: no border) that hold the wanted places."""

    column: str
    share: float
    n: int
    low: float | None
    high: float | None
    below: int
    inside: int

    @property
    def place(self) -> float:
        return self.share * (self.n - 1)

    @property
    def places(self) -> tuple[int, int]:
        """The places that are interpolated, from 0."""
        first = math.floor(self.place)
        return first, min(first + 1, self.n - 1)

    def holds(self) -> bool:
        first, second = self.places
        return self.below <= first and second < self.below + self.inside

    def wanted(self, slack: float) -> tuple[float, float]:
        """Shares of the rows inside between which the places surely are, if an
        estimate is off by less than the slack."""
        first, second = self.places
        return (
            max(0.0, (first - self.below) / self.inside - slack),
            min(1.0, (second + 1 - self.below) / self.inside + slack),
        )

    def under(self) -> Column:
        return F.lit(False) if self.low is None else F.col(self.column) < self.low

    def within(self) -> Column:
        known = F.col(self.column).isNotNull()
        if self.low is not None:
            known = known & (F.col(self.column) >= self.low)
        if self.high is not None:
            known = known & (F.col(self.column) <= self.high)
        return known


def _narrowed(
    doubles: DataFrame, brackets: list[_Bracket], accuracy: int, slack: float
) -> list[_Bracket]:
    """Every bracket with closer borders, or as it was where the estimate missed."""
    ends: dict[tuple, list[float]] = {}  # brackets with the same rows share a sketch
    for b in brackets:
        ends.setdefault((b.column, b.low, b.high), []).extend(b.wanted(slack))
    sketches = []
    for i, (rows, shares) in enumerate(ends.items()):
        one = next(b for b in brackets if (b.column, b.low, b.high) == rows)
        value = F.when(one.within(), F.col(one.column))
        sketches.append(F.percentile_approx(value, shares, accuracy).alias(f"q{i}"))
    found = doubles.agg(*sketches).first()
    estimated = {rows: iter(found[f"q{i}"]) for i, rows in enumerate(ends)}

    closer = []
    for b in brackets:
        low_share, high_share = b.wanted(slack)
        low, high = (next(estimated[b.column, b.low, b.high]) for _ in range(2))
        closer.append(
            replace(
                b,
                low=b.low if low_share == 0.0 else low,
                high=b.high if high_share == 1.0 else high,
            )
        )
    counts = doubles.agg(
        *(F.count(F.when(b.under(), 1)).alias(f"b{i}") for i, b in enumerate(closer)),
        *(F.count(F.when(b.within(), 1)).alias(f"i{i}") for i, b in enumerate(closer)),
    ).first()
    tried = [
        replace(b, below=counts[f"b{i}"], inside=counts[f"i{i}"]) for i, b in enumerate(closer)
    ]
    return [new if new.holds() else old for old, new in zip(brackets, tried)]


def _brackets(
    doubles: DataFrame, columns: list[str], shares: list[float], accuracy: int, most_ordered: int
) -> list[_Bracket]:
    """Brackets of at most ``most_ordered`` rows, or of values that estimates can't tell
    apart. Those hold few different values, each with many rows."""
    sizes = doubles.agg(*(F.count(c).alias(c) for c in columns)).first()
    done = [
        _Bracket(c, float(p), sizes[c], None, None, 0, sizes[c]) for c in columns for p in shares
    ]
    slack, open_at = 2 / accuracy, [i for i, b in enumerate(done) if b.inside > most_ordered]
    while open_at and slack < 0.5:
        before = [done[i] for i in open_at]
        after = _narrowed(doubles, before, accuracy, slack)
        for i, b in zip(open_at, after):
            done[i] = b
        missed = [i for i, old, new in zip(open_at, before, after) if new is old]
        shrunk = [
            i
            for i, old, new in zip(open_at, before, after)
            if most_ordered < new.inside <= old.inside / 2 and new.low != new.high
        ]
        if missed:
            slack *= 8
        open_at = sorted(missed + shrunk)
    return done


def _exact_quantiles(
    df: DataFrame, columns: list[str], shares: list[float], accuracy: int, most_ordered: int
) -> DataFrame:
    doubles = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    brackets = _brackets(doubles, columns, shares, accuracy, most_ordered)
    entries = [
        F.struct(F.lit(i).alias("i"), F.when(b.within(), F.col(b.column)).alias("v"))
        for i, b in enumerate(brackets)
    ]
    # Only values inside a bracket become rows.
    counted = (
        doubles.select(F.inline(F.filter(F.array(*entries), lambda e: e["v"].isNotNull())))
        .groupBy("i", "v")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    table = df.sparkSession.createDataFrame(
        [
            (i, b.column, b.share, b.below, *b.places, b.place - b.places[0])
            for i, b in enumerate(brackets)
        ],
        "i int, feature string, share double, below long, first long, second long, rest double",
    )
    placed = counted.join(F.broadcast(table.select("i", "below", "first", "second", "rest")), "i")
    upto = F.sum("k").over(Window.partitionBy("i").orderBy("v")) + F.col("below")

    def at(where: str) -> Column:
        inside = (F.col("upto") - F.col("k") <= F.col(where)) & (F.col(where) < F.col("upto"))
        return F.max(F.when(inside, F.col("v")))

    found = (
        placed.withColumn("upto", upto)
        .groupBy("i")
        .agg(at("first").alias("a"), at("second").alias("b"), F.first("rest").alias("rest"))
        .select("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("rest")).alias("value"))
    )
    return table.join(F.broadcast(found), "i", "left").select("feature", "share", "value")


def medians(df: DataFrame, columns: list[str] | None = None) -> dict[str, float | None]:
    """Exact medians by column name: one number per column."""
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return {}
    found = {}
    for group in column_groups(columns):
        for row in exact_quantiles(df, group, [0.5]).collect():
            found[row["feature"]] = row["value"]
    return found


def fill_with_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing numbers become the median of their column; empty columns stay empty."""
    known = {c: v for c, v in medians(df, columns).items() if v is not None}
    return df.select(
        *(
            F.coalesce(F.col(c).cast("double"), F.lit(known[c])).alias(c) if c in known else F.col(c)
            for c in df.columns
        )
    )


def keep_from_percentile(scores: DataFrame, score: str, share: float) -> DataFrame:
    """Features whose score reaches the given percentile of all scores.

    Score tables have one row per feature, so the window is small.
    """
    whole = Window.partitionBy(F.lit(0))
    return (
        scores.withColumn("_threshold", F.percentile(score, F.lit(share)).over(whole))
        .where(F.col(score) >= F.col("_threshold"))
        .drop("_threshold")
    )
