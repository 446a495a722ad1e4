"""Mutual information with a class target from nearest neighbours.

A row's distance to its k-th neighbour of the same class is set against how many rows of any
class lie closer than that: where classes live apart, few do. Both are found on sorted
values: the k-th neighbour is within k places, so a task needs its rows and k on either side,
and how many values lie in an interval is the difference of two places in the whole order,
which follow from the sizes of the range partitions before. Equal values are counted once
first, so a value with a third of all rows is one row per class.

Defined cases. A row without a value (null or NaN) or without a target takes no part in that
feature. Classes with one row are left out; a class with fewer than k others has all of them as
neighbours. Rows whose k-th neighbour has the same value count the rows of that value. A
feature without rows has no information. Scores are in nats, and never below zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from paneloom.session import saved
from paneloom.spec import column_groups, union_all

NEIGHBOURS = 3


def digamma(n: Column) -> Column:
    """Of whole numbers from 1: the asymptotic series, eight places further on."""
    z = n.cast("double") + 8
    s = 1 / (z * z)
    series = F.log(z) - 0.5 / z - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))
    for j in range(8):
        series = series - 1 / (n.cast("double") + j)
    return series


def _ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` in range partitions, whose number is `part`, written."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(
        df.repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id())
    )


ORDER = ["feature", "y", "x"]


def _with_halo(points: DataFrame, k: int) -> DataFrame:
    """The rows of each part and, marked, the k rows before its first and behind its last.
    The driver reads 2k rows a part."""
    for_part = Window.partitionBy("part")
    first = F.row_number().over(for_part.orderBy(*ORDER))
    last = F.row_number().over(for_part.orderBy(*(F.desc(c) for c in ORDER)))
    ends = points.select("*", first.alias("_first"), last.alias("_last"))
    rows = ends.where((F.col("_first") <= k) | (F.col("_last") <= k)).collect()
    parts: dict[int, list] = {}
    for r in rows:
        parts.setdefault(r["part"], []).append(r)
    numbers = sorted(parts)
    halo = []
    for i, part in enumerate(numbers):
        for side, key in ((numbers[:i][::-1], "_last"), (numbers[i + 1 :], "_first")):
            lacking = k
            for other in side:
                near = sorted((r for r in parts[other] if r[key] <= lacking), key=lambda r: r[key])
                halo += [(*(r[c] for c in points.columns[:-1]), part) for r in near]
                lacking -= len(near)
                if lacking <= 0:
                    break
    spark = points.sparkSession
    beside = spark.createDataFrame(halo, points.schema).withColumn("halo", F.lit(True))
    return points.withColumn("halo", F.lit(False)).union(beside)


def _intervals(k: int):
    """Adds the open interval up to the k-th neighbour of the same class."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ORDER, kind="stable", ignore_index=True)
        x, n = rows["x"].to_numpy(float), rows["n"].to_numpy()
        group = rows.groupby(["feature", "y"], sort=False).ngroup().to_numpy()
        size = len(rows)
        away = np.full((2 * k + 1, size), np.inf)
        many = np.zeros((2 * k + 1, size), np.int64)
        place = np.full((2 * k + 1, size), 0)
        away[0], many[0], place[0] = 0.0, n - 1, np.arange(size)
        for j in range(1, min(k, size - 1) + 1):
            same = group[j:] == group[:-j]
            gap = np.where(same, x[j:] - x[:-j], np.inf)
            # the neighbour to the left of rows j.., to the right of rows ..-j
            away[2 * j - 1, j:], many[2 * j - 1, j:] = gap, np.where(same, n[:-j], 0)
            away[2 * j, :-j], many[2 * j, :-j] = gap, np.where(same, n[j:], 0)
            place[2 * j - 1, j:], place[2 * j, :-j] = np.arange(size - j), np.arange(j, size)
        order = np.argsort(away, axis=0, kind="stable")
        wanted = np.minimum(k, rows["class_n"].to_numpy() - 1)
        at = (np.cumsum(np.take_along_axis(many, order, 0), axis=0) >= wanted).argmax(axis=0)
        radius = np.take_along_axis(np.take_along_axis(away, order, 0), at[None], 0)[0]
        low, high = x - radius, x + radius
        for row in range(1, 2 * k + 1):  # the value itself, where a neighbour is that far
            exact = (away[row] == radius) & (radius > 0)
            side = low if row % 2 else high
            side[exact] = x[place[row]][exact]
        rows["low"], rows["high"] = low, high
        return rows.loc[~rows["halo"].astype(bool), [*ORDER, "n", "class_n", "low", "high"]]

    return run


def rows_within(near: DataFrame, value: str, low: str, high: str, name: str) -> DataFrame:
    """(feature, y, x, `name`): how many rows of the feature have a `value` inside the open
    interval from `low` to `high`, or equal to them where both are one."""
    # Values and borders in one order: at the same place, what is below it is asked first and
    # what is at it is asked last.
    below, at_it, upto = 0, 1, 2
    none = F.lit(0).cast("long")
    apart = F.col(high) > F.col(low)

    def event(at: Column, kind: Column | int, n: Column, sign: int) -> Column:
        kind = F.lit(kind) if isinstance(kind, int) else kind
        return F.struct(
            at.alias("at"), kind.cast("int").alias("kind"), n.alias("m"), F.lit(sign).alias("sign")
        )

    events = near.select(
        *ORDER,
        F.inline(
            F.array(
                event(F.col(value), at_it, F.col("n"), 0),
                event(F.col(high), F.when(apart, below).otherwise(upto), none, 1),
                event(F.col(low), F.when(apart, upto).otherwise(below), none, -1),
            )
        ),
    )
    ranged = _ordered(events, ["feature", "at", "kind", "y", "x"])
    within = Window.partitionBy("feature", "part").orderBy("at", "kind")
    sizes = ranged.groupBy("feature", "part").agg(F.sum("m").alias("_size"))
    before = Window.partitionBy("feature").orderBy("part")  # one row per part
    offsets = sizes.select(
        F.col("feature").alias("_of"), F.col("part").alias("_part"),
        (F.sum("_size").over(before) - F.col("_size")).alias("_before"),
    )
    return (
        ranged.withColumn("_upto", F.sum("m").over(within))
        .join(offsets, (F.col("feature") == F.col("_of")) & (F.col("part") == F.col("_part")))
        .where("sign <> 0")
        .groupBy(*ORDER)
        .agg(F.sum(F.col("sign") * (F.col("_before") + F.col("_upto"))).alias(name))
    )


def neighbour_information(
    df: DataFrame, columns: list[str], target: str, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """(feature, score) for a target of classes."""
    if neighbours < 1:
        raise ValueError("there must be at least one neighbour")
    found = [_of_group(df, group, target, neighbours) for group in column_groups(list(columns))]
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "_named string")
    scores = union_all(found)
    return names.join(scores, F.col("_named") == F.col("feature"), "left").select(
        F.col("_named").alias("feature"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def _of_group(df: DataFrame, columns: list[str], target: str, k: int) -> DataFrame:
    entries = [
        F.struct(
            F.lit(c).alias("feature"), F.col(target).alias("y"),
            (F.col(c).cast("double") + F.lit(0.0)).alias("x"),
        )
        for c in columns
    ]
    counts = (
        df.select(F.inline(F.array(*entries)))
        .where("x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL")
        .groupBy("feature", "y", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sizes = counts.groupBy("feature", "y").agg(F.sum("n").alias("class_n")).where("class_n > 1")
    points = _ordered(counts.join(sizes, ["feature", "y"]).select(*ORDER, "n", "class_n"), ORDER)
    kind = points.schema["y"].dataType.simpleString()
    near = saved(
        _with_halo(points, k).groupBy("part").applyInPandas(
            _intervals(k),
            f"feature string, y {kind}, x double, n long, class_n long, low double, high double",
        )
    )
    counted = rows_within(near, "x", "low", "high", "inside")
    n = F.col("n").cast("double")
    total = F.sum("n")
    own = digamma(F.least(F.lit(k), F.col("class_n") - 1)) - digamma(F.col("class_n"))
    return (
        near.join(counted, ORDER)
        .groupBy("feature")
        .agg(
            F.greatest(
                digamma(total) + F.sum(n * (own - digamma(F.col("inside")))) / total, F.lit(0.0)
            ).alias("score")
        )
    )
