"""Exact sizes, partition of the input, independence of the partitioning."""

import math

import pytest
from pyspark.sql import functions as F

from paneloom.operators.split import (
    largest_remainder,
    sample_per_class,
    sample_rows,
    sized_split,
    stratified_split,
)


def table(spark, sizes, partitions=3):
    rows, at = [], 0
    for y, n in sizes.items():
        rows += [(at + i, y) for i in range(n)]
        at += n
    return spark.createDataFrame(rows, "id long, y int").repartition(partitions)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def sizes(df):
    return {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}


@pytest.mark.parametrize("classes", [{0: 340, 1: 119}, {0: 1, 1: 1, 2: 7}, {5: 10}, {None: 6, 1: 4}])
def test_valid_takes_the_rounded_up_share_of_each_class(spark, classes):
    df = table(spark, classes)
    train, valid = stratified_split(df, ["id"], "y")
    assert sizes(valid) == {y: math.ceil(0.2 * n) for y, n in classes.items()}
    assert sorted(ids(train) + ids(valid)) == ids(df)


def test_published_sizes():
    """118,828 positives and 340,085 negatives give 91,783 validation rows."""
    want = [math.ceil(0.2 * n) for n in (118_828, 340_085)]
    assert want == [23_766, 68_017] and sum(want) == 91_783


def test_result_does_not_depend_on_the_partitioning(spark):
    classes = {0: 500, 1: 90}
    a = ids(stratified_split(table(spark, classes, 1), ["id"], "y")[1])
    b = ids(stratified_split(table(spark, classes, 7).orderBy(F.desc("id")), ["id"], "y")[1])
    assert a == b
    c = ids(stratified_split(table(spark, classes), ["id"], "y", seed=7)[1])
    assert a != c


@pytest.mark.parametrize(
    "classes, want", [({0: 1378, 1: 122}, {0: 276, 1: 24}), ({0: 3, 1: 3, 2: 3}, {0: 1, 1: 1})]
)
def test_sized_split_shares_by_largest_remainder(spark, classes, want):
    train, valid = sized_split(table(spark, classes), ["id"], "y")
    assert sizes(valid) == want
    assert train.count() + valid.count() == sum(classes.values())


def test_sized_split_without_classes(spark):
    train, valid = sized_split(table(spark, {0: 13, 1: 4}), ["id"], None)
    assert (train.count(), valid.count()) == (13, 4)


def test_samples_have_exact_sizes(spark):
    df = table(spark, {0: 300, 1: 20})
    assert sample_rows(df, ["id"], 37).count() == 37
    assert sample_rows(df, ["id"], 1000).count() == 320
    assert sizes(sample_per_class(df, ["id"], "y", 50)) == {0: 50, 1: 20}


def test_rows_that_cannot_be_told_apart_are_refused(spark):
    df = spark.createDataFrame([(1, 0)] * 10, "id long, y int")
    with pytest.raises(Exception, match="do not identify a row"):
        stratified_split(df, ["id"], "y")[1].collect()


@pytest.mark.parametrize("classes", [900, 1100])
def test_any_number_of_classes(spark, classes):
    """On both sides of the number up to which one row per class is broadcast."""
    df = spark.range(5 * classes).select("id", (F.col("id") % classes).alias("y"))
    train, valid = stratified_split(df, ["id"], "y")
    assert valid.groupBy("y").count().where("count = 1").count() == classes
    assert train.count() == 4 * classes


def test_quotas_of_very_large_classes(spark):
    """Products of sizes leave 64 bits; whole-number arithmetic of Python doesn't."""
    sizes = {0: 10**10, 1: 33 * 10**8, 2: 3 * 10**10, 3: 7}
    total = sum(sizes.values())
    part = -(-total // 5)
    want = {c: part * n // total for c, n in sizes.items()}
    by_remainder = sorted(sizes, key=lambda c: (-(part * sizes[c] % total), c))
    for c in by_remainder[: part - sum(want.values())]:
        want[c] += 1
    table = spark.createDataFrame(list(sizes.items()), "_class int, _n long")
    got = {r["_class"]: r["_want"] for r in largest_remainder(0.2)(table).collect()}
    assert got == want


def test_the_split_does_not_move_the_rows(spark):
    df = table(spark, {0: 50, 1: 50}).withColumn("wide", F.lit("x"))
    valid = stratified_split(df, ["id"], "y")[1]
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    # The only join that sees the wide column is the broadcast of the cuts.
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "rightHint=(strategy=broadcast)" in joins[0]
