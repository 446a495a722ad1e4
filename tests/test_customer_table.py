"""Temporal features and the customer table against plain Python, also when
customers are cut into slices."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

import brute
from paneloom import PanelSpec
from paneloom.operators.aggregate import customer_table, output_columns
from paneloom.operators.slices import FAN, hot_customers
from paneloom.operators.temporal import temporal_table

SPEC = PanelSpec(key="who", order="day", tie=("seq",), categoricals=("kind", "code"))
SCHEMA = "who string, day int, seq long, x double, w long, kind string, code double"
NUMBERS, CATEGORIES = ["x", "w"], ["kind", "code"]


def hand_made():
    """One row, all null, null first / middle / last, tied days, a constant, mean = -1e-5."""
    rows = [("one", 1, 1, 2.5, 7, "a", 1.0)]
    rows += [("empty", d, d, None, None, None, None) for d in range(3)]
    rows += [("holes", d, d, v, v and int(v), k, None) for d, (v, k) in enumerate(
        [(None, "a"), (1.0, None), (None, "b"), (3.0, "b"), (2.0, "c"), (None, None)])]
    rows += [("ties", d, s, float(v), v, k, float(v % 2)) for d, s, v, k in
             [(1, 2, 5, "b"), (1, 1, 4, "a"), (2, 4, 1, "a"), (2, 3, 9, "b")]]
    rows += [("flat", d, d, 4.0, 4, "k", 4.0) for d in range(4)]
    rows += [("zero", 0, 0, -2e-5, 0, "z", 0.0), ("zero", 1, 1, 0.0, 0, "z", 0.0)]
    rows += [(None, 1, 1, 1.0, 1, "n", 1.0), (None, 2, 2, 2.0, 2, "m", None)]
    return rows


def one_large(n=900, seed=5):
    """A customer with most of the rows, small ones around it, all in random order."""
    rng = random.Random(seed)
    rows = []
    for s in range(n):
        who = "big" if rng.random() < 0.7 else f"c{rng.randrange(20)}"
        x = None if rng.random() < 0.2 else round(rng.uniform(-5, 5), 3)
        kind = None if rng.random() < 0.1 else rng.choice("abcdef")
        w = None if rng.random() < 0.1 else rng.randrange(100)
        rows.append((who, rng.randrange(60), s, x, w, kind, float(rng.randrange(3))))
    rng.shuffle(rows)
    return rows


def expected(rows):
    names = ["who", "day", "seq", "x", "w", "kind", "code"]
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(dict(zip(names, r)))
    return {k: brute.customer(v, NUMBERS, CATEGORIES) for k, v in by.items()}


def check(table, rows):
    want = expected(rows)
    got = {r["who"]: r.asDict() for r in table.collect()}
    assert got.keys() == want.keys()
    for who, features in want.items():
        assert got[who].keys() - {"who"} == features.keys()
        for name, value in features.items():
            assert brute.same(got[who][name], value), (who, name, got[who][name], value)


@pytest.mark.parametrize("max_rows", [200_000, 3])
def test_hand_made_rows(spark, max_rows):
    rows = hand_made()
    check(customer_table(spark.createDataFrame(rows, SCHEMA), SPEC, max_rows), rows)


@pytest.mark.parametrize("max_rows", [10, 50, 100, 700])
def test_large_customer_is_cut_into_slices(spark, max_rows):
    rows = one_large()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    hot = hot_customers(df, SPEC, max_rows)
    if max_rows < 600:
        cuts = {r[0]: r[1] for r in hot.table.collect()}
        assert cuts["big"] >= 1
        assert cuts["big"] <= 700 // max_rows
    check(customer_table(df, SPEC, max_rows), rows)


@pytest.mark.parametrize("max_rows", [200_000, 40])
def test_temporal_rows(spark, max_rows):
    rows = one_large(seed=9)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["seq"]: r for r in temporal_table(df, SPEC, max_rows).collect()}
    assert len(got) == len(rows)
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    for history in by.values():
        xs, kinds = [r[3] for r in history], [r[5] for r in history]
        for r, d, c in zip(history, brute.diffs(xs), brute.flags(kinds)):
            assert brute.same(got[r[2]]["x_diff1"], d)
            assert got[r[2]]["kind_changed"] == c


def test_slices_are_near_the_wanted_size(spark):
    df = spark.range(20_000).select(
        F.lit("k").alias("who"), F.lit(1).alias("day"), F.col("id").alias("seq"),
        F.rand(1).alias("x"), F.lit(None).cast("long").alias("w"),
        F.lit("a").alias("kind"), F.lit(1.0).alias("code"),
    )
    hot = hot_customers(df, SPEC, 1000)
    sizes = [r["count"] for r in hot.sliced(df, SPEC).groupBy("_slice").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 3000


@pytest.mark.parametrize("max_rows, levels", [(500, 2), (30, 3)])
def test_every_cut_is_found_from_coarse_to_fine(spark, max_rows, levels):
    """A row's slice is the number of cuts at or before it, whatever the number of levels."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 4 != 0, "k").alias("who"), F.lit(1).alias("day"),
        F.col("id").alias("seq"),
    )
    hot = hot_customers(df, SPEC, max_rows)
    assert FAN ** (levels - 1) <= hot.most_cuts < FAN**levels
    cuts = {}
    for r in hot.cuts.collect():
        cuts.setdefault(r["_cut_key"], []).append(r["_at"]["v1"])
    rows = hot.sliced(df, SPEC).where("NOT _halo").collect()
    assert len(rows) == 20_000
    for key in cuts:
        cuts[key].sort()
    for r in rows:
        assert r["_slice"] == bisect.bisect_right(cuts[r["who"]], r["seq"])


def test_widths(spark):
    """190 columns become 378 and then 3,264; with the target 3,265."""
    numbers = [f"x{i}" for i in range(177)]
    categories = [f"c{i}" for i in range(11)]
    spec = PanelSpec(key="k", order="t", categoricals=tuple(categories))
    schema = "k string, t date, " + ", ".join(f"{c} double" for c in numbers + categories)
    df = spark.createDataFrame([], schema)
    assert len(df.columns) == 190
    assert len(temporal_table(df, spec, None).columns) == 378
    assert len(output_columns(df, spec)) == 3264


def test_one_shuffle_per_group_of_columns(spark):
    df = spark.createDataFrame(hand_made(), SCHEMA)
    numbers = df.drop("w", "kind", "code")
    plan = customer_table(numbers, SPEC, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    # doubles, whole numbers and categories: three exchanges and none for the joins
    plan = customer_table(df, SPEC, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 3


def test_text_without_a_role_is_refused(spark):
    df = spark.createDataFrame([("a", 1, 1, "text")], "who string, day int, seq long, note string")
    with pytest.raises(TypeError, match="note"):
        customer_table(df, SPEC)


def test_null_differences_can_be_left_out(spark):
    df = spark.createDataFrame(hand_made(), SCHEMA)
    names = customer_table(df, SPEC, null_differences=False).columns
    assert "x_total_delta" in names and "x_diff1_total_delta" not in names
