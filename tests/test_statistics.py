"""Statistics against numpy and pandas on small tables."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.operators import selection as sel
from paneloom.operators.correlation import (
    correlation_pairs,
    pearson_target,
    redundant_features,
    roc_auc,
    spearman_target,
    strong_features,
)
from paneloom.operators.information import mutual_information
from paneloom.operators.joint_neighbours import (
    Leaves,
    cell_of,
    cell_tree,
    cells_reached,
    nearest,
    number_information,
    parts_of,
    upper_border,
)
from paneloom.operators.neighbours import neighbour_information
from paneloom.operators.profile import dominant_value, null_share, task_type, value_profile
from paneloom.operators.quantiles import exact_quantiles, fill_with_median, keep_from_percentile


def frame(n=700, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(1e6, 2, n).round(2)
    return pd.DataFrame(
        {
            "id": np.arange(n),
            "a": a,
            "b": np.where(rng.random(n) < 0.3, np.nan, a * 2 + rng.normal(0, 1, n)),
            "ties": rng.integers(0, 4, n).astype(float),
            "heavy": np.where(rng.random(n) < 0.4, 7.0, rng.random(n)),
            "flat": 0.1,
            "empty": np.nan,
            "y": (rng.random(n) + (a > 1e6) * 0.3 > 0.6).astype(int),
            "z": rng.random(n),
        }
    )


NUMBERS = ["a", "b", "ties", "heavy", "flat", "empty"]


@pytest.fixture(scope="module")
def pdf():
    return frame()


@pytest.fixture(scope="module")
def df(spark, pdf):
    from paneloom.functions import nan_to_null

    return nan_to_null(spark.createDataFrame(pdf)).repartition(4).cache()


def scores(table, name="score"):
    return {r["feature"]: r[name] for r in table.collect()}


def close(a, b, tolerance=1e-7):
    if b is None or (isinstance(b, float) and math.isnan(b)):
        return a is None
    return a is not None and abs(a - b) <= tolerance * max(1.0, abs(b))


@pytest.mark.parametrize(
    "accuracy, most_ordered", [(10_000, 1000), (50, 100), (20, 100), (20, 1), (10_000, 0)]
)
def test_quantiles(df, pdf, accuracy, most_ordered):
    shares = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    found = exact_quantiles(df, NUMBERS, shares, accuracy, most_ordered).collect()
    assert len(found) == len(shares) * len(NUMBERS)
    for r in found:
        assert close(r["value"], pdf[r["feature"]].quantile(r["share"]), 1e-12), r


def test_median_fill(df, pdf):
    got = fill_with_median(df, ["b", "empty"]).toPandas().sort_values("id")
    assert np.allclose(got["b"], pdf["b"].fillna(pdf["b"].median()))
    assert got["empty"].isna().all()


def test_pearson(df, pdf):
    got = scores(pearson_target(df, NUMBERS, "y"))
    for c in ["a", "b", "ties", "heavy"]:
        assert close(got[c], pdf[c].corr(pdf["y"])), c
    assert got["flat"] is None and got["empty"] is None


# With few slots, 20 rows a slot are reached by stripes.
@pytest.mark.parametrize("target, slots", [("y", 1000), ("y", 3), ("z", 8), ("z", 1)])
def test_spearman(df, pdf, target, slots):
    got = scores(spearman_target(df, NUMBERS, target, slots, rows_per_slot=20))
    for c in ["a", "b", "ties", "heavy"]:
        known = pdf[[c, target]].dropna().rank()
        assert close(got[c], known[c].corr(known[target])), c
    assert got["flat"] is None and got["empty"] is None


@pytest.mark.parametrize("few_targets", [0, 1000])
def test_spearman_of_odd_values(spark, few_targets):
    rng = np.random.default_rng(5)
    odd = np.array([-0.0, 0.0, np.nan, np.inf, -np.inf, 1e-300, -2.0, 3.5])
    table = pd.DataFrame(
        {
            "x": odd[rng.integers(0, 8, 500)],
            "w": odd[rng.integers(0, 8, 500)],
            "y": odd[rng.integers(0, 8, 500)],
        }
    )
    rows = [
        tuple(None if rng.random() < 0.2 else float(v) for v in row)
        for row in table.itertuples(index=False)
    ]
    df = spark.createDataFrame(rows, "x double, w double, y double").repartition(5)
    got = scores(spearman_target(df, ["x", "w"], "y", 4, 20, few_targets))
    for i, c in enumerate(["x", "w"]):
        known = pd.DataFrame([(r[i], r[2]) for r in rows if r[i] is not None and r[2] is not None])
        # NaN is the greatest value: a rank above infinity.
        ranks = known.replace([np.inf, np.nan], [1e301, 1e302]).rank()
        assert close(got[c], ranks[0].corr(ranks[1])), c
    none = spark.createDataFrame([], "x double, y double")
    assert scores(spearman_target(none, ["x"], "y", few_targets=few_targets)) == {"x": None}
    blank = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    assert scores(spearman_target(blank, ["x"], "y", few_targets=few_targets)) == {"x": None}


@pytest.mark.parametrize("block, at_once", [(256, 10_000), (256, 4), (4, 5), (1, 10_000)])
def test_pairs(df, pdf, block, at_once, monkeypatch):
    monkeypatch.setattr("paneloom.operators.correlation.ROWS_AT_ONCE", at_once)
    monkeypatch.setattr("paneloom.operators.correlation.PAIRS_AT_ONCE", at_once)
    want = pdf[NUMBERS].corr()
    got = correlation_pairs(df, NUMBERS, block).collect()
    assert len(got) == len(NUMBERS) * (len(NUMBERS) - 1) // 2
    assert {(r["feature_a"], r["feature_b"]) for r in got} == set(itertools.combinations(NUMBERS, 2))
    for r in got:
        expected = want.loc[r["feature_a"], r["feature_b"]]
        if "flat" in (r["feature_a"], r["feature_b"]):
            expected = math.nan
        assert close(r["r"], expected), r


@pytest.mark.parametrize("slots", [1000, 4, 1])
def test_auc(df, pdf, slots):
    for c in ["ties", "b"]:
        known = pdf[[c, "y"]].dropna()
        up, down = known[known.y == 1][c].to_numpy(), known[known.y == 0][c].to_numpy()
        wins = (up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()
        assert close(roc_auc(df, c, "y", slots, rows_per_slot=20).first()["auc"], wins / (len(up) * len(down)))


def test_auc_of_one_class_is_null(df):
    assert roc_auc(df.where("y = 1"), "a", "y").first()["auc"] is None


@pytest.mark.parametrize("target, is_class", [("y", True), ("z", False)])
def test_mutual_information(df, pdf, target, is_class):
    def bins(c):
        cuts = sorted(set(pdf[c].quantile([i / 10 for i in range(1, 10)])))
        return np.searchsorted(cuts, pdf[c], side="right")

    y = pdf[target] if is_class else bins(target)
    got = scores(mutual_information(df, ["a", "ties", "heavy", "flat", "empty"], target, 10, is_class))
    for c in ["a", "ties", "heavy", "flat"]:
        p = pd.crosstab(bins(c), y).to_numpy() / len(pdf)
        px, py = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            want = np.nansum(p * np.log(p / (px * py)))
        assert close(got[c], float(want)), c
    assert got["empty"] == 0


def test_profiles(df, pdf):
    for r in value_profile(df, NUMBERS).collect():
        s = pdf[r["feature"]]
        top = s.value_counts().iloc[0] / len(s) if s.notna().any() else None
        assert (r["n_unique"], r["n_null"]) == (s.nunique(), s.isna().sum())
        assert close(r["mode_share"], top)
    got = {r["feature"]: r for r in dominant_value(df, NUMBERS).collect()}
    assert got["flat"]["n_top"] == len(pdf) and got["empty"]["n_top"] == 0
    shares = scores(null_share(df, NUMBERS), "null_share")
    assert close(shares["b"], pdf["b"].isna().mean())


def test_task_type(df):
    of = lambda c: task_type(df, c).first()["task"]
    assert (of("y"), of("ties"), of("z")) == ("binary", "multiclass", "regression")


def test_removal_report(spark):
    n = 400
    rng = random.Random(1)
    rows = [
        (i, float(i) + 0.5, "k", 1.0 if i else 2.0, rng.random() if i < 20 else None, None,
         rng.randrange(5), None if i == 0 else float(i))
        for i in range(n)
    ]
    df = spark.createDataFrame(
        rows, "id long, frac double, one string, nearly double, holes double, nothing double, "
        "fine int, almost_id double"
    )
    names = [c for c in df.columns]
    got = [tuple(r) for r in sel.report_rows(sel.removal_report(df, names)).collect()]
    assert got == [
        ("id", sel.REASON_ID),
        ("frac", sel.REASON_ID),
        ("one", sel.REASON_CONSTANT),
        ("nearly", sel.REASON_QUASI_CONSTANT),
        ("holes", "Missing 95%"),
        ("nothing", "Missing 100%"),
    ]
    whole = sel.removal_report(df, names, ids_are_whole_or_text=True)
    assert "frac" not in {r["feature"] for r in whole.collect()}


def test_static_filter_keeps_order_and_fixed_columns(spark):
    n = 2000
    df = spark.range(n).select(
        F.lit(None).cast("double").alias("nothing"),
        F.when(F.col("id") > 0, 1.0).alias("one_missing"),
        F.when(F.col("id") > 2, 1.0).otherwise(0.0).alias("two_differ"),
        "id",
        F.lit(0).alias("target"),
    )
    kept = sel.static_filter(df, ["id", "target"]).orderBy("position").collect()
    # 3 of 2000 rows differ in the last column: 0.15 % is enough to stay
    assert [r["feature"] for r in kept] == ["id", "target", "two_differ"]


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "feature_a string, feature_b string, r double")


def test_redundancy_keeps_the_better_correlated(spark):
    names = spark.createDataFrame(
        [("A", 0.35), ("B", -0.32), ("C", 0.1), ("D", None)], "feature string, score double"
    )
    pairs = pairs_of(spark, [("A", "B", 0.97), ("B", "C", -0.96), ("C", "D", 0.99), ("A", "C", 0.95)])
    # B loses to A, and C still loses to B although B is dropped; D has no score
    assert {r[0] for r in redundant_features(pairs, names).collect()} == {"B", "C", "D"}
    tie = names.where("feature = 'A'").union(names.where("feature = 'A'").select(F.lit("B"), "score"))
    assert [r[0] for r in redundant_features(pairs.limit(1), tie).collect()] == ["B"]
    assert {r[0] for r in strong_features(pairs, 0.97).collect()} == {"A", "B", "C", "D"}


def test_drift(spark):
    old = sel.feature_table(spark, [f"f{i}" for i in range(20)])
    new = sel.feature_table(spark, [f"f{i}" for i in range(1, 20)] + ["g"])
    changes = sel.drift(old, new)
    summary = sel.drift_summary(changes).first()
    # one of twenty removed: exactly 5 % is tolerated
    assert (summary["added"], summary["removed"], summary["stable"], summary["use"]) == (1, 1, 19, "new")
    assert summary["stability_pct"] == 95.0
    newer = sel.feature_table(spark, [f"f{i}" for i in range(2, 20)])
    assert sel.drift_summary(sel.drift(old, newer)).first()["use"] == "old"
    assert sel.chosen_after_drift(old, newer).count() == 20
    assert {r[0] for r in sel.chosen_after_drift(old, new).collect()} >= {"g", "f1"}


def test_score_tables(spark):
    table = spark.createDataFrame(
        [("a", 4.0), ("b", 1.0), ("c", 1.0), ("d", 0.0)], "feature string, score double"
    )
    assert [r[0] for r in sel.top_scores(table, 2).collect()] == ["a", "b"]
    assert {r[0] for r in keep_from_percentile(table, "score", 0.25).collect()} == {"a", "b", "c"}
    shares = {r["feature"]: r["normalised"] for r in sel.normalised(table).collect()}
    assert shares["a"] == 4 / 6
    counts, edges = np.histogram([4.0, 1.0, 1.0, 0.0], 4)
    bins = sel.score_histogram(table, 4).orderBy("bin").collect()
    assert [r["n"] for r in bins] == list(counts)
    assert np.allclose([r["low"] for r in bins], edges[:-1])
    same = table.withColumn("score", F.lit(2.0))
    assert sum(r["n"] for r in sel.score_histogram(same, 5).collect()) == 4


def test_funnel(spark):
    table = lambda n: sel.feature_table(spark, [f"f{i}" for i in range(n)])
    got = sel.funnel([("a", table(190)), ("b", table(165)), ("c", table(88))]).collect()
    assert [r["n_features"] for r in got] == [190, 165, 88]
    assert round(got[-1]["reduction_pct"], 1) == 53.7


def test_class_weights_and_codes(spark):
    df = spark.createDataFrame([(0, "b"), (0, "a"), (0, None), (1, "b")], "y int, k string")
    assert {r["y"]: r["weight"] for r in sel.class_weights(df, "y").collect()} == {0: 1.0, 1: 3.0}
    codes = {r["level"]: r["code"] for r in sel.category_codes(df, "k").collect()}
    assert codes == {"None": 0, "a": 1, "b": 2}
    coded = sel.with_category_code(df, "k", "c")
    assert sorted((r["y"], r["k"] or "", r["c"]) for r in coded.collect()) == [
        (0, "", 0), (0, "a", 1), (0, "b", 2), (1, "b", 2)
    ]


def test_codes_of_many_levels_are_gapless_and_sorted(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 != 0, F.md5(F.col("id").cast("string"))).alias("k")
    ).union(spark.createDataFrame([("\u00e9",), ("\U0001f600",), ("",), ("None",)], "k string"))
    rows = sel.category_codes(df, "k").collect()
    want = sorted({r["k"] if r["k"] is not None else "None" for r in df.collect()})
    assert [r["level"] for r in sorted(rows, key=lambda r: r["code"])] == want
    assert sorted(r["code"] for r in rows) == list(range(len(want)))
    assert sel.category_codes(df.limit(0), "k").count() == 0


def test_shares_below_the_median_rule_are_counted_exactly(spark):
    """The most frequent value has 40 % of the rows and isn't the median."""
    df = spark.range(100).select(
        F.when(F.col("id") < 40, 0.0).otherwise(F.col("id").cast("double")).alias("x"),
        (F.col("id") % 10).alias("z"),
    )
    kept = sel.static_filter(df, [], stable_share=0.35).collect()
    assert [r["feature"] for r in kept] == ["z"]
    report = sel.removal_report(df, ["x", "z"], quasi_constant_share=0.35).collect()
    assert [r["feature"] for r in report] == ["x"]


def test_a_rare_repetition_is_no_id(spark):
    df = spark.range(5000).select(
        "id",
        F.when(F.col("id") == 1, 0).otherwise(F.col("id")).alias("once"),
        F.floor(F.col("id") * 0.9).alias("often"),
    )
    report = sel.removal_report(df, df.columns).collect()
    assert [(r["feature"], r["reason"]) for r in report] == [("id", sel.REASON_ID)]
    assert sel.repeating_columns(df, ["id"]) == set()
    assert sel.repeating_columns(df, df.columns) == {"once", "often"}
    assert sel.repeating_columns(df, df.columns, 50) <= {"once", "often"}


def test_repetitions_of_every_type(spark, monkeypatch):
    df = spark.range(300).select(
        F.when(F.col("id") > 1, F.col("id")).alias("nulls"),
        F.when(F.col("id") < 2, float("nan")).otherwise(F.col("id")).alias("nan"),
        F.when(F.col("id") == 1, -0.0).otherwise(F.col("id")).cast("double").alias("zeros"),
        (F.col("id") / 7).cast("float").alias("float"),
        F.md5((F.col("id") % 299).cast("string")).alias("text"),
        F.col("id").cast("string").alias("own text"),
        F.col("id").cast("decimal(20, 4)").alias("decimal"),
        F.timestamp_seconds(F.floor(F.col("id") / 2)).alias("time"),
    )
    want = {"nan", "zeros", "text", "time"}
    assert sel.repeating_columns(df, df.columns) == want
    assert sel.repeating_columns(df.limit(0), df.columns) == set()
    assert sel.repeating_columns(df, []) == set()
    # Hashes that collide all the time decide nothing.
    monkeypatch.setattr(
        sel, "_hash", lambda df, c, i: F.when(F.col(c).isNotNull(), F.lit(0).cast("long"))
    )
    assert sel.repeating_columns(df, df.columns) == want


def neighbour_score(pairs, k=3):
    """Nearest-neighbour information by comparing all pairs."""
    def psi(n):
        return -0.57721566490153286 + sum(1 / j for j in range(1, n))

    sizes = {y: sum(v == y for _, v in pairs) for _, y in pairs}
    rows = [(x, y) for x, y in pairs if sizes[y] > 1]
    if not rows:
        return 0.0
    total = 0.0
    for i, (x, y) in enumerate(rows):
        own = sorted(abs(x - v) for j, (v, c) in enumerate(rows) if c == y and j != i)
        near = min(k, sizes[y] - 1)
        away = own[near - 1]
        inside = sum(abs(x - v) < away if away else v == x for v, _ in rows)
        total += psi(near) - psi(sizes[y]) - psi(inside)
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.mark.parametrize("k", [1, 3, 5])
def test_neighbour_information_equals_all_pairs(spark, k):
    rng = random.Random(k)
    rows = []
    for i in range(400):
        y = rng.choice(["a", "a", "a", "b", None])
        near = {"a": 0.0, "b": 3.0, None: 1.0}[y]
        rows.append((y, rng.gauss(near, 1), float(rng.randrange(6)), 7.0,
                     rng.choice([None, float("nan"), 1.0, 1.0, near]), rng.choice([0.0, 50.0]) + rng.random(),
                     None))
    rows += [("lone", 1.0, 2.0, 7.0, 1.0, 0.5, None), ("two", 9.0, 1.0, 7.0, -0.0, 0.5, None),
             ("two", 9.5, 1.0, 7.0, 0.0, 0.5, None)]
    names = ["apart", "ties", "flat", "holes", "clusters", "empty"]
    df = spark.createDataFrame(rows, "y string, " + ", ".join(f"{c} double" for c in names))
    got = {r["feature"]: r["score"] for r in neighbour_information(df.repartition(5), names, "y", k).collect()}
    assert set(got) == set(names)
    for i, c in enumerate(names, 1):
        pairs = [(r[i], r[0]) for r in rows if r[i] is not None and r[i] == r[i] and r[0] is not None]
        assert abs(got[c] - neighbour_score(pairs, k)) < 1e-9, c
    assert got["apart"] > got["ties"] and got["empty"] == 0


def test_neighbour_information_of_no_rows(spark):
    df = spark.createDataFrame([], "y int, x double")
    assert [tuple(r) for r in neighbour_information(df, ["x"], "y").collect()] == [("x", 0.0)]


def number_score(pairs, k=3):
    """Nearest-neighbour information of two numbers by comparing all pairs."""
    if len(pairs) < 2:
        return 0.0
    xy = np.array(pairs, float).T
    scales = [float(f"{v.std():.10g}") or 1.0 for v in xy]
    x, y = (np.abs(v[:, None] - v) / s for v, s in zip(xy, scales))
    both = np.maximum(x, y)
    np.fill_diagonal(both, np.inf)
    near = min(k, len(pairs) - 1)
    radius = np.sort(both, axis=1)[:, near - 1]
    psi = lambda n: -0.57721566490153286 + sum(1 / j for j in range(1, int(n)))
    inside = [np.where(radius > 0, (d < radius[:, None]).sum(1), (d == 0).sum(1)) for d in (x, y)]
    rest = np.mean([psi(a) + psi(b) for a, b in zip(*inside)])
    return max(0.0, psi(len(pairs)) + psi(near) - rest)


@pytest.mark.parametrize("k,cell", [(3, 12), (5, 20_000)])
def test_number_information_equals_all_pairs(spark, k, cell, monkeypatch):
    monkeypatch.setattr("paneloom.operators.joint_neighbours.VISITS_PER_TASK", 50)
    rng = random.Random(k + cell)
    rows = []
    for i in range(300):
        y = rng.choice([rng.gauss(0, 1), float(rng.randrange(4)), 2.0])
        rows.append((
            None if i % 50 == 0 else y,
            y + rng.gauss(0, 0.1),
            float(rng.randrange(6)),
            7.0,
            rng.choice([None, float("nan"), math.inf, 1.0, -0.0, 0.0, rng.random()]),
            rng.choice([0.0, 1e6]) + rng.random(),
            math.exp(rng.gauss(0, 4)),
            None,
            1.0 if i in (3, 4) else None,
            1.0 if i == 3 else None,
        ))
    names = ["close", "ties", "flat", "holes", "clusters", "tailed", "empty", "two", "lone"]
    df = spark.createDataFrame(rows, "y double, " + ", ".join(f"{c} double" for c in names))
    found = number_information(df.repartition(5), names, "y", k, cell).collect()
    got = {r["feature"]: r["score"] for r in found}
    assert set(got) == set(names) and len(found) == len(names)
    for i, c in enumerate(names, 1):
        pairs = [(r[i], r[0]) for r in rows if None not in (r[i], r[0]) and math.isfinite(r[i])]
        assert abs(got[c] - number_score(pairs, k)) < 1e-9, c
    assert got["close"] > 0.5 and got["empty"] == got["lone"] == 0


def test_number_information_of_no_rows(spark):
    df = spark.createDataFrame([], "y int, x double")
    assert [tuple(r) for r in number_information(df, ["x"], "y").collect()] == [("x", 0.0)]


def test_crowded_values_are_cut_along_the_other_direction():
    rng = np.random.default_rng(4)
    x = np.where(rng.random(4000) < 0.4, 5.0, rng.random(4000))
    y = np.where(rng.random(4000) < 0.4, -1.0, rng.random(4000))
    points = np.unique(np.stack([x, y]), axis=1)
    x, y = points
    tree = cell_tree(x, y, 1.0, 1.0, 5)
    _, cells = cells_reached(tree, x, y, np.full(len(x), -1.0), (1.0, 1.0))
    assert len(cells) == len(x) and np.bincount(cells).max() <= len(x) / 16
    rows, nodes = cells_reached(tree, x, y, np.full(len(x), 9.0), (1.0, 1.0))
    assert len(rows) == len(x) * len(set(cells))


def test_rows_of_few_values_stay_in_their_cells_and_parts():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 9, 4000).astype(float), rng.random(4000) * 100
    tree = cell_tree(x, y, 1.0, 1e6, 2)  # cut between values of x only
    own = cell_of(tree, x, y)
    assert len(set(own)) == 4
    rows, cells = cells_reached(tree, x, y, np.full(len(x), 0.1), (1.0, 1e6))
    assert len(rows) == len(x) and (cells == own[rows]).all()
    borders, turns = parts_of(x, len(x), 450)
    assert len(borders) > 4 and (np.abs(x[:, None] - borders) == 0.5).any()
    assert (np.abs(x[:, None] - borders) >= 0.1).all() and len(turns) == len(borders) + 1
    crowded = np.concatenate([np.full(3000, 5.0), x[:1000]])
    assert parts_of(crowded, len(crowded), 450)[1].max() == 4


@pytest.mark.parametrize("wanted", [1, 3, 20])
def test_nearest_points_of_crowds_and_outliers(wanted):
    rng = np.random.default_rng(wanted)
    x = np.concatenate([rng.random(300), np.full(200, 50.0), rng.integers(0, 5, 200), [1e9]])
    y = np.concatenate([rng.random(300) * 1e-6, rng.random(200), rng.integers(0, 5, 200), [1e9]])
    x, y = np.unique(np.stack([x, y]), axis=1)
    n = rng.integers(1, 4, len(x))
    scales = (3.0, 0.7)
    leaves = Leaves(x, y, n, scales)

    def kth(qx, qy, own):
        d = np.maximum(np.abs(x - qx) / scales[0], np.abs(y - qy) / scales[1])
        left = n.copy()
        if own is not None:
            left[own] -= 1
        return np.sort(np.repeat(d, left))[wanted - 1]

    _, _, radius = nearest(leaves, x, y, wanted)
    assert radius.tolist() == [kth(a, b, i) for i, (a, b) in enumerate(zip(x, y))]
    qx, qy = rng.random(50) * 60, rng.random(50)
    for bound in (np.inf, 0.5):
        _, _, radius = nearest(leaves, qx, qy, wanted, np.full(50, bound))
        assert radius.tolist() == [min(bound, kth(a, b, None)) for a, b in zip(qx, qy)]


def test_number_information_of_parts_that_are_given_out(spark, monkeypatch):
    monkeypatch.setattr("paneloom.operators.joint_neighbours.CELLS_PER_PART", 2)
    rng = random.Random(8)
    rows = [(rng.choice([0.0, 0.0, rng.gauss(0, 1)]), rng.choice([1.0, 1.0, 1.0, 2.0, rng.random()]))
            for _ in range(400)]
    df = spark.createDataFrame([(*r, r[1] * 1e9) for r in rows], "y double, x double, wide double")
    got = dict(tuple(r) for r in number_information(df.repartition(5), ["x", "wide"], "y", 3, 5).collect())
    assert abs(got["x"] - number_score([(x, y) for y, x in rows], 3)) < 1e-9
    assert abs(got["wide"] - number_score([(x * 1e9, y) for y, x in rows], 3)) < 1e-9


def test_a_border_is_the_first_number_that_far():
    v = np.array([0.0, 1.0, -3.5, 1e300, 0.1, 5e-324, 0.3])
    radius = np.array([0.1, 1.0, 3.5, 1.0, 0.2, 1e-300, 0.0])
    border = upper_border(v, radius, 0.7)
    for b, x, r in zip(border, v, radius):
        assert (b - x) / 0.7 >= r and (b == x or not (np.nextafter(b, -np.inf) - x) / 0.7 >= r)


def test_borders_of_many_numbers():
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=500), rng.integers(-9, 9, 500), rng.normal(size=500) * 1e12])
    radius = np.concatenate([np.abs(v[:750]), rng.random(750) * 1e-9])  # some end next to zero
    for scale in (1.0, 0.3, 2e5):
        border = upper_border(v, radius, scale)
        assert ((border - v) / scale >= radius).all()
        below = np.nextafter(border, -np.inf)
        assert ((border == v) | ((below - v) / scale < radius)).all()
