"""One key, value or group with a third of all rows: same results, no single task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom import PanelSpec
from paneloom.operators.correlation import roc_auc, spearman_target
from paneloom.operators.labels import attach_target
from paneloom.operators.profile import value_profile
from paneloom.operators.quantiles import exact_quantiles

SPEC = PanelSpec(key="k", order="t", categoricals=())
SMALL_SHUFFLES = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture()
def small_shuffles(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL_SHUFFLES}
    for k, v in SMALL_SHUFFLES.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_statement_labels_split_a_large_customer(spark, small_shuffles):
    n = 60_000
    rows = spark.range(0, n, 1, 16).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("k"),
        F.col("id").alias("t"),
        F.rand(1).alias("x"),
    )
    labels = spark.range(-1, 5000).select(F.col("id").alias("k"), (F.col("id") % 2 == 0).cast("int").alias("target"))
    joined = attach_target(rows, labels, SPEC)
    assert joined.count() == n
    joined.write.format("noop").mode("overwrite").save()
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan.split("== Initial Plan ==")[0]


def test_a_value_with_half_the_rows(spark):
    df = spark.range(0, 9000, 1, 9).select(
        F.when(F.col("id") % 2 == 0, 0.25).otherwise(F.col("id") / 9000).alias("x")
    )
    profile = value_profile(df, ["x"]).first()
    # 0.25 is also one of the other values
    assert profile["n_unique"] in (4500, 4501) and profile["mode_share"] >= 0.5
    middle = {r["share"]: r["value"] for r in exact_quantiles(df, ["x"], [0.3, 0.5], 100).collect()}
    assert middle[0.3] == 0.25 and middle[0.5] == 0.25


@pytest.mark.parametrize("slots, rows_per_slot", [(1, 50), (4, 50), (1000, 200_000)])
def test_ranks_of_a_heavy_and_of_infinite_values(spark, slots, rows_per_slot):
    """A third of zeros, each with a target of its own; infinities and a far outlier."""
    rng = np.random.default_rng(5)
    n = 900
    x = np.where(np.arange(n) % 3 == 0, 0.0, rng.lognormal(0, 3, n))
    x[:4] = [np.inf, -np.inf, 1e300, -1e300]
    pdf = pd.DataFrame({"x": x, "y": rng.random(n) + np.clip(x, 0, 1), "c": (x > 1).astype(int)})
    df = spark.createDataFrame(pdf)
    got = spearman_target(df, ["x"], "y", slots, rows_per_slot).first()["score"]
    ranks = pdf[["x", "y"]].rank()
    assert abs(got - ranks["x"].corr(ranks["y"])) < 1e-9
    assert roc_auc(df, "x", "c", slots, rows_per_slot).first()["auc"] == 1.0


@pytest.mark.parametrize("accuracy, most_ordered", [(20, 10), (10_000, 10), (10_000, 100_000)])
def test_quantiles_of_heavy_values_and_tails(spark, accuracy, most_ordered):
    rng = np.random.default_rng(6)
    x = np.where(np.arange(3000) % 3 == 0, 2.5, rng.lognormal(0, 3, 3000))
    shares = [0.0, 0.001, 0.33, 0.5, 0.999, 1.0]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    for r in exact_quantiles(df, ["x"], shares, accuracy, most_ordered).collect():
        assert np.isclose(r["value"], np.quantile(x, r["share"]), rtol=1e-12)
