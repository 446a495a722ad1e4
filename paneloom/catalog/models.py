"""Tree importance, selected tables and attribution, with the settings of the full runs.
Trees have no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paneloom.catalog.fixtures import (
    CATEGORIES,
    ORDERS,
    Query,
    customer_labels,
    rounded,
    screened,
    statements,
)
from paneloom.operators.aggregate import customer_table
from paneloom.operators.attribution import attribution
from paneloom.operators.correlation import roc_auc
from paneloom.operators.labels import join_labels
from paneloom.operators.quantiles import keep_from_percentile
from paneloom.operators.selection import normalised, static_filter
from paneloom.operators.split import sized_split, stratified_split
from paneloom.operators.trees import (
    MAIN,
    SCREENING,
    TOP_FEATURES,
    TreeModel,
    best_features,
    category_features,
    fit_trees,
    gain_importance,
)
from paneloom.session import shared_folder

KEY, TARGET = "o_custkey", "target"


def _customers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(train, valid), cut off from their plan: training reads them many times."""
    shared_folder(spark)
    labelled = join_labels(
        customer_table(statements(spark, sf_dir), ORDERS), customer_labels(spark, sf_dir), ORDERS
    ).checkpoint()
    return stratified_split(labelled, [KEY], TARGET)


def _main_model(train: DataFrame) -> TreeModel:
    kept = [
        r["feature"] for r in static_filter(train, [KEY, TARGET]).orderBy("position").collect()
    ]
    features = [f for f in kept if f not in (KEY, TARGET)]
    return fit_trees(train, features, category_features(features, ORDERS), TARGET, MAIN)


def _gain(spark, sf_dir):
    train, _ = _customers(spark, sf_dir)
    return rounded(gain_importance(spark, _main_model(train)))


def _selected(which: int):
    def run(spark, sf_dir):
        parts = _customers(spark, sf_dir)
        names = best_features(gain_importance(spark, _main_model(parts[0])), TOP_FEATURES)
        return rounded(parts[which].select(KEY, TARGET, *names))

    return run


SCREENING_FEATURES = ["sum_qty", "sum_price", "max_disc", "max_tax", *CATEGORIES]


def _screening_model(spark, sf_dir) -> tuple[TreeModel, DataFrame]:
    shared_folder(spark)
    rows = screened(spark, sf_dir).checkpoint()
    train, valid = sized_split(rows, ["o_orderkey"], TARGET)
    model = fit_trees(train, SCREENING_FEATURES, CATEGORIES, TARGET, SCREENING, valid=valid)
    return model, valid


def _importance(spark, sf_dir) -> DataFrame:
    return gain_importance(spark, _screening_model(spark, sf_dir)[0])


def _valid_auc(spark, sf_dir):
    model, valid = _screening_model(spark, sf_dir)
    # Scored once; ranking reads the scores several times.
    scores = model.scored(valid, ["o_orderkey", TARGET]).checkpoint()
    return rounded(roc_auc(scores, "score", TARGET))


def _attributed(spark, sf_dir) -> DataFrame:
    model, valid = _screening_model(spark, sf_dir)
    return rounded(attribution(valid, model))


QUERIES = {
    "gain_importance": Query(_gain),
    "selected_train": Query(_selected(0)),
    "selected_valid": Query(_selected(1)),
    "importance_norm": Query(lambda s, d: rounded(normalised(_importance(s, d)))),
    "importance_cut": Query(
        lambda s, d: rounded(keep_from_percentile(_importance(s, d), "score", 0.20))
    ),
    "validation_auc": Query(_valid_auc),
    "mean_abs_attribution": Query(lambda s, d: _attributed(s, d).select("feature", "mean_abs")),
    "attribution_direction": Query(
        lambda s, d: _attributed(s, d).select(
            "feature",
            "direction",
            F.when(F.col("direction") > 0, "raises").when(F.col("direction") < 0, "lowers").alias("effect"),
        )
    ),
}
