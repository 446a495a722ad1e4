"""From statements and labels to selected train and validation tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneloom.functions import nan_to_null
from paneloom.operators.aggregate import customer_table
from paneloom.operators.labels import require_unique_labels
from paneloom.operators.selection import static_filter
from paneloom.operators.slices import MAX_ROWS
from paneloom.operators.split import stratified_split
from paneloom.operators.trees import (
    MAIN,
    TOP_FEATURES,
    TreeSettings,
    best_features,
    category_features,
    fit_trees,
    gain_importance,
)
from paneloom.sources.files import read_parquet
from paneloom.sources.reports import store, write_lines
from paneloom.spec import PanelSpec, require_columns

VALID_SHARE = 0.2
_LABELLED = "_labelled"


@dataclass(frozen=True)
class CustomerFeatures:
    customers: DataFrame
    train: DataFrame
    valid: DataFrame
    train_selected: DataFrame
    valid_selected: DataFrame
    selected: list[str]


def select_features(
    train: DataFrame, spec: PanelSpec, settings: TreeSettings = MAIN, top: int = TOP_FEATURES
) -> list[str]:
    """Key, target and the features with the largest gain, learned from the training
    table only."""
    fixed = [spec.key, spec.target]
    kept = static_filter(train, fixed).orderBy("position").collect()
    features = [r["feature"] for r in kept if r["feature"] not in fixed]
    model = fit_trees(
        train.select(spec.target, *features),
        features,
        category_features(features, spec),
        spec.target,
        settings,
    )
    return fixed + best_features(gain_importance(train.sparkSession, model), top)


def run(
    spark: SparkSession,
    statements_pattern: str,
    labels_pattern: str,
    out: str,
    spec: PanelSpec = PanelSpec(),
    settings: TreeSettings = MAIN,
    top: int = TOP_FEATURES,
    seed: int = 42,
    max_rows: int | None = MAX_ROWS,
) -> CustomerFeatures:
    """Writes ``customers``, ``train``, ``valid``, their selected versions and the list
    of selected columns below ``out``.

    The customer table and its labels are one plan and one wide write: the join uses
    the partitioning of the aggregation. Everything after reads the stored table.
    """
    statements = nan_to_null(read_parquet(spark, statements_pattern))
    labels = read_parquet(spark, labels_pattern)
    require_columns(labels, [spec.key, spec.target], "label table")
    require_unique_labels(labels, spec)

    wide = customer_table(statements, spec, max_rows).join(
        labels.withColumn(_LABELLED, F.lit(True)), spec.key, "left"
    )
    stored = store(wide, f"{out}/customers")
    label_columns = [c for c in labels.columns if c != spec.key]
    customers = stored.drop(_LABELLED, *label_columns)
    labelled = stored.where(F.col(_LABELLED)).drop(_LABELLED)

    parts = stratified_split(labelled, [spec.key], spec.target, VALID_SHARE, seed)
    train, valid = (store(p, f"{out}/{name}") for p, name in zip(parts, ("train", "valid")))
    selected = select_features(train, spec, settings, top)
    write_lines(spark, selected, f"{out}/selected_features")
    return CustomerFeatures(
        customers=customers,
        train=train,
        valid=valid,
        train_selected=store(train.select(*selected), f"{out}/train_selected"),
        valid_selected=store(valid.select(*selected), f"{out}/valid_selected"),
        selected=selected,
    )
