"""Screening of statement columns: clean, correlate, inform, rank, explain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneloom.functions import nan_to_null
from paneloom.operators import selection as sel
from paneloom.operators.attribution import attribution
from paneloom.operators.correlation import (
    correlation_pairs,
    pearson_target,
    redundant_features,
    roc_auc,
    spearman_target,
)
from paneloom.operators.joint_neighbours import number_information
from paneloom.operators.neighbours import neighbour_information
from paneloom.operators.labels import attach_target, require_unique_labels
from paneloom.operators.profile import task_type
from paneloom.operators.quantiles import fill_with_median, keep_from_percentile
from paneloom.operators.split import sample_rows, sized_split
from paneloom.operators.trees import SCREENING, TreeSettings, fit_trees, gain_importance
from paneloom.session import saved
from paneloom.sources.files import read_parquet
from paneloom.sources.reports import (
    attribution_report,
    importance_report,
    store,
    write_csv_report,
    write_numbered_list,
)
from paneloom.spec import PanelSpec, numeric_columns

# Thresholds of the screening.
REDUNDANT_ABOVE = 0.95
MISSING_ABOVE = 0.90
INFORMATION_FROM = 0.25
IMPORTANCE_FROM = 0.20


@dataclass(frozen=True)
class Screening:
    removals: DataFrame
    pearson: DataFrame
    spearman: DataFrame
    information: DataFrame
    importance: DataFrame
    attribution: DataFrame
    funnel: DataFrame
    auc: float | None
    selected: list[str]
    n_without_gain: int


def _names(features: DataFrame) -> list[str]:
    return [r["feature"] for r in features.select("feature").collect()]


def run(
    spark: SparkSession,
    statements_pattern: str,
    labels_pattern: str,
    out: str,
    spec: PanelSpec = PanelSpec(),
    settings: TreeSettings = SCREENING,
    seed: int = 42,
    explained_rows: int | None = None,
) -> Screening:
    """Writes the removal, importance and attribution reports and the final list below
    ``out``. Rows are statements, each with its customer's target. Attribution explains
    all validation rows, or a sample of ``explained_rows``."""
    statements = nan_to_null(read_parquet(spark, statements_pattern))
    labels = read_parquet(spark, labels_pattern)
    require_unique_labels(labels, spec)
    rows = store(attach_target(statements, labels, spec), f"{out}/labelled")
    id_cols = [spec.key, *spec.position]
    columns = [c for c in rows.columns if c != spec.target]
    every = sel.feature_table(spark, columns)

    removals = saved(sel.removal_report(rows, columns, missing_share=MISSING_ABOVE))
    write_csv_report(sel.report_rows(removals), f"{out}/removed_features")
    cleaned = sel.without(every, removals)
    clean_names = [r["feature"] for r in cleaned.orderBy("position").collect()]

    numbers = [
        c for c in numeric_columns(rows) if c in set(clean_names) and c not in id_cols
    ]
    filled = store(
        fill_with_median(rows.select(*id_cols, *numbers, spec.target), numbers), f"{out}/filled"
    )
    pearson = saved(pearson_target(filled, numbers, spec.target))
    spearman = spearman_target(filled, numbers, spec.target)
    redundant = redundant_features(correlation_pairs(filled, numbers), pearson, REDUNDANT_ABOVE)
    dropped = set(_names(redundant))
    unique = [c for c in numbers if c not in dropped]

    task = task_type(filled, spec.target).first()["task"]
    information = saved(
        number_information(filled, unique, spec.target)
        if task == "regression"
        else neighbour_information(filled, unique, spec.target)
    )
    informative = keep_from_percentile(information, "score", INFORMATION_FROM)
    informed = set(_names(informative))
    features = [c for c in unique if c in informed]

    stratify = None if task == "regression" else spec.target
    train, valid = sized_split(filled, id_cols, stratify, 0.2, seed)
    model = fit_trees(train, features, [], spec.target, settings, task, valid)
    importance = saved(sel.normalised(gain_importance(spark, model)))
    write_csv_report(importance_report(importance), f"{out}/importance")
    kept = keep_from_percentile(importance, "score", IMPORTANCE_FROM)
    selected = [
        r["feature"] for r in kept.orderBy(F.desc("score"), "feature").select("feature").collect()
    ]
    write_numbered_list(spark, selected, f"{out}/selected_features")

    auc = None
    if task == "binary":
        scores = store(model.scored(valid, [*id_cols, spec.target]), f"{out}/validation_scores")
        auc = roc_auc(scores, "score", spec.target).first()["auc"]
    rows_to_explain = (
        valid if explained_rows is None else sample_rows(valid, id_cols, explained_rows, seed)
    )
    explained = saved(attribution(rows_to_explain, model))
    write_csv_report(attribution_report(explained), f"{out}/attribution")

    funnel = sel.funnel(
        [
            ("all", every),
            ("cleaned", cleaned),
            ("informative", informative),
            ("important", sel.feature_table(spark, selected)),
        ]
    )
    return Screening(
        removals, pearson, spearman, information, importance, explained, funnel, auc, selected,
        importance.where("score = 0").count(),
    )
