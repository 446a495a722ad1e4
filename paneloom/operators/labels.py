"""Joining customers or statements with their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paneloom.spec import PanelSpec, require_columns

# No side is broadcast by hand: labels grow with the customers. Spark broadcasts
# them by itself where their measured size allows it; otherwise a customer table
# that is already partitioned by its key is not shuffled again.


def join_labels(features: DataFrame, labels: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows that have features and a label; columns of both, features first."""
    require_columns(features, [spec.key], "feature table")
    require_columns(labels, [spec.key, spec.target], "label table")
    return features.join(labels, spec.key, "inner")


def attach_target(rows: DataFrame, labels: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows with their whole-number target; rows without a known target are left out."""
    require_columns(rows, [spec.key], "feature table")
    require_columns(labels, [spec.key, spec.target], "label table")
    joined = rows.join(labels.select(spec.key, spec.target), spec.key, "left")
    return joined.dropna(subset=[spec.target]).withColumn(
        spec.target, F.col(spec.target).cast("int")
    )


def unlabelled(rows: DataFrame, labels: DataFrame, spec: PanelSpec) -> DataFrame:
    """The rows ``attach_target`` leaves out."""
    known = labels.where(F.col(spec.target).isNotNull()).select(spec.key)
    return rows.join(known, spec.key, "left_anti")


def repeated_label_keys(labels: DataFrame, spec: PanelSpec) -> DataFrame:
    """Customers with more than one label; each would multiply its rows."""
    return (
        labels.groupBy(spec.key)
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col(spec.key).isNotNull())
    )


def require_unique_labels(labels: DataFrame, spec: PanelSpec) -> None:
    repeated = repeated_label_keys(labels, spec).take(5)
    if repeated:
        raise ValueError(f"customers with several labels, such as {[r[0] for r in repeated]}")
