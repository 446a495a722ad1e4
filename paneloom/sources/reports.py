"""Writing tables, feature lists and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def store(df: DataFrame, path: str) -> DataFrame:
    """Writes a table as Parquet and returns it as read back, free of its plan."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return df.sparkSession.read.parquet(path)


# Lists and reports have one row per feature, so one file each.


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    ordered = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    ordered.coalesce(1).sortWithinPartitions("i").select("line").write.mode("overwrite").text(path)


def write_numbered_list(spark: SparkSession, names: list[str], path: str) -> None:
    """A title with the number of features, then one numbered feature per line."""
    head = [f"SELECTED FEATURES ({len(names)} total)", "=" * 60, ""]
    write_lines(spark, head + [f"{i}. {name}" for i, name in enumerate(names, 1)], path)


def write_csv_report(report: DataFrame, path: str) -> None:
    """A report with a header, in the report's own order."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def importance_report(scores: DataFrame) -> DataFrame:
    """Feature, Importance, Normalized_Importance; best first."""
    return scores.orderBy(F.desc("score"), "feature").select(
        F.col("feature").alias("Feature"),
        F.col("score").alias("Importance"),
        F.col("normalised").alias("Normalized_Importance"),
    )


def attribution_report(scores: DataFrame) -> DataFrame:
    """Feature, Mean_Abs_SHAP; largest first."""
    return scores.orderBy(F.desc("mean_abs"), "feature").select(
        F.col("feature").alias("Feature"), F.col("mean_abs").alias("Mean_Abs_SHAP")
    )
