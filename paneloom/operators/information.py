"""Mutual information between features and the target, over equal-frequency bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from paneloom.operators.quantiles import exact_quantiles
from paneloom.operators.slots import SLOT, with_slots

BINS = 10


def mutual_information(
    df: DataFrame,
    columns: list[str],
    target: str,
    bins: int = BINS,
    target_is_class: bool = True,
) -> DataFrame:
    """(feature, score) in nats. A row without a value takes part in no bin of that
    feature. A continuous target is binned as well.

    Rows are counted per (feature, bin, target) before the shuffle, which therefore
    carries bins and not rows.
    """
    shares = [i / bins for i in range(1, bins)]
    binned = [*columns] if target_is_class else [*columns, target]
    cuts: dict[str, list[float]] = {c: [] for c in binned}
    for row in exact_quantiles(df, binned, shares).collect():
        if row["value"] is not None:
            cuts[row["feature"]].append(row["value"])
    y = F.col(target) if target_is_class else F.col(SLOT + target)
    entries = [
        F.struct(F.lit(i).alias("feature"), F.col(SLOT + c).alias("b"), y.alias("y"))
        for i, c in enumerate(columns)
    ]
    cells = (
        with_slots(df.select(*columns, target), cuts)
        .select(F.inline(F.array(*entries)))
        .where("b IS NOT NULL AND y IS NOT NULL")
        .groupBy("feature", "b", "y")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    # features x bins x target values rows from here on
    of = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    terms = cells.select(
        "feature", "n", of("b").alias("nx"), of("y").alias("ny"), of().alias("total")
    )
    share = F.col("n") / F.col("total")
    scores = terms.groupBy("feature").agg(
        F.sum(share * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("score")
    )
    scores = scores.withColumnRenamed("feature", "_i")
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "_i int, feature string")
    return names.join(scores, "_i", "left").select(
        "feature", F.coalesce("score", F.lit(0.0)).alias("score")
    )
