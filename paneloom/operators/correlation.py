"""Correlation with the target and between features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from paneloom.operators.profile import to_long
from paneloom.operators.slots import SLOT, rank_slots
from paneloom.spec import column_groups, union_all

# Sorted slots of one feature: how many come from estimated quantiles, and how many rows
# each has; beyond that many rows the slots are cut into stripes.
SLOTS = 1000
ROWS_PER_SLOT = 200_000
# Up to this many target values their ranks are counted and sent to tasks (200 columns each).
FEW_TARGETS = 1000
# A spread below this share of the second moment is rounding, not variation.
NO_SPREAD = 1e-12


def pearson_target(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, score): Pearson correlation of each column with the target over rows
    where both are known; null for a constant. Every column is read once."""
    y = F.col(target).cast("double")

    def correlation(c: str) -> Column:
        x = F.col(c).cast("double")
        both = x.isNotNull() & y.isNotNull()
        spread = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
        return F.covar_samp(F.when(both, x), F.when(both, y)) / F.nullif(spread, F.lit(0.0))

    def of(group: list[str]) -> DataFrame:
        row = df.agg(*(correlation(c).alias(f"score|{c}") for c in group))
        return to_long(row, group, {"score": "double"})

    return union_all([of(group) for group in column_groups(columns)])


# --- ranks -------------------------------------------------------------------


def average_ranks(counts: DataFrame, value: str, slot: str, keep: list[str]) -> DataFrame:
    """Adds the average rank ``_rank`` of each value within its feature and the number
    of rows ``_total`` of the feature.

    ``counts`` has (feature, slot, value, ..., n). Slots are ordered like the values,
    so a rank is what the earlier slots hold plus the place within the own slot; no
    task sees more than one slot of one feature. The slots' offsets (features x slots
    rows) are joined as Spark sees fit.
    """
    sizes = counts.groupBy("feature", slot).agg(F.sum("n").alias("_size"))
    by_slot = Window.partitionBy("feature").orderBy(slot)
    offsets = sizes.select(
        F.col("feature").alias("_of"),
        F.col(slot).alias("_os"),
        (F.sum("_size").over(by_slot) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(Window.partitionBy("feature")).alias("_total"),
    )
    upto = Window.partitionBy("feature", slot).orderBy(value).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    same = Window.partitionBy("feature", slot, value)
    ranked = counts.withColumn("_upto", F.sum("n").over(upto)).withColumn(
        "_same", F.sum("n").over(same)
    )
    return ranked.join(
        offsets, (F.col("feature") == F.col("_of")) & (F.col(slot) == F.col("_os"))
    ).select(
        "feature",
        value,
        *keep,
        "n",
        (F.col("_offset") + F.col("_upto") - (F.col("_same") - 1) / 2).alias("_rank"),
        "_total",
    )


def spearman_target(
    df: DataFrame,
    columns: list[str],
    target: str,
    slots: int = SLOTS,
    rows_per_slot: int = ROWS_PER_SLOT,
    few_targets: int = FEW_TARGETS,
) -> DataFrame:
    """(feature, score): rank correlation of each column with the target, ties at
    their average rank, over rows where both are known.

    Null for a constant, for a column without known values and for an empty table. NaN is
    the greatest value, 0.0 and -0.0 are one. A target of up to ``few_targets`` values is
    ranked by counting, once for all columns, and what it adds up to per value of a column
    is shuffled once; the scores are the same beyond.
    """
    y = F.col(target).cast("double")
    narrow = df.select(*(F.col(c).cast("double").alias(c) for c in columns), y.alias("_y"))
    few = narrow.select("_y").distinct().limit(few_targets + 1).count() <= few_targets
    if few:
        sums = _sums_of_ranked(narrow, columns, slots, rows_per_slot)
    else:
        sums = _sums_of_paired(narrow, columns, slots, rows_per_slot)
    scores = sums.select(
        F.col("feature").alias("_i"),
        F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("score"),
    )
    # A column without known values has a row too.
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "_i int, feature string")
    return names.join(scores, "_i", "left").select("feature", "score")


def _target_ranks(narrow: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The target's known values in order, and for each column (a row) and each of them the
    average rank, less the mean rank, among the rows where the column is known. No row is
    unpivoted: the columns' known values are counted per value of the target."""
    counted = narrow.where("_y IS NOT NULL").groupBy("_y")
    groups = column_groups(columns)
    parts = [
        sorted(counted.agg(*(F.count(c) for c in group)).collect(), key=_nan_last)
        for group in groups
    ]
    values = np.array([row[0] for row in parts[0]], float)
    shapes = [(len(values), len(group)) for group in groups]
    known = np.concatenate(
        [np.array([r[1:] for r in p], float).reshape(s) for p, s in zip(parts, shapes)], axis=1
    ).T
    upto = np.cumsum(known, axis=1)
    return values, upto - (known - 1) / 2 - (known.sum(axis=1, keepdims=True) + 1) / 2


def _nan_last(row) -> tuple[bool, float]:
    return math.isnan(row[0]), row[0]


def _sums_of_ranked(
    narrow: DataFrame, columns: list[str], slots: int, rows_per_slot: int
) -> DataFrame:
    """(feature, xy, xx, yy) for a target of few values.

    Tasks add up their rows per value of a column; these sums meet once, by feature and
    slot. Inside a slot ranks come from one window; sums of them are shifted by what the
    slots before hold. Ranks less their mean are halves of whole numbers, so that sums
    don't depend on their order up to 2^52.
    """
    values, centred = _target_ranks(narrow, columns)
    cut = rank_slots(narrow, columns, slots, rows_per_slot)
    number = {c: i for i, c in enumerate(columns)}
    parts = []
    for group in column_groups(columns):
        slotted = cut.add_to(narrow.where("_y IS NOT NULL").select(*group, "_y"))
        parts.append(
            slotted.mapInArrow(
                _value_sums(group, [number[c] for c in group], values, centred),
                "feature int, slot long, x double, n long, sy double, syy double",
            )
        )
    counts = (
        union_all(parts)
        .repartition("feature", "slot")
        .groupBy("feature", "slot", "x")
        .agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"))
    )
    upto = F.sum("n").over(
        Window.partitionBy("feature", "slot").orderBy("x").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
    )
    rank = upto - (F.col("n") - 1) / 2
    by_slot = (
        counts.withColumn("r", rank)
        .groupBy("feature", "slot")
        .agg(
            F.sum("n").alias("n"),
            F.sum("sy").alias("sy"),
            F.sum("syy").alias("syy"),
            F.sum(F.col("sy") * F.col("r")).alias("syr"),
            F.sum(F.col("n") * F.col("r")).alias("nr"),
            F.sum(F.col("n") * F.col("r") * F.col("r")).alias("nrr"),
        )
    )
    of_feature = Window.partitionBy("feature")
    before = F.sum("n").over(of_feature.orderBy("slot")) - F.col("n")
    shift = before - (F.sum("n").over(of_feature) + 1) / 2
    k = F.col("k")
    return (
        by_slot.withColumn("k", shift)
        .groupBy("feature")
        .agg(
            F.sum(F.col("syr") + k * F.col("sy")).alias("xy"),
            F.sum(F.col("nrr") + 2 * k * F.col("nr") + k * k * F.col("n")).alias("xx"),
            F.sum("syy").alias("yy"),
        )
    )


def _value_sums(group: list[str], numbers: list[int], values: np.ndarray, centred: np.ndarray):
    """For each column of a batch and each of its values: rows, and sums of the target's
    centred ranks and of their squares."""
    of_group = centred[numbers]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.searchsorted(values, batch["_y"].to_numpy(zero_copy_only=False))
            for c, feature, ranks in zip(group, numbers, of_group):
                known = batch[c].is_valid().to_numpy(zero_copy_only=False)
                if not known.any():
                    continue
                x = batch[c].drop_null().to_numpy() + 0.0  # -0.0 becomes 0.0
                slot = batch[SLOT + c].drop_null().to_numpy()
                x, first, at = np.unique(x, return_index=True, return_inverse=True)
                dy = ranks[place[known]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(x), feature, np.int32)),
                        pa.array(slot[first].astype(np.int64)),
                        pa.array(x),
                        pa.array(np.bincount(at)),
                        pa.array(np.bincount(at, dy)),
                        pa.array(np.bincount(at, dy * dy)),
                    ],
                    ["feature", "slot", "x", "n", "sy", "syy"],
                )

    return add_up


def _sums_of_paired(
    narrow: DataFrame, columns: list[str], slots: int, rows_per_slot: int
) -> DataFrame:
    """(feature, xy, xx, yy) for a target of any number of values."""
    slotted = rank_slots(narrow, [*columns, "_y"], slots, rows_per_slot).add_to(narrow)
    entries = [
        F.struct(
            F.lit(i).alias("feature"),
            F.col(c).alias("x"),
            F.col(SLOT + c).alias("xs"),
            F.col("_y").alias("y"),
            F.col(f"{SLOT}_y").alias("ys"),
        )
        for i, c in enumerate(columns)
    ]
    counts = (
        slotted.select(F.inline(F.array(*entries)))
        # The slots are known where the values are. Saying so keeps the uses of this
        # table identical, so that its shuffle happens once and is read by all.
        .where("x IS NOT NULL AND y IS NOT NULL AND xs IS NOT NULL AND ys IS NOT NULL")
        .groupBy("feature", "x", "xs", "y", "ys")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    targets = counts.groupBy("feature", "y", "ys").agg(F.sum("n").alias("n"))
    of_y = average_ranks(targets, "y", "ys", []).select(
        F.col("feature").alias("_fy"),
        F.col("y").alias("_vy"),
        (F.col("_rank") - (F.col("_total") + 1) / 2).alias("_dy"),
    )
    dy = F.col("_dy")
    # Summed per value before it is ranked: a value with a third of all rows, each with
    # a target of its own, is one row of a window.
    by_x = (
        counts.join(of_y, (F.col("feature") == F.col("_fy")) & (F.col("y") == F.col("_vy")))
        .groupBy("feature", "x", "xs")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * dy).alias("_sy"),
            F.sum(F.col("n") * dy * dy).alias("_syy"),
        )
    )
    dx = F.col("_rank") - (F.col("_total") + 1) / 2
    return (
        average_ranks(by_x, "x", "xs", ["_sy", "_syy"])
        .groupBy("feature")
        .agg(
            F.sum(F.col("_sy") * dx).alias("xy"),
            F.sum(F.col("n") * dx * dx).alias("xx"),
            F.sum("_syy").alias("yy"),
        )
    )


def roc_aucs(
    df: DataFrame,
    scores: list[str],
    target: str,
    slots: int = SLOTS,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """(feature, n_rows, positives, auc) of each score, from its average ranks; null when a
    class is absent. A score without known rows has no row."""
    narrow = df.select(
        *(F.col(c).cast("double").alias(c) for c in scores), F.col(target).cast("long").alias("y")
    ).where("y IS NOT NULL")
    # A slot holds that many rows anyway.
    few = narrow.limit(rows_per_slot + 1).count() <= rows_per_slot and slots == SLOTS
    if few:
        slotted = narrow.withColumns({SLOT + c: F.lit(0).cast("long") for c in scores})
    else:
        slotted = rank_slots(narrow, scores, slots, rows_per_slot).add_to(narrow)
    entries = [
        F.struct(
            F.lit(c).alias("feature"), F.col(c).alias("x"), F.col(SLOT + c).cast("long").alias("xs"), "y"
        )
        for c in scores
    ]
    counts = (
        slotted.select(F.inline(F.array(*entries)))
        .where("x IS NOT NULL AND xs IS NOT NULL")
        .groupBy("feature", "x", "xs")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positive"))
    )
    ranked = average_ranks(counts, "x", "xs", ["positive"])
    sums = ranked.groupBy("feature").agg(
        F.sum("n").alias("n_rows"),
        F.sum("positive").alias("positives"),
        F.sum(F.col("_rank") * F.col("positive")).alias("_ranks"),
    )
    p = F.col("positives").cast("double")
    return sums.select(
        "feature",
        "n_rows",
        "positives",
        F.try_divide(F.col("_ranks") - p * (p + 1) / 2, p * (F.col("n_rows") - p)).alias("auc"),
    )


def roc_auc(
    df: DataFrame,
    score: str,
    target: str,
    slots: int = SLOTS,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """(n_rows, positives, auc) from average ranks of the scores; null when a class
    is absent."""
    narrow = df.select(
        F.col(score).cast("double").alias("x"), F.col(target).cast("long").alias("y")
    ).where("x IS NOT NULL AND y IS NOT NULL")
    counts = (
        rank_slots(narrow, ["x"], slots, rows_per_slot)
        .add_to(narrow)
        .where(F.col(f"{SLOT}x").isNotNull())
        .groupBy(F.lit(0).alias("feature"), "x", F.col(f"{SLOT}x").alias("xs"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positive"))
    )
    ranked = average_ranks(counts, "x", "xs", ["positive"])
    sums = ranked.agg(
        F.sum("n").alias("n_rows"),
        F.sum("positive").alias("positives"),
        F.sum(F.col("_rank") * F.col("positive")).alias("_ranks"),
    )
    p = F.col("positives").cast("double")
    return sums.select(
        "n_rows",
        "positives",
        F.try_divide(F.col("_ranks") - p * (p + 1) / 2, p * (F.col("n_rows") - p)).alias("auc"),
    )


# --- pairs -------------------------------------------------------------------

_PAIR_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
_PAIR_SCHEMA = "i int, j int, " + ", ".join(f"{c} double" for c in _PAIR_SUMS)


# Columns whose pairs one task sums up at a time: six sums of the square of this many numbers,
# 50 MB, whatever the width of the table. Rows are multiplied in slices, sums given out in pieces.
PAIR_BLOCK = 1_024
ROWS_AT_ONCE = 2_048
PAIRS_AT_ONCE = 65_536


def _pair_sums(means: np.ndarray, first: range, second: range):
    """Sums over one task's rows for every pair of a column of the first range and one of
    the second, by matrix products. The ranges are equal or apart."""
    same = first == second

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(first), len(second))
        n, sx, sy, sxx, syy, sxy = (np.zeros(shape) for _ in _PAIR_SUMS)
        rows = 0
        slices = (
            batch.slice(at, ROWS_AT_ONCE)
            for batch in batches
            for at in range(0, batch.num_rows, ROWS_AT_ONCE)
        )
        for batch in slices:
            rows += batch.num_rows
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            x = x.astype(float) - means
            known = ~np.isnan(x)
            x[~known] = 0.0
            known = known.astype(float)
            a, known_a = x[:, : len(first)], known[:, : len(first)]
            b, known_b = (a, known_a) if same else (x[:, len(first) :], known[:, len(first) :])
            n += known_a.T @ known_b
            sx += a.T @ known_b
            sy += known_a.T @ b
            sxx += (a * a).T @ known_b
            syy += known_a.T @ (b * b)
            sxy += a.T @ b
        if not rows:
            return
        i, j = np.triu_indices(len(first), 1) if same else map(np.ravel, np.indices(shape))
        for at in range(0, len(i), PAIRS_AT_ONCE):
            a, b = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
            ids = [pa.array((k + of.start).astype("int32")) for k, of in ((a, first), (b, second))]
            sums = [pa.array(m[a, b]) for m in (n, sx, sy, sxx, syy, sxy)]
            yield pa.RecordBatch.from_arrays([*ids, *sums], names=["i", "j", *_PAIR_SUMS])

    return task


def correlation_pairs(
    df: DataFrame, columns: list[str], block: int = PAIR_BLOCK
) -> DataFrame:
    """(i, j, feature_a, feature_b, n, r) for every pair of columns, a before b, over
    rows where both are known; r is null where one of them is constant there. A table
    without rows has no pairs.

    Every task reduces its rows to one set of sums, so what is shuffled grows with
    the tasks and the pairs of columns and not with the rows. Above ``block`` columns
    each pair of blocks is a pass of its own that reads the columns of the two.
    """
    doubles = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    averages = {}
    for group in column_groups(columns):
        averages |= doubles.agg(*(F.avg(c).alias(c) for c in group)).first().asDict()
    means = np.array([averages[c] or 0.0 for c in columns])
    blocks = [
        range(at, min(at + block, len(columns))) for at in range(0, max(1, len(columns)), block)
    ]
    passes = []
    for k, first in enumerate(blocks):
        for second in blocks[k:]:
            members = [*first] if first == second else [*first, *second]
            read = doubles.select(*(columns[m] for m in members))
            passes.append(
                read.mapInArrow(_pair_sums(means[members], first, second), _PAIR_SCHEMA)
            )
    parts = union_all(passes)
    total = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in _PAIR_SUMS))

    def spread(s: str, ss: str) -> Column:
        scale = F.col("n") * F.col(ss)
        value = scale - F.col(s) * F.col(s)
        return F.when(value > scale * NO_SPREAD, value)

    names = F.array(*(F.lit(c) for c in columns))
    cross = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    return total.select(
        "i",
        "j",
        F.get(names, F.col("i")).alias("feature_a"),
        F.get(names, F.col("j")).alias("feature_b"),
        F.col("n").cast("long").alias("n"),
        (cross / F.sqrt(spread("sx", "sxx")) / F.sqrt(spread("sy", "syy"))).alias("r"),
    )


def strong_pairs(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    return pairs.where(F.abs("r") >= threshold)


def strong_features(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Every feature that is part of a strong pair."""
    strong = strong_pairs(pairs, threshold)
    return (
        strong.select(F.col("feature_a").alias("feature"))
        .union(strong.select("feature_b"))
        .distinct()
    )


def redundant_features(
    pairs: DataFrame, target_scores: DataFrame, threshold: float = 0.95
) -> DataFrame:
    """Of every pair above the threshold the member less correlated with the target;
    the later one on a tie. Pairs are judged independently of each other. Scores that
    agree to nine places are a tie: beyond that they depend on the order of addition."""
    score = F.round(F.abs(F.col("score")), 9)
    a = target_scores.select(F.col("feature").alias("feature_a"), score.alias("_a"))
    b = target_scores.select(F.col("feature").alias("feature_b"), score.alias("_b"))
    judged = (
        pairs.where(F.abs("r") > threshold)
        .join(a, "feature_a", "left")
        .join(b, "feature_b", "left")
    )
    keeps_a = F.coalesce("_a", F.lit(0.0)) >= F.coalesce("_b", F.lit(0.0))
    loser = F.when(keeps_a, F.col("feature_b")).otherwise(F.col("feature_a"))
    return judged.select(loser.alias("feature")).distinct()
