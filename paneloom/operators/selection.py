"""Which features to keep: static filters, reports, cuts, changes between runs.

Feature lists are small tables with one row per feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from paneloom.functions import slot_in
from paneloom.operators.profile import Estimates, dominant_value, estimates, value_counts
from paneloom.spec import column_groups, union_all

# Thresholds of the two screening runs and the texts of the report.
EMPTY_SHARE = 0.999
STABLE_SHARE = 0.999
QUASI_CONSTANT_SHARE = 0.99
# The least share at which the median is sure to be found as the most frequent value.
DOMINANT_FROM = 0.6
MISSING_SHARE = 0.90
REASON_ID = "ID (cardinalidade = n_amostras)"
REASON_CONSTANT = "Constante"
REASON_QUASI_CONSTANT = "Quase-constante (>99%)"
REASON_MISSING = "Missing %.0f%%"
REPORT_COLUMNS = ("Feature", "Motivo")

# An estimate of distinct values below this share of the rows rules out an ID.
_MAYBE_ID_SHARE = 0.8
# One of so many slices of the values is looked at before a column is counted whole.
ID_SLICE = 1000


def feature_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """(position, feature) of a list of columns."""
    return spark.createDataFrame(list(enumerate(names)), "position int, feature string")


# --- static filters ----------------------------------------------------------


def static_filter(
    df: DataFrame,
    keep_first: list[str],
    empty_share: float = EMPTY_SHARE,
    stable_share: float = STABLE_SHARE,
) -> DataFrame:
    """(position, feature) of the columns that are neither empty nor constant but for
    a thousandth of the rows. ``keep_first`` columns always stay and lead."""
    others = [c for c in df.columns if c not in keep_first]
    n = F.col("n_rows")
    dropped = dominant_value(df, others, exact=stable_share < DOMINANT_FROM).where(
        (F.col("n_null") / n > empty_share) | (F.col("n_top") / n > stable_share)
    )
    listed = feature_table(df.sparkSession, [*keep_first, *others])
    return listed.join(F.broadcast(dropped.select("feature")), "feature", "left_anti").select(
        "position", "feature"
    )


def removal_report(
    df: DataFrame,
    columns: list[str],
    quasi_constant_share: float = QUASI_CONSTANT_SHARE,
    missing_share: float = MISSING_SHARE,
    ids_are_whole_or_text: bool = False,
) -> DataFrame:
    """(rule, position, feature, reason) of the columns to remove, each with the first
    rule it meets: a value of its own in every row, one value, nearly one value,
    mostly missing.

    ``ids_are_whole_or_text`` exempts fractional numbers from the first rule, which
    otherwise takes any continuous column for an ID.
    """
    spark = df.sparkSession
    may_be_id = [
        c
        for c in columns
        if not ids_are_whole_or_text
        or isinstance(df.schema[c].dataType, (T.IntegralType, T.StringType))
    ]
    about = estimates(df, columns, distinct_of=may_be_id)
    facts = dominant_value(df, columns, about, quasi_constant_share < DOMINANT_FROM).join(
        F.broadcast(feature_table(spark, columns)), "feature"
    )
    ids = _id_columns(df, may_be_id, about)
    is_id = F.col("feature").isin(ids) if ids else F.lit(False)
    n, known = F.col("n_rows"), F.col("n_rows") - F.col("n_null")
    missing = F.col("n_null") / n
    rules: list[tuple[Column, Column]] = [
        (is_id, F.lit(REASON_ID)),
        ((known > 0) & (F.col("n_top") == known), F.lit(REASON_CONSTANT)),
        (F.col("n_top") / n > quasi_constant_share, F.lit(REASON_QUASI_CONSTANT)),
        (missing > missing_share, F.format_string(REASON_MISSING, missing * 100)),
    ]
    rule, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (holds, text) in reversed(list(enumerate(rules, 1))):
        rule = F.when(holds, i).otherwise(rule)
        reason = F.when(holds, text).otherwise(reason)
    return (
        facts.select(rule.alias("rule"), "position", "feature", reason.alias("reason"))
        .where(F.col("rule").isNotNull())
    )


def _id_columns(df: DataFrame, columns: list[str], about: Estimates) -> list[str]:
    """Columns with as many distinct values as rows. Estimates rule most columns out and a
    slice of the values most others; of the rest all values are looked at."""
    maybe = [
        c
        for c in columns
        if 0 < about.n_rows == about.known[c]
        and about.distinct[c] >= _MAYBE_ID_SHARE * about.n_rows
    ]
    for slices in (ID_SLICE, 1):
        repeating = repeating_columns(df, maybe, slices)
        maybe = [c for c in maybe if c not in repeating]
    return maybe


def repeating_columns(df: DataFrame, columns: list[str], slices: int = 1) -> set[str]:
    """Columns with a value that stands twice, among the values of one of so many slices
    by hash. Exact, and a few jobs for 200 columns, however many of them repeat.

    Only 64-bit hashes are counted, which is what keeps wide text out of the shuffle. Of a
    column with a repeated hash, the values behind one such hash are compared; should they
    differ, the column is counted value by value. Nulls are left out, NaN equals itself,
    0.0 and -0.0 are one value. An empty table has no such column.
    """
    found = set()
    for group in column_groups(columns):
        hashes = [
            F.struct(F.lit(i).alias("feature"), _hash(df, c, i).alias("h"))
            for i, c in enumerate(group)
        ]
        sliced = df.select(
            F.inline(
                F.filter(F.array(*hashes), lambda e: F.pmod(e["h"], F.lit(slices)) == 0)
            )
        )
        twice = {
            r["feature"]: r["h"]
            for r in sliced.groupBy("feature", "h")
            .agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1")
            .groupBy("feature")
            .agg(F.min("h").alias("h"))
            .collect()
        }
        if not twice:
            continue
        behind = df.select(
            *(F.when(_hash(df, group[i], i) == h, F.col(group[i])).alias(group[i])
              for i, h in twice.items())
        )
        same = _with_repeated_value(behind, [group[i] for i in twice])
        unsure = [group[i] for i in twice if group[i] not in same]
        found |= same | (_with_repeated_value(df, unsure) if unsure else set())
    return found


def _hash(df: DataFrame, column: str, number: int) -> Column:
    """Null for null; columns of equal values have different hashes."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0.0)  # -0.0 becomes 0.0
    return F.when(F.col(column).isNotNull(), F.xxhash64(F.lit(number), value))


def _with_repeated_value(df: DataFrame, columns: list[str]) -> set[str]:
    repeated = [
        counts.where("value IS NOT NULL AND n > 1").select("feature").distinct()
        for counts in value_counts(df, columns).values()
    ]
    return {columns[r["feature"]] for r in union_all(repeated).collect()}


def report_rows(removals: DataFrame) -> DataFrame:
    """The removal report as it is written: feature and reason, ordered by rule."""
    feature, reason = REPORT_COLUMNS
    return removals.orderBy("rule", "position").select(
        F.col("feature").alias(feature), F.col("reason").alias(reason)
    )


# --- lists as sets -----------------------------------------------------------


def without(features: DataFrame, removed: DataFrame) -> DataFrame:
    """The features that are not removed, in their order."""
    return features.join(removed.select("feature"), "feature", "left_anti").select(features.columns)


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(feature, status): added, removed or stable between two selections."""
    o = old.select("feature", F.lit(True).alias("_old"))
    w = new.select("feature", F.lit(True).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .otherwise("stable")
    )
    return o.join(w, "feature", "full").select("feature", status.alias("status"))


def drift_summary(changes: DataFrame, tolerated: float = 0.05) -> DataFrame:
    """Counts, stability and whether the old or the new list is to be used: the old
    one when more than the tolerated share of it was removed."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    before = F.col("stable") + F.col("removed")
    return changes.agg(
        count("added").alias("added"),
        count("removed").alias("removed"),
        count("stable").alias("stable"),
    ).select(
        "added",
        "removed",
        "stable",
        (F.try_divide(F.col("stable"), before) * 100).alias("stability_pct"),
        F.when(F.try_divide(F.col("removed"), before) > tolerated, "old")
        .otherwise("new")
        .alias("use"),
    )


def chosen_after_drift(old: DataFrame, new: DataFrame, tolerated: float = 0.05) -> DataFrame:
    """The features to go on with, by the rule of ``drift_summary``."""
    changes = drift(old, new)
    use = F.broadcast(drift_summary(changes, tolerated).select("use"))
    wanted = F.when(F.col("use") == "old", F.col("status") != "added").otherwise(
        F.col("status") != "removed"
    )
    # One row decides; it is joined on a constant.
    return (
        changes.withColumn("_one", F.lit(1))
        .join(use.withColumn("_one", F.lit(1)), "_one")
        .where(wanted)
        .select("feature")
    )


# --- scores ------------------------------------------------------------------


def top_scores(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best features, by name where scores are equal."""
    return scores.orderBy(F.desc_nulls_last(score), "feature").limit(k)


def normalised(scores: DataFrame, score: str = "score") -> DataFrame:
    """Adds each score's share of all scores."""
    whole = Window.partitionBy(F.lit(0))
    return scores.withColumn("normalised", F.try_divide(F.col(score), F.sum(score).over(whole)))


def score_histogram(scores: DataFrame, bins: int = 50, score: str = "score") -> DataFrame:
    """(bin, low, high, n) over equal-width bins; the last one includes its upper edge."""
    known = scores.where(F.col(score).isNotNull())
    edges = known.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    # All scores equal: bins around the one value.
    flat = F.col("lo") == F.col("hi")
    lo = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    grid = edges.select(
        lo.alias("lo"), ((hi - lo) / bins).alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    whole = Window.partitionBy(F.lit(0))
    spans = known.select(
        F.col(score).alias("_s"), F.min(score).over(whole).alias("lo"), F.max(score).over(whole).alias("hi")
    )
    place = F.floor((F.col("_s") - lo) / ((hi - lo) / bins)).cast("int")
    filled = spans.groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    low = F.col("lo") + F.col("bin") * F.col("width")
    return grid.join(filled, "bin", "left").select(
        "bin", low.alias("low"), (low + F.col("width")).alias("high"), F.coalesce("n", F.lit(0)).alias("n")
    )


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(stage, n_features, reduction_pct): features left after each stage and the
    reduction since the first."""
    spark = stages[0][1].sparkSession
    rows = [(i, name, table.count()) for i, (name, table) in enumerate(stages)]
    first = rows[0][2]
    return spark.createDataFrame(
        [(i, name, n, 100.0 * (first - n) / first if first else None) for i, name, n in rows],
        "position int, stage string, n_features long, reduction_pct double",
    )


def uplift(auc_before: DataFrame, auc_after: DataFrame) -> DataFrame:
    """(auc_before, auc_after, uplift_pct) from two one-row tables."""
    a = auc_before.select(F.lit(1).alias("_one"), F.col("auc").alias("auc_before"))
    b = auc_after.select(F.lit(1).alias("_one"), F.col("auc").alias("auc_after"))
    change = F.try_divide(F.col("auc_after") - F.col("auc_before"), F.col("auc_before")) * 100
    return a.join(F.broadcast(b), "_one").drop("_one").withColumn("uplift_pct", change)


# --- weights and codes -------------------------------------------------------


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(target, n, weight): the rarer class weighs as much in all as the other one."""
    sizes = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    largest = F.max("n").over(Window.partitionBy(F.lit(0)))
    return sizes.withColumn("weight", largest / F.col("n"))


# Up to this many levels the codes of a category are broadcast.
FEW_LEVELS = 10_000
# Into so many ranges the levels are dealt to be numbered.
LEVEL_RANGES = 500


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(level, code): the levels as text, numbered in sorted order; a missing value is
    a level of its own, spelled "None". Levels are numbered within ranges between borders
    taken from them, and the sizes of the ranges before are added."""
    levels = df.select(_level(column).alias("level")).distinct()
    drawn = levels.orderBy(F.xxhash64("level"), "level").limit(LEVEL_RANGES - 1).collect()
    borders = F.array(*(F.lit(b) for b in sorted(r["level"] for r in drawn)))
    borders = borders.cast("array<string>")
    ranged = levels.withColumn("_range", slot_in(F.col("level"), borders, LEVEL_RANGES))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # One row per range.
    before = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_size")
    offsets = sizes.select(F.col("_range").alias("_of"), before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("level"))
    return (
        ranged.withColumn("_place", place)
        .join(F.broadcast(offsets), F.col("_range") == F.col("_of"))
        .select("level", (F.col("_before") + F.col("_place") - 1).cast("long").alias("code"))
    )


def with_category_code(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the code of each row's level. The rows stay where they are as long as the
    levels are few, which is checked."""
    few = df.select(column).distinct().limit(FEW_LEVELS + 1).count() <= FEW_LEVELS
    codes = category_codes(df, column).withColumnRenamed("code", out)
    joined = df.join(F.broadcast(codes) if few else codes, _level(column) == F.col("level"))
    return joined.drop("level")


def _level(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("None"))
