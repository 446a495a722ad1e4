"""One wide row per customer.

Numbers and categories are aggregated apart, so each shuffles only its own
columns, and joined on the key both are already partitioned by.

Numbers travel as one array per row. After the window the array is exploded to
(customer, feature) rows, where the same eighteen aggregates serve every
feature; the groups of a customer then fold into one array from which the wide
columns are read. The generated code therefore does not grow with the number of
features, and none of this needs a second shuffle.

Distinct values of a category are counted from a set: an ordinary customer has
at most ``max_rows`` of them. Customers above that, and rows without a customer,
take the sliced path: pre-aggregated per slice, distinct values by grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from paneloom.functions import ieee_divide
from paneloom.operators.slices import HALO, LAST_SLICE, MAX_ROWS, SLICE, hot_customers
from paneloom.operators.temporal import BEFORE, BEFORE2, FIRST, LAST, ROW, changed, look_back
from paneloom.spec import CHANGED_SUFFIX, DIFF_SUFFIX, PanelSpec, require_columns

# Added to a mean before dividing by it (fixed value).
RATIO_OFFSET = 1e-5

# Endings of the output columns.
CATEGORY_SUFFIXES = ("_first", "_last", "_nunique", "_count")
FLAG_SUFFIXES = ("_total_changes", "_change_frequency", "_changed_recently")
NUMBER_SUFFIXES = (
    "_mean", "_std", "_min", "_max", "_last",
    "_total_delta", "_trend_ratio", "_pos_ratio", "_avg_monthly_slope",
)


def _at(flag: str, value: Column) -> Column:
    """The value in the flagged row, null included: one row per customer has the flag."""
    return F.max(F.when(F.col(flag), value))


def _rises(now: Column, before: Column) -> Column:
    return F.coalesce(now > before, F.lit(False)).cast("double")


# --- numbers -----------------------------------------------------------------


def _family_types(df: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """Whole numbers stay whole; all other numbers are doubles."""
    whole = [c for c in names if isinstance(df.schema[c].dataType, T.IntegralType)]
    families = {"long": whole, "double": [c for c in names if c not in whole]}
    return {kind: members for kind, members in families.items() if members}


def _base_and_trend(value: str, ups: str, kind: str, first_is_null: bool) -> list[Column]:
    """The nine features of one number, named by suffix. A difference is null in
    every first row, so its delta and slope are null by definition."""
    c = F.col(value)
    mean, last = F.avg(c), _at(LAST, c)
    delta = last - _at(FIRST, c)
    slope = F.try_divide(delta, F.count(c))
    if first_is_null:
        delta = slope = F.lit(None).cast(kind)
    return [
        mean.alias("_mean"),
        F.stddev_samp(c).alias("_std"),
        F.min(c).alias("_min"),
        F.max(c).alias("_max"),
        last.alias("_last"),
        delta.alias("_total_delta"),
        ieee_divide(last.cast("double"), mean + F.lit(RATIO_OFFSET)).alias("_trend_ratio"),
        F.avg(ups).alias("_pos_ratio"),
        slope.cast("double").alias("_avg_monthly_slope"),
    ]


def _numbers(
    rows: DataFrame, spec: PanelSpec, names: list[str], kind: str, hot: bool
) -> DataFrame:
    """Key and the wide features of all numbers of one type."""
    extra = [SLICE, LAST_SLICE, HALO] if hot else []
    packed = rows.select(
        spec.key, *spec.position, *extra, F.array(*(F.col(c).cast(kind) for c in names)).alias("x")
    )
    looked = look_back(packed, spec, 2, hot).select(
        spec.key,
        FIRST,
        LAST,
        F.col(f"{BEFORE}.x").alias("_b"),
        F.col(f"{BEFORE2}.x").alias("_bb"),
        F.posexplode(f"{ROW}.x").alias("_f", "_x"),
    )
    before, before2 = F.get("_b", F.col("_f")), F.get("_bb", F.col("_f"))
    features = (
        looked.select(spec.key, "_f", FIRST, LAST, "_x", before.alias("_p"), before2.alias("_pp"))
        .withColumn("_d", F.col("_x") - F.col("_p"))
        .withColumn("_up", _rises(F.col("_x"), F.col("_p")))
        .withColumn("_up_d", _rises(F.col("_d"), F.col("_p") - F.col("_pp")))
        .groupBy(spec.key, "_f")
        .agg(
            F.struct(*_base_and_trend("_x", "_up", kind, False)).alias("_of_x"),
            F.struct(*_base_and_trend("_d", "_up_d", kind, True)).alias("_of_d"),
        )
        .groupBy(spec.key)
        .agg(F.sort_array(F.collect_list(F.struct("_f", "_of_x", "_of_d"))).alias("_all"))
    )
    # As SQL text: thousands of short expressions are parsed faster than built.
    columns = [f"`{spec.key}`"]
    for i, c in enumerate(names):
        columns += [f"_all[{i}]._of_x.{s} AS `{c}{s}`" for s in NUMBER_SUFFIXES]
        columns += [f"_all[{i}]._of_d.{s} AS `{c}{DIFF_SUFFIX}{s}`" for s in NUMBER_SUFFIXES]
    return features.selectExpr(*columns)


# --- categories --------------------------------------------------------------


def _category(name: str, nunique: bool) -> list[Column]:
    c = F.col(name)
    out = [
        _at(FIRST, c).alias(f"{name}_first"),
        _at(LAST, c).alias(f"{name}_last"),
        F.count(c).alias(f"{name}_count"),
    ]
    if nunique:
        # A missing value counts as one more level.
        distinct = F.size(F.collect_set(c)) + F.max(c.isNull().cast("int"))
        out.append(distinct.cast("long").alias(f"{name}_nunique"))
    return out


def _flag(name: str) -> list[Column]:
    c = F.col(name)
    return [
        F.sum(c).alias(f"{name}_total_changes"),
        F.avg(c).alias(f"{name}_change_frequency"),
        _at(LAST, c).alias(f"{name}_changed_recently"),
    ]


def _categories(rows: DataFrame, spec: PanelSpec, names: list[str], hot: bool) -> DataFrame:
    extra = [SLICE, LAST_SLICE, HALO] if hot else []
    looked = look_back(rows.select(spec.key, *spec.position, *extra, *names), spec, 1, hot)
    flat = looked.select(
        spec.key,
        FIRST,
        LAST,
        *(F.col(f"{ROW}.`{c}`").alias(c) for c in names),
        *(changed(c).alias(c + CHANGED_SUFFIX) for c in names),
    )
    expressions = []
    for c in names:
        expressions += _category(c, nunique=not hot) + _flag(c + CHANGED_SUFFIX)
    return flat.groupBy(spec.key).agg(*expressions)


def _distinct_levels(rows: DataFrame, spec: PanelSpec, names: list[str]) -> DataFrame:
    """Distinct values per customer and category, however many there are."""
    levels = F.array(
        *(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in names)
    )
    return (
        rows.select(spec.key, F.explode(levels).alias("_l"))
        .select(spec.key, "_l.c", "_l.v")
        .distinct()
        .groupBy(spec.key)
        .agg(*(F.count(F.when(F.col("c") == c, 1)).alias(f"{c}_nunique") for c in names))
    )


# --- the table ---------------------------------------------------------------


def output_columns(df: DataFrame, spec: PanelSpec, null_differences: bool = True) -> list[str]:
    """Names of the customer table's columns, in order."""
    names = [spec.key]
    for c in [c for c in df.columns if c not in (spec.key, *spec.position)]:
        suffixes = CATEGORY_SUFFIXES if c in spec.categoricals else NUMBER_SUFFIXES
        names += [c + s for s in suffixes]
    for c in spec.numerics(df):
        names += [
            c + DIFF_SUFFIX + s
            for s in NUMBER_SUFFIXES
            if null_differences or s not in ("_total_delta", "_avg_monthly_slope")
        ]
    for c in spec.present_categoricals(df):
        names += [c + CHANGED_SUFFIX + s for s in FLAG_SUFFIXES]
    return names


def _joined(parts: list[DataFrame], key: str, null_safe: bool) -> DataFrame:
    table = parts[0]
    for i, part in enumerate(parts[1:]):
        if null_safe:
            other = part.withColumnRenamed(key, f"_key{i}")
            table = table.join(other, table[key].eqNullSafe(other[f"_key{i}"]))
        else:
            table = table.join(part, key)
    return table


def customer_table(
    statements: DataFrame,
    spec: PanelSpec,
    max_rows: int | None = MAX_ROWS,
    null_differences: bool = True,
) -> DataFrame:
    """The customer table: 4 columns per category, 3 per change flag, 9 per number
    and per difference. ``null_differences=False`` leaves out the delta and slope
    of differences, which are always null."""
    require_columns(statements, [spec.key, *spec.position], "statement table")
    families = _family_types(statements, spec.numerics(statements))
    categories = spec.present_categoricals(statements)
    names = output_columns(statements, spec, null_differences)
    hot = hot_customers(statements, spec, max_rows)

    def table(rows: DataFrame, sliced: bool) -> DataFrame:
        parts = [_numbers(rows, spec, members, kind, sliced) for kind, members in families.items()]
        if categories:
            parts.append(_categories(rows, spec, categories, sliced))
        if categories and sliced:
            parts.append(_distinct_levels(hot.rows(statements, spec), spec, categories))
        if not parts:
            return rows.select(spec.key).distinct()
        return _joined(parts, spec.key, null_safe=sliced).select(*names)

    if hot is None:
        return table(statements, False)
    return table(hot.ordinary(statements, spec), False).unionByName(
        table(hot.sliced(statements, spec), True)
    )
