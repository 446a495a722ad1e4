"""What is in a table: schema, counts, missing values, levels, balance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from paneloom.spec import column_groups, feature_name, union_all

# Type names as the schema report spells them.
TYPE_NAMES = {
    "double": "DOUBLE", "float": "FLOAT", "bigint": "BIGINT", "int": "INTEGER",
    "smallint": "SMALLINT", "tinyint": "TINYINT", "string": "VARCHAR", "date": "DATE",
    "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN", "binary": "BLOB",
}


# --- schema and counts -------------------------------------------------------


def describe(df: DataFrame) -> DataFrame:
    """One row per column: name, type, nullability; further fields are empty."""
    rows = [
        (
            f.name,
            TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()),
            "YES" if f.nullable else "NO",
        )
        for f in df.schema
    ]
    out = df.sparkSession.createDataFrame(rows, "column_name string, column_type string, `null` string")
    empty = F.lit(None).cast("string")
    return out.select("*", empty.alias("key"), empty.alias("default"), empty.alias("extra"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of several tables."""
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
            )
            for name, df in tables.items()
        ]
    )


def rows_per_file(df: DataFrame) -> DataFrame:
    """Rows read from each file of a scan."""
    return df.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def distinct_count(df: DataFrame, column: str, relative_error: float | None = None) -> DataFrame:
    """Distinct non-null values; estimated when an error is allowed."""
    if relative_error is None:
        count = F.count_distinct(F.col(column))
    else:
        count = F.approx_count_distinct(column, relative_error)
    return df.agg(count.alias("n_distinct"))


def target_balance(tables: dict[str, DataFrame], target: str) -> DataFrame:
    """Rows, positives and positive share of several tables."""
    return union_all(
        [
            df.agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.sum(F.col(target).cast("long")).alias("positives"),
                F.avg(target).alias("rate"),
            ).select(F.lit(name).alias("table_name"), "*")
            for name, df in tables.items()
        ]
    )


# From this many target values on, the task is a regression.
REGRESSION_FROM = 50


def task_type(df: DataFrame, target: str) -> DataFrame:
    """binary, multiclass or regression, from the number of target values."""
    # Counting stops being interesting at the limit, so no more values are kept.
    values = df.select(target).where(F.col(target).isNotNull()).distinct().limit(REGRESSION_FROM)
    n = F.col("n_values")
    return values.agg(F.count(F.lit(1)).alias("n_values")).select(
        F.when(n == 2, "binary")
        .when(n < REGRESSION_FROM, "multiclass")
        .otherwise("regression")
        .alias("task")
    )


# --- per column --------------------------------------------------------------


def to_long(one_row: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """A one-row aggregate with columns ``<field>|<name>`` as one row per name.

    ``fields`` maps each field to its type.
    """
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            *(F.col(f"`{field}|{name}`").cast(kind).alias(field) for field, kind in fields.items()),
        )
        for name in names
    ]
    return one_row.select(F.inline(F.array(*entries)))


def null_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of missing values per column; every column is read once."""
    rows = []
    for group in column_groups(columns):
        shares = (
            df.select(*group)
            .agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in group))
            .first()
        )
        rows += [(c, shares[c]) for c in group]
    return df.sparkSession.createDataFrame(rows, "feature string, null_share double")


def _family(kind: T.DataType) -> str:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(kind, T.IntegralType):
        return "long"
    return "string"


def value_counts(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """(feature, value, n) per value type, nulls included; the feature is a number.

    Values keep their own type (doubles, whole numbers, text), so that equal
    means equal. Rows are counted before the shuffle, so a value that fills a
    third of the table is one row per task.
    """
    families: dict[str, list[str]] = {}
    for c in columns:
        families.setdefault(_family(df.schema[c].dataType), []).append(c)
    counts = {}
    for kind, members in families.items():
        entries = [
            F.struct(F.lit(i).alias("feature"), F.col(c).cast(kind).alias("value"))
            for i, c in enumerate(columns)
            if c in members
        ]
        counts[kind] = (
            df.select(F.inline(F.array(*entries)))
            .groupBy("feature", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
    return counts


def value_profile(df: DataFrame, columns: list[str], null_is_value: bool = False) -> DataFrame:
    """(feature, n_rows, n_null, n_unique, mode_share) with exact numbers.

    ``n_unique`` leaves out nulls. The most frequent value counts nulls only when
    ``null_is_value``; its share is always of all rows.
    """
    known = F.col("value").isNotNull()
    top = F.col("n") if null_is_value else F.when(known, F.col("n"))
    parts = [
        counts.groupBy("feature").agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"),
            F.count(F.when(known, 1)).alias("n_unique"),
            (F.max(top) / F.sum("n")).alias("mode_share"),
        )
        for counts in value_counts(df, columns).values()
    ]
    return union_all(parts).withColumn("feature", feature_name(columns))


@dataclass(frozen=True)
class Estimates:
    """One reading of all columns: rows, known values, and estimates of the distinct
    values and of the median of numbers."""

    n_rows: int
    known: dict[str, int]
    distinct: dict[str, int]
    median: dict[str, object]


DISTINCT_ERROR = 0.02


def _is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def estimates(df: DataFrame, columns: list[str], distinct_of: list[str] = ()) -> Estimates:
    """Estimates of distinct values cost most and are made on demand."""
    wanted = set(distinct_of)
    n_rows, known, distinct, median = 0, {}, {}, {}
    for group in column_groups(columns):
        row = df.select(*group).agg(
            F.count(F.lit(1)).alias("n"),
            *(F.count(c).alias(f"known|{c}") for c in group),
            *(
                F.approx_count_distinct(c, DISTINCT_ERROR).alias(f"distinct|{c}")
                for c in group
                if c in wanted
            ),
            *(
                F.percentile_approx(F.col(c), F.lit(0.5), F.lit(1000)).alias(f"median|{c}")
                for c in group
                if _is_number(df, c)
            ),
        ).first()
        n_rows = row["n"]
        known |= {c: row[f"known|{c}"] for c in group}
        distinct |= {c: row[f"distinct|{c}"] for c in group if c in wanted}
        median |= {c: row[f"median|{c}"] for c in group if _is_number(df, c)}
    return Estimates(n_rows, known, distinct, median)


def dominant_value(
    df: DataFrame, columns: list[str], about: Estimates | None = None, exact: bool = False
) -> DataFrame:
    """(feature, n_rows, n_null, n_top) without a shuffle of the numbers.

    ``n_top`` is the exact number of rows of the most frequent value whenever that
    value holds more than 60 % of the known rows, which is what constancy filters
    ask; below that it is a lower bound. Such a value must be the approximate
    median, so one pass finds the candidate of each number and a second pass counts
    it. Text has no median; its columns are counted value by value, and with ``exact``
    those of numbers too.
    """
    about = estimates(df, columns) if about is None else about
    numbers = [] if exact else [c for c in columns if c in about.median]
    others = [c for c in columns if c not in numbers]

    types = {f.name: f.dataType for f in df.schema}

    def held(c: str) -> Column:
        middle = about.median[c]
        if middle is None:
            return F.lit(0)
        return F.count(F.when(F.col(c) == F.lit(middle).cast(types[c]), 1))

    parts = []
    if numbers:
        rows = []
        for group in column_groups(numbers):
            top = df.select(*group).agg(*(held(c).alias(c) for c in group)).first()
            rows += [(c, about.n_rows, about.n_rows - about.known[c], top[c]) for c in group]
        parts.append(
            df.sparkSession.createDataFrame(
                rows, "feature string, n_rows long, n_null long, n_top long"
            )
        )
    if others:
        profile = value_profile(df, others)
        top = F.coalesce(F.round(F.col("mode_share") * F.col("n_rows")), F.lit(0))
        parts.append(profile.select("feature", "n_rows", "n_null", top.cast("long").alias("n_top")))
    return union_all(parts)
