"""Schema, counts and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.catalog.fixtures import (
    LABELS_SQL,
    ORDERS,
    SCREENED_COLUMNS,
    SCREENED_NUMBERS,
    SCREENED_SQL,
    STATEMENTS_SQL,
    Query,
    customer_labels,
    n,
    r,
    rounded,
    screened,
    statements,
    table,
)
from paneloom.operators.aggregate import customer_table
from paneloom.operators.profile import (
    describe,
    distinct_count,
    dominant_value,
    null_share,
    row_counts,
    rows_per_file,
    target_balance,
    task_type,
    value_profile,
)


def _schema_report(spark, sf_dir):
    """Schema of the distinct statements with the missing share of each column."""
    rows = statements(spark, sf_dir).distinct()
    shares = null_share(rows, rows.columns)
    report = describe(rows).select("column_name", "column_type")
    return rounded(report.join(shares, F.col("column_name") == F.col("feature")).drop("feature"))


def _schema_sql() -> str:
    types = {
        "o_custkey": "BIGINT", "o_orderdate": "TIMESTAMP", "o_orderkey": "BIGINT",
        "o_totalprice": "DOUBLE", "sum_qty": "DOUBLE", "sum_price": "DOUBLE",
        "max_disc": "DOUBLE", "max_tax": "DOUBLE", "o_orderstatus": "VARCHAR",
        "o_orderpriority": "VARCHAR",
    }
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS column_type, "
        f"{r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 'null_share')} "
        f"FROM (SELECT DISTINCT * FROM ({STATEMENTS_SQL}))"
        for c, kind in types.items()
    )


def _row_counts(spark, sf_dir):
    s = statements(spark, sf_dir)
    return rounded(
        row_counts(
            {
                "statements": s,
                "labels": customer_labels(spark, sf_dir),
                "customers": customer_table(s, ORDERS),
            }
        )
    )


def _files(spark, sf_dir):
    return rows_per_file(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _distinct_rows(spark, sf_dir):
    cols = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return table(spark, sf_dir, "orders").select(*cols).distinct()


def _per_column_sql(template: str, columns) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


_PROFILE_SQL = (
    "SELECT '{c}' AS feature, "
    + n("count(*)", "n_rows")
    + ", "
    + n("count(*) - count({c})", "n_null")
    + ", "
    + n("count(DISTINCT {c})", "n_unique")
    + ", "
    + r(
        "(SELECT max(k) FROM (SELECT count({c}) AS k FROM (" + SCREENED_SQL + ") GROUP BY {c}))"
        " / CAST(count(*) AS DOUBLE)",
        "mode_share",
    )
    + " FROM ("
    + SCREENED_SQL
    + ")"
)


def _value_profile(spark, sf_dir):
    p = value_profile(screened(spark, sf_dir), SCREENED_COLUMNS)
    # A column without values has no most frequent one.
    return rounded(p.fillna(0.0, ["mode_share"]))


_MODE_SQL = (
    "SELECT '{c}' AS feature, "
    + r(
        "(SELECT max(k) FROM (SELECT count(*) AS k FROM (" + SCREENED_SQL + ") GROUP BY {c}))"
        " / CAST(count(*) AS DOUBLE)",
        "mode_share",
    )
    + " FROM ("
    + SCREENED_SQL
    + ")"
)


def _dominant(spark, sf_dir):
    """Columns where one value holds more than 60 % of the known rows."""
    d = dominant_value(screened(spark, sf_dir), SCREENED_COLUMNS)
    return d.where(F.col("n_top") > 0.6 * (F.col("n_rows") - F.col("n_null")))


_DOMINANT_SQL = (
    "SELECT feature, n_rows, n_null, n_top FROM ("
    + _per_column_sql(
        "SELECT '{c}' AS feature, "
        + n("count(*)", "n_rows")
        + ", "
        + n("count(*) - count({c})", "n_null")
        + ", "
        + n(
            "(SELECT max(k) FROM (SELECT count({c}) AS k FROM (" + SCREENED_SQL + ") GROUP BY {c}))",
            "n_top",
        )
        + " FROM ("
        + SCREENED_SQL
        + ")",
        SCREENED_COLUMNS,
    )
    + ") WHERE n_top > 0.6 * (n_rows - n_null)"
)


def _tasks(spark, sf_dir):
    labels = customer_labels(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    parts = [
        task_type(labels, "target").withColumn("target", F.lit("acctbal_below_zero")),
        task_type(orders, "o_orderpriority").withColumn("target", F.lit("o_orderpriority")),
        task_type(orders, "o_totalprice").withColumn("target", F.lit("o_totalprice")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _task_sql(name: str, column: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS target, CASE WHEN count(DISTINCT {column}) = 2 THEN 'binary' "
        f"WHEN count(DISTINCT {column}) < 50 THEN 'multiclass' ELSE 'regression' END AS task "
        f"FROM {source}"
    )


QUERIES = {
    "schema_report": Query(_schema_report, _schema_sql()),
    "row_count": Query(
        _row_counts,
        f"SELECT 'statements' AS table_name, {n('count(*)', 'n_rows')}, {n('10', 'n_columns')} FROM orders "
        f"UNION ALL SELECT 'labels', {n('count(*)', 'n_rows')}, {n('2', 'n_columns')} FROM customer "
        f"UNION ALL SELECT 'customers', {n('count(DISTINCT o_custkey)', 'n_rows')}, "
        f"{n('105', 'n_columns')} FROM orders",
    ),
    "rows_per_file": Query(
        _files, "SELECT 'orders.parquet' AS file_name, count(*) AS n_rows FROM orders"
    ),
    "distinct_rows": Query(
        _distinct_rows, "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders"
    ),
    "distinct_customers": Query(
        lambda spark, sf_dir: distinct_count(table(spark, sf_dir, "orders"), "o_custkey"),
        "SELECT count(DISTINCT o_custkey) AS n_distinct FROM orders",
    ),
    "null_share": Query(
        lambda spark, sf_dir: rounded(null_share(screened(spark, sf_dir), SCREENED_COLUMNS)),
        _per_column_sql(
            "SELECT '{c}' AS feature, "
            + r("avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", "null_share")
            + " FROM (" + SCREENED_SQL + ")",
            SCREENED_COLUMNS,
        ),
    ),
    "value_profile": Query(_value_profile, _per_column_sql(_PROFILE_SQL, SCREENED_COLUMNS)),
    "mode_share_with_nulls": Query(
        lambda spark, sf_dir: rounded(
            value_profile(screened(spark, sf_dir), SCREENED_NUMBERS, null_is_value=True).select(
                "feature", "mode_share"
            )
        ),
        _per_column_sql(_MODE_SQL, SCREENED_NUMBERS),
    ),
    "dominant_value": Query(_dominant, _DOMINANT_SQL),
    "target_balance": Query(
        lambda spark, sf_dir: rounded(
            target_balance({"labels": customer_labels(spark, sf_dir)}, "target")
        ),
        f"SELECT 'labels' AS table_name, {n('count(*)', 'n_rows')}, {n('sum(target)', 'positives')}, "
        f"{r('avg(target)', 'rate')} FROM ({LABELS_SQL})",
    ),
    "task_type": Query(
        _tasks,
        " UNION ALL ".join(
            [
                _task_sql("acctbal_below_zero", "target", f"({LABELS_SQL})"),
                _task_sql("o_orderpriority", "o_orderpriority", "orders"),
                _task_sql("o_totalprice", "o_totalprice", "orders"),
            ]
        ),
    ),
}
