"""Files: CSV to Parquet and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneloom.catalog.fixtures import NUMBERS, STATEMENTS_SQL, Query, r, rounded, statements
from paneloom.session import new_shared_path
from paneloom.sources.files import audit_csv, csv_to_parquet

COLUMNS = ["o_custkey", "o_orderkey", *NUMBERS, "o_orderstatus", "o_orderpriority"]
SCHEMA = (
    "o_custkey bigint, o_orderkey bigint, "
    + ", ".join(f"{c} double" for c in NUMBERS)
    + ", o_orderstatus string, o_orderpriority string"
)


def _converted(spark, sf_dir):
    """The statements written as CSV and converted with a declared schema."""
    csv = new_shared_path(spark, "csv")
    statements(spark, sf_dir).select(*COLUMNS).write.option("header", True).csv(csv)
    return rounded(csv_to_parquet(spark, csv, new_shared_path(spark, "parquet"), SCHEMA))


def _bad_lines(spark, sf_dir):
    """Written statements of which some lines are short, some long, some hold text for a
    number."""
    csv, order = new_shared_path(spark, "csv"), F.col("o_orderkey")
    line = F.to_csv(F.struct(*COLUMNS))
    lines = statements(spark, sf_dir).select(
        F.when(order % 7 == 0, F.substring_index(line, ",", 3))
        .when(order % 11 == 0, F.concat(line, F.lit(",more")))
        .when(order % 13 == 0, F.concat(F.lit("no number "), line))
        .otherwise(line)
        .alias(",".join(COLUMNS))
    )
    lines.write.option("header", True).option("sep", "\x01").csv(csv)
    return csv


def _with_bad_lines(spark, sf_dir):
    csv = _bad_lines(spark, sf_dir)
    return rounded(csv_to_parquet(spark, csv, new_shared_path(spark, "parquet"), SCHEMA, True))


def _rejects(spark, sf_dir):
    """The order and cause of every rejected line."""
    rejected = audit_csv(spark, _bad_lines(spark, sf_dir), SCHEMA).rejected
    order = F.split("text", ",")[1].cast("long")
    return rejected.select(order.alias("o_orderkey"), "cause")


def _audit(spark, sf_dir):
    """How many lines of all files there are, and what becomes of them."""
    counts = audit_csv(spark, _bad_lines(spark, sf_dir), SCHEMA).counts
    return counts.agg(
        *(F.sum(c).alias(c) for c in ("blank", "accepted", "rejected")),
        F.sum(F.col("lines") - F.col("headers")).alias("rows"),
    )


def _inferred(spark, sf_dir):
    csv = new_shared_path(spark, "csv")
    statements(spark, sf_dir).select(*COLUMNS).write.option("header", True).csv(csv)
    return rounded(csv_to_parquet(spark, csv, new_shared_path(spark, "parquet")))


_SQL = (
    "SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, "
    + ", ".join(r(c, c) for c in NUMBERS)
    + f" FROM ({STATEMENTS_SQL})"
)

_BAD = "o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0"

QUERIES = {
    "csv_to_parquet": Query(_converted, _SQL),
    "csv_tolerant": Query(
        _with_bad_lines,
        f"{_SQL} WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0",
    ),
    "csv_rejects": Query(
        _rejects,
        f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'too few fields' "
        f"WHEN o_orderkey % 11 = 0 THEN 'too many fields' ELSE 'o_custkey is no bigint' END AS cause "
        f"FROM ({STATEMENTS_SQL}) WHERE {_BAD}",
    ),
    "csv_audit": Query(
        _audit,
        f"SELECT CAST(0 AS BIGINT) AS blank, count(*) FILTER (NOT ({_BAD})) AS accepted, "
        f"count(*) FILTER ({_BAD}) AS rejected, count(*) AS rows FROM ({STATEMENTS_SQL})",
    ),
    "csv_inferred": Query(_inferred, _SQL),
}
