"""Panel tables made from the sample star schema, in Spark and in SQL.

Statements: orders with sums over their line items, one row per (customer, order
date, order). Orders without line items give missing numbers, the priority
"4-NOT SPECIFIED" gives a missing category, and some customers order twice a day.
Sums of prices are rounded here, so that comparisons of consecutive values do
not depend on the order of addition.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from paneloom.spec import PanelSpec

PLACES = 6

ORDERS = PanelSpec(
    key="o_custkey",
    order="o_orderdate",
    tie=("o_orderkey",),
    categoricals=("o_orderstatus", "o_orderpriority"),
)
EVENTS = PanelSpec(
    key="user_id", order="ts", tie=("event_id",), categoricals=("event_type",)
)
NUMBERS = ["o_totalprice", "sum_qty", "sum_price", "max_disc", "max_tax"]
CATEGORIES = ["o_orderstatus", "o_orderpriority"]


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_price"),
            F.max("l_discount").alias("max_disc"),
            F.max("l_tax").alias("max_tax"),
        )
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        "o_custkey",
        "o_orderdate",
        "o_orderkey",
        *NUMBERS,
        "o_orderstatus",
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"),
    )


STATEMENTS_SQL = """
    SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice,
           sum_qty, sum_price, max_disc, max_tax, o_orderstatus,
           nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority
    FROM orders LEFT JOIN (
        SELECT l_orderkey, sum(l_quantity) AS sum_qty,
               round(sum(l_extendedprice), 2) AS sum_price,
               max(l_discount) AS max_disc,
               max(l_tax) AS max_tax
        FROM lineitem GROUP BY l_orderkey
    ) ON o_orderkey = l_orderkey"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", "value", "event_type"
    )


def customer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        (F.col("c_acctbal") < 0).cast("int").alias("target"),
    )


LABELS_SQL = """
    SELECT c_custkey AS o_custkey, CAST(c_acctbal < 0 AS INTEGER) AS target FROM customer"""


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with columns every screening rule should notice, and a target."""
    s = statements(spark, sf_dir)
    big = F.col("o_totalprice")
    return s.select(
        "o_orderkey",
        *NUMBERS,
        (F.col("sum_qty") * 3).alias("qty_triple"),
        F.lit(1.0).alias("constant"),
        F.lit(None).cast("double").alias("empty"),
        F.when(F.col("sum_qty") > 300, 1.0).otherwise(0.0).alias("nearly_constant"),
        F.when(big > 480000, F.col("sum_qty")).alias("sparse"),
        *CATEGORIES,
        # Explained in part by what the models see.
        (F.coalesce("sum_qty", F.lit(0.0)) + big / 4000 > 170).cast("int").alias("target"),
    )


SCREENED_NUMBERS = [
    *NUMBERS, "qty_triple", "constant", "empty", "nearly_constant", "sparse",
]
SCREENED_COLUMNS = ["o_orderkey", *SCREENED_NUMBERS, *CATEGORIES]
SCREENED_SQL = f"""
    SELECT o_orderkey, o_totalprice, sum_qty, sum_price, max_disc, max_tax,
           sum_qty * 3 AS qty_triple, CAST(1 AS DOUBLE) AS constant,
           CAST(NULL AS DOUBLE) AS empty,
           CASE WHEN sum_qty > 300 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS nearly_constant,
           CASE WHEN o_totalprice > 480000 THEN sum_qty END AS sparse,
           o_orderstatus, o_orderpriority,
           CAST(coalesce(sum_qty, 0) + o_totalprice / 4000 > 170 AS INTEGER) AS target
    FROM ({STATEMENTS_SQL})"""


# --- comparable output -------------------------------------------------------


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles rounded (and without negative zero), whole numbers as bigint."""

    def shown(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(c, places) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.IntegralType):
            return c.cast("long").alias(f.name)
        return c

    return df.select(*(shown(f) for f in df.schema))


def r(expression: str, name: str, places: int = PLACES) -> str:
    return f"round(CAST({expression} AS DOUBLE), {places}) + 0.0 AS {name}"


def n(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"
