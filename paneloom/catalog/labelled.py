"""Labels, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paneloom.catalog.fixtures import (
    CATEGORIES,
    LABELS_SQL,
    NUMBERS,
    ORDERS,
    STATEMENTS_SQL,
    Query,
    customer_labels,
    n,
    r,
    rounded,
    statements,
    table,
)
from paneloom.catalog.panel import whole_customer_sql
from paneloom.operators.aggregate import customer_table
from paneloom.operators.labels import attach_target, join_labels, repeated_label_keys, unlabelled
from paneloom.operators.profile import target_balance
from paneloom.operators.split import (
    sample_per_class,
    sample_rows,
    sized_split,
    stratified_split,
)

KEY = ["o_custkey"]
SEED = 42

# Customers outside one market segment have a label, the others have none.
PARTIAL_SQL = """
    SELECT c_custkey AS o_custkey, CAST(c_acctbal < 0 AS INTEGER) AS target,
           c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'"""


def _partial_labels(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .where(F.col("c_mktsegment") != "BUILDING")
        .select(
            F.col("c_custkey").alias("o_custkey"),
            (F.col("c_acctbal") < 0).cast("int").alias("target"),
            "c_mktsegment",
        )
    )


def _inner(spark, sf_dir):
    customers = customer_table(statements(spark, sf_dir), ORDERS)
    return rounded(join_labels(customers, customer_labels(spark, sf_dir), ORDERS))


def _left(spark, sf_dir):
    rows = statements(spark, sf_dir).select("o_custkey", "o_orderkey", "sum_qty")
    return rounded(attach_target(rows, _partial_labels(spark, sf_dir), ORDERS))


def _loss(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    labels = _partial_labels(spark, sf_dir)
    return unlabelled(rows, labels, ORDERS).agg(F.count(F.lit(1)).alias("n_lost"))


def _repeated(spark, sf_dir):
    """Orders taken as labels: a customer with several orders has several."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.lit(1).alias("target"))
    return repeated_label_keys(orders, ORDERS)


_RANKED_SQL = f"""
    SELECT *, row_number() OVER (PARTITION BY target
                 ORDER BY md5(concat_ws('|', CAST(o_custkey AS VARCHAR), '{SEED}')), o_custkey) - 1 AS rank0,
              row_number() OVER (
                 ORDER BY md5(concat_ws('|', CAST(o_custkey AS VARCHAR), '{SEED}')), o_custkey) - 1 AS rank_all,
              count(*) OVER (PARTITION BY target) AS n_class, count(*) OVER () AS n_all
    FROM ({LABELS_SQL})"""

# Class sizes of the part: floors of the exact shares, then one more for the
# classes with the largest remainders until the total is met.
_QUOTA_SQL = f"""
    SELECT target AS t, low + CASE WHEN turn <= part - sum(low) OVER () THEN 1 ELSE 0 END AS quota
    FROM (
        SELECT target, part, floor(exact) AS low,
               row_number() OVER (ORDER BY exact - floor(exact) DESC, target) AS turn
        FROM (
            SELECT target, ceil(sum(c) OVER () * CAST(0.2 AS DOUBLE)) AS part,
                   ceil(sum(c) OVER () * CAST(0.2 AS DOUBLE)) * c / sum(c) OVER () AS exact
            FROM (SELECT target, count(*) AS c FROM ({LABELS_SQL}) GROUP BY target)
        )
    )"""


def _out(where: str) -> str:
    return f"SELECT o_custkey, {n('target', 'target')} FROM ({_RANKED_SQL}) WHERE {where}"


def _split(which: int):
    return lambda spark, sf_dir: rounded(
        stratified_split(customer_labels(spark, sf_dir), KEY, "target", 0.2, SEED)[which]
    )


def _sized(which: int, target):
    return lambda spark, sf_dir: rounded(
        sized_split(customer_labels(spark, sf_dir), KEY, target, 0.2, SEED)[which]
    )


def _balance(spark, sf_dir):
    train, valid = stratified_split(customer_labels(spark, sf_dir), KEY, "target", 0.2, SEED)
    return rounded(target_balance({"train": train, "valid": valid}, "target"))


_BALANCE_SQL = f"""
    SELECT part AS table_name, {n('count(*)', 'n_rows')}, {n('sum(target)', 'positives')},
           {r('avg(target)', 'rate')}
    FROM (SELECT CASE WHEN rank0 < n_class * CAST(0.2 AS DOUBLE) THEN 'valid' ELSE 'train' END AS part,
                 target FROM ({_RANKED_SQL}))
    GROUP BY part"""

QUERIES = {
    "label_inner_join": Query(
        _inner,
        f"SELECT f.*, {n('target', 'target')} FROM "
        f"({whole_customer_sql(ORDERS, STATEMENTS_SQL, NUMBERS, CATEGORIES)}) f "
        f"JOIN ({LABELS_SQL}) l ON f.o_custkey = l.o_custkey",
    ),
    "label_left_dropna": Query(
        _left,
        f"SELECT s.o_custkey, o_orderkey, {r('sum_qty', 'sum_qty')}, {n('target', 'target')} "
        f"FROM ({STATEMENTS_SQL}) s LEFT JOIN ({PARTIAL_SQL}) l ON s.o_custkey = l.o_custkey "
        "WHERE target IS NOT NULL",
    ),
    "label_loss": Query(
        _loss,
        f"SELECT count(*) AS n_lost FROM orders WHERE o_custkey NOT IN "
        f"(SELECT o_custkey FROM ({PARTIAL_SQL}))",
    ),
    "repeated_label_keys": Query(
        _repeated,
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    ),
    "stratified_split_train": Query(_split(0), _out("rank0 >= n_class * CAST(0.2 AS DOUBLE)")),
    "stratified_split_valid": Query(_split(1), _out("rank0 < n_class * CAST(0.2 AS DOUBLE)")),
    "split_balance": Query(_balance, _BALANCE_SQL),
    "sized_split_train": Query(
        _sized(0, "target"),
        f"SELECT o_custkey, {n('target', 'target')} FROM ({_RANKED_SQL}) "
        f"JOIN ({_QUOTA_SQL}) ON t = target WHERE rank0 >= quota",
    ),
    "sized_split_valid": Query(
        _sized(1, "target"),
        f"SELECT o_custkey, {n('target', 'target')} FROM ({_RANKED_SQL}) "
        f"JOIN ({_QUOTA_SQL}) ON t = target WHERE rank0 < quota",
    ),
    "plain_split": Query(
        _sized(1, None), _out("rank_all < ceil(n_all * CAST(0.2 AS DOUBLE))")
    ),
    "sample_n": Query(
        lambda spark, sf_dir: rounded(
            sample_rows(customer_labels(spark, sf_dir), KEY, 500, SEED)
        ),
        _out("rank_all < 500"),
    ),
    "sample_per_class": Query(
        lambda spark, sf_dir: rounded(
            sample_per_class(customer_labels(spark, sf_dir), KEY, "target", 100, SEED)
        ),
        _out("rank0 < 100"),
    ),
}
