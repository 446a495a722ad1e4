"""Temporal features and the customer table."""

from __future__ import annotations

from paneloom.catalog.fixtures import (
    CATEGORIES,
    EVENTS,
    NUMBERS,
    ORDERS,
    STATEMENTS_SQL,
    Query,
    events,
    n,
    r,
    rounded,
    statements,
)
from paneloom.operators.aggregate import (
    CATEGORY_SUFFIXES,
    FLAG_SUFFIXES,
    NUMBER_SUFFIXES,
    customer_table,
)
from paneloom.operators.temporal import temporal_table

BASE = ("_mean", "_std", "_min", "_max", "_last")
TREND = ("_total_delta", "_trend_ratio", "_pos_ratio", "_avg_monthly_slope")
EVENTS_SQL = "SELECT user_id, ts, event_id, value, event_type FROM events"


# --- SQL ---------------------------------------------------------------------


def _window(spec) -> str:
    return f"(PARTITION BY {spec.key} ORDER BY {', '.join(spec.position)})"


def temporal_sql(spec, source: str, numbers, categories) -> str:
    """Statements with differences, change flags, row places and rises."""
    w = _window(spec)
    diffs = [f"{c} - lag({c}) OVER {w} AS {c}_diff1" for c in numbers]
    flags = [
        f"CASE WHEN {c} <> lag({c}) OVER {w} THEN 1 ELSE 0 END AS {c}_changed"
        for c in categories
    ]
    return f"""
    SELECT *, {', '.join(diffs + flags)},
           row_number() OVER {w} AS rn, count(*) OVER (PARTITION BY {spec.key}) AS cnt
    FROM ({source})"""


def rises_sql(spec, source: str, numbers, categories) -> str:
    w = _window(spec)
    columns = [*numbers, *(f"{c}_diff1" for c in numbers)]
    ups = [
        f"CASE WHEN coalesce({c} - lag({c}) OVER {w}, 0) > 0 THEN 1 ELSE 0 END AS {c}_up"
        for c in columns
    ]
    return f"SELECT *, {', '.join(ups)} FROM ({temporal_sql(spec, source, numbers, categories)})"


def _first(c: str) -> str:
    return f"max(CASE WHEN rn = 1 THEN {c} END)"


def _last(c: str) -> str:
    return f"max(CASE WHEN rn = cnt THEN {c} END)"


def number_sql(c: str, suffixes) -> list[str]:
    delta = f"({_last(c)} - {_first(c)})"
    if c.endswith("_diff1"):
        delta = f"(CASE WHEN false THEN {_last(c)} END)"
    ratio = f"avg({c}) + CAST(0.00001 AS DOUBLE)"
    every = {
        "_mean": f"avg({c})",
        "_std": f"stddev_samp({c})",
        "_min": f"min({c})",
        "_max": f"max({c})",
        "_last": _last(c),
        "_total_delta": delta,
        "_trend_ratio": f"{_last(c)} / ({ratio})",
        "_pos_ratio": f"avg({c}_up)",
        "_avg_monthly_slope": f"{delta} / nullif(count({c}), 0)",
    }
    return [r(every[s], c + s) for s in suffixes]


def category_sql(c: str) -> list[str]:
    missing = f"max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
    return [
        f"{_first(c)} AS {c}_first",
        f"{_last(c)} AS {c}_last",
        n(f"count(DISTINCT {c}) + {missing}", f"{c}_nunique"),
        n(f"count({c})", f"{c}_count"),
    ]


def flag_sql(c: str) -> list[str]:
    f = f"{c}_changed"
    return [
        n(f"sum({f})", f"{f}_total_changes"),
        r(f"avg({f})", f"{f}_change_frequency"),
        n(_last(f), f"{f}_changed_recently"),
    ]


def customer_sql(spec, source, numbers, categories, columns: list[str]) -> str:
    return (
        f"SELECT {spec.key}, {', '.join(columns)} "
        f"FROM ({rises_sql(spec, source, numbers, categories)}) GROUP BY {spec.key}"
    )


def whole_customer_sql(spec, source, numbers, categories) -> str:
    columns = []
    for c in numbers:
        columns += number_sql(c, NUMBER_SUFFIXES) + number_sql(f"{c}_diff1", NUMBER_SUFFIXES)
    for c in categories:
        columns += category_sql(c) + flag_sql(c)
    return customer_sql(spec, source, numbers, categories, columns)


# --- queries -----------------------------------------------------------------


def _temporal(columns):
    def run(spark, sf_dir):
        t = temporal_table(statements(spark, sf_dir), ORDERS)
        return rounded(t.select("o_orderkey", "o_custkey", *columns))

    return run


def _customers(columns):
    """Some columns of the customer table; Spark prunes the others."""

    def run(spark, sf_dir):
        return rounded(customer_table(statements(spark, sf_dir), ORDERS).select("o_custkey", *columns))

    return run


def _part(names, suffixes):
    return [c + s for c in names for s in suffixes]


def _orders_sql(columns: list[str]) -> str:
    return customer_sql(ORDERS, STATEMENTS_SQL, NUMBERS, CATEGORIES, columns)


def _number_part_sql(names, suffixes) -> str:
    return _orders_sql([x for c in names for x in number_sql(c, suffixes)])


_DIFFS = [f"{c}_diff1" for c in NUMBERS]
_TEMPORAL_SQL = temporal_sql(ORDERS, STATEMENTS_SQL, NUMBERS, CATEGORIES)

QUERIES = {
    "temporal_diff1": Query(
        _temporal(NUMBERS + _DIFFS),
        f"SELECT o_orderkey, o_custkey, {', '.join(r(c, c) for c in NUMBERS + _DIFFS)} "
        f"FROM ({_TEMPORAL_SQL})",
    ),
    "temporal_changed": Query(
        _temporal(CATEGORIES + [f"{c}_changed" for c in CATEGORIES]),
        f"SELECT o_orderkey, o_custkey, {', '.join(CATEGORIES)}, "
        f"{', '.join(n(f'{c}_changed', f'{c}_changed') for c in CATEGORIES)} FROM ({_TEMPORAL_SQL})",
    ),
    "agg_cat": Query(
        _customers(_part(CATEGORIES, CATEGORY_SUFFIXES)),
        _orders_sql([x for c in CATEGORIES for x in category_sql(c)]),
    ),
    "agg_flag": Query(
        _customers(_part([f"{c}_changed" for c in CATEGORIES], FLAG_SUFFIXES)),
        _orders_sql([x for c in CATEGORIES for x in flag_sql(c)]),
    ),
    "agg_num_stats": Query(_customers(_part(NUMBERS, BASE)), _number_part_sql(NUMBERS, BASE)),
    "agg_num_trend": Query(_customers(_part(NUMBERS, TREND)), _number_part_sql(NUMBERS, TREND)),
    "agg_diff_stats": Query(_customers(_part(_DIFFS, BASE)), _number_part_sql(_DIFFS, BASE)),
    "agg_diff_trend": Query(_customers(_part(_DIFFS, TREND)), _number_part_sql(_DIFFS, TREND)),
    "customer_table": Query(
        lambda spark, sf_dir: rounded(customer_table(statements(spark, sf_dir), ORDERS)),
        whole_customer_sql(ORDERS, STATEMENTS_SQL, NUMBERS, CATEGORIES),
    ),
    "customer_table_events": Query(
        lambda spark, sf_dir: rounded(customer_table(events(spark, sf_dir), EVENTS)),
        whole_customer_sql(EVENTS, EVENTS_SQL, ["value"], ["event_type"]),
    ),
}
