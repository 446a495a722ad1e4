"""Imputation, correlation, information, filters and feature lists."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from paneloom.catalog.fixtures import (
    CATEGORIES,
    LABELS_SQL,
    NUMBERS,
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
)
from paneloom.functions import missing_level
from paneloom.operators import selection as sel
from paneloom.operators.correlation import (
    correlation_pairs,
    pearson_target,
    redundant_features,
    roc_auc,
    spearman_target,
    strong_features,
    strong_pairs,
)
from paneloom.operators.information import mutual_information
from paneloom.operators.joint_neighbours import number_information
from paneloom.operators.neighbours import neighbour_information
from paneloom.operators.quantiles import exact_quantiles, fill_with_median, keep_from_percentile

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
BINS = 10
REDUNDANT, STRONG = 0.95, 0.7
_C = f"({SCREENED_SQL})"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


# --- imputation and codes ----------------------------------------------------


def _quantiles(spark, sf_dir):
    return rounded(exact_quantiles(screened(spark, sf_dir), SCREENED_NUMBERS, SHARES))


_QUANTILES_SQL = _union(
    f"SELECT '{c}' AS feature, {r(str(p), 'share')}, {r(f'quantile_cont({c}, {p})', 'value')} FROM {_C}"
    for c in SCREENED_NUMBERS
    for p in SHARES
)


def _imputed(spark, sf_dir):
    return rounded(fill_with_median(statements(spark, sf_dir), NUMBERS).select("o_orderkey", *NUMBERS))


_MEDIANS_SQL = ", ".join(
    r(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM ({STATEMENTS_SQL})))", c) for c in NUMBERS
)


def _codes(spark, sf_dir):
    rows = statements(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return rounded(sel.with_category_code(rows, "o_orderpriority", "code"))


def _missing(spark, sf_dir):
    rows = statements(spark, sf_dir)
    return rows.groupBy(missing_level(F.col("o_orderpriority")).alias("priority")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- correlation -------------------------------------------------------------


def _pearson(spark, sf_dir) -> DataFrame:
    return pearson_target(screened(spark, sf_dir), SCREENED_NUMBERS, "target")


def _guarded(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return (
        f"covar_pop({a}, {b}) / nullif(stddev_pop(CASE WHEN {both} THEN {a} END)"
        f" * stddev_pop(CASE WHEN {both} THEN {b} END), 0)"
    )


_SCORES_SQL = _union(
    f"SELECT '{c}' AS feature, {_guarded(c, 'target')} AS score FROM {_C}"
    for c in SCREENED_NUMBERS
)
_PEARSON_SQL = f"SELECT feature, {r('score', 'score')} FROM ({_SCORES_SQL})"


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


_SPEARMAN_SQL = _union(
    f"SELECT '{c}' AS feature, {r(_guarded('rx', 'ry'), 'score')} FROM "
    f"(SELECT {_rank(c)} AS rx, {_rank('target')} AS ry FROM {_C} WHERE {c} IS NOT NULL)"
    for c in SCREENED_NUMBERS
)
_INDEX = {c: i for i, c in enumerate(SCREENED_NUMBERS)}
_PAIRS_SQL = _union(
    f"SELECT {_INDEX[a]} AS i, {_INDEX[b]} AS j, '{a}' AS feature_a, '{b}' AS feature_b, "
    f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, "
    f"{_guarded(a, b)} AS r FROM {_C}"
    for a, b in combinations(SCREENED_NUMBERS, 2)
)
_PAIR_COLUMNS_SQL = (
    f"{n('i', 'i')}, {n('j', 'j')}, feature_a, feature_b, {n('n', 'n')}, {r('r', 'r')}"
)
_REDUNDANT_SQL = f"""
    SELECT DISTINCT CASE WHEN round(coalesce(abs(a.score), 0), 9) >= round(coalesce(abs(b.score), 0), 9)
                         THEN feature_b ELSE feature_a END AS feature
    FROM ({_PAIRS_SQL}) p
    LEFT JOIN ({_SCORES_SQL}) a ON a.feature = feature_a
    LEFT JOIN ({_SCORES_SQL}) b ON b.feature = feature_b
    WHERE abs(r) > {REDUNDANT}"""


def _pairs(spark, sf_dir) -> DataFrame:
    return correlation_pairs(screened(spark, sf_dir), SCREENED_NUMBERS)


def _redundant(spark, sf_dir) -> DataFrame:
    return redundant_features(_pairs(spark, sf_dir), _pearson(spark, sf_dir), REDUNDANT)


def _kept_features(spark, sf_dir):
    """The columns left after redundancy pruning, in order."""
    names = sel.feature_table(spark, SCREENED_NUMBERS)
    return rounded(sel.without(names, _redundant(spark, sf_dir)))


_NAMES_SQL = _union(
    f"SELECT {i} AS position, '{c}' AS feature" for i, c in enumerate(SCREENED_NUMBERS)
)

# --- mutual information ------------------------------------------------------


def _mi(spark, sf_dir, target="target", is_class=True) -> DataFrame:
    columns = [c for c in SCREENED_NUMBERS if c != target]
    return mutual_information(screened(spark, sf_dir), columns, target, BINS, is_class)


def _bin_sql(c: str) -> str:
    """Number of distinct cut points at or below the value."""
    shares = ", ".join(str(i / BINS) for i in range(1, BINS))
    cuts = f"(SELECT list_distinct(quantile_cont({c}, [{shares}])) FROM {_C})"
    return f"len(list_filter({cuts}, lambda cut: cut <= {c}))"


def _mi_one_sql(c: str, y: str) -> str:
    return f"""SELECT '{c}' AS feature, coalesce((
        SELECT sum(k / t * ln(k * t / (kx * ky))) FROM (
            SELECT DISTINCT b, y, CAST(count(*) OVER (PARTITION BY b, y) AS DOUBLE) AS k,
                   CAST(count(*) OVER (PARTITION BY b) AS DOUBLE) AS kx,
                   CAST(count(*) OVER (PARTITION BY y) AS DOUBLE) AS ky,
                   CAST(count(*) OVER () AS DOUBLE) AS t
            FROM (SELECT {_bin_sql(c)} AS b, {y} AS y FROM {_C} WHERE {c} IS NOT NULL)
        )), 0.0) AS score"""


_MI_SQL = _union(_mi_one_sql(c, "target") for c in SCREENED_NUMBERS)
_MI_NUMBER_SQL = _union(
    _mi_one_sql(c, _bin_sql("o_totalprice")) for c in SCREENED_NUMBERS if c != "o_totalprice"
)

# --- scores of rows ----------------------------------------------------------


def _auc(spark, sf_dir, score="sum_price"):
    return roc_auc(screened(spark, sf_dir), score, "target")


def _auc_sql(score: str) -> str:
    return f"""
    SELECT {n('count(*)', 'n_rows')}, {n('sum(target)', 'positives')},
           {r('(sum(rk * target) - CAST(sum(target) AS DOUBLE) * (sum(target) + 1) / 2)'
              ' / (CAST(sum(target) AS DOUBLE) * (count(*) - sum(target)))', 'auc')}
    FROM (SELECT target, {_rank(score)} AS rk FROM {_C} WHERE {score} IS NOT NULL)"""


def _uplift(spark, sf_dir):
    return rounded(sel.uplift(_auc(spark, sf_dir, "sum_price"), _auc(spark, sf_dir, "o_totalprice")))


_UPLIFT_SQL = f"""
    SELECT a.auc AS auc_before, b.auc AS auc_after,
           {r('(y.auc - x.auc) / x.auc * 100', 'uplift_pct')}
    FROM ({_auc_sql('sum_price')}) a, ({_auc_sql('o_totalprice')}) b,
         (SELECT (sum(rk * target) - CAST(sum(target) AS DOUBLE) * (sum(target) + 1) / 2)
              / (CAST(sum(target) AS DOUBLE) * (count(*) - sum(target))) AS auc
          FROM (SELECT target, {_rank('sum_price')} AS rk FROM {_C} WHERE sum_price IS NOT NULL)) x,
         (SELECT (sum(rk * target) - CAST(sum(target) AS DOUBLE) * (sum(target) + 1) / 2)
              / (CAST(sum(target) AS DOUBLE) * (count(*) - sum(target))) AS auc
          FROM (SELECT target, {_rank('o_totalprice')} AS rk FROM {_C} WHERE o_totalprice IS NOT NULL)) y"""

# --- score tables ------------------------------------------------------------


def _absolute(scores: DataFrame) -> DataFrame:
    return scores.select("feature", F.abs("score").alias("score")).where("score IS NOT NULL")


_ABS_SQL = f"SELECT feature, abs(score) AS score FROM ({_SCORES_SQL}) WHERE score IS NOT NULL"
_HISTOGRAM_SQL = f"""
    WITH s AS ({_ABS_SQL}), e AS (SELECT min(score) AS lo, max(score) AS hi FROM s),
         g AS (SELECT unnest(range(50)) AS bin)
    SELECT {n('g.bin', 'bin')}, {r('lo + g.bin * ((hi - lo) / 50)', 'low')},
           {r('lo + g.bin * ((hi - lo) / 50) + (hi - lo) / 50', 'high')},
           {n('''(SELECT count(*) FROM s WHERE least(floor((s.score - lo) / ((hi - lo) / 50)), 49) = g.bin)''', 'n')}
    FROM g, e"""

# --- filters -----------------------------------------------------------------

_FACTS_SQL = _union(
    f"SELECT {i} AS position, '{c}' AS feature, count(*) AS rows_all, count({c}) AS known, "
    f"count(DISTINCT {c}) AS levels, "
    f"coalesce((SELECT max(k) FROM (SELECT count({c}) AS k FROM {_C} GROUP BY {c})), 0) AS top FROM {_C}"
    for i, c in enumerate(SCREENED_COLUMNS)
)
_RULE_SQL = """CASE WHEN levels = rows_all THEN 1 WHEN levels = 1 THEN 2
    WHEN top / CAST(rows_all AS DOUBLE) > 0.99 THEN 3
    WHEN (rows_all - known) / CAST(rows_all AS DOUBLE) > 0.9 THEN 4 END"""
_REMOVAL_SQL = f"""
    SELECT {n('rule', 'rule')}, {n('position', 'position')}, feature,
           CASE rule WHEN 1 THEN '{sel.REASON_ID}' WHEN 2 THEN '{sel.REASON_CONSTANT}'
                     WHEN 3 THEN '{sel.REASON_QUASI_CONSTANT}'
                     ELSE printf('Missing %.0f%%', 100.0 * (rows_all - known) / rows_all) END AS reason
    FROM (SELECT *, {_RULE_SQL} AS rule FROM ({_FACTS_SQL})) WHERE rule IS NOT NULL"""
_STATIC_SQL = f"""
    SELECT {n('position', 'position')}, feature FROM ({_FACTS_SQL})
    WHERE NOT ((rows_all - known) / CAST(rows_all AS DOUBLE) > 0.999
               OR top / CAST(rows_all AS DOUBLE) > 0.999)"""


def _removals(spark, sf_dir) -> DataFrame:
    return sel.removal_report(screened(spark, sf_dir), SCREENED_COLUMNS)


def _static(spark, sf_dir):
    s = screened(spark, sf_dir).drop("target")
    return rounded(sel.static_filter(s, ["o_orderkey"]))


def _funnel(spark, sf_dir):
    names = sel.feature_table(spark, SCREENED_NUMBERS)
    cleaned = sel.without(names, _removals(spark, sf_dir))
    pruned = sel.without(cleaned, _redundant(spark, sf_dir))
    return rounded(sel.funnel([("all", names), ("cleaned", cleaned), ("pruned", pruned)]))


_FUNNEL_SQL = f"""
    WITH names AS ({_NAMES_SQL}),
         cleaned AS (SELECT * FROM names WHERE feature NOT IN (SELECT feature FROM ({_REMOVAL_SQL}))),
         pruned AS (SELECT * FROM cleaned WHERE feature NOT IN (SELECT feature FROM ({_REDUNDANT_SQL}))),
         stages AS (SELECT 0 AS position, 'all' AS stage, count(*) AS k FROM names
                    UNION ALL SELECT 1, 'cleaned', count(*) FROM cleaned
                    UNION ALL SELECT 2, 'pruned', count(*) FROM pruned)
    SELECT {n('position', 'position')}, stage, {n('k', 'n_features')},
           {r('100.0 * ((SELECT max(k) FROM stages) - k) / (SELECT max(k) FROM stages)', 'reduction_pct')}
    FROM stages"""


# --- drift -------------------------------------------------------------------

_CORRELATED = 0.02
_CUTOFF = "1996-01-01"


def _selected(rows: DataFrame) -> DataFrame:
    scores = pearson_target(rows, SCREENED_NUMBERS, "target")
    return scores.where(F.abs("score") >= _CORRELATED).select("feature")


def _periods(spark, sf_dir):
    """Features correlated with the target before and from a date."""
    dates = statements(spark, sf_dir).select(
        "o_orderkey", (F.col("o_orderdate") < F.lit(_CUTOFF).cast("date")).alias("early")
    )
    rows = screened(spark, sf_dir).join(dates, "o_orderkey")
    return _selected(rows.where("early")), _selected(rows.where("NOT early"))


def _selected_sql(comparison: str) -> str:
    rows = (
        f"(SELECT c.* FROM {_C} c JOIN orders o ON c.o_orderkey = o.o_orderkey "
        f"WHERE o.o_orderdate {comparison} DATE '{_CUTOFF}')"
    )
    scores = _union(
        f"SELECT '{c}' AS feature, {_guarded(c, 'target')} AS score FROM {rows}"
        for c in SCREENED_NUMBERS
    )
    return f"SELECT feature FROM ({scores}) WHERE abs(score) >= {_CORRELATED}"


_DRIFT_SQL = f"""
    SELECT coalesce(o.feature, w.feature) AS feature,
           CASE WHEN o.feature IS NULL THEN 'added' WHEN w.feature IS NULL THEN 'removed'
                ELSE 'stable' END AS status
    FROM ({_selected_sql('<')}) o FULL JOIN ({_selected_sql('>=')}) w ON o.feature = w.feature"""
_DRIFT_SUMMARY_SQL = f"""
    SELECT added, removed, stable, {r('100.0 * stable / nullif(stable + removed, 0)', 'stability_pct')},
           CASE WHEN removed / CAST(nullif(stable + removed, 0) AS DOUBLE) > 0.05 THEN 'old' ELSE 'new' END AS use
    FROM (SELECT count(CASE WHEN status = 'added' THEN 1 END) AS added,
                 count(CASE WHEN status = 'removed' THEN 1 END) AS removed,
                 count(CASE WHEN status = 'stable' THEN 1 END) AS stable FROM ({_DRIFT_SQL}))"""



def _hundredths(spark, sf_dir) -> DataFrame:
    """The numbers as whole hundredths, whose distances both engines compute exactly."""
    df = screened(spark, sf_dir)
    return df.select("target", *(F.round(F.col(c) * 100).alias(c) for c in NUMBERS))


def _digamma_sql(n: str) -> str:
    z = f"({n} + 8.0)"
    terms = "".join(f" - 1.0 / ({n} + {j}.0)" for j in range(8))
    series = "".join(
        f" {sign} 1.0 / ({c}.0 * {z} ** {power})"
        for sign, c, power in (("-", 12, 2), ("+", 120, 4), ("-", 252, 6), ("+", 240, 8), ("-", 132, 10))
    )
    return f"(ln({z}) - 0.5 / {z}{series}{terms})"


_MI_NEIGHBOURS_SQL = f"""
    WITH long AS (
      SELECT unnest(['{"', '".join(NUMBERS)}']) AS feature,
        unnest([{", ".join(f"CAST(round({c} * 100) AS BIGINT)" for c in NUMBERS)}]) AS x, target AS y
      FROM ({SCREENED_SQL})
    ), known AS (
      SELECT *, count(*) OVER (PARTITION BY feature, y) AS class_n
      FROM long WHERE x IS NOT NULL AND y IS NOT NULL
    ), near AS (
      SELECT feature, y, x, class_n, list_sort(list_filter([
        x - lag(x, 1) OVER own, x - lag(x, 2) OVER own, x - lag(x, 3) OVER own,
        lead(x, 1) OVER own - x, lead(x, 2) OVER own - x, lead(x, 3) OVER own - x],
        lambda d: d IS NOT NULL))[least(3, class_n - 1)] AS away
      FROM known WHERE class_n > 1 WINDOW own AS (PARTITION BY feature, y ORDER BY x)
    ), counted AS (
      SELECT feature, class_n, count(*) OVER (PARTITION BY feature ORDER BY x RANGE BETWEEN
        greatest(away - 1, 0) PRECEDING AND greatest(away - 1, 0) FOLLOWING) AS inside
      FROM near
    )
    SELECT feature, greatest(0.0, {_digamma_sql("count(*)")} + avg(
      {_digamma_sql("least(3, class_n - 1)")} - {_digamma_sql("class_n")}
      - {_digamma_sql("inside")})) AS score
    FROM counted GROUP BY feature"""

_OTHERS = [c for c in NUMBERS if c != "o_totalprice"]
_MI_PAIRS_SQL = f"""
    WITH long AS (
      SELECT unnest(['{"', '".join(_OTHERS)}']) AS feature, o_orderkey AS row,
        unnest([{", ".join(f"round({c} * 100)" for c in _OTHERS)}]) AS x,
        round(o_totalprice * 100) AS y
      FROM ({SCREENED_SQL})
    ), known AS (SELECT * FROM long WHERE x IS NOT NULL AND y IS NOT NULL),
    sizes AS (
      SELECT feature, count(*) AS rows,
        CAST(format('{{:.9e}}', stddev_pop(x)) AS DOUBLE) AS sx,
        CAST(format('{{:.9e}}', stddev_pop(y)) AS DOUBLE) AS sy
      FROM known GROUP BY feature HAVING count(*) > 1
    ), scaled AS (
      SELECT feature, row, x, y, rows, CASE WHEN sx > 0 THEN sx ELSE 1 END AS sx,
        CASE WHEN sy > 0 THEN sy ELSE 1 END AS sy FROM known JOIN sizes USING (feature)
    ), near AS (
      SELECT a.feature, a.row, any_value(a.rows) AS rows,
        list_extract(min(greatest(abs(a.x - b.x) / a.sx, abs(a.y - b.y) / a.sy), 3), -1) AS away
      FROM scaled a JOIN scaled b ON a.feature = b.feature AND a.row <> b.row
      GROUP BY a.feature, a.row
    ), counted AS (
      SELECT a.feature, a.row, any_value(n.rows) AS rows,
        count(CASE WHEN abs(a.x - b.x) / a.sx < n.away OR a.x = b.x THEN 1 END) AS in_x,
        count(CASE WHEN abs(a.y - b.y) / a.sy < n.away OR a.y = b.y THEN 1 END) AS in_y
      FROM scaled a JOIN near n ON a.feature = n.feature AND a.row = n.row
      JOIN scaled b ON a.feature = b.feature
      GROUP BY a.feature, a.row
    )
    SELECT feature, greatest(0.0, {_digamma_sql("count(*)")}
      + {_digamma_sql("least(3, count(*) - 1)")}
      - avg({_digamma_sql("in_x")} + {_digamma_sql("in_y")})) AS score
    FROM counted GROUP BY feature"""

QUERIES = {
    "quantiles": Query(_quantiles, _QUANTILES_SQL),
    "median_impute": Query(_imputed, f"SELECT o_orderkey, {_MEDIANS_SQL} FROM ({STATEMENTS_SQL})"),
    "category_codes": Query(
        _codes,
        f"SELECT o_orderkey, o_orderpriority, "
        f"{n('''dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'None')) - 1''', 'code')} "
        f"FROM ({STATEMENTS_SQL})",
    ),
    "missing_level": Query(
        _missing,
        f"SELECT coalesce(o_orderpriority, 'Missing') AS priority, count(*) AS n "
        f"FROM ({STATEMENTS_SQL}) GROUP BY 1",
    ),
    "pearson_target": Query(lambda s, d: rounded(_pearson(s, d)), _PEARSON_SQL),
    "spearman_target": Query(
        lambda s, d: rounded(spearman_target(screened(s, d), SCREENED_NUMBERS, "target")),
        _SPEARMAN_SQL,
    ),
    "corr_pairs": Query(
        lambda s, d: rounded(_pairs(s, d)), f"SELECT {_PAIR_COLUMNS_SQL} FROM ({_PAIRS_SQL})"
    ),
    "strong_pairs": Query(
        lambda s, d: rounded(strong_pairs(_pairs(s, d), STRONG)),
        f"SELECT {_PAIR_COLUMNS_SQL} FROM ({_PAIRS_SQL}) WHERE abs(r) >= {STRONG}",
    ),
    "strong_features": Query(
        lambda s, d: strong_features(_pairs(s, d), STRONG),
        f"SELECT feature_a AS feature FROM ({_PAIRS_SQL}) WHERE abs(r) >= {STRONG} "
        f"UNION SELECT feature_b FROM ({_PAIRS_SQL}) WHERE abs(r) >= {STRONG}",
    ),
    "redundant_features": Query(_redundant, _REDUNDANT_SQL),
    "kept_features": Query(
        _kept_features,
        f"SELECT {n('position', 'position')}, feature FROM ({_NAMES_SQL}) "
        f"WHERE feature NOT IN ({_REDUNDANT_SQL})",
    ),
    "mi_target": Query(
        lambda s, d: rounded(_mi(s, d)), f"SELECT feature, {r('score', 'score')} FROM ({_MI_SQL})"
    ),
    "mi_number": Query(
        lambda s, d: rounded(_mi(s, d, "o_totalprice", False)),
        f"SELECT feature, {r('score', 'score')} FROM ({_MI_NUMBER_SQL})",
    ),
    "mi_neighbours": Query(
        lambda s, d: rounded(neighbour_information(_hundredths(s, d), NUMBERS, "target")),
        f"SELECT feature, {r('score', 'score')} FROM ({_MI_NEIGHBOURS_SQL})",
    ),
    "mi_number_neighbours": Query(
        lambda s, d: rounded(number_information(_hundredths(s, d), _OTHERS, "o_totalprice")),
        f"SELECT feature, {r('score', 'score')} FROM ({_MI_PAIRS_SQL})",
    ),
    "mi_cut": Query(
        lambda s, d: rounded(keep_from_percentile(_mi(s, d), "score", 0.25)),
        f"SELECT feature, {r('score', 'score')} FROM ({_MI_SQL}) "
        f"WHERE score >= (SELECT quantile_cont(score, 0.25) FROM ({_MI_SQL}))",
    ),
    "top_k_scores": Query(
        lambda s, d: rounded(sel.top_scores(_mi(s, d), 3)),
        f"SELECT feature, {r('score', 'score')} FROM ({_MI_SQL}) "
        f"ORDER BY score DESC, feature LIMIT 3",
    ),
    "auc": Query(lambda s, d: rounded(_auc(s, d)), _auc_sql("sum_price")),
    "auc_uplift": Query(_uplift, _UPLIFT_SQL),
    "score_histogram": Query(
        lambda s, d: rounded(sel.score_histogram(_absolute(_pearson(s, d)))), _HISTOGRAM_SQL
    ),
    "score_shares": Query(
        lambda s, d: rounded(sel.normalised(_absolute(_pearson(s, d)))),
        f"SELECT feature, {r('score', 'score')}, {r('score / sum(score) OVER ()', 'normalised')} "
        f"FROM ({_ABS_SQL})",
    ),
    "static_filter": Query(_static, _STATIC_SQL),
    "removal_report": Query(lambda s, d: rounded(_removals(s, d)), _REMOVAL_SQL),
    "feature_funnel": Query(_funnel, _FUNNEL_SQL),
    "feature_drift": Query(lambda s, d: sel.drift(*_periods(s, d)), _DRIFT_SQL),
    "drift_summary": Query(
        lambda s, d: rounded(sel.drift_summary(sel.drift(*_periods(s, d)))), _DRIFT_SUMMARY_SQL
    ),
    "chosen_features": Query(
        lambda s, d: sel.chosen_after_drift(*_periods(s, d)),
        f"SELECT feature FROM ({_DRIFT_SQL}), (SELECT use FROM ({_DRIFT_SUMMARY_SQL})) "
        "WHERE (use = 'old' AND status <> 'added') OR (use = 'new' AND status <> 'removed')",
    ),
    "class_weights": Query(
        lambda s, d: rounded(sel.class_weights(customer_labels(s, d), "target")),
        f"SELECT {n('target', 'target')}, {n('k', 'n')}, {r('max(k) OVER () / CAST(k AS DOUBLE)', 'weight')} "
        f"FROM (SELECT target, count(*) AS k FROM ({LABELS_SQL}) GROUP BY target)",
    ),
}
