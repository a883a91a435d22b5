"""Queries for quality, statistics, time series, models and insight facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.base import register
from sondage.functions import columns as C
from sondage.operators import facts as I
from sondage.operators import ml as M
from sondage.operators import quality as Q
from sondage.operators import relational as L
from sondage.operators import sketches as K
from sondage.operators import stats as T
from sondage.operators import timeseries as R
from sondage.operators.features import dictionary
from sondage.operators.profile import nunique_table, sigma_counts

_DIRTY = ["orderkey", "custkey", "orderstatus", "totalprice", "sparse_col", "const_col", "orderdate", "orderpriority"]
_DIRTY_NUM = ["orderkey", "custkey", "totalprice", "sparse_col"]
_MISSING = "(" + " + ".join(f"count(*) - count({c})" for c in _DIRTY) + ")"
_N = "(SELECT count(*) FROM dirty_orders)"
_DUPS = "((SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)))"


def _sigma(cols, k, t="dirty_orders"):
    return "(" + " + ".join(
        f"(SELECT count(*) FROM {t}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {t}) WHERE abs({c} - m) > {k} * s)" for c in cols
    ) + ")"


def _fences(c, t="dirty_orders"):
    return f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {t})"


def _iqr_one(c, t="dirty_orders"):
    return f"(SELECT count(*) FROM {t}, {_fences(c, t)} f WHERE {c} < lo OR {c} > hi)"


def _iqr(cols, t="dirty_orders"):
    return "(" + " + ".join(_iqr_one(c, t) for c in cols) + ")"


_UNIQUE = "(" + " + ".join(f"count(DISTINCT {c})" for c in _DIRTY) + ") / 8"

# ------------------------------------------------------------------ quality

register(
    "quality_score", "dirty_orders", Q.quality_score,
    f"""WITH p AS (SELECT {_MISSING} / (count(*) * 8) * 100 AS m, {_DUPS} / count(*) * 100 AS d, {_sigma(_DIRTY_NUM, 3)} / (count(*) * 4) * 100 AS o FROM dirty_orders)
    SELECT least(100.0::DOUBLE, round(greatest(0, 40 - 2 * m) + greatest(0, 30 - 1.5 * d) + greatest(0, 30 - 3 * o))) AS score, round(greatest(0, 40 - 2 * m), 1) AS missing_score,
    round(greatest(0, 30 - 1.5 * d), 1) AS dup_score, round(greatest(0, 30 - 3 * o), 1) AS outlier_score, round(m, 2) AS missing_pct, round(d, 2) AS dup_pct, round(o, 2) AS outlier_pct FROM p""",
)
register(
    "dqi", "dirty_orders", Q.dqi,
    f"""WITH p AS (SELECT round((1 - {_MISSING} / (count(*) * 8)) * 100, 1) AS completeness, round((1 - {_DUPS} / count(*)) * 70 + least(30, 30 * ({_UNIQUE}) / count(*)), 1) AS uniqueness,
    round(100 - {_sigma(_DIRTY_NUM, 6)} / (count(*) * 8) * 100, 1) AS type_validity, round(greatest(0, least(100, 100 - {_iqr(_DIRTY_NUM)} / count(*) * 5)), 1) AS outlier_ratio FROM dirty_orders)
    SELECT *, round(0.35::DOUBLE * completeness + 0.15::DOUBLE * uniqueness + 0.25::DOUBLE * type_validity + 0.25::DOUBLE * outlier_ratio, 1) AS dqi FROM p""",
)
register(
    "health_scores", "dirty_orders", Q.health_scores,
    f"""WITH p AS (SELECT round(100 - {_MISSING} / (count(*) * 8) * 100, 1) AS completeness, 100.0::DOUBLE AS consistency, round(100 - {_DUPS} / count(*) * 100, 1) AS duplicates,
    round(100 - {_iqr(_DIRTY_NUM + ['const_col'])} / (count(*) * 8) * 100, 1) AS outliers, 100.0::DOUBLE AS data_types, round(100 - 1 / 8 * 100, 1) AS null_values,
    round(least(100, ({_UNIQUE}) / count(*) * 100 + 20), 1) AS unique_values, 100.0::DOUBLE AS formatting FROM dirty_orders)
    SELECT *, round((20 * completeness + 15 * consistency + 15 * duplicates + 15 * outliers + 10 * data_types + 10 * null_values + 8 * unique_values + 7 * formatting) / 100, 1) AS overall FROM p""",
)
register(
    "health_scores_negatives", "customer", lambda c: Q.health_scores(c).select("data_types", "formatting", "unique_values"),
    """SELECT round(100 - count(*) FILTER (c_acctbal < 0) / (count(*) * 5) * 50, 1) AS data_types,
    100.0::DOUBLE - 10 * CAST(avg(CASE WHEN regexp_matches(c_name, '[^\\w\\s.-]') THEN 1.0 ELSE 0.0 END) > 0.1 AS INTEGER) AS formatting,
    round(least(100, (count(DISTINCT c_custkey) + count(DISTINCT c_name) + count(DISTINCT c_nationkey) + count(DISTINCT c_acctbal) + count(DISTINCT c_mktsegment)) / 5 / count(*) * 100 + 20), 1) AS unique_values FROM customer""",
)
register(
    "special_character_rates", "text_orders", lambda t: Q.special_character_rates(t).select("column", "rate"),
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg(CASE WHEN regexp_matches({c}, '[^A-Za-z0-9_[:space:].-]') THEN 1.0 ELSE 0.0 END), 4) AS rate FROM text_orders""" for c in ["amount_txt", "flag_txt", "iso_txt", "email_txt", "money_txt", "phone_txt", "coord_txt"]),
)
register(
    "health_problems", "customer", lambda c: Q.health_problems(c).drop("rank"),
    "SELECT 'negative values' AS problem, 'c_acctbal' AS \"column\", count(*) AS count FROM customer WHERE c_acctbal < 0",
)
register(
    "audit", "planted", lambda p: Q.audit(p.select("event_id", "x", "x_noisy", "gap_value", "constant")).withColumn("value", F.round("value", 3)).drop("rank"),
    """WITH r AS (SELECT corr(x, x_noisy) AS a, corr(x, gap_value) AS b, corr(x_noisy, gap_value) AS c FROM planted)
    SELECT 'constant' AS kind, 'constant' AS "column", NULL AS other, NULL::DOUBLE AS value, 'High' AS severity FROM planted HAVING count(DISTINCT constant) <= 1
    UNION ALL SELECT 'nearly equal', 'x_noisy', 'x', round(a, 3), 'High' FROM r WHERE abs(a) > 0.95
    UNION ALL SELECT 'nearly equal', 'gap_value', 'x', round(b, 3), 'High' FROM r WHERE abs(b) > 0.95""",
)
register(
    "audit_collinear", "planted", lambda p: Q.audit(p.select("x", "x_linear", "x_tied", "event_type")).select("kind", "column", "other", "severity"),
    """WITH r AS (SELECT corr(x, x_linear) AS a, corr(x, x_tied) AS b, corr(x_linear, x_tied) AS c FROM planted)
    SELECT 'nearly equal' AS kind, 'x_linear' AS "column", 'x' AS other, 'High' AS severity FROM r WHERE abs(a) > 0.95
    UNION ALL SELECT 'nearly equal', 'x_tied', 'x', 'High' FROM r WHERE abs(b) > 0.95 UNION ALL SELECT 'nearly equal', 'x_tied', 'x_linear', 'High' FROM r WHERE abs(c) > 0.95
    UNION ALL SELECT 'explained by others', v, NULL, 'Medium' FROM r, (VALUES ('x'), ('x_linear'), ('x_tied')) t(v) WHERE 1 / (1 - b * b) > 10""",
)
register(
    "vif", "planted", lambda p: Q.vif(p, ["x_noisy", "gap_value"]),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(1 / (1 - power(corr(x_noisy, gap_value), 2)), 4) AS vif FROM planted" for c in ["x_noisy", "gap_value"]),
)
register(
    "cleaning_recommendations", "dirty_orders", Q.cleaning_recommendations,
    f"""SELECT 'orderstatus' AS "column", count(*) - count(orderstatus) AS missing, round((count(*) - count(orderstatus)) / count(*) * 100, 4) AS missing_pct, 'fill mode' AS action,
    (SELECT orderstatus FROM dirty_orders WHERE orderstatus IS NOT NULL GROUP BY orderstatus ORDER BY count(*) DESC, orderstatus LIMIT 1) AS fill_value FROM dirty_orders
    UNION ALL SELECT 'totalprice', count(*) - count(totalprice), round((count(*) - count(totalprice)) / count(*) * 100, 4), 'fill median', printf('%.2f', quantile_cont(totalprice, 0.5)) FROM dirty_orders
    UNION ALL SELECT 'sparse_col', count(*) - count(sparse_col), round((count(*) - count(sparse_col)) / count(*) * 100, 4), 'drop column', NULL FROM dirty_orders
    UNION ALL SELECT NULL, {_DUPS}, round({_DUPS} / {_N} * 100, 4), 'drop duplicates', NULL""",
)
register(
    "detect_issues", "planted", lambda p: Q.detect_issues(p.select("x", "x_noisy", "event_type")).drop("rank"),
    f"""SELECT 'outliers' AS issue, c AS "column", k AS count, round(k / n * 100, 4) AS pct, 'Medium' AS priority, 'Medium' AS impact FROM (
    SELECT 'x' AS c, {_iqr_one('x', 'planted')} AS k UNION ALL SELECT 'x_noisy', {_iqr_one('x_noisy', 'planted')}), (SELECT count(*) AS n FROM planted) WHERE k > n * 0.02
    UNION ALL SELECT 'duplicate rows', NULL, n - u, round((n - u) / n * 100, 4), 'Medium', 'Medium' FROM (SELECT count(*) AS n FROM planted), (SELECT count(*) AS u FROM (SELECT DISTINCT x, x_noisy, event_type FROM planted)) WHERE n > u""",
)
register(
    "detect_issues_dirty", "dirty_orders", lambda d: Q.detect_issues(d).drop("rank"),
    " UNION ALL ".join(
        f"""SELECT 'missing values' AS issue, '{c}' AS "column", count(*) - count({c}) AS count, round((count(*) - count({c})) / count(*) * 100, 4) AS pct, 'High' AS priority, 'High' AS impact FROM dirty_orders"""
        for c in ["orderstatus", "totalprice", "sparse_col"]
    ) + f""" UNION ALL SELECT 'outliers', c, k, round(k / {_N} * 100, 4), 'Medium', 'Medium' FROM ({" UNION ALL ".join(f"SELECT '{c}' AS c, {_iqr_one(c)} AS k FROM {_fences(c)}" for c in _DIRTY_NUM)}) WHERE k > {_N} * 0.02
    UNION ALL SELECT 'duplicate rows', NULL, {_DUPS}, round({_DUPS} / {_N} * 100, 4), 'Medium', 'Medium'""",
)
register(
    "detect_issues_cardinality", "customer", lambda c: Q.detect_issues(c).drop("rank"),
    "SELECT 'high cardinality' AS issue, 'c_name' AS \"column\", count(DISTINCT c_name) AS count, NULL::DOUBLE AS pct, 'Low' AS priority, 'Low' AS impact FROM customer HAVING count(DISTINCT c_name) > 50",
)
def _gaps(table: str, cats: list[str], nums: list[str]) -> str:
    """Rows of the finding that the means of groups are more than 20 % apart."""
    return " UNION ALL ".join(
        f"""SELECT 'groups differ' AS factor, '{c}' AS "column", '{x}' AS other, round((max(v) - min(v)) / greatest(abs(min(v)), 0.01) * 100, 4) AS value, 'High' AS severity
        FROM (SELECT avg({x}) AS v FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count({x}) > 0) HAVING count(*) > 1 AND (max(v) - min(v)) / greatest(abs(min(v)), 0.01) * 100 > 20"""
        for c in cats for x in nums
    )


register(
    "root_causes", "planted", lambda p: Q.root_causes(p.select("gap_value", "x_noisy", "event_type", "x")).drop("rank"),
    f"""WITH n AS (SELECT count(*) AS n FROM planted),
    o AS (SELECT 'gap_value' AS c, {_iqr_one('gap_value', 'planted')} AS k UNION ALL SELECT 'x_noisy', {_iqr_one('x_noisy', 'planted')} UNION ALL SELECT 'x', {_iqr_one('x', 'planted')}),
    r AS (SELECT 'gap_value' AS a, 'x_noisy' AS b, corr(gap_value, x_noisy) AS v FROM planted UNION ALL SELECT 'gap_value', 'x', corr(gap_value, x) FROM planted UNION ALL SELECT 'x_noisy', 'x', corr(x_noisy, x) FROM planted)
    SELECT 'extreme values' AS factor, c AS "column", NULL AS other, CAST(k AS DOUBLE) AS value, 'Medium' AS severity FROM o, n WHERE k > n.n * 0.02
    UNION ALL SELECT 'repeated rows', NULL, NULL, CAST(n - u AS DOUBLE), 'Medium' FROM n, (SELECT count(*) AS u FROM (SELECT DISTINCT gap_value, x_noisy, event_type, x FROM planted)) WHERE n > u
    UNION ALL SELECT 'moves together', a, b, round(v, 4), 'Medium' FROM r WHERE abs(v) > 0.7
    UNION ALL {_gaps('planted', ['event_type'], ['gap_value', 'x_noisy', 'x'])}""",
)
register(
    "root_causes_dirty", "dirty_orders", lambda d: Q.root_causes(d).drop("rank"),
    " UNION ALL ".join(
        f"""SELECT 'gaps' AS factor, '{c}' AS "column", NULL AS other, CAST(count(*) - count({c}) AS DOUBLE) AS value, 'High' AS severity FROM dirty_orders""" for c in ["orderstatus", "totalprice", "sparse_col"]
    ) + f""" UNION ALL SELECT 'repeated rows', NULL, NULL, CAST({_DUPS} AS DOUBLE), 'Medium'
    UNION ALL SELECT 'extreme values', c, NULL, CAST(k AS DOUBLE), 'Medium' FROM ({" UNION ALL ".join(f"SELECT '{c}' AS c, {_iqr_one(c)} AS k FROM {_fences(c)}" for c in _DIRTY_NUM)}) WHERE k > {_N} * 0.02
    UNION ALL SELECT 'moves together', 'custkey', 'sparse_col', round(corr(custkey, sparse_col), 4), 'Medium' FROM dirty_orders HAVING abs(corr(custkey, sparse_col)) > 0.7
    UNION ALL {_gaps('dirty_orders', ['orderstatus', 'const_col', 'orderpriority'], _DIRTY_NUM)}""",
)
register(
    "outlier_table", "dirty_orders", Q.outlier_table,
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_iqr_one(c)} AS outliers, round(lo, 4) AS lower, round(hi, 4) AS upper FROM {_fences(c)}" for c in _DIRTY_NUM),
)
register(
    "flag_outliers_iqr", "dirty_orders", lambda d: Q.flag_outliers(d, "totalprice").select("orderkey", "is_outlier"),
    f"SELECT orderkey, coalesce(totalprice < lo OR totalprice > hi, false) AS is_outlier FROM dirty_orders, {_fences('totalprice')}",
)
register(
    "flag_outliers_zscore", "dirty_orders", lambda d: Q.flag_outliers(d, "totalprice", "zscore").select("orderkey", "is_outlier"),
    "SELECT orderkey, coalesce(abs(totalprice - m) / s > 3, false) AS is_outlier FROM dirty_orders, (SELECT avg(totalprice) AS m, stddev_pop(totalprice) AS s FROM dirty_orders)",
)
register(
    "outlier_summary", "events", lambda e: Q.outlier_summary(e, "value"),
    f"SELECT {_iqr_one('value', 'events')} AS outliers, round({_iqr_one('value', 'events')} / (SELECT count(*) FROM events) * 100, 4) AS outlier_pct",
)
register(
    "sigma_outliers", "events", lambda e: sigma_counts(e, ["value", "user_id"]).select("column", "outliers"),
    f"SELECT 'value' AS \"column\", {_sigma(['value'], 3, 'events')} AS outliers UNION ALL SELECT 'user_id', {_sigma(['user_id'], 3, 'events')}",
)
register(
    "treat_outliers_remove", "dirty_orders", lambda d: Q.treat_outliers(d, "totalprice", "iqr", "remove").select("orderkey", "totalprice"),
    f"SELECT orderkey, round(totalprice, 4) AS totalprice FROM dirty_orders, {_fences('totalprice')} WHERE totalprice IS NULL OR totalprice BETWEEN lo AND hi",
)
register(
    "treat_outliers_cap", "dirty_orders", lambda d: Q.treat_outliers(d, "totalprice", "iqr", "cap").select("orderkey", "totalprice"),
    f"SELECT orderkey, CASE WHEN totalprice IS NOT NULL THEN round(greatest(lo, least(hi, totalprice)), 4) END AS totalprice FROM dirty_orders, {_fences('totalprice')}",
)
register(
    "treat_outliers_cap_zscore", "dirty_orders", lambda d: Q.treat_outliers(d, "totalprice", "zscore", "cap").select("orderkey", "totalprice"),
    """SELECT orderkey, CASE WHEN totalprice IS NOT NULL THEN round(greatest(m - 3 * s, least(m + 3 * s, totalprice)), 2) END AS totalprice
    FROM dirty_orders, (SELECT avg(totalprice) AS m, stddev_samp(totalprice) AS s FROM dirty_orders)""",
    digits=2,
)
for _method, _sql in {
    "mean": "coalesce(totalprice, (SELECT avg(totalprice) FROM dirty_orders))",
    "median": "coalesce(totalprice, (SELECT quantile_cont(totalprice, 0.5) FROM dirty_orders))",
    "constant": "coalesce(totalprice, 0)",
}.items():
    register(
        f"fill_missing_{_method}", "dirty_orders", lambda d, m=_method: Q.fill_missing(d, "totalprice", m, value=0).select("orderkey", "totalprice"),
        f"SELECT orderkey, round({_sql}, 2) AS totalprice FROM dirty_orders", digits=2,
    )
register(
    "fill_missing_mode", "dirty_orders", lambda d: Q.fill_missing(d, "orderstatus", "mode").select("orderkey", "orderstatus"),
    "SELECT orderkey, coalesce(orderstatus, (SELECT orderstatus FROM dirty_orders WHERE orderstatus IS NOT NULL GROUP BY orderstatus ORDER BY count(*) DESC, orderstatus LIMIT 1)) AS orderstatus FROM dirty_orders",
)
register(
    "fill_missing_ffill", "gappy_events", lambda g: Q.fill_missing(g, "value", "ffill", order_by="event_id").select("event_id", "value"),
    "SELECT event_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS value FROM gappy_events",
)
register(
    "fill_missing_bfill", "gappy_events", lambda g: Q.fill_missing(g, "value", "bfill", order_by="event_id").select("event_id", "value"),
    "SELECT event_id, round(first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS value FROM gappy_events",
)
register("fill_missing_drop_rows", "dirty_orders", lambda d: Q.fill_missing(d, "totalprice", "drop_rows").select("orderkey"), "SELECT orderkey FROM dirty_orders WHERE totalprice IS NOT NULL")
register("fill_missing_drop_column", "dirty_orders", lambda d: Q.fill_missing(d, "sparse_col", "drop_column"),
         "SELECT orderkey, custkey, orderstatus, round(totalprice, 4) AS totalprice, const_col, orderdate, orderpriority FROM dirty_orders")
register(
    "auto_clean", "dirty_orders", lambda d: Q.auto_clean(d)[0],
    """WITH u AS (SELECT DISTINCT * FROM dirty_orders)
    SELECT orderkey, custkey, coalesce(orderstatus, (SELECT orderstatus FROM u WHERE orderstatus IS NOT NULL GROUP BY orderstatus ORDER BY count(*) DESC, orderstatus LIMIT 1)) AS orderstatus,
    round(coalesce(totalprice, (SELECT quantile_cont(totalprice, 0.5) FROM u)), 4) AS totalprice, const_col, orderdate, orderpriority FROM u""",
)
register(
    "auto_clean_actions", "dirty_orders", lambda d: Q.auto_clean(d)[1].drop("step"),
    f"""WITH u AS (SELECT DISTINCT * FROM dirty_orders)
    SELECT 'remove duplicates' AS action, NULL AS "column", {_DUPS} AS count, NULL AS value
    UNION ALL SELECT 'fill median', 'totalprice', count(*) - count(totalprice), printf('%.4f', quantile_cont(totalprice, 0.5)) FROM u
    UNION ALL SELECT 'fill mode', 'orderstatus', count(*) - count(orderstatus), (SELECT orderstatus FROM u WHERE orderstatus IS NOT NULL GROUP BY orderstatus ORDER BY count(*) DESC, orderstatus LIMIT 1) FROM u
    UNION ALL SELECT 'drop column', 'sparse_col', count(*) - count(sparse_col), NULL FROM u""",
)

# ------------------------------------------------------------------ correlation and association

_PLANTED = ["x", "x_linear", "x_neg", "x_noisy", "x_tied"]
register(
    "corr_matrix", "planted", lambda p: T.corr_matrix(p, _PLANTED),
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) AS r FROM planted" for a in _PLANTED for b in _PLANTED),
)
register(
    "corr_matrix_missing", "dirty_orders", lambda d: T.corr_matrix(d, _DIRTY_NUM),
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) + 0.0 AS r FROM dirty_orders" for a in _DIRTY_NUM for b in _DIRTY_NUM),
)


def _ranked(a: str, b: str, t: str) -> str:
    """Spearman: correlation of average ranks over the rows complete in both columns."""
    return f"""(SELECT corr(ra, rb) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb
    FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""


def _tau(a: str, b: str, t: str) -> str:
    """Kendall's tau-b over all row pairs."""
    return f"""(SELECT sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) / sqrt(sum(abs(sign(p.{a} - q.{a}))) * sum(abs(sign(p.{b} - q.{b})))) FROM {t} p, {t} q WHERE p.{a} IS NOT NULL AND p.{b} IS NOT NULL AND q.{a} IS NOT NULL AND q.{b} IS NOT NULL)"""


_CUST = ["c_custkey", "c_nationkey", "c_acctbal"]
register(
    "corr_spearman", "dirty_orders", lambda d: T.corr_matrix(d, ["custkey", "totalprice", "sparse_col"], "spearman").where("a < b"),
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_ranked(a, b, 'dirty_orders')}, 3) + 0.0 AS r" for a, b in [("custkey", "totalprice"), ("custkey", "sparse_col"), ("sparse_col", "totalprice")]),
)
register(
    "corr_kendall", "customer", lambda c: T.corr_matrix(c, _CUST, "kendall"),
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_tau(a, b, 'customer')}, 3) + 0.0 AS r" for a in _CUST for b in _CUST),
)
_PAIRS = [("x", "x_linear"), ("x", "x_neg"), ("x_linear", "x_neg"), ("x", "x_noisy"), ("x_linear", "x_noisy"), ("x_neg", "x_noisy"), ("x", "x_tied"), ("x_linear", "x_tied"), ("x_neg", "x_tied"), ("x_noisy", "x_tied")]
_PAIR_ROWS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) AS r FROM planted" for a, b in _PAIRS)
register(
    "ranked_pairs", "planted", lambda p: T.ranked_pairs(p, _PLANTED),
    f"SELECT a, b, r, CASE WHEN abs(r) > 0.8 THEN 'Very Strong' WHEN abs(r) > 0.6 THEN 'Strong' WHEN abs(r) > 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength FROM ({_PAIR_ROWS})",
)
register("pair_counts", "planted", lambda p: T.pair_counts(p, ["event_id", *_PLANTED]),
         f"""SELECT count(*) FILTER (abs(r) > 0.7) AS strong, count(*) FILTER (abs(r) < 0.3) AS weak FROM ({_PAIR_ROWS} UNION ALL """
         + " UNION ALL ".join(f"SELECT 'event_id', '{c}', round(corr(event_id, {c}), 3) FROM planted" for c in _PLANTED) + ")")
register(
    "related_columns", "planted", lambda p: T.related_columns(p, "x", ["event_id", *_PLANTED]),
    "SELECT c AS \"column\", round(v, 4) + 0.0 AS r, CASE WHEN v > 0.3 THEN 'positive' WHEN v < -0.3 THEN 'negative' ELSE 'weak' END AS relation FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS c, corr(x, {c}) AS v FROM planted" for c in ["event_id", *_PLANTED[1:]]) + ")",
)
register("corr_test_pearson", "planted", lambda p: T.corr_test(p, "x", "x_noisy").select("r", "n"), "SELECT round(corr(x, x_noisy), 4) AS r, regr_count(x, x_noisy)::BIGINT AS n FROM planted")
register("corr_test_spearman", "dirty_orders", lambda d: T.corr_test(d, "custkey", "totalprice", "spearman").select("r", "n"),
         f"SELECT round({_ranked('custkey', 'totalprice', 'dirty_orders')}, 4) AS r, count(*) AS n FROM dirty_orders WHERE custkey IS NOT NULL AND totalprice IS NOT NULL")
_ETA = "(SELECT sum(n * power(m - g, 2)) / any_value(t) FROM (SELECT count({y}) AS n, avg({y}) AS m FROM {s} WHERE {c} IS NOT NULL GROUP BY {c}), (SELECT avg({y}) AS g, sum(power({y} - (SELECT avg({y}) FROM {s}), 2)) AS t FROM {s}))"
register(
    "eta_squared", "planted", lambda p: T.eta_squared(p, "event_type", "gap_value"),
    f"SELECT round(e, 4) AS eta_squared, CASE WHEN e > 0.14 THEN 'Strong' WHEN e > 0.06 THEN 'Moderate' ELSE 'Weak' END AS strength FROM (SELECT {_ETA.format(y='gap_value', c='event_type', s='planted')} AS e)",
)
register(
    "eta_matrix", "dirty_orders", lambda d: T.eta_matrix(d, ["orderstatus", "orderpriority"], ["totalprice", "custkey"]),
    "SELECT c AS category, y AS numeric, round(e, 4) AS eta_squared, CASE WHEN round(e, 4) > 0.14 THEN 'Strong' WHEN round(e, 4) > 0.06 THEN 'Moderate' ELSE 'Weak' END AS strength FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS c, '{y}' AS y, {_ETA.format(y=y, c=c, s='dirty_orders')} AS e" for c in ["orderstatus", "orderpriority"] for y in ["totalprice", "custkey"]) + ")",
)
_CHI = """WITH o AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
r AS (SELECT a, sum(o) AS r FROM o GROUP BY a), c AS (SELECT b, sum(o) AS c FROM o GROUP BY b), n AS (SELECT sum(o) AS n FROM o),
g AS (SELECT coalesce(o.o, 0) AS o, r.r * c.c / n.n AS e FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN o ON o.a = r.a AND o.b = c.b),
k AS (SELECT (SELECT count(*) FROM r) AS i, (SELECT count(*) FROM c) AS j),
x AS (SELECT sum(power(CASE WHEN i = 2 AND j = 2 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE o - e END, 2) / e) AS x FROM g, k)
SELECT round(x, 4) AS chi2, CAST((i - 1) * (j - 1) AS BIGINT) AS dof, round(sqrt(x / ((SELECT count(*) FROM {t}) * (least(i, j) - 1))), 4) AS cramers_v,
CASE WHEN sqrt(x / ((SELECT count(*) FROM {t}) * (least(i, j) - 1))) > 0.5 THEN 'strong' WHEN sqrt(x / ((SELECT count(*) FROM {t}) * (least(i, j) - 1))) > 0.3 THEN 'moderate' ELSE 'weak' END AS association FROM x, k"""
register("chi_square", "dirty_orders", lambda d: T.chi_square(d, "orderstatus", "orderpriority").drop("p_value", "significant"), _CHI.format(a="orderstatus", b="orderpriority", t="dirty_orders"))
register("chi_square_two_by_two", "text_orders", lambda t: T.chi_square(t.withColumn("is_true", F.col("flag_txt") == "TRUE"), "is_true", "is_big").drop("p_value", "significant"),
         _CHI.format(a="is_true", b="is_big", t="(SELECT *, flag_txt = 'TRUE' AS is_true FROM text_orders) s"))

# ------------------------------------------------------------------ tests

register(
    "ttest_ind", "planted", lambda p: T.ttest_ind(p, "gap_value", "event_type", "purchase", "view").drop("p_value", "significant"),
    """WITH s AS (SELECT count(gap_value) FILTER (event_type = 'purchase') AS n1, avg(gap_value) FILTER (event_type = 'purchase') AS m1, var_samp(gap_value) FILTER (event_type = 'purchase') AS v1,
    count(gap_value) FILTER (event_type = 'view') AS n2, avg(gap_value) FILTER (event_type = 'view') AS m2, var_samp(gap_value) FILTER (event_type = 'view') AS v2 FROM planted)
    SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 4) AS t, n1 + n2 - 2 AS dof, round(m1, 4) AS mean_1, round(m2, 4) AS mean_2 FROM s""",
)
register("ttest_1samp", "orders", lambda o: T.ttest_1samp(o, "o_totalprice", 250000.0).drop("p_value", "significant"),
         "SELECT round((avg(o_totalprice) - 250000) / (stddev_samp(o_totalprice) / sqrt(count(*))), 4) AS t, count(*) - 1 AS dof, round(avg(o_totalprice), 4) AS mean FROM orders")
register(
    "mann_whitney", "planted", lambda p: T.mann_whitney(p, "x_tied", "event_type", "purchase", "view").drop("p_value", "significant"),
    """WITH r AS (SELECT event_type, rank() OVER (ORDER BY x_tied) + (count(*) OVER (PARTITION BY x_tied) - 1) / 2 AS k FROM planted WHERE event_type IN ('purchase', 'view')),
    s AS (SELECT sum(k) FILTER (event_type = 'purchase') AS r1, count(*) FILTER (event_type = 'purchase') AS n1, count(*) FILTER (event_type = 'view') AS n2 FROM r)
    SELECT round(r1 - n1 * (n1 + 1) / 2, 4) AS u, n1, n2 FROM s""",
)
register(
    "anova", "planted", lambda p: T.anova(p, "gap_value", "event_type").drop("p_value", "significant"),
    """WITH g AS (SELECT event_type, count(*) AS n, avg(gap_value) AS m FROM planted GROUP BY event_type), a AS (SELECT avg(gap_value) AS m, count(*) AS n FROM planted),
    w AS (SELECT sum(power(gap_value - g.m, 2)) AS w FROM planted JOIN g USING (event_type)), b AS (SELECT sum(g.n * power(g.m - a.m, 2)) AS b, count(*) AS k FROM g, a)
    SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS f, k - 1 AS df_between, n - k AS df_within FROM a, w, b""",
)


def _poly_sql(coef: list[float], x: str) -> str:
    out = repr(coef[0])
    for c in coef[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _quantile_sql(p: str) -> str:
    """Inverse normal of ``p`` on the checking engine."""
    ratio = lambda parts, x: f"{_poly_sql(parts[0], x)} / {_poly_sql(parts[1], x)}"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    outer = f"CASE WHEN {r} <= 5 THEN {ratio(C.PPF_TAIL, f'({r} - 1.6)')} ELSE {ratio(C.PPF_FAR, f'({r} - 5)')} END"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(C.PPF_MIDDLE, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} ELSE sign({p} - 0.5) * ({outer}) END"


def _shapiro_sql(col: str, t: str) -> str:
    """W of all rows with Royston's weights, each row with its own."""
    return f"""(WITH v AS (SELECT {col}::DOUBLE AS x, row_number() OVER (ORDER BY {col}) AS i, count(*) OVER ()::DOUBLE AS n FROM {t} WHERE {col} IS NOT NULL),
    q AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM v), m AS (SELECT x, i, n, {_quantile_sql('p')} AS m FROM q),
    s AS (SELECT sum(m * m) AS mm, any_value(n) AS n, max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2, 1 / sqrt(any_value(n)) AS u FROM m),
    e AS (SELECT *, ((((-2.706056 * u + 4.434685) * u - 2.07119) * u - 0.147981) * u + 0.221157) * u + m1 / sqrt(mm) AS a1,
      ((((-3.582633 * u + 5.682633) * u - 1.752461) * u - 0.293762) * u + 0.042981) * u + m2 / sqrt(mm) AS a2 FROM s),
    f AS (SELECT *, (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi FROM e),
    a AS (SELECT x, CASE WHEN i = m.n THEN a1 WHEN i = m.n - 1 THEN a2 WHEN i = 1 THEN -a1 WHEN i = 2 THEN -a2 ELSE m / sqrt(phi) END AS a FROM m, f)
    SELECT power(sum(a * (x - (SELECT avg(x) FROM v))), 2) / sum(power(x - (SELECT avg(x) FROM v), 2)) FROM a)"""


#: Distribution function of the normal on the checking engine: its logistic form is no match, so the error function is summed as a series.
_ERF_SQL = "list_sum([power(-1, k) * power({z} / sqrt(2), 2 * k + 1) / (factorial(k::INTEGER)::DOUBLE * (2 * k + 1)) FOR k IN range(30)]) * 2 / sqrt(pi())"


def _ks_sql(col: str, t: str) -> str:
    z = f"(({{x}} - (SELECT avg({col}) FROM {t})) / (SELECT stddev_samp({col}) FROM {t}))"
    phi = f"(0.5 + 0.5 * {_ERF_SQL.format(z='z')})"
    return f"""(SELECT max(greatest(u / n - p, p - (u - w) / n)) FROM (SELECT u, w, n, {phi} AS p FROM (SELECT {z.format(x='x')} AS z, w, sum(w) OVER (ORDER BY x) AS u, sum(w) OVER () AS n
    FROM (SELECT {col}::DOUBLE AS x, count(*) AS w FROM {t} WHERE {col} IS NOT NULL GROUP BY 1))))"""


register("shapiro_wilk", "orders", lambda o: T.shapiro_wilk(o, "o_totalprice").select("column", "w", "n"),
         f"SELECT 'o_totalprice' AS \"column\", round({_shapiro_sql('o_totalprice', 'orders')}, 4) AS w, count(o_totalprice) AS n FROM orders")
register("shapiro_wilk_sample", "orders", lambda o: T.shapiro_wilk(o, "o_totalprice", "o_orderkey", most=5000))
register(
    "dagostino_k2", "orders", lambda o: T.dagostino_k2(o, ["o_totalprice"]),
    """WITH m AS (SELECT count(*)::DOUBLE AS n, avg(power(d, 3)) / power(avg(d * d), 1.5) AS g, avg(power(d, 4)) / power(avg(d * d), 2) AS b FROM (SELECT o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS d FROM orders)),
    s AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
    (b - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (power(n + 1, 2) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS q FROM m),
    z AS (SELECT ln(y / sqrt(2 / (w2 - 1)) + sqrt(y * y / (2 / (w2 - 1)) + 1)) / sqrt(0.5 * ln(w2)) AS z1, x, 6 + 8 / q * (2 / q + sqrt(1 + 4 / (q * q))) AS a FROM s),
    k AS (SELECT power(z1, 2) + power((1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * power((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))), 1.0 / 3)) / sqrt(2 / (9 * a)), 2) AS k2 FROM z)
    SELECT 'o_totalprice' AS "column", round(k2, 4) AS k2, round(exp(-k2 / 2), 4) AS p_value FROM k""",
)
register("ks_normal", "orders", lambda o: T.ks_normal(o, ["o_totalprice", "o_custkey"]).select("column", "ks"),
         " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round({_ks_sql(c, 'orders')}, 4) AS ks" for c in ("o_totalprice", "o_custkey")))
_NORMALITY = ["l_quantity", "l_extendedprice"]
register(
    "normality_table", "lineitem", lambda l: T.normality_table(l, _NORMALITY).select("column", "shapiro_w", "ks", "is_normal"),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round({_shapiro_sql(c, 'lineitem')}, 4) AS shapiro_w, round({_ks_sql(c, 'lineitem')}, 4) AS ks, false AS is_normal" for c in _NORMALITY),
)
register(
    "qq_points", "orders", lambda o: T.qq_points(o, "o_totalprice", 101).select("point", "sample"),
    "SELECT CAST(i AS INTEGER) AS point, round(v, 4) AS sample FROM (SELECT unnest(range(101)) AS i, unnest(quantile_cont(o_totalprice, [x / 100 FOR x IN range(101)])) AS v FROM orders)",
)
register(
    "distribution_shape", "events", lambda e: T.distribution_shape(e, ["value", "user_id"]),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(skewness({c}), 4) + 0.0 AS skewness, CASE WHEN skewness({c}) > 0.5 THEN 'right-skewed' WHEN skewness({c}) < -0.5 THEN 'left-skewed' ELSE 'symmetric' END AS skew_class,
        round(kurtosis({c}), 4) AS kurtosis, CASE WHEN kurtosis({c}) > 2 THEN 'heavy-tailed' WHEN kurtosis({c}) < -2 THEN 'light-tailed' ELSE 'normal-tailed' END AS tail_class, round(stddev_samp({c}) / avg({c}), 4) AS cv,
        CASE WHEN stddev_samp({c}) / avg({c}) < 0.1 THEN 'very low' WHEN stddev_samp({c}) / avg({c}) < 0.3 THEN 'moderate' ELSE 'high' END AS variability, {_sigma([c], 2, 'events')} AS outliers_2s FROM events"""
        for c in ["value", "user_id"]
    ),
)
register("ols_line", "planted", lambda p: T.ols_line(p, "x_noisy", "gap_value"),
         "SELECT round(regr_slope(gap_value, x_noisy), 4) AS slope, round(regr_intercept(gap_value, x_noisy), 4) AS intercept, round(regr_r2(gap_value, x_noisy), 4) AS r2, regr_count(gap_value, x_noisy)::BIGINT AS n FROM planted")
register("ols_line_grouped", "planted", lambda p: T.ols_line(p, "x_noisy", "gap_value", by="event_type"),
         "SELECT event_type, round(regr_slope(gap_value, x_noisy), 4) AS slope, round(regr_intercept(gap_value, x_noisy), 4) AS intercept, round(regr_r2(gap_value, x_noisy), 4) AS r2, regr_count(gap_value, x_noisy)::BIGINT AS n FROM planted GROUP BY event_type")
register(
    "important_columns", "orders", lambda o: T.important_columns(o, 6),
    """SELECT 'o_orderkey' AS "column", round(stddev_samp(o_orderkey) / avg(o_orderkey) * count(DISTINCT o_orderkey), 2) AS score, 'numeric' AS logical_type FROM orders
    UNION ALL SELECT 'o_custkey', round(stddev_samp(o_custkey) / avg(o_custkey) * count(DISTINCT o_custkey), 2), 'numeric' FROM orders
    UNION ALL SELECT 'o_totalprice', round(stddev_samp(o_totalprice) / avg(o_totalprice) * count(DISTINCT o_totalprice), 2), 'numeric' FROM orders
    UNION ALL SELECT 'o_orderdate', round(count(DISTINCT year(o_orderdate)) * 10.0::DOUBLE, 2), 'date' FROM orders
    UNION ALL SELECT 'o_orderstatus', round(entropy(o_orderstatus) * ln(2) * ln(count(DISTINCT o_orderstatus) + 1), 2), 'categorical' FROM orders
    UNION ALL SELECT 'o_orderpriority', round(entropy(o_orderpriority) * ln(2) * ln(count(DISTINCT o_orderpriority) + 1), 2), 'categorical' FROM orders""",
)

# ------------------------------------------------------------------ time series

_IDX = "(SELECT value AS y, row_number() OVER (ORDER BY event_id) - 1 AS i FROM gappy_events WHERE value IS NOT NULL)"
register(
    "trend", "gappy_events", lambda g: R.trend(g, "value", "event_id").drop("p_value"),
    f"""SELECT round(regr_slope(y, i), 6) + 0.0 AS slope, round(regr_intercept(y, i), 6) AS intercept, round(corr(y, i), 6) + 0.0 AS r, round(regr_r2(y, i), 6) AS r2, count(*) AS n,
    CASE WHEN regr_slope(y, i) > 0 THEN 'Increasing' ELSE 'Decreasing' END AS direction, CASE WHEN abs(corr(y, i)) > 0.7 THEN 'strong' WHEN abs(corr(y, i)) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM {_IDX}""",
    digits=6,
)


register(
    "trend_fitted", "gappy_events", lambda g: R.trend_fitted(g, "value", "event_id").select("event_id", "position", "fitted"),
    """WITH d AS (SELECT event_id, value AS y, row_number() OVER (ORDER BY event_id) - 1 AS i FROM gappy_events WHERE value IS NOT NULL), l AS (SELECT regr_slope(y, i) AS s, regr_intercept(y, i) AS c FROM d)
    SELECT event_id, i AS position, round(c + s * i, 4) AS fitted FROM d, l""",
)
register(
    "forecast", "gappy_events", lambda g: R.forecast(g, "value", "event_id", 20),
    f"""WITH d AS {_IDX}, l AS (SELECT regr_slope(y, i) AS s, regr_intercept(y, i) AS c, count(*) AS n, regr_r2(y, i) AS r2 FROM d), e AS (SELECT stddev_pop(y - (c + s * i)) AS e FROM d, l)
    SELECT CAST(k AS INTEGER) AS period, '+' || k AS label, round(c + s * (n + k - 1), 4) AS forecast, round(c + s * (n + k - 1) - 1.96 * e, 4) AS ci_low, round(c + s * (n + k - 1) + 1.96 * e, 4) AS ci_high,
    CASE WHEN s > 0 THEN 'increase' ELSE 'decrease' END AS direction, CASE WHEN r2 > 0.7 THEN 'high' WHEN r2 > 0.4 THEN 'moderate' ELSE 'low' END AS confidence FROM l, e, (SELECT unnest(range(1, 21)) AS k)""",
)
_RESAMPLE = {
    "D": ("gappy_events", "ts", "value", "CAST(p AS DATE)", "day", "1 day"),
    "W": ("orders", "o_orderdate", "o_totalprice", "CAST(p AS DATE) + 6", "week", "7 days"),
    "ME": ("orders", "o_orderdate", "o_totalprice", "last_day(CAST(p AS DATE))", "month", "1 month"),
    "QE": ("orders", "o_orderdate", "o_totalprice", "last_day(CAST(p + INTERVAL 2 MONTH AS DATE))", "quarter", "3 months"),
    "YE": ("orders", "o_orderdate", "o_totalprice", "last_day(CAST(p + INTERVAL 11 MONTH AS DATE))", "year", "1 year"),
}
for _f, (_t, _d, _v, _label, _unit, _step) in _RESAMPLE.items():
    register(
        f"resample_{_f.lower()}", _t, lambda x, f=_f, d=_d, v=_v: R.resample(x, d, v, f),
        f"""WITH a AS (SELECT CAST(date_trunc('{_unit}', {_d}) AS TIMESTAMP) AS p, avg({_v}) AS m, min({_v}) AS lo, max({_v}) AS hi FROM {_t} WHERE {_v} IS NOT NULL GROUP BY 1),
        s AS (SELECT unnest(generate_series((SELECT min(p) FROM a), (SELECT max(p) FROM a), INTERVAL {_step})) AS p)
        SELECT {_label} AS period, round(m, 8) AS mean, round(lo, 8) AS min, round(hi, 8) AS max FROM s LEFT JOIN a USING (p)""",
        digits=8,  # cents averaged over up to 64 rows end within 8 decimals, so no rounding ties
    )

# ------------------------------------------------------------------ models

register("detect_problem", "orders", lambda o: M.detect_problem(o),
         "SELECT 'o_totalprice' AS target, CASE WHEN count(DISTINCT o_totalprice) > 10 THEN 'Regression' ELSE 'Classification' END AS problem FROM orders")
register(
    "build_features", "orders", lambda o: _features(o),
    """SELECT o_orderkey, CAST(2 + (SELECT count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority) FROM orders) AS INTEGER) AS width,
    round((o_custkey - m1) / s1, 4) AS custkey_scaled, round((o_totalprice - m2) / s2, 4) AS price_scaled
    FROM orders, (SELECT avg(o_custkey) AS m1, stddev_samp(o_custkey) AS s1, avg(o_totalprice) AS m2, stddev_samp(o_totalprice) AS s2 FROM orders)""",
)
register(
    "category_dictionary", "dirty_orders",
    lambda d: dictionary(d, ["orderstatus", "orderkey", "orderpriority"]),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) - 1 AS number
        FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c}""" for c in ("orderstatus", "orderkey", "orderpriority")
    ),
)


def _features(o: DataFrame) -> DataFrame:
    names = ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    from pyspark.ml.functions import vector_to_array

    out = M.build_features(o, names).fit(o).transform(o).select("o_orderkey", vector_to_array(M.FEATURES).alias("f"))
    return out.select("o_orderkey", F.size("f").alias("width"), F.get("f", F.lit(0)).alias("custkey_scaled"), F.get("f", F.lit(1)).alias("price_scaled"))


register("fit_default_regression", "planted", lambda p: M.metrics_table(M.fit_default(p.select("event_id", "x", "event_type", "x_noisy"), "x_noisy", key="event_id"), p))
register("fit_default_classification", "lineitem", lambda l: M.metrics_table(
    M.fit_default(l.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_linestatus"), "l_linestatus", key=["l_orderkey", "l_partkey"], trees=20), l))
_THREE = "CASE WHEN value < 30 THEN 'low' WHEN value < 60 THEN 'middle' ELSE 'top' END"


def _three(e: DataFrame) -> DataFrame:
    """Events with a class that follows from ``value``, one in eleven of the next class."""
    return e.selectExpr("event_id", "value", "user_id", f"CASE WHEN event_id % 11 = 4 THEN 'low' ELSE {_THREE} END AS band")


def _three_predicted(e: DataFrame) -> DataFrame:
    model = M.fit_default(_three(e), "band", key="event_id", features=["value", "user_id"])
    out = M.predict_table(model, _three(e), probabilities=True)
    total = F.aggregate(F.map_values("Probabilities_band"), F.lit(0.0), lambda a, x: a + x)
    return out.select("event_id", "value", "band", "Predicted_band", F.col("Probabilities_band")[F.col("Predicted_band")].alias("p"), total.alias("total"))


register(
    "boosting_three_classes", "events",
    lambda e: _three_predicted(e).groupBy("band").agg(
        F.count(F.lit(1)).alias("rows"), (F.avg((F.col("Predicted_band") == F.expr(_THREE)).cast("int")) > 0.95).alias("found"),
        F.bool_and(F.abs(F.col("total") - 1) < 1e-9).alias("sums_to_one"), F.bool_and(F.col("p") > 0.34).alias("surest_wins"),
    ),
    f"""SELECT band, count(*) AS rows, true AS found, true AS sums_to_one, true AS surest_wins
    FROM (SELECT CASE WHEN event_id % 11 = 4 THEN 'low' ELSE {_THREE} END AS band FROM events) GROUP BY band""",
)
register(
    "compare_models_three_classes", "events",
    lambda e: M.compare_models(_three(e), "band", "Classification", key="event_id", features=["value"], trees=10, boost=5)
    .where("metric = 'accuracy'").select("model", (F.col("value") > F.when(F.col("model") == "Logistic Regression", 0.6).otherwise(0.85)).alias("good")),
    "SELECT unnest(['Logistic Regression', 'Random Forest', 'Gradient Boosting']) AS model, true AS good",
)
register("compare_models", "planted", lambda p: M.compare_models(p.select("event_id", "x", "event_type", "x_noisy"), "x_noisy", key="event_id", trees=100, boost=100))


def _predicted(p: DataFrame) -> DataFrame:
    model = M.fit_default(p.select("event_id", "x", "event_type", "x_noisy"), "x_noisy", key="event_id")
    return M.predict_table(model, p.select("event_id", "x"))


register("predict_table", "planted", _predicted)
register("predict_table_rows", "planted", lambda p: _predicted(p).agg(F.count(F.lit(1)).alias("rows")), "SELECT count(*) AS rows FROM planted")
_KCOLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _kmeans_facts(l: DataFrame) -> DataFrame:
    """Rows, clusters, whether nearly all rows are in the cluster of the nearest mean, and whether clusters explain a third of the variance."""
    done = M.kmeans(l, _KCOLS, 4, restarts=10)
    base = done.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(_KCOLS)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(_KCOLS)])
    z = done.crossJoin(F.broadcast(base)).select("cluster", *[((F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i, c in enumerate(_KCOLS)])
    means = {r["cluster"]: r[1:] for r in z.groupBy("cluster").agg(*[F.avg(f"z{i}") for i in range(3)]).collect()}  # one row a cluster
    names = sorted(means)
    if not names:
        return z.agg(F.count(F.lit(1)).alias("rows"), F.lit(None).cast("long").alias("clusters"), F.lit(None).cast("boolean").alias("nearest"), F.lit(None).cast("boolean").alias("explains"))
    dist = lambda c: sum((F.col(f"z{i}") - F.lit(v)) * (F.col(f"z{i}") - F.lit(v)) for i, v in enumerate(means[c]))
    for j, c in enumerate(names):
        z = z.withColumn(f"d{j}", dist(c))
    own = F.lit(None).cast("double")
    for j, c in enumerate(names):
        own = F.when(F.col("cluster") == c, F.col(f"d{j}")).otherwise(own)
    nearest = F.least(*[f"d{j}" for j in range(len(names))]) if len(names) > 1 else F.col("d0")
    first = F.lit(None).cast("string")
    for j, c in reversed(list(enumerate(names))):
        first = F.when(F.col(f"d{j}") == nearest, F.lit(c)).otherwise(first)
    found = z.agg(F.count(F.lit(1)).alias("rows"), F.sum(own).alias("inside"), F.avg((first == F.col("cluster")).cast("int")).alias("share"))
    clusters = F.lit(len(names)).cast("long").alias("clusters")
    return found.select("rows", clusters, (F.col("share") > 0.99).alias("nearest"), (F.col("inside") < F.col("rows") * 2).alias("explains"))


register("kmeans_facts", "lineitem", _kmeans_facts, "SELECT count(*) AS rows, CAST(4 AS BIGINT) AS clusters, true AS nearest, true AS explains FROM lineitem")
register("kmeans", "lineitem", lambda l: M.cluster_profile(M.kmeans(l, ["l_quantity", "l_extendedprice", "l_discount"], 4, restarts=10), ["l_quantity", "l_extendedprice", "l_discount"]))
register(
    "isolation_forest_counts", "planted",
    lambda p: M.isolation_forest(p, ["x", "x_noisy"], "event_id").agg(F.count(F.lit(1)).alias("rows"), F.count("anomaly_score").alias("scored"), (F.avg(F.col("is_anomaly").cast("int")) <= 0.011).alias("share_holds")),
    "SELECT count(*) AS rows, count(*) AS scored, true AS share_holds FROM planted",
)
register("isolation_forest", "planted", lambda p: M.isolation_forest(p, ["x", "x_noisy"], "event_id").select("event_id", "anomaly_score", "is_anomaly"))
register("anomaly_drivers", "planted", lambda p: M.anomaly_drivers(M.isolation_forest(p, ["x", "x_noisy", "gap_value"], "event_id"), ["x", "x_noisy", "gap_value"]))
register(
    "scenario_bounds", "dirty_orders", lambda d: M.scenario_bounds(d, ["totalprice", "custkey", "const_col"]),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.5)::DOUBLE, 4) AS baseline, round(CASE WHEN quantile_cont({c}, 0.95) <= quantile_cont({c}, 0.05) THEN min({c})::DOUBLE ELSE quantile_cont({c}, 0.05) END, 4) AS low,
        round(CASE WHEN quantile_cont({c}, 0.95) <= quantile_cont({c}, 0.05) THEN max({c})::DOUBLE ELSE quantile_cont({c}, 0.95) END, 4) AS high FROM dirty_orders""" for c in ["totalprice", "custkey", "const_col"]),
)
register("top_drivers", "planted", lambda p: M.top_drivers(p, "gap_value", ["event_id", "x", "x_noisy", "x_tied", "gap_value"], 4),
         " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(abs(corr({c}, gap_value)), 4) AS strength FROM planted" for c in ["event_id", "x", "x_noisy", "x_tied"]))
register(
    "score_scenarios", "planted", lambda p: M.score_scenarios(p, "gap_value", drivers=["x", "x_noisy"], scenarios=p.groupBy("event_type").agg(F.max("x").alias("x"))),
    """WITH z AS (SELECT gap_value AS y, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS a, (x_noisy - avg(x_noisy) OVER ()) / stddev_pop(x_noisy) OVER () AS b FROM planted),
    s AS (SELECT count(*) AS n, avg(y) AS my, sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS ay, sum(b * y) AS by_, var_pop(y) AS vy FROM z),
    w AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM s),
    e AS (SELECT stddev_pop(y - (my + wa * a + wb * b)) AS sd FROM z, w),
    m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, quantile_cont(x, 0.5) AS qx, avg(x_noisy) AS mn, stddev_pop(x_noisy) AS sn, quantile_cont(x_noisy, 0.5) AS qn FROM planted),
    p AS (SELECT event_type, max(x) AS x FROM planted GROUP BY event_type),
    r AS (SELECT event_type, x, my + wa * (x - mx) / sx + wb * (qn - mn) / sn AS prediction, my + wa * (qx - mx) / sx + wb * (qn - mn) / sn AS baseline, 1.96 * sd * sqrt(1 + 1 / n) AS half, 1 - sd * sd / vy AS r2 FROM p, w, e, m)
    SELECT event_type, round(x, 3) AS x, round(prediction, 3) AS prediction, round(baseline, 3) AS baseline, round(prediction - half, 3) AS ci_low, round(prediction + half, 3) AS ci_high,
    round(prediction - baseline, 3) AS delta, round((prediction - baseline) / greatest(abs(baseline), 0.01) * 100, 3) AS delta_pct, round(r2, 3) AS r2 FROM r""",
    digits=3,
)

# ------------------------------------------------------------------ insight facts


def _fact(kind: str, column: str | None = None, value: str = "NULL", text: str = "NULL", other: str = "NULL", rest: str = "") -> str:
    c = "NULL::VARCHAR" if column is None else f"'{column}'"
    return f"SELECT '{kind}' AS kind, {c} AS \"column\", {other}::VARCHAR AS other, round(({value})::DOUBLE, 4) AS value, ({text})::VARCHAR AS text {rest}"


def _facts(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def _top(c: str, t: str = "dirty_orders") -> str:
    return f"SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1"


def _top_n(c: str, t: str = "dirty_orders") -> str:
    return f"SELECT count(*) FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1"


register(
    "auto_insights", "dirty_orders", lambda d: I.auto_insights(d).drop("rank"),
    _facts(
        _fact("highest missing", "sparse_col", "count(*) - count(sparse_col)", rest="FROM dirty_orders"),
        _fact("most unique", "orderkey", "count(DISTINCT orderkey)", rest="FROM dirty_orders"),
        _fact("largest value", "totalprice", "max(totalprice)", rest="FROM dirty_orders"),
        _fact("smallest value", "orderkey", "min(orderkey)", rest="FROM dirty_orders"),
        _fact("categorical", "orderstatus"), _fact("categorical", "const_col"), _fact("categorical", "orderpriority"),
    ),
)
register(
    "column_facts", "dirty_orders", lambda d: I.column_facts(d).select("column", "logical_type", "n", "low", "high", "mean", "median", "skew_class", "outliers", "distinct", "top", "top_pct", "earliest", "latest", "years"),
    _facts(*[
        f"""SELECT '{c}' AS "column", 'numeric' AS logical_type, count({c}) AS n, round(min({c})::DOUBLE, 4) AS low, round(max({c})::DOUBLE, 4) AS high, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5)::DOUBLE, 4) AS median,
        CASE WHEN skewness({c}) > 0.5 THEN 'right-skewed' WHEN skewness({c}) < -0.5 THEN 'left-skewed' ELSE 'symmetric' END AS skew_class, {_sigma([c], 2)} AS outliers, NULL::BIGINT AS "distinct", NULL AS top, NULL::DOUBLE AS top_pct, NULL AS earliest, NULL AS latest, NULL::INTEGER AS years FROM dirty_orders"""
        for c in _DIRTY_NUM
    ], *[
        f"""SELECT '{c}', 'categorical', count({c}), NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}), CAST(({_top(c)}) AS VARCHAR), round(({_top_n(c)}) / count({c}) * 100, 1), NULL, NULL, NULL FROM dirty_orders"""
        for c in ["orderstatus", "const_col", "orderpriority"]
    ], "SELECT 'orderdate', 'date', count(orderdate), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(min(orderdate)::DATE AS VARCHAR), CAST(max(orderdate)::DATE AS VARCHAR), CAST(count(DISTINCT year(orderdate)) AS INTEGER) FROM dirty_orders"),
)
register(
    "column_facts_text", "text_orders", lambda t: I.column_facts(t).where("logical_type IN ('text', 'boolean')").select("column", "logical_type", "n", "avg_length", "true_pct"),
    _facts(*[f"SELECT '{c}' AS \"column\", 'text' AS logical_type, count({c}) AS n, round(avg(length({c})), 4) AS avg_length, NULL::DOUBLE AS true_pct FROM text_orders" for c in ["amount_txt", "iso_txt", "email_txt", "money_txt", "phone_txt", "coord_txt"]],
           "SELECT 'is_big', 'boolean', count(is_big), NULL, round(avg(CASE WHEN is_big THEN 1.0 ELSE 0.0 END) * 100, 1) FROM text_orders"),
)
register(
    "executive_facts", "dirty_orders", lambda d: I.executive_facts(d).drop("rank"),
    _facts(
        *[_fact(f"kpi {k}", c, f"{fn}({c})", rest="FROM dirty_orders") for c in _DIRTY_NUM for k, fn in [("mean", "avg"), ("total", "sum"), ("min", "min"), ("max", "max")]],
        *[_fact("kpi top share", c, f"round(({_top_n(c)}) / {_N} * 100, 1)", f"CAST(({_top(c)}) AS VARCHAR)") for c in ["orderstatus", "const_col", "orderpriority"]],
        _fact("risk missing", None, f"SELECT {_MISSING} FROM dirty_orders"),
        _fact("risk duplicates", None, _DUPS),
        _fact("risk collinearity", "custkey", "abs(corr(custkey, sparse_col))", other="'sparse_col'", rest="FROM dirty_orders"),
        _fact("action impute"), _fact("action deduplicate"), _fact("action review over time", "orderdate"),
        *[_fact("action investigate drivers", c) for c in _DIRTY_NUM], *[_fact("action segment", c) for c in ["orderstatus", "const_col", "orderpriority"]],
    ),
)
register(
    "story_facts", "orders", lambda o: I.story_facts(o, "o_orderkey").drop("rank"),
    _facts(
        *[_fact("direction", c, "NULL", f"CASE WHEN arg_max({c}, o_orderkey) > arg_min({c}, o_orderkey) THEN 'increased' ELSE 'decreased' END", rest="FROM orders") for c in ["o_orderkey", "o_custkey", "o_totalprice"]],
        *[_fact("top category", c, "NULL", _top(c, "orders")) for c in ["o_orderstatus", "o_orderpriority"]],
        *[_fact("largest total", c, f"sum({c})", rest=f"FROM orders HAVING sum({c}) = greatest({', '.join('(SELECT sum(' + x + ') FROM orders)' for x in ['o_orderkey', 'o_custkey', 'o_totalprice'])})") for c in ["o_orderkey", "o_custkey", "o_totalprice"]],
        *[_fact(f"range {k}", c, v.format(c=c), rest="FROM orders") for c in ["o_orderkey", "o_custkey", "o_totalprice"] for k, v in [("min", "min({c})"), ("max", "max({c})"), ("q1", "quantile_cont({c}, 0.25)"), ("q3", "quantile_cont({c}, 0.75)")]],
        *[_fact("most common", c, f"round(({_top_n(c, 'orders')}) / (SELECT count(*) FROM orders) * 100, 1)", _top(c, "orders")) for c in ["o_orderstatus", "o_orderpriority"]],
        *[_fact(k, c, f"quantile_cont({c}, {q})", rest="FROM orders") for c in ["o_orderkey", "o_custkey", "o_totalprice"] for k, q in [("advice below", 0.05), ("advice above", 0.95)]],
        _fact("rows", None, "count(*)", rest="FROM orders"), _fact("columns", None, "6"), _fact("verdict", None, "NULL", "'good'"),
    ),
)
register(
    "business_facts", "planted", lambda p: I.business_facts(p.select("x", "x_noisy", "gap_value", "event_type")).drop("rank"),
    _facts(
        _fact("strongest pair", "x", "corr(x, x_noisy)", "CASE WHEN abs(corr(x, x_noisy)) > 0.7 THEN 'strong' ELSE 'moderate' END", "'x_noisy'", "FROM planted"),
        _fact("dominant share", "event_type", f"({_top_n('event_type', 'planted')}) / (SELECT count(*) FROM planted) * 100", _top("event_type", "planted")),
        *[_fact(k, c, v.format(c=c), rest="FROM planted") for c in ["x", "x_noisy", "gap_value"] for k, v in [("mean", "avg({c})"), ("min", "min({c})"), ("max", "max({c})"), ("median", "quantile_cont({c}, 0.5)")]],
    ),
)
register("chart_candidates", "planted", lambda p: I.chart_candidates(p))
register("chart_candidates_orders", "orders", lambda o: I.chart_candidates(o))
register(
    "row_insight", "orders", lambda o: I.row_insight(o, "o_orderkey", [1, 2, 3]),
    _facts(*[
        f"""SELECT o_orderkey AS row_key, '{c}' AS "column", CAST({c} AS VARCHAR) AS value, round(({c} - m) / s, 4) AS z, CASE WHEN abs(({c} - m) / s) > 2 THEN 'HIGH' ELSE 'normal' END AS flag, NULL::DOUBLE AS share_pct
        FROM orders, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM orders) WHERE o_orderkey IN (1, 2, 3)""" for c in ["o_orderkey", "o_custkey", "o_totalprice"]
    ], *[
        f"""SELECT o_orderkey, '{c}', {c}, NULL, NULL, round((SELECT count(*) FROM orders q WHERE q.{c} = o.{c}) / (SELECT count(*) FROM orders) * 100, 4) FROM orders o WHERE o_orderkey IN (1, 2, 3)""" for c in ["o_orderstatus", "o_orderpriority"]
    ], "SELECT o_orderkey, 'o_orderdate', CAST(o_orderdate AS VARCHAR), NULL, NULL, NULL FROM orders WHERE o_orderkey IN (1, 2, 3)"),
)
register(
    "row_comparison", "orders", lambda o: I.row_comparison(o, "o_orderkey", [1, 2, 3]),
    _facts(*[
        f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) = 1 THEN 'consistent' ELSE 'range' END AS verdict, round(min({c})::DOUBLE, 4) AS low, round(max({c})::DOUBLE, 4) AS high, round((max({c}) - min({c}))::DOUBLE, 4) AS delta,
        round((max({c}) - min({c})) / (SELECT stddev_samp({c}) FROM orders), 4) AS delta_sigmas, count(DISTINCT {c}) AS "distinct" FROM orders WHERE o_orderkey IN (1, 2, 3)""" for c in ["o_orderkey", "o_custkey", "o_totalprice"]
    ], *[
        f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) = 1 THEN 'consistent' ELSE 'different' END, NULL, NULL, NULL, NULL, count(DISTINCT {c}) FROM orders WHERE o_orderkey IN (1, 2, 3)" for c in ["o_orderstatus", "o_orderdate", "o_orderpriority"]
    ]),
)


def _report(d: DataFrame) -> DataFrame:
    """Section names with their row counts."""
    out = None
    for name, part in I.report_tables(d).items():
        one = part.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("section"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


register("report_tables", "dirty_orders", _report)
register(
    "group_tables", "dirty_orders", lambda d: L.group_tables(d, ["orderstatus", "orderpriority"], ["totalprice", "custkey"]),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS category, {c} AS level, '{x}' AS "column", count({x}) AS count, round(avg({x}), 4) AS mean, round(CAST(coalesce(sum({x}), 0) AS DOUBLE), 4) AS sum
        FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c}""" for c in ("orderstatus", "orderpriority") for x in ("totalprice", "custkey")
    ),
)


def _merged_profile(l: DataFrame) -> DataFrame:
    """A profile merged from five parts, its estimates judged against exact figures."""
    states = None
    for p in range(5):
        one = K.profile_state(l.where(F.col("l_orderkey") % 5 == p), ["l_quantity", "l_extendedprice"])
        states = one if states is None else states.unionByName(one)
    t = K.state_profile(K.merge_states(states))
    x = F.when(F.col("column") == "l_quantity", F.col("l_quantity").cast("double")).otherwise(F.col("l_extendedprice").cast("double"))
    cells = l.select(F.explode(F.array(F.lit("l_quantity"), F.lit("l_extendedprice"))).alias("column"), "l_quantity", "l_extendedprice").select("column", x.alias("x"))
    ranks = cells.join(F.broadcast(t), "column").groupBy("column").agg(
        F.avg((F.col("x") <= F.col("q0_5")).cast("int")).alias("upto"), F.avg((F.col("x") < F.col("q0_5")).cast("int")).alias("below"), F.count_distinct("x").alias("k")
    )
    close = (F.col("below") <= 0.52) & (F.col("upto") >= 0.48) & (F.abs(F.col("nunique") / F.col("k") - 1) < 0.05)
    return t.join(F.broadcast(ranks), "column").select("column", "rows", "missing", "mean", "std", "min", "max", close.alias("close"))


register(
    "profile_of_parts", "lineitem", _merged_profile,
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, true AS close FROM lineitem""" for c in ("l_quantity", "l_extendedprice")
    ),
)
register(
    "nunique_documents", "documents", nunique_table,
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS nunique, count(*) - count({c}) AS missing FROM documents""" for c in ("doc_id", "text", "lang", "source", "n_chars")),
)
