"""Queries for grouping, profiling and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import register
from sondage.operators import chartdata as C
from sondage.operators import ordered as O
from sondage.operators import profile as P
from sondage.operators import relational as R
from sondage.operators.types import column_types, semantic_types
from sondage.plans.ordering import with_global_index

# ------------------------------------------------------------------ grouping

for _fn, _sql in {
    "sum": "sum(l_extendedprice)", "mean": "avg(l_extendedprice)", "count": "count(l_extendedprice)", "max": "max(l_extendedprice)",
    "min": "min(l_extendedprice)", "median": "quantile_cont(l_extendedprice, 0.5)", "std": "stddev_samp(l_extendedprice)", "var": "var_samp(l_extendedprice)",
}.items():
    _digits = 4 if _fn == "median" else 2  # the middle of two prices has three decimals
    register(
        f"group_agg_{_fn}", "lineitem", lambda l, fn=_fn: R.group_agg(l, "l_returnflag", "l_extendedprice", fn),
        f"SELECT l_returnflag, {_sql if _fn == 'count' else f'round({_sql}, {_digits})'} AS {_fn}_l_extendedprice FROM lineitem GROUP BY l_returnflag",
        digits=_digits,
    )
register("group_agg_null_keys", "dirty_orders", lambda d: R.group_agg(d, "orderstatus", "totalprice", "mean"),
         "SELECT orderstatus, round(avg(totalprice), 4) AS mean_totalprice FROM dirty_orders WHERE orderstatus IS NOT NULL GROUP BY orderstatus")
register("pivot_table", "lineitem", lambda l: R.pivot_table(l, "l_returnflag", "l_quantity", "mean", columns="l_linestatus", levels=["F", "O"]),
         """SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 4) AS "F", round(avg(l_quantity) FILTER (l_linestatus = 'O'), 4) AS "O" FROM lineitem GROUP BY l_returnflag""")
register("pivot_table_median", "orders", lambda o: R.pivot_table(o, "o_orderpriority", "o_totalprice", "median"),
         "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median_o_totalprice FROM orders GROUP BY o_orderpriority")
register("group_multi", "lineitem", lambda l: R.group_multi(l, "l_returnflag", "l_extendedprice"),
         "SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 2) AS mean, round(sum(l_extendedprice), 2) AS sum FROM lineitem GROUP BY l_returnflag", digits=2)
register("top_groups_by_mean", "part", lambda p: R.top_groups_by_mean(p, "p_brand", "p_retailprice", 10),
         "SELECT p_brand, round(avg(p_retailprice), 4) AS mean_p_retailprice FROM part GROUP BY p_brand ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 10")
register("frequency_table", "dirty_orders", lambda d: R.frequency_table(d, "orderstatus"),
         """WITH c AS (SELECT orderstatus, count(*) AS count, round(count(*) * 100.0 / (SELECT count(orderstatus) FROM dirty_orders), 2)::DOUBLE AS percentage FROM dirty_orders WHERE orderstatus IS NOT NULL GROUP BY orderstatus)
         SELECT orderstatus, count, percentage, round(sum(percentage) OVER (ORDER BY count DESC, orderstatus ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM c""")
register("frequency_table_many_values", "customer", lambda c: R.frequency_table(c, "c_nationkey"),
         """WITH c AS (SELECT c_nationkey, count(*) AS count, CAST(round(count(*) * 100.0 / (SELECT count(*) FROM customer), 2) AS DOUBLE) AS percentage FROM customer GROUP BY c_nationkey)
         SELECT c_nationkey, count, percentage, round(sum(percentage) OVER (ORDER BY count DESC, c_nationkey ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM c""")
register("value_counts", "part", lambda p: R.value_counts(p, "p_brand", 10), "SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 10")
register("crosstab", "dirty_orders", lambda d: R.crosstab(d, "orderstatus", "orderpriority", zeros=True),
         """SELECT r.orderstatus, c.orderpriority, count(d.orderkey) AS count FROM (SELECT DISTINCT orderstatus FROM dirty_orders WHERE orderstatus IS NOT NULL) r
         CROSS JOIN (SELECT DISTINCT orderpriority FROM dirty_orders WHERE orderpriority IS NOT NULL) c
         LEFT JOIN dirty_orders d ON d.orderstatus = r.orderstatus AND d.orderpriority = c.orderpriority GROUP BY ALL""")
register("crosstab_wide", "part", lambda p: R.crosstab(p, "p_size", "p_type", wide=True),
         "SELECT p_size, " + ", ".join(f"count(*) FILTER (p_type = '{t}') AS \"{t}\"" for t in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]) + " FROM part GROUP BY p_size")
register("crosstab_occurring", "part", lambda p: R.crosstab(p, "p_name", "p_brand"), "SELECT p_name, p_brand, count(*) AS count FROM part GROUP BY ALL")
register("counts_over_time", "orders", lambda o: R.counts_over_time(o, "o_orderdate", "o_orderstatus"),
         "SELECT o_orderdate, o_orderstatus, count(*) AS count FROM orders GROUP BY ALL")
register("category_sums_positive", "customer", lambda c: R.category_sums(c, "c_mktsegment", "c_acctbal", positive_only=True),
         "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment HAVING sum(c_acctbal) > 0", digits=2)
register("category_sums_top", "part", lambda p: R.category_sums(p, "p_brand", "p_retailprice", k=10),
         "SELECT p_brand, round(sum(p_retailprice), 2) AS total FROM part GROUP BY p_brand ORDER BY sum(p_retailprice) DESC, p_brand LIMIT 10", digits=2)
register("category_sums_colored", "orders", lambda o: R.category_sums(o, "o_orderpriority", "o_totalprice", color="o_orderstatus"),
         "SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL", digits=2)
register("group_extremes", "planted", lambda p: R.group_extremes(p, "event_type", "gap_value"),
         """WITH m AS (SELECT event_type AS g, avg(gap_value) AS v FROM planted GROUP BY event_type)
         SELECT arg_max(g, v) AS best, round(max(v), 4) AS best_mean, arg_min(g, v) AS worst, round(min(v), 4) AS worst_mean,
         round((max(v) - min(v)) / greatest(abs(min(v)), 0.01) * 100, 4) AS gap_pct, (max(v) - min(v)) / greatest(abs(min(v)), 0.01) * 100 > 20 AS flagged FROM m""")

# ------------------------------------------------------------------ numeric profiles

_Q = "count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c})::DOUBLE, 4) AS max"
register("describe", "lineitem", lambda l: P.describe(l, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
         " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_Q.format(c=c)} FROM lineitem" for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
register("describe_grouped", "dirty_orders", lambda d: P.describe(d, ["totalprice", "custkey"], by="orderstatus"),
         " UNION ALL ".join(f"SELECT orderstatus, '{c}' AS \"column\", {_Q.format(c=c)} FROM dirty_orders WHERE orderstatus IS NOT NULL GROUP BY orderstatus" for c in ["totalprice", "custkey"]))


def summary_sql(table: str, cols: list[str]) -> str:
    """Summary figures by the checking engine's own functions (its skewness and kurtosis are already bias-corrected)."""
    one = """SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
    (SELECT round({c}::DOUBLE, 4) FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
    round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round((max({c}) - min({c}))::DOUBLE, 4) AS range, round(stddev_samp({c}), 4) AS std, round(var_samp({c}), 4) AS variance,
    (SELECT round(avg(abs({c} - m)), 4) FROM {t}, (SELECT avg({c}) AS m FROM {t})) AS mad, round(stddev_samp({c}) / avg({c}) * 100, 4) AS cv_pct,
    round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr,
    round(quantile_cont({c}, 0.05), 4) AS p5, round(quantile_cont({c}, 0.95), 4) AS p95, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis,
    round(avg({c}) - 1.96 * stddev_samp({c}) / sqrt(count({c})), 4) AS ci_low, round(avg({c}) + 1.96 * stddev_samp({c}) / sqrt(count({c})), 4) AS ci_high,
    (SELECT count(*) FROM {t}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {t}) WHERE abs({c} - m) > 3 * s) AS outliers FROM {t}"""
    return " UNION ALL ".join(one.format(c=c, t=table) for c in cols)


register("numeric_summary", "dirty_orders", lambda d: P.numeric_summary(d).drop("variance"),
         f"SELECT * EXCLUDE (variance) FROM ({summary_sql('dirty_orders', ['orderkey', 'custkey', 'totalprice', 'sparse_col'])})")
register("numeric_summary_lineitem", "lineitem", lambda l: P.numeric_summary(l, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).drop("variance"),
         f"SELECT * EXCLUDE (variance) FROM ({summary_sql('lineitem', ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])})")
register("moments_table", "events", lambda e: P.moments_table(e, ["value", "user_id"]),
         " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(skewness({c}), 3) AS skewness, round(kurtosis({c}), 3) AS kurtosis,
         (SELECT count(*) FROM events, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM events) WHERE abs({c} - m) > 3 * s) AS outliers FROM events""" for c in ["value", "user_id"]), digits=3)
register("quantiles", "lineitem", lambda l: P.quantiles(l, ["l_quantity", "l_extendedprice"], [0.05, 0.25, 0.5, 0.75, 0.95]),
         " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(CAST({q} AS DOUBLE), 4) AS q, round(quantile_cont({c}, {q}), 4) AS value FROM lineitem""" for c in ["l_quantity", "l_extendedprice"] for q in (0.05, 0.25, 0.5, 0.75, 0.95)))
register("extreme_values", "lineitem", lambda l: P.extreme_values(l),
         """SELECT 'max' AS kind, 'l_extendedprice' AS "column", round(max(l_extendedprice), 4) AS value FROM lineitem UNION ALL
         SELECT 'min', 'l_orderkey', CAST(min(l_orderkey) AS DOUBLE) FROM lineitem""")

# ------------------------------------------------------------------ missing, duplicates, distinct, table profile

_DIRTY = ["orderkey", "custkey", "orderstatus", "totalprice", "sparse_col", "const_col", "orderdate", "orderpriority"]
register("missing_table", "dirty_orders", P.missing_table,
         " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS missing_pct FROM dirty_orders" for c in _DIRTY))
register("duplicate_count", "dirty_orders", P.duplicate_count,
         "SELECT (SELECT count(*) FROM dirty_orders) AS rows, (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS duplicates")
register("duplicate_rows", "dirty_orders", P.duplicate_rows,
         "SELECT orderkey, custkey, orderstatus, round(totalprice, 4) AS totalprice, sparse_col, const_col, orderdate, orderpriority FROM dirty_orders WHERE orderkey IN (SELECT orderkey FROM dirty_orders GROUP BY orderkey HAVING count(*) > 1)")
register("duplicate_rows_documents", "documents", lambda d: P.duplicate_rows(d.select("text", "lang", "n_chars")).select("lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5")),
         "SELECT d.lang, d.n_chars, md5(d.text) AS text_md5 FROM documents d JOIN (SELECT text, lang, n_chars FROM documents GROUP BY ALL HAVING count(*) > 1) g ON g.text = d.text AND g.lang = d.lang AND g.n_chars = d.n_chars")
register("nunique_table", "dirty_orders", P.nunique_table,
         " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nunique, count(*) - count({c}) AS missing FROM dirty_orders" for c in _DIRTY))
register("most_unique", "orders", P.most_unique, "SELECT 'o_orderkey' AS \"column\", count(DISTINCT o_orderkey) AS nunique FROM orders")
register("dataset_summary", "dirty_orders", P.dataset_summary,
         """WITH n AS (SELECT count(*) AS rows, """ + " + ".join(f"count(*) - count({c})" for c in _DIRTY) + """ AS missing FROM dirty_orders), u AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM dirty_orders))
         SELECT rows, CAST(8 AS BIGINT) AS columns, CAST(4 AS BIGINT) AS numeric_cols, CAST(3 AS BIGINT) AS categorical_cols, CAST(1 AS BIGINT) AS date_cols, CAST(0 AS BIGINT) AS text_cols, CAST(0 AS BIGINT) AS boolean_cols,
         missing, rows - k AS duplicates, round(missing / (rows * 8) * 100, 2) AS missing_pct, round((rows - k) / rows * 100, 2) AS duplicate_pct,
         CASE WHEN greatest(missing / (rows * 8), (rows - k) / rows) > 0.2 THEN 'poor' WHEN greatest(missing / (rows * 8), (rows - k) / rows) > 0.05 THEN 'fair' ELSE 'excellent' END AS quality FROM n, u""")
register("column_profile", "dirty_orders", P.column_profile,
         " UNION ALL ".join(
             f"""SELECT '{c}' AS "column", '{k}' AS logical_type, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, count(DISTINCT {c}) AS "unique", count(*) - count(DISTINCT {c}) AS repeats, """
             + (f"round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std, " if k == "numeric" else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std, ")
             + "NULL::INTEGER AS longest, NULL::INTEGER AS shortest, NULL::VARCHAR AS most_common, "
             + (f"min({c})::DATE AS earliest, max({c})::DATE AS latest" if k == "date" else "NULL::DATE AS earliest, NULL::DATE AS latest")
             + " FROM dirty_orders"
             for c, k in zip(_DIRTY, ["numeric", "numeric", "categorical", "numeric", "numeric", "categorical", "date", "categorical"])
         ))
register("column_profile_text", "part", lambda p: P.column_profile(p).where("logical_type = 'text'").select("column", "unique", "longest", "shortest", "most_common"),
         """SELECT 'p_name' AS "column", count(DISTINCT p_name) AS "unique", CAST(max(length(p_name)) AS INTEGER) AS longest, CAST(min(length(p_name)) AS INTEGER) AS shortest,
         (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 1) AS most_common FROM part
         UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), CAST(max(length(p_brand)) AS INTEGER), CAST(min(length(p_brand)) AS INTEGER),
         (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1) FROM part""")


def _dictionary_row(c: str, kind: str) -> str:
    numeric = "true" if kind in ("Integer", "Float") else "false"
    return f"""SELECT '{c}' AS "column", '{kind}' AS type,
    CASE WHEN count(DISTINCT {c}) = count(*) AND count(*) > 100 THEN 'ID / Primary Key' WHEN count(DISTINCT {c}) <= 20 AND count(*) > 100 THEN 'Categorical' WHEN {numeric} THEN 'Numeric' ELSE 'Text / Description' END AS role,
    count(*) - count({c}) AS missing, round((1 - (count(*) - count({c})) / count(*)) * 100, 1) AS completeness, count(DISTINCT {c}) AS "unique",
    (SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM dirty_orders WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS sample FROM dirty_orders"""


register("data_dictionary", "dirty_orders", P.data_dictionary,
         " UNION ALL ".join(_dictionary_row(c, k) for c, k in zip(_DIRTY, ["Integer", "Integer", "Text", "Float", "Integer", "int", "Date", "Text"])))
register("mode_value", "dirty_orders", lambda d: P.mode_value(d, "orderstatus"), "SELECT orderstatus AS value, count(*) AS count FROM dirty_orders WHERE orderstatus IS NOT NULL GROUP BY orderstatus ORDER BY count(*) DESC, orderstatus LIMIT 1")
register("least_frequent", "part", lambda p: P.least_frequent(p, "p_brand"), "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY p_brand ORDER BY count(*), p_brand DESC LIMIT 1")
register("entropy", "orders", lambda o: P.entropy(o, "o_orderpriority"), "SELECT round(entropy(o_orderpriority) * ln(2), 4) AS entropy FROM orders")
register("kpis", "orders", P.kpis,
         """SELECT 'Total Rows' AS kpi, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'Total Columns', 6.0::DOUBLE UNION ALL SELECT 'Missing Values', 0.0::DOUBLE UNION ALL SELECT 'Duplicates', 0.0::DOUBLE
         UNION ALL SELECT 'Average Value', round((avg(o_orderkey) + avg(o_custkey) + avg(o_totalprice)) / 3, 2) FROM orders UNION ALL SELECT 'Total Revenue', round(sum(o_totalprice), 2) FROM orders""")
register("kpis_without_money", "events", P.kpis,
         """SELECT 'Total Rows' AS kpi, CAST(count(*) AS DOUBLE) AS value FROM events UNION ALL SELECT 'Total Columns', 6.0::DOUBLE UNION ALL SELECT 'Missing Values', 0.0::DOUBLE UNION ALL SELECT 'Duplicates', 0.0::DOUBLE
         UNION ALL SELECT 'Average Value', round((avg(event_id) + avg(user_id) + avg(value)) / 3, 2) FROM events UNION ALL SELECT 'Total Sum', round(sum(event_id) + sum(user_id) + sum(value), 2) FROM events""")
register("text_stats", "documents", lambda d: P.text_stats(d, "text"),
         "SELECT count(text) AS n, round(avg(length(text)), 4) AS avg_length, CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length, (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text ORDER BY count(*) DESC, text LIMIT 1) AS most_common FROM documents")
register("text_stats_common", "part", lambda p: P.text_stats(p, "p_name"),
         """SELECT count(p_name) AS n, round(avg(length(p_name)), 4) AS avg_length, CAST(min(length(p_name)) AS INTEGER) AS min_length, CAST(max(length(p_name)) AS INTEGER) AS max_length,
         (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 1) AS most_common FROM part""")
register("date_span", "events", lambda e: P.date_span(e, "ts"),
         "SELECT CAST(min(ts) AS DATE) AS earliest, CAST(max(ts) AS DATE) AS latest, count(DISTINCT year(ts)) AS years, CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) AS days FROM events")
register("monthly_counts", "orders", lambda o: P.monthly_counts(o, "o_orderdate"), "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS count FROM orders GROUP BY 1")
register("boolean_split", "text_orders", lambda t: P.boolean_split(t, "is_big"),
         "SELECT round(avg(CASE WHEN is_big THEN 1.0 ELSE 0.0 END) * 100, 1) AS true_pct, round(100 - round(avg(CASE WHEN is_big THEN 1.0 ELSE 0.0 END) * 100, 1), 1) AS false_pct FROM text_orders")

# ------------------------------------------------------------------ types


def _types_sql(table: str, kinds: dict) -> str:
    rule = {
        "n": "CASE WHEN count(DISTINCT {c}) <= 10 AND coalesce(bool_and({c} = floor({c})), true) THEN 'categorical' ELSE 'numeric' END",
        "s": "CASE WHEN count(DISTINCT {c}) < 20 THEN 'categorical' ELSE 'text' END",
        "d": "CASE WHEN count(*) >= 0 THEN 'date' END", "b": "CASE WHEN count(*) >= 0 THEN 'boolean' END",
    }
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {rule[k].format(c=c)} AS logical_type FROM {table}" for c, k in kinds.items())


register("column_types_lineitem", "lineitem", lambda l: column_types(l).select("column", "logical_type"),
         _types_sql("lineitem", {"l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n", "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": "d"}))
register("column_types_dirty", "dirty_orders", lambda d: column_types(d).select("column", "logical_type"),
         _types_sql("dirty_orders", dict(zip(_DIRTY, "nnsnnnds"))))
register("column_types_part", "part", lambda p: column_types(p).select("column", "logical_type"),
         _types_sql("part", {"p_partkey": "n", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "n", "p_retailprice": "n"}))


def _share(c: str, pattern: str) -> str:
    return f"round(avg(CASE WHEN regexp_matches({c}, '{pattern}') THEN 1.0 ELSE 0.0 END) * 100, 1)"


register("semantic_types", "text_orders", lambda t: semantic_types(t).select("column", "semantic_type", "confidence"),
         f"""SELECT 'k' AS "column", 'Continuous Numeric' AS semantic_type, 95.0::DOUBLE AS confidence UNION ALL SELECT 'is_big', 'Ordinal / Binned Numeric', 95.0 UNION ALL SELECT 'amount_txt', 'Free Text', 100.0
         UNION ALL SELECT 'flag_txt', 'Boolean Equivalent', round(avg(CASE WHEN lower(flag_txt) IN ('yes','no','true') THEN 1.0 ELSE 0.0 END) * 100, 1) FROM text_orders
         UNION ALL SELECT 'iso_txt', 'Date (ISO 8601)', {_share('iso_txt', '^[0-9]{4}-[0-9]+-[0-9]+$')} FROM text_orders
         UNION ALL SELECT 'email_txt', 'Email Address', {_share('email_txt', '@example[.]com$')} FROM text_orders
         UNION ALL SELECT 'money_txt', 'Currency String', {_share('money_txt', '^[$][0-9.]+$')} FROM text_orders
         UNION ALL SELECT 'phone_txt', 'Phone Number', {_share('phone_txt', '^555-[0-9]+$')} FROM text_orders
         UNION ALL SELECT 'coord_txt', 'Geographic Coordinates (Lat, Lon)', {_share('coord_txt', '^[0-9]+[.]5, -[0-9]+[.]25$')} FROM text_orders""")

# ------------------------------------------------------------------ ordered operators

register("running_total", "gappy_events", lambda g: O.running_total(g, "value", "event_id").select("event_id", "running_total"),
         "SELECT event_id, CASE WHEN value IS NOT NULL THEN round(sum(value) OVER (ORDER BY event_id), 2) END AS running_total FROM gappy_events", digits=2)
register("running_total_partitioned", "gappy_events", lambda g: O.running_total(g, "value", "ts", "user_id").select("event_id", "running_total"),
         "SELECT event_id, CASE WHEN value IS NOT NULL THEN round(sum(value) OVER (PARTITION BY user_id ORDER BY ts), 2) END AS running_total FROM gappy_events", digits=2)
register("rank_by", "dirty_orders", lambda d: O.rank_by(d, "totalprice").select("orderkey", "totalprice", "rank"),
         """SELECT orderkey, round(totalprice, 4) AS totalprice, CASE WHEN totalprice IS NOT NULL THEN CAST(floor(rank() OVER (ORDER BY totalprice DESC NULLS LAST) + (count(*) OVER (PARTITION BY totalprice) - 1) / 2) AS BIGINT) END AS rank FROM dirty_orders""")
register("rank_by_partitioned", "events", lambda e: O.rank_by(e, "value", "event_type").select("event_id", "rank"),
         "SELECT event_id, CAST(floor(rank() OVER (PARTITION BY event_type ORDER BY value DESC) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2) AS BIGINT) AS rank FROM events")
_ROLL = """SELECT event_id, CASE WHEN k = 7 THEN round(m, 4) END AS rolling_mean, CASE WHEN k = 7 THEN round(s, 4) END AS rolling_std, CASE WHEN k = 7 THEN round(m + s, 4) END AS upper, CASE WHEN k = 7 THEN round(m - s, 4) END AS lower FROM (
SELECT event_id, count(value) OVER w AS k, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM {t} WINDOW w AS ({p} ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""
_ROLLED = ["event_id", "rolling_mean", "rolling_std", "upper", "lower"]
register("rolling_stats", "events", lambda e: O.rolling_stats(e, "value", 7, "ts").select(*_ROLLED), _ROLL.format(t="events", p=""))
register("rolling_stats_partitioned", "gappy_events", lambda g: O.rolling_stats(g, "value", 7, "ts", "user_id").select(*_ROLLED), _ROLL.format(t="gappy_events", p="PARTITION BY user_id"))
register("growth_rate", "gappy_events", lambda g: O.growth_rate(g, "value", "event_id").select("event_id", "growth_pct"),
         "SELECT event_id, round((value - lag(value) OVER (ORDER BY event_id)) / nullif(lag(value) OVER (ORDER BY event_id), 0) * 100, 4) AS growth_pct FROM gappy_events WHERE value IS NOT NULL")
register("growth_summary", "events", lambda e: O.growth_summary(e, "value", "event_id"),
         """WITH g AS (SELECT (value - lag(value) OVER (ORDER BY event_id)) / nullif(lag(value) OVER (ORDER BY event_id), 0) * 100 AS p FROM events)
         SELECT round(avg(p), 4) AS mean_growth, round(avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) FILTER (p IS NOT NULL) * 100, 4) AS positive_pct, 'Mixed growth pattern' AS pattern FROM g""")
register("fill_forward", "gappy_events", lambda g: O.fill_forward(g, "value", "event_id").select("event_id", "value"),
         "SELECT event_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS value FROM gappy_events")
register("fill_backward", "gappy_events", lambda g: O.fill_backward(g, "value", "event_id").select("event_id", "value"),
         "SELECT event_id, round(first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS value FROM gappy_events")
register("fill_forward_partitioned", "gappy_events", lambda g: O.fill_forward(g, "value", "ts", "user_id").select("event_id", "value"),
         "SELECT event_id, round(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS value FROM gappy_events")
register("fill_backward_partitioned", "gappy_events", lambda g: O.fill_backward(g, "value", "ts", "user_id").select("event_id", "value"),
         "SELECT event_id, round(first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS value FROM gappy_events")
register("first_last_trend", "orders", lambda o: O.first_last_trend(o, ["o_totalprice", "o_custkey"], "o_orderkey"),
         " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(arg_min({c}, o_orderkey)::DOUBLE, 4) AS first_value, round(arg_max({c}, o_orderkey)::DOUBLE, 4) AS last_value,
         CASE WHEN arg_max({c}, o_orderkey) > arg_min({c}, o_orderkey) THEN 'increased' ELSE 'decreased' END AS direction FROM orders""" for c in ["o_totalprice", "o_custkey"]))
register("drop_duplicates", "dirty_orders", lambda d: O.drop_duplicates(d).agg(F.count(F.lit(1)).alias("rows"), F.sum("custkey").alias("keys")),
         "SELECT count(*) AS rows, CAST(sum(custkey) AS BIGINT) AS keys FROM (SELECT DISTINCT * FROM dirty_orders)")
register("drop_duplicates_subset", "events", lambda e: O.drop_duplicates(e, "ts", "last", ["user_id", "event_type"]),
         "SELECT event_id, ts, user_id, event_type, round(value, 4) AS value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r FROM events) WHERE r = 1")
register("difference", "gappy_events", lambda g: O.diff(g, "value", "event_id").select("event_id", "difference"),
         "SELECT event_id, round(value - lag(value) OVER (ORDER BY event_id), 4) AS difference FROM gappy_events")
register("difference_partitioned", "events", lambda e: O.diff(e, "value", "ts", "user_id").select("event_id", "difference"),
         "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 4) AS difference FROM events")
register("is_monotonic", "events", lambda e: O.is_monotonic(e, "ts", "event_id"),
         "SELECT bool_and(d >= 0) AS increasing, bool_and(d <= 0) AS decreasing FROM (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY event_id) AS d FROM events) WHERE d IS NOT NULL")
register("global_index", "events", lambda e: with_global_index(e, "ts").select("event_id", "row_index"), "SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS row_index FROM events")
register("global_index_partitioned", "events", lambda e: with_global_index(e, "ts", "event_type").select("event_id", "row_index"),
         "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS row_index FROM events")

# ------------------------------------------------------------------ chart data

_BOX = """SELECT {k}count(*) AS n, round(q1, 4) AS q1, round(m, 4) AS median, round(q3, 4) AS q3, round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low, round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers FROM (SELECT {k}totalprice AS v FROM dirty_orders WHERE totalprice IS NOT NULL {w}) d
JOIN (SELECT {k}quantile_cont(totalprice, 0.25) AS q1, quantile_cont(totalprice, 0.5) AS m, quantile_cont(totalprice, 0.75) AS q3 FROM dirty_orders {g}) q {j} GROUP BY {k}q1, m, q3"""
register("box_stats", "dirty_orders", lambda d: C.box_stats(d, "totalprice"), _BOX.format(k="", w="", g="", j="ON true"))
register("box_stats_grouped", "dirty_orders", lambda d: C.box_stats(d, "totalprice", "orderstatus"),
         _BOX.format(k="orderstatus, ", w="AND orderstatus IS NOT NULL", g="GROUP BY orderstatus", j="USING (orderstatus)"))
_HIST = """WITH s AS (SELECT min({c}) AS lo, max({c}) AS hi, count({c}) AS n, least({most}, greatest(10, floor(count(DISTINCT {c}) / 5)))::INTEGER AS k FROM {t}),
b AS (SELECT least(floor(({c} - lo) / ((hi - lo) / k)), k - 1)::INTEGER AS bin, count(*) AS c FROM {t}, s WHERE {c} IS NOT NULL GROUP BY 1),
e AS (SELECT unnest(range(k))::INTEGER AS bin, lo, (hi - lo) / k AS w, n FROM s)
SELECT e.bin, round(lo + e.bin * w, 4) AS low, round(lo + (e.bin + 1) * w, 4) AS high, coalesce(c, 0) AS count{d} FROM e LEFT JOIN b USING (bin)"""
register("histogram", "lineitem", lambda l: C.histogram(l, "l_extendedprice"), _HIST.format(c="l_extendedprice", t="lineitem", most=50, d=""))
register("histogram_density", "events", lambda e: C.histogram(e, "value", density=True, most=60), _HIST.format(c="value", t="events", most=60, d=", round(coalesce(c, 0) / (n * w), 6) AS density").replace(", 4)", ", 6)"), digits=6)
register("histogram_overlay", "orders", lambda o: C.histogram(o, "o_totalprice", 12, by="o_orderstatus"),
         """WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 12 AS w FROM orders),
         e AS (SELECT o_orderstatus, unnest(range(12))::INTEGER AS bin FROM (SELECT DISTINCT o_orderstatus FROM orders)),
         b AS (SELECT o_orderstatus, least(floor((o_totalprice - lo) / w), 11)::INTEGER AS bin, count(*) AS c FROM orders, s GROUP BY 1, 2)
         SELECT e.o_orderstatus, e.bin, round(lo + e.bin * w, 4) AS low, round(lo + (e.bin + 1) * w, 4) AS high, coalesce(c, 0) AS count FROM e LEFT JOIN b USING (o_orderstatus, bin), s""")
register("histogram_2d", "lineitem", lambda l: C.histogram2d(l, "l_quantity", "l_extendedprice", 20),
         """SELECT least(floor((l_quantity - a) / ((b - a) / 20)), 19)::INTEGER AS x_bin, least(floor((l_extendedprice - c) / ((d - c) / 20)), 19)::INTEGER AS y_bin, count(*) AS count FROM lineitem,
         (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem) GROUP BY 1, 2""")
_KDE = """WITH v AS (SELECT {key} CAST({x} AS DOUBLE) AS x FROM {t} WHERE {x} IS NOT NULL), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT {key} least(floor((x - lo) / ((hi - lo) / 1024)), 1023) AS bin, count(*) AS n, avg(x) AS m FROM v, e GROUP BY ALL),
h AS (SELECT {key} stddev_samp(x) * power(count(*)::DOUBLE, -0.2) AS h, count(*) AS total FROM v {group}),
g AS (SELECT unnest(range(64)) AS i)
SELECT {bkey} round(e.lo + g.i * ((e.hi - e.lo) / 63), 4) AS x, round(sum(exp(-power((e.lo + g.i * ((e.hi - e.lo) / 63) - b.m) / h.h, 2) / 2) * b.n / (h.h * h.total * sqrt(2 * pi()))), 10) AS density
FROM b {join}, e, g GROUP BY {bkey} g.i, e.lo, e.hi"""
register("kde", "lineitem", lambda l: C.kde(l, "l_extendedprice").withColumn("x", F.round("x", 4)), _KDE.format(x="l_extendedprice", t="lineitem", key="", group="", bkey="", join="CROSS JOIN h"), digits=10)
register("kde_grouped", "orders", lambda o: C.kde(o, "o_totalprice", "o_orderstatus").withColumn("x", F.round("x", 4)),
         _KDE.format(x="o_totalprice", t="orders", key="o_orderstatus,", group="GROUP BY ALL", bkey="b.o_orderstatus,", join="JOIN h ON h.o_orderstatus = b.o_orderstatus"), digits=10)
