"""Queries for reading, writing, versioning, projecting, filtering, joining and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.base import register, scratch
from sondage.functions.columns import band, numeric_columns
from sondage.operators import relational as R
from sondage.operators.profile import column_profile, filter_profile
from sondage.sources import tables as S
from sondage.sources.versions import VersionedTable

# ------------------------------------------------------------------ sources and sinks


def _csv_round_trip(orders: DataFrame) -> DataFrame:
    path = scratch(orders, "csv")
    S.write_csv(orders, path)
    back = S.read_table(orders.sparkSession, path, "csv")
    return back.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"), "o_orderpriority")


register(
    "read_csv", "orders",
    lambda o: _csv_round_trip(o).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus", "o_totalprice", "day", "o_orderpriority"),
    "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, CAST(o_orderdate AS DATE) AS day, o_orderpriority FROM orders",
)
register(
    "write_csv", "part",
    lambda p: _written(p, "csv").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_retailprice").alias("total")),
    "SELECT p_type, count(*) AS n, round(sum(p_retailprice), 4) AS total FROM part GROUP BY p_type",
)
register(
    "write_json", "part",
    lambda p: _written(p, "json").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_retailprice").alias("total")),
    "SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 4) AS total FROM part GROUP BY p_brand",
)


def _written(df: DataFrame, fmt: str) -> DataFrame:
    path = scratch(df, fmt)
    (S.write_csv if fmt == "csv" else S.write_json)(df, path)
    return S.read_table(df.sparkSession, path, fmt, schema=df.schema)


register(
    "coerce_types", "text_orders",
    lambda t: S.coerce_types(t, {"amount_txt": "numeric", "iso_txt": "date"}).select("k", "amount_txt", "iso_txt", "flag_txt"),
    "SELECT k, round(TRY_CAST(amount_txt AS DOUBLE), 4) AS amount_txt, TRY_CAST(iso_txt AS TIMESTAMP) AS iso_txt, flag_txt FROM text_orders",
)


def _bundle(df: DataFrame) -> DataFrame:
    path = scratch(df, "bundle")
    S.export_bundle(df, path)
    spark = df.sparkSession
    parts = {"dataset_csv": S.read_table(spark, f"{path}/dataset_csv", "csv", df.schema), "dataset_json": S.read_table(spark, f"{path}/dataset_json", "json", df.schema)}
    out = None
    for name, part in parts.items():
        one = part.agg(F.count(F.lit(1)).alias("rows"), F.sum("totalprice").alias("total")).select(F.lit(name).alias("part"), "rows", "total")
        out = one if out is None else out.unionByName(one)
    return out


register(
    "export_bundle", "dirty_orders", _bundle,
    "SELECT part, n AS rows, total FROM (SELECT count(*) AS n, round(sum(totalprice), 2) AS total FROM dirty_orders), (VALUES ('dataset_csv'), ('dataset_json')) v(part)",
    digits=2,
)
register(
    "schema_table", "orders", lambda o: S.schema_table(o).select("column", "type", "sample"),
    """SELECT 'o_orderkey' AS "column", 'bigint' AS type, CAST(min(o_orderkey) AS VARCHAR) AS sample FROM orders
    UNION ALL SELECT 'o_custkey', 'bigint', CAST(min(o_custkey) AS VARCHAR) FROM orders
    UNION ALL SELECT 'o_orderstatus', 'string', min(o_orderstatus) FROM orders
    UNION ALL SELECT 'o_totalprice', 'double', CAST(min(o_totalprice) AS VARCHAR) FROM orders
    UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', CAST(min(o_orderdate) AS VARCHAR) FROM orders
    UNION ALL SELECT 'o_orderpriority', 'string', min(o_orderpriority) FROM orders""",
)
register("table_fingerprint", "orders", S.table_fingerprint)


def _fingerprints(o: DataFrame) -> DataFrame:
    """Whether the fingerprint is the same after a shuffle, and after one value changed."""
    own, shuffled = S.table_fingerprint(o), S.table_fingerprint(o.repartition(7, "o_custkey"))
    changed = S.table_fingerprint(o.withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderkey") == 1).cast("int")))
    keys = ["rows", "hash_xor", "hash_sum"]
    same = lambda t: t.agg(F.first(F.struct(*keys))).scalar() == F.struct(*keys)
    return own.select("rows", same(shuffled).alias("same_shuffled"), same(changed).alias("same_changed"))


register("table_fingerprint_contract", "orders", _fingerprints, "SELECT count(*) AS rows, true AS same_shuffled, false AS same_changed FROM orders")


def _versions(df: DataFrame) -> VersionedTable:
    v = VersionedTable(df.sparkSession, scratch(df, "versions"))
    v.commit(df)
    v.commit(df.distinct(), "Remove Duplicates", "dropped repeated rows")
    v.commit(v.load().na.drop(subset=["totalprice"]), "Drop Rows", "dropped rows without totalprice")
    v.restore(2)
    return v


register(
    "version_log", "dirty_orders", lambda d: _versions(d).log().drop("recorded"),
    """SELECT 1 AS version, 'Original Dataset' AS name, count(*) AS rows, 8 AS cols, 'Initial upload' AS changes FROM dirty_orders
    UNION ALL SELECT 2, 'Remove Duplicates', count(*), 8, 'dropped repeated rows' FROM (SELECT DISTINCT * FROM dirty_orders)
    UNION ALL SELECT 3, 'Drop Rows', count(*), 8, 'dropped rows without totalprice' FROM (SELECT DISTINCT * FROM dirty_orders) WHERE totalprice IS NOT NULL
    UNION ALL SELECT 4, 'Restored V2', count(*), 8, 'Reverted back to Version 2' FROM (SELECT DISTINCT * FROM dirty_orders)""",
)
register(
    "version_restore", "dirty_orders", lambda d: _versions(d).load(),
    "SELECT DISTINCT orderkey, custkey, orderstatus, round(totalprice, 4) AS totalprice, sparse_col, const_col, orderdate, orderpriority FROM dirty_orders",
)


def _reset(df: DataFrame) -> DataFrame:
    v = _versions(df)
    return v.reset()


register(
    "version_reset", "dirty_orders", _reset,
    "SELECT orderkey, custkey, orderstatus, round(totalprice, 4) AS totalprice, sparse_col, const_col, orderdate, orderpriority FROM dirty_orders",
)
register(
    "audit_trail", "dirty_orders", lambda d: _versions(d).audit_log(),
    """SELECT 2 AS version, 'dropped repeated rows' AS changes WHERE EXISTS (SELECT 1 FROM dirty_orders)
    UNION ALL SELECT 3, 'dropped rows without totalprice' UNION ALL SELECT 4, 'Reverted back to Version 2'""",
)

# ------------------------------------------------------------------ projections and filters

register("select_columns", "orders", lambda o: R.select_columns(o, ["o_orderkey", "o_orderstatus"]), "SELECT o_orderkey, o_orderstatus FROM orders")
register(
    "search_rows", "documents", lambda d: R.search_rows(d, "license").select("doc_id", "lang", "n_chars"),
    """SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(CAST(doc_id AS VARCHAR)), 'license') OR contains(lower(text), 'license')
    OR contains(lower(lang), 'license') OR contains(lower(source), 'license') OR contains(CAST(n_chars AS VARCHAR), 'license')""",
)
register(
    "search_rows_regex", "customer", lambda c: R.search_rows(c, "machin.*y|0077$", ["c_name", "c_mktsegment"], regex=True),
    "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer WHERE regexp_matches(c_name, '(?i)machin.*y|0077$') OR regexp_matches(c_mktsegment, '(?i)machin.*y|0077$')",
)
register("filter_in", "orders", lambda o: R.filter_in(o, "o_orderpriority", ["1-URGENT", "5-LOW"]).select("o_orderkey", "o_orderpriority"),
         "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
register("filter_in_table", ("orders", "customer"), lambda o, c: R.filter_in(o, "o_custkey", c.where("c_acctbal < 0").select("c_custkey")).select("o_orderkey", "o_custkey"),
         "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
register("filter_equal", "lineitem", lambda l: R.filter_equal(l, "l_returnflag", "R").select("l_orderkey", "l_linenumber", "l_quantity"),
         "SELECT l_orderkey, l_linenumber, round(l_quantity, 4) AS l_quantity FROM lineitem WHERE l_returnflag = 'R'")
register("drop_columns", "supplier", lambda s: R.drop_columns(s, ["s_name", "s_acctbal"]), "SELECT s_suppkey, s_nationkey FROM supplier")
register("rename_column", "nation", lambda n: R.rename_column(n, "n_name", "country"), "SELECT n_nationkey, n_name AS country, n_regionkey FROM nation")
register("reorder_columns", "region", lambda r: R.reorder_columns(r, ["r_name"]), "SELECT r_name, r_regionkey FROM region")
register(
    "derive", "dirty_orders",
    lambda d: R.derive(R.derive(R.derive(R.derive(R.derive(R.derive(
        d, "plus", "+", "totalprice", "custkey"), "minus", "-", "totalprice", "custkey"), "times", "*", "custkey", "sparse_col"),
        "ratio", "/", "totalprice", "sparse_col"), "logged", "log", "custkey"), "root", "sqrt", "totalprice")
    .select("orderkey", "plus", "minus", "times", "ratio", "logged", "root"),
    """SELECT orderkey, round(totalprice + custkey, 4) AS plus, round(totalprice - custkey, 4) AS minus, round(CAST(custkey * sparse_col AS DOUBLE), 4) AS times,
    round(totalprice / nullif(sparse_col, 0), 4) AS ratio, round(CASE WHEN custkey > 0 THEN ln(custkey) END, 4) AS logged,
    round(sqrt(CASE WHEN totalprice < 0 THEN 0 ELSE totalprice END), 4) AS root FROM dirty_orders""",
)
register("drop_nulls", "dirty_orders", lambda d: R.drop_nulls(d, ["orderstatus", "totalprice"]).select("orderkey", "orderstatus", "totalprice"),
         "SELECT orderkey, orderstatus, round(totalprice, 4) AS totalprice FROM dirty_orders WHERE orderstatus IS NOT NULL AND totalprice IS NOT NULL")
register("numeric_columns", "lineitem", lambda l: l.select(numeric_columns(l)).agg(*[F.count(c).alias(c) for c in numeric_columns(l)]),
         "SELECT " + ", ".join(f"count({c}) AS {c}" for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]) + " FROM lineitem")
register("melt", "lineitem", lambda l: R.melt(l, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"]),
         """SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, round(l_quantity, 4) AS value FROM lineitem
         UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', round(l_discount, 4) FROM lineitem
         UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', round(l_tax, 4) FROM lineitem""")
register("band", "customer", lambda c: c.select("c_custkey", band(F.col("c_acctbal"), [(5000, "high"), (1000, "middle")], "low").alias("class")),
         "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 1000 THEN 'middle' ELSE 'low' END AS class FROM customer")
register(
    "filter_profile", "dirty_orders", lambda d: filter_profile(column_profile(d), "order", ["categorical", "date"]).select("column", "logical_type", "nulls", "unique"),
    """SELECT 'orderstatus' AS "column", 'categorical' AS logical_type, count(*) - count(orderstatus) AS nulls, count(DISTINCT orderstatus) AS "unique" FROM dirty_orders
    UNION ALL SELECT 'orderpriority', 'categorical', count(*) - count(orderpriority), count(DISTINCT orderpriority) FROM dirty_orders
    UNION ALL SELECT 'orderdate', 'date', count(*) - count(orderdate), count(DISTINCT orderdate) FROM dirty_orders""",
)

# ------------------------------------------------------------------ two tables

_COMPARED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


register(
    "compare_tables", ("orders", "orders_v2"), R.compare_tables,
    """WITH p AS (SELECT 'x' AS c, 0 AS ua, 0 AS ma, 0 AS ub, 0 AS mb WHERE false """
    + "".join(f"UNION ALL SELECT '{c}', (SELECT count(DISTINCT {c}) FROM orders), (SELECT count(*) - count({c}) FROM orders), (SELECT count(DISTINCT {c}) FROM orders_v2), (SELECT count(*) - count({c}) FROM orders_v2) " for c in _COMPARED)
    + """)
    SELECT c AS "column", 'common' AS status, ua AS unique_a, ub AS unique_b, ma AS missing_a, mb AS missing_b, (ua <> ub OR ma <> mb) AS changed FROM p
    UNION ALL SELECT 'channel', 'added', NULL, count(DISTINCT channel), NULL, count(*) - count(channel), NULL FROM orders_v2
    UNION ALL SELECT 'o_orderpriority', 'removed', count(DISTINCT o_orderpriority), NULL, count(*) - count(o_orderpriority), NULL, NULL FROM orders""",
)
register(
    "compare_kpis", ("orders", "orders_v2"), R.compare_kpis,
    """SELECT c AS "column", round(a, 4) AS mean_a, round(b, 4) AS mean_b, round((b - a) / a * 100, 1) AS delta_pct,
    CASE WHEN round((b - a) / a * 100, 1) > 1 THEN 'Increase' WHEN round((b - a) / a * 100, 1) < -1 THEN 'Decrease' ELSE 'Stable' END AS change FROM (
    SELECT 'o_orderkey' AS c, (SELECT avg(o_orderkey) FROM orders) AS a, (SELECT avg(o_orderkey) FROM orders_v2) AS b
    UNION ALL SELECT 'o_custkey', (SELECT avg(o_custkey) FROM orders), (SELECT avg(o_custkey) FROM orders_v2)
    UNION ALL SELECT 'o_totalprice', (SELECT avg(o_totalprice) FROM orders), (SELECT avg(o_totalprice) FROM orders_v2))""",
)

# ------------------------------------------------------------------ sorts, limits, samples

_ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority"
register("top_n", "orders", lambda o: R.top_n(o, "o_totalprice", 10, tie="o_orderkey"), f"SELECT {_ORDER_COLS} FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 10")
register("bottom_n", "orders", lambda o: R.bottom_n(o, "o_totalprice", 10, tie="o_orderkey"), f"SELECT {_ORDER_COLS} FROM orders ORDER BY orders.o_totalprice, o_orderkey LIMIT 10")
register("top_n_selected", "orders", lambda o: R.top_n(o, "o_totalprice", 10, tie="o_orderkey", select=["o_totalprice", "o_orderstatus", "o_orderpriority"]),
         "SELECT round(o_totalprice, 4) AS o_totalprice, o_orderstatus, o_orderpriority FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)")
register("ordered_series", "gappy_events", lambda g: R.ordered_series(g, "ts", "value"), "SELECT ts, round(value, 4) AS value FROM gappy_events WHERE value IS NOT NULL ORDER BY ts")
register("head_n", "orders", lambda o: R.head_n(o, 25, "o_orderkey"), f"SELECT {_ORDER_COLS} FROM orders ORDER BY o_orderkey LIMIT 25")
register("tail_n", "orders", lambda o: R.tail_n(o, 15, "o_orderkey"), f"SELECT {_ORDER_COLS} FROM orders ORDER BY o_orderkey DESC LIMIT 15")
register("sample_n_contract", "orders", lambda o: R.sample_n(o, 5000, "o_orderkey").join(o.select("o_orderkey"), "o_orderkey", "left_semi").agg(F.count_distinct("o_orderkey").alias("n")),
         "SELECT least(5000, count(DISTINCT o_orderkey)) AS n FROM orders")
register("sample_n", "orders", lambda o: R.sample_n(o, 5000, "o_orderkey"))
register("plot_rows", "events", lambda e: R.plot_rows(e, ["value", "user_id", "event_type"], 5000, "event_id"))
register("distinct_rows", "dirty_orders", R.distinct_rows,
         "SELECT DISTINCT orderkey, custkey, orderstatus, round(totalprice, 4) AS totalprice, sparse_col, const_col, orderdate, orderpriority FROM dirty_orders")
register("pct_contribution", "orders", lambda o: R.pct_contribution(o, "o_totalprice", "o_orderkey"),
         "SELECT o_orderkey, round(o_totalprice / (SELECT sum(o_totalprice) FROM orders) * 100, 6) AS contribution FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", digits=6)
register("waterfall", "dirty_orders", lambda d: R.waterfall(d.distinct(), "orderpriority", "totalprice", "orderkey"),
         """WITH f AS (SELECT DISTINCT * FROM dirty_orders WHERE totalprice IS NOT NULL ORDER BY orderkey LIMIT 12)
         SELECT CAST(row_number() OVER (ORDER BY orderkey) AS INTEGER) AS step, orderpriority AS label, round(totalprice, 4) AS value,
         CASE WHEN row_number() OVER (ORDER BY orderkey) = 1 THEN 'absolute' ELSE 'relative' END AS measure,
         round(sum(totalprice) OVER (ORDER BY orderkey), 4) AS level FROM f""")
register("arg_max", "orders", lambda o: R.arg_extreme(o, "o_totalprice", "o_orderkey", "max"),
         "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 1")
register("arg_min", "customer", lambda c: R.arg_extreme(c, "c_acctbal", "c_custkey", "min"),
         "SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal FROM customer ORDER BY customer.c_acctbal, c_custkey LIMIT 1")

# ------------------------------------------------------------------ casts, categories, text

register(
    "convert", "text_orders",
    lambda t: R.convert(R.convert(R.convert(R.convert(R.convert(
        t.withColumn("whole_txt", F.col("k").cast("string")), "amount_txt", "float"), "flag_txt", "boolean"), "iso_txt", "date"), "whole_txt", "integer"), "k", "text")
    .select("k", "amount_txt", "flag_txt", "iso_txt", "whole_txt"),
    """SELECT CAST(k AS VARCHAR) AS k, round(TRY_CAST(amount_txt AS DOUBLE), 4) AS amount_txt, CASE WHEN lower(flag_txt) IN ('yes', 'true') THEN true WHEN lower(flag_txt) = 'no' THEN false END AS flag_txt,
    TRY_CAST(iso_txt AS TIMESTAMP) AS iso_txt, k AS whole_txt FROM text_orders""",
)
register("convert_truthy", "dirty_orders", lambda d: R.convert(R.convert(d, "sparse_col", "boolean", truthy=True), "orderstatus", "boolean", truthy=True).select("orderkey", "sparse_col", "orderstatus"),
         "SELECT orderkey, coalesce(sparse_col <> 0, true) AS sparse_col, coalesce(length(orderstatus) > 0, true) AS orderstatus FROM dirty_orders")
register("convert_category", "nation", lambda n: R.convert(n, "n_regionkey", "category"), "SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
register("cap_categories", "part", lambda p: R.cap_categories(p, "p_brand", 20).select("p_partkey", "p_brand"),
         """SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 20) THEN p_brand ELSE 'Other' END AS p_brand FROM part""")
register("extract_dates", "order_notes", lambda n: R.extract_dates(n, "k", "note"),
         """SELECT DISTINCT k, d AS date FROM (
         SELECT k, TRY_CAST(regexp_extract(note, 'Placed (\\d{4}-\\d\\d-\\d\\d)', 1) AS DATE) AS d FROM order_notes
         UNION ALL SELECT k, TRY_CAST(regexp_extract(note, '/(\\d{4}) ', 1) || '-' || lpad(regexp_extract(note, '/(\\d+)/', 1), 2, '0') || '-' || lpad(regexp_extract(note, 'due (\\d+)/', 1), 2, '0') AS DATE) FROM order_notes
         UNION ALL SELECT k, DATE '1999-03-05' FROM order_notes UNION ALL SELECT k, DATE '2000-04-07' FROM order_notes) WHERE d IS NOT NULL""")

# ------------------------------------------------------------------ ad-hoc SQL and expressions

register("sql_aggregate", "lineitem", lambda l: R.sql(l, """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS avg_disc, count(*) AS n
    FROM dataset WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus"""),
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 2) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    digits=2)
register("sql_self_join", "nation", lambda n: R.sql(n, "SELECT a.n_name AS left_name, b.n_name AS right_name FROM dataset a JOIN dataset b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
         "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
register("sql_rollup", "orders", lambda o: R.sql(o, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM dataset GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
         "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", digits=2)
register("sql_set_operations", "orders", lambda o: R.sql(o, """
    (SELECT o_custkey FROM dataset WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM dataset WHERE o_orderstatus = 'O')
    EXCEPT SELECT o_custkey FROM dataset WHERE o_orderstatus = 'P'"""),
    """(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
    EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
register("expr_query", "orders", lambda o: R.expr_query(
    o, where="o_totalprice > 100000", group_by=["year(o_orderdate) AS year", "o_orderstatus"],
    aggs={"n": "count(*)", "total": "sum(o_totalprice)", "dearest": "max(o_totalprice)"}, order_by=["total desc"], limit=10),
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(max(o_totalprice), 2) AS dearest FROM orders WHERE o_totalprice > 100000 GROUP BY ALL ORDER BY total DESC LIMIT 10",
    digits=2)
register("expr_select", "lineitem", lambda l: R.expr_query(l, where="l_discount >= 0.05 AND l_quantity < 24", select=["l_orderkey", "l_extendedprice * l_discount AS saved", "upper(l_returnflag) AS flag"]),
         "SELECT l_orderkey, round(l_extendedprice * l_discount, 4) AS saved, upper(l_returnflag) AS flag FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 24")
