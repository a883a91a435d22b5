"""Registry of named queries, table loading and the derived views both engines share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sondage.session import shared_folder

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The same text runs on Spark SQL and on the checking engine.
VIEWS = {
    "dirty_orders": """
WITH b AS (SELECT o_orderkey AS orderkey, o_custkey AS custkey,
  CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_orderstatus END AS orderstatus,
  CASE WHEN o_orderkey % 7 = 2 THEN NULL WHEN o_orderkey % 997 = 5 THEN o_totalprice * 50 ELSE o_totalprice END AS totalprice,
  CASE WHEN o_orderkey % 5 <> 0 THEN NULL ELSE o_custkey END AS sparse_col,
  1 AS const_col, o_orderdate AS orderdate, o_orderpriority AS orderpriority FROM orders)
SELECT * FROM b UNION ALL SELECT * FROM b WHERE orderkey % 50 = 0""",
    "text_orders": """
SELECT o_orderkey AS k,
  CASE WHEN o_orderkey % 20 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(32)) END AS amount_txt,
  CASE WHEN o_orderkey % 3 = 0 THEN 'yes' WHEN o_orderkey % 3 = 1 THEN 'No' ELSE 'TRUE' END AS flag_txt,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS iso_txt,
  CONCAT('user', CAST(o_custkey AS VARCHAR(20)), '@example.com') AS email_txt,
  CONCAT('$', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(32))) AS money_txt,
  CONCAT('555-', LPAD(CAST(o_custkey % 10000 AS VARCHAR(20)), 4, '0')) AS phone_txt,
  CONCAT(CAST(o_custkey % 90 AS VARCHAR(20)), '.5, -', CAST(o_orderkey % 180 AS VARCHAR(20)), '.25') AS coord_txt,
  o_totalprice > 250000 AS is_big
FROM orders""",
    "planted": """
SELECT event_id, value AS x, value * 2 + 5 AS x_linear, -value AS x_neg, value + (event_id % 7) * 10 AS x_noisy,
  CAST(FLOOR(value / 10) AS BIGINT) AS x_tied, event_type,
  CASE WHEN event_type = 'purchase' THEN value * 3 ELSE value END AS gap_value, 7 AS constant
FROM events""",
    "gappy_events": """
SELECT event_id, ts, user_id, CASE WHEN event_id % 6 IN (2, 3) THEN NULL ELSE value END AS value
FROM events WHERE EXTRACT(DAY FROM ts) NOT IN (10, 11)""",
    "order_notes": """
SELECT o_orderkey AS k, CONCAT('Placed ', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)),
  ' due ', CAST(EXTRACT(DAY FROM o_orderdate) AS VARCHAR(4)), '/', CAST(EXTRACT(MONTH FROM o_orderdate) AS VARCHAR(4)), '/',
  CAST(EXTRACT(YEAR FROM o_orderdate) + 1 AS VARCHAR(6)), ' review 5 March 1999, close April 7, 2000, bad 2001-13-45') AS note
FROM orders""",
    "orders_v2": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 1.05 AS o_totalprice, o_orderdate, 'web' AS channel
FROM orders WHERE o_orderkey % 3 <> 0""",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table, or a derived view over the test tables."""
    if name in VIEWS:
        for base in ("orders", "events"):
            spark.read.parquet(f"{folder}/{base}.parquet").createOrReplaceTempView(base)
        return spark.sql(VIEWS[name])
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(name: str, source: str | tuple[str, ...], make: Callable, sql: str | None = None, digits: int | None = 4) -> None:
    """Add a query ``make(*tables)`` over the named tables; doubles are rounded on the way out.

    In ``sql`` the derived views may be used like tables.
    """
    sources = (source,) if isinstance(source, str) else source

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = make(*[table(spark, folder, s) for s in sources])
        return out if digits is None else rounded(out, digits)

    if name in QUERIES:
        raise ValueError(f"query '{name}' is registered twice")
    QUERIES[name] = run
    if sql is not None:
        used = [v for v in VIEWS if v in sql]
        ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
        if used:
            own = sql.lstrip()
            sql = f"WITH {ctes}, {own[5:]}" if own.upper().startswith("WITH ") else f"WITH {ctes} {own}"
        ORACLES[name] = sql


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(
        *[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


def scratch(df: DataFrame, label: str) -> str:
    """Fresh path in the session's shared folder, for queries that write and read back."""
    return f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"


def register_large(name: str, **limits: int) -> None:
    """The query ``name`` again as ``<name>_large``, with the library's limits set so low that it takes the path of large tables."""
    plain = QUERIES[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        names = {f"spark.sondage.{k}": str(v) for k, v in limits.items()}
        before = {k: spark.conf.get(k, None) for k in names}
        for k, v in names.items():
            spark.conf.set(k, v)
        try:
            return plain(spark, folder)
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    QUERIES[f"{name}_large"] = run
    ORACLES[f"{name}_large"] = ORACLES[name]
