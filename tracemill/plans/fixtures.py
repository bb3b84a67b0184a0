"""The given tables seen as sessions, observations, usage and versions: each a Spark view and the same in SQL.

Mapping: events are observations of session user_id and project user_id % 5; lineitem rows are usage of session l_orderkey;
conversations are messages; suppliers, customers and parts in perturbed copies are versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    kind = F.when(F.col("event_type") == "view", "file").when(F.col("event_type") == "click", "command").when(F.col("event_type") == "signup", "version").otherwise("verification")
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success")
    return e.select(
        F.lit("a").alias("provider"), F.col("user_id").alias("session_id"), (F.col("user_id") % 5).alias("project_id"), F.col("event_id").alias("sequence"), F.col("event_id").alias("revision_id"), "ts",
        kind.alias("kind"), F.lit("run").alias("operation"), outcome.alias("outcome"), (k % 10).alias("component"), F.concat(F.lit("m"), (k % 20).cast("string")).alias("path"), F.floor(k / 25).cast("long").alias("version"), "value",
    ).withColumn("fields", F.create_map(*(x for c in ("component", "path", "version") for x in (F.lit(c), F.col(c).cast("string")))))


OBS = """obs AS (SELECT 'a' AS provider, user_id AS session_id, user_id % 5 AS project_id, event_id AS sequence, event_id AS revision_id, ts,
 CASE event_type WHEN 'view' THEN 'file' WHEN 'click' THEN 'command' WHEN 'signup' THEN 'version' ELSE 'verification' END AS kind, 'run' AS operation,
 CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' END AS outcome, k % 10 AS component, 'm' || CAST(k % 20 AS VARCHAR) AS path, k // 25 AS version, value
 FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events) e)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    return l.select(
        F.col("l_orderkey").alias("session_id"), (F.col("l_orderkey") % 7).alias("project_id"), (F.col("l_suppkey") % 5).alias("model"), F.col("l_linenumber").cast("long").alias("ordinal"), F.col("l_shipdate").alias("ts"),
        (q * 100).alias("input_tokens"), (F.col("l_linenumber").cast("long") * 10).alias("cached_input_tokens"), F.lit(0).cast("long").alias("cache_write_input_tokens"), (q * 7).alias("output_tokens"),
        F.lit(0).cast("long").alias("reasoning_output_tokens"), (q * 107).alias("total_tokens"),
    )


USAGE = """usage AS (SELECT l_orderkey AS session_id, l_orderkey % 7 AS project_id, l_suppkey % 5 AS model, CAST(l_linenumber AS BIGINT) AS ordinal, l_shipdate AS ts, q * 100 AS input_tokens,
 CAST(l_linenumber AS BIGINT) * 10 AS cached_input_tokens, q * 7 AS output_tokens, q * 107 AS total_tokens FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem) l)"""


# Prices of the five models; rates are per million tokens.
PRICES = [
    (0, "1992-01-01", 3.0, 15.0, "initial"), (0, "1995-06-01", 3.0, 15.0, "refresh"), (0, "1997-01-01", 2.0, 10.0, "change"), (1, "1993-01-01", 1.0, 5.0, "initial"), (1, "1996-01-01", 1.5, 5.0, "correction"),
    (2, "1992-01-01", 0.0, 0.0, "initial"), (3, "1996-06-01", 4.0, 8.0, "initial"), (3, "1998-01-01", 4.0, None, "change"),
]


def prices(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(PRICES, "model long, date string, input_rate double, output_rate double, event string")
    return rows.withColumn("date", F.col("date").cast("date"))


def _sql(v) -> str:
    return "CAST(NULL AS DOUBLE)" if v is None else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else f"'{v}'"


PRICES_SQL = "prices AS (SELECT model, CAST(date AS DATE) AS date, input_rate, output_rate, event FROM (VALUES " + ", ".join(f"({', '.join(map(_sql, r))})" for r in PRICES) + ") p(model, date, input_rate, output_rate, event))"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), "role", F.coalesce("text", F.lit("")).alias("text"))


MESSAGES = "messages AS (SELECT conv_id AS session_id, turn AS ordinal, role, coalesce(text, '') AS text FROM conversations)"


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A base of customers and two edited copies: left changes every 5th, drops every 11th; right changes every 7th, drops every 13th."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"))
    k = F.col("key")
    left = base.where(k % 11 != 0).withColumn("nation", F.when(k % 5 == 0, F.col("nation") + 100).otherwise(F.col("nation")))
    right = base.where(k % 13 != 0).withColumn("nation", F.when(k % 35 == 0, F.col("nation") + 100).when(k % 7 == 0, F.col("nation") + 200).otherwise(F.col("nation")))
    more = base.where(k % 17 == 0).select((k + 1_000_000).alias("key"), "segment", "nation")
    return base, left.unionByName(more), right


VERSIONS = """base AS (SELECT c_custkey AS key, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation FROM customer),
 lft AS (SELECT key, segment, CASE WHEN key % 5 = 0 THEN nation + 100 ELSE nation END AS nation FROM base WHERE key % 11 <> 0
  UNION ALL SELECT key + 1000000, segment, nation FROM base WHERE key % 17 = 0),
 rgt AS (SELECT key, segment, CASE WHEN key % 35 = 0 THEN nation + 100 WHEN key % 7 = 0 THEN nation + 200 ELSE nation END AS nation FROM base WHERE key % 13 <> 0)"""
