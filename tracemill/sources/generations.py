"""Immutable generations of a table, and deterministic JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources.shared import materialize


def content_digest(df: DataFrame, by: str = "project_id") -> DataFrame:
    """A digest of each project's rows that does not depend on their order: count and sum of row hashes."""
    cols = sorted(c for c in df.columns if c != by)
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    part = lambda a, b: F.sum(F.conv(F.substring(row, a, b), 16, 10).cast("decimal(38,0)"))
    return df.groupBy(by).agg(F.sha2(F.concat_ws(":", F.count("*"), part(1, 15), part(16, 15), part(31, 15)), 256).alias("content_digest"))


def _log(spark: SparkSession, table: str) -> DataFrame | None:
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/_log")
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return None
    return spark.read.schema("project_id string, generation_id string, content_digest string, published_at timestamp").parquet(f"{table}/_log")


def write_generation(df: DataFrame, table: str, generation_id: str) -> DataFrame:
    """Add a generation of the projects whose content changed (S10, ST9). Returns what was published; unchanged projects keep their last one.

    Rows go to partitions of project and generation; a small log of generations is appended after them, so a reader never sees part of one.
    A repeated call with the same id writes over what an unfinished one left and adds nothing to a finished one; an id in use for other content raises.
    """
    spark = df.sparkSession
    rows = df.withColumn("project_id", F.col("project_id").cast("string"))
    digests = content_digest(rows)
    log = _log(spark, table)
    if log is not None:
        last = log.groupBy("project_id").agg(F.max_by("content_digest", F.struct("published_at", "generation_id")).alias("__last"))
        used = log.where(F.col("generation_id") == generation_id).groupBy("project_id").agg(F.first("content_digest").alias("__used"))
        digests = digests.join(last, "project_id", "left").join(used, "project_id", "left")
        taken = digests.where("__used <> content_digest").first()
        if taken:
            raise ValueError(f"generation {generation_id} of project {taken.project_id} is published with other content")
        digests = digests.where("__used IS NULL AND (__last IS NULL OR __last <> content_digest)").drop("__last", "__used")
    digests = materialize(digests.withColumn("generation_id", F.lit(generation_id)))
    rows.join(digests.select("project_id", "generation_id"), "project_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "generation_id").parquet(f"{table}/data")
    published = digests.select("project_id", "generation_id", "content_digest", F.current_timestamp().alias("published_at"))
    published.write.mode("append").parquet(f"{table}/_log")
    return digests


def read_generation(spark: SparkSession, table: str, project_id: str | None = None, generation_id: str | None = None) -> DataFrame:
    """The last published generation of each project, or a named one (S11). Both filters prune partitions."""
    log = _log(spark, table)
    if log is None:
        raise ValueError("nothing is published")
    if generation_id is not None:
        log = log.where(F.col("generation_id") == generation_id)
    if project_id is not None:
        log = log.where(F.col("project_id") == project_id)
    pins = log.groupBy("project_id").agg(F.max_by("generation_id", F.struct("published_at", "generation_id")).alias("generation_id"))
    data = spark.read.option("inferSchema", "false").parquet(f"{table}/data")
    data = data.withColumn("project_id", F.col("project_id").cast("string")).withColumn("generation_id", F.col("generation_id").cast("string"))
    if project_id is not None:
        data = data.where(F.col("project_id") == project_id)
    return data.join(pins, ["project_id", "generation_id"], "left_semi")


def report_json(df: DataFrame) -> DataFrame:
    """Each row as JSON with sorted keys and the digest of the rest inside (S12): digest, json."""
    cols = sorted(df.columns)
    body = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return df.select(F.sha2(body, 256).alias("digest"), F.to_json(F.struct(*cols, F.sha2(body, 256).alias("zz_digest")), {"ignoreNullFields": "false"}).alias("json"))


def write_report_json(df: DataFrame, path: str) -> None:
    report_json(df).select("json").write.mode("overwrite").text(path)
