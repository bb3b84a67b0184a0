"""Connected components, for operators over large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.sources.shared import discard, materialize


def rehashed(grouped: DataFrame, key: str = "w") -> DataFrame:
    """The same rows with a key that the planner shuffles anew, so that AQE may split a hot key of the other side."""
    return grouped.withColumn(key, F.col(key) + F.lit(0))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: edges(a, b long) -> (id, component), component the least id reachable.

    Distributed union-find by alternating hooks: each round every vertex's larger neighbours are linked to its least
    neighbour, then its smaller ones (Kiveris et al., "Connected Components in MapReduce and Beyond"). Every round is
    groupings with partial aggregation and joins, written to the shared folder; no vertex's neighbours are gathered
    in one row. Vertices without edges are not returned. Raises if ``rounds`` do not reach the fixed point.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = large = None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"]:
            return spark.createDataFrame([], "id long, component long")
        if seen == (state["n"], state["s"]):
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        seen = (state["n"], state["s"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialize(
            both.join(rehashed(least), F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        discard(now)
        small = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        now = materialize(
            large.join(rehashed(small), F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        discard(large)
    raise RuntimeError("connected_components: rounds are too few")
