"""The price catalog: listings and effective-dated history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATES = ("input_per_mtok", "output_per_mtok", "cached_input_per_mtok")
LISTING = (
    "id string, provider string, model string, category string, input_per_mtok double, output_per_mtok double, cached_input_per_mtok double, promo boolean, promo_until date, price_note string, "
    "context_window long, status string, pricing_url string, last_updated date, detail_url string, modality array<string>, tags array<string>"
)
ENTRY = "struct<date: date, input_per_mtok: double, output_per_mtok: double, cached_input_per_mtok: double, event: string>"


def read_price_catalog(spark: SparkSession, listings: str, history: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(listings, history rows, violations) of two JSON documents (S9). Null rates stay unknown; rows that break a rule are in both."""
    one = spark.read.schema(LISTING).json(listings, multiLine=True)
    rows = one.withColumnRenamed("id", "listing_id")
    doc = spark.read.text(history, wholetext=True).select(F.from_json("value", f"map<string, struct<model: string, provider: string, history: array<{ENTRY}>>>").alias("m"))
    past = doc.select(F.explode("m").alias("listing_id", "e")).select("listing_id", F.explode("e.history").alias("h")).select("listing_id", "h.*")
    bad = lambda d, ok, why: d.where(~F.coalesce(ok, F.lit(False))).select("listing_id", F.lit(why).alias("violation"))
    not_negative = F.lit(True)
    for r in RATES:
        not_negative = not_negative & (F.col(r).isNull() | (F.col(r) >= 0))
    known = rows.select("listing_id").distinct()
    violations = (
        bad(rows, F.trim("listing_id") != "", "no_id").unionByName(bad(rows, not_negative, "negative_rate")).unionByName(bad(rows, ~F.coalesce("promo", F.lit(False)) | F.col("promo_until").isNotNull(), "promo_without_end"))
        .unionByName(bad(past, not_negative, "negative_rate")).unionByName(bad(past, F.col("date").isNotNull(), "no_date"))
        .unionByName(past.join(known, "listing_id", "left_anti").select("listing_id", F.lit("history_without_listing").alias("violation")).distinct())
        .unionByName(rows.groupBy("listing_id").count().where("count > 1").select("listing_id", F.lit("duplicate_id").alias("violation")))
    )
    return rows, past, violations
