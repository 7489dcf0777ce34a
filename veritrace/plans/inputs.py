"""The driver's tables in the shapes that the operators take, with the same shapes in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.functions import columns as C

TODAY = "2025-01-01"
CATEGORY = {"click": "REPUTATIONAL", "error": "OPERATIONAL", "purchase": "FINANCIAL", "signup": "LEGAL", "view": "CYBERSECURITY"}
SEVERITY = {"click": "LOW", "error": "HIGH", "purchase": "INFO", "signup": "MEDIUM", "view": "CRITICAL"}
POLARITY = {"click": "NEGATIVE", "error": "NEGATIVE", "purchase": "POSITIVE", "signup": "NEUTRAL", "view": "NEGATIVE"}
TIERS = ["PRIMARY", "ESTABLISHED", "GENERAL", "LOW"]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def signals(spark: SparkSession, d: str) -> DataFrame:
    """events as signals: type gives category, severity and polarity, value the confidence, user and day the run."""
    e = read(spark, d, "events")
    tier = F.element_at(F.array(*map(F.lit, TIERS)), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    weight = F.element_at(F.array(F.lit(1.0), F.lit(0.85), F.lit(0.6), F.lit(0.35)), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("ord"), F.col("user_id").alias("run_id"), F.to_date("ts").alias("data_date"),
        C.lookup("event_type", CATEGORY, "ESG").alias("risk_category"), C.lookup("event_type", SEVERITY, "INFO").alias("severity"), C.lookup("event_type", POLARITY, "NEUTRAL").alias("signal_polarity"),
        C.clamp01(F.col("value") / 100).alias("confidence_score"), tier.alias("credibility_tier"), weight.alias("source_credibility"),
        (F.pmod("event_id", F.lit(3)) + 1).alias("independent_source_count"), F.col("ts"),
    ).withColumn("temporal_weight", C.temporal_weight("data_date", TODAY))


def _case(column: str, table: dict, default: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else '{default}' end"


SIGNALS = f"""signals as (select event_id id, event_id ord, user_id run_id, ts::date data_date, {_case("event_type", CATEGORY, "ESG")} risk_category,
  {_case("event_type", SEVERITY, "INFO")} severity, {_case("event_type", POLARITY, "NEUTRAL")} signal_polarity, greatest(0.0::double, least(1.0::double, value / 100)) confidence_score,
  ['PRIMARY', 'ESTABLISHED', 'GENERAL', 'LOW'][(user_id % 4)::int + 1] credibility_tier, [1.0::double, 0.85, 0.6, 0.35][(user_id % 4)::int + 1]::double source_credibility,
  event_id % 3 + 1 independent_source_count, ts,
  greatest(0.3::double, least(1.0::double, 1.0::double - 0.15::double * (greatest(0, date_diff('day', ts::date, date '{TODAY}')) / 365.25::double))) temporal_weight from events)"""
WEIGHT = "case severity when 'CRITICAL' then 1.0 when 'HIGH' then 0.8 when 'MEDIUM' then 0.6 when 'LOW' then 0.4 else 0.2 end::double"
RANK = "case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end"
NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
