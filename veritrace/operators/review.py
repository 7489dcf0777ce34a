"""Human review: what is asked, and what the verdicts do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.functions import columns as C


def for_review(signals: DataFrame) -> DataFrame:
    return signals.where("requires_human_review")


def review_payload(signals: DataFrame) -> DataFrame:
    return for_review(signals).select("id", "text", "risk_category", "severity", "confidence_score", "source_url")


def apply_verdicts(signals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Dismissed signals go; the others with a known verdict carry it and need no review; the rest stay.

    verdicts (id, verdict): in any of the accepted spellings, unknown ones ignored.
    """
    v = verdicts.select(F.col("id").alias("_id"), F.coalesce(C.verdict("verdict"), F.when(F.upper("verdict").isin("CONFIRMED", "DISMISSED", "NEEDS_INVESTIGATION"), F.upper("verdict"))).alias("_v"))
    v = v.where("_v is not null").groupBy("_id").agg(F.max("_v").alias("_v"))
    j = signals.join(v, signals["id"] == v["_id"], "left").where("_v is null or _v <> 'DISMISSED'")
    own = F.col("human_verdict") if "human_verdict" in signals.columns else F.lit(None).cast("string")
    j = j.withColumns({"human_verdict": F.coalesce("_v", own), "requires_human_review": F.col("_v").isNull() & F.col("requires_human_review")})
    return j.drop("_id", "_v")


def collected(asked: DataFrame, verdicts: DataFrame, by: str, keep_partial: bool = True) -> DataFrame:
    """(by, id, verdict) that count when time is up: all given, or only those of complete reviews.

    asked (by, id), verdicts (by, id, verdict). A verdict for an id that was not asked is refused.
    """
    given = asked.join(verdicts, [by, "id"], "left")
    if keep_partial:
        return given.where("verdict is not null")
    full = given.groupBy(by).agg(F.bool_and(F.col("verdict").isNotNull()).alias("_all")).where("_all").select(by)
    return given.join(full, by, "left_semi")
