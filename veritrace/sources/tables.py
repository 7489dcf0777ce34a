"""Persisted tables on plain Parquet: appends, latest-of-key views, expiry, audit.

Upserts are appends with a version; a reader takes the newest row of each key. `compact` rewrites a
table to that view in a new folder, which readers then use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.functions import columns as C
from veritrace.operators.ranking import first_rows

SCHEMAS = {
    "entities": "canonical_name string, json_blob string, created_at timestamp_ntz, expires_at timestamp_ntz",
    "documents": "id string, run_id string, entity_name string, source_url string, source_type string, raw_text string, fetch_timestamp timestamp_ntz, metadata_json string",
    "signals": "id string, run_id string, entity_name string, json_blob string, created_at timestamp_ntz",
    "reports": "id string, entity_name string, json_blob string, created_at timestamp_ntz",
    "audit_log": "run_id string, event string, detail string, created_at timestamp_ntz, seq long",
    "entity_cache": "cache_key string, entity_json string, expires_at timestamp_ntz",
    "document_cache": "cache_key string, json_blob string, expires_at timestamp_ntz",
}


def init_tables(spark: SparkSession, root: str) -> None:
    """Create what is missing; what exists stays."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def append(rows: DataFrame, root: str, name: str, unique: str | None = None) -> None:
    """Add rows; with unique, a key that is there already or twice in rows is an error."""
    cols = [x.split()[0] for x in SCHEMAS[name].split(", ")]
    rows = rows.select(*cols)
    if unique:
        held = table(rows.sparkSession, root, name).select(unique)
        clash = rows.select(unique).union(held).groupBy(unique).count().where("count > 1").limit(1)
        if clash.count():
            raise ValueError(f"{name}: {unique} is not unique")
    rows.write.mode("append").parquet(f"{root}/{name}")


def latest(rows: DataFrame, key: str, version: str = "created_at", *ties: str) -> DataFrame:
    """The newest row of each key."""
    return first_rows(rows, [key], [F.col(version).desc(), *(F.col(t).desc() for t in ties)], 1)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """new rows in place of old ones of their key; of several new rows of a key the newest, or any where no version is named."""
    one = new.dropDuplicates([key]) if version is None else latest(new, key, version)
    return old.join(one.select(key), key, "left_anti").unionByName(one)


def live(rows: DataFrame, now: str, expiry: str = "expires_at") -> DataFrame:
    return rows.where(F.col(expiry) > F.lit(now).cast("timestamp_ntz"))


def expired(rows: DataFrame, now: str, expiry: str = "expires_at") -> DataFrame:
    return rows.where(F.col(expiry) <= F.lit(now).cast("timestamp_ntz"))


def invalidate(rows: DataFrame, keys: DataFrame, key: str = "cache_key") -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def cached_documents(wanted: DataFrame, cache: DataFrame, now: str, enabled: bool = True) -> DataFrame:
    """wanted (url, entity) with their cached json_blob, null on a miss or where the cache is off."""
    keyed = wanted.withColumn("cache_key", C.cache_key("url", "entity"))
    if not enabled:
        return keyed.withColumn("json_blob", F.lit(None).cast("string"))
    return keyed.join(live(cache, now).select("cache_key", "json_blob"), "cache_key", "left")


def compact(rows: DataFrame, path: str, key: str, version: str = "created_at", now: str | None = None) -> DataFrame:
    out = latest(live(rows, now) if now else rows, key, version)
    out.write.parquet(path)
    return out.sparkSession.read.schema(out.schema).parquet(path)


def list_reports(reports: DataFrame) -> DataFrame:
    return latest(reports.select("id", "entity_name", "created_at"), "id").orderBy(F.col("created_at").desc(), "id")


def audit_tail(log: DataFrame, run: str | None = None, n: int = 200, order: str = "seq") -> DataFrame:
    """The newest n audit rows, of one run if given."""
    return (log.where(F.col("run_id") == run) if run else log).orderBy(F.col(order).desc()).limit(n)


def rejections(anchored: DataFrame, now: str) -> DataFrame:
    """Audit rows of the signals whose quote was refused."""
    detail = F.format_string("score=%.1f url=%s text=%s snippet=%s", "anchor_score", "source_url", F.substring("text", 1, 300), F.substring("source_snippet", 1, 300))
    return anchored.where("verdict = 'REJECT'").select("run_id", F.lit("anchor_rejected").alias("event"), detail.alias("detail"), F.lit(now).cast("timestamp_ntz").alias("created_at"), F.xxhash64("run_id", "text", "source_url").alias("seq"))


def run_history(persisted: DataFrame, running: DataFrame, key: str = "run_id") -> DataFrame:
    """Persisted runs and those that only live in memory."""
    return persisted.unionByName(running.join(persisted.select(key), key, "left_anti"))


def report_status(wanted: DataFrame, memory: DataFrame, stored: DataFrame, key: str = "run_id") -> DataFrame:
    """wanted with report and HTTP status: from memory, else stored; 409 while running, else 404."""
    m = memory.select(F.col(key).alias("_m"), F.col("report").alias("_mr"))
    s = stored.select(F.col(key).alias("_s"), F.col("report").alias("_sr"))
    j = wanted.join(m, wanted[key] == F.col("_m"), "left").join(s, wanted[key] == F.col("_s"), "left")
    report = F.coalesce("_mr", "_sr")
    code = F.when(report.isNotNull(), 200).when(F.col("_m").isNotNull(), 409).otherwise(404)
    return j.select(wanted[key], report.alias("report"), code.alias("status"))
