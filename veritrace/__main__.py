"""python -m veritrace DOCUMENTS.parquet OUT --today YYYY-MM-DD: a run over a documents table, a JSON file a report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veritrace.operators import reports
from veritrace.plans import pipeline
from veritrace.sources import connectors, exports


def main() -> None:
    p = argparse.ArgumentParser(prog="veritrace")
    p.add_argument("documents", help="parquet: doc_id, run_id, entity_name, source_url, source_type, text")
    p.add_argument("out", help="folder for signals (parquet) and reports (JSON)")
    p.add_argument("--today", required=True)
    p.add_argument("--knowledge", help="folder of markdown files by which signals are graded")
    a = p.parse_args()
    spark = SparkSession.builder.appName("veritrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    docs = spark.read.parquet(a.documents)
    knowledge = pipeline.knowledge_pieces(connectors.read_knowledge(spark, a.knowledge)) if a.knowledge else None
    got = pipeline.run(spark, docs, a.today, knowledge=knowledge)
    # sorted by run, not a folder a run: runs are many and small
    got["signals"].repartitionByRange("run_id", "signal_num").sortWithinPartitions("run_id", "signal_num").write.mode("overwrite").parquet(f"{a.out}/signals")
    names = docs.groupBy("run_id").agg(F.first("entity_name").alias("entity_name"))
    exports.export_files(reports.as_json(got["reports"].join(names, "run_id")), f"{a.out}/reports", mode="overwrite")


if __name__ == "__main__":
    main()
