"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Unset, a local session gets a temporary one; on a cluster, whose executors would each write to their own disk, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="veritrace-")
    return _own[app]


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The setting by which a query's shuffle files go as soon as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, outlives lost executors and leaves no shuffle files."""
    spark = df.sparkSession
    path = _fresh(spark, name)
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            release(df.sparkSession, folder)


def collect(spark: SparkSession) -> None:
    """Let the driver's JVM drop what the jobs so far have left: its heap, else collected when it is full, grows with the number of jobs and tasks, and Spark frees their broadcasts and shuffles with it."""
    spark._jvm.System.gc()


class Bucketed:
    """A table in the shared folder, bucketed by a column and split into parts by another, to which rows can be appended.

    Grouping or joining it by that column needs no shuffle, so rows that meet again and again stay where they are.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int, by: str, parts: str):
        self.spark, self.buckets, self.by, self.parts = spark, buckets, by, parts
        self.name, self.path = f"{name}_{uuid.uuid4().hex}", _fresh(spark, name)

    def add(self, df: DataFrame) -> Bucketed:
        out = df.write.mode("append").option("compression", "zstd").option("path", self.path)
        out.partitionBy(self.parts).bucketBy(self.buckets, self.by).saveAsTable(self.name)
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self, part: int | None = None) -> None:
        """Delete a part of the table, or all of it, once nothing reads it any more."""
        if part is None:
            self.spark.sql(f"drop table if exists {self.name}")
        release(self.spark, self.path if part is None else f"{self.path}/{self.parts}={part}")


def release(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
