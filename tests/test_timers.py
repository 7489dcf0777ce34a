"""Reviews and caches whose state has timers and expires, over a restart."""

import time

import pytest

from veritrace.streaming import runs

REVIEW = "run_id string, kind string, id string, verdict string"
CACHE = "cache_key string, seq long, kind string, json_blob string"


class Stream:
    """A stream over a folder, started from one checkpoint each time."""

    def __init__(self, spark, tmp_path, schema, operator):
        self.spark, self.schema, self.operator, self.got = spark, schema, operator, []
        self.src, self.ck = str(tmp_path / "in"), str(tmp_path / "ck")
        spark.createDataFrame([], schema).write.parquet(self.src)

    def __enter__(self):
        df = self.operator(self.spark.readStream.schema(self.schema).parquet(self.src))
        self.q = runs.fan_out(df, [lambda b, n: self.got.extend(b.collect())], self.ck).trigger(processingTime="500 milliseconds").start()
        return self

    def __exit__(self, *_):
        self.q.stop()

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.src)

    def wait(self, told, seconds=60):
        until = time.time() + seconds
        while time.time() < until and self.q.isActive and not told(self.got):
            time.sleep(0.2)
        assert told(self.got), (self.got, self.q.exception())


def test_a_deadline_outlives_a_restart(spark, tmp_path):
    s = Stream(spark, tmp_path, REVIEW, lambda df: runs.collect_verdicts(df, 8))
    with s:
        s.put(("r", "ask", "a", None), ("r", "ask", "b", None), ("r", "verdict", "a", "c"), ("r", "verdict", "z", "c"), ("r", "verdict", None, "c"))
        s.wait(lambda g: any(r["status"] == "reviewing" for r in g))
    began = time.time()
    with s:  # nothing more comes of r: the timer that was set before ends it
        s.put(("other", "verdict", "a", "c"))  # a stream that starts again waits for a row of any run before its timers count
        s.wait(lambda g: any(r["status"] == "timed_out" for r in g))
        assert time.time() - began < 40
        last = next(r for r in s.got if r["status"] == "timed_out")
        assert (last["n_asked"], last["n_given"], last["verdicts"]) == (2, 1, "a=CONFIRMED")
        s.put(("r", "ask", "a", None))  # a new review: what was is forgotten
        s.wait(lambda g: g[-1]["status"] == "reviewing" and g[-1]["run_id"] == "r")
        assert s.got[-1]["n_given"] == 0


def test_a_cache_forgets(spark, tmp_path):
    s = Stream(spark, tmp_path, CACHE, lambda df: runs.cache_lookups(df, 6))
    with s:
        s.put(("k", 1, "get", None), ("k", 2, "set", "old"), ("k", 3, "set", "new"), ("k", 4, "get", None), ("other", 5, "get", None))
        s.wait(lambda g: len(g) == 3)
        assert {(r["seq"], r["hit"], r["json_blob"]) for r in s.got} == {(1, False, None), (4, True, "new"), (5, False, None)}
        time.sleep(8)
        s.put(("k", 6, "get", None))
        s.wait(lambda g: len(g) == 4)
        assert not s.got[-1]["hit"]


def test_another_store_is_refused(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            runs.collect_verdicts(spark.createDataFrame([], REVIEW), 5)
    finally:
        spark.conf.set(key, was)
