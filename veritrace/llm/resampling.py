"""Importance resampling towards a target distribution, without replacement.

Hashed n-grams of documents and of the target are counted in buckets; a document's weight is the sum
of its buckets' gains, looked up in an array. The draw adds Gumbel noise and keeps the highest
scores: the cutoff is found by exact counts between thresholds over the persisted scores, repeated
until it stands, and the selected rows are ranked by a range partitioning.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.slices import slices
from veritrace.storage import materialize

BUCKETS, RUNS = 10_000, 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Thresholds of one count job.
SECTIONS = 256
LARGEST = (1 << 63) - 1
TOP = (1 << 33) - 1


def features(text: str | None) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every run of 1 to RUNS words."""
    words = WORD.findall((text or "").encode("utf-8", "replace").lower())
    spaced = [b" " + w for w in words]
    sums, out = list(map(crc32, words)), []
    for k in range(RUNS):
        out += sums
        sums = list(map(crc32, spaced[k + 1 :], sums))  # the sum of a run goes on from that of the run before
    return len(words), np.array(out, np.int64) % BUCKETS


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Features of all texts (column text) by bucket; each task sends its array, added up by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for b in slices(whole, 0):
                for x in b.column(0).to_pylist():
                    n += np.bincount(features(x)[1], minlength=BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    told = rows.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[told.column(0).to_numpy()] = told.column(1).to_numpy()
    return out


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the logarithm of how much likelier the target is to use it, rounded down."""
    most_s, most_t = float(s.sum() + BUCKETS), float(t.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * most_s / ((float(x) + 1) * most_t))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                out: list[list[int]] = [[], [], [], []]
                for doc_id, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    n, at = features(x)
                    weight = int(gain[at].sum())
                    for o, v in zip(out, (n, len(at), weight, weight + noise(doc_id, seed)), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, pa.int64()) for o in out)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def first_value(rows: DataFrame, column: str, k: int) -> tuple[int, int, int]:
    """(v, less, same): v is the k-th smallest value of a column of longs; so many rows are less than it, and equal to it.

    Each job counts the rows of the interval left in SECTIONS parts of it, until a part is one value.
    """
    span = rows.agg(F.min(column), F.max(column)).first()
    low, high, less = int(span[0]), int(span[1]), 0
    while True:
        step = (high - low) // SECTIONS + 1
        # the difference of two longs may not fit one, so it is a decimal
        section = F.floor((F.col(column).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(step).cast("decimal(20,0)")).cast("int")
        part = rows.where(F.col(column).between(low, high)).groupBy(section.alias("s")).agg(F.count("*").alias("n"))
        counts = dict(part.toArrow().to_pandas().itertuples(index=False))
        for s in sorted(counts):
            if less + counts[s] >= k:
                break
            less += counts[s]
        low, high = low + int(s) * step, min(high, low + (int(s) + 1) * step - 1)
        if step == 1:
            return low, int(less), int(counts[s])


def is_first(rows: DataFrame, order: list[str], k: int) -> Column:
    """Whether a row is among the k first by columns of longs, at a tie by the next of them.

    rows must be persisted, and the last column tell rows apart.
    """
    out, tied, same = F.lit(False), F.lit(True), rows
    for column in order:
        v, less, equal = first_value(same, column, k)
        out, tied, k = out | tied & (F.col(column) < v), tied & (F.col(column) == v), k - less
        if equal == k:
            break
        same = rows.where(tied)
    return out | tied


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rank, from 1 by order: sorted within ranges, which are numbered on from one another."""
    spark, own = rows.sparkSession, rows.columns
    at = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("place", 33)
    sizes = sorted(tuple(r) for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(starts, "p long, before long"))
    return at.join(starts, part == F.col("p")).select(*own, (F.col("before") + F.col("place").bitwiseAND(TOP) + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text); target has text.

    Of the N rows with at least least_words words floor(percent * N / 100) of highest score are drawn,
    ties to the smaller doc_id; rank is their place, null for the others. A null text has no words, a
    document without words weight 0. A null doc_id has the noise of the empty string and comes after
    all others at a tie. Repeated rows are drawn each for itself; of those equal in score and doc_id
    the one persisted first comes first. Other columns are ignored. With an empty target all buckets
    are equally rare there; no documents give no rows.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = scored(docs, gain, seed).withColumns({"up": -F.col("score"), "tie": F.coalesce("doc_id", F.lit(LARGEST)), "row": F.monotonically_increasing_id()})
    rows, order = materialize(rows, "scored"), ["up", "tie", "row"]
    fit = F.col("n_words") >= least_words
    k = rows.where(fit).count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = fit & is_first(rows.where(fit), order, k)
    top = ranked(rows.where(drawn).select(*out, *order), order)
    return rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")).union(top.select(*out, "rank"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The table of a sum over four bits at a time, by its rule.
_NIBBLES = []
for _i in range(16):
    for _ in range(4):
        _i = _i >> 1 ^ (0xEDB88320 if _i & 1 else 0)
    _NIBBLES.append(_i)
ORACLE = rf"""
with texts as (select doc_id, 0 kind, text from documents union all select null, 1, text from benchmark),
w as (select row_number() over () r, doc_id, kind, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') w from texts),
g as (select r, kind, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) f from w),
u as (select f, hex(encode(f)) x from (select distinct f from g)),
n as (select f, list_transform(range(0, len(x)), lambda i: strpos('0123456789ABCDEF', x[(i + 1 - 2 * (i % 2) + 1)::int]) - 1) q from u),
c as (select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(q, lambda v: v::bigint)), lambda a, v: xor(a >> 4, {_NIBBLES}[(xor(a, v) & 15) + 1])), 4294967295::bigint) % {BUCKETS} b from n),
h as (select r, kind, b from g join c using (f)),
k as (select b, count(*) filter (kind = 0) s, count(*) filter (kind = 1) t from h group by b),
z as (select sum(s)::double s, sum(t)::double t from k),
e as (select b, floor(1000 * ln((k.t::double + 1) * (z.s + {BUCKETS}) / ((k.s::double + 1) * (z.t + {BUCKETS}))))::bigint gain from k, z),
a as (select r, count(*) n_features, sum(gain)::bigint weight from h join e using (b) where kind = 0 group by r),
m as (select doc_id, len(w) n_words, coalesce(n_features, 0)::bigint n_features, coalesce(weight, 0)::bigint weight,
      coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1 : 8])::bigint + 0.5) / 4294967296)))::bigint score from w left join a using (r) where kind = 0),
d as (select doc_id, row_number() over (order by score desc, doc_id) p from m where n_words >= {LEAST_WORDS})
select doc_id, n_features, weight, score, case when p <= (select {PERCENT} * count(*) // 100 from d) then p end "rank" from m left join d using (doc_id)
"""
