"""Audit of five text filters in every order: what each step keeps, removes and duplicates.

Every document is one of 32 cells, the set of filters that it fails, counted per part. A walk over
the subsets of filters in Gray code toggles one filter at a time: each cell keeps the number of its
failures that are active, and the survivors change by the cells whose number leaves or reaches 0.
The 32 states answer all 120 orders by differences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.slices import slices

FILTERS = "ABCDE"
#: The bit of filter E, which depends on other documents; the first four depend on the text alone.
COPY = 16
CELLS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
CAPITALS, SYMBOLS = bytes(range(65, 91)), frozenset(b"#$%&*|")
#: Bytes that continue a code point.
CONTINUING = bytes(range(0x80, 0xC0))
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: Parts that are walked at once.
PARTS = 64


def failures(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = text.split()
    points = len(text.translate(None, CONTINUING))
    bits = len(words) < LEAST_WORDS
    bits |= (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
    bits |= (100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * points) << 2
    return bits | (not SYMBOLS.isdisjoint(text)) << 3


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest): the failures by text, and the SHA-256 of the text, which stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2):
                texts = [(x or "").encode("utf-8", "replace") for x in b.column(2).to_pylist()]
                masks, digests = pa.array([failures(x) for x in texts], pa.int32()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), masks, digests], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail, and those labelled.

    What is identical meets by digest as counts: rows of one digest, part and labels are added up
    before and after the shuffle, so thousands of copies of a text are a few rows in its group.
    """
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    told = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(flag("quality"), flag("toxic")).where("of is not null")
    rows = _judged(docs).join(told, F.col("doc_id") == F.col("of"), "left")
    kind = ["digest", "mask", "part", "good", "toxic"]
    rows = rows.select("doc_id", "digest", "mask", "part", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    each = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("c"))  # repeated rows of one doc_id
    kinds = each.groupBy(*kind).agg(F.sum("c").alias("n"), F.min("doc_id").alias("least"), F.min_by("c", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("unnamed"))
    first = kinds.groupBy(F.col("digest").alias("d")).agg(F.min("least").alias("first"))
    j = kinds.join(first, F.col("digest") == F.col("d"))
    # of a text only the rows of its smallest doc_id are no copies; a null doc_id is neither smaller nor larger
    fresh = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("m"), fresh.alias("k")), F.struct(F.col("mask").bitwiseOR(COPY).alias("m"), (F.col("n") - fresh).alias("k")))
    x = j.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.k > 0")
    return x.groupBy("part", F.col("x.m").alias("mask")).agg(F.sum("x.k").alias("n"), F.sum(F.col("x.k") * F.col("good")).alias("good"), F.sum(F.col("x.k") * F.col("toxic")).alias("toxic"))


def gray_walk(counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters: counts is by cell, then anything; so is the result, by subset."""
    states = np.zeros_like(counts)
    active = np.zeros(CELLS, np.int64)  # failures of each cell that are active
    now = counts.sum(axis=0)
    states[0] = now
    for i in range(1, CELLS):
        subset = i ^ i >> 1
        bit = subset ^ (i - 1) ^ (i - 1) >> 1
        fails = np.flatnonzero(np.arange(CELLS) & bit)
        if subset & bit:
            now = now - counts[fails[active[fails] == 0]].sum(axis=0)
            active[fails] += 1
        else:
            active[fails] -= 1
            now = now + counts[fails[active[fails] == 0]].sum(axis=0)
        states[subset] = now
    return states


def steps(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Every column of the audit as (orders, steps, parts), of counts (cells, parts, 3) of documents, good and toxic ones."""
    states = gray_walk(counts)
    orders = np.array(list(permutations(range(len(FILTERS)))))
    bits = 1 << orders
    after = np.cumsum(bits, axis=1)
    lost = states[after - bits] - states[after]
    removed = lost[..., 0]
    total, alone = (np.array([counts[list(c), :, 0].sum(axis=0) for c in own]) for own in ([[m for m in range(CELLS) if m >> f & 1] for f in range(len(FILTERS))], [[1 << f] for f in range(len(FILTERS))]))
    shapley = np.zeros_like(total)
    np.add.at(shapley, orders, removed)
    return {"kept": states[after][..., 0], "removed": removed, "redundant": total[orders] - removed, "unique_fails": alone[orders], "good_lost": lost[..., 1], "toxic_lost": lost[..., 2], "shapley": shapley[orders]}


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (lang), order of the filters and step, of docs (doc_id, text, lang) and labels (doc_id, quality, toxic).

    A null text is empty; a null lang is the part of the empty string. Repeated rows of one doc_id
    are documents of their own, and no copies of each other, as none has the smaller doc_id; a null
    doc_id makes and is no copy and has no label. A document with several label rows is good, or
    toxic, if one of them says so. Other columns are ignored. Without documents there are no parts,
    so no rows.
    """
    held = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    names = ["".join(x) for x in permutations(FILTERS)]
    order, step = [x for x in names for _ in FILTERS], np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS):
                b = whole.slice(at, PARTS)
                parts = b.column(0).to_pylist()
                counts = np.zeros((CELLS, len(parts), 3), np.int64)
                for i, own in enumerate(b.column(1).to_pylist()):
                    for x in own:
                        counts[x["mask"], i] = x["n"], x["good"], x["toxic"]
                told = steps(counts)
                rows = len(order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p in parts for _ in range(rows)], pa.string()), pa.array(order * len(parts), pa.string()), pa.array(np.tile(step, len(parts))), *(pa.array(np.moveaxis(x, 2, 0).ravel()) for x in told.values())],
                    names=["part", "filter_order", "step", *told],
                )

    return held.mapInArrow(run, OUT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = rf"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
f as (select doc_id, part, (len(w) < {LEAST_WORDS})::int + 2 * (100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w))::int
      + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > {MOST_CAPITALS} * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
      + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int m from d),
c as (select part, m, count(*) n, count(*) filter (quality = 1) good, count(*) filter (toxic = 1) toxic from f left join labels using (doc_id) group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) l, unnest([1, 2, 4, 8, 16]) b),
o as (select a.l || b.l || c.l || d.l || e.l filter_order, [a.b, b.b, c.b, d.b, e.b] bits from l a, l b, l c, l d, l e where a.b + b.b + c.b + d.b + e.b = 31 and a.b | b.b | c.b | d.b | e.b = 31),
s as (select filter_order, unnest(range(1, 6))::int step, bits[step] own, list_sum(bits[1 : step])::int upto from o),
p as (select distinct part from c),
r as (select p.part, filter_order, step, own,
      coalesce(sum(n) filter (m & upto = 0), 0)::bigint kept, coalesce(sum(n) filter (m & upto = own), 0)::bigint removed,
      coalesce(sum(n) filter (m & own > 0 and m & upto <> own), 0)::bigint redundant, coalesce(sum(n) filter (m = own), 0)::bigint unique_fails,
      coalesce(sum(good) filter (m & upto = own), 0)::bigint good_lost, coalesce(sum(toxic) filter (m & upto = own), 0)::bigint toxic_lost
      from p cross join s join c on c.part = p.part group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint shapley from r
"""
