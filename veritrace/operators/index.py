"""A persisted index of vectors for exact nearest neighbours by cosine.

Vectors of length 1 lie in cells around centroids, a partition of a Parquet table each, with their
distance from the centroid beside them. A search looks into a query's nearest cells until they hold k
vectors, which bounds the distance of its k-th neighbour; by the triangle inequality no cell whose
ring is farther than that can hold a better one, and only the others are read. So the answer is that
of a search of everything; vectors without any nearness make it one. Cells travel in groups and
queries in blocks of bounded size, so a query is sent once a group, not once a cell.

An index is named by a fingerprint of its source. Its facts are written last, so one that was left
half-built is never read, and a source that changed is indexed anew beside the old one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritrace.operators.blocks import unit, vectors
from veritrace.storage import materialize

#: Most cells, rows that centroids are learned from for each cell, and rounds of learning: the centroids are what a model of stated size is, and may be sent to every task.
CELLS, SAMPLE, ROUNDS = 1_024, 32, 5
#: Pairs that a task compares at once, and values of the vectors in a group of cells or a block of queries.
PAIRS, VALUES = 2**20, 2**19
#: Pairs of a cell and a block of queries, narrow rows, that may be broadcast.
FEW = 1_000_000
#: Slack of distances against rounding; digits to which similarities are compared, so that copies tie.
SLACK, DIGITS = 1e-4, 9


def directed(rows: DataFrame, vector: str = "v") -> DataFrame:
    """Rows whose vector has a direction: not null, without null or non-finite values, not zero. Others are neither indexed nor answered."""
    v = F.col(vector)
    return rows.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def fingerprint(items: DataFrame) -> str:
    """A name for the rows of items (item, v), whatever their order; equal tables have equal names."""
    h = F.xxhash64("item", "v")
    n, x, s = items.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.shiftright(h, 40)), F.lit(0))).first()
    return f"{n}-{x & (2**64 - 1):016x}-{s & (2**64 - 1):016x}"


def _learn(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of rows of length 1: farthest of a few at each step to begin with, then rounds of means; empty cells keep their place."""
    rng = np.random.default_rng(7)
    at, far = [int(rng.integers(len(x)))], np.full(len(x), np.inf)
    while len(at) < min(cells, len(x)):
        far = np.minimum(far, 2 - 2 * (x @ x[at[-1]]))
        some = rng.integers(len(x), size=16)
        at.append(int(some[far[some].argmax()]))
    c = x[at]
    step = max(1, PAIRS // len(c))
    for _ in range(ROUNDS):
        home = np.concatenate([(x[i : i + step] @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1) for i in range(0, len(x), step)])
        n = np.bincount(home, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of rows x, of length 1, from centroids."""
    return np.sqrt(np.maximum(1 + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T, 0))


@dataclass
class Index:
    """An index on disk: `rows` (item, v, r, cell) and, of each cell that is not empty, `facts` (cell, n, lo, hi, centroid)."""

    spark: SparkSession
    path: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def facts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/facts")

    def search(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """(query, item, sim, rank): the k items of highest cosine for each query (query, v), at a tie the smaller item; queries without a direction have no rows."""
        facts = self.facts.orderBy("cell").toPandas()
        kind = queries.schema["query"].dataType.simpleString()
        item = self.rows.schema["item"].dataType.simpleString()
        asked = materialize(directed(queries).select("query", F.col("v").cast("array<double>").alias("v")), "asked")
        if not len(facts):
            return self.spark.createDataFrame([], f"query {kind}, item {item}, sim double, rank int")
        if asked.where(F.size("v") != len(facts["centroid"][0])).limit(1).count():
            raise ValueError("queries and index have vectors of different lengths")
        order = W.partitionBy("query").orderBy(F.col("sim").desc(), F.col("item").asc())
        most = max(1, VALUES // max(1, len(facts["centroid"][0])))
        asked = asked.withColumn("_q", F.pmod(F.xxhash64("query", "v"), F.lit(1 + asked.count() // most)).cast("int"))
        place = _groups(facts, most)

        def best(asked: DataFrame, pick) -> DataFrame:
            """The best k of each query (query, v, _q, s), s being a bound or null, in the cells that are picked."""
            want = materialize(asked.mapInPandas(_wanted(pick), "_q int, cell int").distinct(), "want")
            cells = [x[0] for x in want.select("cell").distinct().collect()]  # at most CELLS numbers
            to = want.groupBy("cell").agg(F.collect_list("_q").alias("qs")).join(F.broadcast(self.spark.createDataFrame(place)), "cell")
            to = F.broadcast(to) if want.count() <= FEW else to
            some = self.rows.where(F.col("cell").isin(cells)).select("item", "v", "cell").join(to, "cell")
            some = some.select("item", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("item", "v"), F.col("parts"))).cast("int").alias("_g"), F.explode("qs").alias("_q"))
            sent = asked.select("query", "v", "s", "_q").mapInArrow(_sent(pick, place, most), f"query {kind}, v array<double>, s double, _q int, _g int, cells array<int>")
            found = sent.groupBy("_q", "_g").cogroup(some.groupBy("_q", "_g")).applyInArrow(_compared(k), f"query {kind}, item {item}, sim double")
            return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")

        first = materialize(best(asked.withColumn("s", F.lit(None).cast("double")), _nearest_cells(facts, k, place)), "first")
        bound = first.groupBy("query").agg(F.count("*").alias("n"), F.min("sim").alias("s")).select("query", F.when(F.col("n") >= k, F.col("s")).alias("s"))
        rest = materialize(asked.join(bound, "query"), "asked")
        out = first.unionByName(best(rest, _other_cells(facts, k, place)))
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "item", "sim", "rank")


def _groups(facts: pd.DataFrame, most: int) -> pd.DataFrame:
    """(cell, first, parts): cells in groups of up to `most` rows; a larger cell is dealt into groups of its own."""
    out, group, held = [], 0, 0
    for cell, n in zip(facts["cell"].tolist(), facts["n"].tolist(), strict=True):
        if held and held + n > most:
            group, held = group + 1, 0
        parts = -(-n // most)
        out.append((cell, group, parts))
        group, held = (group + parts, 0) if parts > 1 else (group, held + n)
    return pd.DataFrame(out, columns=["cell", "first", "parts"])


def _first_cells(apart: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """For each row which cells are its nearest, as many as it takes to hold k vectors."""
    near = np.argsort(apart, axis=1, kind="stable")
    before = np.cumsum(n[near], axis=1) - n[near]
    out = np.zeros(apart.shape, bool)
    np.put_along_axis(out, near, before < k, axis=1)
    return out


def _slices(batches, cells: int):
    """(offset, rows) of each batch, of which all pairs with so many cells are held at once."""
    step = max(1, PAIRS // max(1, cells))
    for b in batches:
        for at in range(0, len(b), step):
            yield at, b.iloc[at : at + step]


def _probes(at: int, b: pd.DataFrame, facts: pd.DataFrame, go: np.ndarray) -> pd.DataFrame:
    """(at, query, cell): `at` is the query's row in its batch."""
    i, j = np.nonzero(go)
    return pd.DataFrame({"at": at + i, "query": b["query"].to_numpy()[i], "cell": facts["cell"].to_numpy()[j].astype(np.int32)})


def _nearest_cells(facts: pd.DataFrame, k: int, place: pd.DataFrame | None = None):
    c, n = vectors(facts["centroid"]), facts["n"].to_numpy()
    slots = len(c) if place is None else int(place["parts"].sum())

    def run(batches):
        for at, b in _slices(batches, slots):
            yield _probes(at, b, facts, _first_cells(_apart(unit(vectors(b["v"])), c), n, k))

    return run


def _other_cells(facts: pd.DataFrame, k: int, place: pd.DataFrame | None = None):
    """Cells not yet seen whose ring around the centroid comes within a query's bound."""
    c, n, lo, hi = vectors(facts["centroid"]), facts["n"].to_numpy(), facts["lo"].to_numpy(), facts["hi"].to_numpy()
    slots = len(c) if place is None else int(place["parts"].sum())

    def run(batches):
        for at, b in _slices(batches, slots):
            d = _apart(unit(vectors(b["v"])), c)
            reach = np.sqrt(np.maximum(2 - 2 * b["s"].fillna(-1.0).to_numpy(float), 0))[:, None] + SLACK
            yield _probes(at, b, facts, ~_first_cells(d, n, k) & (d - reach <= hi) & (d + reach >= lo))

    return run


def _wanted(pick):
    """Which cells a block of queries looks into."""

    def run(batches):
        for b in batches:
            for p in pick(iter([b])):
                yield pd.DataFrame({"_q": b["_q"].to_numpy()[p["at"]], "cell": p["cell"]}).drop_duplicates()

    return run


def _sent(pick, place: pd.DataFrame, most: int):
    """Each query once for each group that has cells it looks into, with these."""
    cells, first, parts = (place[c].to_numpy() for c in place.columns)

    def run(batches):
        for batch in batches:
            for p in pick(iter([batch.to_pandas()])):
                if not len(p):
                    continue
                where = np.searchsorted(cells, p["cell"])
                times = parts[where]
                row, cell = np.repeat(p["at"].to_numpy(), times), np.repeat(p["cell"].to_numpy(), times)
                group = np.repeat(first[where] - np.cumsum(times) + times, times) + np.arange(times.sum())
                order = np.lexsort((cell, group, row))
                row, cell, group = row[order], cell[order], group[order]
                begin = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(group) != 0)))
                ends = np.append(begin, len(row))
                for at in range(0, len(begin), most):
                    own, to = begin[at : at + most], ends[at : at + most + 1]
                    lists = pa.ListArray.from_arrays(pa.array(to - to[0], pa.int32()), pa.array(cell[to[0] : to[-1]], pa.int32()))
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row[own])).columns, pa.array(group[own], pa.int32()), lists], names=[*batch.schema.names, "_g", "cells"])

    return run


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as rows of length 1."""
    return unit(pc.list_flatten(column).to_numpy().reshape(len(column), -1))


def _compared(k: int):
    def cut(row: np.ndarray, at: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, ...]:
        """The best k of each row, the first of equals."""
        order = np.lexsort((at, -sim, row))
        row, at, sim = row[order], at[order], sim[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], at[keep], sim[keep]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best k of each query of a block in the cells of a group that it looks into."""
        none = np.zeros(0, np.int64)
        out, held = (none, none, np.zeros(0)), []
        if len(left) and len(right):
            right = right.take(pc.sort_indices(right["item"].combine_chunks()))
            q, x, cell = _rows(left["v"]), _rows(right["v"]), right["cell"].to_numpy()
            bound = pc.fill_null(left["s"], -np.inf).to_numpy().copy()
            lists = left["cells"].combine_chunks()
            asking, asked = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()
            for c in np.unique(cell):
                at, rows = np.flatnonzero(cell == c), asking[asked == c]
                y, step = x[at], max(1, PAIRS // len(at))
                for i in range(0, len(rows), step):
                    own = rows[i : i + step]
                    sim = q[own] @ y.T
                    some = sim >= (bound[own] - 2 * 10.0**-DIGITS)[:, None]
                    full = np.flatnonzero(np.count_nonzero(some, axis=1) > k)
                    if len(full):
                        s = np.where(some[full], np.round(sim[full], DIGITS), -np.inf)
                        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                        same = s == kth[:, None]
                        some[full] = (s > kth[:, None]) | same & (np.cumsum(same, axis=1) <= k)
                        bound[own[full]] = np.maximum(bound[own[full]], kth)
                    a, b = np.nonzero(some)
                    held.append((own[a], at[b], np.round(sim[a, b], DIGITS)))
                    if sum(len(h[0]) for h in held) > PAIRS:
                        out, held = cut(*(np.concatenate(z) for z in zip(out, *held, strict=True))), []
            out = cut(*(np.concatenate(z) for z in zip(out, *held, strict=True)))
        return pa.table({"query": left["query"].take(pa.array(out[0])), "item": right["item"].take(pa.array(out[1])), "sim": out[2]})

    return compare


def build(items: DataFrame, path: str, cells: int | None = None) -> Index:
    """Write an index of items (item, v) to a folder that holds none.

    Centroids are learned from at most SAMPLE rows a cell, chosen by hash; every row is indexed. The
    number of cells follows from the rows, up to CELLS.
    """
    spark = items.sparkSession
    v = materialize(directed(items).select("item", F.col("v").cast("array<double>").alias("v")), "items")
    n, short, long = v.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if short != long:
        raise ValueError("vectors of an index have one length")
    cells = cells or int(min(CELLS, max(1, round(n**0.5))))
    # the least hashes, of which each task tells those below a bound only, somewhat more than are needed
    h, share = F.xxhash64("item", "v"), (1.2 * cells * SAMPLE + 1_000) / max(1, n)
    some = v.where(h < int(-(2**63) + min(share, 1) * (2**64 - 2**12))) if share < 1 else v
    some = some.select("v").orderBy(h).limit(cells * SAMPLE).toPandas()
    c = _learn(unit(vectors(some["v"])), cells) if n else np.zeros((0, 1))
    item = items.schema["item"].dataType.simpleString()

    def place(batches):
        for _, b in _slices(batches, len(c)):
            d = _apart(unit(vectors(b["v"])), c)
            home = d.argmin(axis=1)
            yield b.assign(r=d[np.arange(len(b)), home], cell=home.astype(np.int32))

    placed = v.mapInPandas(place, f"item {item}, v array<double>, r double, cell int") if n else v.select("item", "v", F.lit(0.0).alias("r"), F.lit(0).alias("cell"))
    placed = materialize(placed, "placed")
    # rows of a cell lie together, in files of a bounded number of rows however many a cell has
    size = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    size = materialize(size, "size")  # at most CELLS rows
    parts = placed.join(F.broadcast(size.select("cell", (1 + F.floor(F.col("n") / 200_000)).cast("int").alias("_n"))), "cell")
    parts = parts.withColumn("_p", F.pmod(F.xxhash64("item"), "_n")).repartition("cell", "_p").drop("_n", "_p")
    parts.write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(f"{path}/rows")
    if not n:  # no partition, so a table without one says what the columns are
        placed.write.mode("overwrite").parquet(f"{path}/rows")
    centroid = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cell int, centroid array<double>")
    size.join(centroid, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return Index(spark, path)


def built(spark: SparkSession, path: str) -> bool:
    """Whether a folder has a whole index: its facts, which come last, are there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/facts/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def open_or_build(items: DataFrame, root: str, cells: int | None = None) -> Index:
    """The index of items (item, v) under root: as it was written, or built now if the source is new or has changed."""
    path = f"{root}/{fingerprint(items)}" + (f"-{cells}" if cells else "")
    return Index(items.sparkSession, path) if built(items.sparkSession, path) else build(items, path, cells)
