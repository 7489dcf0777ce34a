"""Pairs of vectors above a cosine, without comparing all with all and without missing one.

Rows of a group lie in one cell, which is cut around pivots taken from it: a row is at home with its
nearest pivot, and a guest in later cells that may hold a partner. Two bounds tell which cannot: all
that is at home there lies on the other side of the plane between both pivots, and within the cell's
radius. Cells still large are cut again. A cell whose parts would have nearly as many pairs as it
has (vectors without any nearness, or a low threshold) stays whole and is compared in blocks of
which two meet in a task, so no cell is too large for one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.operators.blocks import FEW, unit, vectors
from veritrace.storage import materialize

#: Rows of a cell that is not cut, and of a block of a larger one; pivots of a cut; share of a cell's pairs that its parts may have.
CELL, PIVOTS, GAIN = 2_000, 256, 0.7
#: Guests that a cut may make for each row of a cell: at least, at most, and between them no more than blocks would copy it.
GUESTS = 4, 32
#: Slack of the bounds against rounding.
EPS = 1e-6

KEY = ["g", "path"]


def _beside(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """rows of the cells in facts; a table of few cells is broadcast, so that a cell with most rows stays where it is."""
    return rows.join(F.broadcast(facts) if facts.count() <= FEW else facts, on)


def _pairs(h: Column | str, q: Column | str) -> Column:
    """How many pairs a cell of h rows and q guests compares."""
    h, q = (F.col(x) if isinstance(x, str) else x for x in (h, q))
    return h * (h - 1) / 2.0 + h * q * 1.0


def _sizes(rows: DataFrame, on: list[str]) -> DataFrame:
    return rows.groupBy(*on).agg(F.count_if(~F.col("guest")).alias("h"), F.count_if("guest").alias("q"))


def _pivots(rows: DataFrame, level: int, most: int) -> DataFrame:
    """(g, path, k, p): of each cell up to `most` different vectors that are at home, by hash; only hashes are shuffled to choose them."""
    from pyspark.sql import Window as W

    home = rows.where("not guest").withColumn("_k", F.xxhash64("v", F.lit(level)))
    first = home.select(*KEY, "_k").distinct().withColumn("k", F.row_number().over(W.partitionBy(*KEY).orderBy("_k")) - 1).where(F.col("k") < most)
    return _beside(home.select(*KEY, "_k", "v"), first, [*KEY, "_k"]).groupBy(*KEY, "k").agg(F.first("v").alias("p"))


def _near(x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of rows x with the pivots y, and the pivots."""
    p = unit(vectors(y["p"]))
    return unit(vectors(x["v"])) @ p.T, p


def _radii(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """The least cosine of what is at home with each pivot; rows as near to two count for both."""
    x, y = x[~x["guest"].to_numpy(bool)], y.sort_values("k")
    if not len(x) or not len(y):
        return pd.DataFrame(columns=["g", "path", "k", "least"])
    s, _ = _near(x, y)
    least = np.where(s >= s.max(axis=1, keepdims=True) - EPS, s, 2.0).min(axis=0)
    at = np.flatnonzero(least < 2)
    return pd.DataFrame({"g": y["g"].to_numpy()[at], "path": y["path"].to_numpy()[at], "k": y["k"].to_numpy()[at], "least": least[at]})


def _go(x: pd.DataFrame, y: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows x and pivots y in order: the nearest pivot, and whom each row may have to visit."""
    s, p = _near(x, y)
    n, home = np.arange(len(x)), s.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 1e-300))
    plane = (s[n, home][:, None] - s) / apart[home] <= np.sqrt(1 - threshold * threshold) + EPS
    radius = np.arccos(np.clip(y["least"].to_numpy(float), -1, 1))
    ball = np.arccos(np.clip(s, -1, 1)) <= radius[None, :] + np.arccos(threshold) + EPS
    return home, plane & ball & (x["guest"].to_numpy(bool)[:, None] | (np.arange(len(y))[None, :] > home[:, None]))


def _count(threshold: float):
    """(g, path, k, h, q): how many rows would be at home with each pivot, and guests there."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame(columns=["g", "path", "k", "h", "q"])
        y = y.sort_values("k")
        home, go = _go(x, y, threshold)
        h = np.bincount(home[~x["guest"].to_numpy(bool)], minlength=len(y))
        return y[["g", "path", "k"]].assign(h=h, q=go.sum(axis=0))

    return run


def _route(threshold: float):
    """Where rows go: (g, path, id, v, guest, k)."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        names = ["g", "path", "id", "v", "guest", "k"]
        if not len(x) or not len(y):
            return pd.DataFrame(columns=names)
        y = y.sort_values("k")
        home, go = _go(x, y, threshold)
        own = np.flatnonzero(~x["guest"].to_numpy(bool))
        i, j = np.nonzero(go)
        out = x.iloc[np.concatenate((own, i))][["g", "path", "id", "v"]].reset_index(drop=True)
        out["guest"] = np.concatenate((np.zeros(len(own), bool), np.ones(len(i), bool)))
        out["k"] = y["k"].to_numpy()[np.concatenate((home[own], j))]
        return out[names]

    return run


def cut(rows: DataFrame, threshold: float, cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """(g, path, id, v, guest): rows (g, id, v) in their cells. Two rows of one g with that cosine share exactly one cell in which they are not both guests."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"g long, path string, id {kind}, v array<double>, guest boolean, k int"
    rest, done, level = materialize(rows.select("g", F.lit("").alias("path"), "id", "v", F.lit(False).alias("guest")), "cells"), [], 0
    while True:
        sizes = _sizes(rest, KEY)
        if threshold <= 0:
            return rest
        big = materialize(sizes.where((F.col("h") + F.col("q") > cell) & (F.col("h") > 1)), "sizes")
        done.append(rest.join(big, KEY, "left_anti") if big.count() > FEW else rest.join(F.broadcast(big), KEY, "left_anti"))
        if big.isEmpty():
            break
        large = _beside(rest, big, KEY).withColumn("n", (1 + F.floor((F.col("h") + F.col("q")) / cell)).cast("int"))
        large = large.withColumn("s", F.pmod(F.xxhash64("id"), "n").cast("int"))
        p = materialize(_pivots(large, level, pivots), "pivots")
        # rows of a cell are in several tasks, to each of which its pivots go
        tasks = big.select(*KEY, F.explode(F.sequence(F.lit(0), F.floor((F.col("h") + F.col("q")) / cell).cast("int"))).alias("s"))
        sent = p.join(tasks, KEY)
        keys = [*KEY, "s"]
        radii = large.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(_radii, "g long, path string, k int, least double")
        sent = p.join(radii.groupBy(*KEY, "k").agg(F.min("least").alias("least")), [*KEY, "k"]).join(tasks, KEY)
        # only cuts that save enough pairs at the price of few guests are made: their parts are counted first
        counted = large.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(_count(threshold), "g long, path string, k int, h long, q long")
        inner = materialize(counted.groupBy(*KEY, "k").agg(F.sum("h").alias("h"), F.sum("q").alias("q")).where("h > 0"), "inner")
        total = inner.groupBy(*KEY).agg(F.sum(_pairs("h", "q")).alias("_in"), F.sum("q").alias("_q"))
        all_ = F.col("h") + F.col("q")
        saved = total.join(big, KEY).where((F.col("_in") <= GAIN * _pairs("h", "q")) & (F.col("_q") <= all_ * F.greatest(F.lit(GUESTS[0]), F.least(F.lit(GUESTS[1]), all_ / cell))))
        saved = materialize(saved.select(*KEY), "saved")
        few = F.broadcast(saved) if saved.count() <= FEW else saved
        done.append(large.join(few, KEY, "left_anti").select(rest.columns))
        if saved.isEmpty():
            break
        parts = large.join(few, KEY).groupBy(*keys).cogroup(sent.join(saved, KEY).groupBy(*keys)).applyInPandas(_route(threshold), schema)
        parts = materialize(parts, "parts")
        alive = inner.where("h > 1 or q > 0").join(saved, KEY).select(*KEY, "k")
        rest = _beside(parts, alive, [*KEY, "k"]).select("g", F.concat("path", F.col("k").cast("string"), F.lit("/")).alias("path"), "id", "v", "guest")
        rest, level = materialize(rest, "cells"), level + 1
    return reduce(DataFrame.unionByName, done)


def compared(cells: DataFrame) -> float:
    """How many pairs of rows the cells of cut compare."""
    return _sizes(cells, KEY).agg(F.sum(_pairs("h", "q"))).first()[0] or 0.0


def _compare(threshold: float, x: pd.DataFrame, y: pd.DataFrame, same: bool) -> pd.DataFrame:
    sim = unit(vectors(x["v"])) @ unit(vectors(y["v"])).T
    i, j = np.nonzero(sim >= threshold)
    a, b = x["id"].to_numpy()[i], y["id"].to_numpy()[j]
    keep = (a < b if same else a != b) & ~(x["guest"].to_numpy(bool)[i] & y["guest"].to_numpy(bool)[j])
    a, b, sim = a[keep], b[keep], sim[i, j][keep]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sim": sim})


def near_pairs(rows: DataFrame, threshold: float, cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, sim): pairs of rows (g, id, v) of one g with a < b and at least that cosine. Identifiers are unique."""
    kind = rows.schema["id"].dataType.simpleString()
    schema, none = f"a {kind}, b {kind}, sim double", pd.DataFrame(columns=["a", "b", "sim"])
    cells = materialize(cut(rows, threshold, cell, pivots), "cells")
    sizes = materialize(_sizes(cells, KEY).where("h > 0 and h + q > 1").withColumn("n", (1 + F.floor((F.col("h") + F.col("q") - 1) / cell)).cast("int")), "sizes")
    bins = 1 + (sizes.where("n = 1").agg(F.sum(F.col("h") + F.col("q"))).first()[0] or 0) // (2 * cell)

    def within(x: pd.DataFrame) -> pd.DataFrame:
        found = [_compare(threshold, one, one, True) for _, one in x.groupby(KEY, sort=False)]
        return pd.concat(found) if found else none

    def between(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return _compare(threshold, x, y, key[-2] == key[-1]) if len(x) and len(y) else none

    small = _beside(cells, sizes.where("n = 1").select(*KEY), KEY).withColumn("_bin", F.pmod(F.xxhash64(*KEY), F.lit(bins)))
    out = small.groupBy("_bin").applyInPandas(lambda x: within(x), schema)
    wide = sizes.where("n > 1")
    if wide.isEmpty():
        return out
    x = _beside(cells, wide.select(*KEY, "n"), KEY).withColumn("_b", F.pmod(F.xxhash64("id"), "n").cast("int"))
    left = x.withColumn("_i", F.col("_b")).withColumn("_j", F.explode(F.sequence("_b", F.col("n") - 1)))
    right = x.select(*(F.col(c).alias(c) for c in x.columns)).withColumn("_j", F.col("_b")).withColumn("_i", F.explode(F.sequence(F.lit(0), "_b")))
    keys = [*KEY, "_i", "_j"]
    return out.union(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(between, schema))
