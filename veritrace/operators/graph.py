"""Connected components over an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.storage import materialize

#: A node with more edges than this, and than one in SHARE of all edges, is a hot centre; there are at most SHARE of them.
HOT, SHARE = 500, 2_000


def _with_low(edges: DataFrame, low: DataFrame, limit: int) -> DataFrame:
    """edges (u, v) with the m of their u from low (u, m, n); hot u, of over limit edges, are few and travel to the edges."""
    hot = F.broadcast(low.where(F.col("n") > limit).select("u", "m"))
    cold = edges.join(hot.select("u"), "u", "left_anti").join(low.where(F.col("n") <= limit).select("u", "m"), "u")
    return cold.union(edges.join(hot, "u"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Alternates two steps until nothing changes. Large star: every node's larger neighbours are
    tied to the smallest node around it. Small star: a node's smaller neighbours are tied to the
    smallest of them. Each edge stays one narrow row, so a node with very many neighbours costs
    rows, never a list, and its rows stay where they are; the number of rounds grows with the
    logarithm of a chain's length. Null ends and self-loops are ignored; an empty edge table gives
    an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    # a fixed point is a set of stars: compare an order-free digest of the edges
    digest = [F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))]
    last = e.agg(*digest).first()
    for _ in range(max_rounds if last[0] else 0):
        limit = max(HOT, 2 * last[0] // SHARE)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_low(both, low, limit).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        j = _with_low(large, low, limit)
        small = j.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(small.where("u <> v").distinct(), "edges")
        now = e.agg(*digest).first()
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
