"""Similarity joins, clusters of near-duplicates, nearest neighbours and set similarity.

Vectors of one group meet in cells around pivots (operators/cells.py); other pairwise joins have an
equality in front, or deal a stated set into blocks. Clusters come from min-label propagation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritrace.functions import columns as C
from veritrace.functions import fixed
from veritrace.operators.blocks import meet, meet_within, vectors
from veritrace.operators.cells import near_pairs
from veritrace.operators.graph import connected_components
from veritrace.storage import materialize

#: Values of the vectors of a block, pairs that a task reckons at once, and slack of their products against rounding.
VALUES, TILE, SLACK = 2**19, 2**20, 1e-9
#: Runs of a block, and keys of all its runs.
RUNS, KEYS = 4_000, 2**19


def _nodes(rows: DataFrame, by: str | list[str], ident: str, vector: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, copies): a node (g, id, v) for each vector of a group, named by the smallest identifier that has it, and (node, id) of the others.

    Vectors that are null or hold null or non-finite values have no partner, nor have zero vectors at
    a threshold above 0; vectors of different lengths do not meet.
    """
    by = [by] if isinstance(by, str) else by
    v = rows.where(F.col(vector).isNotNull()).select(F.xxhash64(*by, F.size(vector)).alias("g"), F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    v = materialize(v.where(F.exists("v", lambda x: x != 0)) if threshold > 0 else v, "vectors")
    nodes = materialize(v.groupBy("g", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "nodes")
    shared = nodes.where("n > 1").select("g", "v", F.col("id").alias("node"))
    copies = v.join(shared, ["g", "v"]).where("id <> node").select("node", "id").distinct()
    return nodes.select("g", "id", "v"), materialize(copies, "copies")


def similar_pairs(rows: DataFrame, by: str | list[str], ident: str, vector: str, threshold: float = fixed.DEDUP_COSINE) -> DataFrame:
    """(a, b, sim): pairs of one group with a < b and at least that cosine; identifiers are unique.

    Different vectors meet in cells (operators/cells.py); the pairs of their copies follow from theirs.
    """
    nodes, copies = _nodes(rows, by, ident, vector, threshold)
    pairs = near_pairs(nodes, threshold)
    if copies.isEmpty():
        return pairs
    pairs = materialize(pairs, "pairs")
    zero = nodes.where(~F.exists("v", lambda x: x != 0)).select(F.col("id").alias("node"), F.lit(0.0).alias("s"))
    member = copies.union(copies.select("node", F.col("node").alias("id")).distinct())

    def spread(p: DataFrame, end: str) -> DataFrame:
        """p with the copies of one end beside it."""
        j = p.join(member, p[end] == member["node"], "left")
        return j.withColumn(end, F.coalesce("id", end)).drop("node", "id")

    met = spread(spread(pairs, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
    one, two = member.withColumnRenamed("id", "a"), member.select("node", F.col("id").alias("b"))
    same = one.join(two, "node").where("a < b").join(zero, "node", "left").select("a", "b", F.coalesce("s", F.lit(1.0)).alias("sim"))
    return met.union(same.where(F.col("sim") >= threshold))


def similar_links(rows: DataFrame, by: str | list[str], ident: str, vector: str, threshold: float = fixed.DEDUP_COSINE) -> DataFrame:
    """(a, b) that connect what similar_pairs connects, with one link for each copy of a vector instead of all pairs of copies; the threshold is above 0."""
    if threshold <= 0:
        raise ValueError("links need a threshold above 0")
    nodes, copies = _nodes(rows, by, ident, vector, threshold)
    return near_pairs(nodes, threshold).select("a", "b").union(copies.select(F.col("node").alias("a"), F.col("id").alias("b")))


def clusters(rows: DataFrame, ident: str, pairs: DataFrame) -> DataFrame:
    """rows with `cluster`, the smallest identifier reachable by pairs (a, b)."""
    comps = connected_components(pairs.select("a", "b"), "a", "b")
    return rows.join(comps, rows[ident] == comps["node"], "left").withColumn("cluster", F.coalesce("component", ident)).drop("node", "component")


def deduplicate(signals: DataFrame, by: list[str], vector: str, threshold: float = fixed.DEDUP_COSINE) -> DataFrame:
    """One signal of each cluster: the most credible, then surest, then earliest; the others are its corroboration.

    signals have ord, id, source_url, source_credibility, confidence_score. Singletons stay as they are, with one source.
    """
    member = clusters(signals, "ord", similar_links(signals, by, "ord", vector, threshold))
    best = W.partitionBy("cluster").orderBy(F.col("source_credibility").desc(), F.col("confidence_score").desc(), F.col("ord").asc())
    member = member.withColumns({"_r": F.row_number().over(best), "_d": C.registrable_domain("source_url")})
    facts = member.groupBy("cluster").agg(
        F.count("*").alias("cluster_size"),
        F.greatest(F.lit(1), F.countDistinct(F.nullif("_d", F.lit("")))).alias("independent_source_count"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") > 1, F.struct("ord", "id")))), lambda x: x["id"]).alias("corroborating_signals"),
    )
    out = member.where("_r = 1").drop("_r", "_d", "independent_source_count", "corroborating_signals").join(facts, "cluster")
    return out.withColumn("is_corroborated", F.col("cluster_size") > 1)


def contradiction_candidates(signals: DataFrame, run: str, vector: str, threshold: float = fixed.CONTRADICTION_COSINE, cap: int = fixed.MAX_PAIRS) -> DataFrame:
    """(run, a, b, sim): of each run the cap most similar pairs of one entity that are alike, or opposed in one category.

    Signals meet in blocks, of each two of which the best cap pairs are kept. Of signals that are equal
    but for ord only the last can be in these pairs, so more than that do not meet. A pair whose vectors
    have no product, being null, holding null or of different lengths, has a null sim and comes last.
    """
    pole = F.when(F.col("signal_polarity") == "POSITIVE", 1).when(F.col("signal_polarity") == "NEGATIVE", -1).otherwise(0)
    one = signals.select(F.col(run).alias("run"), "entity_name", "ord", F.col("risk_category").alias("category"), pole.alias("pole"), F.col(vector).cast("array<double>").alias("v"))
    one = materialize(one.where("run is not null and entity_name is not null and ord is not null"), "signals")
    alike = ["run", "entity_name", "category", "pole", "v"]
    h = F.xxhash64(*alike).alias("h")
    hot = materialize(one.groupBy(h).count().where(F.col("count") > cap + 1).select("h"), "hot")
    if not hot.isEmpty():
        one = one.withColumn("h", h)
        copies = one.join(hot, "h", "left_semi")  # equal rows of one ord are interchangeable
        copies = copies.withColumn("_r", F.row_number().over(W.partitionBy(*alike, "ord").orderBy("h"))).where(F.col("_r") <= cap)
        copies = copies.withColumn("_r", F.dense_rank().over(W.partitionBy(*alike).orderBy(F.col("ord").desc()))).where(F.col("_r") <= cap + 1)
        one = materialize(one.join(hot, "h", "left_anti").drop("h").unionByName(copies.drop("h", "_r")), "signals")
    kinds = {c: one.schema[c].dataType.simpleString() for c in ("run", "ord")}
    blocks = F.count("*") * F.greatest(F.lit(1), F.max(F.size("v"))) / VALUES
    some = meet_within(one, _best_pairs(threshold, cap), f"run {kinds['run']}, a {kinds['ord']}, b {kinds['ord']}, sim double", ("run", "entity_name"), blocks)
    order = W.partitionBy("run").orderBy(F.col("sim").desc(), F.col("a").desc(), F.col("b").desc())
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select(F.col("run").alias(run), "a", "b", "sim", "rank")


def _best_pairs(threshold: float, cap: int):
    def compare(left: pa.Table, right: pa.Table | None) -> pa.Table:
        """The best cap pairs of two blocks, or of one; products of all pairs tell which few are reckoned exactly, as a sum in order over the product of the norms."""
        t = left if right is None else pa.concat_tables([left, right])
        ords = t["ord"].combine_chunks()
        place = pc.index_in(ords, ords.take(pc.sort_indices(ords))).to_numpy().astype(np.int64)  # ord as a number that sorts like it, equal ones alike
        category = pc.fill_null(pc.dictionary_encode(t["category"].combine_chunks()).indices, -1).to_numpy()
        pole = t["pole"].to_numpy().astype(np.int8)
        v = t["v"].combine_chunks()
        length = pc.fill_null(pc.list_value_length(v), -1).to_numpy().copy()
        parent = pc.list_parent_indices(v).to_numpy()
        values = pc.list_flatten(v)
        length[parent[pc.is_null(values).to_numpy(zero_copy_only=False)]] = -1
        side = np.zeros(len(t), np.int8)
        side[len(left) :] = 1
        best = np.empty((0, 4))  # sim or, of a NaN, infinity; known; places
        for n in np.unique(length[length >= 0]):
            rows = np.flatnonzero(length == n)
            x = pc.list_flatten(v.take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(len(rows), n)
            best = _products(x, place[rows], category[rows], pole[rows], None if right is None else side[rows], threshold, cap, best)
        if len(best) < cap and len(np.unique(length)) + (length < 0).sum() > 1:
            best = _unknown(length, place, category, pole, None if right is None else side, cap, best)
        back = np.empty(len(t), np.int64)
        back[place] = np.arange(len(t))
        a, b = (ords.take(pa.array(back[best[:, k].astype(np.int64)])) for k in (2, 3))
        sim = np.where(np.isposinf(best[:, 0]), np.nan, best[:, 0])
        return pa.table({"run": t["run"].take(pa.array(np.zeros(len(best), np.int64))), "a": a, "b": b, "sim": pa.array(sim, pa.float64(), mask=best[:, 1] == 0)})

    return compare


def _top(best: np.ndarray, cap: int) -> np.ndarray:
    """The first cap by sim, known ones first, then by both places, all descending."""
    return best[np.lexsort((-best[:, 3], -best[:, 2], -best[:, 0], -best[:, 1]))[:cap]]


def _opposed(category: np.ndarray, pole: np.ndarray, i, j) -> np.ndarray:
    return (category[i] == category[j]) & (category[i] >= 0) & (pole[i] * pole[j] < 0)


def _tiles(n: int, side: np.ndarray | None):
    """(rows, columns) that cover the pairs of rows of two sides, or of one side in whose square each pair stands twice."""
    one, two = (np.arange(n),) * 2 if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    step = max(1, TILE // max(1, len(two)))
    for at in range(0, len(one), step):
        yield one[at : at + step], two[at:] if side is None else two


def _products(x, place, category, pole, side, threshold, cap, best):
    with np.errstate(all="ignore"):
        norm = np.sqrt(_in_order(x, x))
        u = x / np.where(norm == 0, 1, np.where(np.isfinite(norm), norm, np.nan))[:, None]
        odd = not np.isfinite(u).all()
        for i, j in _tiles(len(x), side):
            s = u[i] @ u[j].T
            if odd:
                s = np.where(np.isnan(s), np.inf, s)
            bound = best[-1, 0] if len(best) == cap else -np.inf
            some = s >= max(threshold, bound) - SLACK
            if bound < threshold:
                some |= (s >= bound - SLACK) & _opposed(category, pole, i[:, None], j[None, :])
            p, q = np.nonzero(some)
            s, p, q = s[p, q], i[p], j[q]
            apart = (place[p] != place[q]) & ((p < q) if side is None else True)
            s, p, q = s[apart], p[apart], q[apart]
            if len(s) > cap:  # pairs at the threshold may fall out, so the bound comes from those that surely stay
                sure = s[(s >= threshold + SLACK) | _opposed(category, pole, p, q)]
                if len(sure) >= cap:
                    keep = s >= np.partition(sure, len(sure) - cap)[len(sure) - cap] - SLACK
                    p, q = p[keep], q[keep]
            if not len(p):
                continue
            both = norm[p] * norm[q]
            sim = np.where(both == 0, 0.0, _in_order(x, x, p, q) / both)
            sim[np.isnan(sim)] = np.inf
            stay = (sim >= threshold) | _opposed(category, pole, p, q)
            p, q, sim = p[stay], q[stay], sim[stay]
            new = np.column_stack((sim, np.ones(len(sim)), np.minimum(place[p], place[q]), np.maximum(place[p], place[q])))
            best = _top(np.concatenate((best, new)), cap)
    return best


def _in_order(x: np.ndarray, y: np.ndarray, p=slice(None), q=slice(None)) -> np.ndarray:
    """Inner products of rows, added value after value."""
    total = np.zeros(len(x[p, :0]))
    for k in range(x.shape[1]):
        total += x[p, k] * y[q, k]
    return total


def _unknown(length, place, category, pole, side, cap, best):
    """Opposed pairs without a product, after those with one."""
    for i, j in _tiles(len(place), side):
        none = (length[i][:, None] != length[j][None, :]) | (length[i] < 0)[:, None]
        p, q = np.nonzero(none & _opposed(category, pole, i[:, None], j[None, :]))
        p, q = i[p], j[q]
        apart = (place[p] != place[q]) & ((p < q) if side is None else True)
        p, q = p[apart], q[apart]
        new = np.column_stack((np.zeros(len(p)), np.zeros(len(p)), np.minimum(place[p], place[q]), np.maximum(place[p], place[q])))
        best = _top(np.concatenate((best, new)), cap)
    return best


def nearest(queries: DataFrame, index: DataFrame, k: int = 3) -> DataFrame:
    """(query, item, sim, rank): the k items of highest inner product for each query, at a tie the smaller item.

    queries (query, v) are a stated set, index (item, v) may be large: both are dealt into blocks, two
    blocks meet in one task and give the block's best k of each query, of which the best k stay.
    """
    kinds = queries.schema["query"].dataType.simpleString(), index.schema["item"].dataType.simpleString()

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("item")
        sim = vectors(left["v"]) @ vectors(right["v"]).T
        top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(left)), top.shape[1])
        return pd.DataFrame({"query": left["query"].to_numpy()[rows], "item": right["item"].to_numpy()[top.ravel()], "sim": sim[rows, top.ravel()]})

    some = meet(queries.select("query", "v"), index.select("item", "v"), best, f"query {kinds[0]}, item {kinds[1]}, sim double")
    order = W.partitionBy("query").orderBy(F.col("sim").desc(), F.col("item").asc())
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "item", "sim", "rank")


def consistency(runs: DataFrame, subject: str, run: str, keys: str) -> DataFrame:
    """(subject, pairs, mean_jaccard, min_jaccard) over all pairs of runs of a subject; null for fewer than two.

    Runs with keys meet in blocks, and of each two blocks only count, sum and least leave the task. Pairs
    with a run without keys are arithmetic: 0, or 1 if both are empty. A null subject has no pairs.
    """
    own = runs.select(F.col(subject).alias("s"), F.col(run).alias("r"), F.array_distinct(F.coalesce(keys, F.array().cast(runs.schema[keys].dataType))).alias("k"))
    own = materialize(own, "runs")
    n = own.groupBy("s").agg(F.count("*").alias("runs"), F.count_if(F.size("k") == 0).alias("empty"))
    some = meet_within(own.where((F.size("k") > 0) & F.col("s").isNotNull()), _jaccards, f"s {own.schema['s'].dataType.simpleString()}, total double, least double", ("s",), F.greatest(F.count("*") / RUNS, F.sum(F.size("k")) / KEYS))
    met = some.groupBy(F.col("s").alias("_s")).agg(F.sum("total").alias("total"), F.min("least").alias("least"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    alike = two("empty")  # pairs of empty runs
    apart = F.col("empty") * (F.col("runs") - F.col("empty"))  # of an empty one with another
    least = F.when(apart > 0, 0.0).otherwise(F.coalesce("least", F.lit(1.0)))
    out = n.withColumn("pairs", F.when(F.col("s").isNull(), 0).otherwise(two("runs")).cast("long")).join(met, F.col("s") == F.col("_s"), "left")
    return out.select(F.col("s").alias(subject), "pairs", F.when(F.col("pairs") > 0, (F.coalesce("total", F.lit(0.0)) + alike) / F.col("pairs")).alias("mean_jaccard"), F.when(F.col("pairs") > 0, least).alias("min_jaccard"))


def _jaccards(left: pa.Table, right: pa.Table | None) -> pa.Table:
    """Sum and least of the similarities of two blocks of runs (s, k), or of one.

    Common keys are counted by products of matrices; a key that few pairs have is counted for those.
    """
    t = left if right is None else pa.concat_tables([left, right])
    k = t["k"].combine_chunks()
    code = pc.dictionary_encode(pc.list_flatten(k), null_encoding="encode").indices.to_numpy().astype(np.int64)
    row = pc.list_parent_indices(k).to_numpy()
    size = np.bincount(row, minlength=len(t)).astype(np.float64)
    one = row < len(left)
    x = (row[one], code[one])
    y = x if right is None else (row[~one] - len(left), code[~one])
    m, n = len(left), len(left) if right is None else len(right)
    if not m or not n or right is None and n < 2:
        return pa.table({"s": t["s"].slice(0, 0), "total": pa.array([], pa.float64()), "least": pa.array([], pa.float64())})
    held = np.bincount(x[1], minlength=code.max() + 1), np.bincount(y[1], minlength=code.max() + 1)
    both = held[0] * held[1]
    common = np.zeros((m, n), np.float32)
    many = np.flatnonzero(both > m * n / 256)
    for at in range(0, len(many), 512):
        some = np.full(len(both), -1)
        some[many[at : at + 512]] = np.arange(len(many[at : at + 512]))
        has = [np.zeros((size_, len(many[at : at + 512])), np.float32) for size_ in (m, n)]
        for h, (r, c) in zip(has, (x, y), strict=True):
            h[r[some[c] >= 0], some[c[some[c] >= 0]]] = 1
        common += has[0] @ has[1].T
    few = (both > 0) & (both <= m * n / 256)
    p, q = ((r[few[c]][np.argsort(c[few[c]], kind="stable")], np.sort(c[few[c]])) for r, c in (x, y))
    begin = np.cumsum(held[1] * few) - held[1] * few  # where a key's runs begin on the right
    step = max(1, TILE // max(1, n // 256))
    for at in range(0, len(p[0]), step):
        r, c = p[0][at : at + step], p[1][at : at + step]
        times = held[1][c]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        np.add.at(common, (np.repeat(r, times), q[0][np.repeat(begin[c], times) + inside]), 1)
    a, b = size[:m], size[:n] if right is None else size[m:]
    total, least = 0.0, np.inf
    step = max(1, TILE // n)
    for at in range(0, m, step):
        c = common[at : at + step].astype(np.float64)
        j = c / (a[at : at + step, None] + b[None, :] - c)
        if right is None:
            j = j[np.triu_indices(len(j), at + 1, n)]
        total, least = total + j.sum(), min(least, j.min(initial=np.inf))
    return pa.table({"s": t["s"].slice(0, 1), "total": [float(total)], "least": [float(least)]})


def fingerprint_key(text: Column | str, matched: Column | None = None) -> Column:
    """t and the matched id, or n: and the first eight normalised words."""
    own = F.concat(F.lit("n:"), F.array_join(F.slice(F.split(C.normalize_text(text), " "), 1, 8), " "))
    return own if matched is None else F.coalesce(F.concat(F.lit("t"), matched.cast("string")), own)
