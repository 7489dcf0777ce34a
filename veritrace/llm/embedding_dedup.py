"""Embedding near-dedup by cross-polytope hashing.

Vectors are rotated pseudo-randomly (signs and fast Hadamard transforms, three times) and hashed to
the axis they lie nearest to; a few such axes make a bucket. Each vector stands in its own bucket
and in the likeliest next ones of every table; pairs that share a bucket are verified by their cosine.

A bucket is so many axes that there are at least as many buckets as vectors, so unlike vectors seldom
meet and the work grows with the number of vectors and of links. Of pairs of cosine 0.98 in 64
dimensions at least 0.99 share a bucket of one to five axes (tests/llm measures it).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.hashing import mix
from veritrace.operators.graph import connected_components
from veritrace.storage import materialize

COSINE, TABLES, PROBES = 0.98, 8, 4
#: Most vectors of a bucket compared in one task; a larger bucket is cut into blocks, compared two by two.
BLOCK = 1_024
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; its length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def buckets(x: np.ndarray, salt: np.ndarray, axes: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Bucket keys (rows, tables, probes) of the rows of x; salt keeps groups apart, axes are the hashes of a bucket."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, wide - d)))
    probes = min(probes, 2**axes)
    out = np.empty((n, tables, probes), np.uint64)
    rng = np.random.default_rng(SEED)
    choices = np.array([[c >> k & 1 for k in range(axes)] for c in range(2**axes)])
    for t in range(tables):
        codes, loss = np.empty((n, axes, 2), np.uint64), np.empty((n, axes))
        for k in range(axes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], wide))
            size = np.abs(y)
            two = np.argsort(-size, axis=1, kind="stable")[:, :2]
            v = np.take_along_axis(y, two, 1)
            codes[:, k] = two.astype(np.uint64) * np.uint64(2) + (v < 0)
            loss[:, k] = np.abs(v[:, 0]) - np.abs(v[:, 1])
        best = np.argsort(loss @ choices.T, axis=1, kind="stable")[:, :probes]
        for p in range(probes):
            key = salt ^ np.uint64((t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            for k in range(axes):
                key = mix(key) + codes[np.arange(n), k, choices[best[:, p], k]]
            out[:, t, p] = mix(key)
    return out


def _keys(classes: DataFrame, axes: int) -> DataFrame:
    """classes (cls, salt, v, m) with the array of all their bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(b.schema.get_field_index("v")).to_numpy(zero_copy_only=False)
            salt = b.column(b.schema.get_field_index("salt")).to_numpy().view(np.uint64)
            sizes, keys = np.array([len(x) for x in rows]), [None] * len(rows)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                for i, k in zip(own, buckets(np.array([rows[i] for i in own], np.float64), salt[own] + np.uint64(d), axes), strict=True):
                    keys[i] = k.ravel().view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("cls", "v", "m")] + [pa.array(keys, pa.list_(pa.int64()))], names=["cls", "v", "m", "keys"])

    kind = classes.schema["v"].dataType.simpleString()
    return classes.select("cls", "salt", "v", "m").mapInArrow(run, f"cls long, v {kind}, m long, keys array<long>")


def _compare(rows: DataFrame, cosine: float) -> DataFrame:
    """(a, b, links): links of class a found in one group of rows (g, b, cross, cls, v, m, keys, key), and a spanning forest of them."""

    def group(b: np.ndarray, cross: bool, cls, v, m, keys, key) -> tuple:
        norm = np.sqrt((v * v).sum(axis=1))
        near = (v @ v.T) / np.outer(norm, norm) >= cosine
        near &= cls[:, None] != cls[None, :]
        if cross:
            near &= b[:, None] != b[None, :]
        i, j = np.nonzero(np.triu(near, 1))
        links = np.zeros(len(cls), np.int64)
        for at in range(0, len(i), 20_000):  # a pair counts in the smallest bucket that both stand in, whichever row is first
            p, q = i[at : at + 20_000], j[at : at + 20_000]
            same = (keys[p][:, :, :, None] == keys[q][:, :, None, :]).any(axis=3).reshape(len(p), -1)
            least = np.where(same, keys[p].reshape(len(p), -1), np.iinfo(np.int64).max).min(axis=1)
            own = least == key
            np.add.at(links, p[own], m[q[own]])
            np.add.at(links, q[own], m[p[own]])
        left, src, dst = np.unique(np.concatenate((i, j))), [], []
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                x = todo.pop()
                got = left[near[x, left]]
                if len(got):
                    src.append(np.full(len(got), x))
                    dst.append(got)
                    todo += got.tolist()
                    left = left[~near[x, left]]
        some = np.flatnonzero(links)
        a = [cls[some], *(cls[x] for x in src)]
        z = [np.zeros(len(some), np.int64), *(cls[x] for x in dst)]
        n = [links[some], *(np.zeros(len(x), np.int64) for x in src)]
        return np.concatenate(a), np.concatenate(z), np.concatenate(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(t: pa.Table) -> Iterator[pa.RecordBatch]:
            g, b, cross, cls, m, key = (t.column(c).to_numpy() for c in ("g", "b", "cross", "cls", "m", "key"))
            v, keys = t.column("v").combine_chunks(), t.column("keys").combine_chunks()
            vat, vals = v.offsets.to_numpy(), v.values.to_numpy()
            kat, kall = keys.offsets.to_numpy(), keys.values.to_numpy()
            cut = np.flatnonzero(np.diff(g)) + 1
            out = []
            for s, e in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(g)])), strict=True):
                if e - s > 1 and (not cross[s] or (b[s:e] != b[s]).any()):
                    x = vals[vat[s] : vat[e]].reshape(e - s, -1).astype(np.float64)
                    k = kall[kat[s] : kat[e]].reshape(e - s, TABLES, -1)
                    out.append(group(b[s:e], bool(cross[s]), cls[s:e], x, m[s:e], k, key[s]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=["a", "b", "links"])

        held = None
        for x in batches:
            t = pa.Table.from_batches([x]) if held is None else pa.concat_tables([held, pa.Table.from_batches([x])])
            g = t.column("g").to_numpy()
            last = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on in the next batch
            if last:
                yield from told(t.slice(0, last).combine_chunks())
            held = t.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield from told(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "g").sortWithinPartitions("g", "cls").mapInArrow(run, "a long, b long, links long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links and components of every row of vectors (vec_id, embedding, label).

    (vec_id, n_links, component_id, kept). Only vectors of one label and length are compared. A
    vector that is null, empty, zero or holds a null or non-finite component, or whose label is
    null, links with nothing. Equal vectors are one class: they link with each other and share the
    links of the class, without being paired. Repeated rows keep their rows; a null vec_id is no
    component's smallest unless there is no other, and is kept; other columns are ignored; no rows
    give no rows.
    """
    spark = vectors.sparkSession
    # single precision is kept as it travels, and compared in double
    number = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{number}>").alias("v"))
    fit = "label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    # 0.0 and -0.0 are one value
    rows = rows.withColumn("v", F.when(F.coalesce(F.expr(fit), F.lit(False)), F.expr(f"transform(v, x -> x + cast(0 as {number}))")))
    rows = materialize(rows.withColumn("cls", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v"))), "vectors")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.xxhash64(F.first("label")).alias("salt"), F.first("v").alias("v"), F.count("*").alias("m"))
    classes = materialize(classes, "classes")
    n, d = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(2))).first()
    wide = 1 << max(1, (d - 1).bit_length())
    axes = max(1, math.ceil(math.log(max(n, 1)) / math.log(2 * wide)))
    keyed = materialize(_keys(classes, axes), "keys")
    stand = keyed.select("cls", F.explode(F.array_distinct("keys")).alias("key"))
    full = stand.groupBy("key").agg(F.count("*").alias("s")).where("s > 1").select(F.col("key").alias("of"), F.ceil(F.col("s") / BLOCK).cast("int").alias("blocks"))
    stand = stand.join(full, F.col("key") == F.col("of")).withColumn("b", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int"))
    stand = stand.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    stand = stand.select(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o")).alias("g"), "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), F.col("cls").alias("c"), "key")
    stand = stand.withColumn("cross", F.col("lo") != F.col("hi")).select("g", "b", "cross", "c", "key")
    found = materialize(_compare(stand.join(keyed, F.col("c") == F.col("cls")).select("g", "b", "cross", "cls", "v", "m", "keys", "key"), cosine), "links")
    links = found.where("links > 0").groupBy(F.col("a").alias("d")).agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("links = 0"), "a", "b")
    named = rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    named = named.join(links, F.col("cls") == F.col("d"), "left").join(comps, F.col("cls") == F.col("node"), "left")
    named = materialize(named.select("cls", "least", F.coalesce("component", "cls").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), "named")
    least = named.groupBy(F.col("comp").alias("of")).agg(F.min("least").alias("component_id"))
    of_class = named.join(least, F.col("comp") == F.col("of")).select(F.col("cls").alias("k"), "n_links", "component_id")
    out = rows.join(of_class, F.col("cls") == F.col("k"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
