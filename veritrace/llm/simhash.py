"""SimHash near-dedup: fingerprints of word shingles, linked within a small Hamming distance.

Links are found by the generalised pigeonhole: the 64 bits are grouped by correlation into
partitions, each partition gets its own threshold by dynamic programming over estimated candidate
counts, fingerprints are probed by partition value, and every candidate pair is verified on all bits.

For a similarity instead of a distance (near_copies) fingerprints are WIDE words long: at Jaccard
0.8 two differ in 15 % of their bits, and the thresholds are those of least cost at which a pair
misses all partitions in at most MISSED of the cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.hashing import mix
from veritrace.operators.graph import connected_components
from veritrace.storage import materialize

#: Most fingerprints that share a probed value in one task; larger buckets are probed on further bits.
BUCKET = 8_192
#: Words of 64 bits of a wide fingerprint, and how often a pair at the similarity may share no probed value.
WIDE, MISSED = 16, 0.005
#: Candidates that cost as much as a probed row.
PAIRS_A_ROW = 500


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 hashes of a text's word shingles; 0 without a word."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(w))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE words of the bits set in over half of the hashes of a set, each word by its own mixing of them."""
    ones = np.zeros(64 * WIDE, np.int64)
    salts = mix(np.arange(1, WIDE + 1, dtype=np.uint64) << np.uint64(32))
    for at in range(0, len(hashes), 255):  # counts of so many fit a byte
        x = mix(hashes[at : at + 255, None] ^ salts)
        ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8 * WIDE), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, *extra): fp is the fingerprint as a signed long; extra are columns of longs to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *(b.column(i) for i in range(2, b.num_columns))], names=["doc_id", "fp", *extra])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra)
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", {x} long" for x in extra))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bit_counts(fps: DataFrame, words: int = 1) -> tuple[int, np.ndarray]:
    """The number of fingerprints (fp, an array of words if there are several) and how many have both bits set, for each two bits of each word."""
    cells = 4096 * words + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((words, 64, 64))
        for b in batches:
            column = b.column(0) if words == 1 else b.column(0).flatten()
            x = np.unpackbits(np.ascontiguousarray(column.to_numpy()).view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little").astype(np.float32)
            for k in range(words):
                both[k] += x[:, 64 * k : 64 * k + 64].T @ x[:, 64 * k : 64 * k + 64]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["cell", "n"])

    told = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(cells)
    flat[told.column(0).to_numpy()] = told.column(1).to_numpy()
    both = flat[:-1].reshape(words, 64, 64)
    return int(flat[-1]), both[0] if words == 1 else both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in parts of equal width: each part starts at the most even bit left and takes those most correlated with it."""
    p = np.diag(both) / max(n, 1)
    var = np.maximum(p * (1 - p), 1e-9)
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.sqrt(np.outer(var, var))
    left, out = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        own = [max(sorted(left), key=lambda j: var[j])]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(sorted(left), key=lambda j: corr[j, own].mean()))
            left.remove(own[-1])
        out.append(own)
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The thresholds, from -1 (not probed) on, of least cost whose sum is total. costs[i][t + 1]: of threshold t in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(cost, -1):
                if s + t not in after or c + x < after[s + t][0]:
                    after[s + t] = (c + x, [*ts, t])
        best = after
    return best[total]


def plan_probes(fps: DataFrame, distance: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the partitions to probe, over all distinct fingerprints."""
    n, both = _bit_counts(fps)
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p * p + (1 - p) * (1 - p), 1e-6, 1)
    options = {m: group_bits(n, both, m) for m in (2, 3, 4)}
    masks = [(m, i, sum(1 << j for j in own)) for m, parts in options.items() for i, own in enumerate(parts)]
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("v")) for k, (_, _, mask) in enumerate(masks))))
    f = fps.select(values.alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("f"))
    shared = {r["k"]: float(r["pairs"]) for r in f.groupBy("k").agg((F.sum((F.col("f") * (F.col("f") - 1)).cast("double")) / 2).alias("pairs")).collect()}
    choices = []
    for m, parts in options.items():
        costs = []
        for i, own in enumerate(parts):
            exact = shared.get(next(k for k, x in enumerate(masks) if x[:2] == (m, i)), 0.0)
            odds = (1 - agree[own]) / agree[own]
            one = 1 + odds.sum()
            two = one + (odds.sum() ** 2 - (odds**2).sum()) / 2
            w = len(own)  # a probe costs a row for each value it looks up, and its candidates
            costs.append([0.0, n + exact, n * (1 + w) + exact * one, n * (1 + w + w * (w - 1) / 2) + exact * two][: distance + 2])
        cost, ts = allocate(costs, distance - m + 1)
        choices.append((cost, m, ts))
    _, m, ts = min(choices)
    return [(sum(1 << j for j in own), t) for own, t in zip(options[m], ts, strict=True) if t >= 0]


def likeliest(costs: list[list[float]], gains: list[list[float]], need: float) -> list[int]:
    """The thresholds, from -1 (not probed) on, of least cost whose gains add up to need; costs[i][t + 1] and gains[i][t + 1] are of threshold t in part i."""
    step = need / 400  # gains are rounded down to so fine steps
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * 400
    for cost, gain in zip(costs, gains, strict=True):
        after: list[tuple[float, list[int]] | None] = [None] * 401
        for s, got in enumerate(best):
            if got is not None:
                for t, (c, g) in enumerate(zip(cost, gain, strict=True), -1):
                    to = min(400, s + int(g / step))
                    if after[to] is None or got[0] + c < after[to][0]:
                        after[to] = (got[0] + c, [*got[1], t])
        best = after
    if best[-1] is None:
        raise ValueError("the fingerprints are too short for the similarity")
    return best[-1][1]


def plan_wide(fps: DataFrame, similarity: float) -> list[tuple[int, int, int]]:
    """(word, mask, threshold) of the partitions of wide fingerprints to probe for pairs of at least that Jaccard similarity."""
    n, both = _bit_counts(fps, WIDE)
    differ = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    choices = []
    for m in (3, 4):
        parts, costs, gains = [], [], []
        for word in range(WIDE):
            p = np.diag(both[word]) / max(n, 1)
            agree = np.clip(p * p + (1 - p) * (1 - p), 1e-6, 1)
            for own in group_bits(n, both[word], m):
                w, odds = len(own), ((1 - agree[own]) / agree[own]).sum()
                pairs = n * n / 2 * float(np.prod(agree[own])) / PAIRS_A_ROW
                none = (1 - differ) ** w
                one = none + w * differ * (1 - differ) ** (w - 1)
                parts.append((word, sum(1 << j for j in own)))
                costs.append([0.0, n + pairs, n * (1 + w) + pairs * (1 + odds)])
                gains.append([0.0, -np.log1p(-none), -np.log1p(-one)])
        ts = likeliest(costs, gains, -np.log(MISSED))
        choices.append((sum(c[t + 1] for c, t in zip(costs, ts, strict=True)), [(*part, t) for part, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(choices, key=lambda x: x[0])[1]


def wide_probes(plan: list[tuple[int, int, int]], some: range) -> Column:
    """An array of (p, v): the values v of a wide fingerprint (fp) that are probed in those partitions p of the plan."""
    out = []
    for p in some:
        word, mask, t = plan[p]
        for flip in _flips(mask, t):
            v = F.get("fp", F.lit(word)).bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(flip)))
            out.append(F.struct(F.lit(p).alias("p"), v.alias("v")))
    return F.array(*out)


def passes(plan: list[tuple[int, int, int]], most: int) -> list[range]:
    """The partitions of a plan in runs that probe at most so many values a fingerprint, unless a single one probes more."""
    out, start, n = [], 0, 0
    for p, (_, mask, t) in enumerate(plan):
        own = len(_flips(mask, t))
        if n and n + own > most:
            out.append(range(start, p))
            start, n = p, 0
        n += own
    return [*out, range(start, len(plan))]


def first_shared(plan: list[tuple[int, int, int]], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(p, v): of each pair of wide fingerprints the first partition in which they are within its threshold, -1 if none, and the smaller of their values there, which both probe."""
    p, v, left = np.full(len(x), -1), np.zeros(len(x), np.int64), np.arange(len(x))
    for k, (word, mask, t) in enumerate(plan):
        a, b = x[left, word] & np.uint64(mask), y[left, word] & np.uint64(mask)
        on = np.bitwise_count(a ^ b) <= t
        p[left[on]], v[left[on]] = k, np.minimum(a[on].view(np.int64), b[on].view(np.int64))
        left = left[~on]
    return p, v


def _flips(mask: int, t: int) -> list[int]:
    bits = [j for j in range(64) if mask >> j & 1]
    out = [0]
    if t >= 1:
        out += [1 << j for j in bits]
    if t >= 2:
        out += [1 << a | 1 << b for i, a in enumerate(bits) for b in bits[:i]]
    return out


def _thirds(mask: int, parts: int) -> list[int]:
    bits = [j for j in range(64) if mask >> j & 1]
    return [sum(1 << j for j in bits[k::parts]) for k in range(parts) if bits[k::parts]]


def forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within distance among distinct values: every one is compared with all not yet reached."""
    v = values.view(np.uint64)
    left, a, b = np.arange(len(v)), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(v[left] ^ v[i]) <= distance
            if near.any():
                got = left[near]
                a.append(np.full(len(got), i))
                b.append(got)
                todo += got.tolist()
                left = left[~near]
    if not a:
        return values[:0], values[:0]
    return values[np.concatenate(a)], values[np.concatenate(b)]


def _verified(rows: DataFrame, distance: int) -> DataFrame:
    """(src, dst): links among the rows (key, fp) that share a key, as a forest for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(k: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(k)) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(k)]))
            two = starts[ends - starts == 2]
            near = two[np.bitwise_count((v[two] ^ v[two + 1]).view(np.uint64)) <= distance]
            src, dst = [v[near]], [v[near + 1]]
            for i in np.flatnonzero(ends - starts > 2):
                a, b = forest(np.unique(v[starts[i] : ends[i]]), distance)
                src.append(a)
                dst.append(b)
            s, d = np.concatenate(src), np.concatenate(dst)
            yield pa.RecordBatch.from_arrays([pa.array(s[s != d]), pa.array(d[s != d])], names=["src", "dst"])

        k, v = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            k, v = np.concatenate((k, b.column(0).to_numpy())), np.concatenate((v, b.column(1).to_numpy()))
            if len(k):
                last = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
                if last:
                    yield from told(k[:last], v[:last])
                k, v = k[last:], v[last:]
        if len(k):
            yield from told(k, v)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "src long, dst long")


def link(fps: DataFrame, distance: int = 2) -> DataFrame:
    """(src, dst): links of distinct fingerprints (fp) within distance, enough to connect all that are linked.

    Buckets above BUCKET are never compared whole: their fingerprints are probed on further bits,
    cut into distance + 1 parts of which a linked pair shares one, until every bucket is small.
    """
    spark, keys = fps.sparkSession, []
    for mask, t in plan_probes(fps, distance):
        for flip in _flips(mask, t):
            value = F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(flip)))
            keys.append(F.struct(F.xxhash64(F.lit(mask % (1 << 62)), value).alias("key"), F.lit(_signed(~mask & (1 << 64) - 1)).alias("free")))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.key", "fp", "x.free")
    edges = None
    for level in range(64):
        rows = materialize(rows, "probes")
        hot = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select(F.col("key").alias("hot")), "hot")
        cold = rows.join(hot, rows["key"] == hot["hot"], "left_anti").select("key", "fp")
        found = _verified(cold, distance)
        edges = found if edges is None else edges.union(found)
        frees = [r["free"] for r in rows.join(hot, rows["key"] == hot["hot"], "left_semi").select("free").distinct().collect()]
        if not frees:
            return edges
        parts = distance + 1
        cuts = [(f, _signed(m), _signed(f % (1 << 64) & ~m)) for f in frees for m in _thirds(f % (1 << 64), parts)]
        cut = F.broadcast(spark.createDataFrame(cuts, "free long, mask long, rest long"))
        rows = rows.join(hot, rows["key"] == hot["hot"], "left_semi").join(cut, "free")
        rows = rows.select(F.xxhash64("key", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", F.col("rest").alias("free"))
    raise RuntimeError("buckets did not get small")


def simhash_groups(docs: DataFrame, distance: int = 2, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, group, *extra) of every row of docs (doc_id, text); group is a fingerprint that names the component.

    component_id is the smallest doc_id reachable by links, itself included. Equal fingerprints are
    one node, so copies never pair up. A null, empty or wordless text has fingerprint 0 and links
    like others; repeated rows keep their rows; a null doc_id is no component's smallest unless its
    component has no other; other columns are ignored; no rows give no rows.
    """
    fp = materialize(fingerprints(docs, extra), "fingerprints")
    nodes = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    comps = connected_components(link(nodes.select("fp"), distance)).withColumnRenamed("node", "n")
    tied = nodes.join(comps, nodes["fp"] == comps["n"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    least = tied.groupBy(F.col("c").alias("of")).agg(F.min("least").alias("component_id"))
    named = tied.join(least, F.col("c") == F.col("of")).select(F.col("fp").alias("f"), F.col("c").alias("group"), "component_id")
    return fp.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id", "group", *extra)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
