"""SimHash near-dedup at a similarity: word shingle sets linked by their Jaccard similarity.

Candidates come from the generalised pigeonhole of simhash over wide fingerprints of the sets; those
whose fingerprints are too far apart go, and the others are verified by the exact similarity of the
two sets: first each set with its nearest candidate, then all pairs that this has not connected. A
bucket full of candidates gives a forest of them at first; all its pairs between sets that are then
still apart follow, however many: the sets themselves meet in groups, which tell links and no pairs.
At similarity 0.8 a pair is missed in 6 of 1,000 cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.llm.hashing import mix
from veritrace.llm.simhash import WIDE, _flips, first_shared, passes, plan_wide, wide_fingerprint, wide_probes
from veritrace.llm.slices import give_back, slices
from veritrace.operators.graph import connected_components
from veritrace.storage import collect, forget, materialize

SIMILARITY, WORDS = 0.8, 5
#: Most bits in which the first words of two candidates differ: at 0.8 they do in 10 of 64, over this in 3 of 10,000 cases.
FAR = 20
#: Buckets up to so many sets give all their candidates at once.
SMALL = 64
#: So do larger ones with at most so many candidates a set, and one block; of the others all pairs that a forest leaves apart follow, in blocks of WIDER, two by two.
PAIRED, BLOCK, WIDER = 16, 1_024, 16
#: Values that a fingerprint probes in one pass: it travels to so many buckets at a time.
PROBES = 12
#: Probes that a task looks at together, and pairs.
ROWS, PAIRS = 100_000, 200_000
#: Shingles of the sets that one task verifies together, on average (of a run of a full bucket's sets: at most), and most partners of a set in it.
TOGETHER, PARTNERS = 2_000_000, 2_000
#: Places of the table that tells hot buckets; it is this many whole numbers, however large the corpus.
SLOTS = 1 << 20
SEED = 7


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted; all words of a shorter text are one, a wordless text has none."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h, k = xxhash.xxh64_intdigest, min(words, len(w))
    word = np.array([h(x, SEED) for x in w], np.uint64)
    n = len(w) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out) + word[i : i + n]
    return np.unique(mix(out))


def _name(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))


def _named(docs: DataFrame, words: int, extra: tuple[str, ...]) -> DataFrame:
    """(doc_id, cls, fp, *extra): cls names the shingle set, fp is its wide fingerprint, null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                names, sizes, prints = [], [], np.empty((b.num_rows, WIDE), np.uint64)
                for i, x in enumerate(b.column(1)):
                    s = shingles(x.as_py(), words)
                    names.append(_name(s))
                    sizes.append(len(s))
                    if len(s):
                        prints[i] = wide_fingerprint(s)
                fp = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * WIDE), pa.array(prints.view(np.int64).ravel()), mask=pa.array(np.array(sizes) == 0))
                own = [b.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), fp]
                yield pa.RecordBatch.from_arrays([*own, *(b.column(i) for i in range(2, b.num_columns))], names=["doc_id", "cls", "size", "fp", *extra])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra)
    return rows.mapInArrow(run, "doc_id long, cls long, size long, fp array<long>" + "".join(f", {x} long" for x in extra))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(cls, grams) of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0):
                sets = [shingles(x.as_py(), words) for x in b.column(0)]
                grams = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), grams], names=["cls", "grams"])

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "cls long, grams array<long>")


def linked(sets: dict[int, np.ndarray], a: list[int], b: list[int], similarity: float, parent: dict[int, int] | None = None) -> tuple[list[int], list[int]]:
    """Those of the pairs (a, b) whose sets are that similar, without those that other links connect, or parent does, which they are added to."""
    parent = {} if parent is None else parent

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    src, dst = [], []
    for x, y in zip(a, b, strict=True):
        i, j = root(x), root(y)
        if i != j:
            s, t = sets[x], sets[y]
            if len(s) > len(t):
                s, t = t, s
            at = np.searchsorted(t, s)
            both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
            if both >= similarity * (len(s) + len(t) - both):
                parent[i] = j
                src.append(x)
                dst.append(y)
    return src, dst


Plan = list[tuple[int, int, int]]
FOUND = "a long, b long, na long, nb long, apart int, p int, v long, s long"


def _near(fp: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, most: float, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that their fingerprints and sizes allow, and how many bits they are apart."""
    out = [(i[:0], i[:0], np.empty(0, np.int64))]
    for at in range(0, len(i), PAIRS):
        x, y = i[at : at + PAIRS], j[at : at + PAIRS]
        apart = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64)
        ok = (apart <= most) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]))
        out.append((x[ok], y[ok], apart[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _owned(plan: Plan, p: np.ndarray, v: np.ndarray, fp: np.ndarray, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) whose first shared bucket is the one (p, v) in which they have met."""
    own = [np.empty(0, bool)]
    for at in range(0, len(i), PAIRS):
        x, y = i[at : at + PAIRS], j[at : at + PAIRS]
        q, w = first_shared(plan, fp[x], fp[y])
        own.append((q == p[x]) & (w == v[x]))
    ok = np.concatenate(own)
    return i[ok], j[ok], apart[ok]


def thin(n: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of n sets to verify first: a forest that connects all that they connect, and each set's nearest."""
    at = np.full((n, n), -1, np.int32)
    at[i, j] = at[j, i] = np.arange(len(i))
    out, left = [], np.ones(n, bool)
    for start in range(n):
        if not left[start]:
            continue
        left[start], todo = False, [start]
        while todo:
            k = todo.pop()
            got = np.flatnonzero(left & (at[k] >= 0))
            left[got] = False
            out.append(at[k, got])
            todo += got.tolist()
    order = np.argsort(-apart, kind="stable")  # the last written is the nearest
    nearest = np.full(n, -1, np.int64)
    nearest[i[order]] = order
    best = np.full(n, -1, np.int64)
    best[j[order]] = order
    return np.unique(np.concatenate([*out, nearest[nearest >= 0], best[best >= 0]]).astype(np.int64))


def _whole(batches: Iterator[pa.RecordBatch], keys: int, long: int | None = None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Sorted rows in runs in which no group of the first columns is cut, as arrays; a group of over long rows comes in pieces (True: more of it follows) that share rows."""
    held, new, n = [], [], 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*([held] if held else []), *new, strict=True)]

    for b in batches:
        if b.num_rows:
            new.append([c.flatten().to_numpy().reshape(-1, WIDE).view(np.uint64) if pa.types.is_list(c.type) else c.to_numpy() for c in b.columns])
            n += b.num_rows
        if n >= ROWS:
            held, new, n = joined(), [], 0
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:keys]], axis=0))
            if len(cut):
                yield [c[: cut[-1] + 1] for c in held], False
                held = [c[cut[-1] + 1 :] for c in held]
            if long and len(held[0]) > long:
                yield held, True
                held = [c[-shared() :] for c in held]
    if held or new:
        yield joined(), False


def shared() -> int:
    """Rows that two blocks of a bucket have in common, so that a forest goes on from one to the next."""
    return max(1, min(64, BLOCK // 2))


def _probed(classes: DataFrame, plan: Plan, some: range) -> DataFrame:
    """(p, v, cls, size, fp): the classes in each bucket that they probe in those partitions. The values are a column of their own, so that the rows of all passes are counted under one name."""
    return classes.select("cls", "size", "fp", wide_probes(plan, some).alias("probes")).select("cls", "size", "fp", F.explode("probes").alias("x")).select("x.p", "x.v", "cls", "size", "fp")


def _candidates(rows: DataFrame, plan: Plan, most: float, similarity: float) -> DataFrame:
    """rows (p, v, cls, size, fp) as FOUND: candidate pairs, each in the first bucket its sets share; and p, v, s: buckets of s rows that gave only a forest of theirs."""
    small, paired, block, over = SMALL, PAIRED, BLOCK, shared()

    def forest(fp: np.ndarray, size: np.ndarray, a: int, b: int) -> tuple[np.ndarray, ...]:
        i, j = np.nonzero(np.triu(np.bitwise_count(fp[a:b, :1] ^ fp[None, a:b, 0]) <= FAR, 1))
        return _near(fp, size, a + i, a + j, most, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0  # rows of the first bucket that came in earlier pieces
        for (p, v, cls, size, fp), more in _whole(batches, 2, WIDER * block):
            cut = np.flatnonzero((p[1:] != p[:-1]) | (v[1:] != v[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(p)]))
            end = np.repeat(np.where(ends - starts <= small, ends, 0), ends - starts)
            if before:
                end[: ends[0]] = 0
            f, lag, on, pairs = np.ascontiguousarray(fp[:, 0]), 1, np.arange(len(p)), []
            on = on[on + 1 < end]
            while len(on):
                got = on[np.bitwise_count(f[on] ^ f[on + lag]) <= FAR]
                pairs.append((got, got + lag))
                lag += 1
                on = on[on + lag < end[on]]
            found, hot = [], []
            own = lambda x: _owned(plan, p, v, fp, *x)  # noqa: E731, B023
            if pairs:
                found.append(own(_near(fp, size, *(np.concatenate(x) for x in zip(*pairs, strict=True)), most, similarity)))
            for k in np.flatnonzero((ends - starts > small) | ((starts == 0) & (before > 0))):
                a, b = int(starts[k]), int(ends[k])
                if b - a <= block and not (more or (before and a == 0)):
                    near = forest(fp, size, a, b)
                    i, j, apart = own(near)
                    if len(near[0]) <= paired * (b - a):
                        found.append((i, j, apart))
                    else:
                        keep = thin(b - a, i - a, j - a, apart)
                        found.append((i[keep], j[keep], apart[keep]))
                        if len(keep) < len(i):
                            hot.append((p[a], v[a], b - a))
                else:
                    for s in range(a, max(b - over, a + 1), max(1, block - over)):
                        i, j, apart = own(forest(fp, size, s, min(b, s + block)))
                        keep = thin(min(b, s + block) - s, i - s, j - s, apart)
                        found.append((i[keep], j[keep], apart[keep]))
                    n = b - a + (before if a == 0 else 0)
                    if not more:
                        hot.append((p[a], v[a], n))
            before = before + len(p) - over if more else 0
            for i, j, apart in found:
                for at in range(0, len(i), PAIRS):
                    yield _told(cls, size, i[at : at + PAIRS], j[at : at + PAIRS], apart[at : at + PAIRS])
            if hot:
                hp, hv, hs = (np.array(x) for x in zip(*hot, strict=True))
                none = lambda t: pa.nulls(len(hot), t)
                yield pa.RecordBatch.from_arrays([*(none(pa.int64()) for _ in range(4)), none(pa.int32()), pa.array(hp, pa.int32()), pa.array(hv, pa.int64()), pa.array(hs, pa.int64())], names=[x.split(" ")[0] for x in FOUND.split(", ")])

    return _dealt(rows, ["p", "v"], ["cls"]).mapInArrow(run, FOUND)


def _told(cls: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
    turned = cls[i] > cls[j]
    i, j = np.where(turned, j, i), np.where(turned, i, j)
    none = lambda t: pa.nulls(len(i), t)
    columns = [cls[i], cls[j], size[i], size[j]]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array(apart, pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.int64())], names=[x.split(" ")[0] for x in FOUND.split(", ")])


def _dealt(rows: DataFrame, by: list[str], then: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by).sortWithinPartitions(*by, *then)


def _slot(p: np.ndarray | int, v: np.ndarray, slots: int) -> np.ndarray:
    """A bucket's place in the table of hot ones."""
    with np.errstate(over="ignore"):
        return mix(v.view(np.uint64) ^ (np.asarray(p).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(slots)


def _hot_blocks(hot: DataFrame) -> np.ndarray:
    """For each of SLOTS places of buckets in how many blocks the largest hot bucket (p, v, s) there is cut, 0 without one."""
    most, slots = WIDER * BLOCK, SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, v, s = (c.to_numpy() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(_slot(p, v, slots).astype(np.int32)), pa.array(-(-s // most), pa.int32())], names=["slot", "blocks"])

    told = hot.select("p", "v", "s").mapInArrow(run, "slot int, blocks int").groupBy("slot").agg(F.max("blocks").alias("blocks")).toArrow()
    out = np.zeros(slots, np.int32)
    out[told.column(0).to_numpy()] = told.column(1).to_numpy()
    return out


def _runs(size: np.ndarray) -> np.ndarray:
    """The runs, by number, into which sets of those sizes are cut: of at most BLOCK sets and, but for a larger one, TOGETHER shingles."""
    return np.arange(len(size)) // BLOCK + np.cumsum(size) // TOGETHER


def _rest(hot: DataFrame, classes: DataFrame, plan: Plan, comps: DataFrame, texts: DataFrame, words: int, most: float, similarity: float) -> DataFrame:
    """(src, dst): links of the hot buckets (p, v, s) between what comps (node, component) leaves apart, enough to connect all that they link.

    A set meets its component once and is then dealt to its hot buckets. Those are told by a table
    of SLOTS places: another bucket in the place of a hot one gives its pairs a second time. In the
    first bucket they share, the fingerprints tell which sets have a candidate; these are cut into
    runs, and the runs meet two by two with their shingles, so that no row is made for a pair.
    """
    table = _hot_blocks(hot)
    labelled = classes.join(comps, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("label"), "size", "fp")
    names = ["p", "v", "low", "high", "b", "cls", "label", "size", "fp"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, label, size = (c.to_numpy() for c in batch.columns[:3])
            fp = batch.column(3).flatten().to_numpy().reshape(-1, WIDE).view(np.uint64)
            place = mix(cls.view(np.uint64) ^ np.uint64(1))
            for p, (word, mask, t) in enumerate(plan):
                own = fp[:, word] & np.uint64(mask)
                values = (own[:, None] ^ np.array(_flips(mask, t), np.uint64)).ravel()
                blocks = table[_slot(p, values, len(table))]
                at = np.flatnonzero(blocks)
                blocks = blocks[at]
                i, v = np.repeat(at // (len(values) // len(cls)), blocks), np.repeat(values[at], blocks).view(np.int64)
                o = np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                b = (place[i] % np.repeat(blocks, blocks).astype(np.uint64)).astype(np.int64)
                for x in range(0, len(i), ROWS // 4):
                    j, w = i[x : x + ROWS // 4], slice(x, x + ROWS // 4)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(j) + 1, dtype=np.int32) * WIDE), pa.array(fp[j].view(np.int64).ravel()))
                    ints = [pa.array(y, pa.int32()) for y in (np.full(len(j), p), np.minimum(b, o)[w], np.maximum(b, o)[w], b[w])]
                    yield pa.RecordBatch.from_arrays([ints[0], pa.array(v[w]), *ints[1:], *(pa.array(y[j], pa.int64()) for y in (cls, label, size)), flat], names=names)

    rows = labelled.mapInArrow(deal, "p int, v long, low int, high int, b int, cls long, label long, size long, fp array<long>")
    unit = ["p", "v", "low", "high", "x", "y"]

    def pairs(p: np.ndarray, v: np.ndarray, label: np.ndarray, size: np.ndarray, fp: np.ndarray, left: np.ndarray, right: np.ndarray, one: bool) -> Iterator[tuple[np.ndarray, ...]]:
        f = np.ascontiguousarray(fp[:, 0])
        for at in range(0, len(left), 64):
            i = left[at : at + 64]
            near = (np.bitwise_count(f[i][:, None] ^ f[right][None, :]) <= FAR) & (label[i][:, None] != label[right][None, :])
            if one:
                near &= i[:, None] < right[None, :]
            c, d = np.nonzero(near)
            yield _owned(plan, p, v, fp, *_near(fp, size, i[c], right[d], most, similarity))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (p, v, low, high, b, cls, label, size, fp), _ in _whole(batches, 4):
            cut = np.flatnonzero((p[1:] != p[:-1]) | (v[1:] != v[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            for x, y in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(p)])).tolist(), strict=True):
                if (label[x:y] == label[x]).all():
                    continue
                one = bool(low[x] == high[x])
                left, right = x + np.flatnonzero(b[x:y] == low[x]), x + np.flatnonzero(b[x:y] == high[x])
                run = np.zeros(y - x, np.int64)
                run[left - x] = _runs(size[left])
                if not one:
                    run[right - x] = _runs(size[right]) + (run[left - x].max(initial=0) + 1)
                got = np.empty((0, 3), np.int64)  # low run, high run, set
                for i, j, _ in pairs(p, v, label, size, fp, left, right, one):
                    both = np.stack((run[i - x], run[j - x]), axis=1)
                    got = np.unique(np.concatenate((got, np.column_stack((both, i)), np.column_stack((both, j)))), axis=0)
                for at in range(0, len(got), ROWS):
                    u, w, k = got[at : at + ROWS].T
                    ints = [pa.array(c, pa.int32()) for c in (low[k], high[k], u, w, run[k - x])]
                    yield pa.RecordBatch.from_arrays([pa.array(p[k], pa.int32()), pa.array(v[k]), *ints, pa.array(cls[k])], names=[*unit, "r", "cls"])

    met = materialize(_dealt(rows, ["p", "v", "low", "high"], ["cls"]).mapInArrow(meet, "p int, v long, low int, high int, x int, y int, r int, cls long"), "met")
    sets = _held(met.select(F.col("cls").alias("c")).distinct(), classes, texts, words)

    def compare(t: pa.Table) -> pa.Table:
        p, v, x, y, r, cls, label, size = (t.column(c).to_numpy() for c in ("p", "v", "x", "y", "r", "cls", "label", "size"))
        fp = t.column("fp").combine_chunks().flatten().to_numpy().reshape(-1, WIDE).view(np.uint64)
        own, parent = _by_name(t), dict(zip(cls.tolist(), label.tolist(), strict=True))
        src, dst = [], []
        for i, j, apart in pairs(p, v, label, size, fp, np.flatnonzero(r == x), np.flatnonzero(r == y), bool(x[0] == y[0])):
            order = np.argsort(apart, kind="stable")
            s, d = linked(own, cls[i[order]].tolist(), cls[j[order]].tolist(), similarity, parent)
            src += s
            dst += d
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    links = met.join(labelled, "cls").join(sets, "cls").groupBy(*unit).applyInArrow(compare, "src long, dst long")
    links = materialize(links, "links")
    forget(met, sets)
    return links


def components(named: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component): the components of linked sets (cls) of named (cls, size, fp, row_hash); texts has (row_hash, text).

    Fingerprints meet in passes of a few probes each, so that few copies of them are on disk at a
    time. Candidate pairs that are near by their whole fingerprints are verified on the sets, dealt
    by their smaller end: a set with its nearest candidate first, then the pairs whose ends stay
    apart. Of a bucket with very many candidates a forest is verified; when all that is done, so is
    every other pair of the bucket whose ends are in different components, where its sets meet;
    what these link are components, which are tied in turn.
    """
    spark = named.sparkSession
    classes = materialize(named.where("fp is not null").groupBy("cls").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.min("row_hash").alias("r")), "classes")
    plan = plan_wide(classes, similarity)
    give_back()
    bits = 64 * WIDE
    differ = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    most = bits * differ + 4.5 * (bits * differ * (1 - differ)) ** 0.5
    parts = []
    for some in passes(plan, PROBES):
        parts.append(materialize(_candidates(_probed(classes, plan, some), plan, most, similarity), "found"))
    found = parts[0]
    for x in parts[1:]:
        found = found.union(x)
    hot = materialize(found.where("s is not null").select("p", "v", "s"), "hot")
    pairs = materialize(found.where("s is null").select("a", "b", "na", "nb", "apart").dropDuplicates(["a", "b"]), "pairs")
    forget(*parts)

    collect(spark)
    comps = connected_components(_linked(pairs, classes, texts, words, similarity))
    collect(spark)
    if not hot.isEmpty():
        comps = _tied(comps, _rest(hot, classes, plan, comps, texts, words, most, similarity))
        collect(spark)
    forget(classes)
    return comps


def _tied(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, component) with those components tied together that the links (src, dst) connect."""
    if links.isEmpty():
        return comps
    named = lambda end, to: comps.select(F.col("node").alias(end), F.col("component").alias(to))
    ends = links.join(named("src", "x"), "src", "left").join(named("dst", "y"), "dst", "left").select("src", "dst", F.coalesce("x", "src").alias("x"), F.coalesce("y", "dst").alias("y"))
    ends = materialize(ends, "ends")
    above = connected_components(ends, "x", "y").select(F.col("node").alias("of"), F.col("component").alias("top"))
    alone = ends.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("x").alias("component")), F.struct(F.col("dst").alias("node"), F.col("y").alias("component")))).alias("e")).select("e.node", "e.component")
    every = comps.union(alone).distinct()  # a set that only these pairs link is in none of comps
    return materialize(every.join(above, F.col("component") == F.col("of"), "left").select("node", F.coalesce("top", "component").alias("component")), "components")


def _by_name(t: pa.Table) -> dict[int, np.ndarray]:
    """The sets of a table (cls, grams)."""
    grams = t.column("grams").combine_chunks()
    ends, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
    return {c: flat[x:y] for c, x, y in zip(t.column("cls").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}


def _held(ends: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(cls, grams): the sets of those names (c)."""
    held = classes.join(ends, F.col("cls") == F.col("c"), "left_semi").select("r")
    return materialize(_sets(texts.join(held, F.col("row_hash") == F.col("r"), "left_semi").dropDuplicates(["row_hash"]), words), "sets")


def _linked(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(src, dst): links among the candidate pairs, enough to connect all that they link."""
    sets = _held(pairs.select(F.col("a").alias("c")).distinct().union(pairs.select("b").distinct()).distinct(), classes, texts, words)
    nearest = pairs.groupBy("b").agg(F.min_by(F.struct("a", "na", "nb"), F.struct("apart", "a")).alias("p")).select("p.a", "b", "p.na", "p.nb")
    first = materialize(_verified(nearest, sets, similarity), "links")
    # these links are a forest that points to smaller names; ends that meet within a few steps of it need no link of their own
    up = first.select(F.col("dst").alias("node"), F.col("src").alias("to"))
    for _ in range(2):
        far = up.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        up = materialize(up.join(far, "to", "left").select("node", F.coalesce("beyond", "to").alias("to")), "up")
    group = lambda c, to: up.select(F.col("node").alias(c), F.col("to").alias(to))
    rest = pairs.join(nearest.select("a", "b"), ["a", "b"], "left_anti").join(group("a", "ga"), "a", "left").join(group("b", "gb"), "b", "left")
    rest = materialize(rest.where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b", "na", "nb"), "rest")
    links = first if rest.isEmpty() else first.union(materialize(_verified(rest, sets, similarity), "links"))
    forget(sets, up)
    return links


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): those of the pairs (a, b, na, nb) that are similar by their sets (cls, grams), dealt into groups of TOGETHER shingles."""
    n = 1 + int(pairs.agg(F.coalesce(F.sum(F.col("na") + F.col("nb")), F.lit(0))).first()[0]) // TOGETHER
    degree = pairs.groupBy("a").agg((F.count("*") / PARTNERS).cast("int").alias("more"))  # a set with very many partners is dealt out by them too
    share = F.pmod(F.xxhash64("b", F.lit(2)), F.col("more") + 1)
    dealt = materialize(pairs.join(degree, "a").select("a", "b", F.xxhash64(F.pmod(F.xxhash64("a", F.lit(3)), F.lit(n)), share).alias("g")), "dealt")
    ends = lambda c: dealt.select(F.col("g").alias("to"), F.col(c).alias("c")).distinct()
    needed = ends("a").union(ends("b")).distinct()
    sent = needed.join(sets, F.col("c") == F.col("cls")).select("to", "cls", "grams")

    def compare(p: pa.Table, t: pa.Table) -> pa.Table:
        src, dst = linked(_by_name(t), p.column("a").to_pylist(), p.column("b").to_pylist(), similarity)
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return dealt.groupBy("g").cogroup(sent.groupBy("to")).applyInArrow(compare, "src long, dst long")


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without near copies: of each group the smallest doc_id's, once.

    Equal sets are one node; texts without a word are equal. A group whose doc_ids are all null
    keeps the row of smallest hash. Rows of one doc_id and text are one document, of which one row
    stays, whatever their other columns; those may have any names.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumns({"row_hash": F.xxhash64("doc_id", "text"), "text_hash": F.hash("text").cast("long")})
    named = materialize(_named(keyed, words, ("row_hash", "text_hash")), "named")
    comps = components(named, keyed, words, similarity)
    groups = named.join(comps, F.col("cls") == F.col("node"), "left").withColumn("group", F.coalesce("component", "cls"))
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash", "text_hash")).alias("b"))
    best = best.select(F.col("b.row_hash").alias("r"), F.col("b.text_hash").alias("t")).distinct()
    left = keyed.join(best, (F.col("row_hash") == F.col("r")) & (F.col("text_hash") == F.col("t")), "left_semi")
    return left.dropDuplicates(["row_hash", "text_hash"]).select(*(F.col(f"row.`{c}`") for c in docs.columns))
