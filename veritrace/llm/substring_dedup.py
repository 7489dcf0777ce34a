"""Exact removal of repeated word windows, by super-k-mers.

Every window of K words has a minimiser, the smallest hash of its runs of m words. Consecutive windows
with one minimiser travel together as one packed string, to the bucket of that minimiser, so equal
windows meet. A bucket counts its windows exactly by sorting them, and tells which occurrences
are not the first.

What makes this hold for hot passages:

* Of strings that are equal within a chunk of documents only the first travels: all windows of the
  others are repeats. Equal strings of several chunks are neighbours in the sorted bucket, where only
  the first is kept.
* Runs that are the minimiser of many strings come last in the order of minimisers, so their windows
  are keyed by another run of theirs; what has none lies within a hot passage, where strings are equal.
* A bucket with over GROUP words in different strings is not counted but cut again by longer runs, at last by
  whole windows, of which equal ones are one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.chunks import Numbering
from veritrace.llm.hashing import mix
from veritrace.llm.slices import slices
from veritrace.storage import materialize

K = 20
#: Words of a minimiser: at first, then for buckets that are too large; the last are whole windows.
RUNS = (4, 11, K)
#: Most words of the different strings of one minimiser that are counted together.
GROUP = 600_000
#: Words of a chunk of documents (one document may exceed them), and of the strings of several minimisers counted at once.
CHUNK, COUNTED = 1_000_000, 600_000
#: Most windows of a string.
LONGEST = 1_000
#: A minimiser of one in so many strings of a chunk is told to the driver, which keeps those of one in so many of all: at most HOT / 2 of them.
HOT = 20_000
#: Words with a two-byte code: the commonest, of at most so many bytes. They make strings short and decide nothing else.
CODES, CODED_BYTES = 65_535, 64
#: Uses in a chunk that make a word a candidate for a code.
OFTEN = 4
#: A longer word is packed as its SHA-256.
LONG_WORD = 200
LARGEST = (1 << 63) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PACKED = "key int, blob binary, doc long, th int, start int, len int"
TAIL = 16


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def run_hashes(h: np.ndarray, m: int) -> np.ndarray:
    """A hash of every m consecutive hashes."""
    out = np.full(max(len(h) - m + 1, 0), m, np.uint64)
    for i in range(m):
        out = mix(out) + h[i : i + len(out)]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x, done = np.minimum(x[:-step], x[step:]), done + step
    return x


def minimisers(h: np.ndarray, m: int, hot: np.ndarray) -> np.ndarray:
    """The minimiser of every window of K; runs in hot (sorted, of 63 bits) are larger than all others."""
    if len(h) < K:
        return np.empty(0, np.uint64)
    x = run_hashes(h, m) >> np.uint64(1)
    if len(hot):
        held = hot[np.minimum(np.searchsorted(hot, x), len(hot) - 1)] == x
        x |= held.astype(np.uint64) << np.uint64(63)
    return sliding_min(x, K - m + 1)


def prefix_sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums whose differences, times a power each, are hashes of substrings."""
    n = len(h)
    power, back = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, b, np.uint64)))) for b in (ODD, INVERSE))
    return np.concatenate(([np.uint64(0)], np.cumsum(h * power[:n], dtype=np.uint64))), back


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def super_runs(mins: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of the longest runs with one minimiser in one owner, in pieces of at most LONGEST.

    owner is by word; a window whose words have several owners is none.
    """
    at = np.flatnonzero(owner[: len(mins)] == owner[K - 1 :]) if len(mins) else np.empty(0, np.int64)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (mins[at[1:]] != mins[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(inside % LONGEST == 0)
    return at[first], np.diff(np.append(first, len(at)))


def ordinal(doc: np.ndarray) -> np.ndarray:
    """Longs as unsigned numbers of the same order."""
    return doc.view(np.uint64) ^ np.uint64(1 << 63)


def _pack(keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray, literal: list[bytes], doc: np.ndarray, th: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """A packed string for each run of words: their number, the length of the words without a code, the codes, those words, and the place.

    keys, doc, th and start are by run; literal has the words of code 0 in order.
    """
    place = np.empty(len(starts), [("doc", ">u8"), ("start", ">u4"), ("th", ">i4")])
    place["doc"], place["start"], place["th"] = ordinal(doc), start, th
    place, coded = place.tobytes(), codes.astype("<u2").tobytes()
    upto = np.concatenate(([0], np.cumsum(codes == 0)))
    blobs = []
    for i, (a, n, la, lb) in enumerate(zip(starts.tolist(), sizes.tolist(), upto[starts].tolist(), upto[starts + sizes].tolist(), strict=True)):
        rest = b" ".join(literal[la:lb]) if lb > la else b""
        blobs.append(b"".join((n.to_bytes(2), len(rest).to_bytes(4), coded[2 * a : 2 * a + 2 * n], rest, place[TAIL * i : TAIL * i + TAIL])))
    none = pa.nulls(len(blobs), pa.int32())
    folded = (mix(keys) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(folded), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.int64()), none, none, none], names=NAMES)


NAMES = [x.split()[0] for x in PACKED.split(", ")]


def _intervals(doc: np.ndarray, th: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Words to remove, as rows that pass through the buckets unchanged."""
    key = (mix(doc.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(doc), pa.binary()), pa.array(doc), pa.array(th.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=NAMES)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct words, word numbers, document number by word, doc and th by document) of rows (doc, th, text)."""
    number = Numbering()
    ids, docs, ths, n = [], [], [], 0
    for whole in batches:
        for b in slices(whole, 2):
            for doc, th, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                w = words_of(text)
                if len(w) < K:
                    continue
                ids.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
                docs.append(doc)
                ths.append(th)
                n += len(w)
                if n >= CHUNK:
                    yield _chunk(number, ids, docs, ths)
                    number, ids, docs, ths, n = Numbering(), [], [], [], 0
    if ids:
        yield _chunk(number, ids, docs, ths)


def _chunk(number: Numbering, ids: list, docs: list, ths: list) -> tuple:
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    return list(number), np.concatenate(ids), owner, np.array(docs, np.int64), np.array(ths, np.int64)


def common(rows: DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """(hot, words): minimisers of many strings, and the commonest words; chunks tell what is common in them, so both lists are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, ids, owner, _, _ in _chunks(batches):
            n = np.bincount(ids, minlength=len(words))
            some = [i for i in np.flatnonzero(n >= OFTEN).tolist() if len(words[i]) <= CODED_BYTES]
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in some], pa.binary()), pa.nulls(len(some), pa.int64()), pa.array(n[some])], names=["word", "run", "n"])
            mins = minimisers(hashed(words)[ids], RUNS[0], np.empty(0, np.uint64))
            first, _ = super_runs(mins, owner)
            kinds, n = np.unique(mins[first], return_counts=True)
            often = (n >= OFTEN) & (n * HOT >= len(first))
            kinds, n = np.append(kinds[often].view(np.int64), -1), np.append(n[often], len(first))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(kinds), pa.binary()), pa.array(kinds), pa.array(n)], names=["word", "run", "n"])

    told = materialize(rows.mapInArrow(run, "word binary, run long, n long").groupBy("word", "run").agg(F.sum("n").alias("n")), "common")
    total = told.where("run = -1").first()
    words = told.where("word is not null").orderBy(F.col("n").desc(), "word").limit(CODES).select("word").toArrow().column(0).to_pylist()
    hot = told.where("run >= 0").where(F.col("n") * HOT >= (total["n"] if total else 0) * 2).orderBy(F.col("n").desc()).limit(HOT).select("run").toArrow().column(0).to_numpy()
    return np.sort(hot.astype(np.uint64)), words


def _cut(rows: DataFrame, hot: np.ndarray, known: list[bytes]) -> DataFrame:
    """Packed strings of the first occurrence in its chunk, and the words that the other occurrences lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of = {w: i for i, w in enumerate(known, 1)}
        for words, ids, owner, doc, th in _chunks(batches):
            h = hashed(words)[ids]
            mins = minimisers(h, RUNS[0], hot)
            first, windows = super_runs(mins, owner)
            size = windows + K - 1
            sums, back = prefix_sums(h)
            name = mix((sums[first + size] - sums[first]) * back[first] ^ mix(size.astype(np.uint64)))
            own = owner[first]
            start = first - np.flatnonzero(np.diff(owner, prepend=-1))[own]
            order = np.lexsort((th[own], start, doc[own], name))
            one = np.ones(len(order), bool)
            one[1:] = name[order[1:]] != name[order[:-1]]
            leader = np.empty(len(order), np.int64)
            leader[order] = order[np.maximum.accumulate(np.where(one, np.arange(len(order)), 0))]
            later = np.flatnonzero(leader != np.arange(len(order)))
            later = later[size[later] == size[leader[later]]]
            if len(later):  # equal names are checked by the words
                same = ids[spans(first[later], size[later])] == ids[spans(first[leader[later]], size[later])]
                later = later[np.logical_and.reduceat(same, np.cumsum(size[later]) - size[later])]
            lead = leader[later]
            twice = (doc[own[later]] == doc[own[lead]]) & (start[later] == start[lead]) & (th[own[later]] == th[own[lead]])  # a repeated row
            gone = later[~twice]
            if len(gone):
                yield _intervals(*_joined(own[gone], doc, th, start[gone], size[gone]))
            left = np.setdiff1d(np.arange(len(order)), later)
            codes = np.array([code_of.get(w, 0) for w in words], np.int64)
            lit = np.flatnonzero(codes[ids] == 0)
            literal = [w if len(w) <= LONG_WORD else b"\n" + hashlib.sha256(w).hexdigest().encode() for w in (words[i] for i in ids[lit].tolist())]
            yield _pack(mins[first[left]], first[left], size[left], codes[ids], literal, doc[own[left]], th[own[left]], start[left])

    return rows.mapInArrow(run, PACKED)


def _joined(own: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of documents (own), those that touch made one: doc, th, start and size."""
    order = np.lexsort((start, own))
    own, start, end = own[order], start[order], (start + size)[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (start[1:] > end[:-1])  # strings of one document end in the order they start
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    return doc[own[first]], th[own[first]], start[first], end[last] - start[first]


def parse(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(size, codes, literal, doc, th, start) of packed strings."""
    size = np.array([int.from_bytes(x[:2]) for x in blobs])
    codes = np.frombuffer(b"".join([x[6 : 6 + 2 * n] for x, n in zip(blobs, size.tolist(), strict=True)]), "<u2").astype(np.int64)
    literal = [w for x, n in zip(blobs, size.tolist(), strict=True) if len(x) > 6 + TAIL + 2 * n for w in x[6 + 2 * n : -TAIL].split(b" ")]
    place = np.frombuffer(b"".join([x[-TAIL:] for x in blobs]), [("doc", ">u8"), ("start", ">u4"), ("th", ">i4")])
    return size, codes, literal, ordinal(place["doc"].astype(np.uint64)).view(np.int64), place["th"].astype(np.int64), place["start"].astype(np.int64)


def count(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The words of windows that are not the first of their kind among packed strings."""
    size, codes, literal, doc, th, start = parse(blobs)
    if literal:
        codes[codes == 0] = CODES + 1 + np.fromiter(map(Numbering().__getitem__, literal), np.int64, len(literal))
    windows = size - (K - 1)
    row = np.repeat(np.arange(len(size)), windows)
    at = spans(np.cumsum(size) - size, windows)
    sums, back = prefix_sums(mix(codes.astype(np.uint64) + ODD))
    name = (sums[at + K] - sums[at]) * back[at]
    order = np.argsort(name)
    twice = name[order][1:] == name[order][:-1]
    some = order[np.append(twice, False) | np.insert(twice, 0, False)] if len(order) else order
    if not len(some):
        return
    place = start[row[some]] + spans(np.zeros(len(size), np.int64), windows)[some]
    d, t, name = doc[row[some]], th[row[some]], name[some]
    order = np.lexsort((t, place, d, name))
    some, place, d, t, name = (x[order] for x in (some, place, d, t, name))
    new = np.ones(len(some), bool)
    new[1:] = name[1:] != name[:-1]
    for k in range(0, len(some), 200_000):  # equal names are checked by the words
        x = np.arange(max(k, 1), min(k + 200_000, len(some)))
        x = x[~new[x]]
        if len(x) and (codes[at[some[x]][:, None] + np.arange(K)] != codes[at[some[x - 1]][:, None] + np.arange(K)]).any():
            name = np.unique(codes[at[some][:, None] + np.arange(K)], axis=0, return_inverse=True)[1].ravel()
            order = np.lexsort((t, place, d, name))
            some, place, d, t, name = (y[order] for y in (some, place, d, t, name))
            new[1:] = name[1:] != name[:-1]
            break
    lead = np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))
    gone = (d != d[lead]) | (place != place[lead])
    flags = np.zeros(len(row), bool)
    flags[some[gone]] = True
    edge = np.ones(len(row), bool)
    edge[1:] = (row[1:] != row[:-1]) | (flags[1:] != flags[:-1])
    first = np.flatnonzero(edge)
    n = np.diff(np.append(first, len(row)))[flags[first]]
    first = first[flags[first]]
    begin = (at - np.repeat(np.cumsum(size) - size, windows))[first]
    r = row[first]
    yield _intervals(doc[r], th[r], start[r] + begin, n + K - 1)


def _bucketed(rows: DataFrame, most: float) -> DataFrame:
    """Count the strings of every bucket; what is in those of over most words comes back as strings, for the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []  # strings of whole buckets, then from group on those of this one
        later: list[bytes] = []
        key, last, group, words, own, large = None, b"", 0, 0, 0, False

        def again() -> pa.RecordBatch:
            n = len(held) - group
            none = pa.nulls(n, pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int32()), pa.array(held[group:], pa.binary()), pa.nulls(n, pa.int64()), none, none, none], names=NAMES)
            del held[group:]
            return out

        def repeats() -> pa.RecordBatch:
            size, _, _, doc, th, start = parse(later)
            later.clear()
            return _intervals(doc, th, start, size)

        for b in batches:
            passing = pc.is_null(b.column(1))
            if pc.any(passing).as_py():
                yield b.filter(passing)
                b = b.filter(pc.invert(passing))
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    if large:
                        yield again()
                    else:
                        words += own
                    if words >= COUNTED:
                        yield from count(held)
                        held.clear()
                        words = 0
                    key, last, group, own, large = k, b"", len(held), 0, False
                if x[:-TAIL] == last[:-TAIL]:  # the same string, later unless it is a repeated row's
                    if x[-TAIL:-4] != last[-TAIL:-4]:
                        later.append(x)
                        if len(later) >= 10_000:
                            yield repeats()
                    continue
                last = x
                held.append(x)
                own += int.from_bytes(x[:2])
                large = large or own > most
                if large and own > most:
                    yield again()
                    own = 0
        if large:
            yield again()
        if later:
            yield repeats()
        if held:
            yield from count(held)

    return rows.repartition("key").sortWithinPartitions("key", "blob").mapInArrow(run, PACKED)


def _cut_again(rows: DataFrame, m: int, known: list[bytes]) -> DataFrame:
    """Strings of buckets that were too large, cut by minimisers of m words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_code = np.concatenate((np.zeros(1, np.uint64), hashed(known)))
        for whole in batches:
            for at in range(0, whole.num_rows, 5_000):
                b = whole.slice(at, 5_000)
                old = b.column(0).to_numpy().astype(np.int64).view(np.uint64)
                size, codes, literal, doc, th, start = parse(b.column(1).to_pylist())
                h = by_code[codes]
                h[codes == 0] = hashed(literal)
                owner = np.repeat(np.arange(len(size)), size)
                mins = minimisers(h, m, np.empty(0, np.uint64))
                first, windows = super_runs(mins, owner)
                own = owner[first]
                yield _pack(mix(mins[first]) ^ old[own], first, windows + K - 1, codes, literal, doc[own], th[own], start[own] + first - (np.cumsum(size) - size)[own])

    return rows.mapInArrow(run, PACKED)


def repeated(rows: DataFrame) -> DataFrame:
    """(doc, th, start, len): words covered by windows that start earlier too, of rows (doc, th, text); they may overlap."""
    hot, known = common(rows)
    told = materialize(_bucketed(_cut(rows, hot, known), GROUP), "windows")
    found = told.where("blob is null")
    for m in RUNS[1:]:
        large = told.where("blob is not null").select("key", "blob")
        if large.isEmpty():
            break
        # whole windows need no bound: the strings of a bucket are one window, repeated up to LONGEST times
        told = materialize(_bucketed(_cut_again(large, m, known), GROUP if m < K else float("inf")), "windows")
        found = found.union(told.where("blob is null"))
    return found.select("doc", "th", "start", "len")


def dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs (doc_id, text); with keep_text also the kept words as text.

    Each word goes that is covered by a window of K words whose sequence also starts earlier: in a
    smaller doc_id, or in the same document at an earlier place. A null or shorter text has no window
    and stays; a null doc_id comes after all others. Rows of one doc_id are one document: repeated
    rows lose the same words, and no row loses them to its own repetition; two texts of one doc_id
    are compared by the places of their words. Other columns are ignored; no rows give no rows.
    """
    th = F.hash("text").alias("th")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST)).alias("doc"), th, F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    gone = repeated(rows.select("doc", "th", "text"))
    gone = gone.groupBy(F.col("doc").alias("d"), F.col("th").alias("t")).agg(F.collect_set(F.struct("start", "len")).alias("gone"))
    whole = rows.join(gone, (F.col("doc") == F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc_id", "text", F.col("gone.start").alias("starts"), F.col("gone.len").alias("sizes"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for b in slices(whole_batch, 1):
                out: list[list] = [[], [], [], []]
                for text, starts, sizes in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    w, lost = words_of(text), 0
                    n = len(w)
                    if starts:
                        held = np.zeros(n + 1, np.int64)
                        np.add.at(held, starts, 1)
                        np.subtract.at(held, np.add(starts, sizes), 1)
                        w = [w[i] for i in np.flatnonzero(np.cumsum(held)[:n] == 0).tolist()]
                        lost = n - len(w)
                    kept = b" ".join(w)
                    for o, v in zip(out, (n, lost, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        o.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 3 + keep_text]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, t) for o, t in zip(out, kinds, strict=False))], names=[x.split()[0] for x in schema.split(", ")])

    return whole.mapInArrow(run, schema)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
i as (select doc_id, w, unnest(range(0, len(w) - {K - 1})) i from d),
g as (select doc_id, i, row_number() over (partition by w[i + 1 : i + {K}] order by doc_id, i) n from i),
c as (select distinct doc_id, unnest(range(i, i + {K})) k from g where n > 1),
u as (select doc_id, unnest(range(0, len(w))) k, unnest(w) x from d),
r as (select doc_id, count(c.k) n, string_agg(x, ' ' order by k) filter (c.k is null) kept from u left join c using (doc_id, k) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join r using (doc_id)
"""
