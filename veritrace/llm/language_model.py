"""LM scoring with a hierarchical Pitman-Yor model over words and letters.

Every preceding word has a restaurant whose customers are the words that follow it. A restaurant's
tables are customers of the parent that all of them share, the restaurant of words without context;
its tables are spelled in a model of letters, where restaurants of two preceding letters of the word
share those of one, and they the one of none, over a uniform choice of 257. So a word never seen
after another, or never seen at all, still has a probability. Seating is sampled by Gibbs sweeps: the
customers of a dish are seated anew by the Chinese-restaurant rule, given all other tables, dishes
of one sweep in parallel. Predictive probabilities are averaged over the kept sweeps.

Documents are coded in chunks of bounded size, whose word pairs and words travel as packed sorted
arrays. Pairs meet by hash in parts of bounded size, where they are counted over the corpus; the
first chunk that has a pair owns it. The words of all chunks meet likewise and hold the state of
their restaurants. In a sweep each chunk seats the pairs it owns, sends the words what their tables
changed, and gets their new probabilities back. A draw depends on the pair or word and the sweep
alone, so every chunk can repeat it, and batches, partitions and retries do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.chunks import Numbering
from veritrace.llm.hashing import mix, pack, unit, unpack
from veritrace.storage import Bucketed, materialize

#: Sweeps before and of the average, and sweeps of the letters within each.
BURN, KEPT, INNER = 1, 2, 4
SEED = 5
#: Strength of all restaurants, and the letters' discount; the words' discounts are estimated from their counts.
THETA, LETTER_DISCOUNT = 1.0, 0.6
#: Symbols: 256 bytes and the end of a word, which also stands before its start.
SYMBOLS, EDGE = 257, 256
#: Letters of the longest context. Its cells are at most SYMBOLS ** 3, 17 million, however large the corpus.
DEPTH = 2
#: The token at the end of a text, and the context of its first word: no word can hold it.
END = b"\n"
#: A chunk ends at so many tokens or distinct words (a text is never split); a block is a stored row of texts.
CHUNK_TOKENS, CHUNK_WORDS, BLOCK_TOKENS = 2_000_000, 400_000, 250_000
#: Characters of text for each part in which pairs, and words, meet: a part holds a few million of them.
PART_CHARS = 32_000_000
FOLD = "pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 10) = 0"


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; the end is not among them."""
    return (text or "").encode("utf-8", "replace").lower().split()


# seating

#: Up to so many customers of a dish the chance of each number of tables is exact; above it is approximated.
EXACT = 256
#: Up to so many tables they are drawn by inversion; above as a rounded normal.
FEW = 50


@cache
def _openings(d: float) -> np.ndarray:
    """[c, t]: in how many more ways, weighed by the discounted sizes of the tables, c customers sit at t + 1 tables than at t."""
    out = np.zeros((EXACT + 1, EXACT + 1))
    ways = np.full(EXACT + 2, -np.inf)
    ways[1] = 0.0
    t = np.arange(EXACT + 2)
    for c in range(1, EXACT + 1):
        out[c, 1:c] = np.exp(ways[2 : c + 1] - ways[1:c])
        with np.errstate(invalid="ignore", divide="ignore"):
            stay = ways + np.log(np.maximum(c - d * t, 0))
        ways = np.logaddexp(np.concatenate(([-np.inf], ways[:-1])), np.where(np.isfinite(ways), stay, -np.inf))
    return out


@cache
def _columns(d: float) -> np.ndarray:
    """_openings by tables, then customers."""
    return np.ascontiguousarray(_openings(d).T)


def _more(c: np.ndarray, t: np.ndarray | int, d: float) -> np.ndarray:
    """The entries of _openings for c and t, continued above EXACT."""
    kept = np.minimum(c, EXACT)
    out = _columns(d)[t][kept] if np.ndim(t) == 0 and t <= EXACT else _openings(d)[kept, np.minimum(t, EXACT)]
    big = np.flatnonzero(c > EXACT)
    if len(big):
        n = c[big].astype(np.float64)
        t = np.minimum(t if np.ndim(t) == 0 else t[big], n).astype(np.float64)
        # y solves t d (1 - y) y^(d - 1) = c (1 - y^d): the saddle point of the ways' generating function
        y = (t * d / n) ** (1 / (1 - d))
        far = np.flatnonzero((t * d > 0.05 * n) & (t < n))
        r, at = t[far] * d / n[far], y[far]
        on = np.arange(len(far))
        for _ in range(60):  # r (1 - y) + y - y^(1 - d) is convex and falls from this y to its root, so Newton's steps only go up
            low, part = at[on], r[on]
            power = low**-d
            step = (part * (1 - low) + low - low * power) / (part - 1 + (1 - d) * power)
            at[on] = low + step
            on = on[step > 1e-9]
            if not len(on):
                break
        y[far] = at
        out[big] = np.where(t < n, (1 - y**d) / (d * (t + t / n)), 0)
    return out


def seat(c: np.ndarray, weight: np.ndarray, slope: np.ndarray, d: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of c customers of each dish, drawn given all other dishes' by the Chinese-restaurant rule.

    Where t tables serve the dish a further one is opened at a weight of weight + slope * t, while a
    customer joins a table at its size less d. The chance of t tables is the sum over all seatings
    of c customers at t tables of the product of these weights. Draws are by hash of key and sweep.
    """
    t = (c > 0).astype(np.int64)
    at = np.flatnonzero(c > 1)
    with np.errstate(over="ignore"):
        salted = key[at] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * sweep + 1)
    c, w, s, u = c[at], weight[at], slope[at], unit(salted)
    grow = lambda i, k: (w[i] + s[i] * k) * _more(c[i], k, d)
    out = np.ones(len(at), np.int64)
    # each further table is less likely than the one before by a falling factor: where the first is below 1 - u the draw is one table
    first = (w + s) * _more(c, 1, d)
    open_ = np.flatnonzero(u >= 1 - first)
    many = first[open_] > 1e5
    rest = np.flatnonzero(~many & (c[open_] > FEW))
    many[rest] = grow(open_[rest], FEW) > 1

    few = open_[~many]
    total, chances = 1 + first[few], []
    x, k = np.flatnonzero(c[few] > 2), 2
    chance, held = first[few[x]], [v[few[x]] for v in (c, w, s)]
    while len(x):  # what is left of the dishes is kept side by side, and the chances for the draw below
        chance = chance * ((held[1] + held[2] * k) * _more(held[0], k, d))
        more = total[x] + chance
        total[x] = more
        chances.append((x, chance))
        stay = chance > 1e-9 * more
        x, chance, held, k = x[stay], chance[stay], [v[stay] for v in held], k + 1
    need = u[few] * total
    drawn = np.where(need > 1, 2, 1)
    below = 1 + first[few]
    open_few = (need > 1) & (below < need)
    last = first[few].copy()
    for k, (x, chance) in enumerate(chances, 2):
        mine = np.flatnonzero(open_few[x])
        if not len(mine):
            break
        x, chance = x[mine], chance[mine]
        below[x] += chance
        last[x] = chance
        drawn[x] += 1
        open_few[x] = (below[x] < need[x]) & (chance > 0)
    left = np.flatnonzero(open_few & (last > 0))  # draws in the billionth part that the sums above leave out
    while len(left):
        k = drawn[left]
        last[left] *= (w[few[left]] + s[few[left]] * k) * _more(c[few[left]], k, d)
        below[left] += last[left]
        drawn[left] += 1
        left = left[(below[left] < need[left]) & (last[left] > 0)]
    out[few] = drawn

    big = open_[many]
    if len(big):
        low, high = np.ones(len(big), np.int64), c[big].copy()  # the likeliest number is the first that grows no more
        while (low < high).any():
            mid = (low + high) // 2
            up = grow(big, mid) > 1
            low, high = np.where(up, mid + 1, low), np.where(up, high, mid)
        steep = np.log(np.maximum(grow(big, np.maximum(low - 1, 1)), 1e-300)) - np.log(np.maximum(grow(big, low), 1e-300))
        with np.errstate(over="ignore"):
            z = np.sqrt(-2 * np.log(u[big])) * np.cos(2 * np.pi * unit(salted[big] ^ np.uint64(0xD1B54A32D192ED03)))
        out[big] = np.clip(np.rint(low + z / np.sqrt(np.maximum(steep, 1e-12))), 1, c[big]).astype(np.int64)
    t[at] = out
    return t


def discount(one: int, two: int) -> float:
    """A restaurant level's discount, by how many of its dishes have one customer and two."""
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


# letters


class Letters:
    """The letter restaurants of contexts of DEPTH letters down to none, as sampled tables, and their predictive probabilities.

    A cell is a context and a letter, packed as a number whose low digit is the letter. As there are
    at most SYMBOLS ** (DEPTH + 1) cells, they are seated in one place and looked up in a full table.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, sweep: int):
        """keys, counts: customers of the deepest cells, sorted by key."""
        d, th = LETTER_DISCOUNT, THETA
        cells, up = [keys], []
        for k in range(DEPTH, 0, -1):  # the parent of a context lacks its first letter
            parent, back = np.unique(cells[-1] % np.int64(SYMBOLS**k), return_inverse=True)
            cells.append(parent)
            up.append(back)
        ctx = [np.unique(x // SYMBOLS, return_inverse=True) for x in cells]
        tables = [np.minimum(counts, 1)] + [np.ones(len(x), np.int64) for x in cells[1:]]
        for inner in range(INNER):
            c, p = self._counts(counts, tables, up), self._predict(counts, tables, cells, up, ctx)
            for k in range(DEPTH + 1):  # each dish is seated given the others' tables
                own = ctx[k][1]
                base = p[k + 1][up[k]] if k < DEPTH else np.full(len(cells[k]), 1 / SYMBOLS)
                held = np.bincount(own, tables[k], len(ctx[k][0]))[own] - tables[k]
                with np.errstate(over="ignore"):
                    key = mix(cells[k].astype(np.uint64) + np.uint64(k << 40))
                tables[k] = seat(c[k], (th + d * held) * base, d * base, d, key, (sweep << 4) + inner)
                if k < DEPTH:
                    c[k + 1] = np.bincount(up[k], tables[k], len(cells[k + 1])).astype(np.int64)
        p = self._predict(counts, tables, cells, up, ctx)
        c = self._counts(counts, tables, up)
        #: For each level: cells and their probabilities, contexts and what they leave to their parents.
        self.levels = []
        for k in range(DEPTH + 1):
            own, n = ctx[k][1], len(ctx[k][0])
            back = (th + d * np.bincount(own, tables[k], n)) / (np.bincount(own, c[k], n) + th)
            self.levels.append((cells[k], p[k], ctx[k][0], back))
        self._log = None

    @staticmethod
    def _counts(counts, tables, up) -> list[np.ndarray]:
        """Customers of the cells of each level: the tables of the cells below."""
        c = [counts]
        for k, back in enumerate(up):
            c.append(np.bincount(back, tables[k], len(tables[k + 1])).astype(np.int64))
        return c

    def _predict(self, counts, tables, cells, up, ctx) -> list[np.ndarray]:
        d, th = LETTER_DISCOUNT, THETA
        c, p = self._counts(counts, tables, up), [None] * (DEPTH + 1)
        for k in range(DEPTH, -1, -1):
            own, n = ctx[k][1], len(ctx[k][0])
            total, held = np.bincount(own, c[k], n) + th, np.bincount(own, tables[k], n)
            base = p[k + 1][up[k]] if k < DEPTH else 1 / SYMBOLS
            p[k] = (np.maximum(c[k] - d * tables[k], 0) + (th + d * held)[own] * base) / total[own]
        return p

    def __getstate__(self):
        return self.__dict__ | {"_log": None}

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """The log probability of the letter of each deepest cell, seen or not."""
        if self._log is None:
            p = np.full(1, 1 / SYMBOLS)
            for k in range(DEPTH, -1, -1):
                cells, seen, ctx, back = self.levels[k]
                left = np.ones(SYMBOLS ** (DEPTH - k))
                left[ctx] = back
                # a context's letters fall back on those of the context without its first letter
                p = (left.reshape(-1, len(p) // SYMBOLS if k < DEPTH else 1)[:, :, None] * p.reshape(1, -1, SYMBOLS if k < DEPTH else 1)).reshape(-1)
                p = np.repeat(p, SYMBOLS) if k == DEPTH else p
                p[cells] = seen
            self._log = np.log(p).astype(np.float32)
        return self._log[keys].astype(np.float64)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The deepest cells of all letters, words one after another, each with its end; where each word starts."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    s = np.frombuffer(b"\0".join([*words, b""]), np.uint8).astype(np.int64)
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    s[ends] = EDGE
    place = np.arange(len(s)) - np.repeat(starts, size)
    key = s.copy()
    for k in range(1, DEPTH + 1):
        before = np.full(len(s), EDGE, np.int64)
        before[k:] = s[:-k]
        before[place < k] = EDGE
        key += before * SYMBOLS**k
    return key, starts


def log_p0(words: list[bytes], letters: Letters) -> np.ndarray:
    """The letters' log probability of each word."""
    if not words:
        return np.zeros(0)
    key, starts = spelled(words)
    return np.add.reduceat(letters.log_p(key), starts)


# chunks of documents

#: Kinds of rows of the coded table: blocks of texts, slices of a chunk's words, slices of its pairs.
TEXTS, WORDS, PAIRS = 0, 1, 2
CODED = "kind int, chunk long, part int, ids array<long>, sizes array<int>, train array<boolean>, a binary, b binary"
#: Kinds of rows that chunks are told: pairs' counts, what they own, and the words' states after each sweep from 0 on.
COUNTS, OWN, STATES = 0, 1, 2


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_()), "double": pa.float64()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w, SEED) for w in words], np.uint64)


def _parts(high: np.ndarray, n: int) -> np.ndarray:
    """The part of each number by its upper 32 bits: parts are ranges of the hash."""
    return (high.astype(np.uint64) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _slices(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the runs of a sorted array of parts."""
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(part)])), strict=True):
        if b > a:
            yield int(part[a]), int(a), int(b)


def _pair_keys(h: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """56-bit keys of word pairs: two of so many pairs as a part holds share one hardly ever, and then are counted together."""
    with np.errstate(over="ignore"):
        return mix(h[before] * np.uint64(0x9E3779B97F4A7C15) + h[word]) >> np.uint64(8)


def _encode(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text, train) as rows CODED.

    The words of a chunk are numbered in order of their hash, so that those of a part are a slice.
    """

    def flush(chunk: int, number: Numbering, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        words = list(number)
        h = _hashes(words)
        order = np.argsort(h, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        h, words, end = h[order], [words[i] for i in order], rank[0]
        freq, keys = np.zeros(len(words), np.int64), []
        at = 0
        while at < len(held):
            some, n = [], 0
            while at < len(held) and (not some or n < BLOCK_TOKENS):
                some.append(held[at])
                n += len(held[at][2])
                at += 1
            seq = rank[np.concatenate([x for _, _, x in some])]
            size = np.array([len(x) for _, _, x in some])
            train = np.repeat(np.array([t for _, t, _ in some]), size)
            before = np.concatenate(([end], seq[:-1]))
            before[np.cumsum(size)[:-1]] = end
            freq += np.bincount(seq[train], minlength=len(words))
            keys.append(np.sort(_pair_keys(h, before, seq) << np.uint64(1) | train))
            yield _batch([(TEXTS, chunk, at, [d for d, _, _ in some], size.tolist(), [t for _, t, _ in some], pack(seq), None)], CODED)
        for p, a, b in _slices(_parts(h >> np.uint64(32), parts)):
            yield _batch([(WORDS, chunk, p, None, None, None, b" ".join(words[a:b]), pack(freq[a:b]))], CODED)
        keys = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.concatenate(([True], np.diff(keys >> np.uint64(1)) > 0)))
        n = np.add.reduceat((keys & np.uint64(1)).astype(np.int64), first)
        keys = keys[first] >> np.uint64(1)
        for p, a, b in _slices(_parts(keys >> np.uint64(24), parts)):
            yield _batch([(PAIRS, chunk, p, None, None, None, pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(n[a:b]))], CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n = TaskContext.get().partitionId() << 32, 0
        number, held = Numbering({END: 0}), []
        for b in batches:
            for doc_id, text, train in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                w = tokens(text)
                held.append((doc_id, train, np.fromiter(map(number.__getitem__, [*w, END]), np.uint32, len(w) + 1)))
                n += len(w) + 1
                if n >= CHUNK_TOKENS or len(number) >= CHUNK_WORDS:
                    yield from flush(chunk, number, held)
                    chunk, n, number, held = chunk + 1, 0, Numbering({END: 0}), []
        if held:
            yield from flush(chunk, number, held)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (~F.expr(FOLD)).alias("train"))
    return narrow.mapInArrow(run, CODED)


def _rows(t: pa.Table, *by: str) -> list[dict]:
    return t.sort_by([(x, "ascending") for x in by]).to_pylist() if t.num_rows else []


TOLD = "kind int, chunk long, part int, one long, two long, a binary, b binary, c binary, d binary"


def _count_pairs(t: pa.Table) -> pa.Table:
    """Of one part: each chunk's pairs' counts over the corpus, doubled, plus 1 where the chunk owns the pair."""
    rows = _rows(t, "chunk")
    keys = [np.cumsum(unpack(r["a"], np.uint64), dtype=np.uint64) for r in rows]
    size = [len(k) for k in keys]
    keys, n = np.concatenate(keys), np.concatenate([unpack(r["b"], np.int64) for r in rows])
    order = np.argsort(keys, kind="stable")
    new = np.concatenate(([True], np.diff(keys[order]) > 0))
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    total = np.add.reduceat(n[order], first)
    value = np.empty(len(keys), np.int64)
    value[order] = 2 * total[group]
    taught = np.flatnonzero(n[order] > 0)
    _, owner = np.unique(group[taught], return_index=True)
    value[order[taught[owner]]] += 1
    out = [(COUNTS, r["chunk"], r["part"], None, None, pack(v), None, None, None) for r, v in zip(rows, np.split(value, np.cumsum(size)[:-1]), strict=True)]
    return pa.Table.from_batches([_batch(out, TOLD)])


class Chunk:
    """A chunk's texts and pairs, from its coded rows."""

    def __init__(self, t: pa.Table):
        rows = _rows(t, "kind", "part")
        slices, self.blocks = [r for r in rows if r["kind"] == WORDS], [r for r in rows if r["kind"] == TEXTS]
        words = [r["a"].split(b" ") for r in slices]
        self.id, self.slices = rows[0]["chunk"], [(r["part"], len(w)) for r, w in zip(slices, words, strict=True)]
        words = [w for x in words for w in x]
        self.h, end = _hashes(words), words.index(END)
        self.seq = np.concatenate([unpack(r["a"], np.uint32) for r in self.blocks])
        self.size = np.array([n for r in self.blocks for n in r["sizes"]])
        before = np.concatenate(([end], self.seq[:-1]))
        before[np.cumsum(self.size)[:-1]] = end
        keys = _pair_keys(self.h, before, self.seq)
        order = np.argsort(keys)
        new = np.concatenate(([True], np.diff(keys[order]) > 0))
        self.pair = np.empty(len(keys), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        first = order[new]
        self.keys, self.before, self.word = keys[first], before[first].astype(np.int64), self.seq[first].astype(np.int64)


def _own(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one chunk: the pairs it owns with two or more customers, and for each part of its words in how many pairs they stand first and second."""
    c = Chunk(left)
    value = np.concatenate([unpack(r["a"], np.int64) for r in _rows(right, "part")])
    count, own = value >> 1, value & 1 > 0
    more = own & (count > 1)
    first, second = (np.bincount(x[own], minlength=len(c.h)) for x in (c.before, c.word))
    one, two = int((count[own] == 1).sum()), int((count[own] == 2).sum())
    out = [(OWN, c.id, -1, one, two, pack(np.diff(c.keys[more], prepend=np.uint64(0))), pack(c.before[more].astype(np.uint32)), pack(c.word[more].astype(np.uint32)), pack(count[more]))]
    at = 0
    for part, n in c.slices:
        out.append((OWN, c.id, part, 0, 0, pack(first[at : at + n]), pack(second[at : at + n]), None, None))
        at += n
    return pa.Table.from_batches([_batch(out, TOLD)])


# the words' restaurants

#: A part's words (chunk -1): words, c, types as context, types as word, tables as context, customers, tables; a row for each chunk: its words' places.
WORDED = "part int, chunk long, words long, total long, customers long, tables long, one long, two long, cells array<long>, counts array<long>, a binary, b binary, c binary, d binary, e binary, f binary, g binary"


def _state(part: int, words: list[bytes], joined: bytes, arrays: list[np.ndarray], index: list[tuple[int, bytes]]) -> pa.Table:
    """Rows WORDED of a part; cells are the letters of its tables."""
    c, _, _, _, customers, tables = arrays
    key, starts = spelled(words)
    cells, back = np.unique(key, return_inverse=True)
    counts = np.bincount(back, np.repeat(tables, np.diff(np.append(starts, len(key)))), len(cells)).astype(np.int64)
    some = counts > 0
    told = [int((c > 0).sum()), int(c.sum()), int(customers.sum()), int(tables.sum()), int((customers == 1).sum()), int((customers == 2).sum()), cells[some].tolist(), counts[some].tolist()]
    out = [(part, -1, *told, joined, *map(pack, arrays))] + [(part, chunk, *[None] * 8, x, *[None] * 6) for chunk, x in index]
    return pa.Table.from_batches([_batch(out, WORDED)])


def _first_state(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one part: its distinct words, with a table for every pair and a table of the word itself."""
    rows = _rows(left, "chunk")
    split = [r["a"].split(b" ") for r in rows]
    coded = pa.array([w for x in split for w in x], pa.binary()).dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    add = lambda x: np.bincount(at, np.concatenate(x), len(words)).astype(np.int64)
    told = {r["chunk"]: r for r in _rows(right, "chunk")}
    c = add([unpack(r["b"], np.int64) for r in rows])
    first, second = (add([unpack(told[r["chunk"]][x], np.int64) for r in rows]) for x in ("a", "b"))
    index = [(r["chunk"], pack(x.astype(np.uint32))) for r, x in zip(rows, np.split(at, np.cumsum([len(x) for x in split])[:-1]), strict=True)]
    return _state(rows[0]["part"], words, b" ".join(words), [c, first, second, first, second, (second > 0).astype(np.int64)], index)


def _held(rows: list[dict]) -> tuple[dict, list[bytes], list[np.ndarray], list[tuple[int, bytes]]]:
    own = rows[0]
    return own, own["a"].split(b" "), [unpack(own[x], np.int64) for x in "bcdefg"], [(r["chunk"], r["a"]) for r in rows[1:]]


def _reseat_words(told: tuple, sweep: int):
    """Of one part: the words' customers and tables after a sweep, given the chunks' changes and the tables and letters before it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables, d, letters = told
        own, words, (c, first, second, _, _, before), index = _held(_rows(left, "chunk"))
        at = dict(index)
        as_context, customers = first.copy(), second.copy()
        for r in _rows(right, "chunk"):
            place = unpack(at[r["chunk"]], np.uint32)[unpack(r["a"], np.uint32)]
            as_context += np.bincount(place, unpack(r["b"], np.int64), len(words)).astype(np.int64)
            customers += np.bincount(place, unpack(r["c"], np.int64), len(words)).astype(np.int64)
        p = np.exp(log_p0(words, letters))
        now = seat(customers, (THETA + d * (tables - before)) * p, d * p, d, _hashes(words), sweep)
        return _state(own["part"], words, own["a"], [c, first, second, as_context, customers, now], index)

    return run


def _tell(told: tuple, sweep: int):
    """To every chunk: its words' counts, tables as context and log probabilities without context."""

    def run(t: pa.Table) -> pa.Table:
        customers, tables, d, letters = told
        own, words, (c, _, _, as_context, n, k), index = _held(_rows(t, "chunk"))
        with np.errstate(divide="ignore"):
            log_p = np.logaddexp(np.log(np.maximum(n - d * k, 0)), math.log(THETA + d * tables) + log_p0(words, letters)) - math.log(customers + THETA)
        out = []
        for chunk, x in index:
            x = unpack(x, np.uint32)
            out.append((STATES + sweep, chunk, own["part"], None, None, pack(c[x]), pack(as_context[x]), pack(log_p[x].astype(np.float32)), None))
        return pa.Table.from_batches([_batch(out, TOLD)])

    return run


def _states(rows: list[dict]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(counts, tables as context, log probabilities) of a chunk's words after each sweep told."""
    out = []
    for kind in sorted({r["kind"] for r in rows if r["kind"] >= STATES}):
        own = [r for r in rows if r["kind"] == kind]
        out.append(tuple(np.concatenate([unpack(r[x], t) for r in own]) for x, t in (("a", np.int64), ("b", np.int64), ("c", np.float32))))
    return out


def _seat_pairs(count, before, word, keys, states, d: float) -> Iterator[np.ndarray]:
    """Tables of pairs after each sweep from 0 on: one each at first, then given the words' states of the sweep before."""
    t = (count > 0).astype(np.int64)
    more = np.flatnonzero(count > 1)  # one customer sits at one table
    count, before, word, keys = count[more], before[more], word[more], keys[more]
    for sweep, (_, tables, log_p) in enumerate(states, 1):
        yield t
        p = np.exp(log_p.astype(np.float64))[word]
        t = t.copy()
        t[more] = seat(count, (THETA + d * (tables[before] - t[more])) * p, d * p, d, keys, sweep)
    yield t


def _reseat_pairs(d: float):
    """Of one chunk: what the tables of the pairs it owns add to its words, as contexts and as customers, part by part."""

    def run(t: pa.Table) -> pa.Table:
        rows = _rows(t, "kind", "part")
        own = next(r for r in rows if r["kind"] == OWN and r["part"] < 0)
        keys, count = np.cumsum(unpack(own["a"], np.uint64), dtype=np.uint64), unpack(own["d"], np.int64)
        before, word = (unpack(own[x], np.uint32).astype(np.int64) for x in "bc")
        states = _states(rows)
        *_, tables = _seat_pairs(count, before, word, keys, states, d)
        n = len(states[0][0])
        as_context, as_word = (np.bincount(x, tables - 1, n).astype(np.int64) for x in (before, word))
        out, at = [], 0
        for r in rows:
            if r["kind"] == STATES:
                size = len(unpack(r["a"], np.int64))
                some = np.flatnonzero(as_context[at : at + size] + as_word[at : at + size])
                if len(some):
                    out.append((OWN, own["chunk"], r["part"], None, None, pack(some.astype(np.uint32)), pack(as_context[at + some]), pack(as_word[at + some]), None))
                at += size
        return pa.Table.from_batches([_batch(out, TOLD)])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(total: int, seen: int, d: float):
    """Of one chunk: its documents' scores."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left)
        rows = _rows(right, "kind", "part")
        count = np.concatenate([unpack(r["a"], np.int64) for r in rows if r["kind"] == COUNTS]) >> 1
        states = _states(rows)
        known = states[0][0]
        log_p = None
        seated = zip(_seat_pairs(count, c.before, c.word, c.keys, states[:-1], d), states, strict=True)
        for sweep, (t, (_, tables, below)) in enumerate(seated):
            if sweep > BURN:
                # the part of the shared words first, in logarithms: long unseen words are far below the least float
                low = np.log(THETA + d * tables)[c.before] + below[c.word]
                own = np.flatnonzero(count)
                low[own] = np.log(count[own] - d * t[own] + np.exp(low[own]))
                log_p = low if log_p is None else np.logaddexp(log_p, low)
        log_p = (log_p - np.log(KEPT * (known + THETA))[c.before]) / math.log(10)
        starts = np.cumsum(c.size) - c.size
        base = np.log10((known + 0.1) / (total + 0.1 * (seen + 1)))
        added = [np.add.reduceat(x, starts) for x in ((known > 0)[c.seq].astype(np.int64), base[c.seq], log_p[c.pair])]
        ids, train = ([x for r in c.blocks for x in r[k]] for k in ("ids", "train"))
        cols = [pa.array(ids, pa.int64()), pa.array([not x for x in train]), pa.array(c.size, pa.int64()), pa.array(added[0]), pa.array(np.full(len(ids), total)), pa.array(added[1]), pa.array(added[2])]
        return pa.table(cols, names=[x.split(" ")[0] for x in SCORES.split(", ")])

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """Base and model scores for every row of docs (doc_id, text).

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): logarithms to base 10 of
    the whole text's probability. Rows of the held-out fold teach nothing. A null text is as an
    empty one: its end alone is a token. Without training rows all restaurants are empty and the
    letters uniform. Repeated rows and null doc_ids keep their rows and count as they come; other
    columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    parts = 1 + chars // PART_CHARS
    n = max(4 * parts, int(spark.conf.get("spark.sql.shuffle.partitions")))  # more buckets than chunks, so that few share one
    coded = Bucketed(spark, "coded", n, "chunk", "kind").add(_encode(docs, parts))
    told = Bucketed(spark, "told", n, "chunk", "kind")
    rows = coded.read()
    told.add(rows.where(F.col("kind") == PAIRS).groupBy("part").applyInArrow(_count_pairs, TOLD).repartition(n, "chunk"))
    coded.forget(PAIRS)
    told.add(rows.where(F.col("kind") < PAIRS).groupBy("chunk").cogroup(told.read().where(F.col("kind") == COUNTS).groupBy("chunk")).applyInArrow(_own, TOLD))
    owned = told.read().where(F.col("kind") == OWN)
    one, two = owned.agg(F.coalesce(F.sum("one"), F.lit(0)), F.coalesce(F.sum("two"), F.lit(0))).first()
    d = discount(one, two)

    by_part = lambda df: df.groupBy("part")
    state = materialize(by_part(rows.where(F.col("kind") == WORDS)).cogroup(by_part(owned.where("part >= 0"))).applyInArrow(_first_state, WORDED), "words")
    sums = [F.coalesce(F.sum(x), F.lit(0)) for x in ("words", "total", "customers", "tables", "one", "two")]
    seen, total, customers, tables, one, two = state.agg(*sums).first()
    top = discount(one, two)
    for sweep in range(BURN + KEPT + 1):
        if sweep:
            changes = told.read().where((F.col("kind") >= STATES) | ((F.col("kind") == OWN) & (F.col("part") < 0))).groupBy("chunk").applyInArrow(_reseat_pairs(d), TOLD)
            state = materialize(by_part(state).cogroup(by_part(changes)).applyInArrow(_reseat_words((tables, top, letters), sweep), WORDED), "words")
            customers, tables = state.agg(*sums[2:4]).first()
        cells = state.where("chunk < 0").select(F.explode(F.arrays_zip("cells", "counts")).alias("x")).groupBy("x.cells").agg(F.sum("x.counts").alias("n")).toArrow()
        cell, count = (cells.column(i).to_numpy() for i in range(2))  # at most SYMBOLS ** (DEPTH + 1)
        by = np.argsort(cell)
        letters = Letters(cell[by], count[by], sweep)
        told.add(by_part(state).applyInArrow(_tell((customers, tables, top, letters), sweep), TOLD).repartition(n, "chunk"))
    texts = rows.where(F.col("kind") < PAIRS).groupBy("chunk")
    return texts.cogroup(told.read().where(F.col("kind") != OWN).groupBy("chunk")).applyInArrow(_score(total, seen, d), SCORES)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
