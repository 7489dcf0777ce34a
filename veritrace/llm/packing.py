"""Best-fit packing of token pieces into sequences of fixed size.

Bulk-synchronous best-fit: pieces are range-sorted by length and ranked within it. Pieces of one
length with ranks in a row, and sequences in a row with gaps of one size, are runs; a round is one
Spark job over the runs, dealt by ranges of size. In its range every piece, larger ones first, looks
for its successor, the smallest gap that holds it; pieces that want the same gaps are matched by
rank; a piece without a gap goes on in the next range, and the gaps that shrank go to theirs. Pieces
that no range could hold open sequences, the longest first, for a part of their tokens, and the next
round begins. In the end the pieces meet the runs that hold their ranks.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritrace.llm.token_counts import tokenizer
from veritrace.storage import collect, materialize

#: Lower-case letters and digits of the characters cut here; texts with others go to the library whole.
_LETTERS = "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == "L")
_DIGITS = "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == "N")
#: Fixed by the vocabulary: how a normalised text is cut into words.
CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ſ]*")
#: Words whose ids a Python worker remembers.
CACHE = 400_000
_cache: dict[str, dict[str, bytes]] = {}
_ends: dict[str, np.ndarray] = {}


def _closes(path: str) -> np.ndarray:
    """For each id, whether its token ends a word."""
    if path not in _ends:
        t = tokenizer(path)
        _ends[path] = np.array([(t.id_to_token(i) or "").endswith("</w>") for i in range(t.get_vocab_size())])
    return _ends[path]


def id_bytes(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids, little-endian unsigned 32-bit, as the library gives them."""
    t, cache = tokenizer(path), _cache.setdefault(path, {})
    plain = [None if "<|" in x or not PLAIN.fullmatch(x) else CUT.findall(x.lower()) for x in texts]
    new = set().union(*(w for w in plain if w)).difference(cache)
    if len(cache) + len(new) > CACHE:
        cache.clear()
        new = set().union(*(w for w in plain if w))
    letters = [w for w in new if w.isascii() and w.isalpha()]  # the model's own symbols: no byte needs another
    model = t.model
    for w in letters:
        cache[w] = np.array([x.id for x in model.tokenize(w)], "<u4").tobytes()
    new = [w for w in new if not (w.isascii() and w.isalpha())]
    for at in range(0, len(new), 2_000):  # a line of words is one call; every word ends in a token that says so
        some = new[at : at + 2_000]
        ids = np.array(t.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(_closes(path)[ids]) + 1
        if len(stops) != len(some):
            raise ValueError(f"{len(some)} words end {len(stops)} times: the tokenizer cuts them otherwise")
        raw, at_byte = ids.tobytes(), (4 * stops).tolist()
        for w, a, b in zip(some, [0, *at_byte], at_byte, strict=False):
            cache[w] = raw[a:b]
    get = cache.__getitem__
    return [b"".join(map(get, w)) if w is not None else np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for w, x in zip(plain, texts, strict=True)]


def pieces(docs: DataFrame, tokenizer_path: str, size: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a closing 0, cut where they exceed size."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(ids), 256):
                rows = []
                for d, x in zip(ids[at : at + 256], id_bytes([x or "" for x in texts[at : at + 256]], tokenizer_path), strict=True):
                    x += b"\0\0\0\0"
                    for k, a in enumerate(range(0, len(x), 4 * size)):
                        y = x[a : a + 4 * size]
                        rows.append((d, k, a // 4, len(y) // 4, zlib.crc32(y)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


#: Ranges of sizes, and the part of the tokens without a gap for which a round opens sequences: less packs tighter, in more rounds.
RANGES, OPENED = 2, 0.5
#: Kinds of runs.
PIECES, GAPS, PLACED = 0, 1, 2
#: Rounds after which the driver drops what they have left.
COLLECTED = 8
RUNS = "kind int, range int, at int, length int, first long, n long, sequence long, offset int"


def range_of(at: int, size: int) -> int:
    return at * RANGES // (size + 1) if at <= size else RANGES


def sweep(runs: list[dict], size: int, number: int) -> list[tuple]:
    """The runs after a round, of those of one range; number is the first of the sequences that may be opened.

    PIECES: n pieces of a length with ranks from first on, which need a gap of at least `at`. GAPS: n
    sequences from `sequence` on with a gap of `at`. PLACED: n pieces, as many sequences, one offset.
    """
    out: list[tuple] = []
    gap = lambda at, sequence, n: out.append((GAPS, range_of(at, size), at, 0, 0, n, sequence, 0)) if at and n else None
    wait = lambda at, length, first, n: out.append((PIECES, range_of(at, size), at, length, first, n, 0, 0)) if n else None
    todo = sorted(((r["length"], r["at"], r["first"], r["n"]) for r in runs if r["kind"] == PIECES), key=lambda x: (-x[0], -x[1], x[2]))
    if runs[0]["range"] == RANGES:
        opened = max(1, int(sum(length * n for length, _, _, n in todo) / size * OPENED))
        for length, _, first, n in todo:
            each = size // length
            for take, times in ((min(n // each, opened), each), (min(1, opened - n // each), n % each)):
                if take > 0 and times:
                    for i in range(times):
                        out.append((PLACED, -1, 0, length, first, take, number, i * length))
                        first, n = first + take, n - take
                    gap(size - times * length, number, take)
                    opened, number = opened - take, number + take
            wait(length, length, first, n)
        return out
    gaps: dict[int, list[tuple[int, int]]] = {}
    for r in sorted((r for r in runs if r["kind"] == GAPS), key=lambda r: -r["sequence"]):
        gaps.setdefault(r["at"], []).append((r["sequence"], r["n"]))
    sizes = sorted(gaps)
    after = -(-(runs[0]["range"] + 1) * (size + 1) // RANGES)  # the least size of the next range
    for length, at, first, n in todo:
        while n and (k := bisect_left(sizes, max(length, at))) < len(sizes):
            held = sizes[k]
            sequence, m = gaps[held].pop()
            take = min(m, n)
            times = min(held // length, n // m) if take == m else 1
            if take < m:
                gaps[held].append((sequence + take, m - take))
            for i in range(times):
                out.append((PLACED, -1, 0, length, first, take, sequence, size - held + i * length))
                first, n = first + take, n - take
            gap(held - times * length, sequence, take)
            if not gaps[held]:
                del gaps[held]
                sizes.pop(k)
        wait(after if after <= size else size + 1, length, first, n)
    for at, held in gaps.items():
        for sequence, m in held:
            gap(at, sequence, m)
    return out


def _placed(lengths: DataFrame, size: int) -> DataFrame:
    """(length, first, n, sequence, offset): where n pieces of a length go; lengths has (length, n).

    A sequence's number is its round, or for a piece of over half the size its length, and a count.
    """
    zero, large = F.lit(0), F.col("length") > size // 2  # no two of these share a sequence: they open one each
    own = F.shiftleft(F.col("length").cast("long"), 40)
    run = lambda kind, at, length, first, sequence: F.struct(F.lit(kind).alias("kind"), F.when(at > size, RANGES).otherwise(F.floor(at * RANGES / (size + 1))).cast("int").alias("range"), at.cast("int").alias("at"), length.cast("int").alias("length"), first.cast("long").alias("first"), F.col("n"), sequence.cast("long").alias("sequence"), F.lit(0).alias("offset"))
    both = F.array(run(PLACED, zero, F.col("length"), zero, own), run(GAPS, size - F.col("length"), zero, zero, own))
    first = lengths.select(F.explode(F.when(large, both).otherwise(F.array(run(PIECES, F.col("length"), F.col("length"), zero, zero)))).alias("r")).select("r.*")
    rounds = [materialize(first.where("kind <> 1 or at > 0"), "runs")]
    names = [x.split()[0] for x in RUNS.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in RUNS.split(", ")]

    def step(number: int):
        def run(t: pa.Table) -> pa.Table:
            rows = sweep(t.to_pylist(), size, number)
            return pa.table([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], names=names)

        return run

    while not rounds[-1].where(F.col("kind") == PIECES).isEmpty():
        left = rounds[-1].where(F.col("kind") < PLACED).groupBy("range")
        rounds.append(materialize(left.applyInArrow(step((size + len(rounds)) << 40), RUNS), "runs"))
        if len(rounds) % COLLECTED == 0:
            collect(lengths.sparkSession)
    done = [r.where(F.col("kind") == PLACED).select("length", "first", "n", "sequence", "offset") for r in rounds]
    return materialize(reduce(DataFrame.union, done), "placed")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, size: int = 2048) -> DataFrame:
    """Every piece of every row of docs (doc_id, text) with its sequence and place there.

    (doc_id, piece, start, length, ids_crc32, sequence_id, offset). A null or empty text is one
    piece, the closing id. Repeated rows and null doc_ids are packed like others; other columns are
    ignored; no rows give no rows.
    """
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(pieces(docs, tokenizer_path, size), "pieces")
    ranged = cut.repartitionByRange(n_parts, "length", "doc_id", "piece", "ids_crc32").sortWithinPartitions("length", "doc_id", "piece")
    ranged = materialize(ranged.withColumn("place", F.monotonically_increasing_id()), "ranged").withColumn("part", F.shiftright("place", 33))
    # a row for each length of each range: as many as ranges and lengths together
    held = ranged.groupBy("part", "length").agg(F.min("place").alias("least"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = materialize(held.withColumn("before", before), "lengths")
    placed = _placed(held.groupBy("length").agg(F.sum("n").alias("n")), size)
    ranked = ranged.join(held.select(F.col("part").alias("p"), F.col("length").alias("l"), "least", "before"), (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))
    ranked = ranked.withColumn("rank", F.col("place") - F.col("least") + F.col("before"))
    runs = placed.select(F.col("length").alias("of"), "first", "n", "sequence", F.col("offset").cast("long").alias("offset"))
    out = ranked.join(runs, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
