"""Word frequencies of documents, coded against a dictionary per chunk of documents.

A chunk is a bounded run of documents of one input partition. Its distinct words are written
once, each document as (word number, frequency) against them, so a corpus-wide fact about a word
travels to a chunk once instead of once per document that uses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.storage import materialize

#: A chunk ends when it has so many distinct words or (word, document) entries; one document is never split.
MAX_WORDS, MAX_ENTRIES = 500_000, 8_000_000
#: Words of a dictionary in one row.
SLICE = 5_000

ENCODED = "chunk long, doc_id long, n_bytes long, n_tokens long, train boolean, ids binary, base long, words array<string>, freqs array<long>"


class Numbering(dict):
    """Numbers keys from 0 as they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def pack(ids: np.ndarray, freqs: np.ndarray) -> bytes:
    gaps = np.diff(ids, prepend=np.uint32(0)).astype(np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + freqs.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    half = len(planes) // 2
    gaps, freqs = (np.ascontiguousarray(x.reshape(4, -1).T).view(np.uint32).ravel() for x in (planes[:half], planes[half:]))
    return np.cumsum(gaps, dtype=np.int64), freqs.astype(np.int64)


def encode(docs: DataFrame, words_of: Callable[[str], list[str]]) -> DataFrame:
    """docs (doc_id, text, train) as the table ENCODED, written to the shared folder.

    Rows with `words` are slices of dictionaries (freqs: uses in rows with train), the others documents.
    A null text has the words of an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, number, entries = TaskContext.get().partitionId(), 0, Numbering(), 0
        used: list[tuple[np.ndarray, np.ndarray]] = []

        def dictionary() -> Iterator[pa.RecordBatch]:
            freqs = np.zeros(len(number), np.int64)
            for ids, f in used:
                freqs[ids] += f
            names = list(number)
            for at in range(0, len(names), SLICE):
                w = names[at : at + SLICE]
                yield batch([((part << 32) + k, None, None, None, None, None, at, w, freqs[at : at + SLICE])])

        for b in batches:
            rows = []
            for doc_id, text, train in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                text = text or ""
                w = words_of(text)
                ids, f = np.unique(np.fromiter(map(number.__getitem__, w), np.uint32, len(w)), return_counts=True)
                if train:
                    used.append((ids, f))
                entries += len(ids)
                rows.append(((part << 32) + k, doc_id, len(text.encode("utf-8", "replace")), len(w), train, pack(ids, f), None, None, None))
                if len(number) >= MAX_WORDS or entries >= MAX_ENTRIES:
                    yield batch(rows)
                    yield from dictionary()
                    rows, k, number, entries = [], k + 1, Numbering(), 0
                    used.clear()
            if rows:
                yield batch(rows)
        yield from dictionary()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], names=NAMES)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("train").cast("boolean"))
    return materialize(narrow.mapInArrow(run, ENCODED), "words")


NAMES = [x.split()[0] for x in ENCODED.split(", ")]
TYPES = [{"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}[x.split()[1]] for x in ENCODED.split(", ")]


def dictionary(encoded: DataFrame) -> DataFrame:
    """(chunk, pos, word, freq): a row for each distinct word of each chunk."""
    rows = encoded.where("words is not null").select("chunk", "base", F.posexplode(F.arrays_zip("words", "freqs")))
    return rows.select("chunk", (F.col("base") + F.col("pos")).cast("int").alias("pos"), F.col("col.words").alias("word"), F.col("col.freqs").alias("freq"))


def per_document(encoded: DataFrame, facts: DataFrame, columns: list[str], name: str, combine: Callable, schema: str) -> DataFrame:
    """Bring facts (chunk, pos, *columns) back to the documents of each chunk.

    combine(documents as a dict of columns, ids, freqs, facts by word number) is called per
    document batch of one chunk, which is of bounded size; it returns columns in schema's order.
    """
    keep = ["chunk", "doc_id", "n_bytes", "n_tokens", "train", "ids"]

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        at = told.column("pos").to_numpy()
        by_word = []
        for c in columns:
            x = told.column(c).to_numpy()
            y = np.zeros(int(at.max()) + 1 if len(at) else 0, x.dtype)
            y[at] = x
            by_word.append(y)
        d = {c: docs.column(c).to_pylist() for c in keep[1:]}
        out = [[] for _ in names]
        for i, blob in enumerate(d["ids"]):
            ids, f = unpack(blob)
            for o, v in zip(out, combine({c: d[c][i] for c in keep[1:5]}, ids, f, by_word), strict=True):
                o.append(v)
        return pa.table([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", ")]
    told = facts.select(F.col("chunk").alias("of"), "pos", *columns)
    return encoded.where("words is null").select(*keep).groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(run, schema)
