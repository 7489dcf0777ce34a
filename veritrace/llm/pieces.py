"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a text follows the automaton; at each position its output links give the pieces that
end there, and each is relaxed against the best segmentation up to where it begins. For a unigram
model the best is the highest sum of scores. A byte-pair model has no sums: there a piece fits when
it and the piece before it stay as they are under the model's merges, and exactly one piece fits at
each position. Characters without a piece fall back to their bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
#: Words whose ids a Python worker remembers.
CACHE = 400_000
_models: dict[str, Model] = {}


class Model:
    """Pieces, scores and the automaton of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.unigram = proto.trainer_spec.model_type == 1
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        self.automaton, self.score, self.id, self.text, self.unknown = ahocorasick.Automaton(), {}, {}, [], 0
        self.bytes = [0] * 256
        for k, p in enumerate(proto.pieces):
            own = b""
            if p.type == 6:  # a byte
                self.bytes[int(p.piece[1:-1], 16)] = k
                own = bytes([int(p.piece[1:-1], 16)])
            elif p.type == 1:
                self.automaton.add_word(p.piece, p.piece)
                self.score[p.piece], self.id[p.piece] = p.score, k
                own = p.piece.encode()
            elif p.type == 2:
                self.unknown = k
                own = " ⁇ ".encode()
            self.text.append(own.replace(SPACE.encode(), b" "))
        self.automaton.make_automaton()
        self.fallback = proto.trainer_spec.byte_fallback
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.size = np.array([len(x) for x in self.text])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        # a piece never has a space after another character, nor a line break: texts can be cut there
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p and p != "\n" for p in self.score):
            self.cut = re.compile("(?s).+")

    def merged(self, text: str) -> list[str]:
        """A short text's pieces by the merges: the neighbours of highest joint score first, leftmost of equals."""
        x = list(text)
        while len(x) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(x, x[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            x[i : i + 2] = [x[i] + x[i + 1]]
        return x

    def _fit(self, a: str, b: str) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > CACHE:
                self.fits.clear()
            got = self.fits[a, b] = self.merged(a + b) == [a, b]
        return got

    def segment(self, word: str) -> list[str]:
        """The pieces of a word; a character without a piece stands alone."""
        n = len(word)
        last: list[str | None] = [None] * (n + 1)  # the last piece of the best segmentation up to each place
        best = [0.0] + [float("-inf")] * n
        found = self.automaton.iter(word)
        end, piece = next(found, (n, ""))
        for e in range(1, n + 1):
            while end == e - 1:
                s = e - len(piece)
                if self.unigram:
                    if best[s] + self.score[piece] > best[e]:
                        best[e], last[e] = best[s] + self.score[piece], piece
                elif last[e] is None and (s == 0 or self._fit(last[s], piece)):
                    last[e] = piece
                end, piece = next(found, (n, ""))
            if last[e] is None:  # no piece ends here
                last[e] = word[e - 1]
                best[e] = best[e - 1] - 1e3
        out, e = [], n
        while e:
            out.append(last[e])
            e -= len(last[e])
        return out[::-1]

    def encode_word(self, word: str) -> bytes:
        ids: list[int] = []
        for p in self.segment(word):
            k = self.id.get(p)
            if k is not None:
                ids.append(k)
            elif self.fallback:
                ids += [self.bytes[b] for b in p.encode("utf-8", "replace")]
            else:
                ids.append(self.unknown)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, little-endian unsigned 32-bit."""
        if not text:
            return b""
        cut = self.cut.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))
        for w in set(cut).difference(self.words):
            if len(self.words) > CACHE:
                self.words.clear()
            self.words[w] = self.encode_word(w)
        try:
            return b"".join(map(self.words.__getitem__, cut))
        except KeyError:  # the cache was cleared meanwhile
            return b"".join(self.words.get(w) or self.encode_word(w) for w in cut)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes in order, without the space put before the text."""
        size = self.size[ids]
        at = np.repeat(self.start[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
        x = self.flat[at].tobytes()
        return (x[1:] if self.prefix and x[:1] == b" " else x).decode("utf-8", "replace")


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encoder(path: str):
    """A function of a text column: its ids as an array."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([np.frombuffer(model(path).encode(t or ""), "<u4").astype(np.int32) for t in x])

    return encode


def decoder(path: str):
    """A function of a column of id arrays: their text; null for null."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([None if i is None else model(path).decode(np.asarray(i, np.int64)) for i in x], dtype=object)

    return decode


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_crc32, round_trip) of every row of docs (doc_id, text).

    round_trip: the ids decode to the text. A null text is as an empty one, without ids; repeated
    rows and null doc_ids keep their rows; other columns are ignored; no rows give no rows.
    """
    names = ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        is_byte = np.zeros(len(m.text), bool)
        is_byte[m.bytes] = True
        for b in batches:
            n, k, crc, back = [], [], [], []
            for x in b.column(1).to_pylist():
                x = x or ""
                raw = m.encode(x)
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                k.append(int(is_byte[ids].sum()))
                crc.append(zlib.crc32(raw))
                back.append(m.decode(ids) == x.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.bool_())], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
