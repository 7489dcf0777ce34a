"""Token counts: pieces counted once per distinct pre-token, joined to per-document frequencies, summed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm import chunks

#: Fixed by byte-level BPE: how a text is cut before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens, over all chunks, that one task counts at most on average.
TASK_WORDS = 500_000
#: Texts of these characters are cut by PRE_TOKEN here, others by the library, whose tables for other scripts may differ.
PLAIN = r"[\t\n\r\x20-\x7E¡-ɏ]*+"


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _patterns(path: str):
    import json

    with open(path, encoding="utf-8") as f:
        special = [x["content"] for x in json.load(f)["added_tokens"]]
    return regex.compile(PRE_TOKEN), regex.compile(PLAIN), regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or "(?!)")


def pre_tokens(text: str, path: str) -> list[str]:
    """A text's pre-tokens; strings of special tokens stand for themselves, as the library has it by default."""
    cut, plain, special = _patterns(path)
    out: list[str] = []
    at = 0
    for m in [*special.finditer(text), None]:
        x = text[at : m.start() if m else len(text)]
        if plain.fullmatch(x):
            out += cut.findall(x)
        elif x:
            out += [x[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(x)]
        if m:
            out.append(m[0])
            at = m.end()
    return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text).

    Pre-tokens are coded per chunk (see chunks); every distinct pre-token is counted once, the
    count joined back to the chunks and summed as frequency times count. No ids are kept.
    A null or empty text has 0 tokens; repeated rows and null doc_ids give a row each; other columns
    are ignored; an empty table gives an empty one.
    """
    coded = chunks.encode(docs.select("doc_id", "text", F.lit(False).alias("train")), lambda text: pre_tokens(text, tokenizer_path))
    # All rows of a pre-token go to one task: there it is counted once, and the count joined to every chunk that has it.
    # A chunk has a pre-token once, so none is hot: even the commonest has one row in the many thousands of every chunk.
    rows = coded.agg(F.coalesce(F.sum(F.size("freqs").cast("long")), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows // TASK_WORDS)
    words = chunks.dictionary(coded).select("chunk", "pos", "word").repartition(n, "word")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = tokenizer(tokenizer_path), {}
        for b in batches:
            coded_words = b.column(2).dictionary_encode()
            some = coded_words.dictionary.to_pylist()
            new = [w for w in some if w not in known]
            known.update(zip(new, (len(e.ids) for e in t.encode_batch(new, add_special_tokens=False)), strict=True))
            n = pa.array([known[w] for w in some], pa.int32()).take(coded_words.indices)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["chunk", "pos", "n"])

    told = words.mapInArrow(count, "chunk long, pos int, n int")

    def total(doc: dict, ids, freqs, by_word) -> tuple:
        n = int((by_word[0][ids] * freqs).sum())
        return doc["doc_id"], doc["n_bytes"], n, n > limit

    return chunks.per_document(coded, told, ["n"], "tokens", total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
