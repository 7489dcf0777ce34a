"""Where quotes may stand: documents that share a run of words with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.functions import columns as C

#: Words of a run.
RUN = 5


def candidates(quotes: DataFrame, docs: DataFrame, quote: str, doc: str, words: int = RUN) -> DataFrame:
    """(quote, doc, text columns of both): pairs that share a run of so many normalised words, found by an equality of the runs' hashes.

    quotes (quote, quote_text), docs (doc, text). A quote of fewer words has no run, and none is found for it.
    """

    def runs(df: DataFrame, ident: str, text: str) -> DataFrame:
        hashed = F.expr(f"if(size(w) >= {words}, transform(sequence(0, size(w) - {words}), i -> xxhash64(slice(w, i + 1, {words}))), array())")
        return df.select(ident, F.split(C.normalize_text(text), " ").alias("w")).select(ident, F.explode(F.array_distinct(hashed)).alias("run"))

    pairs = runs(docs, doc, "text").join(runs(quotes, quote, "quote_text"), "run").select(quote, doc).distinct()
    return pairs.join(quotes, quote).join(docs, doc)
