"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, their character n-grams and
pairs of neighbouring words that are equal; a softmax layer over the average gives the classes.
Vectors and layer are trained together by stochastic gradient descent in numpy on a bounded sample
of labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.chunks import Numbering
from veritrace.llm.slices import give_back, slices

#: The fitted sample: so many labelled rows, lowest by hash, of each a stretch of so many characters at a place given by its hash.
SAMPLE, STRETCH = 4_000, 20_000
BUCKETS, DIM, EPOCHS, RATE = 1 << 17, 8, 8, 0.4
#: Steps of the vectors to those of the layer: a unit's gradient is its share of the text, which is small.
VECTORS = 20
#: Lengths of character n-grams, in bytes, with the marks around a word.
GRAMS = (2, 3, 4)
#: The bucket of a word that repeats the one before it.
REPEAT = 0
PREDICTED = 0.7
#: Letters of the texts that are scored at once.
LETTERS = 1_000_000
FOLD = "pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 4) = 2"


def word_units(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's units, one word after another, and how many each word has."""
    raw = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    x = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), size)
    units, owners = [np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))], [np.arange(len(raw))]
    for n in GRAMS:
        if len(x) >= n:
            h = np.zeros(len(x) - n + 1, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + x[k : len(x) - n + 1 + k] + np.uint32(n)
            whole = owner[: len(h)] == owner[n - 1 :]
            units.append((h ^ h >> np.uint32(15))[whole] * np.uint32(0x9E3779B1) >> np.uint32(7))
            owners.append(owner[: len(h)][whole])
    o = np.concatenate(owners)
    by = np.argsort(o, kind="stable")
    return (np.concatenate(units)[by] % np.uint32(BUCKETS - 1) + 1).astype(np.int64), np.bincount(o, minlength=len(raw))


def document_units(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, uses) of a whole text."""
    number = Numbering()
    w = text.split()
    ids = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
    if not len(ids):
        return ids, ids
    units, per = word_units(list(number))
    uses = np.repeat(np.bincount(ids), per).astype(np.float64)
    again = float((ids[1:] == ids[:-1]).sum())
    u, back = np.unique(np.append(units, REPEAT), return_inverse=True)
    n = np.bincount(back, np.append(uses, again))
    return u[n > 0], n[n > 0]


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias): a document's logit is the average weight of its units and the bias."""
    rng = np.random.default_rng(seed)
    v = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    w, bias = np.zeros((DIM, 2)), np.zeros(2)
    docs = []
    for x in texts:
        u, n = document_units(x)
        docs.append((u.astype(np.int32), (n / n.sum() if len(n) else n).astype(np.float32)))
    total = EPOCHS * len(docs)
    for e in range(EPOCHS):
        for k, i in enumerate(rng.permutation(len(docs))):
            rate = RATE * (1 - (e * len(docs) + k) / total)
            u, share = docs[i]
            h = share @ v[u] if len(u) else np.zeros(DIM)
            z = h @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = w @ p
            w -= rate * np.outer(h, p)
            bias -= rate * p * 0.1
            v[u] -= rate * VECTORS * np.outer(share, back)
    return (v @ (w[:, 1] - w[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Train on at most SAMPLE labelled rows outside the held-out fold; without any the bias alone is 0."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    told = told.where(f"doc_id is not null and quality in (0, 1) and not ({FOLD})").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("q"))
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the sample is chosen by narrow rows; texts join it, and repeated rows do not make it grow
    chosen = told.join(rows.select(F.col("d").alias("doc_id")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    place = F.expr(f"1 + pmod(xxhash64(text), greatest(1, length(text) - {STRETCH} + 1))")
    some = rows.join(F.broadcast(chosen), F.col("d") == F.col("doc_id")).select("d", F.substring("text", place, F.lit(STRETCH)).alias("text"), "q")
    got = some.distinct().orderBy(F.xxhash64("d", "text"), "d", "text").limit(SAMPLE).collect()
    got = sorted((r["d"], r["text"], r["q"]) for r in got)
    if not got:
        return np.zeros(BUCKETS), 0.0
    texts, labels = [x for _, x, _ in got], [q for _, _, q in got]
    model = train(texts, labels)
    del got, texts
    give_back()
    return model


def text_scores(texts: list[str | None], model: tuple[np.ndarray, float]) -> np.ndarray:
    """The probability of label 1 for each text; words that several of the texts use are looked up once."""
    weight, bias = model
    z, at = [], 0
    while at < len(texts):
        number, rows, letters = Numbering(), [], 0
        while at < len(texts) and letters < LETTERS:
            w = (texts[at] or "").split()
            rows.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
            letters += len(texts[at] or "")
            at += 1
        units, per = word_units(list(number))
        own = np.bincount(np.repeat(np.arange(len(per)), per), weight[units], len(per)) if len(per) else np.zeros(0)
        for x in rows:
            again = int((x[1:] == x[:-1]).sum())
            n = int(per[x].sum()) + again
            z.append((own[x].sum() + again * weight[REPEAT]) / n if n else 0.0)
    return 1 / (1 + np.exp(-np.clip(np.array(z) + bias, -500, 500)))


def scored(spark: SparkSession, model: tuple[np.ndarray, float]):
    """A function of a text column: its score."""
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            parts = slices(pa.record_batch([x], names=["text"]), 0, LETTERS)
            yield pa.concat_arrays([pa.array([], pa.float64()), *(pa.array(text_scores(b.column(0).to_pylist(), shipped.value)) for b in parts)])

    return score


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every row of docs (doc_id, text), learned from labels (doc_id, quality).

    A null, empty or wordless text has the score of the bias alone. Labels of doubtful quality
    (null, other than 0 and 1) are left out, several for one doc_id averaged; repeated rows and null
    doc_ids keep their rows; other columns are ignored; no rows give no rows.
    """
    score = scored(docs.sparkSession, fit(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(FOLD).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= PREDICTED).cast("int"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
