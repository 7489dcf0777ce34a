"""Language ID by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is cut greedily into the longest
phrases that occur in a language's text; few long phrases mean little cross-entropy. The language
with the fewest phrases a letter, weighted by the bits that point into its text, wins.
"""

from __future__ import annotations

import math
import unicodedata
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritrace.llm.slices import give_back, slices

#: The fitted sample: so many rows of a language, lowest by hash, of each a stretch of so many letters at a place given by its hash.
SAMPLE_ROWS, ROW_LETTERS = 64, 400
#: As many rows again of each language set the limit beyond which a text is in no learned language: MARGIN times the phrases a
#: letter of this quantile of them (a tenth of them may be mislabelled), and SLACK phrases that any text may have.
CLEAN, MARGIN, SLACK = 0.9, 1.5, 8
#: A model is at most about a megabyte a language; of more labelled values the commonest are learned, with a warning.
MOST_LANGUAGES = 500
#: Letters parsed in one stretch: a longer text is a row of stretches whose phrases add up.
STRETCH = 512
#: Letters of the texts that are parsed at once.
LETTERS = 1_000_000
FOLD = "pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 4) = 2"


class Automaton:
    """The suffix automaton of codes, as rows laid over one another in one table.

    The step from a state by a symbol is at slot place[state] + symbol, if the slot names the state;
    it holds state << 32 | next state. So an alphabet of thousands of symbols costs no more than one
    of thirty. root is the next state of each symbol from the start, 0 for a symbol not in codes.
    """

    def __init__(self, codes: np.ndarray, symbols: int):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes.tolist():
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.root = np.array([nxt[0].get(c, 0) for c in range(symbols)], np.int32)
        self.unseen = (self.root == 0).astype(np.int32)
        self.place, self.slots = self._laid(nxt, symbols)

    @staticmethod
    def _laid(nxt: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
        edges = sum(map(len, nxt))
        slots = np.full(2 * edges + 4 * symbols + 1_024, -1, np.int64)
        place, low, near = np.zeros(len(nxt), np.int32), symbols, symbols  # no row starts below 0
        for s in sorted(range(len(nxt)), key=lambda s: -len(nxt[s])):
            if not nxt[s]:
                continue
            c, to = np.array(list(nxt[s]), np.int64), np.array(list(nxt[s].values()), np.int64)
            at, least = (max(low, near - 128) if len(c) > 1 else low), int(c.min())
            while len(c) > 1:  # from near the row before on, the first place where none of the row's slots is taken; single steps fill the gaps
                if at + 64 + symbols > len(slots):
                    slots = np.concatenate((slots, np.full(len(slots), -1, np.int64)))
                ok = (slots[at - least + np.arange(64)[:, None] + c] < 0).all(axis=1)
                if ok.any():
                    at = near = at + int(ok.argmax())
                    break
                at += 64
            place[s] = at - least
            slots[place[s] + c] = s << 32 | to
            while slots[low] >= 0:
                low += 1
        return place, slots[: int(place.max()) + symbols + 1]


def letter_codes(texts: list[str], lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' codes, one after another, and how many each has: 0 for a run of other characters between letters."""
    raw = [lut[np.frombuffer(x.lower().encode("utf-32-le", "replace"), np.uint32)] for x in texts]
    owner = np.repeat(np.arange(len(raw)), [len(x) + 1 for x in raw])
    flat = np.concatenate([np.append(x, 0) for x in raw]).astype(np.uint16) if raw else np.empty(0, np.uint16)
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0) & (owner[1:] == owner[:-1])
    keep[0:1] = flat[0:1] != 0
    return flat[keep], np.bincount(owner[keep], minlength=len(raw))


def phrases(flat: np.ndarray, counts: np.ndarray, tables: list[Automaton]) -> np.ndarray:
    """Phrases of each text (row) in each automaton (column)."""
    out = np.zeros((len(counts), len(tables)), np.int64)
    starts = np.cumsum(counts) - counts
    per = -(-counts // STRETCH)
    owner = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    begin = starts[owner] + nth * STRETCH
    size = np.minimum(counts[owner] - nth * STRETCH, STRETCH)
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), 16_384):
        o = order[at : at + 16_384]
        b, n = begin[o], size[o]
        active = np.searchsorted(-n, -np.arange(n[0]), "left")  # stretches longer than each step
        state = [np.zeros(len(o), np.int32) for _ in tables]
        found = [np.zeros(len(o), np.int32) for _ in tables]
        for step, m in enumerate(active.tolist()):
            c = flat[b[:m] + step]
            for k, t in enumerate(tables):
                s = state[k][:m]
                x = t.slots.take(t.place.take(s) + c)
                to = x.astype(np.int32)  # the lower half
                off = np.flatnonzero(x >> 32 != s)  # no phrase goes on: one ends, unless none has begun, and one begins with the symbol
                if len(off):
                    d = c[off]
                    to[off] = t.root.take(d)
                    found[k][off] += (s[off] != 0) + t.unseen.take(d)
                state[k][:m] = to
        for k, (s, f) in enumerate(zip(state, found, strict=True)):
            np.add.at(out[:, k], owner[o], f + (s != 0))
    return out


@dataclass
class Model:
    """Languages in order of name, their automata, the bits of a pointer into each, the code of each code point, and the most phrases a letter in each language."""

    languages: list[str]
    lut: np.ndarray
    tables: list[Automaton]
    bits: np.ndarray
    limit: np.ndarray


def _sampled(docs: DataFrame) -> DataFrame:
    """(lang, r, text): stretches of the sample, r from 1 to twice SAMPLE_ROWS in each language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(f"lang is not null and text is not null and not ({FOLD})").withColumn("o", F.xxhash64("doc_id", "text"))
    place = F.expr(f"1 + pmod(o, greatest(1, length(text) - {2 * ROW_LETTERS} + 1))")
    rows = rows.select("lang", "o", F.substring("text", place, F.lit(2 * ROW_LETTERS)).alias("text"))
    held = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(held) > MOST_LANGUAGES:
        warnings.warn(f"only the {MOST_LANGUAGES} commonest lang values are learned", stacklevel=2)
        rows = rows.where(F.col("lang").isin([r["lang"] for r in held[:-1]]))
    first = W.partitionBy("lang").orderBy("o", "text")  # tasks send on no more than the first rows of each language
    return rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= 2 * SAMPLE_ROWS)


def fit(docs: DataFrame) -> Model:
    """Learn from labelled rows outside the held-out fold: SAMPLE_ROWS rows of each language, whatever the table's size."""
    sample = _sampled(docs)
    told = sample.select("lang", "r", "text").collect()
    by: dict[str, list[str]] = {}
    rest: dict[str, list[str]] = {}
    for r in sorted(told, key=lambda r: (r["lang"], r["r"])):
        if r["r"] <= SAMPLE_ROWS:
            by.setdefault(r["lang"], []).append(r["text"])
        else:
            rest.setdefault(r["lang"], []).append(r["text"])
    own = sorted({c for texts in by.values() for x in texts for c in x.lower() if c.isalpha()})
    lut = np.array([(len(own) + 1) * (unicodedata.category(chr(c))[0] == "L") for c in range(0x110000)], np.uint16)
    for k, c in enumerate(own, 1):
        lut[ord(c)] = k
    tables, bits, languages = [], [], []
    for lang in sorted(by):
        flat, counts = letter_codes(by[lang], lut)
        at = np.cumsum(counts) - counts
        codes = np.concatenate([flat[a : a + min(n, ROW_LETTERS)] for a, n in zip(at, counts, strict=True)])
        if (codes > 0).any():
            languages.append(lang)
            tables.append(Automaton(codes, len(own) + 2))
            bits.append(math.log2(len(codes) + 1))
    model = Model(languages, lut, tables, np.array(bits), np.full(len(languages), math.inf))
    for k, lang in enumerate(languages):
        if lang in rest:
            _, _, _, rate = text_languages(rest[lang], model)
            model.limit[k] = MARGIN * float(np.quantile(rate, CLEAN))
    give_back()
    return model


def text_languages(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, known, rate) of each text; `und` at 0 without a letter. rate: phrases a letter, beyond the first few, in the language."""
    named, told, at = [], [np.zeros((0, 3))], 0
    while at < len(texts):
        part, letters = [], 0
        while at < len(texts) and (not part or letters + len(texts[at] or "") <= LETTERS):
            part.append(texts[at] or "")
            letters += len(part[-1])
            at += 1
        flat, counts = letter_codes(part, model.lut)
        some = np.bincount(np.repeat(np.arange(len(part)), counts), flat > 0, len(part)) > 0
        lang, score, rate = np.full(len(part), "und", object), np.zeros(len(part)), np.zeros(len(part))
        if model.languages:
            n = phrases(flat, counts, model.tables)
            cost = n * model.bits
            best = cost.argmin(axis=1)
            lang[some] = np.array(model.languages, object)[best[some]]
            two = np.sort(cost, axis=1)[:, :2]
            score[some] = 1.0 if len(model.languages) == 1 else (two[:, 1] / np.maximum(two.sum(axis=1), 1))[some]
            rate = np.maximum(n[np.arange(len(part)), best] - SLACK, 0) / np.maximum(counts, 1)
            some &= rate <= model.limit[best]
        named += lang.tolist()
        told.append(np.stack((score, rate, some), axis=1))
    score, rate, known = np.concatenate(told).T
    return named, score, known > 0, rate


def predicted(spark: SparkSession, model: Model):
    """A function of a text column: (lang_pred, score, known)."""
    shipped = spark.sparkContext.broadcast(model)

    def told(part: pa.RecordBatch) -> pa.StructArray:
        lang, score, known, _ = text_languages(part.column(0).to_pylist(), shipped.value)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(known)], names=["lang_pred", "score", "known"])

    @F.arrow_udf("lang_pred string, score double, known boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            whole = pa.record_batch([x], names=["text"])
            yield pa.concat_arrays([told(whole.slice(0, 0)), *map(told, slices(whole, 0, LETTERS))])

    # not deterministic for the optimizer alone: else a filter and a projection on it would each call it
    return predict.asNondeterministic()


def language_id(docs: DataFrame) -> DataFrame:
    """Predicted language of every row of docs (doc_id, text, lang).

    score is the loser's share of the two best costs: 0.5 is a tie, which the first language by name
    wins. known is false for a text that takes clearly more phrases a letter in the winner's text
    than labelled texts do: one in no learned language. A text that is null or without a letter is
    `und` at 0 and not known, as is all text when nothing is labelled. Rows with null lang are only
    predicted; repeated rows and null doc_ids keep their rows; other columns are ignored; no rows
    give no rows.
    """
    predict = predicted(docs.sparkSession, fit(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(FOLD).alias("held_out"), predict(F.col("text").cast("string")).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.known")


def accepted(docs: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...) that are known to be in one of languages (all learned ones by default).

    A null lang becomes the predicted one. Other rows, those without text or letters among them, go;
    repeated rows and null doc_ids stay each by its own text; other columns are handed on, whatever
    their names; no rows give no rows.
    """
    predict = predicted(docs.sparkSession, fit(docs))
    p = predict(F.col("text").cast("string"))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), p.alias("p"))
    held = held.where("p.known" if languages is None else F.col("p.known") & F.col("p.lang_pred").isin(languages))
    columns = [F.coalesce("row.lang", "p.lang_pred").alias("lang") if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns]
    return held.select(*columns)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
