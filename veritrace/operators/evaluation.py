"""Metrics of reports against truth and among runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.functions import columns as C
from veritrace.functions import fixed, fuzzy
from veritrace.operators.blocks import FEW, meet, unit, vectors
from veritrace.operators.ranking import first_rows
from veritrace.operators.scan import percentiles, running
from veritrace.storage import materialize

#: Texts of a side of a block, pairs of a task, and pairs that are scored at once.
SIDE, PAIRS, AT_ONCE = 64, 20_000, 8_192

def _best_of(left: DataFrame, right: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, a, b, score): for each row of left (by, a, v) the right row (by, b, v) of highest cosine, the first of equals; null and 0 without one."""
    kinds = [left.schema[by].dataType.simpleString(), left.schema[a].dataType.simpleString(), right.schema[b].dataType.simpleString()]

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values(b)
        sim = unit(vectors(x["v"])) @ unit(vectors(y["v"])).T
        at = sim.argmax(axis=1)
        return pd.DataFrame({by: x[by], a: x[a], b: y[b].to_numpy()[at], "score": sim[np.arange(len(x)), at]})

    some = meet(left.select(by, a, "v"), right.select(by, b, "v"), best, f"{by} {kinds[0]}, {a} {kinds[1]}, {b} {kinds[2]}, score double", (by,))
    top = first_rows(some, [by, a], [F.col("score").desc(), F.col(b).asc()], 1)
    return left.select(by, a).join(top, [by, a], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def best_matches(truth: DataFrame, predicted: DataFrame, by: str, threshold: float = fixed.MATCH_COSINE) -> DataFrame:
    """(by, truth_id, pred_id, score, found): the best prediction of each truth, the first of equals.

    truth (by, truth_id, v), predicted (by, pred_id, v); both sides meet within `by` only, block by block.
    """
    return _best_of(truth, predicted, by, "truth_id", "pred_id").withColumn("found", F.col("score") >= threshold)


def best_truths(truth: DataFrame, predicted: DataFrame, by: str, threshold: float = fixed.MATCH_COSINE) -> DataFrame:
    """(by, pred_id, truth_id, matched): for each prediction the best truth, the first of equals."""
    best = _best_of(predicted, truth, by, "pred_id", "truth_id")
    return best.select(by, "pred_id", "truth_id", (F.col("score") >= threshold).alias("matched"))


def _lexical_best(truth: DataFrame, predicted: DataFrame, threshold: float, by: str, each: str) -> DataFrame:
    """(by, truth_id, pred_id, score): the best pair of each truth or prediction (`each`), among those of a run that share a word or a source's host, which is worth the threshold at least.

    A run's two sides meet in blocks; tasks take as many blocks as have PAIRS pairs, and score the pairs of many runs at once.
    """
    hosts = "source_url" in truth.columns and "source_url" in predicted.columns
    ids = {"truth_id": truth, "pred_id": predicted}
    other = next(c for c in ids if c != each)
    number = lambda: (1 + F.floor((F.count("*") - 1) / SIDE)).cast("int")
    rows = {}
    for c, df in ids.items():
        df = df.where(F.col(by).isNotNull() & F.col(c).isNotNull())
        rows[c] = df.select(by, F.col(c).alias("id"), C.normalize_text("text").alias("text"), C.key_tokens("text").alias("keys"), (C.display_host("source_url") if hosts else F.lit(None).cast("string")).alias("host"))
    sizes = rows[each].groupBy(by).agg(F.count("*").alias("_x"), number().alias("_m")).join(rows[other].groupBy(by).agg(F.count("*").alias("_y"), number().alias("_n")), by)
    sizes = materialize(sizes, "sizes")
    pairs = sizes.agg(F.coalesce(F.sum(F.col("_x") * F.col("_y")), F.lit(0))).first()[0]
    sizes = sizes.drop("_x", "_y")
    sizes = F.broadcast(sizes) if sizes.count() <= FEW else sizes
    dealt = lambda c, own, own_n, met, met_n, side: rows[c].join(sizes, by).withColumn(own, F.pmod(F.xxhash64("id", "text"), own_n).cast("int")).withColumn(met, F.explode(F.sequence(F.lit(0), F.col(met_n) - 1))).select(by, "_i", "_j", F.lit(side).alias("side"), F.col("id").alias(c), "text", "keys", "host")
    x = dealt(each, "_i", "_m", "_j", "_n", 0).unionByName(dealt(other, "_j", "_n", "_i", "_m", 1), allowMissingColumns=True)
    # few pairs are not dealt thin, as those of like lengths are scored together
    tasks = max(1 + int(pairs) // PAIRS, min(int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + 2 * int(pairs) // AT_ONCE))
    x = x.repartition(tasks, by, "_i", "_j").sortWithinPartitions(by, "_i", "_j", "side")
    kind = {c: df.schema[c].dataType.simpleString() for c, df in ids.items()}
    some = x.mapInArrow(_best_pairs(by, each, other, threshold), f"{by} {truth.schema[by].dataType.simpleString()}, truth_id {kind['truth_id']}, pred_id {kind['pred_id']}, score double")
    return first_rows(some, [by, each], [F.col("score").desc(), F.col(other).asc()], 1)


def _best_pairs(by: str, each: str, other: str, threshold: float):
    """For rows sorted by (by, _i, _j, side): the best partner in its block of each row of side 0."""

    def block(rows: list[dict]):
        sides = [[r for r in rows if r["side"] == k] for k in (0, 1)]
        for a in sides[0]:
            for b in sides[1]:
                if a["words"] & b["words"] or a["host"] and a["host"] == b["host"]:
                    yield a, b

    def best(pairs: list[tuple[dict, dict]]) -> list[dict]:
        out: dict = {}
        scores = fuzzy.match_scores([(a, b) if each == "pred_id" else (b, a) for a, b in pairs])
        for (a, b), score in zip(pairs, scores, strict=True):
            if a["host"] and a["host"] == b["host"]:
                score = max(score, threshold)
            key = a[by], a[each]
            if key not in out or (-score, b[other]) < (-out[key]["score"], out[key][other]):
                out[key] = {by: a[by], each: a[each], other: b[other], "score": score}
        return list(out.values())

    def run(batches):
        schema, rows, pairs = None, [], []
        for batch in batches:
            schema = pa.schema([batch.schema.field(c) for c in (by, "truth_id", "pred_id")] + [pa.field("score", pa.float64())])
            for r in batch.to_pylist():
                if rows and any(r[c] != rows[0][c] for c in (by, "_i", "_j")):
                    pairs += block(rows)
                    rows = []
                    if len(pairs) >= AT_ONCE:
                        yield pa.RecordBatch.from_pylist(best(pairs), schema)
                        pairs = []
                r["words"] = set(r["text"].split())
                rows.append(r)
        pairs += block(rows)
        if pairs:
            yield pa.RecordBatch.from_pylist(best(pairs), schema)

    return run


def lexical_matches(truth: DataFrame, predicted: DataFrame, threshold: float = fixed.MATCH_LEXICAL, by: str = "run_id") -> DataFrame:
    """(by, truth_id, pred_id, score, found): for each truth the prediction of best lexical score, the first of equals.

    truth (by, truth_id, text), predicted (by, pred_id, text), both perhaps with source_url. They meet
    within a run by any word that they share, or by the host of their source, which counts as a match.
    Texts without a word in common are compared with nothing: their score is 0.
    """
    top = _lexical_best(truth, predicted, threshold, by, "truth_id")
    out = truth.select(by, "truth_id").join(top, [by, "truth_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.withColumn("found", F.col("score") >= threshold)


def lexical_truths(truth: DataFrame, predicted: DataFrame, threshold: float = fixed.MATCH_LEXICAL, by: str = "run_id") -> DataFrame:
    """(by, pred_id, truth_id, matched): for each prediction the truth of best lexical score, the first of equals, null below the threshold."""
    top = _lexical_best(truth, predicted, threshold, by, "pred_id")
    out = predicted.select(by, "pred_id").join(top.where(F.col("score") >= threshold).select(by, "pred_id", "truth_id"), [by, "pred_id"], "left")
    return out.withColumn("matched", F.col("truth_id").isNotNull())


def extraction_checks(signals: DataFrame) -> DataFrame:
    """signals (snippet, claim, body, traps array) with `verbatim`, whether the snippet stands in the body, `trap`, whether a trap stands in snippet or claim, and `ok`.

    Case and runs of white space do not count; an empty snippet stands everywhere.
    """
    low = lambda x: C.collapse_lower(F.coalesce(x, F.lit("")))
    held = low(F.col("snippet"))
    trap = F.exists(F.coalesce("traps", F.array().cast("array<string>")), lambda t: F.contains(held, low(t)) | F.contains(low(F.col("claim")), low(t)))
    out = signals.withColumns({"verbatim": F.contains(low(F.col("body")), held), "trap": trap})
    return out.withColumn("ok", F.col("verbatim") & ~F.col("trap"))


def judged(statements: DataFrame, questions: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, faithfulness, answer_relevancy) of judged reports: the share of statements (by, supported) that are, and the mean of relevancies (by, relevancy); null without any."""
    f = statements.groupBy(by).agg(F.avg(F.col("supported").cast("double")).alias("faithfulness"))
    r = questions.groupBy(by).agg(F.avg("relevancy").alias("answer_relevancy"))
    return f.join(r, by, "full")


def company_metrics(runs: DataFrame, matches: DataFrame, matched: DataFrame, by: str = "run_id") -> DataFrame:
    """A row of metrics for each run: recall of its truths, share of predictions matched, rejection, guardrails and latency.

    runs (by, extracted, rejected, calls, cost, seconds, tier, expected_tier), matches (by, found), matched (by, matched).
    """
    r = share(matches, [by], "found", "recall").select(by, "recall", F.col("total").alias("n_truths"))
    p = share(matched, [by], "matched", "precision").select(by, "precision", F.col("total").alias("n_predictions"))
    out = runs.join(r, by, "left").join(p, by, "left")
    rate = F.coalesce(F.col("rejected") / F.nullif(F.col("extracted"), F.lit(0)), F.lit(0.0))
    return out.select(
        by, "recall", "precision", F.coalesce("n_truths", F.lit(0)).alias("n_truths"), F.coalesce("n_predictions", F.lit(0)).alias("n_predictions"), rate.alias("rejection_rate"),
        (F.col("tier") == F.col("expected_tier")).alias("sufficiency_exact"), C.guardrail_compliant("calls", "cost").alias("compliant"), "seconds",
    )


def share(rows: DataFrame, by: list[str], flag: str, name: str, empty: float | None = 0.0) -> DataFrame:
    """Recall of truths found, precision of predictions matched and the like."""
    out = rows.groupBy(*by).agg(F.count(flag).alias("total"), F.count_if(F.col(flag)).alias("hits"), F.avg(F.col(flag).cast("double")).alias(name))
    return out if empty is None else out.withColumn(name, F.coalesce(name, F.lit(empty)))


def missed(matches: DataFrame, by: str) -> DataFrame:
    return matches.groupBy(by).agg(F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("truth_id")))).alias("missed"))


def band_accuracy(pairs: DataFrame, a: str, b: str, ranks: dict[str, int]) -> DataFrame:
    """(n, exact, within_one) over pairs whose bands are both known; null without any."""
    r = lambda c: C.lookup(c, ranks, None)
    gap = F.abs(r(a) - r(b))
    return pairs.select(gap.alias("gap")).where("gap is not null").agg(F.count("*").alias("n"), F.avg((F.col("gap") == 0).cast("double")).alias("exact"), F.avg((F.col("gap") <= 1).cast("double")).alias("within_one"))


def severity_accuracy(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return band_accuracy(pairs, a, b, fixed.SEVERITY_RANK)


def sufficiency_accuracy(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return band_accuracy(pairs, a, b, fixed.SUFFICIENCY_RANK)


def verification_stats(runs: DataFrame, *by: str) -> DataFrame:
    """(*by, rejection_rate, pass_rate) from extracted and rejected counts."""
    out = runs.groupBy(*by).agg(F.sum("extracted").alias("extracted"), F.sum("rejected").alias("rejected"))
    rate = F.col("rejected") / F.nullif(F.col("extracted"), F.lit(0))
    return out.withColumns({"rejection_rate": F.coalesce(rate, F.lit(0.0)), "pass_rate": F.coalesce(1 - rate, F.lit(0.0))})


def dedup_stats(signals: DataFrame, *by: str) -> DataFrame:
    n = F.count("*")
    return signals.groupBy(*by).agg(
        n.alias("n"), F.count_if("is_corroborated").alias("corroborated"), F.coalesce(F.avg(F.col("is_corroborated").cast("double")), F.lit(0.0)).alias("corroboration_rate"), F.count_if("is_contradictory").alias("contradictory")
    )


def latency_percentiles(rows: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """(*by, p50, p95, n) of positive values, exact and linearly interpolated, by selection."""
    p = percentiles(rows.where(F.col(seconds) > 0), by, seconds, [0.5, 0.95])
    of = lambda q: F.round(F.max(F.when(F.col("q") == q, F.col("percentile"))), 1)
    return p.groupBy(*by).agg(of(0.5).alias("p50"), of(0.95).alias("p95"), F.first("n").alias("n"))


def average_precision(ranked: DataFrame, by: list[str], order: list[str], relevant: str) -> DataFrame:
    """(*by, ap): the mean over hits of the precision at each; 0 without a hit."""
    r = running(ranked, by, order, {"_hits": F.col(relevant).cast("int")}, "_k")
    return r.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col(relevant), F.col("_hits") / F.col("_k"))), F.lit(0.0)).alias("ap"))


def citation_grounding(reports: DataFrame, valid: DataFrame, by: str, text: str) -> DataFrame:
    """(by, citations, orphans, grounded): share of cited numbers that are valid; null without a citation.

    valid (by, ref): the ordinals and ids of a report's signals, as text. Any case, brackets not needed.
    """
    refs = reports.select(by, F.posexplode_outer(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?i)Signal-(\d+)"), 1)).alias("pos", "ref"))
    known = valid.select(F.col(by).alias("_b"), F.col("ref").alias("_r")).distinct()
    j = refs.join(known, (F.col(by) == F.col("_b")) & (F.col("ref") == F.col("_r")), "left")
    out = j.groupBy(by).agg(F.count("ref").alias("citations"), F.count_if(F.col("ref").isNotNull() & F.col("_r").isNull()).alias("orphans"), F.count("_r").alias("_ok"))
    return out.withColumn("grounded", F.col("_ok") / F.nullif(F.col("citations"), F.lit(0))).drop("_ok")


def orphan_citations(text: str, valid_to: str):
    """A column: cited numbers in order, with repeats, that exceed the number of signals."""
    return F.filter(C.citations(text), lambda n: (n < 1) | (n > F.col(valid_to)))


def aggregate_metrics(companies: DataFrame) -> DataFrame:
    """One row over companies' metrics: means without nulls, rates, and whether any halted."""
    return companies.agg(
        F.avg("recall").alias("recall_mean"), F.avg("precision").alias("precision_mean"), F.avg(F.col("sufficiency_exact").cast("double")).alias("sufficiency_exact_rate"),
        F.avg(F.col("compliant").cast("double")).alias("compliance_rate"), F.coalesce(F.bool_or("cached"), F.lit(False)).alias("any_cached"), F.count("*").alias("n"),
    )


def micro_scores(docs: DataFrame) -> DataFrame:
    """(precision, recall) over documents with found, must, good and kept counts."""
    s = docs.agg(F.sum("found").alias("found"), F.sum("must").alias("must"), F.sum("good").alias("good"), F.sum("kept").alias("kept"))
    return s.select(F.coalesce(F.col("good") / F.nullif("kept", F.lit(0)), F.lit(0.0)).alias("precision"), F.coalesce(F.col("found") / F.nullif("must", F.lit(0)), F.lit(0.0)).alias("recall"))
