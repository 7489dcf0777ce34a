"""The whole run, over many entities at once: documents to signals to scores to reports.

What lies outside an engine, a language model and an embedder, comes in as plain functions that run
in tasks; the defaults are rules and hashing, so a run needs no network and gives the same rows each
time. Each provider's result is written before it is read again: no plan calls a provider twice.
"""

from __future__ import annotations

import random
import re
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrace.functions import columns as C
from veritrace.functions import fixed, fuzzy
from veritrace.operators import ranking, reports, review, scoring, similarity
from veritrace.sources import connectors
from veritrace.storage import materialize

EXTRACTED = "doc_id long, n int, text string, snippet string, risk_category string, risk_subcategory string, severity string, signal_polarity string, confidence double, data_date string, error string"

#: word, category, severity, polarity: what the rule provider looks for
RULES = [
    ("license", "LEGAL", "MEDIUM", "NEGATIVE"), ("lawsuit", "LEGAL", "HIGH", "NEGATIVE"), ("breach", "CYBERSECURITY", "CRITICAL", "NEGATIVE"), ("password", "CYBERSECURITY", "HIGH", "NEGATIVE"),
    ("fraud", "FINANCIAL", "CRITICAL", "NEGATIVE"), ("loss", "FINANCIAL", "MEDIUM", "NEGATIVE"), ("idiot", "REPUTATIONAL", "LOW", "NEGATIVE"), ("stupid", "REPUTATIONAL", "LOW", "NEGATIVE"),
    ("rights reserved", "REGULATORY", "INFO", "NEUTRAL"), ("outage", "OPERATIONAL", "HIGH", "NEGATIVE"), ("award", "REPUTATIONAL", "INFO", "POSITIVE"), ("growth", "FINANCIAL", "INFO", "POSITIVE"),
]


def rule_provider(entity: str, text: str) -> list[dict]:
    """Signals of a text by keyword: the sentence around the first use of each."""
    out, text = [], text or ""
    for word, category, severity, polarity in RULES:
        if m := re.search(rf"(?i)\b{word}\b", text):
            start = max(text.rfind(".", 0, m.start()), text.rfind("\n", 0, m.start())) + 1
            ends = [x for x in (text.find(".", m.end()), text.find("\n", m.end())) if x >= 0]
            s = text[start : min(ends, default=len(text))].strip()
            out.append({"text": s, "snippet": s, "risk_category": category, "risk_subcategory": word, "severity": severity, "signal_polarity": polarity, "confidence": 0.5 + 0.05 * min(len(s) // 20, 8), "data_date": None})
    return out


def hashing_embedder(texts: list[str], width: int = 64) -> list[list[float]]:
    """Word counts hashed to places with signs, as unit vectors."""
    out = np.zeros((len(texts), width))
    for k, t in enumerate(texts):
        for w in re.findall("[a-z0-9]+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            out[k, h % width] += 1 if h >> 16 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).tolist()


def with_backoff(call: Callable, *args, retries: int = 2, wait: float = 1.0):
    """The call's answer; passing errors are tried again, each wait twice the one before and up to 30 % longer."""
    passing = re.compile(fixed.PASSING)
    for k in range(retries + 1):
        try:
            return call(*args)
        except Exception as e:
            if k == retries or not passing.search(str(e).upper()):
                raise
            time.sleep(wait * 2**k * (1 + random.random() * 0.3))


def extract(documents: DataFrame, provider: Callable = rule_provider, wait: float = 1.0) -> DataFrame:
    """EXTRACTED rows of documents (doc_id, entity_name, text): many a document, or one with an error."""
    names = [x.split()[0] for x in EXTRACTED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, e, t in zip(b["doc_id"], b["entity_name"], b["text"], strict=True):
                try:
                    rows += [{"doc_id": d, "n": n, "error": None} | s for n, s in enumerate(with_backoff(provider, e, t, wait=wait))]
                except Exception as x:  # one document's failure is its own
                    rows.append({"doc_id": d, "n": -1, "error": str(x)})
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "int64", "n": "int32", "confidence": "float64"}) if rows else pd.DataFrame(columns=names)

    return materialize(documents.select("doc_id", "entity_name", "text").mapInPandas(run, EXTRACTED), "extracted")


def verified(extracted: DataFrame, documents: DataFrame, today: str) -> DataFrame:
    """Signals whose quote stands in their document, with confidence by verdict; refused ones keep verdict REJECT."""
    e = extracted.where("error is null").withColumns({"confidence_score": C.clamp01(F.col("confidence")), "ord": F.col("n")})
    kept = ranking.cap_signals(e, "doc_id")
    j = kept.join(documents.select("doc_id", "run_id", "entity_name", "source_url", "source_type", F.col("text").alias("body")), "doc_id")
    j = j.withColumn("anchor_score", fuzzy.anchor_score("snippet", "body")).drop("body", "confidence", "error", "n")
    day = C.data_date("data_date")
    return j.withColumns(
        {
            "verdict": C.anchor_verdict("anchor_score"), "confidence_score": F.col("confidence_score") * C.anchor_factor("anchor_score"), "data_date": day,
            "temporal_weight": C.temporal_weight(day, today), "normalized_text": C.normalize_text("text"), "source_snippet": F.col("snippet"),
            "id": F.sha2(F.concat_ws("|", "run_id", F.col("doc_id").cast("string"), F.col("ord").cast("string")), 256),
            "credibility_tier": C.credibility_tier("source_type", "source_url"),
        }
    ).withColumns({"source_credibility": C.lookup("credibility_tier", fixed.TIER_WEIGHT, 0.6), "independent_source_count": F.lit(1)})


def embed(signals: DataFrame, embedder: Callable = hashing_embedder) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vector(x: pd.Series) -> pd.Series:
        return pd.Series(embedder(x.fillna("").tolist()))

    return materialize(signals.withColumn("embedding", vector("text")), "embedded")


def rule_severity(text: str, category: str, context: list[str]) -> str:
    """The severity named most often in the text and its rubric context; MEDIUM without one, the graver of equals."""
    words = " ".join([text or "", *context]).upper()
    n = {k: words.count(k) for k in fixed.SEVERITY_RANK}
    best = max(n, key=lambda k: (n[k], fixed.SEVERITY_RANK[k]))
    return best if n[best] else "MEDIUM"


def knowledge_pieces(files: DataFrame, embedder: Callable = hashing_embedder) -> DataFrame:
    """(item, text, embedding) of markdown texts (source, text), in chunks: what score_signals looks into."""
    chunks = connectors.markdown_chunks(files)
    return embed(chunks.select(F.format_string("%s#%06d", "source", "chunk").alias("item"), "text"), embedder)


def score_signals(signals: DataFrame, knowledge: DataFrame, provider: Callable = rule_severity, prior: int | Column = 0, wait: float = 1.0) -> DataFrame:
    """signals with the severity that a provider(text, category, context) gives within a run's budget of calls, `severity_error` and the review flag.

    signals (run_id, ord, id, text, risk_category, severity, confidence_score, embedding), knowledge
    (item, text, embedding): a signal's context is the three nearest pieces. prior is the calls made
    before, a number or a column of signals. Signals beyond the budget, and those whose call fails, keep their severity.
    """
    some = ranking.budget_prefix(signals, "run_id", "ord", prior)
    near = similarity.nearest(some.select(F.col("id").alias("query"), F.col("embedding").alias("v")), knowledge.select("item", F.col("embedding").alias("v")))
    context = near.join(knowledge.select("item", F.col("text").alias("piece")), "item").groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"]).alias("context"))
    asked = some.select("id", "text", "risk_category").join(context, F.col("id") == F.col("query"), "left").select("id", "text", "risk_category", F.coalesce("context", F.array().cast("array<string>")).alias("context"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, category, pieces in zip(b["id"], b["text"], b["risk_category"], b["context"], strict=True):
                try:
                    rows.append((i, with_backoff(provider, text, category, list(pieces), wait=wait), None))
                except Exception as x:  # one signal's failure is its own
                    rows.append((i, None, str(x)))
            yield pd.DataFrame(rows, columns=["id", "new_severity", "severity_error"])

    told = materialize(asked.mapInPandas(run, f"id {signals.schema['id'].dataType.simpleString()}, new_severity string, severity_error string"), "severities")
    out = signals.join(told, "id", "left").withColumn("severity", F.coalesce("new_severity", "severity")).drop("new_severity")
    return out.withColumn("requires_human_review", C.needs_review("severity", "confidence_score"))


def analyse(signals: DataFrame, knowledge: DataFrame | None = None, provider: Callable = rule_severity, prior: int | Column = 0) -> DataFrame:
    """Clusters, credibility, severity by knowledge if there is any, review flag, gate, contradictions; in this order, which the flags depend on."""
    numbered = materialize(signals.withColumn("ord", F.col("doc_id") * 100 + F.col("ord")), "numbered")
    one = similarity.deduplicate(numbered, ["run_id", "risk_category"], "embedding")
    one = scoring.apply_credibility(one)
    if knowledge is None:
        one = one.withColumn("requires_human_review", C.needs_review("severity", "confidence_score"))
    else:
        one = score_signals(one, knowledge, provider, prior).drop("severity_error")
    one = materialize(scoring.severity_gate(one), "gated")
    pairs = similarity.contradiction_candidates(one, "run_id", "embedding")
    told = pairs.select("run_id", F.col("a").alias("ord")).union(pairs.select("run_id", F.col("b").alias("ord"))).distinct().withColumn("is_contradictory", F.lit(True))
    return one.join(told, ["run_id", "ord"], "left").withColumn("is_contradictory", F.coalesce("is_contradictory", F.lit(False)))


def rule_section(category: str, entity: str, block: str) -> str:
    """A section that names how many signals a category has, and the first."""
    n = re.findall(r"\[Signal-(\d+)\]", block)
    return f"{category}: {len(n)} signals on {entity}, see [Signal-{n[0]}]"


def rule_overall(entity: str, risks: str, strengths: str, sections: dict[str, str]) -> dict:
    """Summary, strengths, and an action for every section, urgent where its first signal is CRITICAL."""
    good = re.findall(r"\[Signal-(\d+)\]", strengths)
    grave = set(re.findall(r"\[Signal-(\d+)\] CRITICAL", risks))
    actions = []
    for c in sorted(sections):
        first = re.search(r"\[Signal-(\d+)\]", sections[c])
        if first:
            actions.append({"description": f"Look into {c}", "priority": fixed.PRIORITIES[0] if first[1] in grave else "", "signal_refs": [first[0]]})
    return {"summary": f"{entity}: {len(sections)} areas of risk", "strengths": f"{len(good)} strengths", "actions": actions}


def synthesise(signals: DataFrame, scores: DataFrame, tiers: DataFrame, section: Callable = rule_section, overall: Callable = rule_overall, prior: int | DataFrame = 0, wait: float = 1.0) -> DataFrame:
    """The written part of reports (see reports.compiled) of numbered signals: a call a category, highest score first, then one over all, within a run's budget.

    prior is the calls made before, a number or a table (run_id, calls). A failed call leaves its part empty.
    """
    made = prior if isinstance(prior, DataFrame) else tiers.select("run_id", F.lit(prior).alias("calls"))
    left = materialize(tiers.select("run_id").join(made, "run_id", "left").select("run_id", F.greatest(F.lit(0), F.lit(fixed.MAX_CALLS) - F.coalesce("calls", F.lit(0))).alias("budget")), "budgets")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for c, e, block in zip(b["risk_category"], b["entity_name"], b["block"], strict=True):
                try:
                    texts.append(with_backoff(section, c, e, block, wait=wait))
                except Exception:  # one section's failure is its own
                    texts.append(None)
            yield pd.DataFrame({"run_id": b["run_id"], "risk_category": b["risk_category"], "section": texts})

    def conclude(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r, e, risks, good, told in zip(b["run_id"], b["entity_name"], b["risks"], b["good"], b["told"], strict=True):
                try:
                    x = with_backoff(overall, e, risks or "", good or "", {k: v for k, v in (told or {}).items() if v}, wait=wait)
                except Exception:
                    x = {}
                rows.append((r, x.get("summary"), x.get("strengths"), x.get("actions", [])))
            yield pd.DataFrame(rows, columns=["run_id", "summary", "strengths", "actions"])

    run = f"run_id {signals.schema['run_id'].dataType.simpleString()}"
    prompts = reports.section_prompts(signals, scores).join(left, "run_id").where("section_rank <= budget").drop("budget")
    sections = materialize(prompts.mapInPandas(write, f"{run}, risk_category string, section string"), "sections")
    calls = sections.groupBy("run_id").agg(F.count("*").alias("calls"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("risk_category", F.coalesce("section", F.lit("")))))).alias("told"))
    blocks = lambda kind, name: reports.format_signals(signals.where(kind)).withColumnRenamed("block", name)
    asked = signals.groupBy("run_id").agg(F.first("entity_name").alias("entity_name")).join(calls, "run_id", "left").join(left, "run_id").where(F.coalesce("calls", F.lit(0)) < F.col("budget"))
    asked = asked.join(blocks("signal_polarity <> 'POSITIVE'", "risks"), "run_id", "left").join(blocks("signal_polarity = 'POSITIVE'", "good"), "run_id", "left")
    asked = asked.select("run_id", "entity_name", "risks", "good", F.coalesce("told", F.create_map().cast("map<string,string>")).alias("told"))
    whole = materialize(asked.mapInPandas(conclude, f"{run}, summary string, strengths string, actions array<struct<description:string,priority:string,signal_refs:array<string>>>"), "overall")
    actions = whole.select("run_id", F.posexplode("actions").alias("action_ord", "a")).select("run_id", "action_ord", "a.description", "a.priority", "a.signal_refs")
    return reports.compiled(signals, sections, whole.select("run_id", "summary", "strengths"), reports.map_actions(actions, signals), tiers)


def run(
    spark: SparkSession, documents: DataFrame, today: str, provider: Callable = rule_provider, embedder: Callable = hashing_embedder, verdicts: DataFrame | None = None,
    knowledge: DataFrame | None = None, grade: Callable = rule_severity, section: Callable = rule_section, conclude: Callable = rule_overall,
) -> dict[str, DataFrame]:
    """signals, scores, overall, sufficiency, stats, calls and reports of documents (doc_id, run_id, entity_name, source_url, source_type, text).

    With knowledge, pieces (item, text, embedding), signals are graded by what is nearest to them.
    Extraction, grading and writing share a run's budget of calls: documents and signals beyond it are
    not sent to a provider, nor sections and conclusions. Runs without a signal still have a report.
    """
    tier = scoring.sufficiency(documents, "run_id")
    sent = ranking.budget_prefix(documents, "run_id", "doc_id")
    calls = materialize(sent.groupBy("run_id").agg(F.count("*").alias("calls")), "calls")
    anchored = materialize(verified(extract(sent, provider), sent, today), "anchored")
    stats = scoring.extraction_stats(anchored, "run_id")
    signals = embed(anchored.where("verdict <> 'REJECT'"), embedder)
    if knowledge is None:
        signals = analyse(signals)
    else:
        signals = analyse(signals.join(calls, "run_id"), knowledge, grade, F.col("calls")).drop("calls")
        graded = ranking.budget_prefix(signals.select("run_id", "ord").join(calls, "run_id"), "run_id", "ord", F.col("calls"))
        graded = graded.groupBy("run_id").agg(F.count("*").alias("graded"))
        calls = calls.join(graded, "run_id", "left").select("run_id", (F.col("calls") + F.coalesce("graded", F.lit(0))).alias("calls"))
        calls = materialize(calls, "calls")
    if verdicts is not None:
        signals = review.apply_verdicts(signals, verdicts)
    signals = materialize(ranking.number_signals(signals), "signals")
    risks = signals.where("signal_polarity <> 'POSITIVE'")
    scores = materialize(scoring.category_scores(risks, "run_id"), "scores")
    tiers = tier.select("run_id", "tier")
    overall = tiers.join(scoring.overall_score(scores, "run_id"), "run_id", "left").withColumn("overall", F.coalesce("overall", F.lit(0.0)))
    written = synthesise(signals, scores, tiers, section, conclude, calls).select("run_id", "summary", "strengths", "sections", "actions", "sources")
    full = reports.report_rows(signals, scores, overall).join(written, "run_id", "left")
    full = full.join(stats.select("run_id", "rejected"), "run_id", "left").withColumn("signals_rejected", F.coalesce("rejected", F.lit(0))).drop("rejected")
    return {"signals": signals, "scores": scores, "overall": overall, "sufficiency": tier, "stats": stats, "calls": calls, "reports": full}
