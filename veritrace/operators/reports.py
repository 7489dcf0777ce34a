"""Reports: numbering, blocks of text, actions, sources, the nested row and its exports."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.functions import columns as C
from veritrace.functions import fixed
from veritrace.operators.ranking import first_rows


def format_signals(signals: DataFrame, by: str | list[str] = "run_id") -> DataFrame:
    """(by, block): numbered signals as the text that a synthesis prompt shows. The layout of a signal is a fixed format."""
    by = [by] if isinstance(by, str) else by
    note = F.when(F.coalesce("is_unverified", F.lit(False)), " | UNVERIFIED (one source of low credibility)").otherwise("")
    line = F.format_string(
        '[Signal-%d] %s | %s | %s | conf=%.2f | tw=%.2f | cred=%s | srcs=%d%s\n  Statement: %s\n  Evidence: "%s"\n  Source: %s',
        "signal_num", "severity", "risk_category", "signal_polarity", "confidence_score", "temporal_weight", F.coalesce("credibility_tier", F.lit("GENERAL")),
        "independent_source_count", note, "text", F.substring("source_snippet", 1, 180), "source_url",
    )
    rows = signals.select(*by, "signal_num", line.alias("line"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("signal_num", "line"))), lambda x: x["line"]), "\n\n").alias("block"))


def map_actions(actions: DataFrame, signals: DataFrame, by: str = "run_id") -> DataFrame:
    """Actions with the ids of the signals they cite, unknown ones left out; an unknown priority is MONITOR.

    actions (by, action_ord, description, priority, signal_refs array), signals (by, signal_num, id).
    """
    refs = actions.select(by, "action_ord", F.posexplode_outer(C.citations(F.array_join("signal_refs", " "))).alias("pos", "signal_num"))
    hit = refs.join(signals.select(by, "signal_num", "id"), [by, "signal_num"], "left")
    ids = hit.groupBy(by, "action_ord").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))), lambda x: x["id"]).alias("related_signals"))
    priority = F.when(F.upper("priority").isin(fixed.PRIORITIES), F.upper("priority")).otherwise("MONITOR")
    out = actions.withColumn("priority", priority).drop("signal_refs").join(ids, [by, "action_ord"])
    return out.withColumn("priority_rank", C.lookup("priority", {p: i for i, p in enumerate(fixed.PRIORITIES)}, 2))


def extraction_prompt(entity: str, text: str, cap: int = fixed.TEXT_CAP) -> Column:
    """What a provider is asked about a document."""
    return F.format_string("Organisation: %s\nFind every statement of risk or strength about it, each with its exact quote.\nDocument:\n%s", F.col(entity), F.substring(text, 1, cap))


def severity_prompt(text: str, category: str, polarity: str, context: str, snippet: str) -> Column:
    """What a provider is asked about a signal; context is an array of pieces of the rubric."""
    pieces = F.coalesce(F.nullif(F.array_join(context, "\n\n"), F.lit("")), F.lit("(no rubric context)"))
    return F.format_string("Grade this signal.\nCategory: %s\nPolarity: %s\nStatement: %s\nQuote: %s\nRubric:\n%s", F.col(category), F.col(polarity), F.col(text), F.coalesce(snippet, F.lit("")), pieces)


def signals_export(signals: DataFrame, stamp: str, by: str = "run_id", name: str = "entity_name") -> DataFrame:
    """(file_name, value): a JSON text of each run's signals, in order, under its name and time."""
    item = F.struct("signal_num", *(c for c in signals.columns if c not in (by, name, "signal_num")))
    rows = signals.groupBy(by, name).agg(F.array_sort(F.collect_list(item)).alias("signals"))
    return rows.select(F.concat(C.slug(name), F.lit(f"_signals_{stamp}.json")).alias("file_name"), F.to_json(F.struct(name, "signals"), {"pretty": "true"}).alias("value"))


def sources_consulted(signals: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, url, source_type, first): the distinct sources in the order of the numbered signals."""
    return signals.groupBy(by, F.col("source_url").alias("url")).agg(F.min_by("source_type", "signal_num").alias("source_type"), F.min("signal_num").alias("first"))


def sources_failed(failed: DataFrame, kinds: dict[str, str], name: str = "source") -> DataFrame:
    """Failed sources with their type; a name without one is NEWS_ARTICLE."""
    return failed.withColumn("source_type", C.lookup(name, kinds, "NEWS_ARTICLE"))


def report_rows(signals: DataFrame, scores: DataFrame, overall: DataFrame, by: str = "run_id") -> DataFrame:
    """One nested row a run: risks, strengths, scores by category, overall and counts. Risks are all that is not positive."""
    item = F.struct("signal_num", "id", "text", "severity", "risk_category", "confidence_score", "source_url")
    risk = F.col("signal_polarity") != "POSITIVE"
    s = signals.groupBy(by).agg(
        F.array_sort(F.collect_list(F.when(risk, item))).alias("risk_signals"), F.array_sort(F.collect_list(F.when(~risk, item))).alias("positive_signals"), F.count("*").alias("signals_extracted")
    )
    c = scores.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("risk_category", "score")))).alias("category_scores"))
    out = overall.join(s, by, "left").join(c, by, "left")
    return out.withColumn("signals_extracted", F.coalesce("signals_extracted", F.lit(0)))


def section_prompts(signals: DataFrame, scores: DataFrame, budget: int | Column = fixed.MAX_CALLS, by: str = "run_id") -> DataFrame:
    """(by, risk_category, section_rank, entity_name, block): what is asked about each category of a run's risks, highest score first, within the budget of calls."""
    risks = signals.where("signal_polarity <> 'POSITIVE'")
    seen = risks.groupBy(by, "risk_category").agg(F.min("signal_num").alias("first_seen"), F.first("entity_name").alias("entity_name"))
    ranked = category_order(seen.join(scores.select(by, "risk_category", "score"), [by, "risk_category"], "left").fillna(0.0, "score"), by)
    most = budget if isinstance(budget, Column) else F.lit(budget)
    return ranked.where(F.col("section_rank") <= most).join(format_signals(risks, [by, "risk_category"]), [by, "risk_category"]).select(by, "risk_category", "section_rank", "entity_name", "block")


def compiled(signals: DataFrame, sections: DataFrame, overall: DataFrame, actions: DataFrame, tiers: DataFrame, by: str = "run_id") -> DataFrame:
    """The written part of every run's report: sections, summary with its caveat, strengths, actions with their signals, sources in order.

    sections (by, risk_category, section), overall (by, summary, strengths), actions as map_actions
    gives them, tiers (by, tier). A run without a signal says so.
    """
    some = signals.groupBy(by).agg(F.count("*").alias("n_signals"))
    told = sections.where("section is not null").groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("risk_category", "section")))).alias("sections"))
    listed = actions.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("priority_rank", "action_ord", "priority", "description", "related_signals"))).alias("actions"))
    consulted = sources_consulted(signals, by).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "url", "source_type"))), lambda x: F.struct(x["url"].alias("url"), x["source_type"].alias("source_type"))).alias("sources"))
    out = tiers.select(by, "tier")
    for df in (some, told, overall, listed, consulted):
        out = out.join(df, by, "left")
    none = F.col("n_signals").isNull()
    summary = F.when(none, "No material risk signals were identified from the available data sources.").otherwise(F.coalesce("summary", F.lit("")))
    strengths = F.when(none, "No material strengths identified from available data.").otherwise(F.coalesce("strengths", F.lit("")))
    out = out.withColumns({"summary": summary, "strengths": strengths, "n_signals": F.coalesce("n_signals", F.lit(0))})
    return out.withColumn("summary", caveat("summary", "tier"))


def caveat(summary: str, tier: str):
    """The summary, with a word of caution where few documents were found."""
    return F.when(F.col(tier).isin("LIMITED", "SPARSE"), F.concat(F.lit("Based on limited data. "), F.coalesce(F.col(summary), F.lit("")))).otherwise(F.col(summary))


def category_order(scores: DataFrame, by: str = "run_id") -> DataFrame:
    """scores with section_rank: highest first, equals as first seen (rows have first_seen)."""
    from pyspark.sql import Window as W

    return scores.withColumn("section_rank", F.row_number().over(W.partitionBy(by).orderBy(F.col("score").desc(), F.col("first_seen").asc())))


def answer_contexts(contexts: DataFrame, by: str = "run_id", cap: int = 80) -> DataFrame:
    """The first cap contexts of a run whose beginnings differ."""
    key = F.lower(F.substring("context", 1, 120))
    distinct = first_rows(contexts.withColumn("_k", key), [by, "_k"], [F.col("ord").asc()], 1).drop("_k")
    return first_rows(distinct, [by], [F.col("ord").asc()], cap)


def as_json(reports: DataFrame, by: str = "run_id", name: str = "entity_name") -> DataFrame:
    """(file_name, value): a pretty JSON text a report, ready for a text sink."""
    return reports.select(F.concat(C.slug(name), F.lit("_"), F.col(by).cast("string"), F.lit(".json")).alias("file_name"), F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def as_html(report: dict) -> str:
    """One collected report as a page: scores, then signals by severity and confidence."""
    esc = lambda x: html.escape(str(x if x is not None else ""))
    rank = fixed.SEVERITY_RANK
    rows = sorted(report.get("risk_signals") or [], key=lambda s: (-rank.get(s["severity"], 0), -s["confidence_score"]))
    scores = "".join(f"<tr><td>{esc(c)}</td><td>{esc(v)}</td></tr>" for c, v in sorted((report.get("category_scores") or {}).items()))
    body = "".join(f"<tr><td>{esc(s['severity'])}</td><td>{esc(s['risk_category'])}</td><td>{esc(s['text'])}</td><td>{s['confidence_score']:.2f}</td></tr>" for s in rows)
    return f"<html><body><h1>{esc(report.get('entity_name'))}</h1><p>Overall {esc(report.get('overall'))}</p><table>{scores}</table><table>{body}</table></body></html>"
