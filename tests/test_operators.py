import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from veritrace.operators import evaluation, graph, ranking, reports, resolution, review, scoring, similarity
from veritrace.plans import pipeline
from veritrace.sources import connectors, tables
from veritrace.streaming import runs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def signal_rows(spark, *given):
    base = {"run_id": "r", "id": "s", "ord": 0, "text": "t", "source_url": "https://a.com/1", "risk_category": "LEGAL", "severity": "HIGH", "signal_polarity": "NEGATIVE", "entity_name": "Acme",
            "confidence_score": 0.9, "temporal_weight": 1.0, "source_credibility": 1.0, "credibility_tier": "PRIMARY", "independent_source_count": 1, "embedding": [1.0, 0.0], "requires_human_review": False}
    data = [base | {"id": f"s{i}", "ord": i} | g for i, g in enumerate(given)]
    schema = "run_id string, id string, ord int, text string, source_url string, risk_category string, severity string, signal_polarity string, entity_name string, confidence_score double, temporal_weight double, source_credibility double, credibility_tier string, independent_source_count int, embedding array<double>, requires_human_review boolean"
    return spark.createDataFrame([tuple(d[c.split()[0]] for c in schema.split(", ")) for d in data], schema)


def test_category_and_overall_scores(spark):
    s = signal_rows(spark, {"severity": "CRITICAL", "confidence_score": 1.0, "risk_category": "LEGAL"}, {"severity": "LOW", "confidence_score": 1.0, "risk_category": "ESG"}, {"severity": "HIGH", "confidence_score": 1.0, "temporal_weight": 0.5, "run_id": "q"})
    sc = scoring.category_scores(s, "run_id")
    assert rows(sc, "run_id", "risk_category", "score") == [("q", "LEGAL", 4.0), ("r", "ESG", 4.0), ("r", "LEGAL", 10.0)]
    assert rows(scoring.overall_score(sc, "run_id"), "run_id", "overall") == [("q", 4.0), ("r", 7.0)]
    assert [r["score"] for r in scoring.category_radar(sc.where("run_id = 'r'")).orderBy("place").collect()] == [0.0, 10.0, 0.0, 0.0, 0.0, 0.0, 4.0]


@pytest.mark.parametrize(("n", "critical", "want"), [(9, 1, True), (20, 1, False), (10, 1, False)])
def test_critical_inflation(spark, n, critical, want):
    s = signal_rows(spark, *[{"severity": "CRITICAL" if i < critical else "LOW"} for i in range(n)])
    assert scoring.critical_inflation(s, "run_id").first()["inflated"] is want


def test_gate_caps_one_weak_source(spark):
    s = signal_rows(spark, {"credibility_tier": "LOW"}, {"credibility_tier": "LOW", "independent_source_count": 2}, {"credibility_tier": "PRIMARY"}, {"credibility_tier": "what", "severity": "CRITICAL", "signal_polarity": "POSITIVE"})
    assert rows(scoring.severity_gate(s), "id", "severity", "is_unverified") == [("s0", "MEDIUM", True), ("s1", "HIGH", False), ("s2", "HIGH", False), ("s3", "MEDIUM", True)]


@pytest.mark.parametrize(("n", "kinds", "tier"), [(15, 4, "RICH"), (15, 3, "ADEQUATE"), (20, 1, "SPARSE"), (8, 3, "ADEQUATE"), (7, 5, "LIMITED"), (4, 2, "LIMITED"), (3, 3, "SPARSE")])
def test_sufficiency(spark, n, kinds, tier):
    d = spark.createDataFrame([("r", f"k{i % kinds}") for i in range(n)], "run_id string, source_type string")
    assert scoring.sufficiency(d, "run_id").first()["tier"] == tier


@pytest.mark.parametrize(("cosine", "n"), [(0.85, 1), (0.84, 2)])
def test_dedup_boundary(spark, cosine, n):
    s = signal_rows(spark, {"embedding": [1.0, 0.0]}, {"embedding": [cosine, (1 - cosine**2) ** 0.5]})
    assert similarity.deduplicate(s, ["run_id", "risk_category"], "embedding", cosine if n == 1 else 0.85).count() == n


def test_dedup_keeps_the_most_credible_and_counts_hosts(spark):
    s = signal_rows(spark, {"source_credibility": 0.6, "source_url": "https://x.a.com/1"}, {"source_credibility": 0.85, "source_url": "https://b.com/1"}, {"source_url": "https://y.a.com/2", "source_credibility": 0.6}, {"risk_category": "ESG"})
    got = {r["id"]: r for r in similarity.deduplicate(s, ["run_id", "risk_category"], "embedding").collect()}
    assert set(got) == {"s1", "s3"} and got["s1"]["corroborating_signals"] == ["s0", "s2"] and got["s1"]["independent_source_count"] == 2
    assert got["s3"]["independent_source_count"] == 1 and not got["s3"]["is_corroborated"]


def test_contradictions(spark):
    s = signal_rows(spark, {}, {"signal_polarity": "POSITIVE", "embedding": [0.0, 1.0]}, {"entity_name": "Other"}, {"embedding": [0.9, 0.1], "risk_category": "ESG"})
    assert rows(similarity.contradiction_candidates(s, "run_id", "embedding"), "a", "b", "rank") == [(0, 1, 2), (0, 3, 1)]


@pytest.mark.parametrize(("values", "tile"), [(2**19, 2**20), (60, 16)])
def test_contradictions_of_all_pairs(spark, monkeypatch, values, tile):
    """Against all pairs, in one block or many: copies, nulls, other lengths and tied pairs included."""
    import math
    import random

    monkeypatch.setattr(similarity, "VALUES", values)
    monkeypatch.setattr(similarity, "TILE", tile)
    rng = random.Random(8)
    seen: list = []

    def vector():
        x = [float(rng.randint(-9, 9)) for _ in range(3)]
        seen.append(rng.choice([x, x, x, [0.0, 0.0, 0.0], None, [1.0, None, 2.0], [1.0, 2.0]] + seen[:3]))
        return seen[-1]

    rows = [(f"run{i % 3}", f"e{i % 2}", i // 2 if i < 12 else i, rng.choice(["A", "B", None]), rng.choice(["POSITIVE", "NEGATIVE", "NEUTRAL", None]), vector()) for i in range(150)]
    rows += [("copies", "e", i, "A", "NEGATIVE", [1.0, 2.0, 2.0]) for i in range(40)] + [("none", "e", i, "A", p, None) for i, p in enumerate(["POSITIVE", "NEGATIVE", "NEGATIVE"])] + [(None, "e", 1, "A", "POSITIVE", [1.0]), ("copies", None, 99, "A", "POSITIVE", [1.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "run_id string, entity_name string, ord int, risk_category string, signal_polarity string, embedding array<double>")
    got: dict = {}
    for r in similarity.contradiction_candidates(df.repartition(3), "run_id", "embedding").collect():
        got.setdefault(r["run_id"], []).append((r["rank"], None if r["sim"] is None else round(r["sim"], 9), r["a"], r["b"]))

    def sim(x, y):
        if x is None or y is None or len(x) != len(y) or None in x or None in y:
            return None
        both = math.sqrt(sum(p * p for p in x)) * math.sqrt(sum(q * q for q in y))
        return sum(p * q for p, q in zip(x, y, strict=True)) / both if both else 0.0

    want = {}
    for run in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == run and r[1] is not None]
        pairs = [(sim(x[5], y[5]), x[2], y[2], x[3] == y[3] and x[3] is not None and {x[4], y[4]} == {"POSITIVE", "NEGATIVE"}) for x in own for y in own if x[1] == y[1] and x[2] < y[2]]
        pairs = sorted((p for p in pairs if p[3] or p[0] is not None and p[0] >= 0.5), key=lambda p: (p[0] is None, -(p[0] or 0), -p[1], -p[2]))[:5]
        want[run] = [(k + 1, None if s is None else round(s, 9), a, b) for k, (s, a, b, _) in enumerate(pairs)]
    assert {k: sorted(x) for k, x in got.items()} == want


def test_components_of_chains_stars_and_rings(spark):
    import random

    pick = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 17) for i in range(17)] + [(300, 300), (None, 5), (7, None)]
    pick.shuffle(edges)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {200 + i: 200 for i in range(17)}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_caps_keep_the_most_severe(spark):
    s = signal_rows(spark, *[{"severity": "LOW"}] * 6, {"severity": "CRITICAL"}, {"severity": "INFO"}).withColumn("doc_id", F.lit(1))
    assert [r[0] for r in rows(ranking.cap_signals(s), "id")] == ["s0", "s1", "s2", "s3", "s4", "s5", "s6"]
    assert rows(ranking.budget_prefix(s, "run_id", "ord", 40), "id") == [("s0",), ("s1",)]
    assert rows(ranking.number_signals(signal_rows(spark, {"signal_polarity": "POSITIVE"}, {})), "id", "signal_num") == [("s0", 2), ("s1", 1)]


def test_percentiles_and_precision(spark):
    d = spark.createDataFrame([("c", float(x)) for x in (10, 20, 30, 40, 100)] + [("c", None), ("c", 0.0)], "c string, s double")
    r = evaluation.latency_percentiles(d, ["c"], "s").first()
    assert (r["p50"], r["n"]) == (30.0, 5)
    d = spark.createDataFrame([("q", i, x) for i, x in enumerate([True, False, True])], "q string, k int, rel boolean")
    assert abs(evaluation.average_precision(d, ["q"], ["k"], "rel").first()["ap"] - (1 + 2 / 3) / 2) < 1e-9


def test_citations(spark):
    d = spark.createDataFrame([("r", "see [Signal-1], signal-2 and [Signal-9]"), ("e", "none"), ("n", None)], "run_id string, body string")
    v = spark.createDataFrame([("r", "1"), ("r", "2"), ("r", "abc")], "run_id string, ref string")
    got = {r["run_id"]: (r["citations"], r["orphans"], r["grounded"]) for r in evaluation.citation_grounding(d, v, "run_id", "body").collect()}
    assert got["r"] == (3, 1, pytest.approx(2 / 3)) and got["e"] == (0, 0, None) and got["n"] == (0, 0, None)


def test_consistency(spark):
    d = spark.createDataFrame([("a", 1, ["x", "y"]), ("a", 2, ["x", "z"]), ("b", 1, ["x"])], "s string, r int, k array<string>")
    assert rows(similarity.consistency(d, "s", "r", "k"), "s", "pairs", "mean_jaccard") == [("a", 1, pytest.approx(1 / 3)), ("b", 0, None)]


def test_verdicts(spark):
    s = signal_rows(spark, *[{"requires_human_review": True}] * 4)
    v = spark.createDataFrame([("s0", "d"), ("s1", "Confirm"), ("s2", "??"), ("zz", "d")], "id string, verdict string")
    assert rows(review.apply_verdicts(s, v).withColumn("human_verdict", F.coalesce("human_verdict", F.lit("-"))), "id", "human_verdict", "requires_human_review") == [("s1", "CONFIRMED", False), ("s2", "-", True), ("s3", "-", True)]
    asked = spark.createDataFrame([("r", "s0"), ("r", "s1"), ("q", "s0")], "run_id string, id string")
    given = spark.createDataFrame([("r", "s0", "c"), ("q", "s0", "d"), ("q", "other", "d")], "run_id string, id string, verdict string")
    assert review.collected(asked, given, "run_id").count() == 2 and review.collected(asked, given, "run_id", keep_partial=False).count() == 1


def test_resolution(spark):
    names = spark.createDataFrame([("acme",), ("beta",), ("gamma",)], "raw string")
    hits = spark.createDataFrame([("acme", 0, "ACME PLC", "gb", "public limited", "1"), ("acme", 1, "ACME US", "US_DE", "stock", "2"), ("beta", 0, "", "us", "llc", "3")], "raw string, ord int, legal_name string, jurisdiction_code string, company_type string, id string")
    got = {r["raw"]: r for r in resolution.resolve(names, hits).collect()}
    assert got["acme"]["canonical_name"] == "ACME PLC" and got["acme"]["is_public"] and got["gamma"]["canonical_name"] == "GAMMA" and got["gamma"]["status"] == "stub"
    assert got["beta"]["canonical_name"] == "BETA" and got["beta"]["is_public"] is False
    picks = spark.createDataFrame([("acme", "2")], "raw string, picked string")
    assert {r["raw"]: r["jurisdiction"] for r in resolution.resolve(names, hits, picks).collect()}["acme"] == "us-de"
    filers = spark.createDataFrame([(12927, "BOEING CO"), (5, "STRIDE, INC.")], "cik long, title string")
    q = spark.createDataFrame([("The Boeing",), ("Boeing Company",), ("Stripe, Inc.",)], "raw string")
    assert rows(resolution.match_filers(q, filers), "raw", "cik") == [("Boeing Company", "0000012927")]
    ents = resolution.resolve(names, hits)
    uk = spark.createDataFrame([("acme", 0, "ACME GROUP PLC", "001"), ("beta", 0, "BETA LTD", "002")], "raw string, ord int, title string, company_number string")
    f = spark.createDataFrame([("beta", "0000000005")], "raw string, cik string")
    e = {r["raw"]: r for r in resolution.enrich(ents, uk, f).collect()}
    assert e["acme"]["canonical_name"] == "ACME GROUP PLC" and e["beta"]["company_number"] is None and e["beta"]["is_public"]
    assert {r["raw"] for r in resolution.candidates(hits).collect()} == {"acme", "beta"}


def test_connector_retries_and_reports_errors(spark):
    def fetch(r):
        if r["q"] == "bad":
            raise ValueError("no")
        if r["q"] == "busy":
            return {"error": "rate_limited", "message": "later"}
        return {"companies": [{"n": r["q"]}, {"n": 2}]}

    got = connectors.connector(spark, "registry_test", fetch, wait=0.0)([{"q": "a"}, {"q": "bad"}, {"q": "busy"}]).collect()
    assert sorted((r["ord"], r["error"] or "") for r in got) == [(0, ""), (0, "api_error"), (0, "rate_limited"), (1, "")]
    assert json.loads(next(r["payload"] for r in got if r["ord"] == 1)) == {"n": 2}


def test_filings_and_facts(spark):
    s = spark.createDataFrame([("1", ["000000000000000001", "000000000000000002", "x"], ["10-K", "8-k", "10-K"], ["2024-01-01", "2024-02-01"], ["a.htm"])], "cik string, accession array<string>, form array<string>, filed array<string>, document array<string>")
    assert rows(connectors.filings_scan(s), "ord", "filing_type", "filing_date", "primary_document") == [(0, "10-K", "2024-01-01", "a.htm"), (1, "8-k", "2024-02-01", ""), (2, "10-K", "", "")]
    assert rows(connectors.filings_scan(s, form="10-k", since="2023-12-01"), "accession_number") == [("0000000000-00-000001",)]
    f = spark.createDataFrame([("c", "USD", 0, 0, "10-K", "2023", 1), ("c", "USD", 0, 1, "8-K", "2024", 2), ("c", "EUR", 1, 2, "8-K", "2023", 3), ("d", "USD", 0, 3, "8-K", "", 4)], "k string, unit string, unit_ord int, ord int, form string, filed string, val int")
    assert rows(connectors.latest_facts(f, ["k"]), "k", "unit", "val") == [("c", "USD", 1)]


def test_fan_in(spark):
    schema = "entity string, ord int, url string, text string, error string"
    a = spark.createDataFrame([("e", i, f"u{i}", "t", None) for i in range(12)], schema)
    b = spark.createDataFrame([("e", 0, None, None, "timeout")], schema)
    c = spark.createDataFrame([], schema)
    e = spark.createDataFrame([("e",), ("f",)], "entity string")
    docs, status = connectors.fan_in(e, {"web": a, "news": b, "registry": c})
    want = [("e", "news", "failed", 0), ("e", "registry", "consulted", 0), ("e", "web", "consulted", 12), *(("f", x, "consulted", 0) for x in ("news", "registry", "web"))]
    assert docs.count() == 10 and rows(status, "entity", "source", "status", "n_docs") == want


def test_markdown_chunks(spark, tmp_path):
    (tmp_path / "kb.md").write_text("intro words\n# Cyber\n---\n" + "w " * 450 + "\n\n## Empty\n### Last\nend")
    got = connectors.markdown_chunks(connectors.read_knowledge(spark, str(tmp_path))).orderBy("chunk").collect()
    assert [len(r["text"].split()) for r in got] == [3, 202, 202, 52, 3]
    assert got[0]["text"] == "[kb] intro words" and got[1]["text"].startswith("[kb] Cyber: w w") and got[-1]["text"] == "[kb] Last: end"
    odd = spark.createDataFrame([("n", None), ("e", ""), ("b", " \t\n---\n# Only"), ("t", "\tone  two\r\nthree\rfour"), ("l", "x" * 1_000_000 + " y" * 401)], "source string, text string")
    c = connectors.markdown_chunks(odd)
    assert [(r["source"], r["chunk"], len(r["text"].split()) - 1) for r in c.orderBy("source", "chunk").collect()] == [("l", 0, 200), ("l", 1, 200), ("l", 2, 2), ("t", 0, 4)]
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "ArrowEvalPythonUDTF" in plan


def test_tables(spark, tmp_path):
    root = str(tmp_path / "db")
    tables.init_tables(spark, root)
    tables.init_tables(spark, root)
    at = datetime.datetime(2024, 1, 1)
    r = spark.createDataFrame([("a", "x", "{}", at), ("b", "y", "{}", at)], tables.SCHEMAS["reports"])
    tables.append(r, root, "reports", "id")
    with pytest.raises(ValueError):
        tables.append(r.limit(1), root, "reports", "id")
    tables.append(r.limit(1).withColumns({"json_blob": F.lit("new"), "created_at": F.lit("2024-02-01").cast("timestamp_ntz")}), root, "reports")
    assert rows(tables.latest(tables.table(spark, root, "reports"), "id"), "id", "json_blob") == [("a", "new"), ("b", "{}")]
    assert [x["id"] for x in tables.list_reports(tables.table(spark, root, "reports")).collect()] == ["a", "b"]
    assert rows(tables.upsert(r, r.limit(1).withColumn("json_blob", F.lit("u")), "id"), "id", "json_blob") == [("a", "u"), ("b", "{}")]
    c = spark.createDataFrame([("k", "{}", at)], tables.SCHEMAS["document_cache"])
    assert tables.live(c, "2023-12-31 00:00:00").count() == 1 and tables.expired(c, "2024-01-01 00:00:00").count() == 1
    st = tables.report_status(spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string"), spark.createDataFrame([("a", None), ("b", "m")], "run_id string, report string"), spark.createDataFrame([("z", "s")], "run_id string, report string"))
    assert rows(st, "run_id", "status") == [("a", 409), ("b", 200), ("c", 404)]


def test_reports(spark):
    s = ranking.number_signals(signal_rows(spark, {}, {"signal_polarity": "POSITIVE"})).withColumns({"source_snippet": F.lit("q"), "is_unverified": F.lit(True), "source_type": F.lit("NEWS_ARTICLE")})
    block = reports.format_signals(s).first()["block"]
    assert block.startswith("[Signal-1] HIGH | LEGAL | NEGATIVE | conf=0.90") and block.count("[Signal-") == 2 and "UNVERIFIED" in block
    a = spark.createDataFrame([("r", 0, "do", "immediate", ["[Signal-2]", "[Signal-7] [Signal-1]"]), ("r", 1, "watch", "x", [])], "run_id string, action_ord int, description string, priority string, signal_refs array<string>")
    assert rows(reports.map_actions(a, s), "action_ord", "priority", "related_signals") == [(0, "IMMEDIATE", ["s1", "s0"]), (1, "MONITOR", [])]
    sc = scoring.category_scores(s, "run_id")
    r = reports.report_rows(s, sc, scoring.overall_score(sc, "run_id")).withColumn("entity_name", F.lit("A & B"))
    assert "A &amp; B" in reports.as_html(r.first().asDict(recursive=True)) and reports.as_json(r).first()["file_name"] == "a_b_r.json"
    assert reports.sources_consulted(s).count() == 1


def test_pipeline(spark):
    docs = spark.createDataFrame(
        [(1, "r", "Acme", "https://a.com/1", "NEWS_ARTICLE", "There was a data breach at Acme. Growth was fine."), (2, "r", "Acme", "https://b.com/1", "COURT_RECORD", "A lawsuit over fraud."), (3, "q", "Beta", "https://c.com", "NEWS_ARTICLE", "boom"), (4, "q", "Beta", "https://c.com/2", "NEWS_ARTICLE", None)],
        "doc_id long, run_id string, entity_name string, source_url string, source_type string, text string",
    )

    def provider(entity, text):
        if text == "boom":
            raise ValueError("refused")
        return [*pipeline.rule_provider(entity, text), {"text": "made up", "snippet": "this stands nowhere at all", "risk_category": "ESG", "risk_subcategory": "", "severity": "LOW", "signal_polarity": "NEGATIVE", "confidence": 0.9, "data_date": "2024-05"}]

    got = pipeline.run(spark, docs, "2025-01-01", provider)
    reports_ = {r["run_id"]: r for r in got["reports"].collect()}
    assert reports_["r"]["signals_extracted"] == 4 and reports_["r"]["signals_rejected"] == 2 and reports_["r"]["overall"] > 0
    assert reports_["q"]["signals_extracted"] == 0 and reports_["q"]["overall"] == 0.0 and reports_["q"]["summary"].startswith("Based on limited data")
    breach = got["signals"].where("risk_subcategory = 'breach'").first()
    assert breach["severity"] == "MEDIUM" and breach["is_unverified"] and breach["requires_human_review"]


def test_streams(spark, tmp_path):
    schema = "run_id string, kind string, id string, verdict string"
    src = str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(src)
    got = []
    changes = runs.collect_verdicts(spark.readStream.schema(schema).parquet(src), 600)
    q = runs.fan_out(changes, [lambda df, n: got.extend(df.collect())], str(tmp_path / "ck")).start()
    try:
        for k, batch in enumerate(([("r", "ask", "a", None), ("r", "ask", "b", None), ("r", "verdict", "x", "c")], [("r", "verdict", "a", "c")], [("r", "verdict", "b", "dismiss")]), 1):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
            until = time.time() + 90
            while len(got) < k and q.isActive and time.time() < until:
                time.sleep(0.2)
            assert len(got) == k
    finally:
        q.stop()
    assert {(r["status"], r["n_given"]) for r in got} == {("reviewing", 0), ("reviewing", 1), ("complete", 2)}
    assert any(r["verdicts"] == "a=CONFIRMED,b=DISMISSED" for r in got)
    u = spark.createDataFrame([("r", "research"), ("r", "extraction"), ("r", "research")], "run_id string, node string")
    assert rows(runs.progress(u), "run_id", "pct") == [("r", 65)]
    u = spark.createDataFrame([("r", "k", "1", 1), ("r", "k", "2", 2)], "run_id string, key string, value string, seq long")
    assert rows(runs.run_state(u), "run_id", "value") == [("r", "2")]


def test_a_recency_that_is_null_or_0_counts_as_1(spark):
    s = signal_rows(spark, {"severity": "HIGH", "confidence_score": 1.0, "temporal_weight": None}, {"severity": "LOW", "confidence_score": 1.0, "temporal_weight": 0.0})
    assert rows(scoring.category_scores(s), "n", "score") == [(2, 6.0)]


def test_a_better_filer_with_another_first_word_refuses(spark):
    names = spark.createDataFrame([("Global Power Systems",), ("Boeing Company",)], "raw string")
    filers = spark.createDataFrame([("1", "Power Systems Global"), ("2", "Global Power Sys Corp"), ("12927", "BOEING CO")], "cik string, title string")
    assert rows(resolution.match_filers(names, filers), "raw", "cik") == [("Boeing Company", "0000012927")]
    assert rows(resolution.match_filers(names, filers, block=1), "raw", "cik") == [("Boeing Company", "0000012927")]


def test_best_token_sort_is_the_best_of_all():
    import random

    from veritrace.functions import fuzzy

    rng = random.Random(5)
    words = ["ACME", "GLOBAL", "POWER", "BANK", "CO", "INC", "OF", "AMERICA", "SYSTEMS", "ENERGI"]
    names, titles = ([" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(40)] for _ in range(2))
    got = {i: (k, s) for i, k, s in fuzzy.best_token_sort(names, titles, 70.0)}
    for i, x in enumerate(names):
        all_ = [fuzzy.token_sort(x, y) for y in titles]
        assert got.get(i) == ((all_.index(max(all_)), max(all_)) if max(all_) >= 70 else None)


def test_blocks_compare_every_pair_once(spark):
    import numpy as np

    from veritrace.operators import similarity

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6))
    df = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "id long, g int, v array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and u[i] @ u[j] >= 0.3}
    got = [(r["a"], r["b"]) for r in similarity.similar_pairs(df, "g", "id", "v", 0.3).collect()]
    assert len(got) == len(want) and set(got) == want
    assert similarity.similar_pairs(df.limit(0), "g", "id", "v", 0.3).count() == 0


def test_a_review_has_one_deadline(spark, tmp_path):
    import time

    from veritrace.streaming import runs

    schema = "run_id string, kind string, id string, verdict string"
    src, got = str(tmp_path / "in"), []
    spark.createDataFrame([], schema).write.parquet(src)
    q = runs.fan_out(runs.collect_verdicts(spark.readStream.schema(schema).parquet(src), 6), [lambda df, n: got.extend((time.time(), r) for r in df.collect())], str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        asked = [("r", "ask", x, None) for x in "abcdefgh"]
        spark.createDataFrame(asked, schema).coalesce(1).write.mode("append").parquet(src)
        for k in range(8):  # verdicts keep coming, but never all
            if any(r["status"] == "timed_out" for _, r in got) or not q.isActive:
                break
            spark.createDataFrame([("r", "verdict", "abcdefg"[k % 7], "c")], schema).coalesce(1).write.mode("append").parquet(src)
            time.sleep(2.5)
        until = time.time() + 60
        while not any(r["status"] == "timed_out" for _, r in got) and q.isActive and time.time() < until:
            spark.createDataFrame([("other", "ask", "a", None)], schema).coalesce(1).write.mode("append").parquet(src)
            time.sleep(1)
    finally:
        q.stop()
    first = min(t for t, r in got if r["run_id"] == "r")
    ended = [(t, r) for t, r in got if r["run_id"] == "r" and r["status"] == "timed_out"]
    assert ended and ended[0][1]["n_given"] < 8 and ended[0][0] - first < 40
