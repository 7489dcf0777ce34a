"""The composed run: grading by knowledge, written parts, one budget of calls."""

from pyspark.sql import functions as F

from veritrace.functions import fixed
from veritrace.plans import pipeline

DOCS = "doc_id long, run_id string, entity_name string, source_url string, source_type string, text string"


def documents(spark):
    return spark.createDataFrame(
        [(1, "r", "Acme", "https://a.com/1", "NEWS_ARTICLE", "There was a data breach at Acme. Growth was fine."), (2, "r", "Acme", "https://b.com/1", "COURT_RECORD", "A lawsuit over fraud."), (3, "q", "Beta", "https://c.com", "NEWS_ARTICLE", "nothing to see")], DOCS
    )


def test_knowledge_grades_and_the_report_is_written(spark):
    files = spark.createDataFrame([("rubric", "# Breach\n\na data breach at a firm is INFO INFO INFO\n\n# Fraud\n\na lawsuit over fraud is INFO INFO")], "source string, text string")
    k = pipeline.knowledge_pieces(files)
    assert [r["item"] for r in k.orderBy("item").collect()] == ["rubric#000000", "rubric#000001"]
    got = pipeline.run(spark, documents(spark), "2025-01-01", knowledge=k)
    s = got["signals"].collect()
    assert s and {x["severity"] for x in s} == {"INFO"}
    r = {x["run_id"]: x for x in got["reports"].collect()}
    assert set(r["r"]["sections"]) == {x["risk_category"] for x in s if x["signal_polarity"] != "POSITIVE"}
    assert "areas of risk" in r["r"]["summary"] and r["r"]["strengths"] == "1 strengths"
    assert {a["description"] for a in r["r"]["actions"]} == {f"Look into {c}" for c in r["r"]["sections"]} and all(a["related_signals"] for a in r["r"]["actions"])
    first = min(s, key=lambda x: x["signal_num"])
    assert r["r"]["sources"][0]["url"] == first["source_url"] and {x["url"] for x in r["r"]["sources"]} == {x["source_url"] for x in s}
    assert r["q"]["sections"] is None and r["q"]["summary"].endswith("No material risk signals were identified from the available data sources.")
    assert {x["run_id"]: x["calls"] for x in got["calls"].collect()} == {"r": 2 + len(s), "q": 1}


def test_a_failed_section_is_its_own(spark):
    def section(category, entity, block):
        if category == "LEGAL":
            raise ValueError("refused")
        return f"about {category}"

    got = pipeline.run(spark, documents(spark), "2025-01-01", section=section)
    r = got["reports"].where("run_id = 'r'").first()
    assert "LEGAL" not in r["sections"] and set(r["sections"].values()) == {f"about {c}" for c in r["sections"]}


def test_extraction_grading_and_writing_share_the_budget(spark):
    most = fixed.MAX_CALLS - fixed.RESERVED_CALLS
    rows = [(i, "r", "Acme", f"https://a{i}.com/", "NEWS_ARTICLE", "A breach of data." if i == 0 else "A fraud.") for i in range(most - 1)]
    rows += [(i, "s", "Beta", f"https://a{i}.com/", "NEWS_ARTICLE", "A breach of data.") for i in range(1000, 1000 + most + 9)]
    k = pipeline.embed(spark.createDataFrame([("x", "INFO INFO INFO INFO")], "item string, text string"))
    got = pipeline.run(spark, spark.createDataFrame(rows, DOCS), "2025-01-01", knowledge=k)
    calls = {x["run_id"]: x["calls"] for x in got["calls"].collect()}
    assert calls == {"r": most, "s": most}  # one signal of r is graded, none of s
    graded = {x["run_id"]: x["n"] for x in got["signals"].groupBy("run_id").agg(F.count_if(F.col("severity") == "INFO").alias("n")).collect()}
    assert graded == {"r": 1, "s": 0}
