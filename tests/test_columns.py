import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrace.functions import columns as C
from veritrace.functions import fuzzy


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: C.normalize_text(F.lit("  Hello,   WORLD!!  (test)\n")), "hello world test"),
        (lambda: C.normalize_text(F.lit(None).cast("string")), ""),
        (lambda: C.registrable_domain(F.lit("http://sub.a.reuters.co.uk/y")), "reuters.co.uk"),
        (lambda: C.registrable_domain(F.lit("https://x/0")), "x"),
        (lambda: C.registrable_domain(F.lit("HTTPS://www.Example.com:8080/a")), "example.com"),
        (lambda: C.registrable_domain(F.lit("https://www.example.com./x")), "example.com"),
        (lambda: C.registrable_domain(F.lit("https://a.example.com:8080x/y")), "example.com"),
        (lambda: C.registrable_domain(F.lit("ftp://a.example.com/y")), "ftp"),
        (lambda: C.registrable_domain(F.lit("a..example.co.uk")), "example.co.uk"),
        (lambda: C.registrable_domain(F.lit(None).cast("string")), ""),
        (lambda: C.retryable(F.lit("HTTP 502 Bad Gateway")), True),
        (lambda: C.retryable(F.lit("model is overloaded")), True),
        (lambda: C.retryable(F.lit("504")), True),
        (lambda: C.retryable(F.lit("400 bad request")), False),
        (lambda: C.step_index(F.lit("error")), -1),
        (lambda: C.step_index(F.lit("unheard of")), 0),
        (lambda: C.confidence_factor(F.lit(1.0), F.lit(1)), 1.0),
        (lambda: F.round(C.confidence_factor(F.lit(0.35), F.lit(1)), 9), 0.61),
        (lambda: F.round(C.confidence_factor(F.lit(0.35), F.lit(3)), 9), 0.79),
        (lambda: C.filer_name(F.lit("Colgate-Palmolive Co.")), "COLGATE PALMOLIVE CO"),
        (lambda: C.filer_name(F.lit("Société, S.A.")), "SOCIÉTÉ S A"),
        (lambda: C.strip_suffix(F.lit("Acme Widgets, Inc.")), "Acme Widgets"),
        (lambda: C.aliases(F.lit("ACME INC"), F.lit("Acme Inc"), F.array(F.lit("ACM"), F.lit(""))), ["ACME INC", "Acme Inc", "ACME", "Acme", "ACM"]),
        (lambda: C.data_date(F.lit("2025-02-30")), None),
        (lambda: C.data_date(F.lit("2025-2")), datetime.date(2025, 2, 1)),
        (lambda: C.data_date(F.lit("2025-02-03-99")), datetime.date(2025, 2, 3)),
        (lambda: C.data_date(F.lit("soon")), None),
        (lambda: C.pad_cik(F.lit(" 0012927 ")), "0000012927"),
        (lambda: C.dashed_accession(F.lit("000119312524000123")), "0001193125-24-000123"),
        (lambda: C.dashed_accession(F.lit("abc")), "abc"),
        (lambda: C.slug(F.lit("--Acme & Co.--")), "acme_co"),
        (lambda: C.slug(F.lit("!!")), "entity"),
        (lambda: C.source_type(F.lit("https://www.sec.gov/x"), F.lit("Acme")), "SEC_FILING"),
        (lambda: C.source_type(F.lit("https://www.acmeworld.com/x"), F.lit("Acme, Inc")), "NEWS_ARTICLE" if len("acme") <= 3 else "COMPANY_WEBSITE"),
        (lambda: C.credibility_tier(F.lit("NEWS_ARTICLE"), F.lit("https://a.substack.com/p")), "LOW"),
        (lambda: C.credibility_tier(F.lit("NEWS_ARTICLE"), F.lit("https://uk.reuters.com/p")), "ESTABLISHED"),
        (lambda: C.temporal_weight(F.lit(None).cast("date"), "2025-01-01"), 0.7),
        (lambda: C.temporal_weight(F.lit("2026-01-01").cast("date"), "2025-01-01"), 1.0),
        (lambda: C.temporal_weight(F.lit("1990-01-01").cast("date"), "2025-01-01"), 0.3),
        (lambda: C.effective_severity(F.lit("HIGH"), F.lit(0.0), F.lit(0.5)), 0.4),
        (lambda: C.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), 1.0),
        (lambda: C.mentions(F.lit("all about ACME corp"), C.binding_names(F.lit("Acme"), F.array(F.lit("BA")))), True),
        (lambda: C.mentions(F.lit("nothing"), C.binding_names(F.lit("BA"), F.array().cast("array<string>"))), True),
        (lambda: C.verdict(F.lit(" Dismiss ")), "DISMISSED"),
        (lambda: C.citations(F.lit("a [Signal-3] b [Signal-12] [Signal-3]")), [3, 12, 3]),
        (lambda: C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), 0.0),
        (lambda: C.guardrail_exceeded(F.lit(50), F.lit(0.0), F.lit(0.0)), True),
        (lambda: C.guardrail_compliant(F.lit(50), F.lit(1.0)), True),
        (lambda: C.anchor_verdict(F.lit(84.9)), "FLAG"),
        (lambda: C.key_tokens(F.lit("Boeing door plug blowout, door PLUG since")), ["door", "plug", "blowout"]),
    ],
)
def test_values(spark, column, want):
    assert value(spark, column()) == want


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_ratios_agree_with_plain_programs(a, b):
    assert fuzzy.lcs(a, b) == plain_lcs(a, b)
    if a and b:
        s, t = (a, b) if len(a) <= len(b) else (b, a)
        windows = [t[max(i, 0) : i + len(s)] for i in range(1 - len(s), len(t))]
        assert abs(fuzzy.partial(a, b) - max(200 * plain_lcs(s, w) / (len(s) + len(w)) for w in windows)) < 1e-9
    assert 0 <= fuzzy.token_set(a, b) <= 100 and fuzzy.token_sort(a, b) == fuzzy.token_sort(b, a)


def test_pages_lose_scripts_and_tags(spark):
    page = "<html><head><title>no</title></head><body>One &amp; <b>two</b><script>x()</script><nav>menu</nav> three</body>"
    assert fuzzy.plain_text(page) == "One & two three"
    assert fuzzy.plain_text(None) == ""
    got = spark.createDataFrame([(page,), (None,)], "p string").select(fuzzy.html_to_text("p").alias("t")).collect()
    assert [r["t"] for r in got] == ["One & two three", ""]


def test_nested_values_flatten(spark):
    d = spark.createDataFrame([('{"a": "x", "b": {"c": ["y", "", "z"]}}',), ("plain",), (None,)], "j string")
    assert [r["t"] for r in d.select(fuzzy.flatten_json("j").alias("t")).collect()] == ["x, y, z", "plain", ""]


def test_scores_of_quotes(spark):
    rows = [("The door plug blew out", "We know: the door plug, blew out."), ("door plug blew owt", "the door plug blew out"), ("", "x"), ("zzzz", "abcd efgh")]
    got = [r["s"] for r in spark.createDataFrame(rows, "a string, b string").select(fuzzy.anchor_score("a", "b").alias("s")).collect()]
    assert got[0] == 100 and 90 < got[1] < 100 and got[2] == 0 and got[3] == 0
