import json

from pyspark.sql import functions as F

from veritrace.sources import connectors

ROWS = [
    {"form": "10-K", "filed": "2023-02-01", "pages": 120}, {"form": "10-Q", "filed": "2023-05-01", "pages": 40},
    {"form": "10-K", "filed": "2024-02-01", "pages": 130}, {"form": "8-K", "filed": "2024-03-01", "pages": 3}, {"form": None, "filed": "none", "pages": "x"},
]
COLUMNS = {"form": "string", "filed": "date", "pages": "long"}


def asking(path, obeys):
    """A service that notes what it is asked for, and obeys a filter on form or not."""

    def fetch(r):
        with open(path, "a") as f:
            f.write(json.dumps(r) + "\n")
        if r["q"] == "bad":
            return {"error": "not_found", "message": "no"}
        want = [v for c, how, v in r.get("filters", []) if (c, how) == ("form", "=")]
        return [x for x in ROWS if not (obeys and want) or x["form"] == want[0]]

    return fetch


def test_filters_reach_the_fetch_and_none_is_left(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for obeys in (True, False):
            log = tmp_path / f"asked-{obeys}"
            scan = connectors.searched(spark, f"filings_{obeys}".lower(), asking(str(log), obeys), COLUMNS, wait=0.0)
            df = scan([{"q": "a"}, {"q": "bad"}]).where("form = '10-K' and filed >= date'2024-01-01' and pages in (3, 130)")
            assert [(r["form"], str(r["filed"]), r["pages"], json.loads(r["payload"])["pages"]) for r in df.collect()] == [("10-K", "2024-02-01", 130, 130)]
            assert "Filter" not in df._jdf.queryExecution().optimizedPlan().toString().replace("filters", "")
            asked = [json.loads(x) for x in log.read_text().splitlines()]
            assert {r["q"] for r in asked} == {"a", "bad"}
            assert all(sorted(map(str, r["filters"])) == sorted(map(str, [["form", "=", "10-K"], ["filed", ">=", "2024-01-01"], ["pages", "in", [3, 130]]])) for r in asked)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_what_is_no_comparison_stays_with_spark(spark, tmp_path):
    scan = connectors.searched(spark, "filings_rest", asking(str(tmp_path / "asked"), False), COLUMNS, wait=0.0)
    assert scan([{"q": "a"}]).where(F.length("form") == 3).count() == 1
    assert scan([{"q": "a"}]).where("pages > 100").count() == 2
    rows = scan([{"q": "a"}, {"q": "bad"}]).collect()
    assert len(rows) == 6 and [r["error"] for r in rows if r["error"]] == ["not_found"]
    assert scan([{"q": "a"}]).where("filed is null and form is null and pages is null").count() == 1
