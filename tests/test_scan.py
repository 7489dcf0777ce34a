"""Scans, selection, inverted lists and lexical matches against plain programs."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrace.functions import fuzzy
from veritrace.operators import evaluation, ranking, scan, similarity


def test_running_sums_of_a_hot_group(spark):
    """One group has nine rows of ten; null groups and null values count."""
    rng = random.Random(1)
    rows = [(None if i % 97 == 0 else "hot" if i % 10 else f"g{i % 7}", i, None if i % 31 == 0 else rng.randint(-5, 9)) for i in range(3_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, x int").repartition(4)
    got = {r["k"]: (r["n"], r["s"]) for r in scan.running(df, ["g"], ["k"], {"s": F.col("x")}, "n").collect()}
    want, last = {}, {}
    for g, k, x in sorted(rows, key=lambda r: r[1]):
        n, s = last.get(g, (0, 0))
        want[k] = last[g] = (n + 1, s + (x or 0))
    assert got == want
    assert scan.running(df.limit(0), ["g"], ["k"], {"s": F.col("x")}, "n").count() == 0


def test_a_hot_group_is_several_ranges(spark, monkeypatch):
    seen = []
    keep = scan.materialize
    monkeypatch.setattr(scan, "materialize", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(2_000).selectExpr("'one' g", "id k")
        assert scan.running(df, ["g"], ["k"], {}, "n").where("n <> k + 1").count() == 0
        ranges = [r["n"] for r in seen[0].groupBy(F.shiftright("_place", 33)).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) > 1 and max(ranges) < 1_500


def test_guardrail_adds_before_it_divides_and_counts_peers(spark):
    """As the SQL of guardrail_trip: sum(value) / 1000, equal order counts together, nulls come last and are no cost."""
    rows = [("tenths", i, 100.0) for i in range(10)] + [("peers", 1, 600.0), ("peers", 1, 600.0), ("peers", 2, 1.0), ("null", 1, None), ("null", None, 9.0), ("null", 2, 1000.0)]
    out = ranking.guardrail_trip(spark.createDataFrame(rows, "run string, at int, value double"), "run", ["at"], "value", 1000)
    got = sorted((r["run"], r["at"] is None, r["at"] or 0, r["calls"], r["cost"], r["halted"]) for r in out.collect())
    tenths = [x for x in got if x[0] == "tenths"]
    assert tenths[-1][3:] == (10, 1.0, True) and not any(x[5] for x in tenths[:-1])
    assert [x[3:] for x in got if x[0] == "peers"] == [(2, 1.2, True), (2, 1.2, True), (3, 1.201, True)]
    assert [x[2:] for x in got if x[0] == "null"] == [(1, 1, None, None), (2, 2, 1.0, True), (0, 3, 1.009, True)]


@pytest.mark.parametrize("few", [3, 50, 10_000])
def test_percentiles_by_selection(spark, monkeypatch, few):
    monkeypatch.setattr(scan, "FEW", few)
    monkeypatch.setattr(scan, "BINS", 4)
    rng = random.Random(few)
    groups = {"normal": [rng.gauss(0, 1) for _ in range(400)], "two": [0.0] * 150 + [1.0] * 151, "same": [7.0] * 200, "wide": [10.0 ** rng.randint(-300, 300) for _ in range(99)] + [-1.7e308, 1.7e308], "single": [3.0], None: [float(i) for i in range(120)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("single", None), ("single", math.nan), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {(r["g"], r["q"]): (r["n"], r["percentile"]) for r in scan.percentiles(df, ["g"], "x", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert {g for g, _ in got} == set(groups)
    for (g, q), (n, p) in got.items():
        assert n == len(groups[g]) and p == pytest.approx(float(np.percentile(groups[g], 100 * q)), rel=1e-9)
    assert got["two", 0.5][1] == statistics.median(groups["two"])


def test_average_precision_with_hits_only_or_none(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, False), ("c", 1, None), ("c", 2, True)], "q string, k int, rel boolean")
    assert {r["q"]: r["ap"] for r in evaluation.average_precision(df, ["q"], ["k"], "rel").collect()} == {"a": 1.0, "b": 0.0, "c": 0.5}


def test_consistency_matches_brute_force(spark):
    rng = random.Random(4)
    runs = [(f"s{i % 6}", i, [f"k{x}" for x in rng.sample(range(12), rng.randint(0, 4))]) for i in range(40)] + [("alone", 1, ["k"]), ("null", 1, None), ("null", 2, []), ("null", 3, ["k"])]
    df = spark.createDataFrame(runs, "s string, r int, k array<string>")
    got = {r["s"]: (r["pairs"], r["mean_jaccard"], r["min_jaccard"]) for r in similarity.consistency(df, "s", "r", "k").collect()}
    for s in {x for x, _, _ in runs}:
        own = [set(k or []) for x, _, k in runs if x == s]
        j = [len(a & b) / len(a | b) if a | b else 1.0 for i, a in enumerate(own) for b in own[:i]]
        want = (len(j), pytest.approx(sum(j) / len(j)), pytest.approx(min(j))) if j else (0, None, None)
        assert got[s] == want


@pytest.mark.parametrize(("block", "keys"), [(7, 3), (7, 400), (4_000, 400)])
def test_consistency_of_many_runs_has_no_row_a_pair(spark, monkeypatch, block, keys):
    """Runs of a subject meet in blocks, of which a row leaves each two; common and rare keys, one key in all, no common key."""
    monkeypatch.setattr(similarity, "RUNS", block)
    made = []
    keep = similarity.meet_within
    monkeypatch.setattr(similarity, "meet_within", lambda *a: made.append(keep(*a)) or made[-1])
    rng = random.Random(keys)
    runs = [("hot", i, [f"k{rng.randrange(keys)}" for _ in range(rng.randint(1, 5))] + (["all"] if keys > 3 and i else [])) for i in range(50)] + [("apart", i, [f"only{i}"]) for i in range(9)] + [(None, i, ["x"]) for i in range(3)]
    runs += [("holes", 1, ["a", None]), ("holes", 2, [None, "b"])]
    got = {r["s"]: (r["pairs"], r["mean_jaccard"], r["min_jaccard"]) for r in similarity.consistency(spark.createDataFrame(runs, "s string, r int, k array<string>"), "s", "r", "k").collect()}
    assert got[None] == (0, None, None)
    for s in ("hot", "apart", "holes"):
        own = [set(k) for x, _, k in runs if x == s]
        j = [len(a & b) / len(a | b) for i, a in enumerate(own) for b in own[:i]]
        assert got[s] == (len(j), pytest.approx(sum(j) / len(j)), pytest.approx(min(j)))
    n = -(-50 // block)
    assert 1 <= made[0].where("s = 'hot'").count() <= n * (n + 1) // 2


def test_all_windows_come_of_one_pass():
    rng = random.Random(2)
    text = lambda n, k: "".join(rng.choice("abcdé日fg"[:k]) for _ in range(n))
    for _ in range(400):
        k = rng.choice([2, 4, 8])
        a, b = sorted((text(rng.randint(1, 15), k), text(rng.randint(1, 40), k)), key=len)
        n, m = len(a), len(b)
        head, windows, tail = fuzzy.window_lcs(a, b)
        assert head.tolist() == [fuzzy.lcs(a, b[:j]) for j in range(n + 1)]
        assert windows.tolist() == [fuzzy.lcs(a, b[i : i + n]) for i in range(m - n + 1)]
        assert tail.tolist() == [fuzzy.lcs(a, b[m - n + j :]) for j in range(n + 1)]
        assert fuzzy.partial(a, b) == pytest.approx(max(fuzzy.ratio(a, b[max(i, 0) : min(i + n, m)]) for i in range(1 - n, m)))
    assert fuzzy.partial("", "a") == 0.0 and fuzzy.partial("b", "abc") == 100.0


def test_many_pairs_are_combed_side_by_side():
    """The same scores as one by one, for texts of like and unlike lengths and many letters."""
    rng = random.Random(12)
    text = lambda n, k: "".join(rng.choice("ab cdé日fg"[:k]) for _ in range(n))
    pairs = [(text(rng.randint(0, 40), k), text(rng.randint(0, 70), k)) for k in (2, 5, 10) for _ in range(150)]
    pairs += [("".join(map(chr, range(300, 300 + n))), "".join(map(chr, range(290, 290 + 2 * n, 2)))) for n in (10, 400)]
    assert fuzzy.partials(pairs) == [fuzzy.partial(a, b) for a, b in pairs]
    rows = [{"text": " ".join(t), "words": set(t), "keys": rng.choice([t, t, [], None])} for t in ([rng.choice(["fire", "tax", "in", "the", "river", "plant"]) for _ in range(rng.randint(0, 6))] for _ in range(60))]
    both = [(a, b) for a in rows for b in rows]

    def one(p, t):
        shared = len(set(p["keys"] or []) & set(t["keys"] or []))
        return max(fuzzy.token_set(p["text"], t["text"]), fuzzy.partial(p["text"], t["text"]), shared / min(len(t["keys"]), 12) * 100 if shared >= 2 else 0.0)

    assert fuzzy.match_scores(both) == [one(a, b) for a, b in both]


def test_lexical_matches_of_a_hot_run_in_blocks(spark, monkeypatch):
    rng = random.Random(13)
    words = ["plant", "fire", "tax", "in", "the", "lawsuit", "river", "of", "bank"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(1, 7)))
    truth, pred = ([(f"r{i // 90}", i, text()) for i in range(100)] for _ in range(2))
    t, p = spark.createDataFrame(truth, "run_id string, truth_id int, text string"), spark.createDataFrame(pred, "run_id string, pred_id int, text string")
    whole = [sorted(map(tuple, f(t, p).collect()), key=str) for f in (evaluation.lexical_matches, evaluation.lexical_truths)]
    for name, n in (("SIDE", 7), ("PAIRS", 300), ("AT_ONCE", 50)):
        monkeypatch.setattr(evaluation, name, n)
    assert [sorted(map(tuple, f(t, p).collect()), key=str) for f in (evaluation.lexical_matches, evaluation.lexical_truths)] == whole


def test_lexical_matches(spark):
    truth = [("r", 1, "tax hit", "https://a.com/x"), ("r", 2, "factory fire in the northern plant", None), ("r", 3, "zzz", "https://www.b.org/1"), ("q", 4, "tax hit", "https://a.com/x"), ("r", 5, None, None)]
    pred = [("r", 10, "big tax hit", None), ("r", 11, "fire at northern factory plant", "https://c.net"), ("r", 12, "other words", "http://b.org/2"), ("r", 13, "words", "no url")]
    t = spark.createDataFrame(truth, "run_id string, truth_id int, text string, source_url string")
    p = spark.createDataFrame(pred, "run_id string, pred_id int, text string, source_url string")
    got = {r["truth_id"]: r for r in evaluation.lexical_matches(t, p).collect()}
    assert (got[1]["pred_id"], got[1]["score"], got[1]["found"]) == (10, 100.0, True)  # short words count
    assert got[2]["pred_id"] == 11 and got[2]["found"]
    assert (got[3]["pred_id"], got[3]["score"], got[3]["found"]) == (12, 55.0, True)  # one host
    assert (got[4]["pred_id"], got[4]["score"], got[4]["found"]) == (None, 0.0, False)  # another run
    assert (got[5]["score"], got[5]["found"]) == (0.0, False)
    back = {r["pred_id"]: (r["truth_id"], r["matched"]) for r in evaluation.lexical_truths(t, p).collect()}
    assert back == {10: (1, True), 11: (2, True), 12: (3, True), 13: (None, False)}


def test_lexical_scores_match_brute_force_over_pairs_with_a_word(spark):
    rng = random.Random(6)
    words = ["plant", "fire", "tax", "in", "the", "lawsuit", "river", "of", "bank"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(1, 7)))
    truth, pred = [("r", i, text()) for i in range(12)], [("r", i, text()) for i in range(15)]
    t, p = spark.createDataFrame(truth, "run_id string, truth_id int, text string"), spark.createDataFrame(pred, "run_id string, pred_id int, text string")
    pairs = t.withColumnRenamed("text", "tt").join(p, "run_id").select("truth_id", "pred_id", "tt", "text", fuzzy.match_score("text", "tt").alias("s")).collect()
    best = {}
    for r in pairs:
        if set(r["tt"].split()) & set(r["text"].split()):
            best[r["truth_id"]] = max(best.get(r["truth_id"], (0.0, 0)), (r["s"], -r["pred_id"]))
    got = {r["truth_id"]: (r["score"], r["pred_id"]) for r in evaluation.lexical_matches(t, p).collect()}
    assert {k: (s, -i) for k, (s, i) in best.items()} == {k: v for k, v in got.items() if v[1] is not None}
