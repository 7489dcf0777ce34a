import random

import pytest

from veritrace.functions import fuzzy
from veritrace.operators import resolution
from veritrace.operators.blocks import meet


def plain(names, filers, cutoff=70.0):
    """The best of all filers for each name, by comparing all with all."""
    out = {}
    for x in names:
        q = " ".join(x.upper().split())
        best = min(((-fuzzy.token_sort(q, t.upper()), c, t.upper()) for c, t in filers), default=None)
        if best and -best[0] >= cutoff and q.split(" ")[0] == best[2].split(" ")[0]:
            out[x] = (best[1].lstrip("0").rjust(10, "0"), best[2], -best[0])
    return out


def made(seed, n, words):
    rng = random.Random(seed)
    pick = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    torn = lambda x: "".join(c for c in x if rng.random() > 0.07) or "A"
    filers = [(str(i), pick()) for i in range(n)]
    names = {torn(t) for _, t in rng.sample(filers, n // 3)} | {pick() for _ in range(n // 4)} | {"A", "FIRST"}
    return sorted(x.strip() for x in names if x.strip()), filers


@pytest.mark.parametrize(("seed", "block", "words"), [(1, 2_000, "ACME GLOBAL POWER BANK FIRST OF AMERICA SYSTEMS ENERGI"), (2, 7, "FIRST NATIONAL BANK CO TRUST"), (3, 25, "A AB ABC BCA CAB ACB BA")])
def test_match_filers_is_the_best_of_all(spark, seed, block, words):
    names, filers = made(seed, 150, words.split())
    n, f = spark.createDataFrame([(x,) for x in names], "raw string"), spark.createDataFrame(filers, "cik string, title string")
    got = {r["raw"]: (r["cik"], r["title"], r["score"]) for r in resolution.match_filers(n, f, block=block).collect()}
    want = plain(names, filers)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} and len(got) > 10
    assert all(got[k][2] == pytest.approx(want[k][2]) for k in got)


def test_every_rival_has_a_key(spark):
    names, filers = made(4, 120, "NORTHERN STAR HOLDING UNITED MARINE WORKS".split())
    n = spark.createDataFrame([(x, x, least) for x in names for least in (70.0, 85.0, 95.0, 100.0)], "raw string, q string, least double").withColumn("raw", resolution.F.concat("raw", resolution.F.col("least").cast("string")))
    f = spark.createDataFrame(filers, "cik string, title string")
    keys = {}
    for r in resolution.rival_keys(n, f).collect():
        keys.setdefault((r["q"], r["least"]), set()).add(r["gram"])
    assert len(keys) == 4 * len(names)
    for (q, least), grams in keys.items():
        if None in grams:
            assert grams == {None}
            continue
        for _, t in filers:
            own = " ".join(sorted(t.split()))
            if fuzzy.token_sort(q, t) >= least:
                assert any(g in own for g in grams), (q, t, least)
    tight = [len(g) for (q, least), g in keys.items() if least == 95.0 and len(q) > 15]
    assert tight and max(tight) < 8  # few of some 20 pairs


def test_empty_and_null_names(spark):
    f = spark.createDataFrame([("1", "ACME CO"), ("2", None), (None, "ACME CO")], "cik string, title string")
    n = spark.createDataFrame([(None,), ("",), ("acme co",)], "raw string")
    assert {r["raw"] for r in resolution.match_filers(n, f).collect()} == {"acme co"}
    assert resolution.match_filers(n, f.limit(0)).count() == 0 and resolution.match_filers(n.limit(0), f).count() == 0


def test_blocks_follow_each_group(spark):
    """A small group beside a large one is one block, and every pair of a group meets once."""
    x = spark.createDataFrame([("a", i) for i in range(60)] + [("b", 100), ("only", 101), (None, 102)], "g string, i long")
    y = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 100), (None, 102)], "g string, j long")

    def pairs(a, b):
        return a[["g", "i"]].merge(b[["g", "j"]], on="g").assign(most=max(len(a), len(b)))

    got = [(r["g"], r["i"], r["j"]) for r in meet(x, y, pairs, "g string, i long, j long, most long", ("g",), 10).collect()]
    assert len(got) == len(set(got)) and set(got) == {("a", i, j) for i in range(60) for j in range(30)} | {("b", 100, 100)}
