import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from veritrace.llm import resampling as rs


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(rows, target, percent=5, least=20):
    """(doc_id, n_features, weight, score) of every row, and the drawn rows in order."""
    count = lambda texts: np.bincount([zlib.crc32(f.encode()) % 10_000 for x in texts for f in grams(x)[1]], minlength=10_000)
    s, t = count([x for _, x in rows]), count(target)
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10_000) / ((a + 1) * (T + 10_000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out, fit = [], []
    for d, x in rows:
        w, f = grams(x)
        weight = sum(gain[zlib.crc32(y.encode()) % 10_000] for y in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        if len(w) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, fit[: percent * len(fit) // 100]


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(-(1 << 62), 1 << 62), " ".join(rng.choices(["Alpha", "beta", "été", "d4", "x-y", "gamma", "日本"], k=rng.randint(0, 60)))) for _ in range(n)]


def check(spark, rows, target, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rs.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), **how).collect()
    out, drawn = plain(rows, target, **{"percent": how.get("percent", 5)})
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(out, key=repr)
    assert [tuple(r)[:4] for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(drawn) + 1))


@pytest.mark.parametrize("percent", [5, 37, 100, 0])
def test_matches_brute_force(spark, percent):
    check(spark, corpus(300), ["alpha beta alpha beta", "gamma d4"], percent=percent)


def test_odd_rows(spark, odd, none, texts):
    check(spark, texts + corpus(50) + [(None, "word " * 500), (77, "y" * 2_000_000 + " word" * 300_000)], ["the word", None, ""], percent=30)
    assert rs.resample(none, none).count() == 0 and rs.resample(odd, none).count() == len(texts)
    assert rs.resample(odd, odd).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_repeated_rows_are_drawn_each(spark):
    rows = [(7, "alpha beta " * 15)] * 40 + [(8, "gamma " * 30)] * 3
    check(spark, rows, ["alpha"], percent=50)


def test_thresholds_find_the_kth_of_any_longs(spark):
    rng = random.Random(2)
    values = [-(1 << 63), (1 << 63) - 1, 0, 0, 0, 5] + [rng.randrange(-(1 << 63), 1 << 63) for _ in range(50)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, row long")
    for k in (1, 2, 28, 29, 30, 55, 56):
        v, less, same = rs.first_value(df, "v", k)
        assert v == sorted(values)[k - 1] and less == sum(x < v for x in values) and same == values.count(v)
    df = df.withColumn("v", (df["v"] > 0).cast("long"))
    for k in (1, 10, 40):
        assert df.where(rs.is_first(df, ["v", "row"], k)).count() == k
