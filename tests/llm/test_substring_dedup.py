import hashlib
import random

import numpy as np
import pytest

from veritrace.llm import substring_dedup as sd


def plain(rows, k=sd.K):
    """(n_words, n_removed, digest) of every row, by comparing all windows; rows of one doc_id and text are one."""
    words = [sd.words_of(x) for _, x in rows]
    rank = [(d is None, d or 0) for d, _ in rows]
    first = {}
    for w, r in zip(words, rank, strict=True):
        for i in range(len(w) - k + 1):
            s = tuple(w[i : i + k])
            first[s] = min(first.get(s, (r, i)), (r, i))
    out = []
    for w, r in zip(words, rank, strict=True):
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < (r, i) for j in range(i, i + k)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd.dedup(df).collect()), key=repr)
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, plain(rows), strict=True)), key=repr)
    return got


def corpus(seed, n=80, vocabulary=2_000):
    """Documents with shared passages, periodic texts, copies and near copies."""
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(vocabulary)]
    passages = [rng.choices(word, k=rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = rng.choices(word, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        if i % 7 == 0 and rows:
            w = rows[rng.randrange(len(rows))][1].split() + w[:3]
        if i % 9 == 0:
            w += ["a", "b"] * rng.randint(5, 40)
        if i % 11 == 0:
            w += ["the"] * rng.randint(20, 60)
        rows.append((rng.randrange(10_000), " ".join(w)))
    return list({d: (d, x) for d, x in rows}.values())


def test_matches_brute_force(spark):
    got = check(spark, corpus(1))
    assert sum(x[2] for x in got) > 500


@pytest.mark.parametrize("group", [0, 300])
def test_large_buckets_are_cut_again(spark, monkeypatch, group):
    monkeypatch.setattr(sd, "GROUP", group)  # every bucket, or those of over 300 words
    check(spark, corpus(2))


def test_one_passage_in_most_documents(spark):
    """A line shorter than a window in distinct contexts, a passage of 60 words, and copies."""
    rng = random.Random(5)
    line, passage = "this line stands in almost every text of the source".split(), [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = [f"v{rng.randrange(50_000)}" for _ in range(60)]
        w[30:30] = line if i % 3 else passage
        rows.append((i, " ".join(w)))
    rows += [(1_000 + i, rows[0][1]) for i in range(100)]
    check(spark, rows, 8)
    hot, words = sd.common(spark.createDataFrame(rows, "doc long, text string").selectExpr("doc", "1 as th", "text").repartition(2))
    assert len(hot) and b"line" in words


def test_odd_rows(spark, odd, none, texts):
    long = "x" * 3_000_000
    big = [(100, " ".join(["a", "b", long] * 10)), (101, " ".join(f"n{i % 700}" for i in range(300_000)))]
    rows = texts + big + [(None, texts[0][1] + " " + "z " * 30), (None, "q " * 30)]
    check(spark, rows)
    out = sd.dedup(odd)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and out.count() == len(texts) and sd.dedup(none).count() == 0


def test_repeated_rows_lose_nothing_to_themselves(spark):
    text = " ".join(f"w{i}" for i in range(50))
    got = check(spark, [(5, text), (5, text), (5, text), (6, text), (6, text)], 4)
    assert [x[2] for x in got] == [0, 0, 0, 50, 50]


def test_kept_text(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, text), (2, "a  b\n" + text + " c")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in sd.dedup(df, keep_text=True).collect()} == {1: text, 2: "a b c"}


def test_equal_hashes_do_not_make_equal_windows(monkeypatch):
    """With hashes that all agree, windows are still told apart by their words."""
    rows = [[f"{c}{i}".encode() for i in range(22)] for c in "ab"] + [[f"a{i}".encode() for i in range(22)]]
    number = {}
    packed = []
    for k, w in enumerate(rows):
        codes = np.array([number.setdefault(x, len(number) + 1) for x in w])
        b = sd._pack(np.zeros(1, np.uint64), np.array([0]), np.array([22]), codes, [], np.array([k]), np.array([0]), np.array([0]))
        packed += b.column(1).to_pylist()
    monkeypatch.setattr(sd, "mix", lambda x: np.zeros_like(x))
    (b,) = sd.count(packed)
    assert [(x["doc"], x["start"], x["len"]) for x in b.to_pylist()] == [(2, 0, 22)]


def test_minimisers_of_hot_runs_come_last():
    h = sd.hashed([f"w{i}".encode() for i in range(40)])
    runs = sd.run_hashes(h, 4) >> np.uint64(1)
    hot = np.sort(runs[10:12])
    mins = sd.minimisers(h, 4, hot)
    assert len(mins) == 21 and not set((hot | np.uint64(1 << 63)).tolist()) & set(mins.tolist())
    want = [min(x for x in runs[i : i + 17].tolist() if x not in hot) for i in range(21)]
    assert mins.tolist() == want
