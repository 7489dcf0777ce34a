from itertools import permutations

import numpy as np

from veritrace.llm import filter_audit as fa


def failing(rows):
    out = []
    for d, text, _ in rows:
        t = text or ""
        w = t
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)) + "D" * any(c in t for c in "#$%&*|")
        out.append(set(f) | set("E" * (d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows))))
    return out


def plain(rows, labels):
    """Every order applied filter by filter to lists of rows (doc_id, text, lang)."""
    fails, good, toxic = failing(rows), {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    want, shapley = {}, {}
    for part in {x or "" for _, _, x in rows}:
        own = [(d, f) for (d, _, x), f in zip(rows, fails, strict=True) if (x or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in own) - len(gone)
                want[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def check(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in NAMES) for r in fa.audit(docs, told).collect()}
    assert got == plain(rows, labels)


def test_matches_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(210))
    texts = ["", None, "a b c", "A B C", "x " * 300, long, long + " #", long.upper(), "été " * 5, long + " É" * 100, "one two\x0bthree", "AAA é" * 70, "A" + "b" * 32 + "é"]
    rows = [(i % 23 if i % 31 else None, texts[i * i % len(texts)], ("en", "de", None, "")[i % 4]) for i in range(160)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(20)]
    check(spark, rows, [(a, b, int(c)) for a, b, c in labels] + [(3, 0, 1), (4, 1, None), (None, 1, 1), (5, None, 0)])


def test_capitals_count_by_code_points():
    assert fa.failures(b"A" + "é".encode() * 32) & 4 and not fa.failures(b"A" + "é".encode() * 33) & 4


def test_walk_is_that_of_every_subset():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (fa.CELLS, 3, 2))
    want = [sum(counts[m] for m in range(fa.CELLS) if not m & s) for s in range(fa.CELLS)]
    assert (fa.gray_walk(counts) == np.array(want)).all()


def test_odd_rows(spark, odd, none, texts):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = fa.audit(odd, labels).collect()
    assert len(out) == 600 and all(r["part"] == "" and r["kept"] + r["removed"] + r["redundant"] <= len(texts) for r in out)
    assert fa.audit(none, labels).count() == 0
    big = spark.createDataFrame([(1, "x" * 5_000_000, "en"), (2, "word " * 1_000_000, "en")], "doc_id long, text string, lang string")
    assert {r["kept"] for r in fa.audit(big, labels).where("step = 5").collect()} == {0}


def test_many_parts(spark):
    rows = [(i, "a b c", f"p{i % 200}") for i in range(400)]
    check(spark, rows, [(1, 1, 1)])
