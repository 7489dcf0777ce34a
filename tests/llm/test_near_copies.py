import random
import re

import numpy as np

import corpus_pipeline
from veritrace.llm import near_copies as nc
from veritrace.llm.simhash import plan_wide


def plain(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def test_shingles_are_sets():
    for x in ("a b c d e f g a b c d e", "a b", "", " \n", "A B"):
        assert len(nc.shingles(x)) == len(plain(x))
    assert nc.shingles(None).size == 0 and (nc.shingles("a b") == nc.shingles("A  B")).all()


def test_wide_fingerprints_are_majorities():
    rng = np.random.default_rng(2)
    for n in (1, 2, 255, 256, 1000):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64)
        got = nc.wide_fingerprint(h)
        for k in (0, 7):
            with np.errstate(over="ignore"):
                own = nc.mix(h ^ nc.mix(np.array([k + 1], np.uint64) << np.uint64(32)))
            assert int(got[k]) == sum(1 << j for j in range(64) if 2 * int((own >> np.uint64(j) & np.uint64(1)).sum()) > n)


def test_plan_misses_few_pairs(spark):
    """Pairs of sets at Jaccard 0.8 that share no probed value, against the stated share."""
    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(1_500):
        x = rng.integers(0, 1 << 63, 330).astype(np.uint64)
        pairs.append((nc.wide_fingerprint(x[:300]), nc.wide_fingerprint(np.concatenate((x[:267], x[300:])))))  # 267 of 333
    df = spark.createDataFrame([(x.view(np.int64).tolist(),) for p in pairs for x in p], "fp array<long>")
    plan = plan_wide(df, 0.8)
    key = lambda x: [int(x[word]) & mask for word, mask, _ in plan]
    near = lambda a, b: any(int(u ^ v).bit_count() <= t for u, v, (_, _, t) in zip(key(a), key(b), plan, strict=True))
    assert np.mean([near(a, b) for a, b in pairs]) >= 0.985 and np.mean([int(a[0] ^ b[0]).bit_count() <= nc.FAR for a, b in pairs]) >= 0.995


def test_near_copies_of_medium_length_go(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5_000)]
    rows, want = [], set()
    for k in range(60):
        base = rng.choices(vocabulary, k=300)
        rows.append((len(rows), " ".join(base)))
        want.add(len(rows) - 1)
        for changes in (1, 3, 5, 20):  # similarity about 0.97, 0.91, 0.85, 0.5
            w = list(base)
            for at in rng.sample(range(300), changes):
                w[at] = f"x{k}_{changes}_{at}"
            rows.append((len(rows), " ".join(w)))
            a, b = plain(rows[-1][1]), plain(" ".join(base))
            if len(a & b) / len(a | b) < 0.8:
                want.add(len(rows) - 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for paired, block in ((16, 1_024), (2, 1_024), (2, 2)):  # all paired; compared in one block; in blocks two by two
        monkeypatch.setattr(nc, "PAIRED", paired)
        monkeypatch.setattr(nc, "BLOCK", block)
        got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
        assert got >= want and len(got - want) <= 1


def test_verified_pairs_connect_what_brute_force_links():
    rng = np.random.default_rng(1)
    base = np.arange(40, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: 40 - k], rng.integers(100, 10_000, k).astype(np.uint64)))) for k in (0, 2, 3, 30, 32)]
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    a, b = nc.linked(dict(enumerate(sets)), *map(list, zip(*pairs, strict=True)), 0.8)
    near = {(i, j) for i, j in pairs if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8}
    assert set(zip(a, b, strict=True)) <= near and len(a) == 2


def family(rng, n, shared):
    """n texts of 300 words of which the first `shared` are the same."""
    head = [f"h{i}" for i in range(shared)]
    return [head + [f"w{rng.randrange(1_000_000)}" for _ in range(300 - shared)] for _ in range(n)]


def test_planted_copies_within_a_dense_family_go(spark):
    """Texts at about 0.51 of each other, half of them with a copy at about 0.85."""
    rng = random.Random(8)
    rows, copies = [], set()
    for w in family(rng, 300, 204):
        rows.append((len(rows), " ".join(w)))
        c = list(w)
        for at in (210, 225, 240, 255, 270):
            c[at] = f"c{rng.randrange(1_000_000)}"
        copies.add(len(rows))
        rows.append((len(rows), " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = set(range(len(rows))) - {r["doc_id"] for r in nc.one_of_each(df).collect()}
    assert gone <= copies and len(gone) >= 0.99 * len(copies)


def test_no_link_of_a_full_bucket_is_lost(spark, monkeypatch):
    """Two close pairs tied by one link that is nobody's nearest, 80 times within a dense family: every bucket gives a forest first, and the rest by components."""
    monkeypatch.setattr(nc, "PAIRED", 0)
    monkeypatch.setattr(nc, "SMALL", 1, raising=False)
    rng = random.Random(12)
    rows = []
    for x in family(rng, 80, 240):
        z = list(x)
        for at in range(242, 290, 8):  # 6 changes: 0.82
            z[at] = f"z{rng.randrange(1_000_000)}"
        y, w = list(x), list(z)
        y[294], w[296] = f"y{rng.randrange(1_000_000)}", f"v{rng.randrange(1_000_000)}"
        a, b = plain(" ".join(x)), plain(" ".join(z))
        assert len(a & b) >= 0.8 * len(a | b)
        rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate((x, y, z, w))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in nc.one_of_each(df).collect()}
    assert kept >= set(range(0, 320, 4)) and len(kept) <= 81


def test_full_buckets_are_not_joined_with_their_sets(spark, monkeypatch):
    """What is kept of a full bucket is one row, not one for each set in it; that all buckets share a place of the table changes nothing."""
    held, write = [], nc.materialize
    monkeypatch.setattr(nc, "materialize", lambda df, name="table": held.append((name, write(df, name))) or held[-1][1])
    monkeypatch.setattr(nc, "PAIRED", 0)
    monkeypatch.setattr(nc, "SMALL", 1)
    rng = random.Random(5)
    rows = [(i, " ".join(w)) for i, w in enumerate(family(rng, 60, 240))]
    rows += [(60 + i, t.rsplit(" ", 1)[0] + " end") for i, t in rows[:20]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for slots in (1 << 20, 1):
        monkeypatch.setattr(nc, "SLOTS", slots, raising=False)
        assert {r["doc_id"] for r in nc.one_of_each(df).collect()} == set(range(60))
        hot = [x for name, x in held if name == "hot"]
        assert hot and all(x.count() == x.select("p", "v").distinct().count() > 0 for x in hot)


def test_a_dense_family_makes_no_row_for_each_pair(spark, monkeypatch):
    """400 texts of one template, at about 0.74 of each other, so that nearly all pairs are candidates: no table has a row for each, and copies among them still go."""
    held, write = [], nc.materialize
    monkeypatch.setattr(nc, "materialize", lambda df, name="table": held.append((name, write(df, name))) or held[-1][1])
    monkeypatch.setattr(nc, "forget", lambda *tables: None)
    rows = [(i, " ".join(w)) for i, w in enumerate(family(random.Random(14), 400, 255))]
    rows += [(400 + i, t.rsplit(" ", 12)[0] + " end") for i, t in rows[:20]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in nc.one_of_each(df).collect()} == set(range(400))
    told = {}
    for name, x in held:
        told[name] = told.get(name, 0) + x.count()
    assert told["hot"] and max(told.values()) < 400 * 399 / 4, told


def test_full_buckets_verify_within_runs(spark, monkeypatch):
    """Links of full buckets whose sets meet in runs of a few, over blocks two by two too."""
    for name, x in (("PAIRED", 0), ("SMALL", 1), ("TOGETHER", 900)):
        monkeypatch.setattr(nc, name, x)
    rng = random.Random(15)
    rows = [(i, " ".join(w)) for i, w in enumerate(family(rng, 60, 250))]
    rows += [(60 + i, t.rsplit(" ", 12)[0] + " end") for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nc, "_linked", lambda pairs, *a: pairs.limit(0).selectExpr("a as src", "b as dst"))  # all is left to the full buckets
    for block in (1_024, 2):
        monkeypatch.setattr(nc, "BLOCK", block)
        whole = []
        rest = nc._rest
        monkeypatch.setattr(nc, "_rest", lambda hot, classes, plan, *a: whole.append(1) or rest(every(hot, classes, plan), classes, plan, *a))  # noqa: B023
        assert {r["doc_id"] for r in nc.one_of_each(df).collect()} == set(range(60)) and whole
        monkeypatch.setattr(nc, "_rest", rest)


def every(hot, classes, plan):
    """All buckets of the classes as hot ones."""
    from pyspark.sql import functions as F

    rows = classes.select(F.explode(nc.wide_probes(plan, range(len(plan)))).alias("x")).groupBy("x.p", "x.v").agg(F.count("*").alias("s"))
    return rows.where("s > 1").select("p", "v", "s")


def test_all_passes_count_their_probes_under_one_name(spark):
    """By the plan, numbers aside: else what the passes of one sign pattern of their masks make is set against those of another."""
    df = spark.createDataFrame([(1, 5, list(range(nc.WIDE)))], "cls long, size long, fp array<long>")
    plan = [(0, 0b111, 1), (1, 1 << 63 | 1, 0), (2, 0b11, 0)]
    names = set()
    for some in (range(0, 1), range(1, 3), range(0, 3)):
        rows = nc._probed(df, plan, some)
        told = rows._jdf.queryExecution().executedPlan().toString()
        names |= {re.sub(r"#?\d+L?", "", x.strip(" +-*():").strip()) for x in told.splitlines() if "Generate" in x}
        assert rows.count() == sum(len(nc._flips(mask, t)) for _, mask, t in (plan[p] for p in some))
    assert len(names) == 1, names


def test_candidates_that_chain_are_not_compared_all_with_all(spark, monkeypatch):
    """Pages of one template, at about 0.65 of each other: many candidates, no link. Each candidate is verified once, and most pairs are none."""
    compared = []
    verify = nc._verified
    monkeypatch.setattr(nc, "_verified", lambda pairs, *a: compared.append(pairs.select("a", "b")) or verify(pairs, *a))
    rows = [(i, " ".join(w)) for i, w in enumerate(family(random.Random(9), 400, 240))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert nc.one_of_each(df).count() == 400
    both = compared[0] if len(compared) == 1 else compared[0].union(compared[1])
    assert both.count() == both.distinct().count() < 400 * 399 / 4


def test_a_hub_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(nc, "PARTNERS", 3)
    monkeypatch.setattr(nc, "TOGETHER", 50)
    sets = spark.createDataFrame([(i, list(range(20)) + [100 + i]) for i in range(40)], "cls long, grams array<long>")
    pairs = spark.createDataFrame([(0, i, 21, 21) for i in range(1, 40)], "a long, b long, na long, nb long")
    assert {r["dst"] for r in nc._verified(pairs, sets, 0.8).collect()} == set(range(1, 40))


def test_odd_rows(odd, none):
    rows = nc.one_of_each(odd).collect()
    assert sum(r["doc_id"] in (2, 3, 4) for r in rows) == 1 and sum(r["doc_id"] == 1 for r in rows) == 1
    assert nc.one_of_each(none).count() == 0


def test_other_columns_have_any_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i % 3, f"the same text {i % 3} with a few words more") for i in range(9)], "doc_id long, text string")
    df = df.withColumns({x: F.lit(x) for x in ("r", "t", "row", "row_hash", "text_hash", "cls", "fp", "group", "node", "component", "key", "a.b")})
    out = nc.one_of_each(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2]
