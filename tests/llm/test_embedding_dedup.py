import math

import numpy as np

from veritrace.llm import embedding_dedup as e


def brute(rows):
    """{index: (links, smallest linked vec_id)} by comparing all pairs."""
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    near = {i: [] for i in range(n)}
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is not None and la == lb and ok(a) and ok(b) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.98:
                    near[i].append(j)
                    near[j].append(i)
    out = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = len(near[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return out


def planted(rng, n, groups, noise):
    rows = []
    for k in range(n):
        rows.append((len(rows), rng.normal(size=64).astype(np.float32).tolist(), int(k % 3)))
    for c in range(groups):
        centre = rng.normal(size=64)
        for _ in range(12):
            rows.append((len(rows), (centre + noise * rng.normal(size=64)).astype(np.float32).tolist(), int(c % 3)))
    return rows


def test_links_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = planted(rng, 300, 20, 0.09)
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for block in (1_024, 4):  # blocks of four: the buckets are cut
        monkeypatch.setattr(e, "BLOCK", block)
        got = {r["vec_id"]: r for r in e.near_vectors(df).collect()}
        found, there = sum(r["n_links"] for r in got.values()), sum(x for x, _ in want.values())
        assert there > 1000 and 0.98 * there <= found <= there
        assert all(got[i]["n_links"] <= want[i][0] for i in want)
        assert np.mean([got[i]["component_id"] == want[i][1] for i in want]) > 0.99


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (1, v, 1), (2, v, None), (3, v, 2), (4, None, 1), (5, [], 1), (6, [0.0] * 3, 1), (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1),
            (9, [float("inf"), 2.0, 3.0], 1), (None, v, 1), (10, [2.0, 4.0, 6.0], 1), (11, [1.0, 2.0], 1), (12, [-1.0, -2.0, -3.0], 1)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"cls": F.lit(1), "v": F.lit("x"), "n": F.lit(2), "keys": F.lit(0)})
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in e.near_vectors(df).collect()))
    assert got == [(0, 3, 1, True), (1, 3, 1, True), (1, 3, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
                   (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 3, 1, False), (11, 0, 11, True), (12, 0, 12, True)]
    assert e.near_vectors(df.limit(0)).count() == 0


def test_hadamard_is_orthonormal():
    h = e.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def test_a_pair_counts_once_whatever_the_order_of_rows_and_probes(spark):
    keys = {1: [7, 5], 2: [5, 7]}  # the same two buckets, in other orders
    for c, k in keys.items():
        k += [100 * c + i for i in range(2 * e.TABLES - 2)]
    row = lambda cls, key: (key, 0, False, cls, [1.0, 0.0], 1, keys[cls], key)
    schema = "g long, b int, cross boolean, cls long, v array<double>, m long, keys array<long>, key long"
    for order in ([(1, 5), (2, 5), (1, 7), (2, 7)], [(1, 5), (2, 5), (2, 7), (1, 7)], [(2, 5), (1, 5), (1, 7), (2, 7)], [(2, 5), (1, 5), (2, 7), (1, 7)]):
        df = spark.createDataFrame([row(*x) for x in order], schema).coalesce(1)
        got = e._compare(df, 0.98).where("links > 0").collect()
        assert sorted((r["a"], r["links"]) for r in got) == [(1, 1), (2, 1)]


def test_pairs_share_a_bucket_of_any_width():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(1_500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1)[:, None]
    salt = np.zeros(len(a), np.uint64)
    for axes in range(1, 6):
        x, y = (e.buckets(v, salt, axes) for v in (a, b))
        met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3))
        assert met.mean() >= 0.99
        if axes > 1:
            other = (x[:, :, :, None] == np.roll(y, 1, axis=0)[:, :, None, :]).any(axis=(1, 2, 3))
            assert other.mean() < 0.08
