import math

import numpy as np
import pytest

from veritrace.operators import cells, similarity


def families(rng, n, size, dims, noise):
    """n families of size vectors around a middle of their own."""
    x = np.repeat(rng.normal(size=(n, dims)), size, axis=0)
    return x + noise * rng.normal(size=x.shape)


def table(spark, x, groups=1):
    return spark.createDataFrame([(i % groups, i, [float(v) for v in r]) for i, r in enumerate(x)], "g long, id long, v array<double>")


def brute(x, threshold, groups=1):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s, n = u @ u.T, len(x)
    return {(i, j) for i in range(n) for j in range(i + 1, n) if i % groups == j % groups and s[i, j] >= threshold}


@pytest.mark.parametrize(("threshold", "cell", "pivots", "groups"), [(0.85, 25, 4, 1), (0.6, 40, 8, 3), (0.95, 10, 2, 2), (0.3, 50, 5, 1), (0.0, 30, 4, 1), (-0.2, 30, 4, 1)])
def test_near_pairs_are_all_pairs(spark, threshold, cell, pivots, groups):
    rng = np.random.default_rng(7)
    x = np.concatenate((families(rng, 40, 5, 8, 0.25), rng.normal(size=(100, 8))))
    rng.shuffle(x)
    got = [(r["a"], r["b"]) for r in cells.near_pairs(table(spark, x, groups), threshold, cell, pivots).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(x, threshold, groups)


def test_pairs_compared_grow_with_rows_not_with_their_square(spark):
    """Four times the families are four times the pairs, within a factor, and few more than those that are near."""
    rng, work = np.random.default_rng(5), []
    for n in (64, 256):
        x = families(rng, n, 10, 24, 0.1)
        c = cells.cut(table(spark, x), 0.85, 100, 128)
        work.append(cells.compared(c))
        assert c.where("not guest").count() <= len(x)  # rows with nothing near leave
    assert work[1] < 8 * work[0] and work[1] < 0.02 * 2_560 * 2_559 / 2


def test_vectors_without_nearness_stay_in_blocks(spark):
    x = np.random.default_rng(2).normal(size=(300, 32))
    c = cells.cut(table(spark, x), 0.3, 50, 8)
    assert {(r["path"], r["guest"]) for r in c.collect()} == {("", False)}
    got = {(r["a"], r["b"]) for r in cells.near_pairs(table(spark, x), 0.3, 50, 8).collect()}
    assert got == brute(x, 0.3)


def test_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = [*rng.normal(size=(6, 4)).tolist()]
    x += [x[0]] * 50 + [x[1]] * 3 + [None, [None, 1.0, 0.0, 0.0], [math.nan] * 4, [math.inf, 0.0, 0.0, 1.0], [0.0] * 4, [-0.0] * 4, [1.0, 2.0], []]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(x)], "grp string, id long, v array<double>")
    fine = [i for i in range(59)]
    u = np.array([x[i] for i in fine])
    want = brute(u, 0.8)
    got = [(r["a"], r["b"]) for r in similarity.similar_pairs(df, "grp", "id", "v", 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = similarity.similar_links(df, "grp", "id", "v", 0.8)
    assert links.count() < len(want) / 10
    reach = {r["id"]: r["cluster"] for r in similarity.clusters(df, "id", links).collect()}
    every = {r["id"]: r["cluster"] for r in similarity.clusters(df, "id", df.sparkSession.createDataFrame(sorted(want), "a long, b long")).collect()}
    assert reach == every
    with pytest.raises(ValueError):
        similarity.similar_links(df, "grp", "id", "v", 0.0)
    # at a threshold of 0 a zero vector, whose cosine is 0 with any, counts
    zero = {(r["a"], r["b"]): r["sim"] for r in similarity.similar_pairs(df, "grp", "id", "v", 0.0).collect()}
    assert zero[(63, 64)] == 0.0 and zero[(6, 7)] == 1.0


def test_one_group_of_copies_of_a_large_cell(spark):
    """All rows of a group at one place: no cut helps, and the links stay few."""
    df = table(spark, np.ones((500, 3)))
    assert similarity.similar_links(df, "g", "id", "v").count() == 499
    near = table(spark, np.ones((200, 3)) + 1e-4 * np.random.default_rng(1).normal(size=(200, 3)))
    assert cells.near_pairs(near, 0.85, 40, 4).count() == 200 * 199 // 2
