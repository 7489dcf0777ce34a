"""The index on disk: exact answers, few cells read, written once a source."""

import numpy as np
import pytest

from veritrace.operators import index as ix


def table(spark, x, name="item", at=0):
    return spark.createDataFrame([(at + i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], f"{name} long, v array<double>")


def brute(q, x, k):
    """For each query with a direction its best k by cosine, the smaller number at a tie."""
    u = lambda v: np.asarray(v, float) / np.linalg.norm(v)
    usable = lambda v: v is not None and np.isfinite(v).all() and np.any(v)
    items = [(i, u(v)) for i, v in enumerate(x) if usable(v)]
    out = {}
    for j, v in enumerate(q):
        if usable(v):
            out[j] = [i for _, i in sorted((-round(float(u(v) @ w), ix.DIGITS), i) for i, w in items)[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append(r["item"])
    return out


def families(n, each, width, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n, width))
    return np.concatenate([c + 0.1 * rng.normal(size=c.shape) for _ in range(each)])


@pytest.mark.parametrize("cells", [1, 7, 40])
def test_equals_a_search_of_everything(spark, tmp_path, cells):
    x = [*families(40, 10, 12, 1), *families(40, 1, 12, 1)[:5].repeat(6, axis=0), None, np.zeros(12), np.array([np.nan] * 12)]
    q = [*families(40, 1, 12, 1)[:20], *np.random.default_rng(5).normal(size=(10, 12)), np.zeros(12), None]
    i = ix.build(table(spark, x), str(tmp_path / "i"), cells)
    for k in (1, 3, 50):
        assert answers(i.search(table(spark, q, "query"), k)) == brute(q, x, k)
    assert i.rows.count() == len(x) - 3


def test_more_wanted_than_there_are_and_empty_tables(spark, tmp_path):
    x = families(2, 2, 4, 2)
    i = ix.build(table(spark, x), str(tmp_path / "i"))
    assert answers(i.search(table(spark, x, "query"), 9)) == brute(x, x, 9)
    assert i.search(table(spark, [], "query")).count() == 0
    none = ix.open_or_build(table(spark, []), str(tmp_path / "none"))
    assert none.search(table(spark, x, "query")).count() == 0 and none.rows.count() == 0
    with pytest.raises(ValueError):
        i.search(table(spark, [[1.0, 2.0]], "query"))
    with pytest.raises(ValueError):
        ix.build(table(spark, [[1.0], [1.0, 2.0]]), str(tmp_path / "two"))


def test_written_once_and_again_when_the_source_changes(spark, tmp_path):
    x, root = families(10, 10, 8, 3), str(tmp_path)
    one = ix.open_or_build(table(spark, x), root)
    marks = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    again = ix.open_or_build(table(spark, x).repartition(3), root)
    assert again.path == one.path and marks == {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    changed = x.copy()
    changed[17] *= -1
    two = ix.open_or_build(table(spark, changed), root)
    assert two.path != one.path
    for i, y in ((one, x), (two, changed)):
        assert answers(i.search(table(spark, x[:5], "query"))) == brute(x[:5], y, 3)


def test_half_an_index_is_not_read(spark, tmp_path):
    x = families(5, 4, 6, 4)
    whole = ix.open_or_build(table(spark, x), str(tmp_path))
    (tmp_path / whole.path.split("/")[-1] / "facts" / "_SUCCESS").unlink()
    (tmp_path / whole.path.split("/")[-1] / "rows" / "_SUCCESS").unlink()
    assert not ix.built(spark, whole.path)
    assert answers(ix.open_or_build(table(spark, x), str(tmp_path)).search(table(spark, x, "query"))) == brute(x, x, 3)


def test_far_cells_are_not_read(spark, tmp_path):
    """Families far from one another: a query reads a few cells, and the plan only their partitions."""
    x = families(64, 20, 16, 6)
    i = ix.build(table(spark, x), str(tmp_path / "i"), 64)
    facts = i.facts.orderBy("cell").toPandas()
    q = table(spark, x[:8], "query").withColumnRenamed("query", "query")
    got = answers(i.search(q))
    assert got == brute(x[:8], x, 3)
    import pandas as pd

    s = {j: float(x[j] @ x[got[j][-1]] / np.linalg.norm(x[j]) / np.linalg.norm(x[got[j][-1]])) for j in got}
    b = pd.DataFrame({"query": range(8), "v": list(x[:8]), "s": [s[j] for j in range(8)]})
    size = facts.set_index("cell")["n"]
    for probes in (ix._nearest_cells(facts, 3)(iter([b])), ix._other_cells(facts, 3)(iter([b]))):
        read = pd.concat(list(probes))
        assert size[read["cell"]].sum() < 0.2 * 8 * len(x)
    plan = i.rows.where("cell in (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan


@pytest.mark.parametrize(("values", "pairs"), [(96, 40), (2**19, 2**20)])
def test_queries_travel_once_a_group_of_cells(spark, tmp_path, monkeypatch, values, pairs):
    """Vectors without nearness, one of them many times: cells in groups, large ones in several, slices of a bounded number of pairs."""
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(ix, "VALUES", values)
    monkeypatch.setattr(ix, "PAIRS", pairs)
    rng = np.random.default_rng(9)
    x = [*rng.normal(size=(150, 6)), *np.ones((60, 6))]
    q = [*x[:30], *np.ones((3, 6)), -np.ones(6)]
    i = ix.build(table(spark, x), str(tmp_path / "i"), 12)
    assert answers(i.search(table(spark, q, "query"))) == brute(q, x, 3)
    facts = i.facts.orderBy("cell").toPandas()
    most = values // 6
    place = ix._groups(facts, most)
    held = {}
    for cell, first, parts in place.itertuples(index=False):
        for g in range(first, first + parts):
            held[g] = held.get(g, 0) + facts.set_index("cell")["n"][cell] / parts
    assert max(held.values()) <= most and sorted(held) == list(range(len(held)))
    b = pd.DataFrame({"query": range(len(q)), "v": [list(map(float, v)) for v in q], "s": [-1.0] * len(q), "_q": 0})
    probes = list(ix._other_cells(facts, 3, place)(iter([b])))
    assert max(map(len, probes)) <= max(pairs, len(facts))
    sent = pa.Table.from_batches(ix._sent(ix._other_cells(facts, 3, place), place, most)(iter([pa.RecordBatch.from_pandas(b, preserve_index=False)])))
    assert len(set(zip(sent["query"].to_pylist(), sent["_g"].to_pylist(), strict=True))) == len(sent) <= len(q) * len(held)
