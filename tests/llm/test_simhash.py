import numpy as np
import xxhash

from veritrace.llm import simhash


def plain(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def components(fp):
    ids = sorted(fp)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_odd_rows(odd, texts, none):
    out = simhash.simhash_groups(odd).collect()
    assert sorted(r["fp"] % (1 << 64) for r in out) == sorted(plain(x) for _, x in texts)
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert by[2] == by[3] == by[4] == 2 and by[1] == 1
    assert simhash.simhash_groups(none).count() == 0


def test_documents_match_brute_force(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    want = {r["doc_id"]: plain(r["text"]) for r in rows}
    got = simhash.op8_simhash(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == want
    assert all(len(r["fingerprint"]) == 16 for r in got)
    assert {r["doc_id"]: r["component_id"] for r in got} == components(want)


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, np.int64)
    fps = {0}
    for c in centres.tolist():
        for _ in range(60):
            a, b, k = rng.integers(0, 63, 3)
            fps.add(c ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(k)))
    monkeypatch.setattr(simhash, "BUCKET", 4)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = simhash.connected_components(simhash.link(df)).collect()
    got = {x: x for x in fps} | {r["node"]: r["component"] for r in found}
    assert got == components({x: x for x in fps})


def test_thresholds_follow_costs():
    cost, ts = simhash.allocate([[0, 1, 3], [0, 500, 900], [0, 400, 800]], 0)
    assert ts == [1, -1, 0] and cost == 403


def test_parts_hold_correlated_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (500, 32))
    x = np.repeat(x, 2, axis=1)  # bits 2k and 2k + 1 are equal
    parts = simhash.group_bits(500, x.T @ x, 4)
    assert sorted(sum(parts, [])) == list(range(64))
    assert all({j ^ 1 for j in p} == set(p) for p in parts)
