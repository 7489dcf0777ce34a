import re
from collections import Counter, defaultdict

from veritrace.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def verdicts(docs):
    """Removed characters of each (doc_id, text, source), by the documented rule."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).lower().strip()
    held, seen = defaultdict(set), defaultdict(set)
    for d, x, s in docs:
        held[s].add((d, x))
        for line in (x or "").split("\n"):
            if norm(line):
                seen[s, norm(line)].add((d, x))
    common = {k for k, v in seen.items() if len(v) > max(q.MIN_DOCS, q.SHARE * len(held[k[0]]))}
    return [sum(len(norm(line).replace(" ", "")) for line in (x or "").split("\n") if (s, norm(line)) in common) for _, x, s in docs]


def check(out, docs):
    want = []
    for (d, x, _), removed in zip(docs, verdicts(docs), strict=True):
        b = base(x)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        want.append((d, *b, failed, not failed and b[1] - removed >= b[1] * q.LEFT, removed))
    got = [tuple(r) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_odd_rows(odd, none, texts):
    check(q.quality_rules(odd).collect(), [(d, x, "s") for d, x in texts])
    assert q.quality_rules(none).count() == 0


def test_documents_match_brute_force(spark, documents):
    check(q.op2_quality_rules(spark, "/root/testdata/sf0.001").collect(), [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()])


def test_common_lines_and_depleted_documents(spark):
    line = "Subscribe to our NEWSLETTER for more of the same every single day of the week"
    docs = [(i, f"{line}\nunique text number {i} with enough words of its own to be kept by every rule there is", "a") for i in range(30)]
    docs += [(100 + i, f"{line.lower()}  \nshort {i}", "a") for i in range(5)]  # little else than the line
    docs += [(200 + i, f"{line}\nshort {i}", "b") for i in range(5)]  # on this host it is not common
    docs += [(300, docs[0][1], "a"), (300, docs[0][1], "a")]
    out = q.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    check(out, docs)
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert not any(kept[100 + i] for i in range(5)) and all(kept[200 + i] and kept[i] for i in range(5)) and kept[300]


def test_hosts_are_kept_apart(spark):
    line = "One and the same line that stands in every document of one host but not of the other"
    docs = [(i, f"{line}\nown text {i}", "a") for i in range(25)]
    docs += [(0, docs[0][1], "b"), (0, docs[0][1], None), (0, docs[0][1], "")]  # elsewhere it is rare
    docs += [(100 + i, f"{line} x\nown text {i}", None) for i in range(12)] + [(200 + i, f"{line} x\nown text {i}", "") for i in range(12)]
    out = q.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    check(out, docs)
    assert sorted(r["removed_chars"] > 0 for r in out if r["doc_id"] == 0) == [False, False, False, True]
    assert not any(r["removed_chars"] for r in out if r["doc_id"] >= 100)


def test_sql_agrees(spark):
    import duckdb

    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()  # noqa: F841  DuckDB reads it by name
    want = duckdb.sql(q.ORACLE)
    got = q.op2_quality_rules(spark, "/root/testdata/sf0.01").select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
