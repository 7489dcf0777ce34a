import numpy as np
import pytest

from veritrace.llm import language_id as li


def plain_phrases(text, train):
    """Greedy longest phrases that occur in train; a letter that does not is its own."""
    n = at = 0
    while at < len(text):
        m = 0
        while at + m < len(text) and text[at : at + m + 1] in train:
            m += 1
        at += max(m, 1)
        n += 1
    return n


def test_automaton_parses_as_substring_search():
    rng = np.random.default_rng(4)
    train = rng.integers(0, 5, 300)
    table = li.Automaton(train, 8)
    as_text = lambda x: "".join(chr(97 + c) for c in x)
    texts = [rng.integers(0, 7, n).astype(np.uint16) for n in (1, 2, 60, 511, 512)]
    got = li.phrases(np.concatenate(texts), np.array([len(x) for x in texts]), [table])[:, 0]
    assert got.tolist() == [plain_phrases(as_text(x), as_text(train)) for x in texts]


def test_stretches_add_up():
    rng = np.random.default_rng(5)
    table = li.Automaton(rng.integers(0, 5, 300), 8)
    x = rng.integers(0, 5, 3 * li.STRETCH + 7).astype(np.uint16)
    whole = li.phrases(x, np.array([len(x)]), [table])[0, 0]
    parts = [x[a : a + li.STRETCH] for a in range(0, len(x), li.STRETCH)]
    assert whole == sum(li.phrases(p, np.array([len(p)]), [table])[0, 0] for p in parts)


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    out = li.op10_language_id(spark, at).join(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, odd, none, texts):
    from pyspark.sql import functions as F

    assert {(r["lang_pred"], r["score"]) for r in li.language_id(odd).collect()} == {("und", 0.0)}  # nothing is labelled
    named = odd.withColumn("lang", F.when(F.col("doc_id") == 7, "ja").when(F.col("doc_id").isin(1, 5, 9), "en"))
    out = li.language_id(named).collect()
    assert len(out) == len(texts) and {r["lang_pred"] for r in out if r["doc_id"] in (2, 3, 4, 8)} == {"und"}
    assert all(r["lang_pred"] == "en" for r in out if r["doc_id"] == 1)
    assert li.language_id(none).count() == 0


def test_large_alphabets_parse_as_substring_search():
    rng = np.random.default_rng(6)
    train = rng.choice(np.concatenate((np.arange(3_000), np.repeat(np.arange(40), 100))), 4_000)
    table = li.Automaton(train, 5_000)
    as_text = lambda x: "".join(chr(0x4E00 + c) for c in x)
    at = [int(x) for x in rng.integers(0, 3_900, 20)]
    texts = [np.concatenate((train[a : a + 60], rng.integers(0, 5_000, 20), train[a : a + 9])).astype(np.uint16) for a in at]
    got = li.phrases(np.concatenate(texts), np.array([len(x) for x in texts]), [table])[:, 0]
    assert got.tolist() == [plain_phrases(as_text(x), as_text(train)) for x in texts]


def test_predictions_match_brute_force(spark, documents):
    """Every prediction against substring search in the sampled text, by the documented rule."""
    model = li.fit(documents)
    sample = {}
    for r in sorted(li._sampled(documents).collect(), key=lambda r: (r["lang"], r["r"])):
        if r["r"] <= li.SAMPLE_ROWS:
            sample.setdefault(r["lang"], []).append(r["text"])
    coded = lambda x: "".join(map(chr, li.letter_codes([x], model.lut)[0] + 32))
    train = {lang: "".join(coded(x)[: li.ROW_LETTERS] for x in xs) for lang, xs in sorted(sample.items())}
    out = {r["doc_id"]: r for r in li.language_id(documents).collect()}
    for r in documents.where("length(text) < 900").limit(25).collect():
        x = coded(r["text"] or "")
        if r["doc_id"] in out and x.strip(" "):
            cost = {lang: sum(plain_phrases(x[a : a + li.STRETCH], t) for a in range(0, len(x), li.STRETCH)) * np.log2(len(t) + 1) for lang, t in train.items()}
            assert out[r["doc_id"]]["lang_pred"] == min(cost, key=cost.get)


def test_scripts_are_told_apart(spark):
    zh = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜"
    ja = "いろはにほへとちりぬるをわかよたれそつねならむうゐのおくやまけふこえてあさきゆめみしゑひもせす"
    el = "το σύνταγμα ορίζει τα δικαιώματα των πολιτών και τις υποχρεώσεις του κράτους προς αυτούς"
    rng = np.random.default_rng(3)
    pick = lambda x: "".join(x[a : a + 12] for a in rng.integers(0, len(x) - 12, 20))
    rows = [(i, pick({"zh": zh, "ja": ja, "el": el}[lang]), lang) for i, lang in enumerate(["zh", "ja", "el"] * 120)]
    rows.append((5000, "".join(chr(c) for c in rng.integers(0x0E01, 0x0E2E, 300)), None))  # a script that is not learned
    out = {r["doc_id"]: r for r in li.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i]["lang_pred"] == lang and out[i]["known"] for i, _, lang in rows[:-1]) and not out[5000]["known"]


def test_sample_is_bounded_by_rows(spark):
    df = spark.range(20_000).selectExpr("cast(null as long) doc_id", "concat('text number ', id) text", "'en' lang")
    assert li._sampled(df).count() == 2 * li.SAMPLE_ROWS


def test_accepted_rows(spark, odd, none):
    from pyspark.sql import functions as F

    named = odd.withColumn("lang", F.when(F.col("doc_id") == 7, "ja").when(F.col("doc_id").isin(1, 5, 9), "en")).withColumns({"row": F.lit(1), "p": F.lit("p"), "a.b": F.lit(2)})
    out = li.accepted(named)
    assert out.columns == named.columns and {r["doc_id"] for r in out.collect()} >= {1, 5, 9, None}
    assert not {r["doc_id"] for r in out.collect()} & {2, 3, 4, 8}
    assert li.accepted(named, ["en"]).count() == out.where("coalesce(lang, 'en') = 'en'").count() + out.where("lang = 'ja'").count()  # 7 is held out: no ja is learned
    assert li.accepted(named, ["fr"]).count() == li.accepted(none).count() == 0


def test_mislabelled_rows_do_not_open_the_limit(spark):
    """A few junk rows labelled en: junk stays unknown, text in en stays known."""
    rng = np.random.default_rng(5)
    en = "the committee wrote a report about the river and the bridges that cross it near the old town where people trade every morning "
    pick = lambda: "".join(en[a : a + 40] for a in rng.integers(0, len(en) - 40, 12))
    junk = lambda: "".join(rng.choice(list("bcdfghjklmnpqrstvwxz "), 400))
    rows = [(i, pick(), "en") for i in range(400)] + [(1_000 + i, junk(), "en") for i in range(12)] + [(2_000 + i, junk(), None) for i in range(20)]
    out = {r["doc_id"]: r["known"] for r in li.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i] for i in range(400)) and not any(out[2_000 + i] for i in range(20))


def test_only_the_commonest_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(li, "MOST_LANGUAGES", 2)
    rows = [(i, f"some text of number {i}", lang) for i, lang in enumerate(["a"] * 30 + ["b"] * 20 + ["stray"] * 5)]
    with pytest.warns(UserWarning, match="commonest"):
        model = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["a", "b"]


def test_a_tie_goes_to_the_first_name(spark):
    rows = [(i, "one and the same text for two names", lang) for i, lang in enumerate(["zz", "aa"] * 200)]
    out = li.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("aa", 0.5)}
