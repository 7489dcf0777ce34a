import random
import zlib

import numpy as np
import public_tokenizers as P
import sentencepiece

from veritrace.llm import pieces

PATH = P.path("piece_bpe_32k.model")


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_are_the_librarys():
    sp, m, pick = library(), pieces.Model(PATH), random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzeeeaaaooottth  \n\t.,éßñ日\U0001f600▁AB1"
    for _ in range(3000):
        x = "".join(pick.choice(letters) for _ in range(pick.randint(1, 40)))
        want = sp.encode(x)
        assert np.frombuffer(m.encode(x), "<u4").tolist() == want, x
        assert m.decode(np.array(want)) == x.replace("▁", " ")


def test_documents(spark, documents):
    sp = library()
    want = {r["doc_id"]: sp.encode(r["text"]) for r in documents.collect()}
    out = pieces.op9_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in out} == {d: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want.items()}
    assert all(r["round_trip"] for r in out)


def test_odd_rows_and_columns(spark, odd, none, texts):
    out = pieces.encoded_documents(odd, PATH).collect()
    assert len(out) == len(texts) and all(r["round_trip"] for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (2, 3)} == {0}
    assert pieces.encoded_documents(none, PATH).count() == 0
    back = odd.select("text", pieces.decoder(PATH)(pieces.encoder(PATH)("text")).alias("b")).collect()
    assert all(r["b"] == (r["text"] or "") for r in back)


def test_unigram_takes_the_best_sum():
    m = pieces.Model(PATH)
    m.unigram = True
    m.automaton = pieces.ahocorasick.Automaton()
    m.score = {"a": -1.0, "b": -1.0, "ab": -3.0, "bc": -0.5, "c": -4.0}
    for p in m.score:
        m.automaton.add_word(p, p)
    m.automaton.make_automaton()
    assert m.segment("abc") == ["a", "bc"] and m.segment("ab") == ["a", "b"] and m.segment("xab") == ["x", "a", "b"]
