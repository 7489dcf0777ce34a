import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from veritrace.llm import chunks
from veritrace.llm import token_counts as tc

PATH = P.path("byte_bpe_50k.json")


def check(out, docs, limit=1024):
    t = Tokenizer.from_file(PATH)
    want = [(d is None, d or 0, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > limit) for d, x in docs]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == sorted(want)


@pytest.mark.parametrize("words", [500_000, 3])
def test_odd_rows(odd, none, texts, words, monkeypatch):
    monkeypatch.setattr(chunks, "MAX_WORDS", words)
    check(tc.token_counts(odd, PATH).collect(), texts)
    assert tc.token_counts(none, PATH).count() == 0


def test_documents_match_the_library(spark, documents):
    check(tc.op5_token_counts(spark, "/root/testdata/sf0.001").collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_pre_tokens_add_up():
    t, pick = Tokenizer.from_file(PATH), random.Random(3)
    for _ in range(2000):
        x = "".join(pick.choice("ab é½ \n\t'sld1²ªº·÷×ßİıʰ<|>ሴ日\U0001f600\x85\x1c ") for _ in range(12)) + pick.choice(["", "<|endoftext|>"])
        assert len(t.encode(x, add_special_tokens=False).ids) == sum(len(t.encode(w, add_special_tokens=False).ids) for w in tc.pre_tokens(x, PATH))
