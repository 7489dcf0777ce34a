import bisect
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from veritrace.llm import packing

PATH = P.path("word_bpe_49k.json")


def check(out, docs, size):
    t = Tokenizer.from_file(PATH)
    want = []
    for d, x in docs:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want += [(d, k, a, len(ids[a : a + size]), zlib.crc32(np.array(ids[a : a + size], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), size))]
    key = lambda r: (r[0] is None, *((x or 0) for x in r))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=key) == sorted(want, key=key)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= size
    return len(by), sum(x[3] for x in want)


def test_odd_rows(odd, texts, none):
    check(packing.best_fit_packing(odd, PATH, 64).collect(), texts, 64)
    assert packing.best_fit_packing(none, PATH).count() == 0


def test_documents_fill_their_sequences(documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    n, total = check(packing.best_fit_packing(documents, PATH).collect(), docs, 2048)
    assert n <= 1.03 * -(-total // 2048) + 1


def best_fit(lengths, size):
    """Plain best-fit decreasing, one piece at a time."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, x)
        gap = gaps.pop(k) if k < len(gaps) else size
        bisect.insort(gaps, gap - x)
    return len(gaps)


def test_rounds_place_every_piece_once(spark):
    rng = np.random.default_rng(5)
    for size, lengths in ((7, rng.integers(1, 8, 50)), (64, rng.integers(1, 65, 4000)), (512, np.clip(rng.exponential(90, 6000), 1, 512).astype(int)), (64, np.full(100, 64)), (64, np.full(100, 3))):
        counts = np.bincount(lengths, minlength=size + 1)
        table = spark.createDataFrame([(k, int(n)) for k, n in enumerate(counts) if n], "length int, n long")
        used, seen = {}, set()
        for r in packing._placed(table, size).collect():
            for i in range(r["n"]):
                assert (r["length"], r["first"] + i) not in seen
                seen.add((r["length"], r["first"] + i))
                used.setdefault(r["sequence"] + i, []).append((r["offset"], r["length"]))
        assert len(seen) == len(lengths) and all(rank < counts[length] for length, rank in seen)
        for x in used.values():
            x.sort()
            at = 0
            for offset, length in x:
                assert offset == at
                at += length
            assert at <= size
        assert len(used) <= 1.03 * best_fit(lengths.tolist(), size) + 1


def test_ids_equal_the_librarys():
    rng = np.random.default_rng(1)
    t = Tokenizer.from_file(PATH)
    bits = ["Don't", "we've", "naïve", "ÉCOLE", "x1y22", "...", "#tag", "a'b", "'s", "\t", "\n", " ", "  ", "ß", "ſt", "ª", "²", "don’t", "日本", "<|endoftext|>", "</w>", "co-op", "A", "ñandú", "I'LL", "_", "\xa0", "½"]
    for _ in range(300):
        x = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.integers(0, 12)))
        assert packing.id_bytes([x], PATH)[0] == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x
