"""Text functions that Spark has no expression for, as vectorised Python functions of columns.

Ratios are on 0 to 100 over the longest common subsequence: 200 * LCS / (lengths together).
"""

from __future__ import annotations

import html.parser
import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrace.functions import columns as C
from veritrace.functions import fixed

#: Letters of shorter texts that are combed side by side, and how far their lengths may be apart.
COMBED, LIKE = 2**14, 1.25
SKIPPED = {"script", "style", "head", "nav", "footer", "noscript"}


class _Reader(html.parser.HTMLParser):
    """Collects text outside skipped elements; a name's prefix up to a colon does not count."""

    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.inside = 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag.rpartition(":")[2] in SKIPPED

    def handle_endtag(self, tag):
        if tag.rpartition(":")[2] in SKIPPED:
            self.inside = max(0, self.inside - 1)

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)


def plain_text(page: str | None, cap: int = fixed.TEXT_CAP) -> str:
    r = _Reader()
    try:
        r.feed(page or "")
        text = " ".join(r.parts)
    except Exception:  # pages that the parser refuses
        text = re.sub("<[^>]+>", " ", page)
    return " ".join(text.split())[:cap]


@F.pandas_udf(T.StringType())
def html_to_text(page: pd.Series) -> pd.Series:
    return page.map(plain_text)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the columns of a as bits of one number."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def window_lcs(a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the longest common subsequence of a with b's starts of 0 to n letters, its windows of n = len(a), and its ends of n to 0; n <= len(b).

    One pass combs the grid of both texts: n strands enter from the left and one over each letter of
    b, and two cross where letters agree, or where they have crossed before, which undoes it. Which
    strands begin and end within a part of b tells that part's length, so all windows come of one
    pass. Cells of a diagonal do not depend on each other and are done at once.
    """
    n, m = len(a), len(b)
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a[::-1], b))
    side, top = np.arange(n), np.arange(n, n + m)
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d)
        s, t = slice(n - 1 - hi, n - lo), slice(d - hi, d - lo + 1)
        h, v = side[s], top[t]
        cross = (x[s] == y[t]) | (h > v)
        side[s], top[t] = np.where(cross, v, h), np.where(cross, h, v)
    return _window_lengths(side, top)


def _window_lengths(side: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """window_lcs from where the combed strands, numbered 0 to n + m, leave the grid."""
    n, m = len(side), len(top)
    ends = np.empty(n + m, np.int64)  # where the strand that begins somewhere ends
    ends[top], ends[side] = np.arange(m), np.arange(m, n + m)
    ends = ends[n:]
    starts = np.concatenate((top, side)) - n  # where the one that ends somewhere begins; negative on the left side
    head = np.arange(n + 1) - np.concatenate(([0], np.cumsum(starts[:n] >= 0)))
    tail = np.arange(n, -1, -1) - np.append(np.cumsum((ends[m - n :] < m)[::-1])[::-1], 0)
    i = np.arange(m - n)
    inside = n - head[n] + np.concatenate(([0], np.cumsum((starts[n:m] > i).astype(int) - (ends[: m - n] < i + n))))
    return head, n - inside, tail


def _best_window(n: int, head: np.ndarray, windows: np.ndarray, tail: np.ndarray) -> float:
    at_ends = np.maximum(head, tail[::-1]) * 200.0 / (n + np.arange(n + 1))
    return float(max(windows.max() * 200.0 / (2 * n), at_ends.max()))


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer, windows at its ends included."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    return _best_window(len(a), *window_lcs(a, b))


def partials(pairs: list[tuple[str, str]]) -> list[float]:
    """partial of many pairs, of which those of like lengths are combed side by side."""
    out = [0.0] * len(pairs)
    left = []
    for k, (a, b) in enumerate(pairs):
        if a and b:
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            if a in b:
                out[k] = 100.0
            else:
                left.append((math.floor(math.log(len(a), LIKE)), len(b), k, a, b))
    left.sort()
    at = 0
    while at < len(left):
        band, m = left[at][:2]
        most, to = max(1, int(COMBED / LIKE ** (band + 1))), at + 1
        while to < len(left) and to - at < most and left[to][0] == band and left[to][1] <= LIKE * m:
            to += 1
        for (_, _, k, _, _), score in zip(left[at:to], _combed([x[3:] for x in left[at:to]]), strict=True):
            out[k] = score
        at = to
    return out


def _combed(pairs: list[tuple[str, str]]) -> list[float]:
    """The best windows of pairs (shorter, longer), combed as in window_lcs, a column each.

    Shorter pairs are filled up with letters that agree with nothing: their strands stay where they
    are. Letters that agree differ by 0, less 1 is the largest number, so the lesser of that and the
    other strand is what a crossing leaves; all other differences are below every strand.
    """
    n, m = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    code = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.unique(code("".join(a + b for a, b in pairs)))
    low = 1 << (len(letters) + 1).bit_length()
    kind = np.uint16 if low + n + m < 2**16 - 1 else np.uint32
    x, y = np.full((n, len(pairs)), len(letters), kind), np.full((m, len(pairs)), len(letters) + 1, kind)
    for k, (a, b) in enumerate(pairs):
        x[n - len(a) :, k] = np.searchsorted(letters, code(a[::-1]))
        y[: len(b), k] = np.searchsorted(letters, code(b))
    side = np.repeat(low + np.arange(n, dtype=kind)[:, None], len(pairs), axis=1).astype(kind)
    top = np.repeat(low + n + np.arange(m, dtype=kind)[:, None], len(pairs), axis=1).astype(kind)
    some, one = np.empty_like(side), kind(1)
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d)
        s, t, w = slice(n - 1 - hi, n - lo), slice(d - hi, d - lo + 1), some[: hi - lo + 1]
        h, v = side[s], top[t]
        np.bitwise_xor(x[s], y[t], out=w)
        np.subtract(w, one, out=w)
        np.maximum(w, h, out=w)
        np.minimum(w, v, out=w)
        np.add(v, h, out=v)
        np.subtract(v, w, out=v)
        h[...] = w
    side, top = side.T.astype(np.int64) - low, top.T.astype(np.int64) - low
    return [_best_window(len(a), *_window_lengths(side[k, n - len(a) :] - (n - len(a)), top[k, : len(b)] - (n - len(a)))) for k, (a, b) in enumerate(pairs)]


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def best_token_sort(names: list[str], titles: list[str], cutoff: float | list[float]) -> list[tuple[int, int, float]]:
    """(name, title, score): the first title of best token-sort ratio for each name that has one of at least cutoff, or of the name's own.

    No ratio exceeds that of the letters two texts have in common, so others are not compared.
    """
    own = [" ".join(sorted(x.split())) for x in (*names, *titles)]
    number = {c: i for i, c in enumerate(sorted(set("".join(own))))}
    held = np.zeros((len(own), len(number)), np.int32)
    for row, x in zip(held, own, strict=True):
        for c in x:
            row[number[c]] += 1
    a, b, size = own[: len(names)], own[len(names) :], held.sum(axis=1)
    out = []
    for i, x in enumerate(a):
        both = np.minimum(held[i], held[len(a) :]).sum(axis=1)
        most = 200.0 * both / np.maximum(size[i] + size[len(a) :], 1)
        best, at = cutoff if isinstance(cutoff, float) else cutoff[i], -1
        for k in np.argsort(-most, kind="stable").tolist():
            if most[k] < best:
                break
            score = ratio(x, b[k])
            if score > best or score == best and (at < 0 or k < at):
                best, at = score, k
        if at >= 0:
            out.append((i, at, best))
    return out


def token_set(a: str, b: str) -> float:
    """The best ratio among the shared words and the shared words with either rest; 100 if one has no rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, ra, rb = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (ra and rb):
        return 100.0
    one, two = f"{both} {ra}".strip(), f"{both} {rb}".strip()
    return max(ratio(one, two), *((ratio(both, one), ratio(both, two)) if both else (0.0,)))


def _over_pairs(f):
    @F.pandas_udf(T.DoubleType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return udf


partial_ratio, token_sort_ratio, token_set_ratio = _over_pairs(partial), _over_pairs(token_sort), _over_pairs(token_set)


def anchor_score(snippet: Column | str, text: Column | str) -> Column:
    """How far a snippet stands in a text; contained ones need no Python, empty ones are 0."""
    a, b = C.normalize_text(snippet), C.normalize_text(text)
    empty = (a == "") | (b == "")
    return F.when(empty, 0.0).when(F.contains(b, a), 100.0).otherwise(partial_ratio(F.when(~F.contains(b, a), a), F.when(~F.contains(b, a), b)))


def match_score(predicted: Column | str, truth: Column | str) -> Column:
    """Best of two ratios, or of the share of the truth's key words where at least two are shared."""
    p, t = C.normalize_text(predicted), C.normalize_text(truth)
    pk, tk = C.key_tokens(predicted), C.key_tokens(truth)
    shared = F.size(F.array_intersect(pk, tk))
    overlap = F.coalesce(shared / F.nullif(F.least(F.size(tk), F.lit(12)), F.lit(0)) * 100, F.lit(0.0))
    lexical = F.greatest(token_set_ratio(p, t), partial_ratio(p, t))
    return F.when(shared >= 2, F.greatest(lexical, overlap)).otherwise(lexical)


def match_scores(pairs: list[tuple[dict, dict]]) -> list[float]:
    """match_score of (predicted, truth), each a row of normalised `text`, its set of `words` and `keys`, the key words or None.

    Of the token set's ratios, two are of a text with its own beginning, and the third is reckoned
    where its lengths let it be the best.
    """
    out = []
    for (p, t), part in zip(pairs, partials([(p["text"], t["text"]) for p, t in pairs]), strict=True):
        best, words = part, p["words"] & t["words"]
        shared = len(set(p["keys"]) & set(t["keys"])) if p["keys"] is not None and t["keys"] is not None else 0
        if shared >= 2:
            best = max(best, shared / min(len(t["keys"]), 12) * 100)
        if p["words"] and t["words"] and best < 100.0:
            both, rests = " ".join(sorted(words)), [" ".join(sorted(x["words"] - words)) for x in (p, t)]
            if both and not all(rests):
                best = 100.0
            else:
                head = len(both) + 1 if both else 0
                one, two = (head + len(r) for r in rests)
                if both:
                    best = max(best, 200.0 * len(both) / (len(both) + min(one, two)))
                if 200.0 * min(one, two) / (one + two) > best:
                    best = max(best, 200.0 * (head + lcs(*rests)) / (one + two))
        out.append(best)
    return out


def flat(x) -> str:
    """Values of any nesting, joined by commas; empty ones are left out."""
    if x is None:
        return ""
    if isinstance(x, dict):
        x = list(x.values())
    if isinstance(x, list):
        return ", ".join(flat(v) for v in x if v)
    return str(x)


@F.pandas_udf(T.StringType())
def flatten_json(x: pd.Series) -> pd.Series:
    def one(s):
        try:
            return flat(json.loads(s)) if s else ""
        except ValueError:
            return s

    return x.map(one)
