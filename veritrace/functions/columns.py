"""Scalar functions over columns, all built of Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrace.functions import fixed


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(x: Column | str, table: dict, default) -> Column:
    """A value of a small fixed table, or the default."""
    out = F.when(F.lit(False), F.lit(default))
    for k, v in table.items():
        out = out.when(_c(x) == k, F.lit(v))
    return out.otherwise(F.lit(default))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


# text


def normalize_text(x: Column | str) -> Column:
    """Lower case, anything but a-z, 0-9 and white space a space, runs of it one, trimmed; null is ''."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def collapse_lower(x: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(x), r"\s+", " ")))


def filer_name(x: Column | str) -> Column:
    """Punctuation a space, runs one, upper case; letters of any script stay."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(_c(x), r"(?U)[^\w\s]", " "), r"\s+", " ")))


def key_tokens(x: Column | str) -> Column:
    """Distinct words of over three characters that are no stop words."""
    words = F.filter(F.split(normalize_text(x), " "), lambda w: F.length(w) > 3)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, fixed.STOP_WORDS)))


def strip_suffix(x: Column | str) -> Column:
    """Without one trailing corporate suffix."""
    return F.trim(F.regexp_replace(_c(x), fixed.CORPORATE_SUFFIX, ""))


def aliases(canonical: Column | str, raw: Column | str, tickers: Column | None = None) -> Column:
    """Distinct names in order: canonical, raw, both without suffix, tickers."""
    names = F.array(_c(canonical), _c(raw), strip_suffix(canonical), strip_suffix(raw))
    names = F.concat(names, tickers) if tickers is not None else names
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""))


def host_of(url: Column | str) -> Column:
    """Between http(s):// and /, up to the first colon, without leading www., lower case; without such a scheme all up to the colon."""
    low = F.lower(F.trim(F.coalesce(_c(url), F.lit(""))))
    host = F.regexp_extract(low, r"^https?://([^/]+)", 1)
    host = F.substring_index(F.when(host == "", low).otherwise(host), ":", 1)
    return F.regexp_replace(host, r"^www\.", "")


def registrable_domain(url: Column | str) -> Column:
    """The last two labels of the host that are not empty, or three where the last two are a public suffix."""
    labels = F.array_remove(F.split(host_of(url), r"\."), "")
    last = F.concat_ws(".", F.slice(labels, -2, 2))
    three = F.concat_ws(".", F.slice(labels, -3, 3))
    return F.when(F.size(labels) <= 2, F.concat_ws(".", labels)).when(last.isin(fixed.TWO_LEVEL_TLDS), three).otherwise(last)


def simple_domain(url: Column | str) -> Column:
    """What follows http(s):// and www. up to a slash, in lower case; '' without a scheme."""
    return F.regexp_extract(F.lower(_c(url)), r"^https?://(?:www\.)?([^/]+)", 1)


def display_host(url: Column | str) -> Column:
    """After ://, before /, without www. in that case, lower case."""
    s = F.coalesce(_c(url), F.lit(""))
    s = F.when(F.instr(s, "://") > 0, F.substring_index(F.regexp_replace(s, r"^.*?://", "\u0001"), "\u0001", -1)).otherwise(s)
    return F.lower(F.regexp_replace(F.substring_index(s, "/", 1), r"^www\.", ""))


def source_type(url: Column | str, entity: Column | str) -> Column:
    """Kind of source by domain; the first rule that holds."""
    d = simple_domain(url)
    base = F.regexp_replace(F.lower(F.substring_index(_c(entity), ",", 1)), "[^a-z0-9]", "")
    return (
        F.when(d.contains("sec.gov"), "SEC_FILING")
        .when(d.endswith(".gov") | d.endswith(".gov.uk"), "COURT_RECORD")
        .when(d.rlike("ofac|sanctions|interpol"), "SANCTIONS_LIST")
        .when((F.length(base) > 3) & d.startswith(base), "COMPANY_WEBSITE")
        .otherwise("NEWS_ARTICLE")
    )


def credibility_tier(kind: Column | str, url: Column | str) -> Column:
    d = registrable_domain(url)
    return (
        F.when(_c(kind).isin(fixed.PRIMARY_TYPES), "PRIMARY")
        .when(_c(kind).isin(fixed.OWN_TYPES), "ESTABLISHED")
        .when(d.isin(fixed.ESTABLISHED_DOMAINS), "ESTABLISHED")
        .when(d.isin(fixed.LOW_DOMAINS), "LOW")
        .otherwise("GENERAL")
    )


def tier_of(tier: Column | str) -> Column:
    return F.when(_c(tier).isin(list(fixed.TIER_WEIGHT)), _c(tier)).otherwise("GENERAL")


def data_date(x: Column | str) -> Column:
    """Y[-M[-D[-...]]] as a date, missing parts 1; null where there is no such day."""
    first = F.array_join(F.slice(F.split(F.trim(_c(x)), "-"), 1, 3), "-")
    return F.coalesce(F.try_to_date(first, "yyyy-M-d"), F.try_to_date(first, "yyyy-M"), F.try_to_date(first, "yyyy"))


def signal_text(text: Column | str, normalized: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(text), F.lit("")), _c(normalized), F.lit(""))


def joined(sep: str, *parts: Column | str) -> Column:
    """Non-empty parts."""
    return F.concat_ws(sep, *(F.nullif(_c(p), F.lit("")) for p in parts))


def slug(x: Column | str) -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(_c(x), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("entity"))


def cache_key(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("::", *map(_c, parts)), 256)


def entity_key(raw: Column | str, ident: Column | str, jurisdiction: Column | str) -> Column:
    """Case-folded and trimmed, so that spelling does not matter."""
    fold = lambda c: F.replace(F.lower(F.trim(F.coalesce(_c(c), F.lit("")))), F.lit("ß"), F.lit("ss"))
    return F.sha2(F.concat_ws("|", fold(raw), fold(ident), fold(jurisdiction)), 256)


def pad_cik(x: Column | str) -> Column:
    return F.lpad(F.regexp_replace(F.trim(_c(x)), "^0+", ""), 10, "0")


def dashed_accession(x: Column | str) -> Column:
    d = F.regexp_replace(_c(x), "-", "")
    return F.when(d.rlike(r"^\d{18}$"), F.concat_ws("-", F.substring(d, 1, 10), F.substring(d, 11, 2), F.substring(d, 13, 6))).otherwise(_c(x))


def retryable(message: Column | str) -> Column:
    """Whether an error's message names a code or a condition that passes."""
    return F.upper(_c(message)).rlike(fixed.PASSING)


def verdict(x: Column | str) -> Column:
    return lookup(F.lower(F.trim(_c(x))), fixed.VERDICTS, None)


def step_index(status: Column | str) -> Column:
    """The step that a state stands for; unknown ones are the first."""
    return lookup(status, fixed.STEPS, 0)


def binding_names(canonical: Column | str, others: Column) -> Column:
    names = F.transform(F.concat(F.array(_c(canonical)), others), lambda n: F.lower(F.trim(n)))
    return F.filter(names, lambda n: F.length(n) >= 4)


def mentions(text: Column | str, names: Column) -> Column:
    """Any name stands in the text; true without a usable name."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    return (F.size(names) == 0) | F.exists(names, lambda n: F.contains(low, n))


# scores


def temporal_weight(day: Column | str, today: str) -> Column:
    """1 less a share a year, not under the floor; the default for no day."""
    years = F.greatest(F.lit(0), F.datediff(F.lit(today).cast("date"), _c(day))) / F.lit(fixed.DAYS_A_YEAR)
    w = F.greatest(F.lit(fixed.TEMPORAL_FLOOR), F.least(F.lit(1.0), F.lit(1.0) - F.lit(fixed.TEMPORAL_LOSS) * years))
    return F.when(_c(day).isNull(), F.lit(fixed.TEMPORAL_DEFAULT)).otherwise(w)


def severity_weight(x: Column | str) -> Column:
    return lookup(x, fixed.SEVERITY_WEIGHT, 0.2)


def severity_rank(x: Column | str) -> Column:
    return lookup(x, fixed.SEVERITY_RANK, 0)


def trust(credibility: Column | str, independent: Column | str) -> Column:
    return F.least(F.lit(1.0), _c(credibility) + F.lit(0.15) * F.greatest(F.lit(0), _c(independent) - 1))


def confidence_factor(credibility: Column | str, independent: Column | str) -> Column:
    return F.lit(0.4) + F.lit(0.6) * trust(credibility, independent)


def effective_severity(severity: Column | str, temporal: Column | str, credibility: Column | str) -> Column:
    one = lambda c: F.coalesce(F.nullif(_c(c), F.lit(0.0)), F.lit(1.0))  # noqa: E731  a weight of 0 counts as none
    return severity_weight(severity) * one(temporal) * one(credibility)


def anchor_verdict(score: Column | str) -> Column:
    return F.when(_c(score) >= fixed.PASS, "PASS").when(_c(score) >= fixed.FLAG, "FLAG").otherwise("REJECT")


def anchor_factor(score: Column | str) -> Column:
    return F.when(_c(score) >= fixed.PASS, 1.0).when(_c(score) >= fixed.FLAG, fixed.FLAG_FACTOR).otherwise(0.0)


def needs_review(severity: Column | str, confidence: Column | str) -> Column:
    return (_c(severity) == "CRITICAL") | (_c(confidence) < fixed.REVIEW_FLOOR)


def score_band(x: Column | str) -> Column:
    return F.when(_c(x) >= 7, "red").when(_c(x) >= 4, "yellow").otherwise("green")


def review_cell(verdict_: Column | str, needs: Column | str) -> Column:
    return F.coalesce(_c(verdict_), F.when(_c(needs), F.lit("PENDING_REVIEW")), F.lit(""))


def guardrail_exceeded(calls: Column | str, cost: Column | str, seconds: Column | str) -> Column:
    return (_c(calls) >= fixed.MAX_CALLS) | (_c(cost) >= fixed.MAX_COST) | (_c(seconds) >= fixed.MAX_SECONDS)


def guardrail_compliant(calls: Column | str, cost: Column | str) -> Column:
    return (_c(calls) <= fixed.MAX_CALLS) & (_c(cost) <= fixed.MAX_COST)


def cosine(a: Column | str, b: Column | str) -> Column:
    """In double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(_c(x), _c(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def jaccard(a: Column | str, b: Column | str) -> Column:
    both = F.size(F.array_union(_c(a), _c(b)))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / both)


def citations(text: Column | str) -> Column:
    """Numbers of [Signal-N] in order, repeats included."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"\[Signal-(\d+)\]"), 1), lambda x: x.cast("int"))
