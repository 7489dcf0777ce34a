"""Entity resolution: registry hits to one entity, fuzzy filer match, enrichment, cache."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.functions import columns as C
from veritrace.functions import fuzzy
from veritrace.operators.blocks import meet
from veritrace.operators.ranking import first_rows
from veritrace.storage import materialize


def _first(*names: str, of: DataFrame) -> Column:
    have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in of.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def parse_registry(hits: DataFrame, raw: str = "raw") -> DataFrame:
    """Registry rows of several shapes as entities: the first filled column of each kind counts."""
    kind = F.lower(F.coalesce(_first("company_type", of=hits), F.lit("")))
    place = F.replace(F.lower(F.coalesce(_first("jurisdiction_code", "country_code", "jurisdiction", "country", of=hits), F.lit(""))), F.lit("_"), F.lit("-"))
    public = F.when(place.startswith("us"), kind.rlike("public|stock|plc")).otherwise(kind.rlike("plc|public limited"))
    name = F.coalesce(_first("legal_name", "name", "company_name", of=hits), F.upper(raw))
    return hits.select(
        raw, "ord", name.alias("canonical_name"), F.nullif(place, F.lit("")).alias("jurisdiction"), public.alias("is_public"),
        _first("id", of=hits).alias("registry_id"), _first("industry", "sic_description", of=hits).alias("industry"), C.aliases(name, raw).alias("aliases"),
    )


def candidates(hits: DataFrame, raw: str = "raw", limit: int = 8) -> DataFrame:
    """What a picker shows: the first hits of each name, with status, type and a short address."""
    p = parse_registry(hits, raw).drop("aliases", "industry")
    flat = lambda *n: fuzzy.flatten_json(_first(*n, of=hits))
    shown = hits.select(F.col(raw).alias("_raw"), F.col("ord").alias("_ord"), flat("status", "company_status", "current_status").alias("status"), flat("company_type", "type").alias("company_type"),
                        F.substring(flat("registered_address", "address", "registered_office_address"), 1, 160).alias("address"))
    out = p.join(shown, (F.col(raw) == F.col("_raw")) & (F.col("ord") == F.col("_ord"))).drop("_raw", "_ord")
    return first_rows(out, [raw], [F.col("ord").asc()], limit)


def resolve(names: DataFrame, hits: DataFrame, picks: DataFrame | None = None, raw: str = "raw") -> DataFrame:
    """One entity a name: the picked registry id, else the first hit, else the name in capitals, with `status`."""
    parsed = parse_registry(hits, raw)
    top = first_rows(parsed, [raw], [F.col("ord").asc()], 1)
    if picks is not None:
        picked = parsed.join(picks.select(F.col(raw).alias("_raw"), F.col("picked").alias("_picked")), (F.col(raw) == F.col("_raw")) & (F.col("registry_id") == F.col("_picked"))).drop("_raw", "_picked")
        picked = first_rows(picked, [raw], [F.col("ord").asc()], 1).withColumn("_how", F.lit(0))
        top = first_rows(picked.unionByName(top.withColumn("_how", F.lit(1))), [raw], [F.col("_how").asc()], 1)
    else:
        top = top.withColumn("_how", F.lit(1))
    out = names.join(top.drop("ord"), raw, "left")
    status = F.when(F.col("_how") == 0, "picked").when(F.col("_how") == 1, "top_hit").otherwise("stub")
    return out.withColumns({"canonical_name": F.coalesce("canonical_name", F.upper(F.trim(raw))), "status": status}).drop("_how")


def _best(names: DataFrame, filers: DataFrame, key: str, block: int) -> DataFrame:
    """(raw, q, cik, title, score): the best filer of each name (raw, q, least) among those of its keys, if it reaches least."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["cik", "title"])
        rows = fuzzy.best_token_sort(left["q"].tolist(), right["title"].tolist(), left["least"].astype(float).tolist())
        return pd.DataFrame([(left["raw"].iat[i], left["q"].iat[i], right["cik"].iat[k], right["title"].iat[k], s) for i, k, s in rows], columns=["raw", "q", "cik", "title", "score"])

    return meet(names.select("raw", "q", "least", key), filers.select("cik", "title", key), best, "raw string, q string, cik string, title string, score double", (key,), block)


def _sorted_words(x: str) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")), " ")


def _grams(own: Column) -> Column:
    """All pairs of neighbouring letters, repeats included."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(own) - 1)), lambda i: F.substring(own, i, F.lit(2)))


def rival_keys(names: DataFrame, filers: DataFrame) -> DataFrame:
    """(raw, q, least, gram): pairs of letters of which every filer whose token-sort ratio reaches least has one; a null gram where no such set exists.

    With c = least / 200, letters a of the name and b of the filer, c (a + b) letters are common to
    both in order. Each letter left out or put in breaks at most two or one of the name's pairs, so
    (3 c - 1) (a + b) - 1 of them stand in the filer's name, and one of those stands among all but
    so many less one. The rarest are taken. b is c a / (1 - c) at least.
    """
    own = _sorted_words("q")
    a, c = F.length("own"), F.col("least") / 200
    shared = F.ceil((3 * c - 1) * (a + F.ceil(c * a / (1 - c) - 1e-9)) - 1 - 1e-9)
    n = names.withColumn("own", own).withColumn("take", F.when((c < 1) & (c > 1 / 3) & (a > 1) & (shared >= 1), F.least(a - 1, a - shared)))
    n = n.withColumn("take", F.when(a > 1, F.col("take")))
    count = filers.select(F.explode(F.array_distinct(_grams(_sorted_words("title")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    each = n.where("take is not null").select("raw", "q", "least", "take", F.explode(_grams(F.col("own"))).alias("gram")).join(count, "gram", "left")
    rare = first_rows(each.withColumn("n", F.coalesce("n", F.lit(0))), ["raw"], [F.col("n"), F.col("gram")], F.col("take"))
    return rare.select("raw", "q", "least", "gram").distinct().union(n.where("take is null").select("raw", "q", "least", F.lit(None).cast("string")))


def match_filers(names: DataFrame, filers: DataFrame, raw: str = "raw", cutoff: float = 70.0, block: int = 2_000) -> DataFrame:
    """(raw, cik, title, score): the filer of best token-sort ratio, if its first word is the name's; the first cik of equals.

    The best of all filers counts, so one with another first word refuses the name. Filers with the
    name's first word come first, by an equality; a name that none of them matches is refused
    whatever the others are. Against the score so found the rivals are sought, by pairs of letters
    of which a filer must have one to reach it (rival_keys); only names whose score is too low for
    such a set meet all filers. Rows of one key are dealt into blocks of about `block`.
    """
    q = names.select(F.col(raw).cast("string").alias("raw"), C.filer_name(raw).alias("q")).where("q is not null").distinct()
    f = materialize(filers.select(F.col("cik").cast("string").alias("cik"), C.filer_name("title").alias("title")).where("title is not null").distinct(), "filers")
    word = lambda x: F.substring_index(x, " ", 1)
    own = materialize(_best(q.select("*", F.lit(float(cutoff)).alias("least"), word("q").alias("word")), f.withColumn("word", word("title")), "word", block), "own")
    own = first_rows(own, ["raw"], [F.col("score").desc(), F.col("cik").asc(), F.col("title").asc()], 1)
    keys = materialize(rival_keys(own.select("raw", "q", F.col("score").alias("least")), f), "keys")
    held = f.withColumn("gram", F.explode(F.array_distinct(_grams(_sorted_words("title"))))).join(keys.select("gram").distinct(), "gram", "left_semi")
    rivals = _best(keys.where("gram is not null"), held, "gram", block)
    loose = keys.where("gram is null").withColumn("gram", F.lit(""))
    if not loose.isEmpty():
        rivals = rivals.union(_best(loose, f.withColumn("gram", F.lit("")), "gram", block))
    top = first_rows(own.union(rivals), ["raw"], [F.col("score").desc(), F.col("cik").asc(), F.col("title").asc()], 1)
    return top.where(word("q") == word("title")).select(F.col("raw").alias(raw), C.pad_cik("cik").alias("cik"), "title", "score")


def enrich(entities: DataFrame, uk_hits: DataFrame, filers: DataFrame, raw: str = "raw") -> DataFrame:
    """UK names and numbers for entities of gb, a filer number for those of us or nowhere; a filer is public."""
    uk = first_rows(uk_hits, [raw], [F.col("ord").asc()], 1).select(F.col(raw).alias("_u"), F.col("title").alias("_title"), F.col("company_number"))
    e = entities.join(uk, (F.col(raw) == F.col("_u")) & F.coalesce(F.col("jurisdiction").contains("gb"), F.lit(False)), "left")
    e = e.withColumn("canonical_name", F.coalesce("_title", "canonical_name")).drop("_u", "_title")
    f = filers.select(F.col(raw).alias("_f"), F.col("cik").alias("sec_cik"))
    e = e.join(f, (F.col(raw) == F.col("_f")) & (F.col("jurisdiction").isNull() | F.col("jurisdiction").startswith("us")), "left").drop("_f")
    return e.withColumn("is_public", F.coalesce("is_public", F.lit(False)) | F.col("sec_cik").isNotNull())


def with_cache(names: DataFrame, cache: DataFrame, now: str, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of names against a cache (cache_key, entity_json, expires_at)."""
    keyed = names.withColumn("cache_key", C.entity_key(raw, F.lit(""), F.lit("")))
    live = cache.where(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))
    return keyed.join(live, "cache_key"), keyed.join(live, "cache_key", "left_anti")


def outcomes(resolved: DataFrame, filers: DataFrame, blocked: DataFrame, raw: str = "raw") -> DataFrame:
    """resolved names with `found`: a stub counts as not found if no filer has the name and the registry was not blocked for it.

    resolved is resolve's result, filers (raw, cik) match_filers', blocked (raw) the names whose search was refused.
    """
    some = filers.select(F.col(raw).alias("_f")).distinct().withColumn("_cik", F.lit(True))
    held = blocked.select(F.col(raw).alias("_b")).distinct().withColumn("_blocked", F.lit(True))
    out = resolved.join(some, F.col(raw) == F.col("_f"), "left").join(held, F.col(raw) == F.col("_b"), "left")
    known = (F.col("status") != "stub") | F.col("_cik").isNotNull() | F.col("_blocked").isNotNull()
    status = F.when(~known, "not_found").when((F.col("status") == "stub") & F.col("_blocked").isNotNull(), "blocked").otherwise(F.col("status"))
    return out.withColumns({"found": known, "status": status}).drop("_f", "_cik", "_b", "_blocked")


def to_cache(entities: DataFrame, now: str, days: int, raw: str = "raw") -> DataFrame:
    """Cache rows (cache_key, entity_json, expires_at) of resolved entities, to be appended; those not found are asked again next time."""
    kept = entities.where("status <> 'not_found'") if "status" in entities.columns else entities
    expiry = F.lit(now).cast("timestamp_ntz") + F.expr(f"interval {days} days")
    return kept.select(C.entity_key(raw, F.lit(""), F.lit("")).alias("cache_key"), F.to_json(F.struct("*")).alias("entity_json"), expiry.alias("expires_at"))
