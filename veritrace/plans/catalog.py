"""The registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.functions import columns as C
from veritrace.functions import fixed, fuzzy
from veritrace.operators import evaluation, index, quotes, ranking, reports, resolution, review, scoring, similarity
from veritrace.plans import pipeline as whole
from veritrace.plans.inputs import NORM, RANK, SIGNALS, TODAY, WEIGHT, read, signals
from veritrace.sources import connectors, tables
from veritrace.storage import shared_dir
from veritrace.streaming import runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x):
    return F.round(x, 6)


def _list(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


# scores

TRUST = "least(1.0::double, source_credibility + 0.15::double * greatest(0, independent_source_count - 1))"
ADJUSTED = f"adjusted as (select * replace (greatest(0.0::double, least(1.0::double, confidence_score * (0.4::double + 0.6::double * {TRUST}))) as confidence_score) from signals)"
GATED = "severity in ('HIGH', 'CRITICAL') and credibility_tier in ('GENERAL', 'LOW') and independent_source_count < 2"
SCORES = f"scores as (select run_id, risk_category, count(*) n, round(least(10.0::double, avg({WEIGHT} * confidence_score * coalesce(nullif(temporal_weight, 0), 1)) * 10), 2) score from adjusted group by all)"


@query(f"with {SIGNALS}, {ADJUSTED} select risk_category, count(*) n, round(least(10.0::double, avg({WEIGHT} * confidence_score * coalesce(nullif(temporal_weight, 0), 1)) * 10), 2) score from adjusted group by all")
def category_scores(spark, d):
    return scoring.category_scores(scoring.apply_credibility(signals(spark, d)))


@query(f"with {SIGNALS}, {ADJUSTED}, {SCORES} select run_id, round(sum(score * n) / sum(n), 2) overall from scores group by run_id")
def overall_scores(spark, d):
    return scoring.overall_score(scoring.category_scores(scoring.apply_credibility(signals(spark, d)), "run_id"), "run_id")


@query(f"""with {SIGNALS}, {ADJUSTED}, s as (select risk_category, round(least(10.0::double, avg({WEIGHT} * confidence_score * coalesce(nullif(temporal_weight, 0), 1)) * 10), 2) score from adjusted group by all),
c as (select unnest(range(0, 7))::int place, unnest(['FINANCIAL', 'LEGAL', 'REGULATORY', 'REPUTATIONAL', 'OPERATIONAL', 'CYBERSECURITY', 'ESG']) risk_category)
select place, risk_category, round(coalesce(score, 0.0::double), 1) score, case when coalesce(score, 0) >= 7 then 'red' when coalesce(score, 0) >= 4 then 'yellow' else 'green' end band from c left join s using (risk_category)""")
def category_radar(spark, d):
    s = scoring.category_scores(scoring.apply_credibility(signals(spark, d)))
    return scoring.category_radar(s).join(s.select("risk_category", F.col("score").alias("s")), "risk_category", "left").select("place", "risk_category", "score", C.score_band(F.coalesce("s", F.lit(0.0))).alias("band"))


@query(f"select o_orderkey, round(greatest(0.3::double, least(1.0::double, 1.0::double - 0.15::double * (greatest(0, date_diff('day', o_orderdate::date, date '{TODAY}')) / 365.25::double))), 6) weight from orders")
def temporal_decay(spark, d):
    return read(spark, d, "orders").select("o_orderkey", r6(C.temporal_weight(F.to_date("o_orderdate"), TODAY)).alias("weight"))


@query(f"with {SIGNALS} select id, case when {GATED} then 'MEDIUM' else severity end severity, {GATED} is_unverified, {GATED} or severity = 'CRITICAL' or confidence_score < 0.6 requires_human_review from signals")
def severity_gate(spark, d):
    s = signals(spark, d).withColumn("requires_human_review", C.needs_review("severity", "confidence_score"))
    return scoring.severity_gate(s).select("id", "severity", "is_unverified", "requires_human_review")


@query(f"with {SIGNALS}, {ADJUSTED} select id, round(confidence_score, 6) confidence_score, round({TRUST}, 6) trust from adjusted")
def confidence_haircut(spark, d):
    return scoring.apply_credibility(signals(spark, d)).select("id", r6("confidence_score").alias("confidence_score"), r6(C.trust("source_credibility", "independent_source_count")).alias("trust"))


@query(f"with {SIGNALS} select id, round({WEIGHT} * temporal_weight * source_credibility, 6) effective from signals")
def effective_severity(spark, d):
    return signals(spark, d).select("id", r6(C.effective_severity("severity", "temporal_weight", "source_credibility")).alias("effective"))


@query(f"""with {SIGNALS} select run_id, round(avg((severity = 'CRITICAL')::int), 6) share, avg((severity = 'CRITICAL')::int) > 0.10::double inflated from signals group by run_id""")
def critical_inflation(spark, d):
    return scoring.critical_inflation(signals(spark, d), "run_id").withColumn("share", r6("share"))


@query("""with g as (select user_id, ts::date as day_of, count(*) n_docs, count(distinct event_type) n_types from events group by all)
select *, case when n_docs >= 15 and n_types >= 4 then 'RICH' when n_docs >= 8 and n_types >= 3 then 'ADEQUATE' when n_docs >= 4 and n_types >= 2 then 'LIMITED' else 'SPARSE' end tier from g""")
def sufficiency_tier(spark, d):
    e = read(spark, d, "events").withColumn("day_of", F.to_date("ts"))
    return scoring.sufficiency(e, "user_id", "day_of", kind="event_type")


@query(f"with {SIGNALS} select id from signals where severity = 'CRITICAL' or confidence_score < 0.6")
def review_queue(spark, d):
    s = signals(spark, d).withColumn("requires_human_review", C.needs_review("severity", "confidence_score"))
    return review.for_review(s).select("id")


# hosts and sources

HOST = r"regexp_replace(split_part(coalesce(nullif(regexp_extract(lower(trim(url)), '^https?://([^/]+)', 1), ''), lower(trim(url)), ''), ':', 1), '^www\.', '')"
DOMAIN = f"""d as (select page_id, url, list_filter(string_split({HOST}, '.'), lambda x: x <> '') l from pages),
r as (select page_id, url, case when len(l) <= 2 then array_to_string(l, '.') when array_to_string(l[-2:], '.') in {_list(fixed.TWO_LEVEL_TLDS)} then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end dom from d)"""


@query(f"with {DOMAIN} select page_id, dom as domain_name from r")
def registrable_domain(spark, d):
    return read(spark, d, "pages").select("page_id", C.registrable_domain("url").alias("domain_name"))


@query(f"""with {DOMAIN} select page_id, case when page_id % 5 = 0 then 'PRIMARY' when page_id % 5 = 1 then 'ESTABLISHED' when dom in {_list(fixed.ESTABLISHED_DOMAINS)} then 'ESTABLISHED'
when dom in {_list(fixed.LOW_DOMAINS)} then 'LOW' else 'GENERAL' end tier from r""")
def credibility_tier(spark, d):
    kind = F.when(F.col("page_id") % 5 == 0, "SEC_FILING").when(F.col("page_id") % 5 == 1, "COMPANY_WEBSITE").otherwise("NEWS_ARTICLE")
    return read(spark, d, "pages").select("page_id", C.credibility_tier(kind, "url").alias("tier"))


@query(r"""with d as (select page_id, regexp_extract(lower(url), '^https?://(?:www\.)?([^/]+)', 1) h, 'th' || substr(split_part(url, '//', 2), 3, 2) || ', inc' base_name from pages),
b as (select page_id, h, regexp_replace(split_part(base_name, ',', 1), '[^a-z0-9]', '', 'g') b from d)
select page_id, case when contains(h, 'sec.gov') then 'SEC_FILING' when h like '%.gov' or h like '%.gov.uk' then 'COURT_RECORD' when regexp_matches(h, 'ofac|sanctions|interpol') then 'SANCTIONS_LIST'
when length(b) > 3 and starts_with(h, b) then 'COMPANY_WEBSITE' else 'NEWS_ARTICLE' end source_type from b""")
def source_type(spark, d):
    p = read(spark, d, "pages").withColumn("name", F.concat(F.lit("th"), F.substring(F.split_part("url", F.lit("//"), F.lit(2)), 3, 2), F.lit(", inc")))
    return p.select("page_id", C.source_type("url", "name").alias("source_type"))


@query(r"select lower(regexp_replace(split_part(split_part(url, '://', 2), '/', 1), '^www\.', '')) host, count(*) n from pages group by 1")
def host_counts(spark, d):
    return read(spark, d, "pages").groupBy(C.display_host("url").alias("host")).agg(F.count("*").alias("n"))


@query(f"with {DOMAIN} select page_id % 20 cluster, count(distinct dom) n_domains from r group by 1")
def independent_sources(spark, d):
    p = read(spark, d, "pages").select((F.col("page_id") % 20).alias("cluster"), C.registrable_domain("url").alias("dom"))
    return p.groupBy("cluster").agg(F.countDistinct("dom").alias("n_domains"))


# caps and pages


@query("select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_suppkey) r from lineitem) where r <= 2")
def signals_per_doc_cap(spark, d):
    order = [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return ranking.first_rows(read(spark, d, "lineitem"), ["l_orderkey"], order, 2).select("l_orderkey", "l_linenumber")


@query(f"with {SIGNALS} select id from (select id, row_number() over (partition by run_id order by {RANK} desc, confidence_score desc, ord) r from signals) where r <= 7")
def severe_signals_cap(spark, d):
    return ranking.cap_signals(signals(spark, d), "run_id").select("id")


@query("select o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) r from orders) where r <= greatest(0, 42 - o_custkey % 50)")
def llm_budget_prefix(spark, d):
    o = read(spark, d, "orders")
    return ranking.budget_prefix(o, "o_custkey", "o_orderkey", F.col("o_custkey") % 50).select("o_orderkey")


@query("select doc_id, source from (select *, row_number() over (partition by source order by doc_id) r from documents) where r <= 10")
def docs_per_source_cap(spark, d):
    return ranking.cap_documents(read(spark, d, "documents"), "source", "doc_id").select("doc_id", "source")


@query("""with l(o_orderpriority, most) as (values ('1-URGENT', 1), ('2-HIGH', 1), ('5-LOW', 2))
select o_orderkey, o_custkey, o_orderpriority from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey) r from orders join l using (o_orderpriority)) where r <= most""")
def filings_top_k_by_type(spark, d):
    o = ranking.newest_by_form(read(spark, d, "orders"), "o_custkey", "o_orderpriority", [F.col("o_orderdate").desc(), F.col("o_orderkey")], {"1-URGENT": 1, "2-HIGH": 1, "5-LOW": 2})
    return o.select("o_orderkey", "o_custkey", "o_orderpriority")


@query(f"with {SIGNALS} select id, severity, round(confidence_score, 6) confidence_score from signals where risk_category = 'OPERATIONAL' and severity = 'HIGH' order by ord limit 50 offset 100")
def api_signals_page(spark, d):
    return ranking.signals_page(signals(spark, d), "operational", "high", 100, 50).select("id", "severity", r6("confidence_score").alias("confidence_score"))


@query(f"with {SIGNALS} select id, run_id, row_number() over (partition by run_id order by (signal_polarity = 'POSITIVE')::int, ord) signal_num from signals")
def signal_numbering(spark, d):
    return ranking.number_signals(signals(spark, d)).select("id", "run_id", F.col("signal_num").cast("long").alias("signal_num"))


@query("select event_id, user_id, max(p) over (partition by user_id order by ts, event_id) pct from (select *, case event_type when 'signup' then 15 when 'view' then 35 when 'click' then 65 when 'purchase' then 98 else 0 end p from events)")
def progress_monotone(spark, d):
    node = C.lookup("event_type", {"signup": "entity_resolution", "view": "research", "click": "extraction", "purchase": "presentation"}, "none")
    e = read(spark, d, "events").withColumn("p", C.lookup(node, {n: p for n, _, p in fixed.STAGES}, 0))
    return ranking.running_max(e, "user_id", ["ts", "event_id"], "p", "pct").select("event_id", "user_id", "pct")


@query("""with c as (select event_id, user_id, count(*) over w calls, sum(value) over w / 1000 total from events window w as (partition by user_id order by ts, event_id))
select event_id, calls, round(total, 6) cost, calls >= 50 or total >= 1.0 halted from c""")
def guardrail_trip(spark, d):
    e = read(spark, d, "events")
    return ranking.guardrail_trip(e, "user_id", ["ts", "event_id"], "value", 1000).select("event_id", "calls", r6("cost").alias("cost"), "halted")


@query("select user_id, event_type, arg_max(value, (ts, event_id)) last_value from events group by all")
def last_write_wins(spark, d):
    return ranking.last_writes(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value").withColumnRenamed("value", "last_value")


# text


@query("with n as (select doc_id, " + NORM.format("text") + " t from documents) select doc_id, md5(t) digest, length(t) n_norm from n")
def normalise_text(spark, d):
    t = C.normalize_text("text")
    return read(spark, d, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n_norm"))


@query(f"select doc_id, len(list_filter(list_distinct(string_split({NORM.format('text')}, ' ')), lambda x: length(x) > 3 and x not in {_list(fixed.STOP_WORDS)}))::bigint n_keys from documents")
def key_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(C.key_tokens("text")).cast("long").alias("n_keys"))


@query(r"""with w as (select doc_id, unnest(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) word, generate_subscripts(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> ''), 1) - 1 k from documents)
select doc_id, (k // 200)::bigint chunk, count(*) n_words, md5('[' || any_value(doc_id) || '] ' || string_agg(word, ' ' order by k)) digest from w group by doc_id, k // 200""")
def chunk_windows(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    c = connectors.markdown_chunks(docs)
    return c.select(F.col("source").cast("long").alias("doc_id"), F.col("chunk").cast("long").alias("chunk"), (F.size(F.split("text", " ")) - 1).cast("long").alias("n_words"), F.md5("text").alias("digest"))


@query()
def html_to_text(spark, d):
    t = fuzzy.html_to_text("html")
    return read(spark, d, "pages").select("page_id", t.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@query("""with x as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y') when 1 then strftime(o_orderdate, '%Y-%m') when 2 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y') || '-13-40' end s from orders)
select o_orderkey, case o_orderkey % 4 when 0 then (s || '-01-01')::date when 1 then (s || '-01')::date when 2 then s::date end data_date from x""")
def parse_data_date(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey") % 4
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13-40")))
    return o.select("o_orderkey", C.data_date(s).alias("data_date"))


SUFFIXED = "s_name || case s_suppkey % 5 when 0 then ', Inc.' when 1 then ' Ltd' when 2 then ' Holdings' when 3 then ' & Sons' else ' L.L.P' end"


@query(rf"""with n as (select s_suppkey, {SUFFIXED} as full_name from supplier), s as (select *, trim(regexp_replace(full_name, '[\s,]*(Inc\.?|LLC\.?|Ltd\.?|Corp\.?|Co\.?|L\.?P\.?|LLP|PLC|Limited|Incorporated|Corporation|Holdings|Group|S\.?A\.?)[\s,]*$', '', 'i')) stem from n)
select s_suppkey, stem, case when stem = full_name then upper(full_name) || '|' || full_name || case when trim(regexp_replace(upper(full_name), '[\s,]*(Inc\.?|LLC\.?|Ltd\.?|Corp\.?|Co\.?|L\.?P\.?|LLP|PLC|Limited|Incorporated|Corporation|Holdings|Group|S\.?A\.?)[\s,]*$', '', 'i')) = upper(full_name) then '' else '?' end
else upper(full_name) || '|' || full_name || '|' || upper(stem) || '|' || stem end aliases from s""")
def aliases(spark, d):
    k = F.col("s_suppkey") % 5
    name = F.concat("s_name", F.when(k == 0, ", Inc.").when(k == 1, " Ltd").when(k == 2, " Holdings").when(k == 3, " & Sons").otherwise(" L.L.P"))
    n = read(spark, d, "supplier").withColumn("full_name", name)
    return n.select("s_suppkey", C.strip_suffix("full_name").alias("stem"), F.array_join(C.aliases(F.upper("full_name"), "full_name"), "|").alias("aliases"))


@query("""select s_suppkey, lpad(case when s_suppkey = 0 then '' else s_suppkey::varchar end, 10, '0') cik, substr(lpad(s_suppkey::varchar, 18, '1'), 1, 10) || '-' || substr(lpad(s_suppkey::varchar, 18, '1'), 11, 2) || '-' || substr(lpad(s_suppkey::varchar, 18, '1'), 13, 6) accession from supplier""")
def accession_normalise(spark, d):
    k = F.col("s_suppkey").cast("string")
    return read(spark, d, "supplier").select("s_suppkey", C.pad_cik(F.concat(F.lit(" 00"), k, F.lit(" "))).alias("cik"), C.dashed_accession(F.lpad(k, 18, "1")).alias("accession"))


@query("select s_suppkey, sha256('https://x/' || s_suppkey || '::' || s_name) url_key, sha256(lower(trim(s_name)) || '|' || s_suppkey || '|us') entity_key from supplier")
def cache_key(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", C.cache_key(F.concat(F.lit("https://x/"), F.col("s_suppkey").cast("string")), "s_name").alias("url_key"), C.entity_key(F.upper("s_name"), F.col("s_suppkey").cast("string"), F.lit(" US ")).alias("entity_key"))


@query("""with b as (select *, 'src' || (item_id % 20) source from benchmark) select d.doc_id from documents d where exists (select 1 from b where b.source = d.source and contains(lower(d.text), lower(trim(b.text))))
or not exists (select 1 from b where b.source = d.source and length(trim(b.text)) >= 4)""")
def wrong_company_guard(spark, d):
    """Documents that mention one of the names of their source's organisation, or whose organisation has no usable name."""
    b = read(spark, d, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), "text")
    names = b.groupBy("source").agg(F.collect_set("text").alias("all"))  # an organisation's names are few
    docs = read(spark, d, "documents").join(names, "source", "left")
    usable = C.binding_names(F.lit(""), F.coalesce("all", F.array().cast("array<string>")))
    return docs.where(C.mentions("text", usable)).select("doc_id")


# quotes

ANCHORED = f"""qw as (select item_id, string_split({NORM.format('text')}, ' ') w, {NORM.format('text')} q from benchmark), dw as (select doc_id, string_split({NORM.format('text')}, ' ') w, {NORM.format('text')} t from documents),
qr as (select distinct item_id, array_to_string(w[i + 1 : i + 5], ' ') run from (select item_id, w, unnest(range(0, len(w) - 4)) i from qw)), dr as (select distinct doc_id, array_to_string(w[i + 1 : i + 5], ' ') run from (select doc_id, w, unnest(range(0, len(w) - 4)) i from dw)),
p as (select distinct item_id, doc_id from qr join dr using (run)), q as (select item_id, doc_id, contains(t, q) held from p join qw using (item_id) join dw using (doc_id))"""


def _quotes(spark, d, quote="text"):
    b = read(spark, d, "benchmark").select("item_id", F.expr(quote).alias("quote_text"))
    return quotes.candidates(b, read(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id")


@query(f"with {ANCHORED} select item_id, doc_id, case when held then 'PASS' else 'REJECT' end verdict from q")
def quote_anchor_exact(spark, d):
    """Every benchmark passage against every document that shares five words in a row with it."""
    score = F.when(F.contains(C.normalize_text("text"), C.normalize_text("quote_text")), 100.0).otherwise(0.0)
    return _quotes(spark, d).select("item_id", "doc_id", C.anchor_verdict(score).alias("verdict"))


@query(f"with {ANCHORED} select doc_id % 10 bucket, count(*) extracted, count(*) filter (held) kept, count(*) filter (not held) rejected, 0::bigint flagged, round(avg(held::int), 6) pass_rate from q group by 1")
def extraction_stats(spark, d):
    q = quote_anchor_exact(spark, d).withColumn("bucket", F.col("doc_id") % 10)
    return scoring.extraction_stats(q, "bucket").withColumn("pass_rate", r6("pass_rate"))


@query()
def quote_anchor_fuzzy(spark, d):
    """Passages without their every ninth word, against every document that shares five words in a row with what is left."""
    torn = "array_join(filter(split(text, ' '), (w, i) -> (i + 1) % 9 <> 0), ' ')"
    q = _quotes(spark, d, torn)
    return q.withColumn("score", fuzzy.anchor_score("quote_text", "text")).select("item_id", "doc_id", "score", C.anchor_verdict("score").alias("verdict"))


@query()
def fuzzy_resolve(spark, d):
    names = read(spark, d, "nation").select(F.concat("n_name", F.lit(", Inc")).alias("raw"))
    filers = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("cik"), F.concat("n_name", F.lit(" Co "), (F.col("s_suppkey") % 3).cast("string")).alias("title"))
    return resolution.match_filers(names, filers)


@query("select c_custkey, case when c_custkey % 3 = 0 then c_name else upper(trim(c_name)) end canonical_name, case when c_custkey % 3 = 0 then 'top_hit' else 'stub' end status, case when c_custkey % 3 = 0 then c_mktsegment = 'BUILDING' end is_public, case when c_custkey % 3 = 0 then 'us-ny' end jurisdiction from customer")
def resolve_entities(spark, d):
    c = read(spark, d, "customer").withColumn("raw", F.col("c_name"))
    hits = c.where("c_custkey % 3 = 0").select("raw", F.lit(0).alias("ord"), F.col("c_name").alias("legal_name"), F.lit("US_NY").alias("jurisdiction_code"), F.when(F.col("c_mktsegment") == "BUILDING", "Public stock").otherwise("llc").alias("company_type"), F.col("c_custkey").cast("string").alias("id"))
    return resolution.resolve(c.select("c_custkey", "raw"), hits).select("c_custkey", "canonical_name", "status", "is_public", "jurisdiction")


# scans of nested data


@query("""with o as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) - 1 r from orders)
select o_custkey cik, r::int as ord, lpad(o_orderkey::varchar, 18, '0') acc, o_orderpriority filing_type from (select *, row_number() over (partition by o_custkey order by r) k from o where o_orderpriority in ('1-URGENT') and o_orderdate >= timestamp '1994-01-01') where k <= 40""")
def filings_scan(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("t"), "o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")))), lambda x: x).alias("a"))
    s = o.select(F.col("o_custkey").alias("cik"), F.transform("a", lambda x: F.lpad(x["o_orderkey"].cast("string"), 18, "0")).alias("accession"), F.col("a.o_orderpriority").alias("form"), F.col("a.day").alias("filed"), F.array().cast("array<string>").alias("document"))
    f = connectors.filings_scan(s, form="1-urgent", since="1994-01-01")
    return f.select("cik", "ord", F.replace("accession_number", F.lit("-"), F.lit("")).alias("acc"), "filing_type")


@query("""with f as (select l_returnflag || '-' || (l_suppkey % 50) concept, l_linestatus unit, case l_linestatus when 'F' then 0 else 1 end unit_ord, case when l_linenumber <= 2 then '10-K' else '8-K' end form, strftime(l_shipdate, '%Y-%m-%d') filed, l_extendedprice val, l_orderkey * 10 + l_linenumber as ord, l_partkey from lineitem),
a as (select *, bool_or(form = '10-K') over (partition by concept, unit) has_k from f),
p as (select * from (select *, row_number() over (partition by concept, unit order by filed desc, ord, l_partkey, val) r from a where not has_k or form = '10-K') where r = 1)
select concept, unit, filed, val from (select *, row_number() over (partition by concept order by filed desc, unit_ord) q from p) where q = 1""")
def latest_fact(spark, d):
    li = read(spark, d, "lineitem")
    f = li.select(F.concat("l_returnflag", F.lit("-"), (F.col("l_suppkey") % 50).cast("string")).alias("concept"), F.col("l_linestatus").alias("unit"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("unit_ord"),
                  F.when(F.col("l_linenumber") <= 2, "10-K").otherwise("8-K").alias("form"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("filed"), F.col("l_extendedprice").alias("val"),
                  F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), "l_partkey", "l_extendedprice").alias("ord"))
    return connectors.latest_facts(f, ["concept"]).select("concept", "unit", "filed", "val")


# similarity

PAIRS = """n as (select vec_id, label, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) norm from embeddings),
p as (select a.label, a.vec_id a, b.vec_id b, list_dot_product(a.v, b.v) / (a.norm * b.norm) sim from n a join n b on a.label = b.label and a.vec_id < b.vec_id)"""


@query(f"with {PAIRS} select a, b, round(sim, 6) sim from p where sim >= 0.35")
def cosine_pairs(spark, d):
    return similarity.similar_pairs(read(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.35).withColumn("sim", r6("sim"))


DEDUP = f"""with recursive {PAIRS}, e as (select a, b from p where sim >= 0.30 union select b, a from p where sim >= 0.30),
reach(x, y) as (select vec_id, vec_id from n union select reach.x, e.b from reach join e on e.a = reach.y),
c as (select x vec_id, min(y) cluster from reach group by x)"""


@query(DEDUP + """ select cluster, count(*) cluster_size, arg_min(vec_id, (-(1 - vec_id % 4 / 4.0::double), -(vec_id % 7 / 7.0::double), vec_id)) id, count(*) > 1 is_corroborated from c group by cluster""")
def dedup_clusters(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), "label", "embedding", F.lit("https://a.example.com/1").alias("source_url"), (1 - F.col("vec_id") % 4 / 4.0).alias("source_credibility"), (F.col("vec_id") % 7 / 7.0).alias("confidence_score"))
    return similarity.deduplicate(e, ["label"], "embedding", 0.30).select("cluster", "cluster_size", "id", "is_corroborated")


@query("""with q as (select vec_id query, embedding::double[] v from embeddings where vec_id % 20 = 0), i as (select vec_id item, embedding::double[] v from embeddings),
s as (select query, item, list_dot_product(q.v, i.v) sim from q, i), r as (select *, row_number() over (partition by query order by sim desc, item) rank from s)
select query, item, round(sim, 6) sim, rank::int rank from r where rank <= 3""")
def kb_top3(spark, d):
    e = read(spark, d, "embeddings")
    q, i = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    return similarity.nearest(q, i).withColumn("sim", r6("sim"))


@query("""with q as (select vec_id query, embedding::double[] v from embeddings where vec_id % 20 = 0), i as (select vec_id item, embedding::double[] v from embeddings),
s as (select query, item, round(list_dot_product(q.v, i.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(i.v, i.v))), 9) sim from q, i where list_dot_product(q.v, q.v) > 0 and list_dot_product(i.v, i.v) > 0),
r as (select *, row_number() over (partition by query order by sim desc, item) rank from s) select query, item, round(sim, 6) sim, rank::int rank from r where rank <= 3""")
def kb_index_top3(spark, d):
    """As kb_top3 by cosine, through the index on disk: written if the table is new or has changed, then read back and probed."""
    e = read(spark, d, "embeddings")
    i = index.open_or_build(e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v")), f"{shared_dir(spark)}/knowledge_index")
    return i.search(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))).withColumn("sim", F.round(F.col("sim") * 10**6) / 10**6)  # of 9 digits, so ties are rounded as SQL does


@query("""with n as (select vec_id, vec_id % 10 run_id, label, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) norm, case vec_id % 3 when 0 then 'POSITIVE' when 1 then 'NEGATIVE' else 'NEUTRAL' end pol from embeddings),
p as (select a.run_id, a.vec_id a, b.vec_id b, list_dot_product(a.v, b.v) / (a.norm * b.norm) sim, a.label = b.label and ((a.pol = 'POSITIVE' and b.pol = 'NEGATIVE') or (a.pol = 'NEGATIVE' and b.pol = 'POSITIVE')) opposed from n a join n b on a.run_id = b.run_id and a.vec_id < b.vec_id),
r as (select *, row_number() over (partition by run_id order by sim desc, a desc, b desc) rank from p where opposed or sim >= 0.5) select run_id, a, b, round(sim, 6) sim, rank::int rank from r where rank <= 5""")
def contradiction_pairs(spark, d):
    pol = F.when(F.col("vec_id") % 3 == 0, "POSITIVE").when(F.col("vec_id") % 3 == 1, "NEGATIVE").otherwise("NEUTRAL")
    e = read(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("run_id"), F.col("vec_id").alias("ord"), F.lit("e").alias("entity_name"), F.col("label").cast("string").alias("risk_category"), pol.alias("signal_polarity"), "embedding")
    return similarity.contradiction_candidates(e, "run_id", "embedding").withColumn("sim", r6("sim"))


# evaluation

MATCH = """t as (select label, vec_id truth_id, embedding::double[] v from embeddings where vec_id % 2 = 0), g as (select label, vec_id pred_id, embedding::double[] v from embeddings where vec_id % 2 = 1),
s as (select t.label, truth_id, pred_id, list_dot_product(t.v, g.v) / (sqrt(list_dot_product(t.v, t.v)) * sqrt(list_dot_product(g.v, g.v))) score from t join g on t.label = g.label)"""


def _sides(spark, d):
    e = read(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("v"))
    return e.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "truth_id"), e.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "pred_id")


@query(f"with {MATCH}, r as (select *, row_number() over (partition by truth_id order by score desc, pred_id) k from s) select label, truth_id, pred_id, round(score, 6) score, score >= 0.35 found from r where k = 1")
def truth_match(spark, d):
    return evaluation.best_matches(*_sides(spark, d), "label", 0.35).withColumn("score", r6("score"))


@query(f"with {MATCH}, m as (select label, truth_id, max(score) >= 0.35 found from s group by all) select label, count(*) total, count(*) filter (found) hits, round(avg(found::int), 6) recall from m group by label")
def recall(spark, d):
    return evaluation.share(evaluation.best_matches(*_sides(spark, d), "label", 0.35), ["label"], "found", "recall").withColumn("recall", r6("recall"))


@query(f"with {MATCH}, m as (select label, pred_id, max(score) >= 0.35 matched from s group by all) select label, count(*) total, count(*) filter (matched) hits, round(avg(matched::int), 6) as precision_proxy from m group by label")
def precision_proxy(spark, d):
    return evaluation.share(evaluation.best_truths(*_sides(spark, d), "label", 0.35), ["label"], "matched", "precision_proxy").withColumn("precision_proxy", r6("precision_proxy"))


@query("select count(quality) total, count(*) filter (quality = 1) hits, round(avg(quality), 6) as precision_labelled from labels")
def precision_from_labels(spark, d):
    l = read(spark, d, "labels").withColumn("good", F.col("quality") == 1)
    return evaluation.share(l, [], "good", "precision_labelled", None).withColumn("precision_labelled", r6("precision_labelled"))


BANDS = """b as (select case when n_chars > 8000 then 4 when n_chars > 4000 then 3 when n_chars > 2000 then 2 when n_chars > 1000 then 1 else 0 end x, doc_id % 5 y from documents join labels using (doc_id))"""


@query(f"with {BANDS} select count(*) n, round(avg((x = y)::int), 6) exact, round(avg((abs(x - y) <= 1)::int), 6) within_one from b")
def severity_accuracy(spark, d):
    names = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    n = F.col("n_chars")
    x = F.when(n > 8000, names[4]).when(n > 4000, names[3]).when(n > 2000, names[2]).when(n > 1000, names[1]).otherwise(names[0])
    y = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 5 + 1).cast("int"))
    out = evaluation.severity_accuracy(j.select(x.alias("x"), y.alias("y")), "x", "y")
    return out.select("n", r6("exact").alias("exact"), r6("within_one").alias("within_one"))


@query("""with k as (select user_id % 20 subject, user_id run, list_sort(list_distinct(list(event_type || (event_id % 7)))) ks from events group by all),
j as (select a.subject, len(list_intersect(a.ks, b.ks)) / len(list_distinct(list_concat(a.ks, b.ks)))::double j from k a join k b on a.subject = b.subject and a.run < b.run)
select s.subject, count(j.j) pairs, round(avg(j), 6) mean_jaccard, round(min(j), 6) min_jaccard from (select distinct subject from k) s left join j using (subject) group by all""")
def jaccard_consistency(spark, d):
    k = read(spark, d, "events").groupBy((F.col("user_id") % 20).alias("subject"), F.col("user_id").alias("run")).agg(F.collect_set(F.concat("event_type", (F.col("event_id") % 7).cast("string"))).alias("ks"))
    return similarity.consistency(k, "subject", "run", "ks").select("subject", "pairs", r6("mean_jaccard").alias("mean_jaccard"), r6("min_jaccard").alias("min_jaccard"))


@query("select event_type, round(quantile_cont(value, 0.5), 1) p50, round(quantile_cont(value, 0.95), 1) p95, count(*) n from events where value > 0 group by event_type")
def latency_percentiles(spark, d):
    return evaluation.latency_percentiles(read(spark, d, "events"), ["event_type"], "value")


@query("""with r as (select source, quality = 1 rel, sum((quality = 1)::int) over w hits, count(*) over w k from labels join documents using (doc_id) window w as (partition by source order by doc_id))
select source, round(coalesce(avg(hits / k::double) filter (rel), 0), 6) ap from r group by source""")
def average_precision(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("rel", F.col("quality") == 1)
    return evaluation.average_precision(j, ["source"], ["doc_id"], "rel").withColumn("ap", r6("ap"))


CITED = """t as (select conv_id, string_agg(text || ' [Signal-' || (turn + 1) || ']', ' ' order by turn) || ' [Signal-99] signal-2' body, 3 + conv_id % 3 n_sig from conversations group by conv_id)"""


def _cited(spark, d):
    line = F.concat("text", F.lit(" [Signal-"), (F.col("turn") + 1).cast("string"), F.lit("]"))
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), " ").alias("b"))
    return c.select("conv_id", F.concat("b", F.lit(" [Signal-99] signal-2")).alias("body"), (3 + F.col("conv_id") % 3).alias("n_sig"))


@query(rf"""with {CITED}, r as (select conv_id, n_sig, unnest(regexp_extract_all(body, '(?i)Signal-(\d+)', 1)) ref from t)
select conv_id, count(*) citations, count(*) filter (ref::int > n_sig) orphans, round(avg((ref::int <= n_sig)::int), 6) grounded from r group by conv_id""")
def citation_grounding(spark, d):
    c = _cited(spark, d)
    valid = c.select("conv_id", F.explode(F.transform(F.sequence(F.lit(1), F.col("n_sig")), lambda x: x.cast("string"))).alias("ref"))
    return evaluation.citation_grounding(c, valid, "conv_id", "body").withColumn("grounded", r6("grounded"))


@query(rf"with {CITED} select conv_id, array_to_string(list_filter(list_transform(regexp_extract_all(body, '\[Signal-(\d+)\]', 1), lambda x: x::int), lambda x: x > n_sig), ',') orphans from t")
def verify_citations(spark, d):
    return _cited(spark, d).select("conv_id", F.array_join(F.transform(evaluation.orphan_citations("body", "n_sig"), lambda x: x.cast("string")), ",").alias("orphans"))


@query("""select user_id, count(*) extracted, count(*) filter (event_type = 'error') rejected, round(avg((event_type = 'error')::int), 6) rejection_rate, round(1 - avg((event_type = 'error')::int), 6) pass_rate from events group by user_id""")
def verification_stats(spark, d):
    e = read(spark, d, "events").select("user_id", F.lit(1).alias("extracted"), (F.col("event_type") == "error").cast("int").alias("rejected"))
    return evaluation.verification_stats(e, "user_id").select("user_id", "extracted", "rejected", r6("rejection_rate").alias("rejection_rate"), r6("pass_rate").alias("pass_rate"))


# review, stores and history


@query(f"""with {SIGNALS}, v as (select id, case when id % 2 = 0 then 'DISMISSED' when id % 3 = 0 then 'CONFIRMED' end as verdict from signals where id % 5 = 0)
select id, verdict human_verdict, verdict is null and (severity = 'CRITICAL' or confidence_score < 0.6) requires_human_review from signals left join v using (id) where verdict is null or verdict <> 'DISMISSED'""")
def apply_verdicts(spark, d):
    s = signals(spark, d).withColumn("requires_human_review", C.needs_review("severity", "confidence_score"))
    v = s.where("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, " Dismiss").when(F.col("id") % 3 == 0, "c").otherwise("what").alias("verdict"))
    return review.apply_verdicts(s, v).select("id", "human_verdict", "requires_human_review")


@query("select o_orderkey, o_orderstatus from orders where o_orderkey % 3 <> 0 union all select o_orderkey, 'live' from orders where o_orderkey % 2 = 0 and o_orderkey % 3 = 0")
def run_history(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return tables.run_history(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("live")), "o_orderkey")


@query("select event_id from events where ts > timestamp '2024-01-15 00:00:00'")
def ttl_lookup(spark, d):
    return tables.live(read(spark, d, "events"), "2024-01-15 00:00:00", "ts").select("event_id")


@query("select count(*) purged from events where ts <= timestamp '2024-01-15 00:00:00'")
def purge_expired(spark, d):
    return tables.expired(read(spark, d, "events"), "2024-01-15 00:00:00", "ts").agg(F.count("*").alias("purged"))


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1")
def upsert_latest(spark, d):
    return tables.latest(read(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("select event_id, event_type from events order by event_id desc limit 200")
def audit_tail(spark, d):
    return tables.audit_tail(read(spark, d, "events"), order="event_id").select("event_id", "event_type")


@query("select conv_id, turn, model, round(case model when 'gemini-2.5-flash-lite' then 0.1e-6 * length(text) + 0.4e-6 * turn when 'gemini-2.5-pro' then 1.25e-6 * length(text) + 1e-5 * turn else 0.075e-6 * length(text) + 0.3e-6 * turn end, 9) cost_usd from (select *, case role when 'user' then 'gemini-2.5-flash-lite' when 'system' then 'other' else 'gemini-2.5-pro' end model from conversations)")
def llm_cost(spark, d):
    model = F.when(F.col("role") == "user", "gemini-2.5-flash-lite").when(F.col("role") == "system", "other").otherwise("gemini-2.5-pro")
    c = read(spark, d, "conversations").select("conv_id", "turn", model.alias("model"), F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"))
    return scoring.llm_cost(c).select("conv_id", "turn", "model", F.round("cost_usd", 9).alias("cost_usd"))


@query(f"""with {SIGNALS}, {ADJUSTED}, {SCORES}, o as (select run_id, round(sum(score * n) / sum(n), 2) overall from scores group by run_id)
select run_id, overall, count(*) filter (signal_polarity <> 'POSITIVE') n_risks, count(*) filter (signal_polarity = 'POSITIVE') n_strengths, count(*) signals_extracted from o join signals using (run_id) group by all""")
def report_rows(spark, d):
    s = ranking.number_signals(scoring.apply_credibility(signals(spark, d))).withColumns({"text": F.col("risk_category"), "source_url": F.lit("https://a.example.com")})
    sc = scoring.category_scores(s, "run_id")
    r = reports.report_rows(s, sc, scoring.overall_score(sc, "run_id"))
    return r.select("run_id", "overall", F.size("risk_signals").cast("long").alias("n_risks"), F.size("positive_signals").cast("long").alias("n_strengths"), "signals_extracted")


# single steps


STEP = "case event_type when 'signup' then 'queued' when 'view' then 'researching' when 'click' then 'synthesizing' when 'purchase' then 'complete' when 'error' then 'error' else 'other' end"


@query(f"select event_id, case {STEP} when 'queued' then 0 when 'researching' then 1 when 'synthesizing' then 5 when 'complete' then 6 when 'error' then -1 else 0 end::int step from events")
def status_steps(spark, d):
    status = C.lookup("event_type", {"signup": "queued", "view": "researching", "click": "synthesizing", "purchase": "complete", "error": "error"}, "other")
    return read(spark, d, "events").select("event_id", C.step_index(status).alias("step"))


@query("""select event_id, event_type = 'error' or event_id % 5 in (0, 1, 2) passes from events""")
def retryable_errors(spark, d):
    k = F.col("event_id") % 5
    told = F.when(F.col("event_type") == "error", "Service Unavailable").when(k == 0, "HTTP 502").when(k == 1, "504 gateway").when(k == 2, "model overloaded").when(k == 3, "400 bad request").otherwise("not found")
    return read(spark, d, "events").select("event_id", C.retryable(told).alias("passes"))


@query("""select doc_id, 'https://n.example.com/' || doc_id url from documents where lang = 'en' and contains(lower(substr(text, 1, 40) || ' ' || text), 'the') and date '2024-01-01' + (doc_id % 365)::int between date '2024-03-01' and date '2024-09-30'
order by doc_id % 365 desc, url limit 10""")
def news_search(spark, d):
    docs = read(spark, d, "documents").select(
        "doc_id", F.substring("text", 1, 40).alias("title"), F.lit(None).cast("string").alias("description"), F.col("text").alias("content"), F.concat(F.lit("https://n.example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("lang").alias("language"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("published_at"),
    )
    return connectors.search_news(docs, " The ", "2024-03-01", "2024-09-30").select("doc_id", "url")


LOW = r"lower(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')))"


@query(f"""with s as (select doc_id, case when doc_id % 3 = 0 then reverse(substr(text, 11, 40)) else substr(text, 11, 40) end snippet, substr(text, 1, 60) claim, text body, substr(text, 20 + (doc_id % 60)::int, 5) tr from documents)
select doc_id, contains({LOW.format('body')}, {LOW.format('snippet')}) verbatim, contains({LOW.format('snippet')}, {LOW.format('tr')}) or contains({LOW.format('claim')}, {LOW.format('tr')}) trap,
contains({LOW.format('body')}, {LOW.format('snippet')}) and not (contains({LOW.format('snippet')}, {LOW.format('tr')}) or contains({LOW.format('claim')}, {LOW.format('tr')})) ok from s""")
def extraction_checks(spark, d):
    snippet = F.substring("text", 11, 40)
    s = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.reverse(snippet)).otherwise(snippet).alias("snippet"), F.substring("text", 1, 60).alias("claim"), F.col("text").alias("body"), F.array(F.expr("substring(text, 20 + cast(doc_id % 60 as int), 5)")).alias("traps"))
    return evaluation.extraction_checks(s).select("doc_id", "verbatim", "trap", "ok")


COMPANY = f"""{MATCH}, m as (select label, truth_id, max(score) >= 0.35 found from s group by all), pm as (select label, pred_id, max(score) >= 0.35 matched from s group by all),
ev as (select user_id % 10 as label, count(*) extracted, count(*) filter (event_type = 'error') rejected from events group by 1),
c as (select ev.label::int as label, (select avg(found::int) from m where m.label = ev.label) recall, (select avg(matched::int) from pm where pm.label = ev.label) prec, rejected / extracted::double rejection_rate, ev.label % 2 = 0 sufficiency_exact, extracted <= 50 compliant from ev)"""


def _companies(spark, d):
    e = read(spark, d, "events").groupBy((F.col("user_id") % 10).cast("int").alias("label")).agg(F.count("*").alias("extracted"), F.count_if(F.col("event_type") == "error").alias("rejected"))
    e = e.select("*", F.col("extracted").alias("calls"), F.lit(0.5).alias("cost"), F.lit(1.0).alias("seconds"), F.lit("RICH").alias("tier"), F.when(F.col("label") % 2 == 0, "RICH").otherwise("SPARSE").alias("expected_tier"))
    t, g = _sides(spark, d)
    return evaluation.company_metrics(e, evaluation.best_matches(t, g, "label", 0.35), evaluation.best_truths(t, g, "label", 0.35), "label")


@query(f"with {COMPANY} select label, round(recall, 6) recall, round(prec, 6) as precision_share, round(rejection_rate, 6) rejection_rate, sufficiency_exact, compliant from c")
def company_metrics(spark, d):
    return _companies(spark, d).select("label", r6("recall").alias("recall"), r6("precision").alias("precision_share"), r6("rejection_rate").alias("rejection_rate"), "sufficiency_exact", "compliant")


@query(f"with {COMPANY} select round(avg(recall), 6) recall_mean, round(avg(prec), 6) precision_mean, round(avg(sufficiency_exact::int), 6) sufficiency_exact_rate, round(avg(compliant::int), 6) compliance_rate, false any_cached, count(*) n from c")
def company_aggregate(spark, d):
    out = evaluation.aggregate_metrics(_companies(spark, d).withColumn("cached", F.lit(False)))
    return out.select(r6("recall_mean").alias("recall_mean"), r6("precision_mean").alias("precision_mean"), r6("sufficiency_exact_rate").alias("sufficiency_exact_rate"), r6("compliance_rate").alias("compliance_rate"), "any_cached", "n")


@query("""with b as (select (event_id % 4)::int x, (value / 25)::int % 4 y from events) select count(*) n, round(avg((x = y)::int), 6) exact, round(avg((abs(x - y) <= 1)::int), 6) within_one from b""")
def sufficiency_bands(spark, d):
    names = F.array(*map(F.lit, sorted(fixed.SUFFICIENCY_RANK, key=fixed.SUFFICIENCY_RANK.get)))
    e = read(spark, d, "events").select(F.get(names, (F.col("event_id") % 4).cast("int")).alias("x"), F.get(names, (F.bround(F.col("value") / 25).cast("int") % 4)).alias("y"))
    out = evaluation.sufficiency_accuracy(e, "x", "y")
    return out.select("n", r6("exact").alias("exact"), r6("within_one").alias("within_one"))


@query(f"with {SIGNALS} select run_id, count(*) n, count(*) filter (id % 3 = 0) corroborated, round(avg((id % 3 = 0)::int), 6) corroboration_rate, count(*) filter (id % 7 = 0) contradictory from signals group by run_id")
def dedup_summary(spark, d):
    s = signals(spark, d).withColumns({"is_corroborated": F.col("id") % 3 == 0, "is_contradictory": F.col("id") % 7 == 0})
    return evaluation.dedup_stats(s, "run_id").withColumn("corroboration_rate", r6("corroboration_rate"))


@query(f"with {SIGNALS} select id, severity from signals order by {RANK} desc, confidence_score desc, ord limit 100")
def severity_order(spark, d):
    return ranking.by_severity(signals(spark, d)).select("id", "severity").limit(100)


@query(f"""with {SIGNALS}, {ADJUSTED}, {SCORES}, f as (select run_id, risk_category, min(ord) first_seen from signals group by all)
select run_id, risk_category, row_number() over (partition by run_id order by score desc, first_seen) section_rank from scores join f using (run_id, risk_category)""")
def section_order(spark, d):
    s = scoring.apply_credibility(signals(spark, d))
    seen = s.groupBy("run_id", "risk_category").agg(F.min("ord").alias("first_seen"))
    out = reports.category_order(scoring.category_scores(s, "run_id").join(seen, ["run_id", "risk_category"]))
    return out.select("run_id", "risk_category", F.col("section_rank").cast("long").alias("section_rank"))


@query("select user_id, event_type, min(event_id) event_id from events group by all")
def first_of_each(spark, d):
    return ranking.ordered_distinct(read(spark, d, "events"), ["user_id"], "event_type", "event_id").select("user_id", "event_type", "event_id")


@query("select user_id run_id, count(*) calls, round(sum(value / 1000), 6) as cost, count(*) >= 50 or sum(value / 1000) >= 1.0 halted from events group by user_id")
def run_spending(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.col("value") / 1000).alias("cost_usd"))
    return runs.spending(e).withColumn("cost", r6("cost"))


@query("""with c as (select o_orderkey, o_custkey from orders where o_orderkey % 2 = 0 and o_orderdate > timestamp '1995-01-01') select o.o_orderkey, c.o_custkey is not null hit from orders o left join c using (o_orderkey)""")
def cached_lookup(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("https://x/"), F.col("o_orderkey").cast("string")).alias("url"), F.lit("e").alias("entity"), "o_orderdate")
    cache = o.where("o_orderkey % 2 = 0").select(C.cache_key("url", "entity").alias("cache_key"), F.lit("{}").alias("json_blob"), F.col("o_orderdate").cast("timestamp_ntz").alias("expires_at"))
    return tables.cached_documents(o.drop("o_orderdate"), cache, "1995-01-01 00:00:00").select("o_orderkey", F.col("json_blob").isNotNull().alias("hit"))


@query("select event_id from events where event_type <> 'error'")
def invalidated_cache(spark, d):
    e = read(spark, d, "events").withColumn("cache_key", F.col("event_id").cast("string"))
    return tables.invalidate(e, e.where("event_type = 'error'").select("cache_key")).select("event_id")


@query("select conv_id, count(*) extracted, count(*) filter (turn % 2 = 0) supported, round(avg((turn % 2 = 0)::int), 6) faithfulness, round(avg(1.0::double / (1 + turn)), 6) answer_relevancy from conversations group by conv_id")
def judge_metrics(spark, d):
    c = read(spark, d, "conversations")
    s = c.select("conv_id", (F.col("turn") % 2 == 0).alias("supported"))
    j = evaluation.judged(s, c.select("conv_id", (F.lit(1.0) / (1 + F.col("turn"))).alias("relevancy")), "conv_id")
    n = s.groupBy("conv_id").agg(F.count("*").alias("extracted"), F.count_if("supported").alias("supported"))
    return n.join(j, "conv_id").select("conv_id", "extracted", "supported", r6("faithfulness").alias("faithfulness"), r6("answer_relevancy").alias("answer_relevancy"))


@query("""with r as (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) k from supplier)
select s_nationkey, 0 as ord, string_agg(s_suppkey::varchar, ',' order by s_suppkey) ids from r where k <= 5 group by s_nationkey union all select s_nationkey, 1, s_suppkey::varchar from r where k = 1""")
def registry_documents(spark, d):
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    hits = s.select(F.col("s_nationkey").alias("entity"), F.col("s_suppkey").alias("ord"), k.alias("id"), F.lit("n").alias("name"), F.lit("active").alias("status"), F.concat(F.lit("https://r/"), k).alias("url"))
    out = connectors.registry_lookup(hits, s.select(k.alias("id"), F.concat(F.lit("n | "), k, F.lit(" | active")).alias("body")))
    return out.select(F.col("entity").alias("s_nationkey"), "ord", F.array_join(F.regexp_extract_all("text", F.lit(r"\| (\d+) \|"), 1), ",").alias("ids"))


@query()
def lexical_match(spark, d):
    """For each question of a conversation the answer of best lexical score."""
    c = read(spark, d, "conversations").withColumn("run_id", F.col("conv_id"))
    t, p = c.where("role = 'user'").select("run_id", F.col("turn").alias("truth_id"), "text"), c.where("role <> 'user'").select("run_id", F.col("turn").alias("pred_id"), "text")
    return evaluation.lexical_matches(t, p)


@query()
def score_signals(spark, d):
    """Vectors as signals, ten runs, graded within their budgets by the knowledge nearest to them: the benchmark's passages with vectors of their own."""
    e = read(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("run_id"), F.col("vec_id").alias("ord"), F.col("vec_id").alias("id"), F.concat(F.lit("signal "), F.col("label").cast("string")).alias("text"), F.lit("LEGAL").alias("risk_category"), F.lit("LOW").alias("severity"), F.lit(0.7).alias("confidence_score"), "embedding")
    grade = F.element_at(F.array(*map(F.lit, ["info", "low", "medium", "high", "critical"])), (F.col("item_id") % 5 + 1).cast("int"))
    k = read(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.concat(grade, F.lit(" severity: "), F.col("text")).alias("text")).join(read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "embedding"), "item")
    return whole.score_signals(e, k).select("id", "run_id", "severity", "severity_error", "requires_human_review")


@query(f"""with {SIGNALS}, num as (select *, row_number() over (partition by run_id order by (signal_polarity = 'POSITIVE')::int, ord) num from signals where run_id % 10 <> 3),
t as (select run_id, case when run_id % 2 = 0 then 'RICH' else 'SPARSE' end tier from signals group by run_id),
c as (select run_id, count(distinct risk_category) n_sections, count(distinct risk_category) filter (f = num and severity = 'CRITICAL') n_urgent from (select *, min(num) over (partition by run_id, risk_category) f from num where signal_polarity <> 'POSITIVE') group by run_id),
g as (select run_id, count(*) filter (signal_polarity = 'POSITIVE') n_good, count(distinct event_url) n_sources, arg_min(event_url, num) first_source from (select *, 'https://e.example.com/' || risk_category event_url from num) group by run_id)
select t.run_id, coalesce(n_sections, 0)::bigint n_sections, coalesce(n_urgent, 0)::bigint n_urgent, coalesce(n_sources, 0)::bigint n_sources, first_source,
case when tier = 'SPARSE' then 'Based on limited data. ' else '' end || case when g.run_id is null then 'No material risk signals were identified from the available data sources.' else 'run ' || t.run_id || ': ' || coalesce(n_sections, 0) || ' areas of risk' end summary,
case when g.run_id is null then 'No material strengths identified from available data.' else n_good || ' strengths' end strengths from t left join c using (run_id) left join g using (run_id)""")
def report_struct(spark, d):
    s = signals(spark, d)
    tiers = s.groupBy("run_id").agg(F.when(F.col("run_id") % 2 == 0, "RICH").otherwise("SPARSE").alias("tier"))
    s = s.where("run_id % 10 <> 3").withColumns({"text": F.col("risk_category"), "source_snippet": F.col("risk_category"), "source_type": F.lit("NEWS_ARTICLE"), "is_unverified": F.lit(False), "entity_name": F.concat(F.lit("run "), F.col("run_id").cast("string")), "source_url": F.concat(F.lit("https://e.example.com/"), F.col("risk_category"))})
    s = ranking.number_signals(s)
    r = whole.synthesise(s, scoring.category_scores(s.where("signal_polarity <> 'POSITIVE'"), "run_id"), tiers)
    urgent = F.size(F.filter(F.coalesce("actions", F.array()), lambda a: (a["priority"] == fixed.PRIORITIES[0]) & (F.size(a["related_signals"]) == 1)))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return r.select("run_id", n("sections").alias("n_sections"), urgent.cast("long").alias("n_urgent"), n("sources").alias("n_sources"), F.get("sources", F.lit(0))["url"].alias("first_source"), "summary", "strengths")


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'top_hit' when c_custkey % 7 = 1 then 'blocked' when c_custkey % 5 = 0 then 'stub' else 'not_found' end status, c_custkey % 3 = 0 or c_custkey % 7 = 1 or c_custkey % 5 = 0 as found from customer""")
def resolve_outcomes(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("raw"))
    hits = c.where("c_custkey % 3 = 0").select("raw", F.lit(0).alias("ord"), F.col("raw").alias("legal_name"), F.lit("US_NY").alias("jurisdiction_code"), F.lit("llc").alias("company_type"), F.col("c_custkey").cast("string").alias("id"))
    out = resolution.outcomes(resolution.resolve(c, hits), c.where("c_custkey % 5 = 0"), c.where("c_custkey % 7 = 1"))
    return out.select("c_custkey", "status", "found")


@query("select sha256(lower(trim(c_name)) || '||') cache_key, timestamp '2025-01-31 00:00:00' expires_at from customer where c_custkey % 4 <> 0")
def cache_writes(spark, d):
    c = read(spark, d, "customer").select(F.col("c_name").alias("raw"), F.when(F.col("c_custkey") % 4 == 0, "not_found").otherwise("stub").alias("status"))
    return resolution.to_cache(c, "2025-01-01 00:00:00", 30).select("cache_key", "expires_at")


@query("""with g as (select doc_id, unnest([doc_id + 1, doc_id + 2]) page_id, unnest([0, 1]) as ord from documents), p as (select g.doc_id, g.ord, g.page_id from g join documents d on d.doc_id = g.page_id where contains(lower(d.text), 'the '))
select doc_id, arg_min(page_id, ord) page_id from p group by doc_id""")
def website_first_hit(spark, d):
    docs = read(spark, d, "documents")
    g = docs.select(F.col("doc_id").alias("entity"), F.posexplode(F.array(F.col("doc_id") + 1, F.col("doc_id") + 2)).alias("ord", "url"))
    names = docs.select(F.col("doc_id").alias("entity"), F.array(F.lit("the ")).alias("names"))
    out = connectors.website_documents(g, docs.select(F.col("doc_id").alias("url"), "text"), names)
    return out.select(F.col("entity").alias("doc_id"), F.col("url").alias("page_id"))


@query(f"with {SIGNALS} select run_id, count(*) filter (signal_polarity <> 'POSITIVE') n_risks, count(*) filter (signal_polarity = 'POSITIVE') n_strengths, 'SPARSE' data_sufficiency, count(*) signals_extracted from signals group by run_id")
def adapted_reports(spark, d):
    e = signals(spark, d).groupBy(F.col("run_id").alias("entity_name")).agg(F.collect_list(F.struct("id", "signal_polarity", "severity")).alias("signals"))
    r = connectors.adapted_reports(e)
    return r.select(F.col("entity_name").alias("run_id"), F.size("risk_signals").cast("long").alias("n_risks"), F.size("positive_signals").cast("long").alias("n_strengths"), "data_sufficiency", "signals_extracted")


@query("""select doc_id, md5('Organisation: ' || source || chr(10) || 'Find every statement of risk or strength about it, each with its exact quote.' || chr(10) || 'Document:' || chr(10) || substr(text, 1, 200)) digest from documents""")
def extraction_prompts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(reports.extraction_prompt("source", "text", 200)).alias("digest"))


# event time, beyond what the rest needs


@query("select time_bucket(interval '1 hour', ts) as start, time_bucket(interval '1 hour', ts) + interval '1 hour' as \"end\", event_type, count(*) n, round(sum(value), 4) total from events group by all")
def event_windows(spark, d):
    w = runs.windows(read(spark, d, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from e)
select user_id, min(ts) as start, max(ts) + interval '30 minutes' as "end", count(*) n, round(sum(value), 4) total from s group by user_id, k""")
def event_sessions(spark, d):
    w = runs.sessions(read(spark, d, "events"))
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))


# whole runs


@query()
def pipeline_end_to_end(spark, d):
    """Reports of a run for each source of documents, by the rule provider and the hashing embedder, graded by the benchmark's passages."""
    docs = read(spark, d, "documents").select(
        "doc_id", F.col("source").alias("run_id"), F.col("source").alias("entity_name"), F.concat(F.lit("https://"), F.col("lang"), F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.when(F.col("lang") == "en", "NEWS_ARTICLE").when(F.col("lang") == "de", "COURT_RECORD").otherwise("COMPANY_WEBSITE").alias("source_type"), "text",
    )
    rubric = read(spark, d, "benchmark").select(F.format_string("item%d", "item_id").alias("source"), "text")
    r = whole.run(spark, docs, TODAY, knowledge=whole.knowledge_pieces(rubric))["reports"]
    text = [F.to_json(c).alias(c) for c in ("category_scores", "sections", "actions", "sources")]
    return r.select("run_id", "tier", "overall", "summary", "strengths", "signals_extracted", "signals_rejected", *text)
