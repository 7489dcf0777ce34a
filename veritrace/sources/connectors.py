"""Scans of outside sources: a Python data source around an injected fetch, and the operators on what it returns.

A fetch takes one request (a dict of strings) and returns JSON-like rows, or a dict with `error`. It
runs in tasks, one partition a request, with retries; a failure becomes a row with an error code.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veritrace.functions import columns as C
from veritrace.functions import fixed
from veritrace.functions.fuzzy import html_to_text
from veritrace.operators.ranking import first_rows, newest_by_form

#: status of a response, error code
ERRORS = {"400": "bad_request", "401": "auth_error", "403": "auth_error", "404": "not_found", "429": "rate_limited", "503": "unavailable", "timeout": "timeout"}
ANNUAL = ["10-K", "20-F", "10-K/A", "20-F/A"]


def error_code(status: Column | str) -> Column:
    return C.lookup(status, ERRORS, "api_error")


def with_retries(fetch: Callable[[dict], object], request: dict, attempts: int = 3, wait: float = 1.0, retry: tuple[str, ...] = ("rate_limited", "unavailable", "timeout")) -> object:
    """The fetch's answer; passing errors are tried again, each wait twice the one before."""
    for k in range(attempts):
        try:
            got = fetch(request)
        except TimeoutError as e:
            got = {"error": "timeout", "message": str(e)}
        except Exception as e:
            return {"error": "api_error", "message": str(e)}
        if not (isinstance(got, dict) and got.get("error") in retry) or k == attempts - 1:
            return got
        time.sleep(wait * 2**k)
    return got


def connector(spark: SparkSession, name: str, fetch: Callable[[dict], object], wait: float = 1.0) -> Callable[[list[dict]], DataFrame]:
    """Register a data source of that name; the result scans a list of requests.

    Rows: request, ord, payload (JSON), error, message. Requests are a stated, small list: one for each
    name or key asked for, each a partition of its own.
    """

    class Reader(DataSourceReader):
        def __init__(self, requests: list[dict]):
            self.requests = requests

        def partitions(self):
            return [InputPartition(r) for r in self.requests]

        def read(self, partition):
            r = partition.value
            got = with_retries(fetch, r, wait=wait)
            told = json.dumps(r, sort_keys=True)
            if isinstance(got, dict) and "error" in got:
                yield told, 0, None, str(got["error"]), str(got.get("message", ""))
                return
            for i, x in enumerate(rows_of(got)):
                yield told, i, json.dumps(x), None, None

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "request string, ord int, payload string, error string, message string"

        def reader(self, schema):
            return Reader(json.loads(self.options["requests"]))

    spark.dataSource.register(Source)
    return lambda requests: spark.read.format(name).option("requests", json.dumps(requests)).load()


#: Comparisons that a search takes, by the class of the filter: what it is called in the request, and what it means.
COMPARED = {
    "EqualTo": ("=", lambda x, v: x == v), "In": ("in", lambda x, v: x in v), "GreaterThan": (">", lambda x, v: x > v),
    "GreaterThanOrEqual": (">=", lambda x, v: x >= v), "LessThan": ("<", lambda x, v: x < v), "LessThanOrEqual": ("<=", lambda x, v: x <= v),
}


def _typed(x: object, kind: str) -> object:
    """A value of a JSON row as string, long, double or date; null where it is none."""
    try:
        return None if x is None else {"string": str, "long": int, "double": float, "date": lambda v: date.fromisoformat(str(v)[:10])}[kind](x)
    except ValueError:
        return None


def searched(spark: SparkSession, name: str, fetch: Callable[[dict], object], columns: dict[str, str], wait: float = 1.0) -> Callable[[list[dict]], DataFrame]:
    """As connector, for a service that can search: columns of its rows, of type string, long, double or date, can be compared in `where`.

    What compares them with values goes into each request, as `filters` of column, comparison and
    value, so the service sends less; rows that it sends all the same are left out here, and Spark
    filters nothing again. As in any table, a row of an error has null columns and meets no
    comparison. Pushing needs spark.sql.python.filterPushdown.enabled, here and in later scans; where
    it is not set at this call, Spark filters.
    """

    class Reader(DataSourceReader):
        def __init__(self, requests: list[dict]):
            self.requests, self.pushed = requests, []

        def pushFilters(self, filters):  # noqa: N802
            for f in filters:
                kind = type(f).__name__
                if kind == "IsNotNull" and f.attribute[0] in columns:
                    self.pushed.append((f.attribute[0], "filled", None))
                elif kind in COMPARED and f.attribute[0] in columns:
                    self.pushed.append((f.attribute[0], kind, f.value))
                else:
                    yield f

        def partitions(self):
            return [InputPartition(r) for r in self.requests]

        def read(self, partition):
            r = partition.value
            told = json.dumps(r, sort_keys=True)
            plain = lambda v: [plain(x) for x in v] if isinstance(v, list | tuple) else v.isoformat() if isinstance(v, date) else v
            asked = [[c, COMPARED[k][0], plain(v)] for c, k, v in self.pushed if k != "filled"]
            got = with_retries(fetch, {**r, "filters": asked} if asked else r, wait=wait)
            if isinstance(got, dict) and "error" in got:
                if not self.pushed:
                    yield (told, 0, *(None for _ in columns), None, str(got["error"]), str(got.get("message", "")))
                return
            for i, x in enumerate(rows_of(got)):
                own = {c: _typed(x.get(c), kind) if isinstance(x, dict) else None for c, kind in columns.items()}
                if all(own[c] is not None and (k == "filled" or COMPARED[k][1](own[c], v)) for c, k, v in self.pushed):
                    yield (told, i, *own.values(), json.dumps(x), None, None)

    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        del Reader.pushFilters

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "request string, ord int, " + "".join(f"`{c}` {kind}, " for c, kind in columns.items()) + "payload string, error string, message string"

        def reader(self, schema):
            return Reader(json.loads(self.options["requests"]))

    spark.dataSource.register(Source)
    return lambda requests: spark.read.format(name).option("requests", json.dumps(requests)).load()


def rows_of(got: object) -> list:
    """A list, or the first filled one of data, companies, results; anything else is a row of its own."""
    if isinstance(got, list):
        return got
    if isinstance(got, dict):
        for k in ("data", "companies", "results"):
            if got.get(k):
                return got[k] if isinstance(got[k], list) else [got[k]]
        return [] if any(k in got for k in ("data", "companies", "results")) else [got]
    return []


def filings_scan(submissions: DataFrame, form: str | None = None, since: str | None = None, until: str | None = None, most: int = 40) -> DataFrame:
    """(cik, ord, accession_number, filing_type, filing_date, primary_document) of parallel arrays; short ones are padded with ''.

    submissions (cik, accession, form, filed, document): arrays in the order of filing. The first `most` that pass stay.
    """
    z = submissions.select("cik", F.size("accession").alias("_n"), F.posexplode(F.arrays_zip("accession", "form", "filed", "document")).alias("ord", "z")).where("ord < _n")
    e = lambda c: F.coalesce(F.col(f"z.{c}"), F.lit(""))
    f = z.select("cik", "ord", C.dashed_accession("z.accession").alias("accession_number"), e("form").alias("filing_type"), e("filed").alias("filing_date"), e("document").alias("primary_document"))
    if form:
        f = f.where(F.upper("filing_type") == form.upper())
    if since:
        f = f.where(F.col("filing_date") >= since)
    if until:
        f = f.where(F.col("filing_date") <= until)
    return first_rows(f, ["cik"], [F.col("ord").asc()], most)


def filings_for_research(filings: DataFrame) -> DataFrame:
    """The newest annual, quarterly and two current reports of each filer."""
    return newest_by_form(filings, "cik", "filing_type", [F.col("filing_date").desc(), F.col("ord").asc()], {"10-K": 1, "10-Q": 1, "8-K": 2})


def filing_texts(wanted: DataFrame, filings: DataFrame, pages: DataFrame) -> DataFrame:
    """wanted (cik, accession_number) with document and text: the primary document, else the submission's text file.

    pages (cik, document, body). A body with tags is read as HTML; texts end at the cap.
    """
    first = first_rows(filings.select("cik", "accession_number", "primary_document", "ord"), ["cik", "accession_number"], [F.col("ord").asc()], 1)
    d = wanted.join(first.drop("ord"), ["cik", "accession_number"], "left")
    d = d.withColumn("document", F.coalesce(F.nullif("primary_document", F.lit("")), F.concat("accession_number", F.lit(".txt")))).drop("primary_document")
    j = d.join(pages, ["cik", "document"], "left")
    text = F.when(F.contains("body", F.lit("<")), html_to_text(F.when(F.contains("body", F.lit("<")), F.col("body")))).otherwise(F.col("body"))
    return j.withColumn("text", F.substring(text, 1, fixed.TEXT_CAP)).drop("body")


def latest_facts(facts: DataFrame, by: list[str]) -> DataFrame:
    """The newest value of each concept: per unit the newest annual form, else the newest; over units the strictly newest, the first of equals.

    facts (*by, unit, unit_ord, ord, form, filed, val).
    """
    w = W.partitionBy(*by, "unit")
    f = facts.withColumn("_annual", F.col("form").isin(ANNUAL) & (F.coalesce("filed", F.lit("")) != ""))
    f = f.withColumn("_any", F.max(F.col("_annual").cast("int")).over(w)).where((F.col("_any") == 0) | F.col("_annual"))
    per = first_rows(f, [*by, "unit"], [F.coalesce("filed", F.lit("")).desc(), F.col("ord").asc()], 1)
    per = per.where(F.coalesce("filed", F.lit("")) > "")
    return first_rows(per, by, [F.col("filed").desc(), F.col("unit_ord").asc()], 1).drop("_annual", "_any", "ord", "unit_ord", "form")


def search_documents(results: DataFrame, names: DataFrame, by: str = "entity", cap: int = fixed.DOCS_A_SOURCE) -> DataFrame:
    """Documents of a web search: first of each url, with the fullest text, that mention the entity.

    results (entity, ord, url, raw_content, content, snippet), names (entity, names array).
    """
    r = first_rows(results.where("url is not null"), [by, "url"], [F.col("ord").asc()], 1)
    e = lambda c: F.nullif(F.col(c), F.lit(""))
    r = r.withColumn("text", F.substring(F.coalesce(e("raw_content"), e("content"), e("snippet"), F.lit("")), 1, fixed.TEXT_CAP))
    r = r.join(names, by).where(C.mentions("text", F.col("names"))).drop("names")
    return first_rows(r, [by], [F.col("ord").asc()], cap)


def fetched_pages(pages: DataFrame) -> DataFrame:
    """Answers with status 200 as text, HTML or of no type read as such; under 100 characters go. pages (url, status, content_type, body)."""
    is_html = F.col("content_type").isNull() | F.lower("content_type").contains("html")
    text = F.when(is_html, html_to_text(F.when(is_html, F.col("body")))).otherwise(F.col("body"))
    return pages.where("status = 200").withColumn("text", F.substring(text, 1, fixed.TEXT_CAP)).where(F.length(F.trim("text")) >= 100).drop("body")


def website_guesses(entities: DataFrame, name: str = "canonical_name") -> DataFrame:
    """Candidate addresses of an entity's own site, in the order they are tried."""
    base = F.regexp_replace(F.lower(F.substring_index(F.col(name), ",", 1)), "[^a-z0-9]", "")
    urls = F.array(F.concat(F.lit("https://www."), base, F.lit(".com")), F.concat(F.lit("https://"), base, F.lit(".com/about")))
    return entities.where(F.length(base) > 0).select("*", F.posexplode(urls).alias("ord", "url"))


def website_documents(guesses: DataFrame, pages: DataFrame, names: DataFrame, by: str = "entity") -> DataFrame:
    """(by, url, text): for each entity the first of its guessed addresses whose page mentions it.

    guesses (by, ord, url), pages (url, text), names (by, names array).
    """
    hit = guesses.select(by, "ord", "url").join(pages.select("url", "text"), "url").join(names.select(by, "names"), by).where(C.mentions("text", F.col("names")))
    return first_rows(hit, [by], [F.col("ord").asc()], 1).select(by, "url", "text")


def adapted_reports(exports: DataFrame) -> DataFrame:
    """Exports that hold signals alone in the shape of reports: absent parts are empty, or what their signals tell."""
    have = lambda c, other: F.coalesce(F.col(c), other) if c in exports.columns else other
    s = F.coalesce("signals", F.array())
    risk, good = F.filter(s, lambda x: x["signal_polarity"] != "POSITIVE"), F.filter(s, lambda x: x["signal_polarity"] == "POSITIVE")
    return exports.select("entity_name", have("risk_signals", risk).alias("risk_signals"), have("positive_signals", good).alias("positive_signals"), have("data_sufficiency", F.lit("SPARSE")).alias("data_sufficiency"), F.size(s).cast("long").alias("signals_extracted"))


def news_documents(articles: DataFrame, names: DataFrame, by: str = "entity", cap: int = fixed.DOCS_A_SOURCE) -> DataFrame:
    """Articles, newest first, as title, description and content; short and foreign ones go."""
    a = articles.withColumn("text", C.joined("\n\n", "title", "description", "content")).where(F.length("text") >= 50)
    a = a.join(names, by).where(C.mentions("text", F.col("names"))).drop("names")
    return first_rows(a, [by], [F.col("published_at").desc(), F.col("url").asc()], cap)


def search_news(articles: DataFrame, query: str, since: str | None = None, until: str | None = None, language: str = "en", page: int = fixed.DOCS_A_SOURCE) -> DataFrame:
    """The newest articles (title, description, content, url, language, published_at) of a language that hold the query as it stands, in any case, within the dates; a blank query is an error."""
    if not query.strip():
        raise ValueError("query must not be empty")
    text = F.lower(C.joined(" ", "title", "description", "content"))
    a = articles.where((F.col("language") == language) & F.contains(text, F.lit(query.strip().lower())))
    if since:
        a = a.where(F.col("published_at") >= F.lit(since).cast("date"))
    if until:
        a = a.where(F.col("published_at") < F.date_add(F.lit(until).cast("date"), 1))
    return a.orderBy(F.col("published_at").desc(), F.col("url").asc()).limit(page)


def registry_lookup(hits: DataFrame, details: DataFrame, by: str = "entity", cap: int = 5) -> DataFrame:
    """(by, ord, url, text): a document of an entity's first registry hits, and one of the details of the first of them.

    hits (by, ord, id, name, status, url), details (id, body).
    """
    top = first_rows(hits, [by], [F.col("ord").asc()], cap)
    line = F.concat_ws(" | ", "name", "id", "status")
    listed = top.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"), F.min_by("url", "ord").alias("url"))
    first = first_rows(top, [by], [F.col("ord").asc()], 1).join(details, "id").select(by, F.lit(1).alias("ord"), "url", F.col("body").alias("text"))
    return listed.select(by, F.lit(0).alias("ord"), "url", "text").union(first)


def officers(rows: DataFrame, include_resigned: bool = False) -> DataFrame:
    return rows if include_resigned else rows.where("resigned_on is null")


def company_filings(rows: DataFrame, category: str | None = None) -> DataFrame:
    return rows.where(F.lower("category") == category.lower()) if category else rows


def fan_in(entities: DataFrame, sources: dict[str, DataFrame], cap: int = fixed.DOCS_A_SOURCE, by: str = "entity") -> tuple[DataFrame, DataFrame]:
    """(documents, status): all sources in their fixed order, the first cap of each, and a status row for every entity and source.

    A source (entity, ord, url, text, error) that has an error row has failed for the entity and
    gives no document; one that has nothing for it was consulted all the same.
    """
    tagged = None
    for k, (name, df) in enumerate(sources.items()):
        one = df.select(by, "ord", "url", "text", "error").withColumns({"source": F.lit(name), "source_ord": F.lit(k)})
        tagged = one if tagged is None else tagged.unionByName(one)
    found = tagged.groupBy(by, "source").agg(F.count_if(F.col("error").isNotNull()).alias("_e"), F.count_if(F.col("error").isNull()).alias("_n"))
    asked = entities.select(by).distinct().select(by, F.explode(F.array(*map(F.lit, sources))).alias("source"))
    status = asked.join(found, [by, "source"], "left")
    broken = F.coalesce("_e", F.lit(0)) > 0
    status = status.select(by, "source", F.when(broken, "failed").otherwise("consulted").alias("status"), F.when(broken, 0).otherwise(F.coalesce("_n", F.lit(0))).alias("n_docs"))
    failed = status.where("status = 'failed'").select(by, "source")
    docs = first_rows(tagged.where("error is null and text is not null").join(failed, [by, "source"], "left_anti"), [by, "source"], [F.col("ord").asc()], cap)
    return docs.drop("error"), status


class _Chunks:
    """The chunks of one markdown text, in one pass over its lines."""

    def eval(self, text: str, words: int):
        if text is None:
            return
        heading, held, n = "", [], 0
        for line in [*re.split(r"\r\n|\n|\r", text), None]:
            title = None if line is None else re.match(r"#{1,6}[ \t\x0b\f]+(.*)$", line.strip(" "))
            if line is None or title:  # a section ends with the text or the next heading
                if held:
                    yield n, heading, " ".join(held)
                    n, held = n + 1, []
                heading = title[1].strip(" ") if title else ""
            elif not re.match(r"-{3,}$", line.strip(" ")):
                for w in re.split(r"[ \t\x0b\f]+", line):
                    if w:
                        held.append(w)
                        if len(held) == words:
                            yield n, heading, " ".join(held)
                            n, held = n + 1, []


def markdown_chunks(files: DataFrame, words: int = fixed.CHUNK_WORDS) -> DataFrame:
    """(source, chunk, text) of whole markdown texts (source, text): windows of words under their heading, which is put before.

    A table function beside each row, so texts are neither shuffled nor sorted; null and blank texts have no chunk.
    """
    chunks = F.udtf(_Chunks, returnType="chunk int, heading string, body string", useArrow=True)
    t = files.select("source", "text").lateralJoin(chunks(F.col("text").outer(), F.lit(words)))
    context = F.when(F.col("heading") != "", F.concat("heading", F.lit(": "))).otherwise("")
    return t.select("source", "chunk", F.concat(F.lit("["), F.col("source"), F.lit("] "), context, F.col("body")).alias("text"))


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of the markdown files of a folder."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("source"), F.col("value").alias("text"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Cached JSON reports, one a file, with `modified` to take the newest."""
    return spark.read.json(path, multiLine=True).select("*", F.col("_metadata.file_modification_time").alias("modified"))
