"""Quality rules: word and line statistics of each text, and lines that too many documents of a host share.

Lines are normalised and hashed, the distinct documents of each line counted per host, lines above
the host's limit removed, and documents that are left with too little rejected. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line may stand in so many distinct documents of a host, or in this share of the host's if that is more.
MIN_DOCS, SHARE = 20, 0.02
#: A document is depleted when less than this share of its characters in words is left.
LEFT = 0.2
SPACE = r"[\x20\x09-\x0D]+"
#: Words of a window, and limits of the base rules.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20


def _has_word(column: str) -> str:
    return f"{column} rlike '[^\\\\x20\\\\x09-\\\\x0D]'"


def _metrics(rows: DataFrame) -> DataFrame:
    """The base columns of each row (doc_id, host, th, text)."""
    lines = F.expr(f"filter(split(text, '\\n'), l -> {_has_word('l')})")
    w = rows.select(
        "*",
        F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    w = w.select(
        "doc_id", "host", "th", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.expr("aggregate(words, 0L, (n, w) -> n + length(w))").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(words, w -> xxhash64(w))").alias("wh"),
    )
    windows = f"if(size(wh) >= {WINDOW}, transform(sequence(0, size(wh) - {WINDOW}), i -> xxhash64({', '.join(f'wh[i + {k}]' for k in range(WINDOW))})), array())"
    w = w.withColumn("h", F.expr(windows)).drop("wh")
    # Only texts with a repeated window pay for sorting their windows by (hash, place).
    w = w.withColumn("s", F.expr("if(size(array_distinct(h)) < size(h), sort_array(transform(h, (x, i) -> struct(x as x, i as i))), array())")).drop("h")
    places = """array_sort(transform(
        filter(sequence(0, size(s) - 1), j -> coalesce(get(s, j).x = get(s, j - 1).x, false) or coalesce(get(s, j).x = get(s, j + 1).x, false)),
        j -> get(s, j).i))"""
    w = w.withColumn("p", F.expr(f"if(size(s) > 0, {places}, array())")).drop("s")
    covered = f"if(size(p) > 0, {WINDOW} + aggregate(transform(p, (x, i) -> if(i > 0, least({WINDOW}, x - get(p, i - 1)), 0)), 0L, (n, x) -> n + x), 0L)"
    return w.withColumn("n_repeat_words", F.expr(covered).cast("long")).drop("p")


def _removed(rows: DataFrame) -> DataFrame:
    """(d, s, t, removed): characters in words of the lines that a document of a host loses to the host's limit."""
    norm = f"trim(lower(regexp_replace(l, '{SPACE.replace(chr(92), chr(92) * 2)}', ' ')))"
    told = f"transform(split(text, '\\n'), l -> struct(xxhash64({norm}) as h, length(replace({norm}, ' ', '')) as c))"
    lines = rows.withColumn("lines", F.expr(told)).select("doc_id", "host", "th", F.posexplode_outer("lines").alias("place", "line"))
    lines = lines.select("doc_id", "host", "th", "place", "line.h", "line.c").where("c > 0")
    # a document is a doc_id and a text: repeated rows are one
    seen = lines.groupBy("host", "h", "doc_id", "th").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("n_docs"))
    held = rows.groupBy(F.col("host").alias("s"), "doc_id", "th").agg(F.lit(1).alias("one")).groupBy("s").agg(F.greatest(F.lit(float(MIN_DOCS)), F.count("*") * SHARE).alias("limit"))
    common = seen.where(F.col("n_docs") > MIN_DOCS).join(held, F.col("host") == F.col("s")).where("n_docs > limit").select(F.col("host").alias("s"), F.col("h").alias("x"))
    lost = lines.join(common, (F.col("host") == F.col("s")) & (F.col("h") == F.col("x")), "left_semi")
    once = lost.groupBy("doc_id", "th", "host", "place").agg(F.max("c").alias("c"))  # repeated rows lose their lines once
    return once.groupBy(F.col("doc_id").alias("d"), F.col("host").alias("s"), F.col("th").alias("t")).agg(F.sum("c").alias("removed"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base statistics and verdict for every row of docs (doc_id, text, source).

    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    removed_chars). A document is a doc_id and a text; its repeated rows count once towards a
    line's documents, and each keeps its row. A document on two hosts is judged on each by that
    host's lines. A null text has no words and fails; a null source is a host of its own, apart from
    the empty one; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("host"),
        F.xxhash64("text").alias("th"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    m = _metrics(rows).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
    out = m.join(_removed(rows), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("host") == F.col("s")) & (F.col("th") == F.col("t")), "left")
    removed = F.coalesce("removed", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("word_chars") - removed >= F.col("word_chars") * LEFT)).alias("kept"),
        removed.alias("removed_chars"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
with d as (select doc_id, coalesce('=' || source, '') source, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
i as (select doc_id, w, unnest(range(0, len(w) - {WINDOW - 1})) i from d),
g as (select doc_id, i, count(*) over (partition by doc_id, w[i + 1 : i + {WINDOW}]) n from i),
c as (select doc_id, least({WINDOW}, i - lag(i) over (partition by doc_id order by i)) step from g where n > 1),
r as (select doc_id, sum(coalesce(step, {WINDOW}))::bigint n_repeat_words from c group by doc_id),
l as (select doc_id, source, text, unnest(string_split(text, chr(10))) line from d),
n as (select *, trim(lower(regexp_replace(line, '{SPACE}', ' ', 'g'))) norm from l),
u as (select doc_id, count(*) - count(distinct line) n_dup_lines from n where norm <> '' group by doc_id),
h as (select source, greatest({float(MIN_DOCS)}, count(*) * {SHARE}) most from d group by source),
k as (select source, norm from n join h using (source) where norm <> '' group by source, norm, most having count(distinct doc_id) > most),
x as (select doc_id, sum(length(replace(norm, ' ', '')))::bigint removed from n join k using (source, norm) group by doc_id),
m as (select doc_id, len(w)::bigint n_words, coalesce(length(array_to_string(w, '')), 0)::bigint word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols,
      coalesce(n_dup_lines, 0)::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words, coalesce(removed, 0)::bigint removed_chars from d left join u using (doc_id) left join r using (doc_id) left join x using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} or n_repeat_words * 100 > n_words * {MOST_REPEATED} base_failed,
not (n_words < {LEAST_WORDS} or n_repeat_words * 100 > n_words * {MOST_REPEATED}) and word_chars - removed_chars >= word_chars * {LEFT}::double kept, removed_chars from m
"""
