"""License scans: word k-grams of documents vote for offset diagonals of license templates.

Every rolling k-gram hash of a document is joined to the template positions that hold the same
k-gram; a match votes for the diagonal document position - template position. Votes are counted
by diagonal, neighbouring diagonals merged (a word put in or left out moves the offset), and the
spans verified against the words and the template's length. DataFrame operations only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Words of a k-gram.
K = 3
#: Diagonals so near to the one before belong to one span.
DRIFT = 3
#: Least share of a template's k-grams in a verified span, and its greatest length in templates.
COVERAGE, STRETCH = 0.6, 2
#: Characters that end a word, after lower-casing A-Z.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Exact phrases and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Wordings of public licenses, matched in part: label, the words that tell it from its siblings (all must stand in a span), wording.
NOTICES = [
    ("gpl-3", ["gnu general public license", "version 3"], "licensed under the GNU General Public License, version 3"),
    ("gpl-3", ["gnu general public license", "version 3 of"], "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-3", ["general public license is", "copyleft license for software"], "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("gpl-2", ["gnu general public license", "version 2"], "licensed under the GNU General Public License, version 2"),
    ("gpl-2", ["gnu general public license", "version 2 of"], "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("agpl-3", ["gnu affero general public"], "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", ["gnu lesser general public"], "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", ["gnu lesser general public", "version 2 1"], "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("mit", ["publish distribute sublicense and or sell"], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2", ["apache license version 2 0"], "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", ["source and binary forms"], "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", ["use copy modify and or distribute this software"], "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", ["mozilla public license v 2 0"], "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl-2", ["eclipse public license v 2 0"], "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    ("unlicense", ["unencumbered software released into"], "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", ["cc0 1 0 universal"], "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication"),
]
#: The kinds and versions of one family of notices, whose wordings follow from them.
CREATIVE = {"cc-by": "Attribution", "cc-by-sa": "Attribution-ShareAlike", "cc-by-nd": "Attribution-NoDerivatives", "cc-by-nc": "Attribution-NonCommercial",
            "cc-by-nc-sa": "Attribution-NonCommercial-ShareAlike", "cc-by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
CREATIVE_VERSIONS = ["4.0 International", "3.0 Unported"]


def _words(text: str) -> list[str]:
    return [x for x in re.split(BREAK, text.lower()) if x]


def templates() -> list[tuple[str, bool, list[str], set[int]]]:
    """(label, exact, words, places of the k-grams that a span must hold) of every template."""
    told = [(label, True, phrase, [phrase]) for phrase, label in PHRASES] + [(label, False, text, must) for label, must, text in NOTICES]
    for label, kind in CREATIVE.items():
        told += [(label, False, f"This work is licensed under a Creative Commons {kind} {v} License", [f"creative commons {kind} {v[0]}"]) for v in CREATIVE_VERSIONS]
    out = []
    for label, exact, text, must in told:
        w = _words(text)
        places = set()
        for m in map(_words, must):
            at = next(i for i in range(len(w)) if w[i : i + len(m)] == m)
            low = min(at, len(w) - K)  # two words: a gram that holds them
            places |= set(range(low, max(low + 1, at + len(m) - K + 1)))
        out.append((label, exact, w, places))
    return out


def template_grams() -> list[tuple]:
    """(template, label, exact, words, required grams, place, required, three words) of every k-gram of every template: a fixed, small table."""
    return [(t, label, exact, len(w), len(must), i, i in must, *w[i : i + K]) for t, (label, exact, w, must) in enumerate(templates()) for i in range(len(w) - K + 1)]


def _values() -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in template_grams())


def license_scans(docs: DataFrame) -> DataFrame:
    """Phrases, labels and a score for every row of docs (doc_id, text).

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score). n_base counts the
    places of PHRASES; score is the largest covered share of a template among verified spans, 0
    without one. Notices that share their wording compete: among spans of notices that overlap in the
    text the one with most verified k-grams stays, at a tie the earlier template. A null text is as an empty one: no words, empty labels, null places. Repeated rows
    and null doc_ids each keep their row; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    low = F.lower(F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("K"), F.lit("é")))  # the Kelvin sign is no k here
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.array_remove(F.split(low, BREAK), "").alias("words"))
    templates = spark.sql(f"select *, xxhash64(w0, w1, w2) gram from values {_values()} as t(template, label, exact, n, must, tpos, needed, w0, w1, w2)")

    grams = F.expr(f"if(size(words) >= {K}, transform(sequence(0, size(words) - {K}), i -> xxhash64(words[i], words[i + 1], words[i + 2])), array())")
    # explode_outer: a filter on the array's size would be pushed below and compute the array again
    placed = rows.withColumn("grams", grams).select("doc_id", "th", "words", F.posexplode_outer("grams").alias("pos", "gram"))
    key = ["doc_id", "th", "template", "label", "exact", "n", "must"]
    hits = (
        placed.join(F.broadcast(templates), "gram")
        .groupBy(*key, (F.col("pos") - F.col("tpos")).alias("diag"), "tpos", "needed")
        .agg(F.max("pos").alias("pos"), F.max(F.expr(f"concat_ws(' ', slice(words, pos + 1, {K}))")).alias("seen"), F.max(F.concat_ws(" ", "w0", "w1", "w2")).alias("meant"))
        .where("seen = meant")
    )
    needs = F.collect_set(F.when(F.col("needed"), F.col("tpos"))).alias("needs")
    diagonals = hits.groupBy(*key, "diag").agg(F.count("*").alias("votes"), F.collect_set("tpos").alias("covers"), needs, F.min("pos").alias("low"), F.max("pos").alias("high"))
    full = F.col("n") - (K - 1)
    along = W.partitionBy(*key).orderBy("diag")
    spans = (
        diagonals.withColumn("apart", (F.col("exact") | (F.col("diag") - F.lag("diag").over(along) > DRIFT)).cast("int"))
        .withColumn("span", F.sum(F.coalesce("apart", F.lit(1))).over(along))
        .groupBy(*key, "span")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("covered"), F.size(F.array_distinct(F.flatten(F.collect_list("needs")))).alias("needs"), F.min("low").alias("low"), F.max("high").alias("high"))
        .withColumn("share", F.col("covered") / full)
        .where(F.when(F.col("exact"), F.col("covered") == full).otherwise((F.col("share") >= COVERAGE) & (F.col("needs") == F.col("must")) & (F.col("high") + K - F.col("low") <= F.col("n") * STRETCH)))
    )
    # spans of notices that overlap, in a row, are one island; the best covered of each stays
    text_order = W.partitionBy("doc_id", "th", "exact").orderBy("low", "high", "template")
    before = F.max(F.col("high") + K).over(text_order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("exact") | before.isNull() | (F.col("low") >= before), 1).otherwise(0)).withColumn("island", F.sum("new").over(text_order))
    best = W.partitionBy("doc_id", "th", "exact", "island").orderBy(F.col("covered").desc(), "template", "low")
    spans = spans.withColumn("rank", F.row_number().over(best)).where(F.col("exact") | (F.col("rank") == 1))
    base = F.when(F.col("exact"), F.col("low"))
    found = spans.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    out = rows.select("doc_id", "th", F.size("words").cast("long").alias("n_words"))
    return out.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
with t(template, label, exact, n, must, tpos, needed, w0, w1, w2) as (values {_values()}),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
p as (select doc_id, w, unnest(range(0, len(w) - {K - 1})) pos from d),
g as (select doc_id, pos, w[pos + 1] w0, w[pos + 2] w1, w[pos + 3] w2 from p),
h as (select doc_id, template, label, exact, n, must, pos - tpos diag, tpos, needed, pos from g join t using (w0, w1, w2)),
a as (select *, case when exact or diag - lag(diag) over q > {DRIFT} or lag(diag) over q is null then 1 else 0 end apart
      from (select distinct doc_id, template, label, exact, n, must, diag from h) window q as (partition by doc_id, template order by diag)),
s as (select *, sum(apart) over (partition by doc_id, template order by diag) span from a),
c as (select doc_id, template, label, exact, n, must, span, count(distinct tpos) covered, count(distinct tpos) filter (needed) needs, min(pos) low, max(pos) high
      from s join h using (doc_id, template, label, exact, n, must, diag) group by all),
v as (select *, covered / (n - {K - 1}) share from c
      where case when exact then covered = n - {K - 1} else covered / (n - {K - 1}) >= {COVERAGE} and needs = must and high + {K} - low <= n * {STRETCH} end),
i as (select *, sum(new) over (partition by doc_id, exact order by low, high, template rows unbounded preceding) island from
      (select *, case when coalesce(low >= max(high + {K}) over (partition by doc_id, exact order by low, high, template rows between unbounded preceding and 1 preceding), true) then 1 else 0 end new from v)),
b as (select * from i qualify exact or row_number() over (partition by doc_id, exact, island order by covered desc, template, low) = 1),
f as (select doc_id, count(*) filter (exact) n_base, min(low) filter (exact) first_word, max(low) filter (exact) last_word,
      string_agg(distinct label, ',' order by label) filter (exact) base_labels, string_agg(distinct label, ',' order by label) labels, max(share) score from b group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0)::double score from d left join f using (doc_id)
"""
