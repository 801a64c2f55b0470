"""License scans by diagonal voting.

Every rolling word k-gram of a text that also stands in a license template is a vote for the diagonal (place in the
text less place in the template). Votes on one diagonal, and on diagonals a few words apart, come from one copy with
small edits; a copy is accepted when enough of the template's k-grams voted. Only DataFrame functions are used.

All k-grams are joined by the hash of their k words to the template positions, a table of fixed size; equal hashes are
confirmed by the words, and a span by the share of the template's words that it holds. Rows without a vote end in the
stage that read the texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, text_of, written

MOST_K = 4
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    k: int
    base: bool = False


#: Fixed by the contract of op7.
BASE_TEMPLATES = (
    Template("gpl", "gnu general public license", 2, True),
    Template("apache", "apache license", 2, True),
    Template("cc-by", "cc by", 2, True),
    Template("mit", "mit license", 2, True),
)
#: The customary notices, in lower-case words.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 4),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", 4),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 4),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 4),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", 4),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 4),
    Template("cc-by", "this work is licensed under a creative commons attribution", 4),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", 4),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", 4),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", 4),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", 4),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", 4),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", 4),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 4),
)
TEMPLATES = BASE_TEMPLATES + NOTICES


def template_rows(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[int, str, bool, int, int, int, int, list[str]]]:
    """(template, label, base, number of words, number of k-grams, k, place, the k-gram's words)."""
    rows = []
    for t, template in enumerate(templates):
        words = template.words.split()
        n = len(words) - template.k + 1
        rows += [(t, template.label, template.base, len(words), n, template.k, i, words[i : i + template.k]) for i in range(n)]
    return rows


def _gram(words: list[Column], k: int) -> Column:
    """The hash of the k-gram that starts here, null where the text ends before it does."""
    return F.when(words[k - 1].isNotNull(), F.xxhash64(F.lit(k), *words[:k]))


def _templates(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    df = spark.createDataFrame(template_rows(templates), "template int, label string, base boolean, length int, grams int, k int, place int, words array<string>")
    words = [F.get("words", F.lit(i)) for i in range(MOST_K)]
    grams = F.coalesce(*(F.when(F.col("k") == k, _gram(words, k)) for k in sorted({t.k for t in templates})))
    return df.withColumn("gram", grams)


def license_votes(docs: DataFrame, *, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document without a template (template null), and one per document, template and diagonal with `votes`.

    Columns: uid (one per input row), _row (the other input columns), n_words, template, label, base, length, grams, k,
    diagonal, votes, places (in the template, of the votes), low and high (first and last place in the text).
    """
    if any(not 2 <= t.k <= MOST_K for t in templates):
        raise ValueError(f"k must be from 2 to {MOST_K}")
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row"), text_of(f"`{text_col}`").alias("t")).withColumn("uid", F.monotonically_increasing_id())
    rows = rows.select("uid", "_row", F.array_remove(F.split(ascii_lower(F.col("t")), SEPARATOR), "").alias("w"))
    after = [F.slice("w", i + 1, F.greatest(F.size("w"), F.lit(1))).alias(f"w{i}") for i in range(1, MOST_K)]
    rows = rows.select("uid", "_row", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("w").alias("w0"), *after)).alias("pos", "g"))
    words = [F.col(f"g.w{i}") for i in range(MOST_K)]
    # one row per place and k; the first of a place stays also where nothing matches
    grams = [F.struct(F.lit(i).alias("i"), _gram(words, k).alias("gram")) for i, k in enumerate(sorted({t.k for t in templates}))]
    rows = rows.select("uid", "_row", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"), *(w.alias(f"w{i}") for i, w in enumerate(words)), F.explode(F.array(*grams)).alias("h"))
    table = F.broadcast(_templates(docs.sparkSession, templates))  # of fixed size
    equal = [(F.col("k") <= i) | (F.get("words", F.lit(i)) == F.col(f"w{i}")) for i in range(MOST_K)]
    hits = rows.join(table, reduce(lambda a, b: a & b, equal, F.col("h.gram") == table["gram"]), "left")
    hits = hits.where(F.col("template").isNotNull() | ((F.col("pos") == 0) & (F.col("h.i") == 0)))
    hits = hits.withColumn("diagonal", (F.col("pos") - F.col("place")).cast("long"))
    votes = hits.groupBy("uid", "_row", "n_words", "template", "label", "base", "length", "grams", "k", "diagonal").agg(
        F.count("place").alias("votes"), F.collect_set("place").alias("places"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    return written(votes, "votes")  # uid is used on two branches


def license_spans(votes: DataFrame, *, slack: int = 3, least: float = 0.5) -> DataFrame:
    """The copies found: diagonals of a document and template at most `slack` apart merged, and verified by words: `share`
    of the template's words stand in the span inside an equal k-gram. `accepted`: share of `least` or more, over a span of no
    more than twice the template's length or with half of the template on one diagonal."""
    order = Window.partitionBy("uid", "template").orderBy("diagonal")
    rows = votes.where("template IS NOT NULL").withColumn("_new", (F.col("diagonal") - F.lag("diagonal").over(order) <= slack).cast("int"))
    rows = rows.withColumn("_run", F.sum(1 - F.coalesce("_new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1))))
    rows = rows.withColumn("_most", F.size(words)).withColumn("_word", F.explode(words))
    rows = rows.groupBy("uid", "template", "label", "base", "length", "_run").agg(F.count_distinct("_word").alias("_equal"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("_most").alias("_most"))
    share = F.col("_equal") / F.col("length")
    near = (F.col("high") - F.col("low") <= 2 * F.col("length")) | (F.col("_most") >= least * F.col("length"))
    return rows.select("uid", "template", "label", "base", "low", "high", share.alias("share"), ((share >= least) & near & ~F.col("base")).alias("accepted"))


def _listed(c: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(c)), ",")


def scan_licenses(docs: DataFrame, *, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, slack: int = 3, least: float = 0.5) -> DataFrame:
    """A row per row of `docs`: its other columns (_row), n_words, the base phrases' places and labels, all labels, score.

    A base phrase stands exactly where all its k-grams vote for one diagonal, which is the place of its first word.
    Null or empty texts have no words and no labels, score 0. Repeated rows are scanned each; an empty table gives no rows.
    Texts of any length are scanned whole; of equal scores there is nothing to choose, as all labels are given.
    """
    votes = license_votes(docs, text_col=text_col, templates=templates)
    places = votes.withColumn("_full", F.col("base") & (F.col("votes") == F.col("grams")))
    start = F.when(F.col("_full"), F.col("diagonal"))
    heads = places.groupBy("uid").agg(
        F.first("_row").alias("_row"), F.max("n_words").alias("n_words"), F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        F.collect_set(F.when(F.col("_full"), F.col("label"))).alias("_base"),
    )
    spans = license_spans(votes, slack=slack, least=least)
    more = spans.groupBy("uid").agg(F.collect_set(F.when(F.col("accepted"), F.col("label"))).alias("_more"), F.max("share").alias("score"))
    none = F.array().cast("array<string>")
    joined = heads.join(more, "uid", "left")
    return joined.select(
        "_row", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("_base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("_base", F.coalesce("_more", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def licenses_query(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs.select("doc_id", "text")).select("_row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def licenses_sql(templates: tuple[Template, ...] = TEMPLATES, slack: int = 3, least: float = 0.5) -> str:
    """op7 for DuckDB, with the k-grams compared as lists of words."""
    rows = ", ".join(f"({t}, '{label}', {base}, {length}, {grams}, {k}, {place}, {words!r})" for t, label, base, length, grams, k, place, words in template_rows(templates))
    return rf"""WITH tpl(template, label, base, length, grams, k, place, words) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(w))) AS p, w FROM d),
h AS (SELECT doc_id, p - 1 AS pos, tpl.*, p - 1 - place AS diagonal FROM e JOIN tpl ON w[p] = words[1] AND w[p + 1] = words[2] AND w[p : p + k - 1] = words),
v AS (SELECT doc_id, template, label, base, length, grams, k, diagonal, count(*) AS votes, list(place) AS places, min(pos) AS low, max(pos) AS high FROM h GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word FROM v WHERE base AND votes = grams GROUP BY doc_id),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {slack} THEN 0 ELSE 1 END AS fresh FROM v),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM n),
x AS (SELECT *, unnest(places) AS place FROM r),
y AS (SELECT *, place + unnest(range(k)) AS word FROM x),
m AS (SELECT doc_id, template, run, diagonal, count(DISTINCT word) AS most FROM y GROUP BY ALL),
q AS (SELECT doc_id, template, run, max(most) AS most FROM m GROUP BY ALL),
c AS (SELECT doc_id, label, base, count(DISTINCT word) / length AS share, max(high) - min(low) <= 2 * length OR any_value(most) >= {least} * length AS near
      FROM y JOIN q USING (doc_id, template, run) GROUP BY doc_id, template, label, base, length, run),
l AS (SELECT doc_id, label, true AS b FROM v WHERE base AND votes = grams UNION ALL SELECT doc_id, label, false FROM c WHERE share >= {least} AND near AND NOT base),
g AS (SELECT doc_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE b), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM l GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS score FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN s ON d.doc_id = s.doc_id"""
