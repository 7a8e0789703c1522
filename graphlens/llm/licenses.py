"""License scans by diagonal voting.

Rolling word k-gram hashes of the texts are joined with the positions of the same k-grams in the
license templates. A match votes for the diagonal (text position less template position); votes on
neighbouring diagonals are merged, which allows for words put in or left out; and the spans that
remain are verified word by word and by how much of the template they cover. All of it is
DataFrame operations; the templates are a fixed list.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows give
repeated results; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import staged, texts

# The words that make a text's word, the base phrases and their labels, and opening
# lines of widespread licenses, lower-cased without punctuation.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("all-rights-reserved", "copyright all rights reserved no part of this publication may be reproduced"),
]
#: Words of a gram, diagonals apart that still merge, and the share of a template's grams that a label takes.
GRAM, SLACK, COVERED = 3, 3, 0.6


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _gram(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(GRAM)]


def _template_grams(docs: DataFrame) -> DataFrame:
    """hash, template, label, base, tpos, grams, words of each gram of each template."""
    rows = [(k, label, k < len(BASE), phrase.split(" ")) for k, (label, phrase) in enumerate([*BASE, *TEMPLATES])]
    table = docs.sparkSession.createDataFrame(rows, "template int, label string, base boolean, words array<string>")
    at = table.withColumn("tpos", F.explode(F.sequence(F.lit(0), F.size("words") - GRAM)))
    gram = _gram(F.col("words"), F.col("tpos"))
    return at.select(F.xxhash64(*gram).alias("hash"), "template", "label", "base", "tpos", (F.size("words") - GRAM + 1).alias("grams"), F.array(*gram).alias("gram"))


def matches(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, key, n_words) with ``hits``: the grams (position, hash, words) whose hash is a template's.

    ``key`` tells texts of one doc_id apart.
    """
    known = [r.hash for r in _template_grams(docs).select("hash").distinct().collect()]  # the fixed list
    split = texts(docs).select("doc_id", F.xxhash64("text").alias("key"), _words(F.col("text")).alias("words"))
    words = F.col("words")
    places = F.filter(F.sequence(F.lit(0), F.size(words) - GRAM), lambda i: F.xxhash64(*_gram(words, i)).isin(known))
    gram = lambda i: F.struct(i.alias("pos"), F.xxhash64(*_gram(words, i)).alias("hash"), F.array(*_gram(words, i)).alias("gram"))
    hits = F.when(F.size(words) >= GRAM, F.transform(places, gram))
    return split.select("doc_id", "key", F.size(words).cast("long").alias("n_words"), hits.alias("hits"))


def spans(found: DataFrame) -> DataFrame:
    """Verified places of templates: doc_id, key, template, label, base, first (word), coverage."""
    templates = F.broadcast(_template_grams(found))  # the fixed list
    grams = found.select("doc_id", "key", F.explode("hits").alias("hit")).select("doc_id", "key", "hit.*")
    same = (grams["hash"] == templates["hash"]) & (grams["gram"] == templates["gram"])
    votes = (
        grams.join(templates, same)
        .groupBy("doc_id", "key", "template", "label", "base", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.collect_set("tpos").alias("covered"))  # at most a template's grams
    )
    exact = votes.filter("base and size(covered) = grams").select("doc_id", "key", "template", "label", "base", F.col("diagonal").alias("first"), F.lit(1.0).alias("coverage"))
    along = W.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > SLACK, F.lit(True))
    merged = (
        votes.filter(~F.col("base"))
        .withColumn("apart", apart.cast("int"))
        .withColumn("island", F.sum("apart").over(along))
        .groupBy("doc_id", "key", "template", "label", "base", "grams", "island")
        .agg(F.min("diagonal").alias("first"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n"))
        .select("doc_id", "key", "template", "label", "base", "first", (F.col("n") / F.col("grams")).alias("coverage"))
    )
    return exact.unionByName(merged)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = staged(matches(docs), "license-hits")
    listed = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    base, label = F.col("base"), F.col("label")
    per_doc = (
        spans(found.filter(F.size("hits") > 0))
        .groupBy("doc_id", "key")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
            listed(F.when(base, label)).alias("base_labels"),
            listed(F.when(F.col("coverage") >= COVERED, label)).alias("labels"),
            F.round(F.max("coverage"), 6).alias("score"),
        )
        .withColumnsRenamed({"doc_id": "_doc_id", "key": "_key"})
    )
    rows = found.select("doc_id", "key", "n_words")
    joined = rows.join(per_doc, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    names = ["n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return joined.select("doc_id", "n_words", *[F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in names])


def _values() -> str:
    return ", ".join(f"({k}, '{label}', {k < len(BASE)}, string_split('{phrase}', ' '))" for k, (label, phrase) in enumerate([*BASE, *TEMPLATES]))


ORACLE_SQL = rf"""
WITH t(template, label, base, words) AS (VALUES {_values()}),
tg AS (SELECT template, label, base, len(words) - {GRAM - 1} AS grams, unnest(range(len(words) - {GRAM - 1})) AS tpos, words FROM t),
tw AS (SELECT template, label, base, grams, tpos, words[tpos + 1] AS a, words[tpos + 2] AS b, words[tpos + 3] AS c FROM tg),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(len(w) - {GRAM - 1})) AS pos FROM d WHERE len(w) >= {GRAM}),
votes AS (
  SELECT doc_id, template, label, base, grams, pos - tpos AS diagonal, list_distinct(list(tpos)) AS covered
  FROM g JOIN tw ON w[pos + 1] = a AND w[pos + 2] = b AND w[pos + 3] = c GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {SLACK} THEN 0 ELSE 1 END AS apart
  FROM votes WHERE NOT base),
islands AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM marked),
spans AS (
  SELECT doc_id, label, base, diagonal AS first, 1.0::DOUBLE AS coverage FROM votes WHERE base AND len(covered) = grams
  UNION ALL
  SELECT doc_id, label, base, min(diagonal), len(list_distinct(flatten(list(covered)))) / grams::DOUBLE FROM islands GROUP BY doc_id, template, label, base, grams, island),
s AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (coverage >= {COVERED})), ',') AS labels,
         round(max(coverage), 6) AS score
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN s USING (doc_id)
"""
