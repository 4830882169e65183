"""License scan: places of license phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are lines, templates fixed texts; both are sets of words. A block meets a template if it contains at least
THRESHOLD of the template's words. The join finds every such pair without comparing each block with each template:

* all sets are ordered by how many blocks of the corpus have a word, rarest first;
* length: a block with fewer words than the template needs can't meet it;
* prefix: of a template of t words that needs k, one of the first t - k + 1 words is in every block that meets it, and
  likewise one of the first b - k + 1 of a block's b template words;
* position: at a shared prefix word, the words not yet passed on either side must still suffice for k.

Candidates are verified on the whole sets. Templates are a parameter of bounded size, so their index is broadcast.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import ascii_lower, table, written

#: Fixed phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Fixed texts: notices and opening clauses by which licenses are known, and the labels of the blocks that meet them.
TEMPLATES = [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Released under the MIT License.", "mit-notice"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0"),
    ("Licensed under CC BY 4.0.", "cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction",
        "mit-text",
    ),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl-text"),
]
THRESHOLD = 0.8
MOST_TEMPLATES = 1000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same without the line feed, which parts blocks.
BREAKS_IN_BLOCK = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of_template(text: str) -> list[str]:
    """Different words in order of appearance."""
    low = "".join(c.lower() if c < "\x80" else c for c in text)
    return list(dict.fromkeys("".join(c if c.isalnum() or c >= "\x80" else " " for c in low).split()))


def needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(n * threshold - 1e-9))


def _lines(text: Column) -> Column:
    """The text's blocks: words parted by one blank, blocks by line feeds."""
    return F.regexp_replace(ascii_lower(text), BREAKS_IN_BLOCK, " ")


def _places(words: Column, n: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == p)
        return hit

    return F.when(n >= len(parts), F.filter(F.sequence(F.lit(0), n - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def base_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, n_words, n_base, first_word, last_word, _base): places of the phrases in every row; _text is a hash."""
    norm = F.trim(F.regexp_replace(ascii_lower(F.col("text")), BREAKS, " "))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text", F.length("text")).alias("_text"), norm.alias("norm"))
    rows = rows.withColumn("n", F.when(F.col("norm") == "", 0).otherwise(F.length(F.regexp_replace("norm", "[^ ]+", "")) + 1))
    none = F.array().cast("array<int>")
    # a document without a phrase isn't split at all
    some = F.col("norm").contains(PHRASES[0][0])
    for p, _ in PHRASES[1:]:
        some = some | F.col("norm").contains(p)
    rows = rows.select("doc_id", "_text", "n", F.when(some, F.split("norm", " ")).alias("words"))
    words = F.col("words")
    found = [F.when(words.isNotNull(), _places(words, F.col("n"), p)).otherwise(none).alias(label) for p, label in PHRASES]
    rows = rows.select("doc_id", "_text", "n", F.struct(*found).alias("at"))
    places = F.concat(*(F.col("at")[label] for _, label in PHRASES))
    base = F.filter(F.array(*(F.when(F.size(F.col("at")[label]) > 0, label) for _, label in PHRASES)), lambda x: x.isNotNull())
    return rows.select(
        "doc_id",
        "_text",
        F.col("n").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        base.alias("_base"),
    )


def _blocks(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, _text, size, toks): blocks that have a word of the vocabulary; size counts all different words of the block."""
    known = F.split(F.lit(" ".join(sorted(vocabulary))), " ")
    def block(line: Column) -> Column:
        w = F.array_distinct(F.split(F.trim(line), " "))
        return F.struct(F.size(w).alias("size"), F.array_intersect(w, known).alias("toks"))

    # computed within the row and exploded after, so that no filter is pushed below and computed twice
    blocks = F.explode_outer(F.transform(F.split(_lines(F.col("text")), "\n"), block))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text", F.length("text")).alias("_text"), blocks.alias("x"))
    return rows.select("doc_id", "_text", "x.size", "x.toks").filter(F.size("toks") > 0)


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, _text, labels, containment): rows with a block that meets a template; the best containment of any."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError("templates are broadcast and so must be few")
    spark = docs.sparkSession
    sets = [(i, label, words_of_template(text)) for i, (text, label) in enumerate(templates)]
    vocabulary = sorted({w for _, _, ws in sets for w in ws})
    # global order: blocks of the corpus that have the word; the fewest first, ties by the word
    least = min(needed(len(ws), threshold) for _, _, ws in sets)
    blocks = written(_blocks(docs, vocabulary).filter(F.size("toks") >= least), "blocks")
    counts = {r[0]: r[1] for r in blocks.select(F.explode("toks").alias("t")).groupBy("t").count().collect()}
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    index = []
    for i, label, ws in sets:
        ranks, need = sorted(order[w] for w in ws), needed(len(ws), threshold)
        index += [(r, p, i, label, ranks, len(ranks), need) for p, r in enumerate(ranks[: len(ranks) - need + 1])]
    kinds = "tok int, p int, template int, label string, ranks array<int>, t int, need int"
    index_df = F.broadcast(spark.createDataFrame(index, T._parse_datatype_string(kinds)))
    ranked = F.map_from_arrays(F.lit(list(order)), F.lit(list(order.values())))
    mine = blocks.select("doc_id", "_text", "size", F.array_sort(F.transform("toks", lambda w: ranked[w])).alias("mine"))
    b = F.size("mine")
    # every block word is a key, as the needed count depends on the template; the block's own prefix is tested at once
    keyed = mine.select("doc_id", "_text", "size", "mine", F.posexplode("mine").alias("q", "tok"))
    met = keyed.join(index_df, "tok")
    met = met.filter((F.col("size") >= F.col("need")) & (b >= F.col("need")))  # length
    met = met.filter(F.col("q") <= b - F.col("need"))  # the block's prefix
    met = met.filter(F.least(F.col("t") - F.col("p"), b - F.col("q")) + F.least("p", "q") >= F.col("need"))  # position
    overlap = F.size(F.array_intersect("mine", "ranks"))
    met = met.filter(overlap >= F.col("need")).select("doc_id", "_text", "label", (overlap / F.col("t")).alias("c"))
    return met.groupBy("doc_id", "_text").agg(F.collect_set("label").alias("labels"), F.max("c").alias("containment"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    score is 1 if a phrase is there, else the best containment of a template that is met, else 0. A null text is an empty
    one: no words, no places, labels are empty strings. Rows with null or repeated doc_ids are told apart by their text;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """
    base = base_scan(docs)
    found = template_matches(docs, templates, threshold).withColumnsRenamed({"doc_id": "_d", "_text": "_t"})
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")), "left")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    own = F.coalesce("labels", F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("_base")).alias("base_labels"),
        joined(F.concat("_base", own)).alias("labels"), score.alias("score"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    values = ",\n".join(f"  ({i}, '{label}', {words_of_template(text)!r})" for i, (text, label) in enumerate(TEMPLATES))
    places = " || ".join(
        "list_transform(list_filter(range(0, len(w)), lambda i: "
        + " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))
        + f"), lambda i: {{'l': '{label}', 'i': i}})"
        for phrase, label in PHRASES
    )
    return rf"""
WITH templates(template, label, tw) AS (VALUES
{values}),
docs AS (
  SELECT doc_id, {lower} AS low FROM documents),
words AS (
  SELECT doc_id, low, list_filter(string_split(regexp_replace(low, '{BREAKS}', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM docs),
base AS (
  SELECT doc_id, len(w) AS n_words, CASE WHEN contains(low, 'license') THEN {places} ELSE [] END AS found FROM words),
blocks AS (
  SELECT doc_id, string_split(regexp_replace(line, '{BREAKS}', ' ', 'g'), ' ') AS b
  FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS line FROM docs)),
met AS (
  SELECT doc_id, label, len(list_intersect(list_distinct(b), tw)) / len(tw) AS c, len(tw) AS t,
         len(list_intersect(list_distinct(b), tw)) AS o
  FROM blocks, templates),
own AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS c FROM met WHERE o >= ceil(t * {THRESHOLD} - 1e-9) GROUP BY doc_id)
SELECT doc_id, n_words, len(found) AS n_base, list_min(list_transform(found, lambda x: x.i)) AS first_word,
       list_max(list_transform(found, lambda x: x.i)) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.l))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.l) || coalesce(labels, []))), ',') AS labels,
       CASE WHEN len(found) > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM base LEFT JOIN own USING (doc_id)
"""


OP4_SQL = _oracle()
