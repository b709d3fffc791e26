"""License text by an exact set-similarity join, in DataFrame operations only.

Blocks are lines, and the stretches of a text's words as long as a template (repeats counted), whatever line breaks are inside, as
licenses are published in wrapped lines. A block meets a template if it holds at least the threshold's share of the template's distinct words.
Words are ordered by their frequency over all documents, rarest first. With a need of k of a template's n words, a block
must share one of the template's first n - k + 1 (prefix filter), have k distinct words or more (length filter), and from
its first shared word on both must have enough words left (positional filter); what passes is verified on the full sets. No
filter loses a block. For stretches, the words around a prefix word must hold enough of the template; then every stretch with that word
is verified. Templates are a fixed list, so their tables are as small as that list, whatever the corpus.

Null and empty texts have no words, places or labels; very long texts are read whole, and an empty table gives an empty result. Labels are joined to documents by a fingerprint of the text, so equal texts
are verified once and get equal results, whatever their ids. Other columns of the input don't matter.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capwindow.llm import common

#: Words after lower-casing: ASCII letters and digits, and everything beyond ASCII.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
TEMPLATES = {
    "agpl-3.0": "GNU Affero General Public License version 3",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-terms": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc0": "dedicated to the public domain under CC0 1.0 Universal",
    "copyright": "All rights reserved",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "lgpl": "GNU Lesser General Public License",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
}
THRESHOLD = 0.9
SALTS = 32


def lowered(text: Column) -> Column:
    """A-Z in lower case. Beyond ASCII, the Kelvin sign alone would become an ASCII letter, so it is kept apart."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e0")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {k: list(dict.fromkeys(re.findall(r"[0-9a-z]+", t.lower()))) for k, t in templates.items()}


def fingerprint(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("fp"), F.xxhash64(F.lit(7), text).alias("fp2")]


def places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively; words is a column that is computed already."""
    parts = phrase.split()
    rarest = max(parts, key=len)

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out &= F.get(words, i + k) == part
        return out

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    return F.when(F.array_contains(words, rarest) & (F.size(words) >= len(parts)), starts).otherwise(F.array().cast("array<int>"))


def frequency_order(docs_words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of documents that hold each word, rarest first, ties by the word."""
    counted = docs_words.select(F.explode(F.array_intersect("words", F.lit(vocabulary))).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counted.collect()}  # at most the vocabulary of the templates
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def prefix_table(spark, sets: dict[str, list[str]], order: list[str], threshold: float) -> DataFrame:
    """A row for each word of each template's prefix: label, word, its place, the template's size, need and words."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, words in sets.items():
        ordered = sorted(words, key=rank.__getitem__)
        need = needed(len(ordered), threshold)
        for i, w in enumerate(ordered[: len(ordered) - need + 1]):
            values = {"label": label, "__w": w, "__i": i, "__n": len(ordered), "__need": need, "__template": ordered}
            rows.append(F.struct(*(F.lit(v).alias(k) for k, v in values.items())))
    return spark.range(1).select(F.inline(F.array(*rows)))


def needed(n: int, threshold: float) -> int:
    """Words of a template of n words that a block must hold."""
    return max(1, math.ceil(threshold * n - 1e-9))


def join_stretches(texts: DataFrame, sets: dict[str, list[str]], lengths: dict[str, int], order: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(text's columns, label, containment) of texts and templates such that a stretch of the text's words, as long as the template,
    meets the threshold, once for each place of a prefix word. texts has the array column words; lengths are the templates' in words."""
    kept = [c for c in texts.columns if c not in ("words", "label", "containment")]
    table = prefix_table(texts.sparkSession, sets, order, threshold)
    length = F.create_map(*(F.lit(x) for item in lengths.items() for x in item))
    table = table.select("__w", "__n", "__need", "__template", "label", length[F.col("label")].alias("__long"))
    heads = [r["__w"] for r in table.select("__w").distinct().collect()]  # at most the vocabulary of the templates
    places = texts.select(*kept, F.col("words").alias("__words"), F.posexplode("words").alias("__p", "__w")).where(F.col("__w").isin(heads))
    pairs = places.join(F.broadcast(table), "__w")  # as large as the list of templates

    def overlap(start: Column, n: Column) -> Column:
        return F.size(F.array_intersect(F.slice("__words", start + 1, n), "__template"))

    first = F.greatest(F.col("__p") - F.col("__long") + 1, F.lit(0))
    last = F.greatest(F.least(F.col("__p"), F.size("__words") - F.col("__long")), F.lit(0))
    near = pairs.where(overlap(first, F.col("__p") - first + F.col("__long")) >= F.col("__need"))
    best = F.array_max(F.transform(F.sequence(first, last), lambda i: overlap(i, F.col("__long"))))
    met = near.withColumn("__best", best).where(F.col("__best") >= F.col("__need"))
    return met.select(*kept, "label", (F.col("__best") / F.col("__n")).alias("containment"))


def join_blocks(blocks: DataFrame, sets: dict[str, list[str]], order: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(block's columns, label, containment) of all pairs that meet the threshold, once for each word that leads to the pair. blocks has the array column words;
    columns of the names label and containment are replaced."""

    # One order for all words: the vocabulary's by frequency, then the others, which never match, by spelling.
    def rank(w: Column) -> Column:
        return F.coalesce(F.nullif(F.array_position(F.lit(order), w), F.lit(0)), F.lit(len(order) + 1))

    ranked = F.sort_array(F.transform(F.array_distinct("words"), lambda w: F.struct(rank(w).alias("r"), w.alias("w"))))
    kept = [c for c in blocks.columns if c not in ("words", "label", "containment")]
    ordered = blocks.withColumn("__ranked", ranked).withColumn("__set", F.transform("__ranked", lambda x: x["w"])).withColumn("__size", F.size("__set"))
    shared = ordered.select(*kept, "__set", "__size", F.posexplode("__set").alias("__j", "__w"))
    pairs = shared.join(F.broadcast(prefix_table(blocks.sparkSession, sets, order, threshold)), "__w")  # as large as the list of templates
    left = 1 + F.least(F.col("__n") - 1 - F.col("__i"), F.col("__size") - 1 - F.col("__j"))
    overlap = F.size(F.array_intersect("__set", "__template"))
    met = pairs.where((F.col("__size") >= F.col("__need")) & (left >= F.col("__need"))).where(overlap >= F.col("__need"))
    return met.select(*kept, "label", (overlap / F.col("__n")).alias("containment"))


def query(spark, sf_dir: str) -> DataFrame:
    sets = template_words(TEMPLATES)
    vocabulary = sorted({w for words in sets.values() for w in words})
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = frequency_order(docs.select(words_of(lowered(F.col("text"))).alias("words")), vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    heads = sorted({w for words in sets.values() for w in sorted(words, key=rank.__getitem__)[: len(words) - needed(len(words), THRESHOLD) + 1]})
    read = docs.select("doc_id", lowered(F.col("text")).alias("text"), *fingerprint(F.col("text"))).withColumn("words", words_of(F.col("text")))
    read = read.withColumns({f"__{k}": places(F.col("words"), p) for k, p in PHRASES.items()})
    found = F.flatten(F.array(*(F.col(f"__{k}") for k in PHRASES)))
    # Only texts that hold a word of some template's prefix can have a block; their lines alone go on.
    lines = F.when(F.arrays_overlap("words", F.lit(heads)), F.split("text", "\n"))
    skinny = common.cut(
        read.select(
            "doc_id",
            "fp",
            "fp2",
            F.size("words").cast("long").alias("n_words"),
            F.size(found).cast("long").alias("n_base"),
            F.array_min(found).cast("long").alias("first_word"),
            F.array_max(found).cast("long").alias("last_word"),
            F.filter(F.array(*(F.when(F.size(f"__{k}") > 0, F.lit(k)) for k in PHRASES)), lambda x: x.isNotNull()).alias("base"),
            lines.alias("lines"),
        )
    )
    texts = skinny.where(F.col("lines").isNotNull()).groupBy("fp", "fp2").agg(F.any_value("lines").alias("lines"))
    blocks = texts.select("fp", "fp2", F.explode("lines").alias("line")).select("fp", "fp2", words_of(F.col("line")).alias("words"))
    joined = join_blocks(blocks.where(F.arrays_overlap("words", F.lit(heads))), sets, order)
    whole = texts.where(F.size("lines") > 1).select("fp", "fp2", words_of(F.array_join("lines", "\n")).alias("words"))
    joined = joined.unionByName(join_stretches(whole, sets, {k: len(re.findall(r"[0-9a-z]+", t.lower())) for k, t in TEMPLATES.items()}, order))
    labels = joined.groupBy("fp", "fp2").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    # Labelled texts are few; each meets the rows of a large group of copies in so many tasks as there are salts.
    salted = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = skinny.drop("lines").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = rows.join(salted, ["fp", "fp2", "salt"], "left")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("containment", F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The query in SQL: every line against every template, without filters."""
    texts = ", ".join(f"('{label}', {sorted(words)!r})" for label, words in template_words(TEMPLATES).items())
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for label, phrase in PHRASES.items())
    return rf"""
WITH templates(label, words) AS (VALUES {texts}), phrases(label, p) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
places AS (SELECT r, label, i - 1 AS place FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w), phrases WHERE words[i : i + len(p) - 1] = p),
base AS (SELECT r, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS labels FROM places GROUP BY r),
blocks AS (SELECT r, list_distinct(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS b FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
met AS (SELECT r, label, len(list_intersect(b, words)) / len(words) AS c FROM blocks, templates WHERE len(list_intersect(b, words)) >= ceil({THRESHOLD} * len(words) - 1e-9)),
found AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS c FROM met GROUP BY r)
SELECT doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  coalesce(found.c, CASE WHEN base.n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM w LEFT JOIN base ON w.r = base.r LEFT JOIN found ON w.r = found.r
"""
