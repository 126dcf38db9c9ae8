"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line, or a stretch of the whole text, since notices are wrapped and whole licenses have several paragraphs:
ends of lines and paragraphs, comment signs and markup only separate words. Its set is the distinct words. Templates
are searched for in stretches of their own size (they are classed by length, a class reaching to twice its shortest):
stretches follow each other so that any run of `SLACK` times as many words as the class's longest template has lies
whole in one. A template is found in a block that holds at least `threshold` of its
words. Words are ordered by their frequency in the whole corpus, rarest first. Prefix filter: a block that holds `need`
of a template's n words holds one of its first n - need + 1. Length filter: the block has at least `need` words.
Positional filter: from the first common word on, both sides must have enough words left. What passes is verified.
All steps are DataFrame expressions. Templates are a parameter, sentences or whole texts (see read_templates); as many are
searched for at once as have `MOST_WORDS` distinct words together, so that what is broadcast stays bounded, and the
others after them.

Base phrases (consecutive words) are found beside the join and always reported.

Contract. Null text counts as empty. Rows that share an id share the labels found for it. Ties in frequency are broken
by the word. A template without words finds nothing. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, settled

#: Sentences that public licenses ask to be quoted, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("proprietary", "All rights reserved"),
    ("proprietary", "No part may be reproduced without permission"),
]
#: Phrases and labels of the base.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
THRESHOLD = 0.9
#: Words of a wrapped notice, in the longest template's: notices say more than the template between its words.
SLACK = 2
#: Distinct words of the templates that are searched for at once.
MOST_WORDS = 20_000
#: Prefix words up to which lines are searched for their letters before they are split into words.
MOST_NEEDLES = 64


def _block_words(column: Column | str) -> Column:
    """Words of the join. lower() is many times faster than translate(), and the same on templates, which are ASCII."""
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))


def read_templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(label, text) of license texts, one in each file below the path; the label is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("label"), "value")
    return sorted((unquote(r.label), r.value) for r in files.collect())  # a bounded set by nature: there are some hundreds of licenses


def _template_sets(docs: DataFrame, templates: list[tuple[str, str]]) -> list[tuple[list, list[str]]]:
    """Templates with their lengths and sets of words, and all of these words: in slices of at most MOST_WORDS of them."""
    sets = docs.sparkSession.createDataFrame([(k, label, body) for k, (label, body) in enumerate(templates)], "template int, label string, body string")
    sets = sets.select("template", "label", F.size(_block_words("body")).alias("length"), F.array_distinct(_block_words("body")).alias("words")).where(F.size("words") > 0).collect()
    slices, held, known = [], [], set()
    for r in sorted(sets, key=lambda r: r.template):
        if held and len(known | set(r.words)) > MOST_WORDS:
            slices.append((held, sorted(known)))
            held, known = [], set()
        held.append(r)
        known |= set(r.words)
    return [*slices, (held, sorted(known))]


def _held(words: Column | str, known: list[str]) -> Column:
    return F.array_intersect(words, F.array(*map(F.lit, known)) if known else F.array().cast("array<string>"))


def _needed(words: list[str], threshold: float) -> int:
    return max(1, min(-(-int(round(threshold * len(words) * 1e6)) // 1_000_000), len(words)))


def size_classes(lengths: list[int]) -> list[tuple[int, int]]:
    """(shortest, longest) of each class of template lengths."""
    out: list[tuple[int, int]] = []
    for n in sorted(set(lengths)):
        if out and n <= 2 * out[-1][0]:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def _stretches(words: str, held: str, sets: list, threshold: float) -> Column:
    """(kind, words) of the stretches (their distinct words) that hold enough of any template of their class; kind is the
    class's number. Texts whose words, all told, do not hold enough are not cut."""

    def meets(words: Column | str, own: list) -> Column:
        return reduce(or_, [F.size(F.array_intersect(words, F.array(*map(F.lit, r.words)))) >= _needed(r.words, threshold) for r in own], F.lit(False))

    def cut(span: int) -> Column:
        """2 * span words, a new stretch every span words."""
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - span, F.lit(0)) + 1, F.lit(span))
        return F.transform(starts, lambda k: F.array_distinct(F.slice(words, k, F.lit(2 * span))))

    def of_class(kind: int, low: int, high: int) -> Column:
        own = [r for r in sets if low <= r.length <= high]
        kept = F.filter(cut(SLACK * high), lambda x: meets(x, own))
        return F.when(meets(held, own), F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("words")))).otherwise(none)

    none = F.array().cast("array<struct<kind:int,words:array<string>>>")
    parts = [of_class(k, *c) for k, c in enumerate(size_classes([r.length for r in sets]))]
    return F.concat(*parts) if parts else none


def find_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, held: DataFrame | None = None) -> DataFrame:
    """(key, block, label, containment) for every block of every document and every template that it meets; block is the
    line's number, and null for stretches of the text.

    held: a table (key, held, stretches) of each document's distinct template words and its stretches, if known already.
    """
    slices = _template_sets(docs, templates)
    found = [_find_slice(docs, key, text, sets, known, threshold, held if len(slices) == 1 else None) for sets, known in slices]
    return reduce(DataFrame.unionByName, found).groupBy(key, "block", "label").agg(F.max("containment").alias("containment"))


def _find_slice(docs: DataFrame, key: str, text: str, sets: list, known: list[str], threshold: float, held: DataFrame | None) -> DataFrame:
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    if held is None:
        held = docs.select(key, _block_words(body).alias("w")).select(key, "w", _held("w", known).alias("held")).select(key, "held", _stretches("w", "held", sets, threshold).alias("stretches"))
    counts = {r["word"]: r["count"] for r in held.select(F.explode("held").alias("word")).groupBy("word").count().collect()}  # a row for each template word at most
    order = {w: k for k, w in enumerate(sorted(known, key=lambda w: (counts.get(w, 0), w)))}
    rows, classes = [], size_classes([r.length for r in sets])
    for r in sets:
        words, need = sorted(r.words, key=order.__getitem__), _needed(r.words, threshold)
        own = next(k for k, (low, high) in enumerate(classes) if low <= r.length <= high)
        rows += [(w, p, r.template, r.label, words, need, own) for p, w in enumerate(words[: len(words) - need + 1])]
    prefixes = spark.createDataFrame(rows, "word string, p int, template int, label string, template_words array<string>, need int, class int")
    first = sorted({r[0] for r in rows})
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.lower(body), "\n")).alias("block", "line"))
    if first and len(first) <= MOST_NEEDLES:  # a line without the letters of any prefix word has none of the words
        some = F.contains("line", F.lit(first[0]))
        for w in first[1:]:
            some = some | F.contains("line", F.lit(w))
        lines = lines.where(some)
    none = F.lit(None).cast("int")
    lines = lines.select("key", "block", none.alias("kind"), F.array_distinct(F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).alias("words"))
    stretches = held.where(F.size("stretches") > 0).select(F.col(key).alias("key"), none.alias("block"), F.explode("stretches").alias("x")).select("key", "block", "x.kind", "x.words")
    lines = lines.unionByName(stretches)
    lines = lines.where(F.size(_held("words", first)) > 0)
    rank = F.create_map(*(F.lit(x) for pair in order.items() for x in pair)) if order else F.create_map().cast("map<string,int>")
    ranked = F.array_sort(F.filter(F.transform("words", lambda w: F.struct(F.try_element_at(rank, w).alias("r"), w.alias("w"))), lambda x: x["r"].isNotNull()))
    lines = lines.withColumn("held", ranked).select("key", "block", "kind", "words", F.size("held").alias("n_held"), F.posexplode("held").alias("q", "x"))
    pairs = lines.withColumn("word", F.col("x.w")).join(F.broadcast(prefixes), "word")
    pairs = pairs.where("coalesce(kind = class, true) AND size(words) >= need AND 1 + least(size(template_words) - p - 1, n_held - q - 1) >= need")
    common = F.size(F.array_intersect("words", "template_words"))
    return pairs.where(common >= F.col("need")).select(F.col("key").alias(key), "block", "label", (common / F.size("template_words")).alias("containment"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its words, the base phrases' places, the labels of both kinds and a score from 0 to 1."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    places = []
    for phrase, label in PHRASES:
        want = phrase.split()
        same = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(want))
        inside = f"CASE WHEN size(w) >= {len(want)} THEN filter(sequence(0, size(w) - {len(want)}), i -> {same}) ELSE cast(array() AS array<int>) END"
        places.append(f"transform({inside}, i -> named_struct('i', cast(i AS bigint), 'label', '{label}'))")
    found = f"CASE WHEN array_contains(w, 'license') THEN array_sort(concat({', '.join(places)})) END"
    sets, known = _template_sets(docs, templates)[0]
    # lower() leaves the words' number as it is and makes none of the phrases' letters from others than A-Z
    rows = docs.select(key, _block_words(body).alias("w")).select(key, "w", F.size("w").cast("long").alias("n_words"), _held("w", known).alias("held"), F.expr(found).alias("places"))
    rows = settled(rows.select(key, "n_words", "held", "places", _stretches("w", "held", sets, threshold).alias("stretches")))
    blocks = find_blocks(docs, key, text, templates, threshold, rows)
    blocks = blocks.groupBy(F.col(key).alias("__key")).agg(F.collect_set("label").alias("__labels"), F.max("containment").alias("__score"))
    joined = rows.join(blocks, F.col(key).eqNullSafe(F.col("__key")), "left")
    n = F.coalesce(F.array_size("places"), F.lit(0))
    base = F.array_sort(F.array_distinct(F.coalesce(F.transform("places", lambda x: x["label"]), F.array().cast("array<string>"))))
    both = F.array_sort(F.array_union(base, F.coalesce("__labels", F.array().cast("array<string>"))))
    return joined.select(
        key,
        "n_words",
        F.when(n > 0, n).otherwise(0).cast("long").alias("n_base"),
        F.when(n > 0, F.col("places")[0]["i"]).alias("first_word"),
        F.when(n > 0, F.element_at("places", -1)["i"]).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(n > 0, 1.0).otherwise(F.coalesce("__score", F.lit(0.0))).alias("score"),
    )
