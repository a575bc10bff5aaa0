"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are paragraphs. A template is found in a block that holds at least ``threshold`` of its distinct words.
Words are ordered by document frequency, rarest first; a block can only reach the threshold if it holds one of a
template's first few words (prefix), has words enough (length), and has enough words left from there on (position).

Null texts count as empty. Repeated rows are scanned each on its own. An empty table gives an empty result; other
columns are ignored; very long texts are scanned whole. Of several places of a template in a block the fullest counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.decontaminate import TABLE
from kgloom.llm.common import bind, scan, written

#: Label and opening words of well-known licenses.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the terms of the mit license"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc", "licensed under cc by nc 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Runs of ASCII characters other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLANK_LINE = r"\n[ \t\r]*\n"


def words_of(text: Column) -> Column:
    """Words in lower case. Unicode lower-casing keeps the number of words and every ASCII word of letters but k."""
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def _places(w: Column) -> Column:
    """Start and label of every base phrase."""
    at = lambda i, s: F.coalesce(F.get(w, i) == s, F.lit(False))
    place = lambda i, label: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))
    return F.filter(
        F.transform(
            w,
            lambda x, i: F.when((x == "license") & at(i - 1, "mit"), place(i - 1, "mit"))
            .when((x == "license") & at(i - 1, "apache"), place(i - 1, "apache"))
            .when((x == "license") & at(i - 1, "public") & at(i - 2, "general"), place(i - 2, "gpl")),
        ),
        lambda x: x.isNotNull(),
    )


def _literal(words: list[str]) -> Column:
    """A constant array; words hold no space."""
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def find_licenses(docs: DataFrame, templates: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """Per row: doc_id, n_words, places (base phrases), found (template number, label, block, containment).

    ``templates``: a reference table of ``label, text``, numbered in their order; without one, TEMPLATES. Their texts are cut into words by the
    same rule as documents; one without a word is never met.
    """
    spark = docs.sparkSession
    given = [(r.label, r.text) for r in templates.select("label", "text").sort("label", "text").collect()] if templates else list(TEMPLATES)
    given = [(label, sorted({w.decode() for w in (t or "").encode().translate(TABLE).split()})) for label, t in given]
    need = [max(1, math.ceil(threshold * len(s))) for _, s in given]
    vocabulary = sorted({w for _, s in given for w in s})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of = lambda w, words: F.filter(w, lambda x: x.isin(words))
    # document frequencies of the templates' words: as many rows as the templates have words
    met_words = docs.select(F.explode(F.array_distinct(of(words_of(text), vocabulary))).alias("w"))
    counts = {r.w: r["count"] for r in met_words.groupBy("w").count().collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    entries = []
    for k, ((label, s), n) in enumerate(zip(given, need, strict=True)):
        s = sorted(s, key=rank.get)
        entries += [(w, k, label, i, len(s), n, s) for i, w in enumerate(s[: len(s) - n + 1])]
    prefix = sorted({e[0] for e in entries})
    first = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        bind(
            words_of(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.when(F.array_contains(w, "license"), _places(w)).alias("places"),
                # only a block that holds a prefix word of some template can reach the threshold
                F.when(
                    F.exists(w, lambda x: x.isin(prefix)),
                    F.transform(F.split(text, BLANK_LINE), lambda b: F.array_distinct(of(words_of(b), vocabulary))),
                ).alias("blocks"),
            ),
        ).alias("m"),
    )
    first = written(first.select("doc_id", F.monotonically_increasing_id().alias("row"), "m.*"))
    index = spark.createDataFrame(entries, "word string, template int, label string, pos int, size int, need int, words array<string>")
    if len(entries) < 100_000:  # one row per prefix word of a template
        index = F.broadcast(index)
    blocks = first.where("blocks is not null").select("row", F.posexplode("blocks").alias("block", "held"))
    blocks = blocks.where(F.exists("held", lambda x: x.isin(prefix))).select("row", "block", F.array_intersect(_literal(order), "held").alias("held"))
    probes = blocks.select("row", "block", "held", F.explode(of(F.col("held"), prefix)).alias("word"))
    at = F.array_position("held", F.col("word")).cast("int")
    most = F.least(F.col("pos"), at - 1) + 1 + F.least(F.col("size") - F.col("pos") - 1, F.size("held") - at)
    common = F.size(F.array_intersect("held", "words"))
    met = (
        probes.join(index, "word")
        .where((F.size("held") >= F.col("need")) & (most >= F.col("need")))
        .where(common >= F.col("need"))
        .groupBy("row", "block", "template")
        .agg(F.first("label").alias("label"), F.max(common / F.col("size")).alias("containment"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("block", "template", "label", "containment")).alias("found"))
    )
    return first.join(met, "row", "left").select("doc_id", "n_words", "places", "found")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = find_licenses(scan(spark, sf_dir, "documents"))
    places = F.coalesce("places", F.array().cast("array<struct<at:long,label:string>>"))
    found = F.coalesce("found", F.array().cast("array<struct<block:int,template:int,label:string,containment:double>>"))
    base = F.array_distinct(F.transform(places, lambda x: x["label"]))
    text = lambda labels: F.array_join(F.array_sort(labels), ",")
    return r.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform(places, lambda x: x["at"])).alias("last_word"),
        text(base).alias("base_labels"),
        text(F.array_union(base, F.transform(found, lambda x: x["label"]))).alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(found, lambda x: x["containment"])), F.lit(0.0))).alias("score"),
    )
