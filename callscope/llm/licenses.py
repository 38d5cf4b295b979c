"""Operator 2: license scans, an exact set-similarity join of text blocks with license templates.

Base: the places where a phrase's words stand consecutively. Method: a block of text meets a
template if it holds at least ``share`` of the template's distinct words. Blocks are half
overlapping windows of each line and of the whole text across its line breaks. Their size follows the
template: twice the least power of two (``LEAST`` at the smallest) that its words fit in, so a template
of any length lies whole in some window.

Words of the templates are ordered by their frequency over all documents. A block that meets a
template must hold one of the template's rarest words (prefix filter), enough distinct words
(length filter) and enough words from there on in both orders (positional filter); what passes
is counted exactly. Nothing that meets a template is missed.

Built-in functions only. Null text counts as empty, and empty text has no words. Repeated rows
and ties are handled row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Public license texts and notices, as words.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by-4": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Words that the smallest windows advance by; they are twice as long.
LEAST = 32
_OTHER = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def _need(words: set[str], share: float) -> int:
    return -int(-len(words) * share // 1)


def line_words(text: Column) -> Column:
    """Lines that have words, as words with one blank between.

    ``lower`` touches more than A-Z, but makes no word, phrase or template word out of others:
    what it changes beyond is not ASCII before and, but for the Kelvin sign, not after.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _OTHER, " ")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def _phrase(words: Column, phrase: str) -> Column:
    """``n, first, last`` of a phrase in words that have a blank before each and at the end."""

    def place(pieces: Column) -> Column:
        n = F.size(pieces) - 1
        upto = F.substring(words, F.lit(1), F.length(words) - F.length(F.element_at(pieces, -1)) - len(phrase) - 1)
        return F.struct(n.cast("bigint").alias("n"), _blanks(pieces[0]).alias("first"), _blanks(upto).alias("last"))

    absent = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"))
    return F.when(words.contains(f" {phrase} "), let(F.split(words, f" {phrase}(?= )", -1), place)).otherwise(absent)


def strides(templates: Mapping[str, str]) -> dict[str, int]:
    """For each template the words by which its windows advance: no less than its own words."""
    return {label: max(LEAST, 1 << (len(text.split()) - 1).bit_length()) for label, text in templates.items()}


def template_blocks(lines: DataFrame, templates: Mapping[str, str] = TEMPLATES, share: float = 0.8) -> DataFrame:
    """``_row, label, overlap, size`` of all blocks that meet a template. ``lines`` has ``_row, _lines``."""
    spark = lines.sparkSession
    sets = {label: set(text.split()) for label, text in templates.items()}
    stride = strides(templates)
    vocabulary = sorted(set().union(*sets.values()))
    counted = lines.select(F.explode("_lines").alias("l")).select(F.explode(F.split("l", " ")).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count()
    often = {r["w"]: r["count"] for r in counted.collect()}  # a row for each template word at most
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}

    rows = []
    for label, words in sets.items():
        need = _need(words, share)
        ranks = sorted(order[w] for w in words)
        rows += [(order[w], label, stride[label], k, len(ranks), need, ranks) for k, w in enumerate(sorted(words, key=order.get)) if k <= len(words) - need]
    prefix = spark.createDataFrame(rows, "rank long, label string, stride int, at long, size long, need long, ranks array<long>")
    table = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.lit(order[w]).cast("bigint"))])

    by_line = lines.select("_row", F.explode("_lines").alias("l")).select("_row", F.split("l", " ").alias("w"))
    # Notices are wrapped: the words of a text are a line of their own.
    whole = lines.where(F.size("_lines") > 1).select("_row", F.split(F.array_join("_lines", " "), " ").alias("w"))

    def windows(words: DataFrame, step: int) -> DataFrame:
        """Windows of ``2 * step`` words that hold a word which a template of that size must have one of."""
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - step, F.lit(1)), F.lit(step))
        rare = F.array(*[F.lit(w) for w in vocabulary if any(order[w] == r[0] for r in rows if r[2] == step)])
        found = words.select("_row", F.explode(F.filter(F.transform(starts, lambda i: F.slice("w", i, 2 * step)), lambda x: F.arrays_overlap(x, rare))).alias("w"))
        ranked = found.select("_row", F.array_sort(F.filter(F.transform(F.array_distinct("w"), lambda w: F.try_element_at(table, w)), lambda r: r.isNotNull())).alias("v"))
        least = min(r[5] for r in rows if r[2] == step)
        return ranked.where(F.size("v") >= least).select("_row", F.lit(step).alias("stride"), "v", F.size("v").alias("m"))

    ranked = None
    for step in sorted(set(stride.values())):
        some = windows(by_line, step).union(windows(whole, step))
        ranked = some if ranked is None else ranked.union(some)
    probes = ranked.select("_row", "stride", "v", "m", F.posexplode("v").alias("j", "rank"))
    # The templates are a parameter: their rows, some hundreds, are sent to every task.
    met = probes.join(F.broadcast(prefix), ["rank", "stride"]).where((F.col("m") >= F.col("need")) & (F.least(F.col("size") - F.col("at"), F.col("m") - F.col("j")) >= F.col("need")))
    overlap = F.size(F.array_intersect("v", "ranks"))
    return met.select("_row", "label", overlap.cast("bigint").alias("overlap"), "size", "need").where("overlap >= need").select("_row", "label", "overlap", "size")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.8, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Base counts and places, labels of both, and a score: the best containment found, 1 for a phrase."""
    lines = docs.select(F.col(id_col).alias("_id"), line_words(F.col(text_col)).alias("_lines"))
    # Rows are told apart by their words, so that repeated and null ids need no special care.
    keyed = lines.withColumn("_row", F.xxhash64("_lines"))
    method = template_blocks(keyed.select("_row", "_lines"), templates, share).groupBy("_row").agg(F.collect_set("label").alias("_more"), F.max(F.col("overlap") / F.col("size")).alias("_best"))
    words = keyed.select("_id", "_row", F.concat(F.lit(" "), F.array_join("_lines", " "), F.lit(" ")).alias("_words"))
    phrases = {label: _phrase(F.col("_words"), phrase) for phrase, label in PHRASES.items()}
    found = words.select("_id", "_row", F.when(F.col("_words") == "  ", 0).otherwise(_blanks(F.col("_words")) - 1).cast("bigint").alias("n_words"), *[c.alias(k) for k, c in phrases.items()])
    names = list(phrases)
    base = F.array_compact(F.array(*[F.when(F.col(f"`{k}`.n") > 0, F.lit(k)) for k in names]))
    found = found.select(
        "_id", "_row", "n_words", sum((F.col(f"`{k}`.n") for k in names[1:]), F.col(f"`{names[0]}`.n")).alias("n_base"),
        F.least(*[F.col(f"`{k}`.first") for k in names]).alias("first_word"), F.greatest(*[F.col(f"`{k}`.last") for k in names]).alias("last_word"), base.alias("_base"),
    )
    both = found.join(method, "_row", "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0)))
    return both.select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"),
    )
