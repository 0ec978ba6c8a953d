"""License scans: phrases, and diagonal voting of word k-grams against templates.

Every rolling word k-gram of every text is hashed and joined with the positions of equal
k-grams in license templates. A hit votes for a diagonal (its position in the text less
that in the template). Votes are counted for each diagonal, neighbouring diagonals are
merged where words were added or left out, and a span is proposed when enough of the
template's k-grams stand in it. Then its words are compared with the template's, in order:
a span counts when words that stand in both in the same order make enough of the longer one. Only texts with proposed spans are read for that.

The templates are fixed: openings, short notices and sections of license texts, each a row
with a share of its own. So the broadcast side of the join has a bounded size (about
11,000 positions) whatever the input. The join and the explosion run in one stage: only
hits are shuffled. Of spans that cover the same words, the one that holds most k-grams
counts: a notice of one license is not one of another that reads nearly alike.

Defined results: a null or empty text has no words, no places and no labels; very long
texts are scanned whole; a k-gram that several templates share votes for each of them, and of
spans that hold equally many k-grams all stay; a share of exactly the bound counts; rows that repeat an id are matched by id and text, so each keeps
its own result; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import frames
from graphloom.llm.frames import cut_lineage
from graphloom.llm.license_texts import NOTICES, SECTIONS
from graphloom.llm.words import LETTERS, Words

#: Phrases that name a license outright, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Openings of public license notices.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "apache-2": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
#: Label and text of every template.
ROWS = (*TEMPLATES.items(), *NOTICES, *SECTIONS)
#: Words of a k-gram.
GRAM = 3
#: Diagonals this far apart can belong to one span: words added or left out.
DRIFT = 4
#: Words of the text between two runs of hits of one span, at most.
GAP = 8
#: Least share of a template's k-grams, and of its words in their order, that a span must hold.
SHARE = 0.7

_FINDERS = [(re.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])"), label) for p, label in PHRASES.items()]


@F.arrow_udf(T.ArrayType(T.LongType()))
def _grams(texts: pa.Array) -> pa.Array:
    return pa.array([Words([t], LETTERS).grams(GRAM)[0].view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))


def template_positions(df: DataFrame, templates: Iterable[tuple[str, str]]) -> DataFrame:
    """``(gram, row, label, place, size)``: each template's k-grams."""
    rows = []
    for row, (label, text) in enumerate(templates):
        grams = Words([text], LETTERS).grams(GRAM)[0].view(np.int64).tolist()
        rows += [(gram, row, label, place, len(grams)) for place, gram in enumerate(grams)]
    return df.sparkSession.createDataFrame(rows, "gram long, row int, label string, place int, size int")


def spans(docs: DataFrame, templates: Iterable[tuple[str, str]] = ROWS) -> DataFrame:
    """``(id, text_key, row, first_word, last_word, held)`` of each proposed span; docs has id, text_key and text."""
    hits = (
        docs.select("id", "text_key", F.posexplode(_grams("text")).alias("at", "gram"))
        .join(F.broadcast(template_positions(docs, templates)), "gram")
        .select("id", "text_key", "row", "label", "size", "at", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    )
    one = ["id", "text_key", "row", "label", "size"]
    diagonals = hits.groupBy(*one, "diagonal").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_set("place").alias("places"))
    # texts have few hits, so a text's diagonals for one template are a small group; stray hits on far diagonals don't part a band
    across = Window.partitionBy(*one).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(across) > DRIFT, F.lit(True))
    bands = diagonals.withColumn("apart", apart).withColumn("band", F.sum(F.col("apart").cast("int")).over(across))
    order = Window.partitionBy(*one, "band").orderBy("lo", "diagonal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("lo") > F.max("hi").over(before) + GAP, F.lit(True))
    merged = bands.withColumn("new", new).withColumn("span", F.sum(F.col("new").cast("int")).over(order)).groupBy(*one, "band", "span")
    held = F.size(F.array_distinct(F.flatten(F.collect_list("places"))))
    return (
        merged.agg(F.min("lo").alias("first_word"), (F.max("hi") + GRAM - 1).alias("last_word"), held.alias("held"))
        .withColumn("share", F.col("held") / F.col("size"))
        .where(F.col("share") >= SHARE)
        .select("id", "text_key", "row", F.col("first_word").cast("int"), F.col("last_word").cast("int"), F.col("held").cast("int"))
    )


def strongest(found: list[dict]) -> list[dict]:
    """The spans of one text without those that are covered, for half their words or more, by a span that holds more k-grams."""
    found = sorted(found, key=lambda s: s["first_word"])
    firsts = [s["first_word"] for s in found]
    longest = max((s["last_word"] - s["first_word"] for s in found), default=0)

    def covered(s: dict) -> bool:
        first, last = s["first_word"], s["last_word"]
        near = found[bisect_left(firsts, first - longest) : bisect_right(firsts, last)]
        return any(t["held"] > s["held"] and 2 * (min(last, t["last_word"]) - max(first, t["first_word"]) + 1) >= last - first + 1 for t in near)

    return [{k: v for k, v in s.items() if k != "held"} for s in found if not covered(s)]


def _share(words: list[bytes], template: list[bytes]) -> float:
    """Share of words that stand in both in the same order, of the longer of the two."""
    return sum(m.size for m in SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks()) / max(len(words), len(template))


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("share", pa.float64())])
_SPANS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType()), T.StructField("share", T.DoubleType())]))
_READ = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("spans", _SPANS)])


def _reader(templates: list[tuple[str, str]]):
    """A function of texts and proposed spans: the number of words, the phrases' places, and the spans whose words agree."""

    def run(texts: pa.Array, proposed: pa.Array) -> pa.Array:
        rows, known = [], {}
        for text, found in zip(texts.to_pylist(), proposed.to_pylist(), strict=True):
            words = Words([text], LETTERS).list()
            joined = b" ".join(words)
            starts, labels = [], []
            for finder, label in _FINDERS:
                for m in finder.finditer(joined):
                    starts.append(m.start())
                    labels.append(label)
            if starts:
                spaces = np.cumsum(np.frombuffer(joined, dtype=np.uint8) == 0x20)
                starts = [int(spaces[s]) for s in starts]
            agreed = []
            for s in found or ():
                label, wording = templates[s["row"]]
                template = known.setdefault(s["row"], Words([wording], LETTERS).list())
                share = _share(words[s["first_word"] : s["last_word"] + 1], template)
                if share >= SHARE:
                    agreed.append({"label": label, "first_word": s["first_word"], "last_word": s["last_word"], "share": share, "held": s["held"]})
            rows.append({"n_words": len(words), "starts": starts, "labels": labels, "spans": strongest(agreed)})
        kinds = [("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))]
        return pa.array(rows, pa.struct(kinds))

    return F.arrow_udf(run, _READ)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Iterable[tuple[str, str]] = ROWS) -> DataFrame:
    """One row for each row of ``df``: ``(id, n_words, starts, base_labels, spans, score)``.

    ``starts`` are the word indexes of the phrases, ``spans`` the verified template spans,
    ``score`` is 1 where a phrase stands, else the largest share of a template's words found.
    """
    templates = list(templates)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    # a text's spans are at most one for some words of it
    found = spans(docs, templates).groupBy("id", "text_key").agg(F.collect_set(F.struct("row", "first_word", "last_word", "held")).alias("found"))
    # few texts have spans: these are sent to the texts, so that no text is shuffled to meet them
    found = cut_lineage(found)
    size = found.agg(F.sum(F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(0)) + 32 + 24 * F.size("found"))).first()[0] or 0
    found = F.broadcast(found) if size <= frames.BROADCAST_NAMES else found
    same: Column = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.text_key") == F.col("b.text_key"))
    read = docs.alias("a").join(found.alias("b"), same, "left").select(F.col("a.id").alias("id"), _reader(templates)("a.text", "b.found").alias("p"))
    share = F.array_max(F.transform("p.spans", lambda s: s["share"]))
    return read.select(
        F.col("id").alias(id_col),
        F.col("p.n_words"),
        F.array_sort("p.starts").alias("starts"),
        F.array_sort(F.array_distinct("p.labels")).alias("base_labels"),
        F.array_sort(F.array_distinct("p.spans")).alias("spans"),
        F.when(F.size("p.starts") > 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )
