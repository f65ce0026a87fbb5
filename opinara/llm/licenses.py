"""License notices by diagonal voting.

Templates and documents are cut into rolling hashes of ``k`` words. A join of both gives
matches: a word position in a document, one in a template. All matches of an unedited
notice lie on one diagonal, the difference of the two positions; a word more or less
moves the rest to a neighbouring diagonal. Votes are summed per diagonal, neighbouring
diagonals merged, and a span with enough votes is verified by its words: the whole
template is aligned with the words around the span, by edits of words. Few edits may
remain, and none of a word that tells licenses apart. Fixed phrases are counted beside that.

A bitmap of fixed size lets tasks emit only hashes that can match, and the words around
them; the index of templates is as large as the list of templates, whatever the documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.batches import map_slices, materialize
from opinara.llm.words import ALNUM, Words, gram_hash, words_of

# Phrases and their labels. Fixed values.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices as they stand in texts, by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("mit", "Released under MIT License"),
    ("mit", "Licensed under MIT License"),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission",
    ),
    (
        "lgpl",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation",
    ),
    (
        "agpl",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation",
    ),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    (
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def more_templates() -> list[tuple[str, str]]:
    """Creative Commons and GNU notices by license and version."""
    out = []
    names = {"nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
    for terms in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        short, long_ = ("-".join(x) for x in (("by", *terms), ("Attribution", *(names[t] for t in terms))))
        for version in ("3.0", "4.0"):
            label = f"cc-{short}-{version}"
            out.append((label, f"Licensed under CC {short} {version}"))
            out.append((label, f"licensed under a Creative Commons {long_} {version} International License"))
    for label, name, versions in (("gpl", "", "23"), ("lgpl", "Lesser ", "23"), ("agpl", "Affero ", "3")):
        for v in versions:
            out.append((f"{label}-{v}.0", f"GNU {name}General Public License, version {v}"))
            out.append((f"{label}-{v}.0", f"GNU {name}General Public License v{v}"))
    return [*out, ("lgpl-2.1", "GNU Lesser General Public License version 2.1"), ("lgpl-2.1", "GNU Lesser General Public License v2.1")]


TEMPLATES = (*TEMPLATES, *more_templates())

# Words that tell licenses apart, beside numbers: none may be missing or too many.
DECISIVE = (
    "gnu apache mit gpl lgpl agpl bsd isc mozilla mpl eclipse epl lesser affero nc sa nd "
    "noncommercial sharealike noderivatives noderivs"
).split()
NUMBERS = tuple(str(i) for i in range(100))
DECISIVE = (*DECISIVE, *NUMBERS, *("v" + n for n in NUMBERS))

FILTER_BITS = 1 << 20


@dataclass(frozen=True)
class Settings:
    k: int = 3
    gap: int = 2  # between diagonals of one notice
    votes: float = 0.25  # of a template's hashes, for a span to be looked at
    edits: float = 0.2  # of a template's words; one in any case


def template_index(templates, k: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    """``(hash, template, position)`` of all templates, and ``(template, label, hashes)``."""
    rows, facts = [], []
    for t, (label, text) in enumerate(templates):
        grams = gram_hash(words_of(pa.array([text]), ALNUM).hash, k).view(np.int64)
        if len(grams) == 0:
            raise ValueError(f"template of fewer than {k} words: {text}")
        rows += [(int(g), t, q) for q, g in enumerate(grams)]
        facts.append((t, label, len(grams)))
    return rows, facts


def align(template: Sequence[int], near: Sequence[int], decisive: set[int]) -> tuple[int, int, int]:
    """Fewest edits that turn some run of ``near`` into the whole template, and that run.

    An edit of a decisive word counts as many as all others together.
    """
    much = len(template) + len(near) + 1
    best = [(0, j) for j in range(len(near) + 1)]  # edits so far, start of the run
    extra = [much if x in decisive else 1 for x in near]
    for w in template:
        own = much if w in decisive else 1
        last = (best[0][0] + own, best[0][1])
        row = [last]
        for j, x in enumerate(near):
            cost, start = best[j]
            if x != w:
                cost += max(own, extra[j])
            if best[j + 1][0] + own < cost:
                cost, start = best[j + 1][0] + own, best[j + 1][1]
            if last[0] + extra[j] < cost:
                cost, start = last[0] + extra[j], last[1]
            last = (cost, start)
            row.append(last)
        best = row
    end = min(range(len(best)), key=lambda j: best[j][0])
    return best[end][0], best[end][1], end


def phrase_places(w: Words, phrases: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and phrase numbers of all places of all phrases."""
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(len(counts)), counts)
    at, number = [], []
    for i, phrase in enumerate(phrases):
        own = words_of(pa.array([phrase]), ALNUM).hash
        n = len(w.hash) - len(own) + 1
        if n > 0:
            same = owner[:n] == owner[len(own) - 1 :]
            for j, h in enumerate(own):
                same &= w.hash[j : j + n] == h
            at.append(np.flatnonzero(same))
            number.append(np.full(len(at[-1]), i))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *number])


def scan(docs: DataFrame, hashes: np.ndarray, phrases: dict[str, str], k: int, reach: int) -> DataFrame:
    """Base counts of each document, its hashes that may be a template's, and the words up
    to ``reach`` words from these."""
    bits = np.zeros(FILTER_BITS, bool)
    bits[(hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    labels = list(phrases.values())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words_of(batch.column(1), ALNUM)
        n = batch.num_rows
        counts = np.diff(w.first)
        owner = np.repeat(np.arange(n), counts)
        at, number = phrase_places(w, phrases)
        doc = owner[at]
        place = at - w.first[doc]
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.minimum.at(low, doc, place)
        np.maximum.at(high, doc, place)
        found = np.zeros((n, len(labels)), bool)
        found[doc, number] = True
        named = [",".join(sorted({labels[j] for j in np.flatnonzero(f)})) for f in found]
        g = gram_hash(w.hash, k)
        bit = (g & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        hit = (shared.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
        hit = np.flatnonzero((hit == 1) & (owner[: len(g)] == owner[k - 1 :][: len(g)])) if len(g) else np.zeros(0, np.int64)
        inner = pa.StructArray.from_arrays(
            [pa.array(hit - w.first[owner[hit]]), pa.array(g[hit].view(np.int64))], names=["p", "g"]
        )
        cuts = np.searchsorted(owner[hit], np.arange(n + 1)).astype(np.int32)
        change = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(change, np.maximum(hit - reach, w.first[owner[hit]]), 1)
        np.add.at(change, np.minimum(hit + k + reach, w.first[owner[hit] + 1]), -1)
        near = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        around = pa.StructArray.from_arrays(
            [pa.array(near - w.first[owner[near]]), pa.array(w.hash[near].view(np.int64))], names=["p", "h"]
        )
        near_cuts = np.searchsorted(owner[near], np.arange(n + 1)).astype(np.int32)
        none = high < 0
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(counts.astype(np.int64)),
                pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
                pa.array(low, mask=none),
                pa.array(high.astype(np.int64), mask=none),
                pa.array(named, pa.string()),
                pa.ListArray.from_arrays(pa.array(cuts), inner),
                pa.ListArray.from_arrays(pa.array(near_cuts), around),
            ],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "hits", "near"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(
        docs,
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "hits array<struct<p: long, g: long>>, near array<struct<p: long, h: long>>",
    )


def candidates(scanned: DataFrame, rows, facts, s: Settings) -> DataFrame:
    """``(uid, t, low, high)``: templates with enough votes, on diagonals ``low`` to ``high``."""
    spark = scanned.sparkSession
    index = spark.createDataFrame(rows, "g long, t int, q int")
    templates = spark.createDataFrame(facts, "t int, label string, grams int").drop("label")
    votes = (
        scanned.select("uid", F.explode("hits").alias("h"))
        .select("uid", "h.*")
        .join(F.broadcast(index), "g")
        .groupBy("uid", "t", (F.col("p") - F.col("q")).alias("diagonal"))
        .agg(F.collect_set("q").alias("qs"))
    )
    order = Window.partitionBy("uid", "t").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > s.gap).cast("int"), F.lit(1))
    return (
        votes.withColumn("apart", apart)
        .withColumn("part", F.sum("apart").over(order))
        .groupBy("uid", "t", "part")
        .agg(
            F.min("diagonal").alias("low"),
            F.max("diagonal").alias("high"),
            F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("covered"),
        )
        .join(F.broadcast(templates), "t")
        .where(F.col("covered") >= s.votes * F.col("grams"))
        .select("uid", "t", "low", "high")
    )


def spans(scanned: DataFrame, templates, rows, facts, s: Settings) -> DataFrame:
    """Verified spans ``(uid, label, from_word, to_word, coverage)`` of templates.

    Coverage is the share of the template's words that stand unedited. Where a template
    ends in a version without minor number, none but 0 may follow.
    """
    words = [words_of(pa.array([text]), ALNUM).hash.view(np.int64).tolist() for _, text in templates]
    named = lambda names: set(words_of(pa.array([" ".join(names)]), ALNUM).hash.view(np.int64).tolist())
    decisive, minor, numbers = named(DECISIVE), named(NUMBERS[1:]), named(NUMBERS)
    versions = decisive - named(x for x in DECISIVE if not x[-1].isdigit())
    open_ = [own[-1] in versions and own[-2] not in numbers for own in words]
    labels = [label for label, _ in templates]
    found = candidates(scanned, rows, facts, s).groupBy("uid").agg(F.collect_list(F.struct("t", "low", "high")).alias("found"))

    def verify(batches):
        for batch in batches:
            known = {}  # notices are often copies
            out = []
            for uid, near, found in zip(*(batch.column(i) for i in range(3))):
                inner = near.values
                p, h = inner.field("p").to_numpy(), inner.field("h").to_numpy()
                for c in found.as_py():
                    own, t = words[c["t"]], c["t"]
                    slack = s.gap + max(1, int(s.edits * len(own)))
                    a, b = np.searchsorted(p, (c["low"] - slack, c["high"] + len(own) + slack))
                    case = (t, h[a:b].tobytes())
                    if case not in known:
                        around = h[a:b].tolist()
                        edits, first, end = align(own, around, decisive)
                        longer = open_[t] and end < len(around) and around[end] in minor
                        known[case] = len(own) if longer else edits, first, end
                    edits, first, end = known[case]
                    if edits <= max(1, int(s.edits * len(own))):
                        out.append((uid.as_py(), labels[t], int(p[a + first]), int(p[a + end - 1]), 1 - edits / len(own)))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["uid", "label", "from_word", "to_word", "coverage"],
            )

    return (
        scanned.select("uid", "near")
        .join(found, "uid")
        .mapInArrow(verify, "uid long, label string, from_word long, to_word long, coverage double")
        .distinct()
    )


def scan_licenses(
    docs: DataFrame,
    templates=TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    settings: Settings = Settings(),
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: base counts, ``base_labels``, ``labels``, ``score``, ``spans``.

    ``labels`` are those of phrases and of verified templates, ``score`` the best coverage
    of a verified template, 0 without one, ``spans`` all verified spans. A template of
    three or more words is found with edits in a fifth of its words, or one, as long as a
    quarter of its rolling hashes and all its decisive words are left. A null or empty
    text has no words, empty labels and null first and last words. Repeated rows and null
    keys are rows like any other.
    """
    rows, facts = template_index(templates, settings.k)
    hashes = np.array([g for g, _, _ in rows], np.int64).view(np.uint64)
    longest = max(grams for _, _, grams in facts) + settings.k - 1
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    scanned = materialize(
        scan(docs, hashes, phrases, settings.k, 2 * longest + 8).withColumn("uid", F.monotonically_increasing_id()), "scanned"
    )
    found = spans(scanned, templates, rows, facts, settings).groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("from_word", "to_word", "label", "coverage"))).alias("spans")
    )
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    empty = F.array().cast("array<struct<from_word: bigint, to_word: bigint, label: string, coverage: double>>")
    every = F.coalesce("spans", empty)
    return scanned.drop("hits", "near").join(found, "uid", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_join(F.array_sort(F.array_union(base, F.transform(every, lambda x: x["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(every, lambda x: x["coverage"])), F.lit(0.0)).alias("score"),
        every.alias("spans"),
    )
