"""License scan: an exact set-similarity join of text blocks with license templates.

Every text is cut into overlapping blocks of words. A template belongs to the smallest class of 8, 16, 32, ... words that holds it; the
blocks of a class have twice as many words and begin at every multiple of its size, so a passage as long as the template lies whole in
one of them. A block meets a template if it holds at least ``THRESHOLD`` of the template's distinct tokens.

The join is exact and by filters. Tokens are ordered globally by the number of documents that hold them, rarest first. A template with
``o`` tokens to be found and a block that meets it share a token among the first ``|T| - o + 1`` of the template (prefix filter, an
inverted index over these) and the first ``|B| - o + 1`` of the block; a block with fewer than ``o`` tokens can't meet it (length
filter); a shared token at places i and j leaves at most ``1 + min(|B| - i - 1, |T| - j - 1)`` tokens to share (positional filter). What
is left is counted. Tokens in no template can't be shared, so blocks leave them out.

Licenses differ by single words, so a block can meet several templates of a family. A block names a template unless an overlapping
block shares more with another one: a true superset of its shared tokens, or the same ones with a shorter template.

Templates are fixed text, so they and the index travel with the tasks; texts are read row by row, counts are one row per token.

Defined results: a null or empty text has no words, no blocks and no labels; ties between templates or blocks are all reported; repeated
rows are judged each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from mendcast.llm.common import ascii_terms, map_batches, utf8

THRESHOLD = 0.85
SMALLEST = 8

#: Label and wording of statements that put a text under a license, or keep its rights.
TEMPLATES = [
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Phrases whose words name a license wherever they stand together, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]


class Templates:
    """The templates as token sets: classes, tokens to be found, and their order once the counts of the tokens are known."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD):
        self.labels = [label for label, _ in templates]
        words = [ascii_terms(text.encode()) for _, text in templates]
        self.phrases = [ascii_terms(text.encode()) for text, _ in phrases]
        self.phrase_labels = [label for _, label in phrases]
        self.number: dict[bytes, int] = {}
        for w in [w for ws in [*words, *self.phrases] for w in ws]:
            self.number.setdefault(w, len(self.number))
        self.sets = [frozenset(self.number[w] for w in ws) for ws in words]
        self.needed = [int(np.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.size = [max(SMALLEST, 1 << (len(ws) - 1).bit_length()) for ws in words]
        self.spoken = [np.array([self.number[w] for w in ws]) for ws in self.phrases]

    def order_by(self, counts: np.ndarray) -> None:
        """``place`` of every token in the global order, the sorted templates, and per class the index of their prefixes."""
        order = np.lexsort((np.arange(len(counts)), counts))
        self.place = np.empty(len(counts), np.int64)
        self.place[order] = np.arange(len(counts))
        self.sorted = [sorted(int(self.place[t]) for t in s) for s in self.sets]
        self.index = defaultdict(lambda: defaultdict(list))
        for i, (tokens, needed, size) in enumerate(zip(self.sorted, self.needed, self.size)):
            for j, token in enumerate(tokens[: len(tokens) - needed + 1]):
                self.index[size][token].append((i, j))
        self.index = {size: dict(index) for size, index in self.index.items()}

    def positions(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the words that occur in a template or phrase."""
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(found >= 0)
        return at, found[at]

    def phrase_places(self, at: np.ndarray, tokens: np.ndarray) -> list[tuple[int, int]]:
        """(first word, phrase) of every place where a phrase's words stand consecutively."""
        out = []
        for i, phrase in enumerate(self.spoken):
            first = np.flatnonzero(tokens == phrase[0])
            first = first[first + len(phrase) <= len(tokens)]
            for j in range(1, len(phrase)):
                first = first[(tokens[first + j] == phrase[j]) & (at[first + j] == at[first] + j)]
            out += [(int(p), i) for p in at[first]]
        return sorted(out)

    def blocks_met(self, at: np.ndarray, tokens: np.ndarray) -> list[tuple]:
        """(first word, end, template, shared tokens) of every block that meets a template, by its first word."""
        out = []
        place = self.place[tokens]
        for size, index in self.index.items():
            probes = np.flatnonzero(np.isin(place, list(index)))
            if not len(probes):
                continue
            blocks = at[probes] // size
            for b in np.union1d(blocks, np.maximum(blocks - 1, 0)).tolist():
                low, high = np.searchsorted(at, (b * size, (b + 2) * size))
                out += [(b * size, (b + 2) * size, t, shared) for t, shared in self.meets(np.unique(place[low:high]).tolist(), index)]
        return sorted(out, key=lambda hit: hit[:3])

    def meets(self, block: list[int], index: dict) -> list[tuple[int, frozenset]]:
        """Templates that a block of sorted tokens meets, with the tokens they share."""
        seen: dict[int, int] = {}
        for i, token in enumerate(block):
            for t, j in index.get(token, ()):
                needed = self.needed[t]
                if i > len(block) - needed:  # beyond the block's prefix, or too short a block
                    continue
                reach = 1 + min(len(block) - i - 1, len(self.sorted[t]) - j - 1)
                # a template that can't reach what is needed any more stays below it
                seen[t] = seen.get(t, 0) + 1 if seen.get(t, 0) + reach >= needed else -len(block)
        found = [(t, frozenset(block).intersection(self.sorted[t])) for t, n in seen.items() if n > 0]
        return [(t, shared) for t, shared in found if len(shared) >= self.needed[t]]

    def named(self, hits: list[tuple]) -> list[bool]:
        """Whether no overlapping block shares more with another template."""
        begins, widest = [h[0] for h in hits], 2 * max(self.size)

        def less(t, shared, other, more):
            return shared < more or (shared == more and len(self.sets[other]) < len(self.sets[t]))

        return [
            not any(
                less(t, shared, other, more)
                for _, e, other, more in hits[bisect_left(begins, begin - widest): bisect_left(begins, end)] if e > begin
            ) for begin, end, t, shared in hits
        ]


def token_counts(rows: DataFrame, templates: Templates) -> np.ndarray:
    """Documents of the whole table that hold each token of the templates; a row per token and task is added up."""
    import pyarrow as pa

    def run(batches):
        seen = np.zeros(len(templates.number), np.int64)
        for batch in batches:
            for text in utf8(batch.column(0)):
                held = templates.number.keys() & ascii_terms(text.as_py() or b"")
                seen[[templates.number[w] for w in held]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], ["token", "n"])

    sums = rows.select("_text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(templates.number), np.int64)
    counts[sums["token"].to_numpy()] = sums["n"].to_numpy()
    return counts


BLOCK = "array<struct<template:int,label:string,first_word:bigint,n_words:int,containment:double,named:boolean>>"
PLACE = "array<struct<first_word:bigint,label:string>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Templates | None = None) -> DataFrame:
    """``_id, n_words``, ``phrases`` (places of phrases) and ``blocks`` (every block that meets a template) of every text."""
    import pyarrow as pa

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    templates = templates or Templates()
    templates.order_by(token_counts(rows, templates))
    block = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int32()),
                                ("containment", pa.float64()), ("named", pa.bool_())]))
    place = pa.list_(pa.struct([("first_word", pa.int64()), ("label", pa.string())]))

    def make():
        def work(batch):
            sizes, phrases, blocks = [], [], []
            for text in utf8(batch.column(batch.schema.get_field_index("_text"))):
                words = ascii_terms(text.as_py() or b"")
                at, tokens = templates.positions(words)
                sizes.append(len(words))
                phrases.append([{"first_word": p, "label": templates.phrase_labels[i]} for p, i in templates.phrase_places(at, tokens)])
                hits = templates.blocks_met(at, tokens)
                blocks.append([
                    {"template": t, "label": templates.labels[t], "first_word": begin, "n_words": min(end, len(words)) - begin,
                     "containment": len(shared) / len(templates.sets[t]), "named": named}
                    for (begin, end, t, shared), named in zip(hits, templates.named(hits))])
            return {"n_words": sizes, "phrases": pa.array(phrases, place), "blocks": pa.array(blocks, block)}

        return work

    return map_batches(rows, make, {"n_words": "long", "phrases": PLACE, "blocks": BLOCK})


def joined_labels(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def document_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: places of phrases, labels by phrases alone and with the templates, and a score.

    The score is the greatest containment of a template in a block that meets it, 1 where a phrase stands, and 0 without either.
    """
    found = scan_licenses(docs, id_col, text_col)
    places = F.transform("phrases", lambda p: p["first_word"])
    base = F.transform("phrases", lambda p: p["label"])
    named = F.transform(F.filter("blocks", lambda b: b["named"]), lambda b: b["label"])
    nearest = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return found.select(
        F.col("_id").alias(id_col), "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined_labels(base).alias("base_labels"), joined_labels(F.concat(base, named)).alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(nearest, F.lit(0.0))).alias("score"),
    )
