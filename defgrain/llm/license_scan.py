"""License statements: exact phrases, and an exact set-similarity join with license templates.

A text block (a line, or a paragraph between blank lines) matches a template if it holds at least
``threshold`` of the template's distinct words. Template words are ordered by how many blocks of the
whole corpus hold them, rarest first. A block can only match if it has one of the template's first
``n - need + 1`` words (prefix filter), enough template words at all (length filter), and enough of
them left after the first shared one on either side (positional filter); what passes is verified.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, map_batches

THRESHOLD = 0.8

# Phrases whose words must stand consecutively, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Statements and opening passages by which licenses are recognised; public texts.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain"),
    ("all-rights-reserved", "All rights reserved"),
]

_PARAGRAPH = re.compile(r"\n[ \t]*\n")


def template_words(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(alnum_words(text))) for label, text in templates]


def blocks(text: str | None) -> list[str]:
    """Lines, and paragraphs of several lines."""
    if not text:
        return []
    lines = text.split("\n")
    several = [p for p in _PARAGRAPH.split(text) if "\n" in p.strip()] if "\n" in text else []
    return lines + several


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many blocks of the corpus each template word occurs; as long as the vocabulary."""
    words = sorted(vocabulary)
    index = {w: i for i, w in enumerate(words)}

    def run(batches):
        counts = np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if vocabulary.isdisjoint(alnum_words(text)):
                    continue
                for block in blocks(text):
                    for w in vocabulary.intersection(alnum_words(block)):
                        counts[index[w]] += 1
        yield pa.record_batch([pa.array(range(len(words)), pa.int32()), pa.array(counts)], names=["w", "n"])

    found = docs.select(text_col).mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {words[r["w"]]: r["n"] for r in found}


class Matcher:
    """Templates with their words in global order, and the index of their prefixes."""

    def __init__(self, templates, frequencies: dict[bytes, int], threshold: float):
        vocabulary = set().union(*(words for _, words in templates)) if templates else set()
        order = sorted(vocabulary, key=lambda w: (frequencies.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates, self.prefix = [], {}
        for k, (label, words) in enumerate(t for t in templates if t[1]):
            ranked = sorted(self.rank[w] for w in words)
            need = max(1, math.ceil(threshold * len(ranked) - 1e-9))
            self.templates.append((label, frozenset(ranked), len(ranked), need))
            for position, r in enumerate(ranked[: len(ranked) - need + 1]):
                self.prefix.setdefault(r, []).append((k, position))
        self.prefix_words = frozenset(order[r] for r in self.prefix)

    def match(self, words: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of each template that a block of these words meets."""
        if self.prefix_words.isdisjoint(words):
            return []
        ranked = sorted({self.rank[w] for w in words if w in self.rank})
        seen, out = set(), []
        for at, r in enumerate(ranked):
            for k, position in self.prefix.get(r, ()):
                label, all_ranks, size, need = self.templates[k]
                if k in seen or len(ranked) < need:
                    continue
                seen.add(k)
                # The first shared word: both sides must have enough words from here on.
                if min(size - position, len(ranked) - at) < need:
                    continue
                overlap = len(all_ranks.intersection(ranked))
                if overlap >= need:
                    out.append((label, overlap / size))
        return out


def phrase_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(start, label) of each place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases.items():
        wanted = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(wanted[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(wanted)] == wanted:
                out.append((at, label))
    return sorted(out)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``labels`` are those of the phrases and of the templates that some block meets; ``score`` is 1
    with a phrase, else the best containment that meets the threshold, else 0. Null and empty texts
    have no words: counts 0, positions null, labels empty. Repeated rows are scanned alike, other
    columns ignored, and an empty table gives an empty result."""
    wanted = template_words(templates if templates is not None else TEMPLATES)
    vocabulary = frozenset().union(*(w for _, w in wanted))
    matcher = Matcher(wanted, word_frequencies(docs, vocabulary, text_col), threshold)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch):
        rows = []
        for text in batch.column(1).to_pylist():
            words = alnum_words(text)
            places = phrase_places(words) if b"license" in words else []
            base = {label for _, label in places}
            found = {}
            if not matcher.prefix_words.isdisjoint(words):
                for block in blocks(text):
                    for label, share in matcher.match(alnum_words(block)):
                        found[label] = max(share, found.get(label, 0.0))
            rows.append(
                (
                    len(words),
                    len(places),
                    places[0][0] if places else None,
                    places[-1][0] if places else None,
                    ",".join(sorted(base)),
                    ",".join(sorted(base | found.keys())),
                    1.0 if base else max(found.values(), default=0.0),
                )
            )
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        return pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=names)

    id_type = source.schema["doc_id"].dataType.simpleString()
    return map_batches(
        source,
        lambda b: run(b) if b.num_rows else None,
        f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
