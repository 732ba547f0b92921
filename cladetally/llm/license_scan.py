"""Find licence notices in texts: an exact containment join of text blocks with templates.

A template of n words meets every text block of n consecutive words that holds at least the share `threshold` of its
distinct words. Phrases are templates of threshold 1 whose words must also stand consecutively.

1. Order. The words of all templates are ordered by the number of documents that hold them, rare ones first, counted
   over all documents.
2. Prefix filter. A block that holds o of a template's t words holds one of the t - o + 1 rarest; only places of
   these words are looked at.
3. Positional and length filters. At such a place, as the block's rarest, the block gains at most what follows in the
   template's order, and at most the places of less rare template words within n words on both sides.
4. Verification. Around the places that are left, distinct words are counted for every start of a block at once: a word's place
   counts for the starts since its previous place. Neighbouring blocks that meet the threshold are one hit, its
   start that of the first fullest block. Where hits of several labels overlap, those that hold most stay; phrases stay always.

A word is a run of characters that are ASCII letters, digits or not ASCII; A-Z are lower-cased. Blocks are joined
in the tasks that read the texts: the templates are a parameter of at most MAX_WORDS words, so the index is small wherever it
is sent. The driver gets one count per template word. Nothing is shuffled but these counts.

Defined cases: null and empty texts hold no words and no hits; texts shorter than a template are one block; templates
without words are refused; repeated rows are rows of their own; an empty table gives no rows; all input columns are
passed through, those named like an added one are replaced by it.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladetally.llm.batches import beside_text, bounded
from cladetally.llm.columns import put_back, set_apart

MAX_WORDS = 100_000
THRESHOLD = 0.8
HIT = "label: string, phrase: boolean, start: bigint, length: bigint, containment: double"

# Bytes of words as they are, A-Z in lower case, all others a blank. Bytes from 0x80 on belong to characters that are not ASCII.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = THRESHOLD
    phrase: bool = False  # its words stand consecutively

    @property
    def words(self) -> list[bytes]:
        return words_of(self.text)


def phrase(label: str, text: str) -> Template:
    return Template(label, text, 1.0, True)


# The phrases and labels that are always looked for.
PHRASES = (
    phrase("mit", "under the mit license"),
    phrase("apache-2", "apache license version 2"),
    phrase("cc-by-nc", "cc by nc"),
)

# The notices that published licences ask to be placed in files, and customary statements.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
             "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
             "compliance with the License. You may obtain a copy of the License at"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
             "the following conditions are met"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    Template("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3"),
    Template("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
             "General Public License as published by the Free Software Foundation"),
    Template("agpl", "This work is licensed under the GNU Affero General Public License, version 3"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
             "was not distributed with this file, You can obtain one at"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
             "publish, use, compile, sell, or distribute this software"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def vocabulary(templates: Sequence[Template]) -> list[bytes]:
    """The templates' distinct words; refuses what is no bounded set of templates."""
    sizes = [len(t.words) for t in templates]
    if not all(sizes) or sum(sizes) > MAX_WORDS:
        raise ValueError(f"templates hold words, {MAX_WORDS} at most together")
    if not all(0 < t.threshold <= 1 for t in templates):
        raise ValueError("a threshold lies above 0 and is 1 at most")
    return sorted({w for t in templates for w in t.words})


class Words:
    """Template words in a batch of texts. Places are numbered through the batch, texts `gap` places apart."""

    def __init__(self, texts: list[str | None], numbers: dict[bytes, int], gap: int):
        words = [words_of(t) for t in texts]
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.cumsum(self.sizes + gap) - self.sizes
        get = numbers.get
        flat = np.array([n for w in words for n in map(get, w)], dtype=float)  # nan: no word of a template
        within = np.flatnonzero(~np.isnan(flat))
        self.token = flat[within].astype(np.int64)
        self.text = np.searchsorted(np.cumsum(self.sizes), within, side="right")
        self.place = within + (self.starts - (np.cumsum(self.sizes) - self.sizes))[self.text]


def word_counts(docs: DataFrame, templates: Sequence[Template] = NOTICES + PHRASES) -> dict[bytes, int]:
    """How many documents hold each template word. One row per task and word is shuffled, one per word collected."""
    known = vocabulary(templates)
    numbers = {w: i for i, w in enumerate(known)}

    def count(batches):
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            words = Words(batch.column(0).to_pylist(), numbers, 1)
            total += np.bincount(np.unique(words.text * len(known) + words.token) % len(known), minlength=len(known))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["word", "n"])

    counted = bounded(docs.select("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}
    return {w: found.get(i, 0) for i, w in enumerate(known)}


class Index:
    """Templates as words in the global order, to be met with batches of texts."""

    def __init__(self, templates: Sequence[Template], counts: dict[bytes, int]):
        self.templates = tuple(templates)
        order = sorted(vocabulary(templates), key=lambda w: (counts.get(w, 0), w))
        self.numbers = {w: i for i, w in enumerate(order)}  # the number is the rank, rare ones first
        self.sequences = [np.array([self.numbers[w] for w in t.words], dtype=np.int64) for t in templates]
        self.sets = [np.unique(s) for s in self.sequences]
        self.needs = [max(1, math.ceil(t.threshold * len(s) - 1e-9)) for t, s in zip(templates, self.sets)]
        self.gap = max((len(s) for s in self.sequences), default=0) + 1

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, list[tuple]]:
        """Number of words of each text, and the hits as (text, template, start, length, containment) in order."""
        words = Words(texts, self.numbers, self.gap)
        by_token = np.argsort(words.token, kind="stable")
        edges = np.searchsorted(words.token[by_token], np.arange(len(self.numbers) + 1))
        places = words.place[by_token]
        commoner: dict[int, np.ndarray] = {}

        def of(token):
            return places[edges[token]:edges[token + 1]]

        def above(token):
            if token not in commoner:
                commoner[token] = words.place[words.token > token]
            return commoner[token]

        hits = []
        for t in range(len(self.templates)):
            n, wanted, need = len(self.sequences[t]), self.sets[t], self.needs[t]
            at = []
            for position, token in enumerate(wanted[:len(wanted) - need + 1]):
                x = of(token)
                if not len(x):
                    continue
                around = np.searchsorted(above(token), x + n) - np.searchsorted(above(token), x - n, side="right")
                at.append(x[1 + np.minimum(around, len(wanted) - position - 1) >= need])
            at = np.sort(np.concatenate(at)) if at else np.empty(0, dtype=np.int64)
            if len(at):
                hits += self._blocks(t, at, [of(token) for token in wanted], words)
        return words.sizes, sorted(hits)

    def _blocks(self, t: int, at: np.ndarray, found: list[np.ndarray], words: Words) -> list[tuple]:
        """Hits of one template around the places `at`; `found` are the places of its words, rare ones first."""
        n, size, need = len(self.sequences[t]), len(self.sets[t]), self.needs[t]
        opened, closed = [], []
        for places in found:
            after = np.searchsorted(at, places)
            near = np.minimum(np.abs(places - at[np.minimum(after, len(at) - 1)]), np.abs(places - at[np.maximum(after - 1, 0)]))
            places = places[near < n]
            since = np.maximum(np.concatenate([[-1], places[:-1]]) + 1, places - n + 1)
            opened.append(since)
            closed.append(places + 1)
        where = np.concatenate([*opened, *closed])
        step = np.repeat([1, -1], len(where) // 2)
        turns, index = np.unique(where, return_inverse=True)
        held = np.cumsum(np.bincount(index, weights=step, minlength=len(turns)).astype(np.int64))
        full = held >= need
        begins = np.flatnonzero(full & ~np.concatenate([[False], full[:-1]]))
        ends = np.flatnonzero(full & ~np.concatenate([full[1:], [False]]))
        out = []
        for b, e in zip(begins, ends):
            text = int(np.searchsorted(words.starts, turns[b] + n, side="left")) - 1
            first, size_of = int(words.starts[text]), int(words.sizes[text])
            if self.templates[t].phrase:
                # All its words are here; now their order.
                for start in range(int(turns[b]), int(turns[e + 1])):
                    if all(len(p) for p in found) and self._stands(t, start, words):
                        out.append((text, t, start - first, n, 1.0))
                continue
            best = b + int(np.argmax(held[b:e + 1]))
            start = max(int(turns[best]) - first, 0)
            out.append((text, t, start, min(n, size_of - start), float(held[best]) / size))
        return out

    def _stands(self, t: int, start: int, words: Words) -> bool:
        low = np.searchsorted(words.place, start)
        here = slice(low, low + len(self.sequences[t]))
        return (np.array_equal(words.place[here], np.arange(start, start + len(self.sequences[t])))
                and np.array_equal(words.token[here], self.sequences[t]))


def strongest(templates: Sequence[Template], hits: list[tuple]) -> list[tuple]:
    """Hits without those that overlap one of another label that holds more; phrases stay, and beat nothing."""
    notices = [h for h in hits if not templates[h[1]].phrase]
    notices.sort(key=lambda h: (h[0], h[2]))
    lost = set()
    open_: list[int] = []
    for i, h in enumerate(notices):
        open_ = [j for j in open_ if notices[j][0] == h[0] and notices[j][2] + notices[j][3] > h[2]]
        for j in open_:
            other = notices[j]
            if templates[other[1]].label != templates[h[1]].label and other[4] != h[4]:
                lost.add(j if other[4] < h[4] else i)
        open_.append(i)
    return sorted([h for h in hits if templates[h[1]].phrase] + [h for i, h in enumerate(notices) if i not in lost])


def found_in(texts: list[str | None], index: Index) -> list[pa.Array]:
    """The columns `n_words` and `hits` of a batch of texts."""
    sizes, hits = index.search(texts)
    hits = strongest(index.templates, hits)
    templates = [index.templates[h[1]] for h in hits]
    columns = [pa.array([t.label for t in templates], pa.string()), pa.array([t.phrase for t in templates], pa.bool_()),
               pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int64()),
               pa.array([h[4] for h in hits], pa.float64())]
    fields = pa.StructArray.from_arrays(columns, ["label", "phrase", "start", "length", "containment"])
    offsets = np.searchsorted(np.array([h[0] for h in hits], dtype=np.int64), np.arange(len(sizes) + 1)).astype(np.int32)
    return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), fields)]


def scan(docs: DataFrame, notices: Sequence[Template] = NOTICES, phrases: Sequence[Template] = PHRASES) -> DataFrame:
    """`docs` with `n_words` and `hits`: label, whether a phrase, start and length in words from 0, containment."""
    templates = (*phrases, *notices)
    index = Index(templates, word_counts(docs, templates))
    plain, names = set_apart(docs, {"text"})
    found = beside_text(plain, lambda texts: found_in(texts, index), f"n_words bigint, hits array<struct<{HIT}>>")
    return put_back(found, names, ("n_words", "hits"))
