"""License scans: phrases, and an exact set-similarity join of text blocks with notice templates.

A template is a set of words; a text block contains it if it holds at least ``ceil(threshold * size)``
of them. Template words are put in one global order, by how often they occur in all texts (rare ones
first, counted by a job of its own). A block that reaches the threshold must share a word with the
first ``size - least + 1`` words of the template and with the first ``words - least + 1`` of its own
template words (prefix filter), hold at least ``least`` of them (length filter), and have enough words
left after the first shared one on both sides (positional filter). What passes is verified.

Blocks are windows of 16, 32, 64, ... words that begin at every half window; a template of n words is
compared with windows of the smallest size from 2 n, so any of its occurrences lies in one of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, arrow_map, byte_rows, hash_word, id_and_text, word_hashes

#: Phrases that name a licence and its label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Well-known licence notices and their label.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


#: Words that tell licences apart. A block names a template's licence only if it holds those of them that the template has.
MARKS = ("mit", "apache", "nc", "noncommercial", "cc", "commons", "gnu", "mozilla", "unencumbered")


class _Notices:
    """Templates and phrases over a vocabulary of word hashes, in a global order."""

    def __init__(self, templates: Mapping[str, str], phrases: Mapping[str, str], threshold: float, counts: Mapping[int, int]):
        words = sorted({w for t in (*templates, *phrases) for w in t.split()})
        hashes = np.array([hash_word(w, ALNUM) for w in words], np.uint64)
        by_count = sorted(range(len(words)), key=lambda i: (counts.get(int(hashes[i].view(np.int64)), 0), words[i]))
        rank = {words[i]: r for r, i in enumerate(by_count)}
        self.sorted = np.sort(hashes)
        where = {int(h): rank[w] for h, w in zip(hashes, words)}
        self.rank = np.array([where[int(h)] for h in self.sorted], np.int64)
        self.phrases = [([rank[w] for w in p.split()], label) for p, label in phrases.items()]
        self.templates = []
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, label in templates.items():
            own = sorted({rank[w] for w in t.split()})
            least = -(-int(round(threshold * 1000)) * len(own) // 1000)
            window = 16
            while window < 2 * len(t.split()):
                window *= 2
            for i in range(len(own) - least + 1):
                self.prefix[window][own[i]].append((len(self.templates), i))
            self.templates.append((own, least, label))
        self.marks = [{rank[w] for w in t.split() if w in MARKS} for t in templates]

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """The rank of every word, -1 for words of no template or phrase."""
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.rank[at], -1)

    def base(self, ranks: np.ndarray) -> list[tuple[int, str]]:
        out = []
        for phrase, label in self.phrases:
            n = len(ranks) - len(phrase) + 1
            if n > 0:
                at = np.flatnonzero(ranks[:n] == phrase[0])
                for i, r in enumerate(phrase[1:], 1):
                    at = at[ranks[at + i] == r]
                out += [(int(i), label) for i in at]
        return out

    def named(self, ranks: np.ndarray, blocks: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """The blocks that name their template's licence: they hold its telling words, and no overlapping block
        names a template that has all words of this one and more."""
        held = [x for x in blocks if self.marks[x[2]] <= set(ranks[x[0]:x[0] + x[1]].tolist())]
        larger = lambda a, b: set(self.templates[a[2]][0]) > set(self.templates[b[2]][0])
        return [x for x in held if not any(larger(y, x) and y[0] < x[0] + x[1] and x[0] < y[0] + y[1] for y in held)]

    def blocks(self, ranks: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(first word, words, template, containment) of every block that contains a template."""
        out = []
        for window, prefix in self.prefix.items():
            half = window // 2
            rare = np.flatnonzero(np.isin(ranks, list(prefix)))
            for b in sorted({x for x in (*(rare // half), *(rare // half - 1)) if x >= 0}):
                own = np.unique(ranks[b * half:b * half + window])
                own = own[own >= 0].tolist()
                place = {r: j for j, r in enumerate(own)}
                met: dict[int, tuple[int, int]] = {}
                for j, r in enumerate(own):
                    for t, i in prefix.get(r, ()):
                        met.setdefault(t, (i, j))
                for t, (i, j) in met.items():
                    words, least, _ = self.templates[t]
                    if len(own) < least or j > len(own) - least or min(len(words) - i, len(own) - j) < least:
                        continue
                    both = sum(r in place for r in words)
                    if both >= least:
                        out.append((b * half, min(window, len(ranks) - b * half), t, both / len(words)))
        return out


def word_frequencies(docs: DataFrame, words: Sequence[str], text_col: str = "text") -> dict[int, int]:
    """How often each of ``words`` occurs in all texts, by hash (as a signed long)."""
    known = np.sort(np.array([hash_word(w, ALNUM) for w in words], np.uint64))

    def run(batches):
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for text in byte_rows(batch.column("text")):
                h = word_hashes(text, ALNUM)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                total += np.bincount(at[known[at] == h], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], names=["word", "n"])

    texts = docs.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    rows = arrow_map(texts, run, "word long, n long")
    return {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
         threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    blocks (first word, words, label, containment).

    ``n_base`` counts the places of all phrases, first/last_word are the smallest and largest word they
    start at (null if none). ``blocks`` are all that reach the threshold; ``labels`` are those of phrases
    and of blocks that name a licence: they hold the template's telling words (``MARKS``), and no larger
    template is named there. ``score`` is 1 with a phrase, else the highest containment of a block that
    names one, 0 if none. Null and empty texts have no words;
    null ids are kept; an empty table gives no rows.
    """
    vocabulary = sorted({w for t in (*templates, *phrases) for w in t.split()})
    counts = word_frequencies(docs, vocabulary, text_col)

    def run(batches):
        notices = _Notices(templates, phrases, threshold, counts)
        for batch in batches:
            rows = []
            for text in byte_rows(batch.column("text")):
                ranks = notices.ranks(word_hashes(text, ALNUM))
                base, blocks = notices.base(ranks), notices.blocks(ranks)
                named = {label for _, label in base}
                found = [(b, n, notices.templates[t][2], c) for b, n, t, c in blocks]
                sure = [(notices.templates[t][2], c) for _, _, t, c in notices.named(ranks, blocks)]
                rows.append({
                    "n_words": len(ranks), "n_base": len(base), "first_word": min((i for i, _ in base), default=None),
                    "last_word": max((i for i, _ in base), default=None), "base_labels": ",".join(sorted(named)),
                    "labels": ",".join(sorted(named | {label for label, _ in sure})),
                    "score": 1.0 if base else max((c for _, c in sure), default=0.0),
                    "blocks": [{"first_word": b, "words": n, "label": label, "containment": c} for b, n, label, c in found]})
            made = pa.RecordBatch.from_pylist(rows, schema=_ROWS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made.columns], names=["doc_id", *made.schema.names])

    return arrow_map(id_and_text(docs, id_col, text_col), run,
                     "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                     "labels string, score double, blocks array<struct<first_word: long, words: long, label: string, containment: double>>")


_ROWS = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("blocks", pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])))])
