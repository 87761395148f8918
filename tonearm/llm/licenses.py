"""License scan: phrases in place, and an exact set-similarity join of text blocks with templates.

A block is a paragraph (lines without an empty one between them). It meets a template when it holds
at least ``CONTAINMENT`` of the template's distinct words. The join orders words by how many blocks of
the whole corpus have them, rarest first, and looks only at blocks that share a word of the prefixes
in which the first common word must lie; length and position then bound the overlap before it is
counted. Templates are a bounded list, so each task has all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import (
    ALNUM, LOWER, find_words, hash_words, plain_columns, slices, text_bytes,
)

CONTAINMENT = 90  # per cent of a template's distinct words

# Phrases whose words must stand in a row, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Sentences of public licenses and notices, by label. A label may have several.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain "
                   "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files, to deal in the Software without "
            "restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
            "or without fee is hereby granted"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under "
                   "the terms of the GNU General Public License as published by the Free Software "
                   "Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
                  "License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words_of(text: str) -> list[str]:
    """Words as the scan sees them: A-Z in lower case, ASCII punctuation and blanks between words."""
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = find_words(raw, np.array([0, len(raw)]), ALNUM)
    return [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)]


def _hash(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = find_words(raw, np.array([0, len(raw)]), ALNUM)
    return hash_words(raw, starts, ends)


@dataclass
class _Slice:
    """Words of some texts and the blocks they stand in."""

    raw: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    owner: np.ndarray
    block: np.ndarray  # of each word, counted over the slice
    first_block: np.ndarray  # of each text

    @classmethod
    def of(cls, column: pa.Array) -> _Slice:
        raw, at = text_bytes(column)
        raw = LOWER[raw]
        starts, ends, counts = find_words(raw, at, ALNUM)
        gap = np.zeros(len(raw) + 1, np.int64)  # blocks begun so far: empty lines and new texts
        gap[1:len(raw)] = (raw[1:] == 10) & (raw[:-1] == 10)
        gap[at[:-1]] = 1
        number = np.cumsum(gap)
        return cls(raw, hash_words(raw, starts, ends), counts,
                   np.repeat(np.arange(len(counts)), counts), number[starts], number[at[:-1]])

    def block_words(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (block, place in the sorted vocabulary), by block and place."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(vocabulary, self.hashes), len(vocabulary) - 1)
        known = vocabulary[place] == self.hashes
        pairs = np.unique(self.block[known] * len(vocabulary) + place[known])
        return pairs // len(vocabulary), pairs % len(vocabulary)


def frequencies(docs: DataFrame, templates=tuple(TEMPLATES)) -> dict[str, int]:
    """Blocks of the whole corpus that have each word of the templates."""
    words = sorted({w for _, t in templates for w in words_of(t)})
    vocabulary = _hash(words)
    order = np.argsort(vocabulary)

    def run(batches):
        total = np.zeros(len(words), np.int64)
        for part in slices(batches, "text"):
            _, place = _Slice.of(part.column("text")).block_words(vocabulary[order])
            total[order] += np.bincount(place, minlength=len(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(words)), pa.int32()), pa.array(total, pa.int64())],
            names=["word", "n"])

    counted = docs.mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}  # a row for each word of the templates
    return {w: found.get(i, 0) for i, w in enumerate(words)}


class Templates:
    """Templates as ranks of their words by corpus frequency, with an index of their prefixes."""

    def __init__(self, templates, counts: dict[str, int], containment: int = CONTAINMENT):
        by_frequency = sorted(counts, key=lambda w: (counts[w], w))
        rank = {w: i for i, w in enumerate(by_frequency)}
        hashes = _hash(by_frequency)
        order = np.argsort(hashes)
        self.vocabulary, self.rank_of = hashes[order], order  # place in the vocabulary -> rank
        self.labels = [label for label, _ in templates]
        self.words = [sorted({rank[w] for w in words_of(t)}) for _, t in templates]
        self.least = [-(-containment * len(own) // 100) for own in self.words]
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for t, (own, least) in enumerate(zip(self.words, self.least)):
            for i, word in enumerate(own[:len(own) - least + 1]):
                self.prefixes.setdefault(word, []).append((t, i))
        self.sets = [set(own) for own in self.words]

    def matches(self, part: _Slice) -> list[tuple[int, int, int]]:
        """Every (block, template, overlap) of a slice that meets the containment."""
        block, place = part.block_words(self.vocabulary)
        if not len(block):
            return []
        rank = self.rank_of[place]
        order = np.lexsort((rank, block))
        block, rank = block[order], rank[order]
        in_prefix = np.isin(rank, list(self.prefixes))
        begins = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        some = np.logical_or.reduceat(in_prefix, begins)
        found = []
        for a, b in zip(begins[some], np.r_[begins[1:], len(block)][some]):
            own = rank[a:b].tolist()
            seen = set()
            for j, word in enumerate(own):
                for t, i in self.prefixes.get(word, ()):
                    least = self.least[t]
                    # length, the block's own prefix, and what can still follow in both
                    if (t in seen or len(own) < least or j > len(own) - least
                            or 1 + min(len(self.words[t]) - i - 1, len(own) - j - 1) < least):
                        continue
                    seen.add(t)
                    overlap = len(self.sets[t].intersection(own))
                    if overlap >= least:
                        found.append((int(block[a]), t, overlap))
        return found


_KINDS = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(),
    "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(),
    "score": pa.float64(),
    "blocks": pa.list_(pa.struct([("block", pa.int32()), ("label", pa.string()),
                                  ("containment", pa.float64())])),
}


def scan_licenses(docs: DataFrame, templates=tuple(TEMPLATES), phrases: dict[str, str] = PHRASES,
                  containment: int = CONTAINMENT, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """One row per row of ``docs``: places of the phrases, labels, and the matching blocks.

    ``n_words, n_base`` (places), ``first_word`` and ``last_word`` (smallest and largest place, or
    null), ``base_labels`` and ``labels`` (sorted, comma-joined), ``score`` (1 with a phrase, else the
    largest containment of a matching block, else 0) and ``blocks`` (block number from 0, label,
    containment). Null text is empty. The texts are read twice: word frequencies, then the join.
    """
    docs = plain_columns(docs, doc_id=doc_id, text=text)
    known = Templates(templates, frequencies(docs, templates), containment)
    wanted = [(label, _hash(words_of(phrase))) for phrase, label in phrases.items()]

    def run(batches):
        for batch in slices(batches, "text"):
            part = _Slice.of(batch.column("text"))
            n = len(part.counts)
            first = np.cumsum(part.counts) - part.counts
            base: list[set] = [set() for _ in range(n)]
            places: list[list[int]] = [[] for _ in range(n)]
            for label, words in wanted:
                room = len(part.hashes) - len(words) + 1
                hit = np.ones(max(room, 0), bool)
                for k, word in enumerate(words):
                    hit &= part.hashes[k:k + len(hit)] == word
                for at in np.flatnonzero(hit):
                    own = part.owner[at]
                    if part.owner[at + len(words) - 1] == own:
                        base[own].add(label)
                        places[own].append(int(at - first[own]))
            blocks: list[list] = [[] for _ in range(n)]
            for block, t, overlap in known.matches(part):
                own = int(np.searchsorted(part.first_block, block, "right")) - 1
                blocks[own].append({"block": block - int(part.first_block[own]),
                                    "label": known.labels[t],
                                    "containment": overlap / len(known.words[t])})
            labels = [base[i] | {b["label"] for b in blocks[i]} for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((
                batch.column("doc_id").to_pylist(), part.counts, [len(p) for p in places],
                [min(p, default=None) for p in places], [max(p, default=None) for p in places],
                [",".join(sorted(b)) for b in base], [",".join(sorted(own)) for own in labels],
                [1.0 if places[i] else max((b["containment"] for b in blocks[i]), default=0.0)
                 for i in range(n)], blocks), _KINDS.values())], names=list(_KINDS))

    return docs.mapInArrow(
        run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
             "base_labels string, labels string, score double, "
             "blocks array<struct<block:int,label:string,containment:double>>")


def oracle_sql() -> str:
    """The same scan as DuckDB SQL over ``documents``, without any filter."""
    letters, capitals = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    starts = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        starts.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {test}), "
                      f"lambda i: {{'label': '{label}', 'at': i - 1}})")
    rows = ", ".join(
        f"({i}, '{label}', [{', '.join(repr(w) for w in sorted(set(words_of(t))))}])"
        for i, (label, t) in enumerate(TEMPLATES))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
    translate(coalesce(text, ''), '{capitals}', '{letters}') AS t FROM documents),
words AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{word}') AS w FROM docs),
base AS (SELECT rid, list_concat({starts[0]}, list_concat({starts[1]}, {starts[2]})) AS found FROM words),
templates(id, label, own) AS (VALUES {rows}),
blocks AS (SELECT rid, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10) || chr(10))),
    '{word}')) AS own FROM docs),
hits AS (SELECT rid, label, len(list_intersect(b.own, t.own)) / len(t.own)::DOUBLE AS share
    FROM blocks b, templates t
    WHERE 100 * len(list_intersect(b.own, t.own)) >= {CONTAINMENT} * len(t.own)),
best AS (SELECT rid, list(label) AS found, max(share) AS share FROM hits GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(base.found) AS n_base,
    list_min(list_transform(base.found, lambda x: x.at)) AS first_word,
    list_max(list_transform(base.found, lambda x: x.at)) AS last_word,
    array_to_string(list_sort(list_distinct(list_transform(base.found, lambda x: x.label))), ',')
        AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(
        list_transform(base.found, lambda x: x.label), coalesce(best.found, [])))), ',') AS labels,
    CASE WHEN len(base.found) > 0 THEN 1.0 ELSE coalesce(best.share, 0) END::DOUBLE AS score
FROM words JOIN base USING (rid) LEFT JOIN best USING (rid)"""
