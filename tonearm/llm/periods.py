"""Stretches of text that repeat with a period, found as runs of words.

A run is a stretch of words with smallest period q, at least ``least_exponent`` periods long, that no
neighbouring word extends. A suffix automaton of the words knows all their repeats: the path from a
prefix's state up the suffix links holds every suffix of the prefix. Each appended word colours that
path with its place, by the access operation of a link-cut tree over the links, and on the way
meets the path segments that earlier words left behind. A segment coloured by place e whose deepest
state holds suffixes of length l says that the last l words also end at e; if i - e <= l, they make
a square of period i - e, and squares of the same period and start, one word after the other, are a run.

Most text repeats nothing nearby. Automata are built only for stretches in which every three
words in a row recur at a distance that a run of that length allows; the rest has no runs.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.common import (
    WHITE, find_words, hash_windows, hash_words, mix, slices, text_bytes, window_starts,
)

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
_LETTERS = ~WHITE
# Passes of the filter over what is left; it only spares work.
_PASSES = 12
_RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType())
                                  for n in ("start", "length", "period")]))
_RUN_KIND = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


class SuffixAutomaton:
    """States of all distinct stretches of a sequence: lengths, suffix links, state of each prefix."""

    def __init__(self, words: list[int]):
        # most states have one way on: it is kept in arrays, further ones in a dictionary
        word, to, more = array("i", [-1]), array("i", [-1]), {}
        link, length, prefixes = array("i", [-1]), array("i", [0]), array("i")
        last = 0
        for c in words:
            state = len(link)
            word.append(-1)
            to.append(-1)
            link.append(0)
            length.append(length[last] + 1)
            p, q = last, -1
            while p >= 0:
                if word[p] == c:
                    q = to[p]
                    break
                if word[p] < 0:
                    word[p], to[p] = c, state
                else:
                    ways = more.setdefault(p, {})
                    if c in ways:
                        q = ways[c]
                        break
                    ways[c] = state
                p = link[p]
            if q >= 0:
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    clone = len(link)
                    word.append(word[q])
                    to.append(to[q])
                    if q in more:
                        more[clone] = dict(more[q])
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[state] = clone
                    while p >= 0:
                        if word[p] == c:
                            if to[p] != q:
                                break
                            to[p] = clone
                        else:
                            ways = more.get(p)
                            if ways is None or ways.get(c) != q:
                                break
                            ways[c] = clone
                        p = link[p]
            prefixes.append(state)
            last = state
        self.link, self.length, self.prefixes = link, length, prefixes


class ColouredPaths:
    """Link-cut tree over a rooted tree whose only operation is access with a colour.

    Preferred paths are splay trees ordered by depth. All nodes of one were last reached by the same
    access, so the colour stands at the root of its splay tree.
    """

    def __init__(self, parent: array):
        n = len(parent)
        self.up = array("i", parent)
        self.left = array("i", [-1]) * n
        self.right = array("i", [-1]) * n
        self.colour = array("i", [-1]) * n

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        if p < 0 or (left[p] != x and right[p] != x):
            return
        while True:
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):  # same side: first the parent
                self._rotate(p)
                self._rotate(x)
            elif inner:
                self._rotate(x)
                self._rotate(x)
            else:
                self._rotate(x)
                self.colour[x] = self.colour[p]
                return
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                self.colour[x] = self.colour[g]
                return

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = right[x]
            left[p] = b
            right[x] = p
        else:
            b = left[x]
            right[p] = b
            left[x] = p
        if b >= 0:
            up[b] = p
        up[p] = x
        up[x] = g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Colours the path from ``x`` to the root; the former segments as (deepest node, colour)."""
        met, below = [], -1
        up, right, colours, splay = self.up, self.right, self.colour, self._splay
        while x >= 0:
            splay(x)
            met.append((x, colours[x]))
            cut = right[x]
            if cut >= 0:
                colours[cut] = colours[x]
            right[x] = below
            below = x
            x = up[x]
        colours[below] = colour
        return met


def runs_of(words: list[int], least_length: int = LEAST_LENGTH,
            least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run, by start and period."""
    automaton = SuffixAutomaton(words)
    paths, length = ColouredPaths(automaton.link), automaton.length
    ends: dict[tuple[int, int], int] = {}
    for i, state in enumerate(automaton.prefixes):
        for node, end in paths.access(state, i):
            if end >= 0 and length[node] >= (least_exponent - 1) * (i - end):
                # the last length[node] words also end at `end`: a run so far, up to word i
                ends[end - length[node] + 1, i - end] = i
    return sorted((start, i - start + 1, q) for (start, q), i in ends.items()
                  if i - start + 1 >= least_length)


def periodic_stretches(words: np.ndarray, counts: np.ndarray, least_length: int,
                       least_exponent: int) -> list[tuple[int, int]]:
    """Begin and end, among all words of a slice, of the stretches that may hold runs.

    In a run of length l and period q <= l / exponent each group of words recurs within q words, so a
    stretch whose groups recur only farther away than its length over the exponent has none.
    """
    # a run of fewer than three periods may hold three words in a row that do not recur in it
    size = 3 if least_exponent >= 3 and least_length >= 4 else 1
    starts = window_starts(counts, size)
    owner = np.searchsorted(np.cumsum(counts), starts, "right").astype(np.uint64)
    keys = hash_windows(words, size)[starts] + mix(owner + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    apart = np.where(same, np.diff(starts[order]), np.iinfo(np.int64).max)
    near = np.full(len(starts), np.iinfo(np.int64).max)
    near[order[1:]] = apart
    near[order[:-1]] = np.minimum(near[order[:-1]], apart)
    alive = near < np.iinfo(np.int64).max
    first = last = np.zeros(0, np.int64)
    for _ in range(_PASSES):
        starts, near = starts[alive], near[alive]
        if not len(starts):
            return []
        breaks = np.flatnonzero(np.diff(starts) > 1) + 1
        first, last = np.r_[0, breaks], np.r_[breaks, len(starts)]
        long = starts[last - 1] - starts[first] + size
        room = np.repeat(long, last - first)
        alive = (near * least_exponent <= room) & (room >= least_length)
        if alive.all():
            break
    return list(zip(starts[first].tolist(), (starts[last - 1] + size).tolist()))


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH,
                  least_exponent: int = LEAST_EXPONENT, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``n_words``, ``runs`` and ``collapsed_text``.

    Words are runs of anything but ASCII blanks, numbered from 0. ``runs`` holds ``start``, ``length``
    and ``period`` of each stretch of words with smallest period q and a length of at least
    ``least_length`` and ``least_exponent`` (2 or more) times q that no neighbouring word extends, by
    start and period. ``collapsed_text`` is the words that no run contains after its first q words,
    joined by single blanks.

    Null and empty texts have no words, no runs and an empty collapsed text. Rows are judged one by
    one, so repeated rows and ids, nulls in other columns and further columns change nothing; columns
    named like the three new ones give way to them. A text may have up to 2 GB; a long stretch of
    periodic words takes about 100 bytes for each of its words.
    """
    if least_exponent < 2:
        raise ValueError("least_exponent must be 2 or more")
    new = ("n_words", "runs", "collapsed_text")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in new])
    names = [*docs.columns, *new]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), text):
                raw, at = text_bytes(part.column(text))
                starts, ends, counts = find_words(raw, at, _LETTERS)
                words = hash_words(raw, starts, ends)
                stops = np.cumsum(counts)
                runs: list[list] = [[] for _ in counts]
                gone = np.zeros(len(words) + 1, np.int64)
                for a, b in periodic_stretches(words, counts, least_length, least_exponent):
                    row = int(np.searchsorted(stops, a, "right"))
                    base = int(stops[row] - counts[row])
                    ids = np.unique(words[a:b], return_inverse=True)[1].tolist()
                    for start, length, period in runs_of(ids, least_length, least_exponent):
                        runs[row].append((a - base + start, length, period))
                        gone[a + start + period] += 1
                        gone[a + start + length] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                texts = []
                for value, n, stop, own in zip(part.column(text).to_pylist(), counts, stops, runs):
                    own.sort(key=lambda r: (r[0], r[2]))
                    kept = (value or "").encode().split()
                    texts.append(b" ".join(compress(kept, ~gone[stop - n:stop]) if own else kept))
                columns = [part.column(c) for c in names[:-3]]
                yield pa.RecordBatch.from_arrays([
                    *columns, pa.array(counts, pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in own]
                              for own in runs], _RUN_KIND),
                    pa.array(texts, pa.binary()).cast(pa.string())], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("runs", _RUNS), T.StructField("collapsed_text", T.StringType())])
    return docs.mapInArrow(find, schema)


def with_echoes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, in every tenth of which (by a hash of the id) the words from some place on repeat.

    With h = crc32 of the decimal id, g = h // 10 and n words, h % 10 = 0 makes each word i >= a word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8). Words are then joined by
    single blanks. Rows without an id or without words stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # explode() of one array: a column of its own, where a projection could be computed for each word
    split = docs.select(F.struct("*").alias("row"), F.floor(h / 10).alias("g"), F.explode(
        F.array(F.when(h % 10 == 0, words))).alias("words")).withColumn("n", F.size("words"))
    n = F.greatest(F.col("n"), F.lit(1))
    placed = split.withColumn("a", F.pmod(F.col("g"), n).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    said = F.array_join(F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(F.col("words"), F.when(i < F.col("a"), i).otherwise(
            F.col("a") + F.pmod(i - F.col("a"), F.col("p"))))), " ")
    told = F.when(F.col("n") > 0, said).otherwise(F.col(f"row.`{text}`"))
    return placed.select("row", told.alias("said")).select(*[
        F.col("said").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
