"""Passages that repeat across documents, found by fixed-block anchors and removed.

A passage of ``window`` words that two documents share holds, in either of them, one whole block of
``(window + 1) // 2`` words that starts at a multiple of the block's length. So the blocks of all
documents are indexed, every rolling window of a block's length probes them, and only windows of
full length around a hit are compared in full: where their hash occurs in a document of smaller id,
the words are covered, and covered windows in a row extend to the whole exact repeat.

Texts stay where they are. They are written once as chunks (a few hundred documents each, in a
bucketed table, so that later joins by chunk move none of them). A chunk sends its distinct window
hashes, sorted and packed by hash range, and gets back one bit for each. A hash is sent once by a
chunk however often it occurs there, so a passage found in a third of all documents is a row for
each chunk and not one for each document. There are as many ranges as keep about ``RANGE_BYTES`` of text
in each, whatever the size of the corpus. Windows count as equal by 128 bits of two hashes.
"""

from __future__ import annotations

import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm.common import (
    WHITE, find_words, hash_windows, hash_words, shuffle_partitions, slices, text_bytes,
    window_starts,
)
from tonearm.session import shared_folder, written

WINDOW = 13
# Text whose hashes one range holds, about: a word and its blank have some six bytes, a hash has eight.
RANGE_BYTES = 16 << 20
# Bits of a block's hash that are compared, at least, and beyond those that number all words: a chance
# match, one in so many thousand, only costs a comparison in full.
_ANCHOR_BITS, _SPARE_BITS = 40, 12
_LETTERS = ~WHITE
_SENT = "p int, chunk bigint, n int, hashes binary, extra binary"
_MARKS = "chunk bigint, p int, bits binary"


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as differences, byte by byte of all of them, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(),
                       codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int, kind) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(kind).ravel(), dtype=kind)


def _table(columns: dict[str, list], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[name], kind) for name, kind in schema.items()], names=list(schema))


_SENT_KINDS = {"p": pa.int32(), "chunk": pa.int64(), "n": pa.int32(), "hashes": pa.binary(),
               "extra": pa.binary()}
_MARK_KINDS = {"chunk": pa.int64(), "p": pa.int32(), "bits": pa.binary()}


class _Chunk:
    """The documents of a chunk by ascending id, their words and the distinct hashes they send."""

    def __init__(self, blob: bytes, doc_id: str, text: str, window: int, parts: int,
                 anchor_bits: int):
        with pa.ipc.open_stream(blob) as stream:
            self.rows = stream.read_next_batch()
        self.window, self.block, self.parts = window, (window + 1) // 2, parts
        self.anchor_bits = anchor_bits
        ids = self.rows.column(doc_id)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        raw, at = text_bytes(self.rows.column(text))
        starts, ends, self.counts = find_words(raw, at, _LETTERS)
        self.words = hash_words(raw, starts, ends)
        self.first = np.cumsum(self.counts) - self.counts
        # a row without an id neither gives nor loses passages
        self.taking = np.where(ids.is_valid().to_numpy(zero_copy_only=False), self.counts, 0)

    def _starts(self, size: int) -> np.ndarray:
        starts = window_starts(self.counts, size)
        return starts[np.repeat(self.taking, np.maximum(self.counts - size + 1, 0)) > 0]

    def owners(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, starts, "right") - 1

    def _split(self, distinct: np.ndarray, bits: int) -> np.ndarray:
        """Where each hash range begins among the sorted distinct hashes (and where the last ends)."""
        edges = [(p << bits) // self.parts for p in range(1, self.parts)]
        return np.r_[0, np.searchsorted(distinct, np.array(edges, np.uint64)), len(distinct)]

    def anchors(self) -> None:
        self.places = self._starts(self.block)
        hashes = hash_windows(self.words, self.block)[self.places] >> np.uint64(64 - self.anchor_bits)
        self.anchor, first, self.anchor_of = np.unique(
            hashes, return_index=True, return_inverse=True)
        owner = self.owners(self.places)
        self.is_block, self.shared = np.zeros((2, len(self.anchor)), bool)
        self.is_block[self.anchor_of[(self.places - self.first[owner]) % self.block == 0]] = True
        self.shared[self.anchor_of[owner != owner[first][self.anchor_of]]] = True
        self.anchor_edges = self._split(self.anchor, self.anchor_bits)

    def candidates(self, marks: list | None) -> None:
        """Full windows around a hit, from the bits that came back for the anchors."""
        hit = self._marked(marks, self.anchor_edges)
        at = np.zeros(len(self.words) + 1, np.int64)
        at[self.places[hit[self.anchor_of]]] = 1
        before = np.r_[0, np.cumsum(at)]
        starts = self._starts(self.window)
        self.starts = starts[before[starts + self.window - self.block + 1] > before[starts]]
        both = [hash_windows(self.words, self.window, seed)[self.starts] for seed in (1, 2)]
        order = np.lexsort(both[::-1])
        new = np.ones(len(order), bool)
        new[1:] = (both[0][order][1:] != both[0][order][:-1]) | (both[1][order][1:] != both[1][order][:-1])
        self.full_of = np.empty(len(order), np.int64)
        self.full_of[order] = np.cumsum(new) - 1
        # starts go up with the ids, and the order is stable: the first of a group has its least id
        first = order[new]
        self.full, self.more = both[0][first], both[1][first]
        self.least = self.ids[self.owners(self.starts)][first]
        self.full_edges = self._split(self.full, 64)

    def covered(self, marks: list | None) -> np.ndarray:
        """Words covered by a window that a document of smaller id has too."""
        elsewhere = self._marked(marks, self.full_edges)[self.full_of]
        again = elsewhere | (self.ids[self.owners(self.starts)] > self.least[self.full_of])
        steps = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(steps, self.starts[again], 1)
        np.add.at(steps, self.starts[again] + self.window, -1)
        return np.cumsum(steps)[:-1] > 0

    @staticmethod
    def _marked(marks: list | None, edges: np.ndarray) -> np.ndarray:
        out = np.zeros(int(edges[-1]), bool)
        for mark in marks or []:
            a, b = edges[mark["p"]], edges[mark["p"] + 1]
            out[a:b] = np.unpackbits(np.frombuffer(mark["bits"], np.uint8), count=int(b - a))
        return out


def ranges_for(size: int) -> int:
    """How many ranges the hashes of so many bytes of text are dealt to."""
    return max(8, -(-size // RANGE_BYTES))


def _chunks(docs: DataFrame, doc_id: str, text: str, parts: int) -> DataFrame:
    """The rows of ``docs`` in chunks, stored in the shared folder in buckets by chunk.

    Each bucket is one file. Were every task to write its own part of each bucket, files would grow
    with the square of the text, and each costs an executor a process that sets its permissions.
    """

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for part in slices(batches, text):
            part = part.take(pc.array_sort_indices(part.column(doc_id)))
            size = len(text_bytes(part.column(text))[0])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as stream:
                stream.write_batch(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["size", "blob"])

    spark = docs.sparkSession
    name = f"tonearm_chunks_{uuid.uuid4().hex}"
    (docs.mapInArrow(run, "size bigint, blob binary").withColumn("chunk", F.monotonically_increasing_id())
     .repartition(parts, "chunk").write.bucketBy(parts, "chunk").option("path", shared_folder(spark, "chunks")).saveAsTable(name))
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and what has been read of them knows their buckets
    return chunks


def _sent(p: int, chunk: int, hashes: np.ndarray, extra: bytes) -> tuple:
    return p, chunk, len(hashes), _pack(hashes), extra


def _send(rows: list[tuple]):
    if rows:
        yield _table(dict(zip(_SENT_KINDS, zip(*rows))), _SENT_KINDS)


def _answer(decide):
    """One bit for each hash that a chunk sent to a hash range, to the chunks that have any."""

    def run(rows: pa.Table) -> pa.Table:
        sizes = rows["n"].to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        hashes = np.concatenate([_unpack(b, int(n), np.uint64)
                                 for b, n in zip(rows["hashes"].to_pylist(), sizes)])
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        del hashes
        mark = decide(rows["extra"].to_pylist(), sizes, order, starts, ordered)
        out = [(c, p, np.packbits(mark[e - n:e]).tobytes()) for c, p, n, e in zip(
            rows["chunk"].to_pylist(), rows["p"].to_pylist(), sizes, ends) if mark[e - n:e].any()]
        columns = list(zip(*out)) or [[], [], []]
        return pa.Table.from_batches([_table(dict(zip(_MARK_KINDS, columns)), _MARK_KINDS)])

    return run


def _anchored(extra: list[bytes], sizes: np.ndarray, order: np.ndarray,
              starts: np.ndarray, _) -> np.ndarray:
    """Hashes that are a block of one document and occur in another."""
    flags = np.concatenate([np.unpackbits(np.frombuffer(e, np.uint8), count=2 * int(n)).reshape(2, -1)
                            for e, n in zip(extra, sizes)], axis=1).astype(bool)[:, order]
    times = np.diff(np.r_[starts, len(order)])
    hit = np.logical_or.reduceat(flags[0], starts) & (
        (times > 1) | np.logical_or.reduceat(flags[1], starts))
    mark = np.zeros(len(order), bool)
    mark[order] = np.repeat(hit, times)
    return mark


def _both(more: np.ndarray, least: np.ndarray) -> bytes:
    """Second hashes and smallest ids of a chunk's windows."""
    packed = _pack(least.astype(np.int64))
    return len(packed).to_bytes(4, "little") + packed + more.tobytes()


def _earlier(extra: list[bytes], sizes: np.ndarray, order: np.ndarray,
             starts: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Windows that another chunk has in a document of smaller id."""
    cuts = [4 + int.from_bytes(e[:4], "little") for e in extra]
    ids = np.concatenate([_unpack(e[4:c], int(n), np.int64) for e, c, n in zip(extra, cuts, sizes)])
    more = np.concatenate([np.frombuffer(e, np.uint64, offset=c) for e, c in zip(extra, cuts)])
    if (np.diff(np.r_[starts, len(order)]) > 1).any():
        # by the second hash within equal first ones
        again = np.lexsort((more[order], ordered))
        order = order[again]
        starts = np.flatnonzero(np.r_[True, (ordered[1:] != ordered[:-1])
                                      | (more[order][1:] != more[order][:-1])])
    least = np.minimum.reduceat(ids[order], starts)
    mark = np.zeros(len(order), bool)
    mark[order] = np.repeat(least, np.diff(np.r_[starts, len(order)])) < ids[order]
    return mark


def _back(marks: DataFrame, name: str) -> DataFrame:
    """Answers by chunk: at most one for each hash range."""
    return marks.groupBy("chunk").agg(F.collect_list(F.struct("p", "bits")).alias(name))


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``n_words``, ``n_removed`` and ``kept_text``.

    Words are runs of anything but ASCII blanks. A word is removed when it is covered by ``window``
    words in a row that also start in a document of smaller id; all windows are judged on the
    input. ``kept_text`` is what is left, joined by single blanks. Null and empty texts have no
    words and an empty kept text; texts of fewer than ``window`` words keep all. Rows with the same
    id don't take words from each other, and rows without an id are left whole and take none.
    Columns of ``docs`` named like the three new ones give way to them. Ids are integers; a text
    may have up to 2 GB. The chunks lie in the shared folder; the result reads them.
    """
    spark = docs.sparkSession
    new = ("n_words", "n_removed", "kept_text")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in new])
    names = docs.columns
    chunks = _chunks(docs, doc_id, text, shuffle_partitions(spark))
    size = chunks.agg(F.sum("size")).first()[0] or 0
    parts, anchor_bits = ranges_for(size), min(64, max(_ANCHOR_BITS, (size // 6).bit_length() + _SPARE_BITS))

    def load(blob: bytes) -> _Chunk:
        return _Chunk(blob, doc_id, text, window, parts, anchor_bits)

    def probe(batches):
        for batch in batches:
            for key, blob in zip(batch["chunk"].to_pylist(), batch["blob"]):
                chunk = load(blob.as_buffer())
                chunk.anchors()
                edges = chunk.anchor_edges
                yield from _send([
                    _sent(p, key, chunk.anchor[a:b], np.packbits(np.r_[
                        chunk.is_block[a:b], chunk.shared[a:b]]).tobytes())
                    for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a])

    anchors = written(
        chunks.select("chunk", "blob").mapInArrow(probe, _SENT)
        .groupBy("p").applyInArrow(_answer(_anchored), _MARKS), "anchors")
    hit = chunks.join(_back(anchors, "anchors"), "chunk", "left")

    def compare(batches):
        for batch in batches:
            for key, blob, marks in zip(batch["chunk"].to_pylist(), batch["blob"],
                                        batch["anchors"].to_pylist()):
                if not marks:
                    continue
                chunk = load(blob.as_buffer())
                chunk.anchors()
                chunk.candidates(marks)
                edges = chunk.full_edges
                yield from _send([
                    _sent(p, key, chunk.full[a:b], _both(chunk.more[a:b], chunk.least[a:b]))
                    for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a])

    earlier = written(
        hit.select("chunk", "blob", "anchors").mapInArrow(compare, _SENT)
        .groupBy("p").applyInArrow(_answer(_earlier), _MARKS), "earlier")
    both = hit.join(_back(earlier, "earlier"), "chunk", "left")

    def cut(batches):
        for batch in batches:
            for blob, marks, more in zip(batch["blob"], batch["anchors"].to_pylist(),
                                         batch["earlier"].to_pylist()):
                chunk = load(blob.as_buffer())
                gone = np.zeros(len(chunk.words), bool)
                if marks:
                    chunk.anchors()
                    chunk.candidates(marks)
                    gone = chunk.covered(more)
                kept, removed = [], []
                for value, first, n in zip(chunk.rows.column(text).to_pylist(), chunk.first,
                                           chunk.counts):
                    own = gone[first:first + n]
                    words = (value or "").encode().split()
                    removed.append(int(own.sum()))
                    kept.append(b" ".join(compress(words, ~own) if removed[-1] else words))
                yield pa.RecordBatch.from_arrays([
                    *chunk.rows.columns, pa.array(chunk.counts, pa.int64()),
                    pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[*names, *new])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType())])
    return both.select("blob", "anchors", "earlier").mapInArrow(cut, schema)
