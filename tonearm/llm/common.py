"""Helpers of the corpus operators: tables by name, byte-bounded slices, hashes of words and windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Text handled at once by a task, in bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
# Bytes hashed with one table of powers.
_SEGMENT = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
# words of letters and digits: every byte but those of ASCII punctuation, controls and blanks
ALNUM = np.ones(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM[_a:_b + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """How many parts the cluster wants a shuffle to have; it grows with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, by position of use: extra columns and their names don't matter."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def slices(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts have at most ``limit`` bytes together, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        # a worker lives on between tasks: what the batch took goes back to the system
        del batch, sizes, ends
        pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (with the end of the last)."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def find_words(raw: np.ndarray, at: np.ndarray,
               letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run of ``letters`` bytes in one text), and words per text."""
    inside = letters[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = at[:-1][at[:-1] < len(raw)]
    first[begins] = inside[begins]
    stops = at[1:][at[1:] > 0] - 1
    last[stops] = inside[stops]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, at))
    return starts, ends, counts


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (finaliser with xor-shifts and odd multipliers)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(_SEGMENT + 1, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps))
    return _POWERS


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; the same word has the same hash anywhere."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _SEGMENT, "right")))
        if ends[i] - lo > _SEGMENT:
            digest = hashlib.blake2b(raw[lo:ends[i]].tobytes(), digest_size=8).digest()
            out[i] = np.frombuffer(digest, np.uint64)[0]
        else:
            part = _BYTE[raw[lo:ends[j - 1]]]
            part *= up[:len(part)]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=sums[1:])
            a, b = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def hash_windows(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words; runs over the end of a text must be masked."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, seed, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + words[k:k + n]
    return mix(out)


def window_starts(counts: np.ndarray, size: int) -> np.ndarray:
    """Places, among all words of a slice, where a window of ``size`` words of one text starts."""
    first = np.cumsum(counts) - counts
    room = np.maximum(counts - size + 1, 0)
    total = int(room.sum())
    if not total:
        return np.zeros(0, np.int64)
    texts = np.repeat(np.arange(len(counts)), room)
    return np.arange(total) - np.repeat(np.cumsum(room) - room, room) + first[texts]
