"""Vectors as one byte for each part: codebooks refined in rounds, nearest entries by Orchard search.

Every entry of a codebook keeps the other entries in order of their distance to it. The search for a
part starts at some entry, walks along that entry's list, and jumps to the list of whatever
lies nearer; entries are marked when they have been compared. An entry farther from the present one
than twice the part's distance to it cannot be nearer, and the list is in order, so the search ends
there. It is run for a batch of parts in step. All arithmetic is on whole numbers, so that results depend on
neither the order of rows nor the number of tasks.

Codebooks are small (entries x width numbers) and go to every task; a round brings back one
sum for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Whole numbers within this bound are handled as 64-bit integers, others as numbers of any size.
_NARROW = 2**24
# Sums travel in digits to this base, so that no magnitude overflows a long.
_BASE = 2**40
# Parts searched in step.
_BATCH = 4096


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` exactly: 64-bit integers, or Python integers where those might overflow."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if np.isfinite(scaled).all() and (np.abs(scaled) <= _NARROW).all():
        return scaled.astype(np.int64)
    exact = np.empty(vectors.shape, object)
    for place, x in np.ndenumerate(vectors):
        top, bottom = float(x).as_integer_ratio()
        exact[place] = top * scale // bottom
    return exact


class Codebook:
    """Entries of one part position and, for each of them, all others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = np.stack([((entries - e) ** 2).sum(axis=1) for e in entries])
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        # where a search begins: the entry nearest in the coordinate that tells entries apart best
        spread = entries.max(axis=0) - entries.min(axis=0)
        self.axis = int(np.argmax(spread))
        self.by_axis = np.argsort(entries[:, self.axis], kind="stable")

    def _distance(self, points: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((points - self.entries[entry]) ** 2).sum(axis=1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each point (the lower of equals), squared distance, comparisons made."""
        n, size = len(points), len(self.entries)
        ranks = np.searchsorted(self.entries[self.by_axis, self.axis], points[:, self.axis])
        now = self.by_axis[np.minimum(ranks, size - 1)]
        least = self._distance(points, now)
        seen = np.zeros((n, size), bool)
        seen[np.arange(n), now] = True
        at = np.zeros(n, np.int64)
        open_ = np.arange(n)
        made = n
        while len(open_):
            entry, place = now[open_], at[open_]
            going = place < size
            place = np.minimum(place, size - 1)
            # beyond twice the distance (four times its square) nothing can be nearer or as near
            going &= self.apart[entry, place] <= 4 * least[open_]
            open_, other = open_[going], self.order[entry, place][going]
            at[open_] += 1
            fresh = ~seen[open_, other]
            rows, other = open_[fresh], other[fresh]
            seen[rows, other] = True
            made += len(rows)
            d = self._distance(points[rows], other)
            better = (d < least[rows]) | ((d == least[rows]) & (other < now[rows]))
            rows, other = rows[better], other[better]
            now[rows], least[rows], at[rows] = other, d[better], 0
        return now, least, made


def _usable(vectors: DataFrame, vec_id: str, vector: str, label: str | None) -> DataFrame:
    x = F.col("x")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("x"),
                          *([F.col(label).alias("label")] if label else []))
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return rows.where(x.isNotNull() & (F.size(x) > 0) & finite)


def _batches(batch: pa.RecordBatch, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    for a in range(0, batch.num_rows, _BATCH):
        part = batch.slice(a, _BATCH)
        flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
        yield slice(a, a + part.num_rows), whole_numbers(flat.reshape(-1, width))


def _edges(width: int, parts: int) -> list[tuple[int, int]]:
    cuts = [p * width // parts for p in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def _assign(books: list[Codebook], edges: list[tuple[int, int]], rows: np.ndarray):
    found = [book.nearest(rows[:, a:b])[:2] for book, (a, b) in zip(books, edges)]
    return [f[0] for f in found], [f[1] for f in found]


_SUMS = "part int, entry int, digit int, n bigint, sums array<bigint>"


def _digits(total: list[int]) -> list[list[int]]:
    """The numbers in digits to the base, each with its number's sign; at least one digit."""
    signs, rest, out = [-1 if t < 0 else 1 for t in total], [abs(t) for t in total], []
    while not out or any(rest):
        out.append([s * (r % _BASE) for s, r in zip(signs, rest)])
        rest = [r // _BASE for r in rest]
    return out


def _refine(rows: DataFrame, books: list[np.ndarray], edges: list[tuple[int, int]]) -> list[np.ndarray]:
    """One round: every part to its nearest entry, every used entry to the floor of its parts' mean."""
    width = edges[-1][1]

    def sums(batches):
        own = [Codebook(b) for b in books]
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            for _, ints in _batches(batch, width):
                for p, (entries, (a, b)) in enumerate(zip(_assign(own, edges, ints)[0], edges)):
                    for e in np.unique(entries):
                        at = entries == e
                        total = totals.setdefault((p, int(e)), [0, [0] * (b - a)])
                        total[0] += int(at.sum())
                        total[1] = [t + int(s) for t, s in zip(total[1], ints[at, a:b].sum(axis=0))]
        out = [(p, e, d, n if d == 0 else 0, digit) for (p, e), (n, total) in totals.items()
               for d, digit in enumerate(_digits(total))]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (
                    pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                names=["part", "entry", "digit", "n", "sums"])

    most = max(b - a for a, b in edges)
    found = rows.select("x").mapInArrow(sums, _SUMS).groupBy("part", "entry", "digit").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(most)]).alias("sums"))
    totals: dict[tuple[int, int], list] = {}
    for r in found.collect():  # a row for each entry and digit
        a, b = edges[r.part]
        total = totals.setdefault((r.part, r.entry), [0, [0] * (b - a)])
        total[0] += r.n
        total[1] = [t + s * _BASE**r.digit for t, s in zip(total[1], r.sums[:b - a])]
    out = [book.astype(object) for book in books]
    for (p, e), (n, total) in totals.items():
        out[p][e] = [t // n for t in total]
    return [_narrow(book) for book in out]


def _narrow(book: np.ndarray) -> np.ndarray:
    small = all(abs(x) <= _NARROW for x in book.ravel())
    return book.astype(np.int64) if small else book


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
                    rounds: int = ROUNDS, vec_id: str = "vec_id",
                    vector: str = "embedding") -> list[np.ndarray]:
    """The codebook of every part position after ``rounds``; empty if there are no vectors.

    They start as the parts of the ``entries`` smallest ids.
    """
    rows = _usable(vectors, vec_id, vector, None)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    if not first:
        return []
    width = len(first[0].x)
    edges = _edges(width, parts)
    ints = whole_numbers(np.array([r.x for r in first if len(r.x) == width]))
    books = [ints[:, a:b] for a, b in edges]
    same = rows.where(F.size("x") == width)
    for _ in range(rounds):
        books = _refine(same, books, edges)
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, between commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def decode(code: str, books: list[np.ndarray], scale: int = SCALE) -> list[float]:
    """The vector that a code stands for."""
    return [int(x) / scale for p, book in enumerate(books)
            for x in book[int(code[2 * p:2 * p + 2], 16)]]


def compress_vectors(vectors: DataFrame, books: list[np.ndarray], vec_id: str = "vec_id",
                     vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """``(vec_id, code, error)`` of each usable vector, with ``label`` if named.

    Components become ``floor(1024 * x)``; ``code`` has two hex digits for the nearest entry of each
    part (squared Euclidean distance, the lower index of equals), ``error`` is the sum of these distances.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do those of
    another length than the vector of the smallest id. A length that parts don't divide gives parts
    whose lengths differ by one. With fewer vectors than entries the codebooks are that much shorter.
    Repeated rows and ids count and are coded row by row; null ids come last. Numbers of any size are
    exact; an error beyond a long is null. An empty table has no codes. Other columns are not read.
    """
    width = sum(b.shape[1] for b in books)
    edges = _edges(width, len(books)) if books else []
    rows = _usable(vectors, vec_id, vector, label).where(F.size("x") == width)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "x")

    def run(batches):
        own = [Codebook(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = [], []
            for _, ints in _batches(batch, width):
                entries, apart = _assign(own, edges, ints)
                codes += ["".join(f"{e:02x}" for e in row) for row in np.stack(entries, axis=1).tolist()]
                errors += [s if s < 2**63 else None for s in map(int, sum(apart))]
            kept = [n for n in batch.schema.names if n != "x"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(codes, pa.string()),
                 pa.array(errors, pa.int64())], names=[*kept, "code", "error"])

    return rows.mapInArrow(run, f"{kinds}, code string, error bigint")


def with_label_error(codes: DataFrame) -> DataFrame:
    """``label_error``: the error summed over rows of the same label, those without one together.

    Null if the sum is beyond a long. Sums are taken before anything moves, so a frequent label is no
    burden; Spark broadcasts them if they are few.
    """
    total = codes.groupBy("label").agg(
        F.expr("try_cast(sum(cast(error AS decimal(38, 0))) AS bigint)").alias("label_error"))
    total = total.withColumnRenamed("label", "of")
    return codes.join(total, F.col("label").eqNullSafe(F.col("of"))).drop("of")
