"""Best-fit packing of tokenised documents into sequences by linear grouping.

Lengths are integers of at most ``limit``, so everything that decides how pieces are combined is a
histogram of at most ``limit`` counts. Large lengths are rounded up to the largest of their group
(groups of equal cardinality), a linear program over the few rounded sizes chooses configurations,
real lengths are substituted for the rounded ones, and the rest is placed best-fit into the room
left. The plan says, for runs of pieces of one length, which run of sequences holds them and where;
Spark ranks the pieces of each length and looks the places up.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.common import plain_columns, slices
from tonearm.session import written

LIMIT = 1024
END_ID = 2
# Pieces of at least this share of a sequence are large: each is tried and the best plan taken.
LARGE_SHARES = (1 / 4, 1 / 3, 1 / 2)
# Groups that large lengths are rounded up in.
GROUPS = 48
# Pieces ranked by one task for each length.
RANKED_TOGETHER = 200_000
# Characters given to the tokenizer at once; cuts only where a token must begin.
_CHARS = 100_000
_CUT = re.compile(r"(?<=\w) (?=\w)")
# Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_encoder(path: str):
    """The byte-level BPE of a tokenizers JSON file, run by tiktoken: same ids, a third of the time.

    Byte-level vocabularies spell bytes as printable characters; ids of such files are merge ranks.
    Strings of special tokens in a text are ordinary text.
    """
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in printable}
    spelled |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    ranks = {bytes(spelled[c] for c in token): i for token, i in vocabulary.items()
             if all(c in spelled for c in token) and not re.fullmatch(r"<\|.*\|>", token)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(encoder, text: str) -> np.ndarray:
    """Ids of a whole text, in parts that begin where a token must begin anyway."""
    if len(text) <= _CHARS:
        return np.array(encoder.encode_ordinary(text), np.uint32)
    ids, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + _CHARS)
        to = cut.start() if cut else len(text)
        ids.append(np.array(encoder.encode_ordinary(text[at:to]), np.uint32))
        at = to
    return np.concatenate(ids)


def tokenise(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID,
             ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``.

    Each row is a document of its own, repeated or not; null text counts as empty, and an empty
    document is the closing id alone. Documents of over ``limit`` ids are cut so that only the
    first piece may be shorter.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    if ids:
        schema, names, kinds = schema + ", ids array<int>", [*names, "ids"], [
            *kinds, pa.list_(pa.int32())]

    def run(batches):
        encoder = load_encoder(tokenizer)
        for part in slices(batches, "text"):
            rows = [[] for _ in names]
            for key, value in zip(part.column("doc_id").to_pylist(),
                                  part.column("text").to_pylist()):
                all_ids = np.append(encode(encoder, value or ""), np.uint32(end_id)).astype("<u4")
                edges = [0, *range((len(all_ids) - 1) % limit + 1, len(all_ids) + 1, limit)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    own = all_ids[a:b]
                    found = (key, k, a, b - a, zlib.crc32(own.tobytes()), own.astype(np.int32))
                    for column, x in zip(rows, found):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(rows, kinds)], names=names)

    return plain_columns(docs, doc_id=doc_id, text=text).mapInArrow(run, schema)


def _best_pattern(values: np.ndarray, sizes: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits (knapsack with repetition)."""
    best, taken = np.zeros(limit + 1), np.full(limit + 1, -1)
    least = int(sizes.min())
    for room in range(least, limit + 1):
        best[room], taken[room] = best[room - 1], -1
        fits = sizes <= room
        worth = np.where(fits, best[np.where(fits, room - sizes, 0)] + values, -1.0)
        k = int(worth.argmax())
        if worth[k] > best[room] + 1e-12:
            best[room], taken[room] = worth[k], k
    pattern, room = np.zeros(len(sizes), np.int64), limit
    while room >= least:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return float(best[limit]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray,
                   limit: int, steps: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Patterns of sizes and how often to use each: linear program by column generation, rounded
    down; what rounding leaves over is not covered."""
    k = len(sizes)
    basis = np.diag(limit // sizes).astype(float)
    for _ in range(steps):
        inverse = np.linalg.inv(basis)
        used = inverse @ demand
        worth, pattern = _best_pattern(np.maximum(inverse.sum(axis=0), 0), sizes, limit)
        if worth <= 1 + 1e-7:
            break
        enter = inverse @ pattern
        ratio = np.where(enter > 1e-9, used / np.where(enter > 1e-9, enter, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    used = np.linalg.solve(basis, demand)
    return [(basis[:, i].astype(np.int64), int(n)) for i, n in
            enumerate(np.floor(used + 1e-6)) if n >= 1 and k]


def plan(histogram: dict[int, int], limit: int = LIMIT, groups: int = GROUPS,
         shares: tuple[float, ...] = LARGE_SHARES) -> list[tuple[int, int, int, int, int]]:
    """Places for all pieces: ``(length, first rank, pieces, first sequence, offset)``.

    Piece number ``first rank + i`` among those of its length goes to sequence
    ``first sequence + i`` at ``offset``. The number of entries depends on ``limit`` and
    ``groups``, not on how many pieces there are. Of the plans for each share, the one with the
    fewest sequences is taken, the first of equals.
    """
    plans = [_plan(histogram, limit, groups, share) for share in shares]
    return min(plans, key=_sequences)


def _sequences(places: list[tuple[int, int, int, int, int]]) -> int:
    return sum(n for _, _, n, _, offset in places if offset == 0)


def _plan(histogram: dict[int, int], limit: int, groups: int,
          large_share: float) -> list[tuple[int, int, int, int, int]]:
    left = {int(n): int(c) for n, c in histogram.items() if c > 0}
    taken: dict[int, int] = defaultdict(int)
    places: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    # runs of equal sequences with room: room -> heap of (first sequence, how many)
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(length: int, n: int, first: int, room: int) -> None:
        places.append((length, taken[length], n, first, limit - room))
        taken[length] += n
        left[length] -= n
        if room > length:
            heapq.heappush(rooms[room - length], (first, n))

    large = sorted((n for n in left if n >= limit * large_share and n < limit), reverse=True)
    total = sum(left[n] for n in large)
    members: dict[int, list[int]] = {}
    if total:
        # equal-cardinality groups from the largest down; a group is named by its largest length
        share, seen, head, group = total / groups, 0, 0, -1
        for n in large:
            if int(seen / share) != group:
                group, head = int(seen / share), n
            members.setdefault(head, []).append(n)
            seen += left[n]
        sizes = np.array(sorted(members, reverse=True))
        demand = np.array([sum(left[n] for n in members[s]) for s in sizes], float)
        for pattern, times in configurations(sizes, demand, limit):
            runs = [(sequences, times, limit)]  # first sequence, how many, room
            sequences += times
            for k in np.flatnonzero(pattern):
                for _ in range(int(pattern[k])):
                    after = []
                    for first, n, room in runs:
                        for own in members[int(sizes[k])]:
                            use = min(n, left[own])
                            if use:
                                places.append((own, taken[own], use, first, limit - room))
                                taken[own] += use
                                left[own] -= use
                                after.append((first, use, room - own))
                                first, n = first + use, n - use
                        if n:
                            after.append((first, n, room))
                    runs = after
            for first, n, room in runs:
                if room:
                    heapq.heappush(rooms[room], (first, n))
    for length in sorted((n for n, c in left.items() if c), reverse=True):
        while left[length]:
            room = min((r for r, runs in rooms.items() if r >= length and runs), default=None)
            if room is None:
                each = limit // length
                n = max(1, left[length] // each)
                heapq.heappush(rooms[limit], (sequences, n))
                sequences += n
                room = limit
            first, n = heapq.heappop(rooms[room])
            use = min(n, left[length])
            if use < n:
                heapq.heappush(rooms[room], (first + use, n - use))
            put(length, use, first, room)
    return places


def pack(pieces: DataFrame, limit: int = LIMIT, groups: int = GROUPS) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of ``pieces`` (``doc_id, piece, length``, ...).

    ``pieces`` is read several times, so give a stored table. Equal rows get different places. An
    empty table gives an empty table. Sequence numbers run from 0; one whose configuration was not
    filled may be missing.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and max(counts) > limit:
        raise ValueError(f"a piece has {max(counts)} tokens; a sequence holds {limit}")
    places = spark.createDataFrame(
        plan(counts, limit, groups),
        "length bigint, place_from bigint, place_n bigint, place_sequence bigint, offset bigint")
    # ranks by length: a length may be common, so its pieces are dealt by hash and ranks shifted
    parts = max(1, -(-sum(counts.values()) // RANKED_TOGETHER))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = (
        dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(
            Window.partitionBy("length").orderBy("part")
            .rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    )
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("own", F.row_number().over(own) - 1)
        .join(before, ["length", "part"])
        .withColumn("rank", F.col("own") + F.col("before"))
    )
    # the plan's size is bounded by limit and groups alone
    found = ranked.join(F.broadcast(places), "length").where(
        (F.col("rank") >= F.col("place_from"))
        & (F.col("rank") < F.col("place_from") + F.col("place_n")))
    return found.select(
        *pieces.columns,
        (F.col("place_sequence") + F.col("rank") - F.col("place_from")).alias("sequence_id"),
        "offset")


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT,
                   end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents; texts are read once and never shuffled."""
    return pack(written(tokenise(docs, tokenizer, limit, end_id, ids), "pieces"), limit)
