"""Near-duplicate documents by b-bit MinHash over word shingles, with links confirmed on full sets.

1. One read of the texts gives each document a hash of its shingle set, band keys and a packed
   signature of the low bits of its minima.
2. Documents with equal sets are one class, stood for by its smallest id.
3. Documents that share a band key are tied to the smallest id of that key: the packed signatures
   estimate their similarity, what may reach the threshold is confirmed on the full sets.
4. Keys whose documents lie in one component need nothing more. In the others, documents of
   different components are compared with each other in blocks of longer signatures, and the likely
   ones confirmed as before. So every two documents that share a key and lie in different components
   have been compared, while groups of copies are never expanded into pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import (
    LOWER, WHITE, find_words, hash_windows, hash_words, mix, plain_columns, slices, text_bytes,
    window_starts,
)
from tonearm.llm.components import components
from tonearm.session import written

SHINGLE = 5
SIMILARITY = 80  # per cent
# A pair of similarity 0.8 shares no band key with probability (1 - 0.8^4)^25 = 2e-6.
BANDS, ROWS = 25, 4
LOW_BITS = 4
# Standard deviations of the estimate that a pair may lie below the threshold and still be confirmed.
SLACK = 5
# Documents of a key compared at once.
BLOCK = 512

_HASHES = BANDS * ROWS
_LONG = 1024  # places of the longer signatures that settle doubtful pairs
_EACH = 64 // LOW_BITS


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return (random.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
            random.integers(0, 2**32, n, dtype=np.uint32))


_SHORT_FUNCTIONS, _LONG_FUNCTIONS = _functions(_HASHES, 91), _functions(_LONG, 92)
_ONES = 0x1111111111111111
_LETTERS = ~WHITE


def shingle_sets(part: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: words without blanks, A-Z in lower case; a
    text of fewer than ``size`` words is one shingle, one without words has none."""
    raw, at = text_bytes(part)
    raw = LOWER[raw]
    starts, ends, counts = find_words(raw, at, _LETTERS)
    words = hash_words(raw, starts, ends)
    windows, places = hash_windows(words, size), window_starts(counts, size)
    room = np.cumsum(np.maximum(counts - size + 1, 0))
    first = np.cumsum(counts) - counts
    out = []
    for i, n in enumerate(counts):
        if n >= size:
            out.append(np.unique(windows[places[room[i] - (n - size + 1):room[i]]]))
        elif n:
            out.append(hash_windows(words[first[i]:first[i] + n], int(n), seed=int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], functions=_SHORT_FUNCTIONS) -> np.ndarray:
    """Smallest value of every hash function over each set (none empty): documents x functions."""
    sizes = np.array([len(s) for s in sets])
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), len(functions[0])), np.uint32)
    for k, (factor, offset) in enumerate(zip(*functions)):
        out[:, k] = np.minimum.reduceat(values * factor + offset, first)
    return out


def band_keys(lowest: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different between bands: documents x bands."""
    rows = lowest.reshape(len(lowest), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(lowest), BANDS))
    for k in range(ROWS):
        key = mix(key ^ rows[:, :, k]) + np.uint64(k)
    return key.view(np.int64)


def packed(lowest: np.ndarray) -> np.ndarray:
    """Low bits of the minima (each mixed first), side by side in 64-bit words; the last may have
    places left over, which are 0."""
    low = (mix(lowest.astype(np.uint64)) & np.uint64(2**LOW_BITS - 1))
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % _EACH)))
    shifts = np.arange(_EACH, dtype=np.uint64) * np.uint64(LOW_BITS)
    return np.bitwise_or.reduce(
        low.reshape(len(low), -1, _EACH) << shifts, axis=2).view(np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n_shingles``, 128 bits that name the set, band keys and the packed signature."""

    def run(batches):
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            signs: list = [None] * len(sets)
            if full:
                lowest = minima([sets[i] for i in full])
                for i, k, s in zip(full, band_keys(lowest), packed(lowest)):
                    keys[i], signs[i] = k, s
            names = [[int(mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64))
                      for s in sets] for salt in (0x51ED270B, 0xA3C59AC2F0)]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(names[0], pa.int64()), pa.array(names[1], pa.int64()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64())),
            ], names=["doc_id", "n_shingles", "name1", "name2", "keys", "sign"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, name1 bigint, name2 bigint, "
                                "keys array<bigint>, sign array<bigint>")


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).view(np.uint64)


def long_signatures(sets: DataFrame) -> DataFrame:
    """``doc_id, sign, keys``: signatures with many more places, and the band keys, from full sets."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                own = [s.values.to_numpy().view(np.uint64) for s in part.column("shingles")]
                found = packed(minima(own, _LONG_FUNCTIONS)), band_keys(minima(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(list(x), pa.list_(pa.int64())) for x in found)],
                    names=["doc_id", "sign", "keys"])

    return sets.mapInArrow(run, "doc_id bigint, sign array<bigint>, keys array<bigint>")


def _least_equal(similarity: int, hashes: int) -> int:
    """Equal places in the signatures from which a pair is confirmed."""
    chance = 2.0 ** -LOW_BITS
    share = similarity / 100 + (1 - similarity / 100) * chance
    return int(np.floor(hashes * share - SLACK * np.sqrt(hashes * share * (1 - share))))


def estimate(equal, hashes: int = _HASHES):
    """Similarity from the share of equal low bits, freed of chance agreement."""
    chance = 2.0 ** -LOW_BITS
    return (equal / hashes - chance) / (1 - chance)


def _equal_places(a: str, b: str) -> Column:
    """Places where two short signatures agree, by counting bits of the folded difference."""
    total = F.lit(_HASHES)
    for k in range(-(-_HASHES // _EACH)):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total - F.bit_count(x.bitwiseAND(F.lit(_ONES)))
    return total


def _likely_pairs(least: int):
    """Pairs of one block (or of two blocks) of a key that lie in different components and whose
    signatures are alike, each from the first band whose key both have. Takes rows sorted by key,
    blocks and side."""

    def pairs(groups, ids, components, sides, signs, keys):
        left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        same = len(left) == len(right) == len(ids)
        for k, i in enumerate(left):
            other = right[k + 1:] if same else right
            other = other[components[other] != components[i]]
            if len(other):
                x = signs[other] ^ signs[i]
                x |= x >> np.uint64(1)
                x |= x >> np.uint64(2)
                differ = np.bitwise_count(x & np.uint64(_ONES)).sum(axis=1, dtype=np.int64)
                other = other[_LONG - differ >= least]
                shared = keys[other] == keys[i]
                first = keys[i][shared.argmax(axis=1)] == groups[0, 0].view(np.uint64)
                found = ids[other[first & shared.any(axis=1)]]
                if len(found):
                    yield np.minimum(found, ids[i]), np.maximum(found, ids[i])

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                groups = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
                own = [groups, *(batch.column(c).to_numpy() for c in ("doc_id", "component", "side")),
                       _matrix(batch.column("sign")), _matrix(batch.column("keys"))]
                held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
            if held is None or not len(held[0]):
                continue
            edges = np.flatnonzero((held[0][1:] != held[0][:-1]).any(axis=1)) + 1
            edges = [0, *edges.tolist()]
            if batch is None:
                edges.append(len(held[0]))
            out = [p for a, b in zip(edges, edges[1:]) for p in pairs(*(x[a:b] for x in held))]
            held = [x[edges[-1]:] for x in held]  # a group that goes on
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs ``a, b`` whose full sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    # 100 * shared >= similarity * (a + b - shared)
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.join(left, "b").join(right, "a")
            .where((100 + similarity) * shared >= similarity * (F.size("set_a") + F.size("set_b")))
            .select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked when 100 times the shingles they share is at least ``similarity`` times
    those they have together. ``component_id`` is the smallest id reachable over links, ``kept``
    says that it is the row's own. Null, empty and blank texts have no shingles and no links.
    Repeated rows are linked; rows that share an id are linked too, whatever their texts. Rows
    without an id take no part: their component is null and they are kept. Ids are integers.
    """
    docs = plain_columns(docs, doc_id=doc_id, text=text).withColumn(
        "doc_id", F.col("doc_id").cast("bigint"))
    known = written(signatures(docs, shingle), "signatures")
    named = ["name1", "name2", "n_shingles"]
    full = known.where("doc_id is not null and n_shingles > 0")
    # classes of equal sets; only the smallest id of a class goes on
    classes = written(full.groupBy(named).agg(F.min("doc_id").alias("head"), F.count("*").alias("n"))
                      .where("n > 1").drop("n"), "classes")
    own = F.coalesce("head", "doc_id")
    headed = written(
        known.join(classes, named, "left").select(
            "doc_id", "n_shingles", own.alias("head"),
            *[F.when((own == F.col("doc_id")) & (F.col("n_shingles") > 0), F.col(c)).alias(c)
              for c in ("keys", "sign")]), "heads")
    repeated = headed.where("n_shingles > 0 and head <> doc_id").select("doc_id", "head").distinct()
    # an id with several texts: its classes belong together
    own_class = headed.where("head = doc_id").select("doc_id").distinct()
    several = repeated.groupBy("doc_id").agg(F.min("head").alias("least"), F.max("head").alias("most"))
    same_id = (
        repeated.join(several.where("least <> most"), "doc_id", "left_semi")
        .unionByName(repeated.join(own_class, "doc_id", "left_semi"))
        .select(F.col("doc_id").alias("a"), F.col("head").alias("b")))

    heads = headed.where("head = doc_id and n_shingles > 0").select("doc_id", "keys", "sign")
    keyed = heads.select("doc_id", F.explode("keys").alias("key"))
    hubs = written(keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("other"))
                   .where("hub <> other").drop("other"), "hubs")
    members = written(keyed.join(hubs, "key").distinct(), "members")
    ids = members.select("doc_id").distinct()
    sets = written(sets_of(docs.join(ids, "doc_id", "left_semi"), shingle)
                   .where(F.size("shingles") > 0), "sets")
    signs = heads.select("doc_id", "sign")

    stars = members.where("doc_id <> hub").select(
        F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    likely = (
        stars.join(signs.select(F.col("doc_id").alias("b"), F.col("sign").alias("sign_b")), "b")
        .join(signs.select(F.col("doc_id").alias("a"), F.col("sign").alias("sign_a")), "a")
        .where(_equal_places("sign_a", "sign_b") >= _least_equal(similarity, _HASHES)).select("a", "b").distinct())
    links = written(_confirmed(likely, sets, similarity).unionByName(same_id), "links")
    first = components(links)

    placed = written(
        members.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "placed")
    open_keys = written(
        placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                  F.count("*").alias("n"))
        .where("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "open")
    # a key's documents are dealt to blocks; each two blocks meet once, so none grows with the key
    open_members = placed.join(open_keys, "key")
    long = written(long_signatures(sets.join(
        open_members.select("doc_id").distinct(), "doc_id", "left_semi")), "long-signatures")
    blocks = (
        open_members.join(long, "doc_id")
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select("key", "doc_id", "component", "sign", "keys",
                F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                F.when(F.col("own") == F.col("other"), 2)
                .when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side")))
    across = (blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
              .mapInArrow(_likely_pairs(_least_equal(similarity, _LONG)), "a bigint, b bigint")
              .distinct())
    more = written(_confirmed(across, sets, similarity), "more-links")
    # what the second pass adds are links between components of the first
    named_first = first.select("node", "component")
    lifted = (
        more.join(named_first.toDF("a", "ca"), "a", "left").join(named_first.toDF("b", "cb"), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    second = components(lifted).toDF("component", "top")
    # every id met in either pass, with its last component
    final = written(
        first.join(second, "component", "left").select(
            F.col("node").alias("head"), F.coalesce("top", "component").alias("top"))
        .unionByName(second.join(first.select(F.col("node").alias("component")), "component", "left_anti")
                     .select(F.col("component").alias("head"), "top")), "final")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "head"))
    return headed.join(final, "head", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
