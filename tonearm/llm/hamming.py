"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are the signs of principal components under rotations learned on a bounded sample (iterative
quantisation). A code is split into bytes and each byte is indexed: codes within a Hamming radius of
a query agree with it, by the pigeonhole principle, up to a small radius in some byte, so probing
the bytes' neighbourhoods finds every one of them. Their vectors are compared in double precision.

Vectors are dealt to parts of bounded size by a hash of their ids, whatever their codes, and queries
to blocks; each part meets each block once, in numpy, and only its best few come back. Many equal
vectors or a crowded code therefore fill no part more than others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.common import plain_columns
from tonearm.session import written

BITS = 128
# Vectors the rotations and the radius are learned from (fewer if they are long), and how many of
# them ask when the radius is chosen.
SAMPLE_ROWS, SAMPLE_CELLS, SAMPLE_QUERIES = 4096, 2_000_000, 256
# Share of the sample's true neighbours that the radius takes in; among more vectors neighbours are
# nearer than in the sample.
SAMPLE_RECALL = 0.98
PART_ROWS, QUERY_ROWS = 20_000, 2_000

_BYTES = BITS // 8
_COUNT = np.array([bin(i).count("1") for i in range(256)])
# bytes by distance from 0, and how many lie within each distance
_NEAR = np.argsort(_COUNT, kind="stable").astype(np.uint8)
_WITHIN = np.searchsorted(np.sort(_COUNT), np.arange(9), "right")


@dataclass
class Codes:
    """A learned mapping from vectors to codes, and the radius searched."""

    mean: np.ndarray
    rotation: np.ndarray  # dimensions x BITS
    radius: int

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.rotation > 0, axis=1)


def rotations(sample: np.ndarray, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projections: each rotation turns the leading components so that signs lose least;
    several rotations from different starts are put side by side."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    width = min(sample.shape[1], 64)
    leading = axes[:, ::-1][:, :width]
    reduced = centred @ leading
    random, found = np.random.default_rng(17), []
    while sum(f.shape[1] for f in found) < BITS:
        turn = np.linalg.qr(random.normal(size=(width, width)))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.where(reduced @ turn > 0, 1.0, -1.0).T @ reduced)
            turn = (u @ v).T
        found.append(leading @ turn)
    return mean, np.concatenate(found, axis=1)[:, :BITS]


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def differing(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count((codes ^ code).view(np.uint64)).sum(axis=1, dtype=np.int64)


def learn(sample: np.ndarray, k: int) -> Codes:
    mean, rotation = rotations(sample)
    known = Codes(mean, rotation, BITS)
    codes = known.encode(sample)
    seen = []
    for i in range(min(SAMPLE_QUERIES, len(sample))):
        away = distances(sample, sample[i])
        away[i] = np.inf
        best = np.argsort(away, kind="stable")[:min(k, len(sample) - 1)]
        seen.append(differing(codes[best], codes[i]))
    seen = np.concatenate(seen) if seen else np.zeros(0)
    known.radius = int(np.ceil(np.quantile(seen, SAMPLE_RECALL))) if len(seen) else 0
    return known


class Index:
    """The codes of a part by each of their bytes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable").T
        self.edges = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs in at most ``radius`` bits, ascending.

        With radius = s * bytes + a, a code that near differs in at most s bits in one of the first
        a + 1 bytes, or in at most s - 1 in one of the others.
        """
        s, a = divmod(min(radius, BITS), _BYTES)
        seen = np.zeros(len(self.codes), bool)
        for j, (order, edges) in enumerate(zip(self.order, self.edges)):
            reach = min(s if j <= a else s - 1, 8)
            if reach >= 0:
                keys = code[j] ^ _NEAR[:_WITHIN[reach]]
                for key in keys:
                    seen[order[edges[key]:edges[int(key) + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[differing(self.codes[rows], code) <= radius]

    def nearest(self, code: np.ndarray, radius: int, least: int) -> np.ndarray:
        """Rows within the radius; it grows until they are ``least`` or all there are."""
        rows = self.within(code, radius)
        while len(rows) < min(least, len(self.codes)):
            radius += 4
            rows = self.within(code, radius)
        return rows


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows with an id and a vector that is not null or zero and has only finite components."""
    rows = plain_columns(vectors, vec_id=vec_id, embedding=embedding)
    finite = F.forall("embedding", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(
        finite & F.exists("embedding", lambda x: x != 0), F.lit(False))).select(
            "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id",
           embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest found for each query: ``query_id, rank, vec_id, score``.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. Rows with a
    query's own id are not its neighbours. Of rows of ``queries`` with one id the smallest vector
    asks. Unusable vectors (see ``usable``), and vectors whose length is not the commonest one, take
    no part. Every query gets ``k`` rows if there are as many others; empty inputs give none.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), F.desc("d")).limit(1).collect()
    width, total = (sizes[0]["d"], sizes[0]["n"]) if sizes else (0, 0)
    rows = rows.where(F.size("embedding") == width)
    asked = (usable(queries, vec_id, embedding).where(F.size("embedding") == width)
             .groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    # a bounded sample: the smallest hashes
    bound = min(SAMPLE_ROWS, SAMPLE_CELLS // max(1, width))
    sample = (rows.select(F.xxhash64("vec_id").alias("h"), "vec_id", "embedding")
              .orderBy("h", "vec_id", "embedding").limit(bound).collect())
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    codes = spark.sparkContext.broadcast(learn(np.array([r["embedding"] for r in sample]), k))
    asked = written(asked, "queries")
    parts, blocks = -(-total // PART_ROWS), max(1, -(-asked.count() // QUERY_ROWS))

    def dealt(df: DataFrame, n: int) -> F.Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n)).cast("int")

    def spread(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.withColumn("block", dealt(asked, blocks)).withColumn("part", spread(parts))
    right = rows.withColumn("part", dealt(rows, parts)).withColumn("block", spread(blocks))

    def meet(own: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if own.num_rows and held.num_rows:
            known = codes.value
            points, ids = _matrix(held["embedding"]), held["vec_id"].to_numpy()
            index = Index(known.encode(points))
            asking = _matrix(own["embedding"])
            for query, point, code in zip(own["vec_id"].to_pylist(), asking, known.encode(asking)):
                # more by the rows of the query's own id, which may be among them
                same = ids == query
                near = index.nearest(code, known.radius, k + int(same.sum()))
                near = near[~same[near]]
                away = distances(points[near], point)
                if len(near) > k:  # ties at the k-th place stay
                    kept = away <= np.partition(away, k - 1)[k - 1]
                    near, away = near[kept], away[kept]
                best = np.lexsort((ids[near], away))[:k]
                out += zip([query] * len(best), ids[near[best]].tolist(), away[best].tolist())
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(
            ("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()))})

    found = (left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))
             .applyInArrow(meet, "query_id bigint, vec_id bigint, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
