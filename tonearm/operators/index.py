"""Vector index: unit vectors in Parquet, cut into cells by k-means for approximate search.

An index is a row of versions. Building writes version 0; adding, removing and splitting write one
version each and change no file of another. A version has vectors by cell, ids that it removes from earlier
versions, centres of new or given-up cells, and by how much cells grew or shrank. It counts once its entry in
``log`` is written, so readers never see half of one, and a failed attempt is simply made again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.functions.vectors import l2_normalise
from tonearm.operators.nearest import (
    best_in_shared_blocks, gathered, grouped, near_order, nearest, sent, vector_rows,
)
from tonearm.operators.networks import Weights, encode
from tonearm.session import written
from tonearm.sources.preferences import path_exists

# fixed value: number of cells
CELLS = 1024
ROWS_PER_FILE = 500_000
# Rows whose layers are computed at once.
_AT_ONCE = 2048


def encode_vectors(df: DataFrame, weights: Weights, tower: str, keys: str | list[str],
                   vec: str = "vec") -> DataFrame:
    """(keys, embedding): unit embeddings of one tower for a feature-vector column."""
    keys = [keys] if isinstance(keys, str) else keys
    shared = df.sparkSession.sparkContext.broadcast(weights)
    shape = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _AT_ONCE):
                part = b.slice(at, _AT_ONCE)
                e = encode(shared.value, tower, vector_rows(pa.chunked_array([part[vec]]), 0))
                ends = np.arange(len(e) + 1, dtype=np.int32) * e.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in keys), pa.ListArray.from_arrays(ends, e.ravel())],
                    names=[*keys, "embedding"])

    return df.select(*keys, vec).mapInArrow(run, shape + ", embedding array<double>")


def build_index(vectors: DataFrame, path: str, *, ivf: bool = False, cells: int = CELLS,
                item_id: str = "id", vec: str = "embedding", seed: int = 0,
                centres: list[list[float]] | None = None) -> None:
    """Store (item_id, embedding) as unit vectors, by cell when ``ivf``.

    Cells are trained before any vector is assigned, or given by their ``centres``. Centres and
    sizes, one row per cell, are stored beside the vectors. What ``path`` held is replaced.
    """
    spark = vectors.sparkSession
    for part in ("log", "vectors", "removed", "centres", "sizes"):
        _drop(spark, f"{path}/{part}")
    unit = _unit_rows(vectors, item_id, vec)
    if not ivf:
        unit.withColumn("cell", F.lit(0)).write.partitionBy("cell").parquet(f"{path}/vectors/version=0")
        _commit(spark, path, 0)
        return
    if centres is None:
        centres = _train(unit, cells, seed)
    near = spark.createDataFrame(list(enumerate(centres)), _CENTRE)
    near.withColumn("live", F.lit(True)).write.parquet(f"{path}/centres/version=0")
    _store(_placed(unit, near), path, 0)
    _commit(spark, path, 0)


_CENTRE = "cell int, centre array<double>"


def _unit_rows(vectors: DataFrame, item_id: str, vec: str) -> DataFrame:
    return l2_normalise(vectors.select(F.col(item_id).alias("item_id"),
                                       F.col(vec).alias("embedding")), "embedding")


def _train(unit: DataFrame, cells: int, seed: int) -> list[list[float]]:
    points = unit.withColumn("features", array_to_vector("embedding"))
    return [c.tolist() for c in KMeans(k=cells, seed=seed).fit(points).clusterCenters()]


def _placed(unit: DataFrame, centres: DataFrame) -> DataFrame:
    """(item_id, embedding, cell): each vector with the cell of its nearest centre."""
    unit = written(unit, "unit")
    found = nearest(unit.select("item_id", "embedding").dropDuplicates(["item_id"]), centres, 1, "l2",
                    query_id="item_id", item_id="cell", query_vec="embedding", item_vec="centre")
    return written(unit.join(found.select("item_id", "cell"), "item_id"), "placed")


def _store(placed: DataFrame, path: str, version: int) -> None:
    """A version's vectors, in a file per cell and ROWS_PER_FILE rows: no task gets the whole of a
    crowded cell; and its growth of each cell."""
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("more"))
    files = sizes.select("cell", F.ceil(F.col("more") / F.lit(ROWS_PER_FILE)).cast("int").alias("files"))
    part = F.pmod(F.xxhash64("item_id"), F.col("files")).alias("part")
    placed.join(files, "cell").select("item_id", "embedding", "cell", part) \
        .repartition("cell", "part").drop("part") \
        .write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors/version={version}")
    sizes.write.mode("overwrite").parquet(f"{path}/sizes/version={version}")


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _commit(spark: SparkSession, path: str, version: int) -> None:
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/log/v={version}")


def index_version(spark: SparkSession, path: str) -> int | None:
    """The last complete version, or None when the index is not there."""
    if not path_exists(spark, f"{path}/log"):
        return None
    return spark.read.schema("version int").parquet(f"{path}/log").agg(F.max("version")).first()[0]


def _versions(spark: SparkSession, path: str, part: str, schema: str, upto: int) -> DataFrame:
    """A part of the index up to a version; empty if no version has it."""
    if not path_exists(spark, f"{path}/{part}"):
        return spark.createDataFrame([], f"{schema}, version int")
    return spark.read.schema(f"{schema}, version int").parquet(f"{path}/{part}").where(
        F.col("version") <= upto)


def _item_type(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(f"{path}/vectors/version=0").schema["item_id"].dataType.simpleString()


def live_centres(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(cell, centre) of the cells that are in use."""
    every = _versions(spark, path, "centres", f"{_CENTRE}, live boolean", version)
    return every.groupBy("cell").agg(F.max_by(F.struct("centre", "live"), "version").alias("x")) \
        .where("x.live").select("cell", "x.centre")


def _live(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(item_id, embedding, version, cell): vectors that no later version removed, in live cells."""
    item = _item_type(spark, path)
    rows = spark.read.schema(f"item_id {item}, embedding array<double>, version int, cell int") \
        .parquet(f"{path}/vectors").where(F.col("version") <= version)
    if path_exists(spark, f"{path}/removed"):
        gone = _versions(spark, path, "removed", f"item_id {item}", version).select(
            F.col("item_id").alias("_gone"), F.col("version").alias("_at"))
        rows = rows.join(gone, (F.col("item_id") == F.col("_gone"))
                         & (F.col("version") < F.col("_at")), "left_anti")
    given_up = _versions(spark, path, "centres", f"{_CENTRE}, live boolean", version).where("NOT live")
    given_up = [r.cell for r in given_up.select("cell").distinct().collect()]  # CELLS and splits at most
    return rows.where(~F.col("cell").isin(given_up)) if given_up else rows


def open_index(spark: SparkSession, path: str) -> DataFrame | None:
    """(item_id, embedding, cell) of the last complete version, or None when the index is not there."""
    version = index_version(spark, path)
    return None if version is None else _live(spark, path, version).drop("version")


def _next(spark: SparkSession, path: str) -> int:
    version = index_version(spark, path)
    if version is None:
        raise ValueError("the index is not built")
    return version + 1


def _shrunk(spark: SparkSession, path: str, ids: DataFrame, version: int) -> DataFrame:
    """By how much cells shrink when the ids go."""
    return _live(spark, path, version - 1).join(ids, "item_id", "left_semi").groupBy("cell").agg(
        (-F.count(F.lit(1))).alias("more"))


def remove_from_index(ids: DataFrame, path: str, item_id: str = "id") -> int:
    """Takes vectors out of the index; unknown ids change nothing. Returns the new version."""
    spark = ids.sparkSession
    version = _next(spark, path)
    gone = ids.select(F.col(item_id).alias("item_id")).where("item_id IS NOT NULL").distinct()
    gone.write.mode("overwrite").parquet(f"{path}/removed/version={version}")
    gone = spark.read.schema(gone.schema).parquet(f"{path}/removed/version={version}")
    _shrunk(spark, path, gone, version).write.mode("overwrite").parquet(f"{path}/sizes/version={version}")
    _commit(spark, path, version)
    return version


def add_to_index(vectors: DataFrame, path: str, item_id: str = "id", vec: str = "embedding") -> int:
    """Adds vectors, each to the cell of the nearest stored centre; an id that is there already gets
    the new vector instead. Returns the new version. Nothing that is stored moves."""
    spark = vectors.sparkSession
    version = _next(spark, path)
    unit = _unit_rows(vectors, item_id, vec)
    centres = live_centres(spark, path, version - 1)
    cut = not centres.isEmpty()
    placed = _placed(unit, written(centres, "centres")) if cut else \
        written(unit.withColumn("cell", F.lit(0)), "placed")
    again = placed.select("item_id").distinct()
    again.write.mode("overwrite").parquet(f"{path}/removed/version={version}")
    shrunk = written(_shrunk(spark, path, again, version), "shrunk")
    _store(placed, path, version)
    shrunk.write.mode("append").parquet(f"{path}/sizes/version={version}")
    _commit(spark, path, version)
    return version


def split_cells(spark: SparkSession, path: str, most: int, seed: int = 0) -> int | None:
    """Splits every cell of more than ``most`` vectors, each by itself, into cells of about half that;
    other cells stay as they are. Returns the new version, or None if no cell is overfull."""
    version = _next(spark, path)
    rows = _live(spark, path, version - 1)
    full = [(r.cell, r.n) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > most).orderBy("cell").collect()]
    centres = live_centres(spark, path, version - 1)
    if not full or centres.isEmpty():
        return None
    free = _versions(spark, path, "centres", f"{_CENTRE}, live boolean", version).agg(
        F.max("cell")).first()[0] + 1
    moved, new = [], []
    for cell, n in full:
        own = rows.where(F.col("cell") == cell).select("item_id", "embedding")
        trained = _train(own, max(2, -(-2 * n // most)), seed)
        near = [(free + i, c) for i, c in enumerate(trained)]
        free += len(near)
        new += [(c, centre, True) for c, centre in near] + [(cell, None, False)]
        moved.append(_placed(own, spark.createDataFrame(near, _CENTRE)))
    spark.createDataFrame(new, f"{_CENTRE}, live boolean").write.mode("overwrite").parquet(
        f"{path}/centres/version={version}")
    every = moved[0]
    for more in moved[1:]:
        every = every.unionByName(more)
    _store(every, path, version)
    _commit(spark, path, version)
    return version


def _sizes(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(cell, centre, size) of the live cells."""
    grown = _versions(spark, path, "sizes", "cell int, more bigint", version).groupBy("cell").agg(
        F.sum("more").alias("size"))
    return live_centres(spark, path, version).join(grown, "cell", "left").select(
        "cell", "centre", F.coalesce("size", F.lit(0)).alias("size"))


def _seen(q: np.ndarray, centre: np.ndarray, size: np.ndarray, k: int, nprobe: int) -> np.ndarray:
    """For each query, which cells it visits."""
    if nprobe >= len(centre):  # none is left out, whatever their order
        return np.ones((len(q), len(centre)), bool)
    away = ((q * q).sum(1)[:, None] - 2 * q @ centre.T + (centre * centre).sum(1)).round(12)
    order = np.argsort(away, axis=1, kind="stable")
    have = np.cumsum(size[order], axis=1)
    # the first nprobe cells, and on to the one that brings the k-th vector
    last = np.maximum(nprobe, (have < k).sum(1) + 1)
    seen = np.zeros(order.shape, bool)
    np.put_along_axis(seen, order, np.arange(len(centre)) < last[:, None], axis=1)
    return seen


def _probes(queries, query_id, vec, cells, groups, k, nprobe):
    """(query_id, block, bits): the groups with cells that each query visits, nearest centres first,
    and which ones."""
    shared = queries.sparkSession.sparkContext.broadcast((
        np.array([c.centre for c in cells]), np.array([c.size for c in cells]), groups))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, size, groups = shared.value
        step = max(1, 1_000_000 // len(centre))
        for b in batches:
            for at in range(0, len(b), step):
                part = b.iloc[at:at + step]
                seen = _seen(np.stack(part[vec].to_numpy()), centre, size, k, nprobe)
                yield from sent(part[[query_id]], seen, groups)

    kind = queries.schema[query_id].dataType.simpleString()
    return queries.select(query_id, F.col(vec).cast("array<double>").alias(vec)).mapInPandas(
        run, f"{query_id} {kind}, block int, bits binary")


def _probed(probes: DataFrame, groups: list) -> set[int]:
    """Places of the cells that any query visits; each task gives a row of bits for each group."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {}
        for b in batches:
            for block, bits in zip(b["block"], b["bits"]):
                seen[block] = seen.get(block, 0) | int.from_bytes(bits)
        yield pd.DataFrame({"block": list(seen), "bits": [n.to_bytes(-(-len(groups[g]) // 8))
                                                          for g, n in seen.items()]})

    found = probes.select("block", "bits").mapInPandas(run, "block int, bits binary").distinct().collect()
    return {int(c) for r in found for c in groups[r.block][np.unpackbits(
        np.frombuffer(r.bits, np.uint8), count=len(groups[r.block])).astype(bool)]}


def search_index(queries: DataFrame, spark: SparkSession, path: str, k: int, *,
                 query_id: str = "query_id", vec: str = "vec", nprobe: int | None = None,
                 block_rows: int = 50_000) -> DataFrame:
    """(query_id, id, score, rank) by cosine: all vectors, or those of the ``nprobe`` nearest cells
    and of as many more as it takes to have ``k`` vectors."""
    index = open_index(spark, path)
    if index is None:
        raise ValueError("the index is not built")
    if nprobe is None:
        return nearest(queries, index, k, "cosine", query_id=query_id, item_id="item_id",
                       query_vec=vec, item_vec="embedding") \
            .withColumnRenamed("item_id", "id")
    cells = _sizes(spark, path, index_version(spark, path)).orderBy("cell").collect()  # a row a cell
    width = len(cells[0].centre)
    groups = gathered(near_order(np.array([c.centre for c in cells])), np.array([c.size for c in cells]),
                      width)
    probes = written(_probes(queries, query_id, vec, cells, groups, k, nprobe), "probes")
    q = probes.join(queries, query_id).select(
        F.col(query_id).alias("qid"), F.col(vec).cast("array<double>").alias("qvec"), "block", "bits")
    # only the folders of probed cells are read
    probed = _probed(probes, groups)
    x = index if len(probed) == len(cells) else index.filter(
        F.col("cell").isin([cells[c].cell for c in probed]))
    x = grouped(x.select(F.col("item_id").alias("iid"), F.col("embedding").alias("ivec"), "cell"),
                groups, [c.cell for c in cells])
    shape = (f"qid {q.schema['qid'].dataType.simpleString()}, "
             f"iid {x.schema['iid'].dataType.simpleString()}, cost double")
    found = best_in_shared_blocks(q, x, k, "cosine", shape, width, block_rows)
    w = Window.partitionBy("qid").orderBy("cost", "iid")
    return found.withColumn("rank", F.row_number().over(w).cast("int")) \
        .filter(F.col("rank") <= k) \
        .select(F.col("qid").alias(query_id), F.col("iid").alias("id"),
                (-F.col("cost")).alias("score"), "rank")
