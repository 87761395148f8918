"""Word vectors from the company words keep, and a text encoder that uses them.

Words that stand near each other more often than chance (positive mutual information) give a
symmetric sparse matrix. Its leading singular vectors come from a randomised range finder: the matrix is
multiplied with a few hundred random columns, which are made orthonormal, and so on for some rounds; a
small matrix that the driver can decompose is left. Columns are kept in blocks of words. A product joins
each packed part of the matrix with the one block it meets; the driver only ever sees matrices of
``width`` columns and rows. Texts without a word in common can so be near.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions.vectors import l2_normalise
from tonearm.operators.encoder import WIDTH, Encoder, document_words
from tonearm.operators.numbering import number_rows
from tonearm.operators.training import SUMS, summed, task_number
from tonearm.session import BROADCAST_CELLS, compute_partitions, written

# Words on either side that count as company.
WINDOW = 8
# Columns beyond the wanted ones, and rounds of multiplying, that make the leading ones exact.
EXTRA, ROUNDS = 16, 2
# Words in a block of columns; entries of the matrix in a packed part, and multiplied at once.
BLOCK, PACKED, AT_ONCE = 4096, 50_000, 8192
_COLUMNS = "block int, x binary"


def company(documents: DataFrame, window: int = WINDOW, document: str = "document") -> DataFrame:
    """(a, b, n): how often two different words stand within ``window`` words, in both directions."""
    w = F.col("w")
    near = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda d: F.zip_with(
        w, F.slice(w, d + 1, F.greatest(F.size(w), F.lit(1))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    # explode() of one array: a column of its own, where a projection could split the text again
    pairs = documents.select(F.explode(F.array(document_words(document))).alias("w")) \
        .select(F.explode(near).alias("p")).select("p.*").where("b IS NOT NULL AND a <> b")
    once = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.count("*").alias("n"))
    return once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))


def _matrix(counts: DataFrame, block: int) -> tuple[DataFrame, DataFrame, int]:
    """(words with their numbers, packed entries, number of words)."""
    totals = counts.groupBy("a").agg(F.sum("n").alias("n"))
    words = written(number_rows(totals.select(F.col("a").alias("word"), "n"),
                                [F.xxhash64("word"), "word"], "i"), "words")
    size, total = words.agg(F.count("*"), F.sum("n")).first()
    if not size:
        return words, None, 0
    rows = words.select(F.col("word").alias("a"), "i", F.col("n").alias("n_a"))
    columns = words.select(F.col("word").alias("b"), F.col("i").alias("j"), F.col("n").alias("n_b"))
    weight = F.log(F.col("n") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b")))
    entries = counts.join(rows, "a").join(columns, "b").select(
        "i", "j", weight.alias("weight")).where("weight > 0")
    at = F.floor(F.col("j") / block).cast("int")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"block": [], "i": [], "j": [], "weight": []})
        for b in batches:
            held = pd.concat([held, b], ignore_index=True) if len(held) else b
            # a block goes on until another begins; long ones leave in parts
            done = len(held) if len(held) >= PACKED else int((held["block"] != held["block"].iloc[-1]).sum())
            yield from _packed(held.iloc[:done])
            held = held.iloc[done:]
        if len(held):
            yield from _packed(held)

    parts = max(1, -(-entries.count() // (4 * PACKED)))
    packed = entries.withColumn("block", at).repartition(
        max(parts, compute_partitions(entries.sparkSession)), "block", F.pmod(F.xxhash64("i"), F.lit(parts)))
    return words, written(packed.select("block", "i", "j", "weight").sortWithinPartitions("block", "i")
                          .mapInPandas(pack, "block int, n int, i binary, j binary, weight binary"),
                          "matrix"), size


def _packed(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for block, own in rows.groupby("block"):
        for at in range(0, len(own), PACKED):
            part = own.iloc[at:at + PACKED].sort_values("i")
            yield pd.DataFrame({
                "block": [int(block)], "n": [len(part)], "i": [part["i"].to_numpy(np.int64).tobytes()],
                "j": [part["j"].to_numpy(np.int64).tobytes()],
                "weight": [part["weight"].to_numpy(np.float64).tobytes()]})


def _times(matrix: DataFrame, columns: DataFrame, size: int, block: int) -> DataFrame:
    """The product of the matrix and some columns, in blocks."""

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                x = np.frombuffer(row.x).reshape(min(block, size - row.block * block), -1)
                i, j = np.frombuffer(row.i, np.int64), np.frombuffer(row.j, np.int64) - row.block * block
                weight = np.frombuffer(row.weight)
                for at in range(0, row.n, AT_ONCE):
                    own = i[at:at + AT_ONCE]
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    sums = np.add.reduceat(weight[at:at + AT_ONCE, None] * x[j[at:at + AT_ONCE]], first)
                    for to, places in pd.Series(np.arange(len(first))).groupby(own[first] // block):
                        yield pd.DataFrame({
                            "block": np.array([to], np.int32),
                            "i": [(own[first[places]] - to * block).tobytes()],
                            "x": [np.ascontiguousarray(sums[places]).tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for b in batches:
            for to, i, x in zip(b["block"], b["i"], b["x"]):
                i = np.frombuffer(i, np.int64)
                x = np.frombuffer(x).reshape(len(i), -1)
                if to != now:
                    if now is not None:
                        yield pd.DataFrame({"block": [now], "x": [total.tobytes()]})
                    now, total = to, np.zeros((min(block, size - to * block), x.shape[1]))
                total[i] += x  # places of a part are distinct
        if now is not None:
            yield pd.DataFrame({"block": [now], "x": [total.tobytes()]})

    parts = matrix.join(columns, "block").mapInPandas(multiply, "block int, i binary, x binary")
    blocks = -(-size // block)
    return written(parts.repartition(min(blocks, compute_partitions(matrix.sparkSession)), "block")
                   .sortWithinPartitions("block").mapInPandas(add, _COLUMNS), "columns")


def _gram(left: DataFrame, right: DataFrame, size: int, block: int) -> np.ndarray:
    """The small matrix of inner products of the columns of two blocked matrices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for b in batches:
            for at, x, y in zip(b["block"], b["x"], b["y"]):
                rows = min(block, size - at * block)
                own = np.frombuffer(x).reshape(rows, -1).T @ np.frombuffer(y).reshape(rows, -1)
                total, n = own if total is None else total + own, n + rows
        if n:
            yield pd.DataFrame({"slot": [task_number()], "rows": [n], "numbers": [[0.0]],
                                "vectors": [total.tobytes()]})

    both = left.join(right.withColumnRenamed("x", "y"), "block")
    _, _, total = summed(both.mapInPandas(run, SUMS), compute_partitions(left.sparkSession))
    width = int(round(len(total) ** 0.5))
    return total.reshape(width, width)


def _mixed(columns: DataFrame, by: np.ndarray, size: int, block: int) -> DataFrame:
    """New columns: the old ones combined by a small matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, x in zip(b["block"], b["x"]):
                own = np.frombuffer(x).reshape(min(block, size - at * block), -1) @ by
                yield pd.DataFrame({"block": [at], "x": [np.ascontiguousarray(own).tobytes()]})

    return written(columns.mapInPandas(run, _COLUMNS), "columns")


def _orthonormal(columns: DataFrame, size: int, block: int) -> DataFrame:
    """Columns of length 1, at right angles, that span the same; twice, for the digits' sake."""
    for _ in range(2):
        value, vector = np.linalg.eigh(_gram(columns, columns, size, block))
        keep = value > value[-1] * 1e-13
        columns = _mixed(columns, vector[:, keep] / np.sqrt(value[keep]), size, block)
    return columns


def fit_word_vectors(documents: DataFrame, width: int = WIDTH, *, window: int = WINDOW, seed: int = 0,
                     rounds: int = ROUNDS, document: str = "document", block: int = BLOCK) -> DataFrame:
    """(word, weight, vec): a vector of ``width`` numbers for every word that has company, and how much
    it tells (the logarithm of all words' share over its own)."""
    spark = documents.sparkSession
    counts = written(company(documents, window, document), "company")
    words, matrix, size = _matrix(counts, block)
    if not size:
        return spark.createDataFrame([], "word string, weight double, vec array<float>")
    wanted = min(width + EXTRA, size)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in b["block"]:
                rows = min(block, size - at * block)
                x = np.random.default_rng([seed, at]).normal(size=(rows, wanted))
                yield pd.DataFrame({"block": [at], "x": [x.tobytes()]})

    blocks = spark.range(-(-size // block)).select(F.col("id").cast("int").alias("block"))
    columns = written(blocks.mapInPandas(start, _COLUMNS), "columns")
    for _ in range(rounds + 1):
        columns = _orthonormal(_times(matrix, columns, size, block), size, block)
    small = _gram(columns, _times(matrix, columns, size, block), size, block)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(value))[:width]
    turned = _mixed(columns, vector[:, order] * np.sqrt(np.abs(value[order])), size, block)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, x in zip(b["block"], b["x"]):
                own = np.frombuffer(x).reshape(min(block, size - at * block), -1)
                own = np.pad(own, ((0, 0), (0, width - own.shape[1]))).astype(np.float32)
                yield pd.DataFrame({"i": np.arange(len(own)) + at * block, "vec": list(own)})

    total = words.agg(F.sum("n")).first()[0]
    return turned.mapInPandas(rows, "i bigint, vec array<float>").join(words, "i").select(
        "word", F.log(F.lit(float(total)) / F.col("n")).alias("weight"), "vec")


def meaning_encoder(vectors: DataFrame, document: str = "document", embedding: str = "embedding",
                    broadcast_cells: int = BROADCAST_CELLS) -> Encoder:
    """Unit sums of the words' vectors by their weight; zeros for texts without a known word.

    ``vectors`` is a stored table of ``fit_word_vectors``. It goes to every task if it is small, which is
    checked; else the texts' words are joined with it.
    """
    head = vectors.select(F.size("vec")).head()
    width = head[0] if head else WIDTH
    most = max(1, broadcast_cells // (width + 4))
    local = vectors.limit(most + 1).toPandas()

    def sums(found: pd.DataFrame) -> np.ndarray:
        scale = (found["weight"] * found["times"]).to_numpy()[:, None]
        return scale * np.stack(found["vec"].to_numpy())

    def encode(df: DataFrame) -> DataFrame:
        if len(local) <= most:
            matrix = np.stack(local["vec"].to_numpy()) * local["weight"].to_numpy(np.float64)[:, None] \
                if len(local) else np.zeros((0, width))
            shared = df.sparkSession.sparkContext.broadcast(
                ({w: i for i, w in enumerate(local["word"])}, matrix))

            @F.pandas_udf("array<double>")
            def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                places, matrix = shared.value
                for texts in batches:
                    own = [[places[w] for w in t if w in places] if t is not None else [] for t in texts]
                    yield pd.Series([matrix[p].sum(axis=0) for p in own])

            out = df.withColumn(embedding, look_up(document_words(document)))
        else:
            rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "documents")
            found = rows.select("_row", F.explode(document_words(document)).alias("word")) \
                .groupBy("_row", "word").agg(F.count("*").alias("times")).join(vectors, "word")

            def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                now, total = None, None
                for b in batches:
                    parts = sums(b) if len(b) else []
                    for row, part in zip(b["_row"], parts):
                        if row != now:
                            if now is not None:
                                yield pd.DataFrame({"_row": [now], embedding: [total]})
                            now, total = row, np.zeros(width)
                        total += part
                if now is not None:
                    yield pd.DataFrame({"_row": [now], embedding: [total]})

            summed_up = found.select("_row", "times", "weight", "vec").repartition("_row") \
                .sortWithinPartitions("_row").mapInPandas(add, f"_row bigint, {embedding} array<double>")
            zeros = F.array_repeat(F.lit(0.0), width)
            out = rows.join(summed_up, "_row", "left").withColumn(
                embedding, F.coalesce(embedding, zeros)).drop("_row")
        return l2_normalise(out, embedding).withColumn(embedding, F.col(embedding).cast("array<float>"))

    return encode
