"""The trained rankers as one stored model: fit, save, index and load again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.vectors import model_vector
from tonearm.operators import training
from tonearm.operators.index import build_index, encode_vectors
from tonearm.operators.networks import Weights
from tonearm.session import written
from tonearm.sources.models import load_weights, save_weights
from tonearm.sources.preferences import path_exists

# Cells of the item index: about the square root of the items, at most.
MOST_CELLS = 1024


@dataclass
class Models:
    towers: Weights
    ranker: Weights
    index_path: str
    history: DataFrame


def save(spark: SparkSession, path: str, towers: training.Trained, ranker: training.Trained,
         items: DataFrame) -> None:
    """Store both models, the course of their training and the index of the items' embeddings."""
    save_weights(spark, towers.weights, f"{path}/towers")
    save_weights(spark, ranker.weights, f"{path}/ranker")
    rows = [(name, i, loss, *(x[i] if i < len(x) else None
                              for x in (done.validation_losses, done.accuracies)))
            for name, done in (("two_tower", towers), ("wide_deep", ranker))
            for i, loss in enumerate(done.losses)]
    spark.createDataFrame(rows, _HISTORY).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/history")
    index_items(items, towers.weights, f"{path}/index")


_HISTORY = "model string, epoch int, loss double, validation_loss double, accuracy double"


def index_items(items: DataFrame, towers: Weights, path: str) -> None:
    """(Re)build the index of the items' tower embeddings."""
    vectors = items.select("id", model_vector().alias("vec"))
    encoded = written(encode_vectors(vectors, towers, "item", "id"), "item-embeddings")
    cells = max(1, min(MOST_CELLS, int(encoded.count() ** 0.5)))
    build_index(encoded, path, ivf=True, cells=cells)


def load(spark: SparkSession, path: str) -> Models | None:
    """The stored models, or None when nothing was saved there."""
    towers, ranker = (load_weights(spark, f"{path}/{n}") for n in ("towers", "ranker"))
    if towers is None or ranker is None or not path_exists(spark, f"{path}/index/log"):
        return None
    history = spark.read.schema(_HISTORY).parquet(f"{path}/history")
    return Models(towers, ranker, f"{path}/index", history)


def fit(ratings: DataFrame, items: DataFrame, path: str, **options) -> Models:
    """Train both rankers on all ratings, save them with the item index, and load them back."""
    spark = ratings.sparkSession
    pairs = written(training.training_pairs(ratings, items), "pairs")
    towers = training.train_two_tower(pairs, **options)
    ranker = training.train_wide_deep(pairs, **options)
    save(spark, path, towers, ranker, items)
    return load(spark, path)


def load_or_fit(ratings: DataFrame, items: DataFrame, path: str, **options) -> Models:
    """The models stored at ``path``; they are trained when there are none."""
    return load(ratings.sparkSession, path) or fit(ratings, items, path, **options)


def item_index(spark: SparkSession, models: Models) -> DataFrame:
    """(id, embedding) of the stored index."""
    from tonearm.operators.index import open_index

    return open_index(spark, models.index_path).select(
        F.col("item_id").alias("id"), "embedding")
