"""Text encoders: a function that adds ``embedding`` (unit vectors) from ``document``.

The default hashes words into a fixed number of columns. ``model_encoder`` runs any other model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, IDF, IDFModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions.text import squeeze
from tonearm.functions.vectors import l2_normalise

WIDTH = 384
Encoder = Callable[[DataFrame], DataFrame]


def document_words(document: str):
    return F.filter(F.split(F.lower(squeeze(F.col(document))), " "), lambda w: w != "")


def hashing_encoder(width: int = WIDTH, idf: IDFModel | None = None, document: str = "document",
                    embedding: str = "embedding") -> Encoder:
    """Hashed word counts, weighted by ``idf`` when given, scaled to length 1."""
    tf = HashingTF(numFeatures=width, inputCol="_words", outputCol="_tf")
    unit = Normalizer(inputCol="_idf" if idf else "_tf", outputCol="_unit")

    def encode(df: DataFrame) -> DataFrame:
        out = tf.transform(df.withColumn("_words", document_words(document)))
        if idf:
            out = idf.setInputCol("_tf").setOutputCol("_idf").transform(out)
        out = unit.transform(out).withColumn(embedding, vector_to_array("_unit", "float32"))
        return out.drop("_words", "_tf", "_idf", "_unit")

    return encode


def counting_encoder(vocabulary: list[str], document: str = "document",
                     embedding: str = "embedding") -> Encoder:
    """How often each word of a given list occurs, scaled to length 1; zeros where none does."""
    def encode(df: DataFrame) -> DataFrame:
        # a column of its own: the text is split once, not once for each word of the list
        split = df.withColumn("_words", document_words(document))
        counts = F.array(*[F.size(F.filter("_words", F.lit(w).eqNullSafe)).cast("double")
                           for w in vocabulary])
        return l2_normalise(split.withColumn(embedding, counts).drop("_words"), embedding).withColumn(
            embedding, F.col(embedding).cast("array<float>"))

    return encode


def fit_idf(documents: DataFrame, width: int = WIDTH, document: str = "document") -> IDFModel:
    """Word weights of a corpus; one pass, ``width`` numbers come back."""
    tf = HashingTF(numFeatures=width, inputCol="_words", outputCol="_tf")
    return IDF(inputCol="_tf", outputCol="_idf").fit(
        tf.transform(documents.withColumn("_words", document_words(document))))


def model_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]],
                  document: str = "document", embedding: str = "embedding") -> Encoder:
    """Encode with a model: ``load()`` runs once per task and returns texts -> matrix."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            m = np.asarray(model(texts.tolist()), dtype=np.float64)
            m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-10
            yield pd.Series(list(m.astype(np.float32)))

    return lambda df: df.withColumn(embedding, run(document))
