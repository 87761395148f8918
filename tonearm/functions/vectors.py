"""Vector columns."""

from __future__ import annotations

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.schemas import FEATURES


def model_vector(names: list[str] = FEATURES) -> Column:
    """Feature vector for the models: an absent feature counts as 0."""
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in names])


def distance_vector(names: list[str] = FEATURES) -> Column:
    """Feature vector for distances: an absent feature is NaN and adds nothing."""
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in names])


def l2_normalise(df: DataFrame, vec: str) -> DataFrame:
    """Scale a vector column to length 1; a zero vector stays zero."""
    as_vector = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    return Normalizer(p=2.0, inputCol="_v", outputCol="_unit").transform(as_vector) \
        .withColumn(vec, vector_to_array("_unit")).drop("_v", "_unit")
