"""Ratings: last value per user and track, and the nested JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.schemas import PREFERENCES_JSON


def latest_ratings(events: DataFrame) -> DataFrame:
    """One row per (user_id, track_id): the rating with the greatest (ts, seq).

    An aggregate, not a window: each task keeps one row per key before the shuffle.
    """
    return events.groupBy("user_id", "track_id").agg(
        F.max(F.struct("ts", "seq", "rating")).alias("last")
    ).select("user_id", "track_id", "last.rating", "last.ts", "last.seq")


def save_preferences(ratings: DataFrame, path: str, max_entries: int = 100_000) -> None:
    """Write JSON lines ``{user: {track: rating}}``.

    A user with more than ``max_entries`` ratings gets several lines, so that no row or task
    ever holds all of a very active user's ratings; reading them back gives the same table.
    """
    r = ratings.select(
        F.col("user_id").cast("string"), F.col("track_id").cast("string"), "rating")
    parts = r.groupBy("user_id").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(max_entries)).alias("parts"))
    per_line = (
        r.join(parts, "user_id")
        .withColumn("part", F.pmod(F.xxhash64("track_id"), F.col("parts")))
        .groupBy("user_id", "part")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("track_id", "rating"))))
             .alias("tracks"))
    )
    per_line.select(F.to_json(F.create_map("user_id", "tracks")).alias("value")) \
        .write.mode("overwrite").text(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_preferences(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """(user_id, track_id, rating) from nested JSON; a missing path gives no rows.

    ``whole_file`` reads files that hold one object over many lines, as other tools write them.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], "user_id string, track_id string, rating double")
    return (
        spark.read.text(path, wholetext=whole_file)
        .select(F.explode(F.from_json("value", PREFERENCES_JSON)).alias("user_id", "tracks"))
        .select("user_id", F.explode("tracks").alias("track_id", "rating"))
    )
