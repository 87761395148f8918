"""The item store: a folder of Parquet files with text documents and embeddings.

Adding items appends files; files once written are not changed. ``compact_store`` writes the items
to a new folder in fewer files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.quality import REQUIRED, check_table
from tonearm.functions.text import text_document
from tonearm.schemas import ALL_FEATURES, STORED_ITEM
from tonearm.session import written
from tonearm.sources.preferences import path_exists


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """All stored items; a store that does not exist yet is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], STORED_ITEM)
    return spark.read.schema(STORED_ITEM).parquet(path)


def new_items(incoming: DataFrame, stored: DataFrame, small: bool = False) -> DataFrame:
    """Incoming rows whose id is not stored yet.

    For a ``small`` batch the stored ids are first reduced to those it brings again: the batch,
    if small enough, is sent to the store's ids and these are scanned but never shuffled.
    """
    ids = stored.select("id")
    if small:
        ids = ids.join(incoming.select("id"), "id", "left_semi")
    return incoming.join(ids, "id", "left_anti")


def stored_columns(df: DataFrame) -> DataFrame:
    """Item rows in the store's shape: counts default to 0, absent features stay NULL."""
    have = df.columns

    def col(name, kind, default=None):
        c = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return (c if default is None else F.coalesce(c, F.lit(default))).alias(name)

    return df.select(
        F.col("id").cast("string").alias("id"),
        text_document(have).alias("document"),
        col("name", "string"), col("artists", "array<string>"), col("album", "string"),
        col("release_date", "string"),
        col("popularity", "bigint", 0), col("duration_ms", "bigint", 0),
        col("external_urls", "string", ""), col("preview_url", "string", ""),
        *[col(f, "double") for f in ALL_FEATURES])


def add_items(incoming: DataFrame, path: str, encoder) -> bool:
    """Store the new rows of ``incoming``; False when it is empty, True otherwise.

    ``encoder`` adds an ``embedding`` column from ``document``.
    """
    incoming = written(incoming, "incoming")  # computed once for the checks and the store
    if incoming.isEmpty():
        return False
    check_table(incoming, REQUIRED)
    fresh = new_items(incoming, open_store(incoming.sparkSession, path))
    rows = encoder(stored_columns(fresh)).select(*[f.name for f in STORED_ITEM.fields])
    rows.write.mode("append").parquet(path)
    return True


def compact_store(spark: SparkSession, path: str, target: str, files: int) -> None:
    """Write the items of a store to ``files`` files of a new one."""
    open_store(spark, path).repartition(files).write.mode("overwrite").parquet(target)


def lookup(ids: DataFrame, items: DataFrame) -> DataFrame:
    """Items for a table of ids in one join; unknown ids give no row."""
    return ids.select("id").join(items, "id")


def store_stats(items: DataFrame, location: str, name: str = "items") -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("total_tracks")).select(
        "total_tracks", F.lit(location).alias("location"), F.lit(name).alias("name"))


def clear_store(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], STORED_ITEM).write.mode("overwrite").parquet(path)
