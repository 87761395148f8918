"""Ranked windows: top n per group, dedup, artist cap, diverse seeds, first non-empty query.

Every order ends in a unique column, so results never depend on partitioning. Filters on
``row_number`` let Spark keep only the needed rows per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names: str | Column | list) -> list:
    return names if isinstance(names, list) else [names]


def top_per(df: DataFrame, by, order, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of every group in ``order``, numbered from 1."""
    w = Window.partitionBy(*_cols(by)).orderBy(*_cols(order))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def dedup_last(df: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Last row per key, at the position of the first: ``seq`` becomes the smallest one."""
    return _dedup(df, key, seq, F.max)


def dedup_first(df: DataFrame, key: str | list[str] = "id", seq: str = "seq") -> DataFrame:
    """First row per key."""
    return _dedup(df, key, seq, F.min)


def _dedup(df, key, seq, pick):
    # an aggregate, so that copies of one key are merged in each task before the shuffle
    keys = _cols(key)
    rest = [c for c in df.columns if c not in keys]
    whole = F.struct(F.col(seq).alias("_at"), *rest)
    merged = df.groupBy(*keys).agg(pick(whole).alias("_row"), F.min(seq).alias("_first"))
    return merged.select(*[
        F.col(c) if c in keys else
        F.col("_first").alias(c) if c == seq else F.col(f"_row.{c}")
        for c in df.columns])


def dedup_popular(df: DataFrame, keys: list[str], popularity: str = "popularity",
                  seq: str = "seq") -> DataFrame:
    """Most popular row per key, earliest first among equals."""
    return top_per(df, keys, [F.col(popularity).desc(), F.col(seq)], 1, "_rn").drop("_rn")


def artist_cap(df: DataFrame, group: list[str], order: list, max_per_artist: int = 2,
               artists: str = "artists") -> DataFrame:
    """At most ``max_per_artist`` rows per group and first artist, best in ``order`` first."""
    primary = F.lower(F.coalesce(F.get(F.col(artists), F.lit(0)), F.lit("unknown")))
    return top_per(df.withColumn("_artist", primary), group + ["_artist"], order,
                   max_per_artist, "_rn").drop("_rn", "_artist")


def diverse_first(df: DataFrame, group: list[str], artist: str, pos: str, n: int) -> DataFrame:
    """n rows per group in ``pos`` order: first of each artist, then the remaining ones."""
    nth = F.row_number().over(Window.partitionBy(*group, artist).orderBy(pos))
    # at most n per artist can ever be used
    few = df.withColumn("_nth", nth).filter(F.col("_nth") <= n)
    return top_per(few, group, [F.col("_nth") > 1, F.col(pos)], n).drop("_nth")


def first_non_empty(df: DataFrame, group: list[str], priority: str) -> DataFrame:
    """Rows of the lowest priority number present in each group."""
    best = df.groupBy(*group).agg(F.min(priority).alias("_best"))
    return df.join(best, group).filter(F.col(priority) == F.col("_best")).drop("_best")
