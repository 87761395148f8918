"""Usage metrics from an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_metrics(events: DataFrame, name: str, duration: str, ok: Column,
                  cached: Column | None = None) -> DataFrame:
    """Per function: calls, mean duration, success rate and, if known, cache hit rate."""
    extra = [] if cached is None else [F.avg(cached.cast("int")).alias("cache_hit_rate")]
    return events.groupBy(name).agg(
        F.count(F.lit(1)).alias("calls"), F.avg(duration).alias("mean_duration"),
        F.avg(ok.cast("int")).alias("success_rate"), *extra)


def click_through(events: DataFrame, by: list[str], kind: str = "event_type") -> DataFrame:
    """Clicks per view."""
    counted = events.groupBy(*by).agg(
        F.count_if(F.col(kind) == "view").alias("views"),
        F.count_if(F.col(kind) == "click").alias("clicks"))
    return counted.withColumn("ctr", F.try_divide(F.col("clicks").cast("double"), F.col("views")))


def popular_searches(queries: DataFrame, query: str, top: int = 10) -> DataFrame:
    """The most frequent queries, ties in alphabetical order."""
    return queries.groupBy(query).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("n").desc(), query).limit(top)


# Queries that the sketch of an hour keeps.
KEPT = 1000


def search_sketch(searches: DataFrame, query: str, ts: str, kept: int = KEPT) -> DataFrame:
    """(hour, query, n, missed): the most frequent queries of each hour, ties in alphabetical order.

    ``missed`` is how often a query of that hour that is not listed can have been asked at most: the
    count of the first one left out, or 0. An hour has at most ``kept`` rows however many queries it had,
    so a store of hours grows with time, not with what was asked. Searches without a text or time
    don't count.
    """
    hour = F.date_trunc("hour", F.col(ts)).alias("hour")
    counted = searches.where(F.col(query).isNotNull() & F.col(ts).isNotNull()) \
        .groupBy(hour, F.col(query).alias("query")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("hour").orderBy(F.desc("n"), "query"))
    # ranks beyond the first one left out are dropped before rows move
    ranked = counted.withColumn("rank", rank).where(F.col("rank") <= kept + 1)
    missed = F.sum(F.when(F.col("rank") == kept + 1, F.col("n")).otherwise(0)).over(
        Window.partitionBy("hour"))
    return ranked.withColumn("missed", missed).where(F.col("rank") <= kept).drop("rank")


def merged_sketch(sketch: DataFrame) -> DataFrame:
    """(query, n, listed, missed) of any set of hours, which can be merged on in any order.

    ``n`` is how often a query was counted, ``listed`` and ``missed`` the sums of ``missed`` over the hours
    that list it and over all hours.
    """
    if "listed" in sketch.columns:
        parts = sketch.select("query", "n", "listed", F.col("missed").alias("every"))
    else:
        hours = sketch.groupBy("hour").agg(F.max("missed").alias("missed"))
        parts = sketch.select("query", "n", F.col("missed").alias("listed"), F.lit(0).cast("bigint").alias("every")) \
            .unionByName(hours.select(F.lit(None).cast("string").alias("query"), F.lit(0).cast("bigint").alias("n"),
                                      F.lit(0).cast("bigint").alias("listed"), F.col("missed").alias("every")))
    # the row without a query carries what all hours missed
    return parts.groupBy("query").agg(F.sum("n").alias("n"), F.sum("listed").alias("listed"),
                                      F.sum("every").alias("missed"))


def popular_in_sketch(sketch: DataFrame, top: int = 10) -> DataFrame:
    """(query, n, bound): the most frequent queries; each was asked ``n`` to ``n + bound`` times, and a
    query that is not in the sketch at most as often as all hours missed together."""
    merged = sketch if "listed" in sketch.columns else merged_sketch(sketch)
    missed = merged.where("query IS NULL").first()
    return merged.where("query IS NOT NULL").select(
        "query", "n", (F.lit(missed.missed if missed else 0) - F.col("listed")).alias("bound")) \
        .orderBy(F.col("n").desc(), "query").limit(top)
