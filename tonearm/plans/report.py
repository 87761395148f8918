"""The tables behind a recommendation report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions.scoring import (
    duration_text, is_recent, score_colour, score_percent,
)
from tonearm.functions.text import slug
from tonearm.operators.ranking import top_per
from tonearm.plans.requests import MODELS


def report_totals(context: DataFrame, picks: DataFrame, by: str = "need") -> DataFrame:
    """Seeds, picks, distinct seed genres and mean popularity of the picks, rounded half to even."""
    chosen = picks.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_recommendations"),
        F.bround(F.avg("popularity")).cast("bigint").alias("mean_popularity"))
    return context.select(by, F.size("seed_ids").alias("n_seeds"),
                          F.size("seed_genres").alias("n_genres")) \
        .join(chosen, by, "left").na.fill(0, ["n_recommendations", "mean_popularity"])


def report_cards(tracks: DataFrame, by: str = "need", seeds: bool = False) -> DataFrame:
    """One card per track: rank label, texts, badges and up to five genres.

    Seeds carry no score badge.
    """
    percent = F.lit(None).cast("double") if seeds else score_percent(F.col("similarity_score"))
    colour = F.lit(None).cast("string") if seeds else score_colour(F.col("similarity_score"))
    label = F.lit("SEED") if seeds else F.concat(F.lit("#"), F.col("rank").cast("string"))
    return tracks.select(
        by, F.col("rank").cast("int").alias("rank"), label.alias("label"), "id", "name",
        F.array_join("artists", ", ").alias("artists"), "album",
        duration_text(F.col("duration_ms")).alias("duration"), "popularity",
        F.bround(percent).cast("int").alias("percent"), colour.alias("colour"),
        is_recent(F.col("release_date")).alias("is_new"), "explicit", "external_urls",
        "preview_url",
        F.when(F.size("genres") > 0, F.array_join(F.slice("genres", 1, 5), ", ")).otherwise("-")
        .alias("genres"))


def report_genres(picks: DataFrame, by: str = "need", top: int = 8) -> DataFrame:
    """Genre histogram: the first two genres of each pick, ties by first appearance."""
    each = picks.select(by, "rank", F.posexplode(F.slice("genres", 1, 2)).alias("pos", "genre"))
    counts = each.groupBy(by, "genre").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "pos")).alias("first"))
    return top_per(counts, by, [F.col("n").desc(), F.col("first")], top, "place").select(
        by, F.col("place").cast("int").alias("place"), "genre", "n")


def report_signals(context: DataFrame, by: str = "need") -> DataFrame:
    """What was understood: named genres, mood, recency, keyword, and up to five seed genres."""
    return context.select(
        by,
        F.array_join(F.slice("parsed.genre_queries", 1, 3), " · ").alias("genres"),
        F.col("parsed.mood_terms").alias("mood"),
        F.col("parsed.prefer_recent").alias("prefer_recent"),
        F.col("parsed.keyword").alias("keyword"),
        F.when(F.size("seed_genres") > 0, F.array_join(
            F.slice(F.array_sort("seed_genres"), 1, 5), ", ")).otherwise("-")
        .alias("seed_genres"))


def report_name(text, keyword, model_key: str):
    """``<model>_<slug>``: the slug of the keyword, or of the whole text without one."""
    subject = F.when(F.coalesce(keyword, F.lit("")) != "", keyword).otherwise(text)
    return F.concat(F.lit(MODELS[model_key] + "_"), slug(subject))


def write_report(found: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """All report tables of ``find_recommendations`` under one folder."""
    tables = {
        "totals": report_totals(found["context"], found["picks"]),
        "seed_cards": report_cards(found["seeds"], seeds=True),
        "cards": report_cards(found["picks"]),
        "genres": report_genres(found["picks"]),
        "signals": report_signals(found["context"]),
        "requests": found["requests"].select("request_id", "text", "need"),
        "failed": found["failed"],
    }
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).save(f"{path}/{name}")
