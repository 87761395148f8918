"""Search of the stored catalogue for a table of queries, and genre enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.operators.inverted import CatalogueIndex, build_catalogue_index, search_index

SEED_LIMIT = 20
CANDIDATE_LIMIT = 30


def with_genres(tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """Tracks without genres take those of their first artist, if it is known."""
    known = artists.select(F.col("artist_id").alias("_artist"), F.col("genres").alias("_genres"))
    none = F.array().cast("array<string>")
    return tracks.withColumn("_artist", F.get("artist_ids", F.lit(0))) \
        .join(known, "_artist", "left") \
        .withColumn("genres", F.when(F.size("genres") > 0, F.col("genres"))
                    .otherwise(F.coalesce("_genres", none))) \
        .drop("_artist", "_genres")


def search_catalogue(searches: DataFrame, catalogue: DataFrame | CatalogueIndex,
                     limit: int) -> DataFrame:
    """(kind, text, rank, id) of the best ``limit`` items for each distinct search.

    ``catalogue`` is a stored index, or the items themselves, which are then indexed first; whoever
    searches them more than once builds the index once. See ``inverted.search_index``.
    """
    index = catalogue if isinstance(catalogue, CatalogueIndex) else build_catalogue_index(catalogue)
    return search_index(searches, index, limit)
