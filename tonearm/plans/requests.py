"""From lines of free text to ranked tracks, for a table of requests.

Everything up to the ranking depends on what a request means, not on who sent it. So requests
are reduced to distinct *needs* first, and results are joined back at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions.scoring import genre_jaccard_score, multi_signal_score
from tonearm.functions.text import (
    candidate_searches, normalise_title, parse_request, seed_searches,
)
from tonearm.operators.catalogue import CANDIDATE_LIMIT, SEED_LIMIT, search_catalogue
from tonearm.operators.inverted import CatalogueIndex, build_catalogue_index
from tonearm.operators.ranking import (
    artist_cap, dedup_first, diverse_first, first_non_empty, top_per,
)
from tonearm.session import written

# fixed values: ranker names and their short forms for file names
MODELS = {"multi-signal": "MultiSignal", "genre-jaccard": "GenreJaccard", "two-tower": "TwoTower"}
DEFAULT_MODEL = "multi-signal"
N_SEEDS = 3
TRACK_COLUMNS = ["id", "name", "artists", "artist_ids", "album", "release_date", "popularity",
                 "duration_ms", "explicit", "external_urls", "preview_url", "genres"]


RANKED = ["need", "rank", "id", "similarity_score"]


def parse(requests: DataFrame) -> DataFrame:
    """Adds ``parsed`` and ``need``, a digest of what was parsed: a key of fixed length."""
    parsed = parse_request(requests)
    return parsed.withColumn("need", F.sha2(F.to_json("parsed"), 256))


def distinct_needs(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("need").agg(F.first("parsed").alias("parsed"))


def find_seeds(needs: DataFrame, catalogue: DataFrame, n_seeds: int = N_SEEDS,
               index: CatalogueIndex | None = None):
    """(seeds, failed): up to n seeds per need, and needs without any with the reason.

    Seeds come from the first search that finds something. Copies of a title by one artist
    count once, the most popular; different artists come first.
    """
    listed = needs.withColumn("searches", seed_searches())
    asked = listed.select("need", F.posexplode("searches").alias("priority", "q")) \
        .select("need", "priority", "q.kind", "q.text")
    found = search_catalogue(asked, index or catalogue, SEED_LIMIT)
    tracks = found.join(catalogue.select(*TRACK_COLUMNS), "id")
    artist = F.lower(F.coalesce(F.get("artists", F.lit(0)), F.lit("")))
    titled = tracks.withColumn("artist", artist).withColumn("title", normalise_title(F.col("name")))
    # results are already most popular first, so the first copy is the most popular one
    unique = dedup_first(titled, ["kind", "text", "title", "artist"], "rank")
    chosen = diverse_first(unique.withColumnRenamed("rank", "place"), ["kind", "text"], "artist",
                           "place", n_seeds)
    seeds = first_non_empty(
        asked.join(chosen.drop("artist", "title", "place"), ["kind", "text"]),
        ["need"], "priority").drop("priority", "kind", "text")
    failed = listed.join(seeds.select("need").distinct(), "need", "left_anti").select(
        "need", F.when(F.size("searches") == 0, "no search terms").otherwise("no search results")
        .alias("error"))
    return seeds, failed


def seed_context(needs: DataFrame, seeds: DataFrame, artists: DataFrame) -> DataFrame:
    """One row per need that has seeds: their ids, genres, first artists' ids and names."""
    lead = F.get("artist_ids", F.lit(0))
    names = artists.select(F.col("artist_id").alias("_lead"), F.lower("name").alias("_name"))
    per_need = (
        seeds.withColumn("_lead", lead).join(names, "_lead", "left")
        .groupBy("need").agg(
            # a need has n_seeds seeds at most, so these lists stay short
            F.collect_set("id").alias("seed_ids"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("genres"))))
            .alias("seed_genres"),
            F.collect_set("_name").alias("seed_artists"),
            F.array_distinct(F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "_lead"))), lambda s: s["_lead"]))
            .alias("seed_artist_ids")))
    return needs.join(per_need, "need")


def find_candidates(context: DataFrame, catalogue: DataFrame,
                    index: CatalogueIndex | None = None) -> DataFrame:
    """(need, id, seq, what scoring needs of the track and the context), without the seeds.

    ``seq`` is the place at which a track was first found. Track columns are joined to the few
    results of each distinct search, not to every need's copy of them; rows then move once, by
    need, and everything up to the final ranking happens there.
    """
    asked = context.select("need", F.posexplode(candidate_searches()).alias("priority", "q")) \
        .select("need", "priority", "q.kind", "q.text")
    found = search_catalogue(asked, index or catalogue, CANDIDATE_LIMIT) \
        .join(catalogue.select("id", *_SCORED), "id")
    hits = asked.join(found, ["kind", "text"]).select(
        "need", "id", (F.col("priority") * 1000 + F.col("rank")).alias("seq"), *_SCORED)
    if dict(hits.dtypes)["id"] == "string":
        hits = hits.filter(F.col("id") != "")
    first = top_per(hits.repartition("need"), ["need", "id"], "seq", 1, "_rn").drop("_rn")
    known = context.select("need", "seed_ids", "seed_genres", "seed_artists",
                           "parsed.prefer_recent")
    return first.join(known, "need").filter(~F.array_contains("seed_ids", F.col("id")))


_SCORED = ["artists", "genres", "popularity", "release_date"]


def by_seed_artist():
    """Whether any of a track's artists is a seed's first artist."""
    return F.coalesce(
        F.arrays_overlap(F.transform("artists", F.lower), F.col("seed_artists")), F.lit(False))


def _score_order():
    return [F.col("similarity_score").desc(), F.col("seq")]


def rank_multi_signal(candidates: DataFrame, n: int = 20, max_per_artist: int = 2) -> DataFrame:
    """(need, rank, id, similarity_score) by genre overlap, popularity and recency, minus a
    penalty for the seeds' own artists; at most ``max_per_artist`` per first artist."""
    scored = candidates.withColumn("similarity_score", multi_signal_score(
        F.col("seed_genres"), F.col("genres"), F.col("popularity"), F.col("release_date"),
        F.col("prefer_recent"), by_seed_artist()))
    narrow = scored.select("need", "id", "seq", "similarity_score", "artists")
    capped = artist_cap(narrow, ["need"], _score_order(), max_per_artist)
    return top_per(capped, "need", _score_order(), n).select(*RANKED)


def rank_genre_jaccard(candidates: DataFrame, n: int = 20) -> DataFrame:
    """(need, rank, id, similarity_score) by genre overlap and popularity only, without a cap."""
    scored = candidates.withColumn("similarity_score", genre_jaccard_score(
        F.col("seed_genres"), F.col("genres"), F.col("popularity")))
    return top_per(scored, "need", _score_order(), n).select(*RANKED)


def find_recommendations(
    requests: DataFrame, catalogue: DataFrame, artists: DataFrame, *, n: int = 20,
    n_seeds: int = N_SEEDS, model_key: str = DEFAULT_MODEL, two_tower=None,
    models_path: str | None = None, index: CatalogueIndex | None = None,
) -> dict[str, DataFrame]:
    """Seeds and ranked tracks for every request.

    Returns ``requests`` (parsed), ``context`` (per need), ``seeds`` and ``picks`` (per need,
    with ``rank``), and ``failed`` (per need). An unknown model means the default one.
    ``two_tower`` is the pair of towers and item embeddings (a table, or the path of a stored cell
    index) for that model, or ``models_path`` names stored models; with neither, or nothing stored
    there, the default ranker answers. ``index`` is the catalogue's stored index; without one it is
    built for this call.
    """
    index = index or build_catalogue_index(catalogue)
    if model_key == "two-tower" and two_tower is None and models_path is not None:
        from tonearm.plans.models import load

        models = load(requests.sparkSession, models_path)
        if models is not None:
            two_tower = (models.towers, models.index_path)
    parsed = written(parse(requests), "requests")
    # what follows reads these tables several times; writing them keeps each step one job
    needs = written(distinct_needs(parsed), "needs")
    seeds, failed = find_seeds(needs, catalogue, n_seeds, index)
    seeds = written(seeds, "seeds")
    context = written(seed_context(needs, seeds, artists), "context")
    if model_key == "genre-jaccard":
        picks = rank_genre_jaccard(find_candidates(context, catalogue, index), n)
    elif model_key == "two-tower" and two_tower is not None:
        from tonearm.plans.two_tower_rank import rank_two_tower

        picks = rank_two_tower(seeds, context, catalogue, *two_tower, n=n, index=index)
    else:
        picks = rank_multi_signal(find_candidates(context, catalogue, index), n)
    picks = picks.join(catalogue.select(*TRACK_COLUMNS), "id")
    return {"requests": parsed, "context": context, "seeds": seeds, "picks": picks,
            "failed": failed}


def per_request(found: dict[str, DataFrame], what: str) -> DataFrame:
    """Rows of ``seeds``, ``picks`` or ``failed`` joined back to the requests.

    Both sides are stored tables, so that Spark can split a need that very many requests share.
    """
    return found["requests"].select("request_id", "need").join(written(found[what], what), "need")
