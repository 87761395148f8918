"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions import quality as Q
from tonearm.functions import text as TX
from tonearm.functions.predicates import where
from tonearm.functions.scoring import array_jaccard
from tonearm.operators import encoder as E
from tonearm.operators import networks as N
from tonearm.operators import proxy as PX
from tonearm.operators import ranking as K
from tonearm.operators import training
from tonearm.operators.catalogue import search_catalogue, with_genres
from tonearm.operators.index import (
    add_to_index, build_index, encode_vectors, remove_from_index, search_index, split_cells,
)
from tonearm.operators.inverted import build_catalogue_index, open_catalogue_index
from tonearm.operators.meaning import fit_word_vectors, meaning_encoder
from tonearm.operators.nearest import nearest
from tonearm.operators.neighbours import top_neighbours
from tonearm.plans import metrics as M
from tonearm.plans import models as MD
from tonearm.plans import recommend as R
from tonearm.plans import report as RP
from tonearm.plans import requests as P
from tonearm.plans import two_stage as TS
from tonearm.plans.given import GIVEN_CENTRES, GIVEN_RANKER, GIVEN_TOWERS, GIVEN_WORDS
from tonearm.plans.profiles import user_profiles
from tonearm.plans.search import search_text
from tonearm.schemas import FEATURES, RAW_ARTIST_TOP
from tonearm.session import compute_partitions, shared_folder, written
from tonearm.sources import landing, store
from tonearm.sources import testbed as tb
from tonearm.sources.models import load_weights, save_weights
from tonearm.sources.preferences import load_preferences, save_preferences
from tonearm.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    """The ratings table, stored once for queries that read it several times."""
    return written(tb.ratings(spark, sf), "ratings")


def _single(c):
    """A score at single precision, where the order in which it was summed cannot show."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("float").cast("double")


def _shown(df: DataFrame, *scores: str) -> DataFrame:
    """First artist instead of the array, scores at single precision: columns to compare."""
    if "artists" in df.columns:
        df = df.withColumn("artist", F.get("artists", F.lit(0))).drop("artists")
    return df.withColumns({s: _single(s) for s in scores}) if scores else df


# --- ratings, profiles, feature search, recommenders ------------------------------------------

@query
def rating_upsert(spark, sf):
    return tb.ratings(spark, sf)


@query
def user_profile(spark, sf):
    return _shown(user_profiles(tb.ratings(spark, sf), tb.tracks(spark, sf)), *FEATURES)


@query
def store_stats(spark, sf):
    """Size of a store that all parts were added to."""
    path = shared_folder(spark, "items")
    store.add_items(tb.tracks(spark, sf), path, E.hashing_encoder())
    return store.store_stats(store.open_store(spark, path), "part", "tracks")


@query
def audio_feature_search(spark, sf):
    tracks = tb.tracks(spark, sf)
    targets = tracks.groupBy(F.get("artists", F.lit(0)).alias("target_id")).agg(
        *[F.avg(f).alias(f) for f in FEATURES])
    return _shown(R.search_by_features(targets, tracks, 20), "feature_score").drop("artist")


@query
def content_based(spark, sf):
    return _shown(R.content_based(_ratings(spark, sf), tb.tracks(spark, sf), 10),
                  "feature_score")


@query
def top_neighbours_query(spark, sf):
    return _shown(top_neighbours(_ratings(spark, sf)), "similarity")


QUERIES["top_neighbours"] = QUERIES.pop("top_neighbours_query")


@query
def top_neighbours_hot(spark, sf):
    """The same users when half of all tracks count as hot."""
    return _shown(top_neighbours(_ratings(spark, sf), hot_cutoff=30), "similarity")


@query
def collaborative(spark, sf):
    return _shown(R.collaborative(_ratings(spark, sf), tb.tracks(spark, sf), 10),
                  "recommendation_score")


@query
def hybrid(spark, sf):
    return _shown(R.hybrid(_ratings(spark, sf), tb.tracks(spark, sf), 10), "score")


@query
def pick_reasons(spark, sf):
    """Why each collaborative pick was made."""
    ratings, tracks = _ratings(spark, sf), tb.tracks(spark, sf)
    picks = written(R.collaborative(ratings, tracks, 10).select("user_id", "id"), "picks")
    return R.explain(picks, ratings, tracks)


# --- validation and sanitizing -----------------------------------------------------------------

def _listed(errors):
    return F.array_join(errors, "; ").alias("errors")


@query
def validate_tracks(spark, sf):
    return tb.raw_tracks(spark, sf).select("part", _listed(Q.track_errors()))


@query
def validate_features(spark, sf):
    clean = Q.sanitize_features(tb.raw_features(spark, sf))
    return clean.select("id", _listed(Q.feature_errors(clean.columns)))


@query
def validate_ratings(spark, sf):
    rating = F.when(F.col("event_type") == "error", "invalid") \
        .when(F.col("event_type") == "signup", F.concat(F.col("value").cast("string"), F.lit("d"))) \
        .otherwise(F.col("value").cast("string"))
    return tb.table(spark, sf, "events").select("event_id", rating.alias("rating")) \
        .select("event_id", _listed(Q.rating_errors()))


@query
def validate_user_ids(spark, sf):
    ids = tb.table(spark, sf, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("row"),
        F.col("text").alias("user_id"))
    ids = ids.unionByName(tb.table(spark, sf, "events").select(
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("row"),
        F.col("user_id").cast("string").alias("user_id")))
    return ids.select("row", _listed(Q.user_id_errors()))


@query
def validate_queries(spark, sf):
    texts = tb.table(spark, sf, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("row"),
        F.col("text").alias("query"))
    texts = texts.unionByName(tb.raw_tracks(spark, sf).select(
        F.concat(F.lit("part "), F.col("part").cast("string")).alias("row"),
        F.col("name").alias("query")))
    return texts.select("row", _listed(Q.query_errors()))


@query
def validate_source_ids(spark, sf):
    digest = F.md5(F.col("c_name").cast("binary"))
    # 20 to 24 characters, every seventh with an underscore
    made = F.expr("substring(d, 1, 20 + CAST(c_custkey % 5 AS INT))")
    ids = tb.table(spark, sf, "customer").withColumn("d", digest).select(
        "c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.overlay(made, F.lit("_"), F.lit(3)))
        .when(F.col("c_custkey") % 7 == 1, F.concat(F.substring("d", 1, 22), F.lit("\n")))
        .when(F.col("c_custkey") % 7 == 2, F.concat(F.substring("d", 1, 22), F.lit("\r\n")))
        .otherwise(made).alias("playlist_id"))
    return ids.select("c_custkey", "playlist_id", _listed(Q.source_id_errors("playlist_id")))


@query
def sanitize_tracks(spark, sf):
    clean = Q.sanitize_tracks(tb.raw_tracks(spark, sf))
    return clean.select("part", "id", "name", F.array_join("artists", "|").alias("artists"),
                        "album", "popularity", "duration_ms")


@query
def sanitize_features(spark, sf):
    return Q.sanitize_features(tb.raw_features(spark, sf)).drop("type")


@query
def clean_query(spark, sf):
    return tb.table(spark, sf, "documents").select(
        "doc_id", TX.clean_query(F.col("text")).alias("query"))


# --- text --------------------------------------------------------------------------------------

@query
def normalize_title(spark, sf):
    return tb.table(spark, sf, "documents").select(
        "doc_id", TX.normalise_title(F.col("text")).alias("title"))


@query
def slug(spark, sf):
    return tb.table(spark, sf, "documents").select(
        "doc_id", TX.slug(F.col("text")).alias("slug"))


@query
def text_document(spark, sf):
    tracks = tb.tracks(spark, sf)
    return tracks.select("id", TX.text_document(tracks.columns).alias("document"))


# --- collection, dedup, store ------------------------------------------------------------------

def _landing(spark, sf):
    return tb.write_landing(spark, sf, shared_folder(spark, "landing"))


def _flat(pair):
    """The tracks, and the text of each answer that was refused."""
    cols = ["id", "name", "artists", "album", "release_date", "popularity", "duration_ms",
            "external_urls"]
    tracks = pair[0].withColumn("artists", F.array_join("artists", "|")).select(*cols)
    refused = pair[1].where("record IS NOT NULL").select(F.col("record").alias("refused"))
    return tracks.unionByName(refused, allowMissingColumns=True)


@query
def flatten_search(spark, sf):
    return _flat(landing.search_results(spark, _landing(spark, sf)["search"]))


@query
def flatten_playlist(spark, sf):
    return _flat(landing.playlist_tracks(spark, _landing(spark, sf)["playlist"]))


@query
def flatten_artist_top(spark, sf):
    return _flat(landing.artist_top_tracks(spark, _landing(spark, sf)["artist"]))


@query
def normalise_raw(spark, sf):
    raw = landing.read_landing(spark, _landing(spark, sf)["artist"], RAW_ARTIST_TOP)
    out = raw.where("NOT broken").select(F.explode("tracks").alias("t")).select(*landing.report_track())
    return out.select("id", "name", F.array_join("artist_ids", "|").alias("artist_ids"), "album",
                      "popularity", "duration_ms", "explicit", "external_urls",
                      F.size("genres").alias("n_genres"))


@query
def read_features(spark, sf):
    valid, bad = landing.track_features(spark, _landing(spark, sf)["features"])
    cols = ["id", "danceability", "energy", "valence", "tempo", "time_signature"]
    return valid.select(*cols, F.lit(True).alias("ok"), F.lit(None).cast("string").alias("refused")) \
        .unionByName(bad.select(*cols, F.lit(False).alias("ok"), F.col("record").alias("refused")))


@query
def track_analysis(spark, sf):
    """The opaque JSON of each event, kept as VARIANT; errors have none, signups also a cut line."""
    path = shared_folder(spark, "analysis")
    events = tb.table(spark, sf, "events").withColumn("id", F.col("event_id").cast("string"))
    events.filter(F.col("event_type") != "error").select(F.to_json(F.struct(
        "id", F.from_json("props", "k int").alias("analysis"))).alias("value")).write.text(path)
    events.filter(F.col("event_type") == "signup").select(F.concat(
        F.lit(tb.CUT["analysis"]), "id").alias("value")).write.mode("append").text(path)
    found, bad = landing.track_analysis(spark, events, path)
    return found.select("id", F.try_variant_get("analysis", "$.k", "int").alias("k")).unionByName(
        bad.select(F.col("record").alias("refused")), allowMissingColumns=True)


@query
def collect_tracks(spark, sf):
    at = _landing(spark, sf)
    sources = [landing.search_results(spark, at["search"])[0],
               landing.playlist_tracks(spark, at["playlist"])[0],
               landing.artist_top_tracks(spark, at["artist"])[0]]
    features, _ = landing.track_features(spark, at["features"])
    return landing.collect_tracks(sources, features).select(
        "id", "name", "popularity", F.col("seq.source").alias("first_source"), "danceability",
        "tempo")


@query
def dedup_last(spark, sf):
    events = tb.table(spark, sf, "events").withColumnRenamed("event_id", "seq")
    return K.dedup_last(events, ["user_id", "event_type"])


@query
def dedup_first(spark, sf):
    events = tb.table(spark, sf, "events").withColumnRenamed("event_id", "seq")
    return K.dedup_first(events, ["user_id", "event_type"])


@query
def dedup_title(spark, sf):
    tracks = tb.tracks(spark, sf).select(
        "id", TX.normalise_title(F.col("name")).alias("title"),
        F.lower(F.get("artists", F.lit(0))).alias("artist"), "popularity")
    return K.dedup_popular(tracks, ["title", "artist"], seq="id")


@query
def left_join_features(spark, sf):
    tracks = Q.sanitize_tracks(tb.raw_tracks(spark, sf)).select("id", "name", "duration_ms")
    # feature rows bring a duration of their own; the track's is kept
    features = Q.sanitize_features(tb.raw_features(spark, sf)) \
        .withColumn("duration_ms", F.lit(-1))
    return landing.attach_features(tracks, features).select(
        "id", "name", "duration_ms", "danceability", "tempo", "type")


@query
def artist_cap(spark, sf):
    return _shown(K.artist_cap(tb.tracks(spark, sf).select("id", "album", "artists", "popularity"),
                               ["album"], [F.col("popularity").desc(), F.col("id")]))


@query
def diverse_seeds(spark, sf):
    tracks = tb.tracks(spark, sf).select(
        "id", "album", F.lower(F.get("artists", F.lit(0))).alias("artist"),
        F.struct((-F.col("popularity")).alias("p"), "id").alias("pos"))
    return K.diverse_first(tracks, ["album"], "artist", "pos", 3).drop("pos") \
        .withColumn("rank", F.col("rank").cast("int"))


@query
def ingest_new(spark, sf):
    tracks = tb.tracks(spark, sf)
    stored = tracks.filter(F.col("popularity") <= 50)
    return store.new_items(tracks, stored).select("id", "name", "popularity")


@query
def add_items(spark, sf):
    """Half the catalogue first, then all of it: the second call stores only what is missing."""
    path = shared_folder(spark, "items")
    tracks = tb.tracks(spark, sf)
    encode = E.hashing_encoder()
    store.add_items(tracks.filter(F.col("popularity") <= 50), path, encode)
    store.add_items(tracks, path, encode)
    return store.open_store(spark, path).select(
        "id", "document", F.size("embedding").alias("width"), "popularity", "duration_ms",
        F.array_join("artists", "|").alias("artists"), "acousticness", "preview_url")


@query
def add_items_counted(spark, sf):
    """Stored embeddings, component by component, of an encoder that counts given words."""
    path = shared_folder(spark, "items")
    store.add_items(tb.tracks(spark, sf), path, E.counting_encoder(GIVEN_WORDS))
    return store.open_store(spark, path).select(
        "id", *[_single(F.get("embedding", F.lit(i))).alias(f"e{i}")
                for i in range(len(GIVEN_WORDS))])


@query
def clear_store(spark, sf):
    """A store filled, cleared and filled with other items holds only those."""
    path, tracks = shared_folder(spark, "items"), tb.tracks(spark, sf)
    store.add_items(tracks, path, E.hashing_encoder())
    store.clear_store(spark, path)
    store.add_items(tracks.filter(F.col("popularity") > 50), path, E.hashing_encoder())
    return store.open_store(spark, path).select("id", "name")


@query
def validate_table(spark, sf):
    """Which of the delivered tables may be stored, by column and repeated ids."""
    tracks = tb.tracks(spark, sf).select("id", "name", "artists", "album")
    twice = tracks.join(tb.ratings(spark, sf).select(F.col("track_id").alias("id")), "id")
    found = [(name, _refusal(lambda df=df: Q.check_table(df))) for name, df in (
        ("tracks", tracks), ("rated", twice), ("nameless", tracks.drop("name")),
        ("none", tracks.filter("id < 0")))]
    return spark.createDataFrame(found, "name string, error string")


@query
def validate_n_results(spark, sf):
    """Which numbers of results may be asked for, the parts' sizes taken as numbers."""
    asked = tb.table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") * 40 - 40).cast("bigint").alias("n"))
    return asked.withColumn("accepted", F.size(Q.n_results_errors("n")) == 0)


def _refusal(check):
    try:
        check()
    except ValueError as e:
        return str(e)
    return None


@query
def point_lookup(spark, sf):
    ids = tb.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return store.lookup(ids, tb.tracks(spark, sf)).select("id", "name", "album", "popularity")


@query
def preferences_roundtrip(spark, sf):
    path = shared_folder(spark, "preferences")
    save_preferences(tb.ratings(spark, sf), path)
    return load_preferences(spark, path)


@query
def csv_export(spark, sf):
    path = landing.save_csv(
        tb.tracks(spark, sf).select("id", "name", "artists", "popularity", "tempo"),
        shared_folder(spark, "tracks"))
    return spark.read.schema("id bigint, name string, artists string, popularity bigint, "
                             "tempo double").option("header", True).csv(path) \
        .withColumn("artists", F.array_join(F.from_json("artists", "array<string>"), "|"))


@query
def metadata_filter(spark, sf):
    keep = where({"$or": [
        {"$and": [{"tempo": {"$gte": 100, "$lt": 160}}, {"album": {"$in": ["PROMO", "SMALL"]}}]},
        {"acousticness": {"$gt": 0.9}, "explicit": False},
        {"name": "red ring", "album": {"$nin": ["PROMO"]}}]})
    return tb.tracks(spark, sf).filter(keep).select("id", "name", "album", "tempo")


# --- requests: parsing, seeds, candidates, rankers, report -------------------------------------

def _catalogue(spark, sf):
    return with_genres(tb.tracks(spark, sf), tb.artists(spark, sf))


_CATALOGUES: dict[tuple[str, str], tuple[str, str]] = {}


def _indexed(spark, sf):
    """This application's stored catalogue of a folder of tables, and its index; built at first use."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CATALOGUES:
        items, index = shared_folder(spark, "catalogue"), shared_folder(spark, "catalogue-index")
        _catalogue(spark, sf).write.parquet(items)
        build_catalogue_index(spark.read.parquet(items), index)
        _CATALOGUES[key] = items, index
    items, index = _CATALOGUES[key]
    return spark.read.parquet(items), open_catalogue_index(spark, index)


def _found(spark, sf, **options):
    catalogue, index = _indexed(spark, sf)
    return P.find_recommendations(tb.requests(spark, sf), catalogue, tb.artists(spark, sf),
                                  index=index, **options)


@query
def parse_query(spark, sf):
    return P.parse(tb.requests(spark, sf)).select(
        "request_id", "parsed.keyword",
        F.array_join("parsed.genre_queries", "|").alias("genre_queries"),
        "parsed.mood_terms", "parsed.prefer_recent")


@query
def parse_documents(spark, sf):
    docs = tb.table(spark, sf, "documents")
    return TX.parse_request(docs.select("doc_id", "text")).select(
        "doc_id", "parsed.keyword", F.array_join("parsed.genre_queries", "|")
        .alias("genre_queries"), "parsed.prefer_recent")


@query
def enrich_genres(spark, sf):
    return _catalogue(spark, sf).select("id", F.array_join("genres", "|").alias("genres"))


@query
def catalogue_search(spark, sf):
    parts = tb.table(spark, sf, "part").select(F.lit("text").alias("kind"),
                                               F.col("p_name").alias("text"))
    makers = tb.artists(spark, sf)
    searches = parts.unionByName(makers.select(
        F.lit("genre").alias("kind"), F.explode("genres").alias("text"))) \
        .unionByName(makers.select(F.lit("text").alias("kind"), F.col("name").alias("text")))
    return search_catalogue(searches, _indexed(spark, sf)[1], 30)


@query
def genre_jaccard(spark, sf):
    """Overlap of every track's genres with those of each brand's three most popular tracks."""
    tracks = _catalogue(spark, sf).select(
        "id", F.get("artists", F.lit(0)).alias("brand"), "popularity", "genres")
    seeds = K.top_per(tracks, "brand", [F.col("popularity").desc(), F.col("id")], 3) \
        .groupBy("brand").agg(F.array_distinct(F.flatten(F.collect_list("genres")))
                              .alias("seed_genres"))
    return tracks.join(seeds, "brand").select(
        "id", "brand", _single(array_jaccard(F.col("seed_genres"), F.col("genres")))
        .alias("jaccard"))


@query
def seed_searches(spark, sf):
    listed = P.parse(tb.requests(spark, sf)).withColumn("searches", TX.seed_searches())
    return listed.select("request_id", F.posexplode("searches").alias("priority", "q")) \
        .select("request_id", "priority", "q.kind", "q.text")


@query
def seed_tracks(spark, sf):
    return P.per_request(_found(spark, sf), "seeds").select(
        "request_id", F.col("rank").cast("int").alias("rank"), "id", "name",
        F.array_join("genres", "|").alias("genres"))


@query
def failed_requests(spark, sf):
    return P.per_request(_found(spark, sf), "failed").select("request_id", "error")


@query
def candidate_queries(spark, sf):
    found = _found(spark, sf)
    listed = found["context"].select(
        "need", F.posexplode(TX.candidate_searches()).alias("priority", "q"))
    return found["requests"].select("request_id", "need").join(listed, "need").select(
        "request_id", "priority", "q.kind", "q.text")


def _picks(spark, sf, model_key, **options):
    found = _found(spark, sf, model_key=model_key, **options)
    return P.per_request(found, "picks").select(
        "request_id", F.col("rank").cast("int").alias("rank"), "id", "name",
        "similarity_score")


@query
def multi_signal(spark, sf):
    return _picks(spark, sf, "multi-signal")


@query
def genre_jaccard_rank(spark, sf):
    return _picks(spark, sf, "genre-jaccard")


@query
def report_totals(spark, sf):
    found = _found(spark, sf)
    totals = RP.report_totals(found["context"], found["picks"])
    return found["requests"].select("request_id", "need").join(totals, "need").drop("need")


@query
def report_cards(spark, sf):
    found = _found(spark, sf)
    cards = RP.report_cards(found["picks"])
    return found["requests"].select("request_id", "need").join(cards, "need").drop("need")


@query
def report_seed_cards(spark, sf):
    found = _found(spark, sf)
    cards = RP.report_cards(found["seeds"], seeds=True).drop("percent", "colour")
    return found["requests"].select("request_id", "need").join(cards, "need").drop("need")


@query
def report_genres(spark, sf):
    found = _found(spark, sf)
    chart = RP.report_genres(found["picks"])
    return found["requests"].select("request_id", "need").join(chart, "need").drop("need")


@query
def report_signals(spark, sf):
    found = _found(spark, sf)
    signals = RP.report_signals(found["context"])
    named = found["requests"].select("request_id", "need", RP.report_name(
        F.col("text"), F.col("parsed.keyword"), P.DEFAULT_MODEL).alias("report_name"))
    artists = found["context"].select(
        "need", F.array_join("seed_artist_ids", "|").alias("seed_artist_ids"))
    return named.join(signals, "need").join(artists, "need").drop("need")


# --- vectors -----------------------------------------------------------------------------------

def _vectors(spark, sf):
    return tb.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _ranked(df):
    return df.withColumn("score", _single("score"))


@query
def vector_topk_cosine(spark, sf):
    v = _vectors(spark, sf)
    return _ranked(nearest(v.withColumnRenamed("id", "query_id"), v, 10, "cosine"))


@query
def vector_topk_blocks(spark, sf):
    """The same search when neither side is small: every block of items meets every query."""
    v = _vectors(spark, sf)
    return _ranked(nearest(v.withColumnRenamed("id", "query_id"), v, 10, "cosine",
                           broadcast_cells=64, block_rows=150))


@query
def vector_topk_cells(spark, sf):
    """Nearest vectors by distance when neither side is small: cells around pivots, far ones skipped."""
    v = _vectors(spark, sf)
    return _ranked(nearest(v.withColumnRenamed("id", "query_id"), v, 10, "l2", broadcast_cells=64,
                           block_rows=150))


@query
def vector_topk_few_queries(spark, sf):
    """Nearest vectors to each label's mean, sent to all vectors."""
    v = _vectors(spark, sf)
    means = PX.mean_vector(v, "label").withColumnRenamed("label", "query_id")
    return _ranked(nearest(means, v, 10, "cosine", broadcast_cells=100 * 64))


@query
def audio_feature_search_pruned(spark, sf):
    """Feature search by ranges of tempo, two passes."""
    tracks = tb.tracks(spark, sf)
    targets = tracks.groupBy(F.get("artists", F.lit(0)).alias("target_id")).agg(
        *[F.avg(f).alias(f) for f in FEATURES])
    return _shown(R.search_by_features(targets, tracks, 20, broadcast_cells=8, block_rows=300),
                  "feature_score").drop("artist")


@query
def vector_topk_l2_filtered(spark, sf):
    v = _vectors(spark, sf)
    kept = v.filter(where({"label": {"$in": [1, 3, 5, 7]}}))
    return _ranked(nearest(v.withColumnRenamed("id", "query_id"), kept, 10, "l2"))


def _index(spark, sf, **options):
    path = shared_folder(spark, "index")
    build_index(_vectors(spark, sf), path, vec="vec", **options)
    return path


@query
def index_search(spark, sf):
    q = _vectors(spark, sf).withColumnRenamed("id", "query_id")
    return _ranked(search_index(q, spark, _index(spark, sf), 10))


@query
def ivf_search_all_cells(spark, sf):
    """With every cell probed the cell index must agree with the exact search."""
    q = _vectors(spark, sf).withColumnRenamed("id", "query_id")
    return _ranked(search_index(q, spark, _index(spark, sf, ivf=True, cells=16), 10, nprobe=16))


@query
def index_after_changes(spark, sf):
    """An index from which vectors were removed, to which some were added again, and whose large cells
    were split: with every cell probed it agrees with the exact search over what is left."""
    v = _vectors(spark, sf)
    path = _index(spark, sf, ivf=True, cells=8)
    remove_from_index(v.where("id % 5 = 0"), path)
    add_to_index(v.where("id % 10 = 0"), path, vec="vec")
    split_cells(spark, path, 60)
    q = v.withColumnRenamed("id", "query_id")
    return _ranked(search_index(q, spark, path, 10, nprobe=1 << 20))


@query
def ivf_search_given_cells(spark, sf):
    """Cells around given centres, the two nearest probed and more only where they lack vectors."""
    q = _vectors(spark, sf).withColumnRenamed("id", "query_id")
    path = _index(spark, sf, ivf=True, centres=GIVEN_CENTRES)
    return _ranked(search_index(q, spark, path, 10, nprobe=2))


@query
def ivf_search(spark, sf):
    q = _vectors(spark, sf).withColumnRenamed("id", "query_id")
    return _ranked(search_index(q, spark, _index(spark, sf, ivf=True, cells=16), 10, nprobe=4))


def _documents(spark, sf):
    """Tracks with their text, dealt to all cores: encoding is bound by CPU, and the table is a few files."""
    docs = tb.tracks(spark, sf).repartition(compute_partitions(spark), "id")
    return docs.withColumn("document", TX.text_document(docs.columns))


@query
def text_search_counted(spark, sf):
    """Text search with an encoder that counts given words."""
    encode = E.counting_encoder(GIVEN_WORDS)
    docs = encode(_documents(spark, sf))
    queries = tb.table(spark, sf, "part").select("p_name").distinct().select(
        F.col("p_name").alias("query_id"), F.col("p_name").alias("query"))
    found, _ = search_text(queries, docs, encode, 10, {"popularity": {"$gte": 20}})
    return found.select("query_id", "rank", "id", "name",
                        _single("similarity_score").alias("similarity_score"))


@query
def text_search(spark, sf):
    docs = _documents(spark, sf)
    encode = E.hashing_encoder(idf=E.fit_idf(docs))
    queries = tb.table(spark, sf, "part").select("p_name").distinct().select(
        F.col("p_name").alias("query_id"), F.col("p_name").alias("query"))
    found, _ = search_text(queries, encode(docs), encode, 10, {"popularity": {"$gte": 20}})
    return found.select("query_id", "rank", "id", "name",
                        _single("similarity_score").alias("similarity_score"))


@query
def text_search_related(spark, sf):
    """Text search that knows related words, by vectors fitted on the items' own texts."""
    docs = _documents(spark, sf)
    encode = meaning_encoder(written(fit_word_vectors(docs, 64), "word-vectors"))
    queries = tb.table(spark, sf, "part").select("p_name").distinct().select(
        F.col("p_name").alias("query_id"), F.col("p_name").alias("query"))
    found, _ = search_text(queries, written(encode(docs), "encoded"), encode, 10,
                           {"popularity": {"$gte": 20}})
    return found.select("query_id", "rank", "id", "name",
                        _single("similarity_score").alias("similarity_score"))


@query
def proxy_features(spark, sf):
    found = PX.proxy_features(_catalogue(spark, sf))
    return found.select("id", *[_single(F.col("vec")[i]).alias(f) for i, f in
                                enumerate(FEATURES)])


@query
def mean_vector(spark, sf):
    means = PX.mean_vector(_vectors(spark, sf), "label")
    return means.select("label", F.posexplode("vec").alias("at", "x")) \
        .withColumn("x", _single("x"))


# --- trained rankers ---------------------------------------------------------------------------

_MODELS: dict[tuple[str, str], str] = {}


def _models_path(spark, sf):
    """Where this application's trained models of a folder of tables are; trained at first use."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = shared_folder(spark, "models")
    path = _MODELS[key]
    MD.load_or_fit(_ratings(spark, sf), tb.tracks(spark, sf), path)
    return path


@query
def training_pairs(spark, sf):
    pairs = training.training_pairs(_ratings(spark, sf), tb.tracks(spark, sf))
    return pairs.select("user_id", "track_id", "label", "target", *[
        _single(F.get(v, F.lit(i))).alias(f"{v}_{i}")
        for v in ("user_vec", "item_vec") for i in range(len(FEATURES))])


@query
def two_tower_training(spark, sf):
    """Losses and held-out accuracy of every epoch of both rankers, from the stored models."""
    return MD.load(spark, _models_path(spark, sf)).history


@query
def two_tower_candidates(spark, sf):
    models = MD.load(spark, _models_path(spark, sf))
    return TS.two_tower_candidates(_ratings(spark, sf), tb.tracks(spark, sf), models.towers, 100,
                                   models.index_path, nprobe=8)


@query
def wide_deep_rank(spark, sf):
    ratings = _ratings(spark, sf)
    return TS.score_wide_deep(ratings.select("user_id", F.col("track_id").alias("id")), ratings,
                              tb.tracks(spark, sf), MD.load(spark, _models_path(spark, sf)).ranker)


@query
def two_stage(spark, sf):
    path = _models_path(spark, sf)
    return _shown(R.recommend(_ratings(spark, sf), tb.tracks(spark, sf), 10, "two_stage",
                              models_path=path, nprobe=8), "score")


@query
def two_tower_rank(spark, sf):
    return _picks(spark, sf, "two-tower", models_path=_models_path(spark, sf))


# --- the same rankers with given weights, whose numbers SQL can say ----------------------------

def _given(spark, weights):
    """Small networks with given weights, saved and loaded as trained ones are."""
    path = shared_folder(spark, "given")
    save_weights(spark, weights, path)
    return load_weights(spark, path)


@query
def two_tower_given(spark, sf):
    found = TS.two_tower_candidates(_ratings(spark, sf), tb.tracks(spark, sf),
                                    _given(spark, GIVEN_TOWERS), 100)
    return found.withColumn("similarity", _single("similarity"))


@query
def wide_deep_given(spark, sf):
    ratings = _ratings(spark, sf)
    pairs = ratings.select("user_id", F.col("track_id").alias("id"))
    return _shown(TS.score_wide_deep(pairs, ratings, tb.tracks(spark, sf),
                                     _given(spark, GIVEN_RANKER)), "score")


@query
def wide_deep_steps_given(spark, sf):
    """Weights and losses of two training steps over all rated pairs, from given weights."""
    pairs = training.training_pairs(_ratings(spark, sf), tb.tracks(spark, sf))
    done = training.train(
        pairs.withColumn("y", F.col("target")), GIVEN_RANKER,
        lambda w, x, y, _: N.wide_deep_step(w, x, y, None), N.wide_deep_score, epochs=2,
        batch_rows=1 << 40, learning_rate=0.01, validation_share=0.0)
    rows = [(f"{name}[{i}]", float(v)) for name in sorted(done.weights)
            for i, v in enumerate(done.weights[name].ravel())]
    rows += [(f"loss {i}", v) for i, v in enumerate(done.losses)]
    return spark.createDataFrame(rows, "weight string, value double").withColumn("value", _single("value"))


@query
def two_stage_given(spark, sf):
    return _shown(R.recommend(
        _ratings(spark, sf), tb.tracks(spark, sf), 10, "two_stage",
        towers=_given(spark, GIVEN_TOWERS), ranker=_given(spark, GIVEN_RANKER)), "score")


@query
def two_tower_rank_given(spark, sf):
    towers = _given(spark, GIVEN_TOWERS)
    index = encode_vectors(TS.item_vectors(tb.tracks(spark, sf)), towers, "item", "id")
    return _picks(spark, sf, "two-tower", two_tower=(towers, written(index, "item-embeddings")))


# --- metrics and streams -----------------------------------------------------------------------

# Rows in one file of a stream's input.
ARRIVALS = 500_000


def _two_batches(rows: DataFrame, n: int, path: str) -> DataFrame:
    """About ``n`` rows stored in files of bounded size, as a stream that reads them in two batches."""
    half = max(2, -(-n // (2 * ARRIVALS)))
    rows.repartition(2 * half).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", half).parquet(path)


@query
def usage_metrics(spark, sf):
    events = tb.table(spark, sf, "events")
    key = F.get_json_object("props", "$.k").cast("int")
    return _shown(M.usage_metrics(events, "event_type",
                                  "value", F.col("value") < 50, key % 2 == 0),
                  "mean_duration", "success_rate", "cache_hit_rate")


@query
def click_through(spark, sf):
    return _shown(M.click_through(tb.table(spark, sf, "events"), ["user_id"]), "ctr")


@query
def popular_searches(spark, sf):
    return M.popular_searches(tb.table(spark, sf, "part"), "p_name", 10)


@query
def popular_searches_sketch(spark, sf):
    """The most frequent kinds of events, found in sketches of single hours merged in two steps."""
    events = tb.table(spark, sf, "events").withColumn(
        "search", F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")))
    path = shared_folder(spark, "sketch")
    M.search_sketch(events, "search", "ts").write.parquet(path)
    hours = spark.read.parquet(path)
    days = [M.merged_sketch(hours.where(F.dayofmonth("hour") % 2 == d)) for d in (0, 1)]
    return M.popular_in_sketch(M.merged_sketch(days[0].unionByName(days[1])), 20)


@query
def rating_stream(spark, sf):
    """The ratings in two batches' worth of files, read from the state they leave."""
    at = shared_folder(spark, "rating-stream")
    events = tb.rating_events(spark, sf)
    stream = _two_batches(events, tb.table(spark, sf, "lineitem").count(), f"{at}/in")
    jobs.rating_stream(stream, f"{at}/log", f"{at}/checkpoint").awaitTermination()
    return jobs.current_ratings(spark, f"{at}/checkpoint", events.schema) \
        .select("user_id", "track_id", "rating")


@query
def ingest_stream(spark, sf):
    """Tracks arrive once per order line; each is stored once."""
    at = shared_folder(spark, "ingest-stream")
    seen = tb.rating_events(spark, sf).select(F.col("track_id").alias("id"), "ts")
    arrivals = seen.join(tb.tracks(spark, sf), "id").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = _two_batches(arrivals, tb.table(spark, sf, "lineitem").count(), f"{at}/in")
    jobs.ingest_stream(stream, f"{at}/items", f"{at}/checkpoint", E.hashing_encoder()) \
        .awaitTermination()
    return jobs.open_stream_store(spark, f"{at}/items").select("id", "name", "popularity")


@query
def usage_stream(spark, sf):
    at = shared_folder(spark, "usage-stream")
    events = tb.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = _two_batches(events, events.count(), f"{at}/in")
    jobs.usage_stream(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return jobs.current_usage(spark, f"{at}/out").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("name").alias("event_type"), "calls", _single("mean_value").alias("mean_value"))


@query
def final_usage_stream(spark, sf):
    """Windows that become final, with the corrections of what came later and the open ones."""
    at = shared_folder(spark, "final-usage-stream")
    events = tb.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    # files are not in the order of time, so most events come late
    stream = _two_batches(events, events.count(), f"{at}/in")
    jobs.final_usage_stream(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return jobs.corrected_usage(spark, f"{at}/out").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("name").alias("event_type"), "calls", _single("mean_value").alias("mean_value"))
