"""Views that give the driver's tables the shape of ratings, tracks, artists and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.dictionaries import GENRE_PROXY, GENRE_WORDS
from tonearm.sources.preferences import latest_ratings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rating_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rating ever given: one row per order line, the customer rates the part."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("track_id"),
        (F.lit(1) + F.col("l_quantity").cast("bigint") % 5).cast("double").alias("rating"),
        F.col("l_shipdate").alias("ts"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("seq"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, track_id, rating), the last rating of each user and track."""
    return latest_ratings(rating_events(spark, sf_dir)).select("user_id", "track_id", "rating")


def _share(factor: int) -> Column:
    return (F.col("p_partkey") * factor % 101) / F.lit(100.0)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tracks with the eight features; every 17th lacks acousticness."""
    key = F.col("p_partkey")
    artists = F.when(
        key % 3 == 0, F.array("p_brand", F.concat(F.lit("Maker#"), (key % 7).cast("string")))
    ).otherwise(F.array("p_brand"))
    own = F.array(F.lower("p_type"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)))
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_name").alias("name"),
        artists.alias("artists"),
        F.transform(artists, lambda a: F.concat(F.lit("id-"), a)).alias("artist_ids"),
        F.col("p_type").alias("album"),
        F.concat((F.lit(2019) + key % 8).cast("string"), F.lit("-01-01")).alias("release_date"),
        (F.col("p_size") * 2).cast("bigint").alias("popularity"),
        (F.lit(120000) + (key * 7919) % 240000).cast("bigint").alias("duration_ms"),
        (key % 11 == 0).alias("explicit"),
        F.concat(F.lit("https://tracks.example.org/"), key.cast("string")).alias("external_urls"),
        F.lit(None).cast("string").alias("preview_url"),
        _share(37).alias("danceability"),
        _share(53).alias("energy"),
        _share(71).alias("valence"),
        (F.lit(60.0) + (key * 29 % 140)).alias("tempo"),
        _share(13).alias("instrumentalness"),
        F.when(key % 17 != 0, _share(19)).alias("acousticness"),
        _share(23).alias("liveness"),
        _share(41).alias("speechiness"),
        # two of three tracks carry genres of their own, the others take their artist's
        F.when(key % 3 != 2, own).otherwise(F.array().cast("array<string>")).alias("genres"),
    )


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artist_id, name, genres): brands and makers, two genres each, some only near a known one."""
    names = tracks(spark, sf_dir).select(F.explode("artists").alias("name")).distinct()
    known = F.array(*[F.lit(g) for g in GENRE_PROXY])
    number = F.split_part(F.col("name"), F.lit("#"), F.lit(2)).cast("int")
    return names.select(
        F.concat(F.lit("id-"), "name").alias("artist_id"),
        "name",
        F.array(
            F.get(known, number % len(GENRE_PROXY)),
            F.concat(F.lit("korean "), F.get(known, (number * 3 + 1) % len(GENRE_PROXY))),
        ).alias("genres"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, text): one line of free text per customer, built from its key and a part name."""
    words = F.array(*[F.lit(w) for w in GENRE_WORDS])
    c = table(spark, sf_dir, "customer").select("c_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    kind = F.col("c_custkey") % 5
    genre = F.get(words, (F.col("c_custkey") % len(GENRE_WORDS)).cast("int"))
    name = F.coalesce(F.col("p_name"), F.lit(""))
    text = (
        F.when(kind == 0, F.concat(name, F.lit(" 같은 "), genre, F.lit(" 추천")))
        .when(kind == 1, F.concat(F.lit("잔잔하고 감성적인 "), genre, F.lit(" 추천해줘")))
        .when(kind == 2, F.concat(F.lit("이번 "), name, F.lit(" 신곡 너무 좋더라!")))
        .when(kind == 3, F.concat(F.lit("신나는 "), genre, F.lit(", "), name))
        .otherwise(F.lit("슬픈 노래 없어?"))
    )
    return c.join(p, c.c_custkey == p.p_partkey, "left").select(
        F.col("c_custkey").alias("request_id"), text.alias("text"))


def raw_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as freshly delivered tracks: blanks, gaps and numbers as text, some no numbers."""
    key = F.col("p_partkey")
    suffixes = F.array(*[F.lit(s) for s in ("", "d", "f", "F ", "D")])
    text = key.cast("string")
    artists = (
        F.when(key % 31 == 0, F.array().cast("array<string>"))
        .when(key % 5 == 0, F.array(F.concat(F.lit("  "), "p_brand", F.lit("\t")), F.lit("")))
        .otherwise(F.array("p_brand")))
    return table(spark, sf_dir, "part").select(
        key.alias("part"),
        F.when(key % 23 == 0, F.concat(F.lit("trk"), text)).otherwise(
            F.concat(F.lit("track_"), F.lpad(text, 8, "0"))).alias("id"),
        F.when(key % 19 == 0, "").when(key % 29 == 0, "   ").otherwise(
            F.concat(F.lit("  "), "p_name", F.lit("\t"))).alias("name"),
        artists.alias("artists"),
        F.when(key % 37 != 0, F.concat(F.lit(" "), "p_type")).alias("album"),
        F.concat((F.lit(2019) + key % 8).cast("string"), F.lit("-01-01")).alias("release_date"),
        F.when(key % 4 == 0, F.concat((F.col("p_size") * 2).cast("string"), F.lit(".5")))
        .when(key % 4 == 3, F.concat(F.col("p_size").cast("string"),
                                     F.get(suffixes, (key % 5).cast("int")))).when(key % 4 == 1, "n/a").when(key % 4 == 2, F.lit(None))
        .otherwise(F.col("p_size").cast("string")).alias("popularity"),
        F.concat((key * 1000).cast("string"), F.lit(".0")).alias("duration_ms"),
        (key % 11 == 0).alias("explicit"),
    )


def raw_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of feature texts per part; some unreadable, some out of range."""
    key = F.col("p_partkey")

    def share(factor: int, modulus: int = 101):
        hundredths = key * factor % modulus
        return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."),
                        F.lpad((hundredths % 100).cast("string"), 2, "0"))

    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("track_"), F.lpad(key.cast("string"), 8, "0")).alias("id"),
        F.when(key % 11 == 0, "invalid").when(key % 11 == 1, F.concat(share(37), F.lit("d")))
        .when(key % 11 == 2, F.concat(share(37), F.lit("F"))).otherwise(share(37))
        .alias("danceability"),
        share(53, 104).alias("energy"),
        F.when(key % 13 != 0, share(71)).alias("valence"),
        F.when(key % 17 == 0, "fast").otherwise((F.lit(60) + key % 245).cast("string"))
        .alias("tempo"),
        share(13).alias("instrumentalness"),
        share(19).alias("acousticness"),
        share(23).alias("liveness"),
        share(41).alias("speechiness"),
        (key % 12).cast("string").alias("key"),
        (key % 2).cast("string").alias("mode"),
        F.when(key % 7 == 0, "?").otherwise((F.lit(3) + key % 5).cast("string"))
        .alias("time_signature"),
        F.lit("audio_features").alias("type"),
    )


def _nested(popularity: Column, title: Column) -> Column:
    key = F.col("p_partkey").cast("string")
    return F.struct(
        F.concat(F.lit("track_"), F.lpad(key, 8, "0")).alias("id"),
        title.alias("name"),
        F.array(F.struct(F.concat(F.lit("id-"), "p_brand").alias("id"),
                         F.col("p_brand").alias("name"))).alias("artists"),
        F.struct(F.col("p_type").alias("name"), F.lit("2023-01-01").alias("release_date"))
        .alias("album"),
        popularity.alias("popularity"),
        (F.col("p_partkey") * 1000).alias("duration_ms"),
        F.lit(False).alias("explicit"),
        F.struct(F.concat(F.lit("https://tracks.example.org/"), key).alias("page"))
        .alias("external_urls"),
    )


# How the cut lines of each feed begin; the number of the page follows.
CUT = {"search": '{"tracks":{"items":[{"id":"page ', "playlist": '{"items":[{"track":{"id":"page ',
       "artist": '{"tracks":[{"id":"page ', "features": '{"id":"page ', "analysis": '{"id":"event '}


def write_landing(spark: SparkSession, sf_dir: str, root: str) -> dict[str, str]:
    """Parts as delivered JSON answers, 50 tracks each: searches, playlists and artist pages.

    Every feed has every part. Playlists have one more point of popularity and a null entry in
    each answer, artist pages another title. For every seventh page a feed also has a line that was
    cut short.
    """
    part = table(spark, sf_dir, "part")
    page = F.floor(F.col("p_partkey") / 50).alias("page")

    def answers(df, track):
        # an answer holds at most 50 tracks, so the lists are bounded
        return df.groupBy(page).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("p_partkey", track.alias("t")))),
            lambda s: s["t"]).alias("ts"))

    def with_cut(whole, start):
        cut = part.select(page).distinct().where(F.col("page") % 7 == 0).select(
            F.concat(F.lit(start), F.col("page").cast("string")).alias("value"))
        return whole.unionByName(cut)

    size, name = F.col("p_size"), F.col("p_name")
    out = {k: f"{root}/{k}" for k in ("search", "playlist", "artist", "features")}
    with_cut(answers(part, _nested(size, name)).select(
        F.to_json(F.struct(F.struct(F.col("ts").alias("items")).alias("tracks"))).alias("value")),
        CUT["search"]).write.text(out["search"])
    lists = answers(part, _nested(size + 1, name)).select(
        F.concat(F.lit('{"items":[{"track":null},'),
                 F.array_join(F.transform("ts", lambda t: F.concat(
                     F.lit('{"track":'), F.to_json(t), F.lit("}"))), ","),
                 F.lit("]}")).alias("value"))
    with_cut(lists, CUT["playlist"]).write.text(out["playlist"])
    with_cut(answers(part, _nested(size, F.concat(F.lit("Best of "), name))).select(
        F.to_json(F.struct(F.col("ts").alias("tracks"))).alias("value")), CUT["artist"]) \
        .write.text(out["artist"])
    with_cut(raw_features(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")),
             CUT["features"]).write.text(out["features"])
    return out
