"""Explicit schemas for every source and store; nothing is inferred."""

from pyspark.sql import types as T

# fixed values: the audio features, in the order model vectors use
FEATURES = [
    "danceability", "energy", "valence", "tempo",
    "instrumentalness", "acousticness", "liveness", "speechiness",
]
EXTRA_FEATURES = ["key", "mode", "time_signature"]
ALL_FEATURES = FEATURES + EXTRA_FEATURES

_S, _D, _L, _B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()

TRACK = T.StructType([
    T.StructField("id", _S),
    T.StructField("name", _S),
    T.StructField("artists", T.ArrayType(_S)),
    T.StructField("album", _S),
    T.StructField("release_date", _S),
    T.StructField("popularity", _L),
    T.StructField("duration_ms", _L),
    T.StructField("explicit", _B),
    T.StructField("external_urls", _S),
    T.StructField("preview_url", _S),
])

# One nested track as the catalogue service delivers it. Numbers arrive as text at times,
# so they are read as strings and cast by the sanitizer.
RAW_TRACK = T.StructType([
    T.StructField("id", _S),
    T.StructField("name", _S),
    T.StructField("artists", T.ArrayType(T.StructType([
        T.StructField("id", _S), T.StructField("name", _S)]))),
    T.StructField("album", T.StructType([
        T.StructField("name", _S), T.StructField("release_date", _S)])),
    T.StructField("popularity", _S),
    T.StructField("duration_ms", _S),
    T.StructField("explicit", _B),
    T.StructField("external_urls", T.MapType(_S, _S)),
    T.StructField("preview_url", _S),
])
RAW_SEARCH = T.StructType([
    T.StructField("tracks", T.StructType([T.StructField("items", T.ArrayType(RAW_TRACK))]))])
RAW_PLAYLIST = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([T.StructField("track", RAW_TRACK)])))])
RAW_ARTIST_TOP = T.StructType([T.StructField("tracks", T.ArrayType(RAW_TRACK))])

# Feature rows: numbers are read as text so that a bad one can be replaced, not lost.
RAW_FEATURES = T.StructType(
    [T.StructField("id", _S)]
    + [T.StructField(f, _S) for f in ALL_FEATURES]
    + [T.StructField(f, _S) for f in ("uri", "track_href", "analysis_url", "type")]
)

RATING = T.StructType([
    T.StructField("user_id", _S),
    T.StructField("track_id", _S),
    T.StructField("rating", _D),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", _L),
])

PREFERENCES_JSON = T.MapType(_S, T.MapType(_S, _D))

STORED_ITEM = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("document", _S),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("name", _S),
        T.StructField("artists", T.ArrayType(_S)),
        T.StructField("album", _S),
        T.StructField("release_date", _S),
        T.StructField("popularity", _L),
        T.StructField("duration_ms", _L),
        T.StructField("external_urls", _S),
        T.StructField("preview_url", _S),
    ]
    + [T.StructField(f, _D) for f in ALL_FEATURES]
)
