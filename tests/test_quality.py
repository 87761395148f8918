"""Accept and reject tables of the validators and sanitizers."""

import pytest
from pyspark.sql import functions as F

from tonearm.functions import quality as Q
from tonearm.functions.text import clean_query


def verdicts(spark, values, errors, name, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} {kind}")
    return [not r.e for r in df.select("i", errors.alias("e")).orderBy("i").collect()]


def test_tracks(spark):
    df = spark.createDataFrame(
        [(1, "test_track_1234567890", "Song", ["A"], "Album"),
         (2, "test_track_1234567890", "Song", None, "Album"),
         (3, "short", "Song", ["A"], "Album"),
         (4, "test_track_1234567890", "   ", ["A"], "Album"),
         (5, None, "", [], None)],
        "n int, id string, name string, artists array<string>, album string")
    valid, bad = Q.split_valid(df, Q.track_errors())
    assert sorted(r.n for r in valid.collect()) == [1, 4]
    assert {r.n: r.errors for r in bad.collect()} == {
        2: ["artists missing"], 3: ["id malformed"],
        5: ["id missing", "name missing", "artists missing", "album missing"]}
    with pytest.raises(Exception, match="invalid row"):
        Q.split_valid(df, Q.track_errors(), strict=True)[0].collect()


def test_audio_ranges(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, 0.8, 120.0, 0.0, 4.0), (2, 1.5, 120.0, 0.0, 4.0), (3, nan, 120.0, 0.0, 4.0),
         (4, None, None, None, None), (5, 0.5, 301.0, 12.0, 2.0), (6, 0.0, 300.0, 11.0, 7.0)],
        "n int, danceability double, tempo double, key double, time_signature double")
    valid, bad = Q.split_valid(df, Q.feature_errors(df.columns))
    assert sorted(r.n for r in valid.collect()) == [1, 4, 6]
    assert {r.n: len(r.errors) for r in bad.collect()} == {2: 1, 3: 1, 5: 3}


def test_ratings(spark):
    values = ["1.0", "2.5", "3.0", "4.5", "5.0", "0.5", "5.5", "-1.0", "invalid", None]
    assert verdicts(spark, values, Q.rating_errors(), "rating") == [True] * 5 + [False] * 5


def test_user_ids(spark):
    values = ["user123", "test_user", "user_123", "ab", "a" * 51, "", "   ", None]
    assert verdicts(spark, values, Q.user_id_errors(), "user_id") == [True] * 3 + [False] * 5


def test_queries(spark):
    values = ["jazz", "rock music", "k-pop", "a" * 100, "", "a" * 101, "　", None]
    assert verdicts(spark, values, Q.query_errors(), "query") == [True] * 4 + [False] * 4


def test_source_ids(spark):
    good = ["37i9dQZF1DXcBWIGoYBM5M", "0TnOYISbd1XYRBk9myaseg"]
    values = good + ["short", "37i9dQZF1DXcBWIGoYBM5M_x", "37i9dQZF1DXcBWIGoYBM5_", "", None]
    assert verdicts(spark, values, Q.source_id_errors("p"), "p") == [True] * 2 + [False] * 5


@pytest.mark.parametrize("n", [0, -1, 1001, "invalid", True, 2.0])
def test_result_counts_refused(n):
    with pytest.raises(ValueError):
        Q.check_n_results(n)


def test_result_counts_taken():
    for n in (1, 10, 100, 1000):
        Q.check_n_results(n)


def test_tables(spark):
    df = spark.createDataFrame([("a", "n", ["x"], "b"), ("c", "n", ["x"], "b")],
                               "id string, name string, artists array<string>, album string")
    Q.check_table(df)
    for bad in (df.limit(0), df.drop("artists"), df.unionByName(df)):
        with pytest.raises(ValueError):
            Q.check_table(bad)


def test_sanitize_track(spark):
    df = spark.createDataFrame(
        [("  Test Track  ", "\tAlbum\n", ["  Test Artist  ", ""], "80.5", "180000.0"),
         ("x", "y", ["  "], "many", None)],
        "name string, album string, artists array<string>, popularity string, duration_ms string")
    a, b = Q.sanitize_tracks(df).collect()
    assert (a.name, a.album, a.artists, a.popularity, a.duration_ms) == (
        "Test Track", "Album", ["Test Artist"], 80, 180000)
    assert (b.artists, b.popularity, b.duration_ms) == ([""], 0, 0)


def test_sanitize_features(spark):
    df = spark.createDataFrame([("0.8", "invalid", "0.6", "x", None, "uri:1")],
                               "danceability string, energy string, valence string, tempo string, "
                               "time_signature string, uri string")
    r = Q.sanitize_features(df).first()
    assert (r.danceability, r.energy, r.valence, r.tempo, r.time_signature, r.uri) == (
        0.8, 0.5, 0.6, 120.0, 4.0, "uri:1")


def test_clean_query(spark):
    pairs = [("  jazz music  ", "jazz music"), ("rock; DROP TABLE users;", "rock DROP TABLE users"),
             ("k-pop -- comment", "k-pop comment"), ("electronic /* comment */", "electronic comment"),
             (None, ""), ("a-;-b", "ab"), ("x 　y\tz", "x y z")]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(pairs)], "i int, q string")
    got = [r.c for r in df.select("i", clean_query(F.col("q")).alias("c")).orderBy("i").collect()]
    assert got == [want for _, want in pairs]


def test_line_breaks_and_type_letters_are_refused(spark):
    good = "37i9dQZF1DXcBWIGoYBM5M"
    ids = spark.createDataFrame([(good,), (good + "\n",), (good + "\r\n",), ("\n" + good,)], "p string")
    assert [len(r[0]) for r in ids.select(Q.source_id_errors("p")).collect()] == [0, 1, 1, 1]
    rows = spark.createDataFrame([("4",), ("4d",), ("4.F ",), ("4e0",), (" 2.5 ",)], "rating string")
    assert [len(r[0]) for r in rows.select(Q.rating_errors()).collect()] == [0, 1, 1, 0, 0]
    features = spark.createDataFrame([("0.8d",), ("0.8f",), ("0.8",)], "danceability string")
    assert [r[0] for r in Q.sanitize_features(features).collect()] == [0.5, 0.5, 0.8]
