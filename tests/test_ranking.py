"""The worked ranking example: scores, order, badges, cap and report tables."""

from pyspark.sql import functions as F

from tonearm.functions.scoring import multi_signal_score
from tonearm.operators import ranking as K
from tonearm.operators.proxy import genre_vectors, proxy_features
from tonearm.plans import report as RP
from tonearm.plans.requests import rank_multi_signal

# id, name, artists, popularity, genres, new, badge, colour, score
GOLDEN = [
    ("7hlEhmg5h9XuFtaGfgvqjF", "Love Love Love", ["Epik High"], 68, ["k-rap", "k-pop", "k-ballad"], 0, 54, "green", 0.5373),
    ("7tI8dRuH2Yc6RuoTjxo4dU", "Who", ["Jimin"], 87, ["k-pop"], 1, 51, "green", 0.5110),
    ("2bAQsNqdo62T8akkIvWzGl", "RUDE!", ["Hearts2Hearts"], 87, ["k-pop"], 1, 51, "green", 0.5110),
    ("1k0JAiH11gHL9dc5dfQjQr", "NOT CUTE ANYMORE", ["ILLIT"], 85, ["k-pop"], 1, 50, "green", 0.5050),
    ("27xkOIER6uDLKALIelHylZ", "Don’t Say You Love Me", ["Jin"], 84, ["k-pop"], 1, 50, "green", 0.5020),
    ("2O9bMJticxbQ8FH3NiQ7Xh", "Catch Catch", ["YENA"], 83, ["k-pop"], 1, 50, "orange", 0.4990),
    ("5EoV2HmAlkqN1XvsIjOBZZ", "STYLE", ["Hearts2Hearts"], 79, ["k-pop"], 1, 49, "orange", 0.4870),
    ("3m08yeqLjXsqblRU3KXPAp", "TICK TOCK", ["HAON"], 69, ["k-rap"], 1, 46, "orange", 0.4570),
    ("6WCEA1cWcv3jfsVXpWdeXR", "BBUU!", ["PLAVE"], 67, ["k-pop"], 1, 45, "orange", 0.4510),
    ("5bB7348yF6DXMmK1WQlBui", "Money Checks", ["NOWIMYOUNG"], 65, ["k-rap"], 1, 44, "orange", 0.4450),
    ("1rEa59P5yEal5cp1h7kl2e", "404 (New Era)", ["KiiiKiii"], 65, ["k-pop"], 1, 44, "orange", 0.4450),
    ("0FKR7mQJnYqdEmHAMhgQjw", "Blue Valentine", ["NMIXX"], 64, ["k-pop"], 1, 44, "orange", 0.4420),
    ("3NkkcnnKrNHv4AiGaPdD76", "Energetic", ["Wanna One"], 63, ["k-pop"], 0, 44, "orange", 0.4390),
    ("3CEs5Jnov3YkmYn0Vezrcr", "Energetic", ["Wanna One"], 47, ["k-pop"], 0, 39, "orange", 0.3910),
    ("3TPvrMAd1hbPRXuHCRX0Pl", "AEAO", ["Dynamicduo", "DJ Premier"], 75, ["k-rap", "k-pop"], 0, 32, "orange", 0.3250),
]


def candidates(spark):
    rows = [("q", g[0], i, g[1], g[2], g[3], g[4], "2025-01-01" if g[5] else "2019")
            for i, g in enumerate(GOLDEN)]
    # a third track of one artist, which the cap must remove
    rows.append(("q", "third", 99, "Energetic 3", ["WANNA ONE"], 46, ["k-pop"], "2019"))
    df = spark.createDataFrame(
        rows, "need string, id string, seq int, name string, artists array<string>, "
              "popularity bigint, genres array<string>, release_date string")
    return df.select("*", F.array(F.lit("k-pop"), F.lit("k-rap")).alias("seed_genres"),
                     F.array(F.lit("bts"), F.lit("primary"), F.lit("dynamicduo"))
                     .alias("seed_artists"), F.lit(False).alias("prefer_recent"))


def test_worked_example(spark):
    pool = candidates(spark)
    picks = rank_multi_signal(pool, 15)
    got = [(r.id, r.similarity_score) for r in picks.orderBy("rank").collect()]
    assert got == [(g[0], g[8]) for g in GOLDEN]

    full = picks.join(pool.drop("need"), "id").select(
        "*", F.lit("L").alias("album"), F.lit(200_000).alias("duration_ms"),
        F.lit(False).alias("explicit"), F.lit("#").alias("external_urls"),
        F.lit(None).cast("string").alias("preview_url"))
    cards = RP.report_cards(full).orderBy("rank").collect()
    assert [(c.percent, c.colour, c.is_new) for c in cards] == [
        (g[6], g[7], bool(g[5])) for g in GOLDEN]
    assert {(c.label, c.duration) for c in cards if c.rank == 3} == {("#3", "3:20")}
    context = spark.createDataFrame([("q", ["a", "b", "c"], ["k-pop", "k-rap"])],
                                    "need string, seed_ids array<string>, seed_genres array<string>")
    t = RP.report_totals(context, full).first()
    assert (t.n_seeds, t.n_recommendations, t.n_genres, t.mean_popularity) == (3, 15, 2, 73)
    chart = [(r.genre, r.n) for r in RP.report_genres(full).orderBy("place").collect()]
    assert chart == [("k-pop", 13), ("k-rap", 4)]


def test_recency_bonus_and_floor(spark):
    df = spark.createDataFrame(
        [(1, "2024-02", True, False), (2, "2023", True, False), (3, None, True, True)],
        "i int, d string, recent boolean, seed boolean")
    none = F.array().cast("array<string>")
    got = [r.s for r in df.select("i", multi_signal_score(
        none, none, F.lit(50), F.col("d"), F.col("recent"), F.col("seed")).alias("s"))
        .orderBy("i").collect()]
    assert got == [0.25, 0.15, 0.0]


def test_dedups(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z")],
                               "seq int, id string, v string")
    assert {(r.id, r.seq, r.v) for r in K.dedup_last(df).collect()} == {("a", 1, "z"), ("b", 2, "y")}
    assert {(r.id, r.seq, r.v) for r in K.dedup_first(df).collect()} == {("a", 1, "x"), ("b", 2, "y")}


def test_diverse_seeds_fill_up(spark):
    df = spark.createDataFrame([("g", "A", 1), ("g", "A", 2), ("g", "B", 3), ("g", "A", 4)],
                               "g string, artist string, pos int")
    got = K.diverse_first(df, ["g"], "artist", "pos", 3).orderBy("rank").collect()
    assert [r.pos for r in got] == [1, 3, 2]


def test_first_non_empty(spark):
    df = spark.createDataFrame([("r", 2, "x"), ("r", 1, "y"), ("r", 1, "z"), ("s", 3, "w")],
                               "g string, p int, v string")
    assert {r.v for r in K.first_non_empty(df, ["g"], "p").collect()} == {"y", "z", "w"}


def test_proxies(spark):
    genres = spark.createDataFrame([("jazz",), ("korean jazz",), ("k-pop",), ("kr",), ("zzz",),
                                    ("korean k-pop",)], "genre string")
    got = {r.genre: r.proxy[0] for r in genre_vectors(genres).collect()}
    # partial matches take the first entry in table order: "pop" for "korean k-pop"
    assert got == {"jazz": 0.55, "korean jazz": 0.55, "k-pop": 0.75, "korean k-pop": 0.75}
    tracks = spark.createDataFrame([(1, ["Jazz", "zzz"], 100), (2, [], None), (3, ["edm"], 100)],
                                   "id int, genres array<string>, popularity bigint")
    vecs = {r.id: r.vec for r in proxy_features(tracks).collect()}
    assert [round(x, 4) for x in vecs[1][:3]] == [0.6325, 0.575, 0.6]
    assert [round(x, 4) for x in vecs[2][:3]] == [0.55, 0.55, 0.55]
    assert round(vecs[3][0], 4) == 0.9775 and vecs[3][1] == 1.0
