"""Parser, titles, slugs, documents, search lists."""

from pyspark.sql import functions as F

from tonearm.functions import text as TX


def parsed(spark, *lines):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, text string")
    return [r.parsed for r in TX.parse_request(df).orderBy("i").collect()]


def test_parser_examples(spark):
    a, b, c, d = parsed(
        spark, "BTS Dynamite 같은 신나는 팝 추천", "이번 브루노마스 신곡 너무 좋더라 비슷한 좋은 노래 없어?",
        "잔잔하고 감성적인 재즈 추천해줘", "a 팝 팝 x-y IU IU 신나고 신나는")
    assert (a.keyword, a.genre_queries, a.mood_terms, a.prefer_recent) == (
        "BTS Dynamite", ["pop"], "upbeat energetic", False)
    assert (b.keyword, b.genre_queries, b.mood_terms, b.prefer_recent) == (
        "브루노마스", [], "", True)
    assert (c.keyword, c.genre_queries, c.mood_terms, c.prefer_recent) == (
        "", ["jazz", "smooth jazz", "jazz piano"], "calm mellow emotional", False)
    # one-letter tokens go, repeated keywords stay, phrases and genres count once
    assert (d.keyword, d.genre_queries, d.mood_terms) == ("IU IU", ["pop"], "upbeat energetic")


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_titles(spark):
    assert values(spark, TX.normalise_title, "Dynamite (Tropical) [Remix]!", "Café — Été", "곡 #1") \
        == ["dynamite", "café  été", "곡 1"]


def test_slugs(spark):
    assert values(spark, TX.slug, 'a/b: "c"  d--e-', "??", "가" * 50, " x  y ") == [
        "ab-c-d-e", "report", "가" * 40, "x-y"]


def test_document(spark):
    df = spark.createDataFrame(
        [("N", ["A", "B"], "L", ["pop"], 0.5, None, 120.0), ("N", ["A"], "L", [], None, 0.25, None)],
        "name string, artists array<string>, album string, genres array<string>, "
        "danceability double, energy double, tempo double")
    got = [r.d for r in df.select(TX.text_document(df.columns).alias("d")).collect()]
    assert got == ["N A B L pop danceability:0.50 tempo:120.00", "N A L energy:0.25"]


def searches(spark, column, genres, keyword, mood, seeds=()):
    df = spark.createDataFrame(
        [((keyword, list(genres), mood, False), list(seeds))],
        "parsed struct<keyword:string,genre_queries:array<string>,mood_terms:string,"
        "prefer_recent:boolean>, seed_genres array<string>")
    return [f"{s.kind}:{s.text}" for s in df.select(column.alias("s")).first().s]


def test_seed_searches(spark):
    c = TX.seed_searches()
    assert searches(spark, c, ["pop", "rock"], "IU", "sad") == ["text:IU", "genre:pop", "text:sad pop"]
    assert searches(spark, c, ["pop"], "", "") == ["genre:pop"]
    assert searches(spark, c, [], "", "sad") == ["text:sad"]
    assert searches(spark, c, [], "IU", "sad") == ["text:IU"]
    assert searches(spark, c, [], "", "") == []


def test_candidate_searches(spark):
    c = TX.candidate_searches()
    assert searches(spark, c, ["a", "b", "c", "d"], "IU", "sad", ["z", "d", "y", "x", "w"]) == [
        "genre:a", "genre:b", "genre:c", "text:sad a", "genre:w", "genre:x", "text:IU sad"]
    assert searches(spark, c, [], "IU", "", ["k-rap", "k-pop"]) == [
        "genre:k-pop", "genre:k-rap", "text:IU"]
    assert searches(spark, c, [], "", "sad") == ["text:sad"]
    assert searches(spark, c, [], "", "sad", ["pop"]) == ["genre:pop"]


def test_counting_encoder_splits_a_text_once(spark):
    from tonearm.operators.encoder import counting_encoder

    docs = spark.range(3).selectExpr("id", "concat('Red  bolt red ', id) AS document")
    out = counting_encoder(["red", "bolt", "1", "none"])(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and out.columns == ["id", "document", "embedding"]
    rows = {r.id: [round(x, 4) for x in r.embedding] for r in out.collect()}
    assert rows == {0: [0.8944, 0.4472, 0.0, 0.0], 1: [0.8165, 0.4082, 0.4082, 0.0],
                    2: [0.8944, 0.4472, 0.0, 0.0]}


def test_documents_of_text_searches_are_dealt_to_all_cores(spark, tmp_path):
    from tonearm.plans.queries import _documents
    from tonearm.session import compute_partitions

    spark.range(200).selectExpr(
        "id AS p_partkey", "'red bolt' AS p_name", "'Brand#1' AS p_brand", "'SMALL' AS p_type",
        "CAST(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    parts = _documents(spark, str(tmp_path)).select("id", "document").rdd.glom().map(len).collect()
    assert len(parts) == compute_partitions(spark) > 1 and sum(parts) == 200 and max(parts) < 150
