"""Landing files, the item store, preferences, exports, filters and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tonearm.functions.predicates import where
from tonearm.operators.encoder import hashing_encoder, model_encoder
from tonearm.plans.search import search_text
from tonearm.sources import landing, models, store
from tonearm.sources.preferences import load_preferences, save_preferences
from tonearm.streaming import jobs


def raw(i, popularity=80, name=None):
    return {"id": f"mock_track_{i}", "name": name or f"Mock Track {i}",
            "artists": [{"id": "a1", "name": "Mock Artist 1"}],
            "album": {"name": "Mock Album 1", "release_date": "2023-01-01"},
            "popularity": popularity, "duration_ms": 180000, "explicit": False,
            "external_urls": {"page": "https://tracks.example.org/1"}, "preview_url": None}


def write(path, *docs):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(d) for d in docs), encoding="utf-8")
    return str(path)


def test_collect(spark, tmp_path):
    search = write(tmp_path / "s.json", {"tracks": {"items": [raw(1), raw(2), raw(1, 5)]}})
    lists = write(tmp_path / "p.json", {"items": [{"track": None}, {"track": raw(2, 9)},
                                                  {"track": {**raw(3), "id": "short"}}]})
    top = write(tmp_path / "a.json", {"tracks": [raw(4), raw(1, 7, "  Last  ")]})
    features = write(tmp_path / "f.json", {"id": "mock_track_1", "energy": "bad", "tempo": 120},
                     {"id": "mock_track_2", "energy": 2}, {"id": "unwanted", "energy": 0.5})
    playlist, refused = landing.playlist_tracks(spark, lists)
    assert [r.errors for r in refused.collect()] == [["id malformed"]]
    sources = [landing.search_results(spark, search)[0], playlist,
               landing.artist_top_tracks(spark, top)[0]]
    wanted = sources[0].select("id")
    good, bad = landing.track_features(spark, features, wanted)
    assert [r.id for r in bad.collect()] == ["mock_track_2"]
    rows = landing.collect_tracks(sources, good).orderBy("seq").collect()
    assert [(r.id, r.name, r.popularity, r.energy, r.tempo) for r in rows] == [
        ("mock_track_1", "Last", 7, 0.5, 120.0), ("mock_track_2", "Mock Track 2", 9, None, None),
        ("mock_track_4", "Mock Track 4", 80, None, None)]
    assert landing.collect_tracks([], spark=spark).count() == 0


def test_broken_answers_are_quarantined(spark, tmp_path):
    def answers(n):
        return json.dumps({"tracks": {"items": [raw(n)]}})

    lines = [answers(1), "", answers(2)[:150], answers(3), '["no object"]', '{"error": "limit"}', "plain text",
             '{"tracks": {"items": []}}', json.dumps({"tracks": {"items": [raw(4), {**raw(5), "explicit": "x"}]}})]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.json").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "s" / "2.json").write_text("\n".join([answers(6)[:40], answers(7)]), encoding="utf-8")
    good, bad = landing.search_results(spark, str(tmp_path / "s"))
    assert {"mock_track_1", "mock_track_3", "mock_track_4", "mock_track_7"} <= {r.id for r in good.collect()}
    refused = sorted((r.file.rsplit("/", 1)[1], r.line, r.record, *r.errors)
                     for r in bad.where("record IS NOT NULL").collect())
    assert refused == sorted([
        ("1.json", 3, lines[2], "answer unreadable"), ("1.json", 5, lines[4], "answer unreadable"),
        ("1.json", 6, lines[5], "answer without tracks"), ("1.json", 7, lines[6], "answer unreadable"),
        ("1.json", 9, lines[8], "answer readable in part"), ("2.json", 1, answers(6)[:40], "answer unreadable")])
    with pytest.raises(Exception, match="unreadable answer"):
        landing.search_results(spark, str(tmp_path / "s"), strict=True)[0].collect()


def test_lines_are_counted_across_blocks(spark, tmp_path):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    path = tmp_path / "f.json"
    lines = [json.dumps({"id": f"track_{i:08d}", "energy": 0.5}) for i in range(3000)]
    for at in (0, 777, 2999):
        lines[at] = lines[at][:15]
    path.write_text("\n".join(lines), encoding="utf-8")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        good, bad = landing.track_features(spark, str(path))
        assert good.count() == 2997
        assert sorted(r.line for r in bad.collect()) == [1, 778, 3000]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_whole_files_and_analysis_lines(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "good.json").write_text(json.dumps({"tracks": [raw(1)]}, indent=2), encoding="utf-8")
    (tmp_path / "w" / "cut.json").write_text(json.dumps({"tracks": [raw(2)]}, indent=2)[:60], encoding="utf-8")
    good, bad = landing.artist_top_tracks(spark, str(tmp_path / "w"), whole_file=True)
    assert [r.id for r in good.collect()] == ["mock_track_1"]
    assert [(r.file.rsplit("/", 1)[1], r.line) for r in bad.collect()] == [("cut.json", 1)]
    (tmp_path / "a.json").write_text('{"id": "x", "analysis": {"k": 1}}\n{"id": "y", "ana', encoding="utf-8")
    found, bad = landing.track_analysis(spark, spark.createDataFrame([("x",), ("y",)], "id string"),
                                        str(tmp_path / "a.json"))
    assert sorted((r.id, r.a) for r in found.selectExpr("id", "to_json(analysis) AS a").collect()) == [
        ("x", '{"k":1}'), ("y", "{}")]
    assert [(r.line, r.record) for r in bad.collect()] == [(2, '{"id": "y", "ana')]


def items(spark, *ids):
    return spark.createDataFrame(
        [(i, f"Song {i}", ["A", "B"], "L", "2023", None, 1000, 0.5, None) for i in ids],
        "id string, name string, artists array<string>, album string, release_date string, "
        "popularity int, duration_ms int, danceability double, energy double")


def test_store(spark, tmp_path):
    path = str(tmp_path / "items")
    encode = hashing_encoder()
    assert store.open_store(spark, path).count() == 0
    assert store.add_items(items(spark), path, encode) is False
    assert store.add_items(items(spark, "a", "b"), path, encode) is True
    assert store.add_items(items(spark, "b", "c"), path, encode) is True
    assert store.add_items(items(spark, "c"), path, encode) is True
    with pytest.raises(ValueError):
        store.add_items(items(spark, "d", "d"), path, encode)
    rows = store.open_store(spark, path).orderBy("id").collect()
    assert [r.id for r in rows] == ["a", "b", "c"]
    assert rows[0].document == "Song a A B L danceability:0.50"
    assert rows[0].popularity == 0 and rows[0].energy is None and len(rows[0].embedding) == 384
    stats = store.store_stats(store.open_store(spark, path), path).first()
    assert (stats.total_tracks, stats.location) == (3, path)
    store.clear_store(spark, path)
    assert store.open_store(spark, path).count() == 0


def test_text_search(spark):
    encode = hashing_encoder()
    docs = spark.createDataFrame(
        [("1", "calm piano night", 2020), ("2", "calm piano", 2024), ("3", "loud metal", 2024)],
        "id string, document string, year int")
    stored = encode(docs).select("*", F.col("document").alias("name"),
                                 F.array(F.lit("A")).alias("artists"), F.lit("L").alias("album"))
    queries = spark.createDataFrame([(1, " calm  piano; "), (2, "  "), (3, "x" * 101)],
                                    "query_id int, query string")
    found, refused = search_text(queries, stored, encode, 2)
    assert [(r.id, round(r.similarity_score, 4)) for r in found.orderBy("rank").collect()][0] \
        == ("2", 0.0)
    assert {r.query_id for r in refused.collect()} == {2, 3}
    only_old, _ = search_text(queries, stored, encode, 2, {"year": {"$lt": 2024}})
    assert [r.id for r in only_old.collect()] == ["1"]


def test_model_encoder(spark):
    def load():
        import numpy as np

        return lambda texts: np.array([[len(t), 0.0] for t in texts])

    df = spark.createDataFrame([("abc",)], "document string")
    assert model_encoder(load)(df).first().embedding == [1.0, 0.0]


def test_preferences(spark, tmp_path):
    ratings = spark.createDataFrame([("u", "a", 1.0), ("u", "b", 2.0), ("u", "c", 3.0),
                                     ("v", "a", 5.0)],
                                    "user_id string, track_id string, rating double")
    path = str(tmp_path / "prefs")
    save_preferences(ratings, path, max_entries=2)
    assert sorted(load_preferences(spark, path).collect()) == sorted(ratings.collect())
    whole = tmp_path / "one.json"
    whole.write_text(json.dumps({"u": {"a": 1.0, "b": 2}, "w": {}}, indent=2), encoding="utf-8")
    assert sorted(tuple(r) for r in load_preferences(spark, str(whole), True).collect()) == [
        ("u", "a", 1.0), ("u", "b", 2.0)]
    assert load_preferences(spark, str(tmp_path / "none")).count() == 0


def test_csv(spark, tmp_path):
    path = landing.save_csv(items(spark, "a"), str(tmp_path / "out"))
    assert path.endswith("out.csv")
    row = spark.read.option("header", True).option("escape", "\\").csv(path).first()
    assert (row.id, row.artists) == ("a", '["A","B"]')
    empty = landing.save_csv(items(spark), str(tmp_path / "empty"))
    assert not (tmp_path / "empty.csv").exists() and empty.endswith("empty.csv")


def test_weights(spark, tmp_path):
    import numpy as np

    path = str(tmp_path / "w")
    assert models.load_weights(spark, path) is None
    w = {"a.w0": np.arange(6.0).reshape(2, 3), "a.b0": np.ones(3)}
    models.save_weights(spark, w, path)
    back = models.load_weights(spark, path)
    assert set(back) == set(w) and all((back[k] == w[k]).all() for k in w)


@pytest.mark.parametrize("filters, want", [
    (None, {1, 2, 3}), ({"x": 1}, {1}), ({"x": {"$gt": 1}}, {2}), ({"x": {"$ne": 1}}, {2, 3}),
    ({"x": {"$gte": 1, "$lt": 2}}, {1}), ({"x": {"$in": [1, 2]}}, {1, 2}),
    ({"x": {"$nin": [1]}}, {2, 3}), ({"$or": [{"x": 1}, {"y": "b"}]}, {1, 2}),
    ({"$and": [{"x": {"$lte": 2}}, {"y": {"$eq": "b"}}]}, {2}), ({"x": 1, "y": "b"}, set()),
])
def test_filters(spark, filters, want):
    df = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, None, "c")],
                               "i int, x int, y string")
    assert {r.i for r in df.filter(where(filters)).collect()} == want


def test_unknown_filter():
    with pytest.raises(ValueError):
        where({"x": {"$like": "a"}})


def test_rating_log(spark, tmp_path):
    schema = "user_id string, track_id string, rating double, ts timestamp, seq bigint"
    src, log, check = (str(tmp_path / d) for d in ("in", "log", "check"))

    def arrive(*rows):
        df = spark.createDataFrame(rows, "user_id string, track_id string, rating double, "
                                         "ts string, seq bigint")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.rating_stream(stream, log, check).awaitTermination()
        return {(r.user_id, r.track_id): r.rating for r in jobs.current_ratings(spark, check).collect()}

    assert arrive(("u", "a", 1.0, "2024-01-01", 1), ("u", "a", 2.0, "2024-01-02", 2)) == {
        ("u", "a"): 2.0}
    # a late event does not win, a newer one does; each run starts the stream anew
    assert arrive(("u", "a", 9.0, "2023-01-01", 3), ("u", "b", 4.0, "2024-01-01", 4)) == {
        ("u", "a"): 2.0, ("u", "b"): 4.0}
    # an event that comes again changes nothing, nor does an older one of the same time
    assert arrive(("u", "a", 2.0, "2024-01-02", 2), ("u", "a", 5.0, "2024-01-02", 1),
                  ("u", "b", 1.0, "2024-01-01", 5)) == {("u", "a"): 2.0, ("u", "b"): 1.0}
    changes = sorted((r.batch, r.user_id, r.track_id, r.rating) for r in spark.read.parquet(log).collect())
    assert changes == [(0, "u", "a", 2.0), (1, "u", "b", 4.0), (2, "u", "b", 1.0)]
    assert [tuple(r)[:3] for r in jobs.changed_ratings(spark, log, 2).collect()] == [("u", "b", 1.0)]


def test_rating_state_equals_upsert_in_any_order(spark, tmp_path):
    import random

    from tonearm.sources.preferences import latest_ratings

    rnd = random.Random(8)
    rows = [(f"u{rnd.randint(0, 9)}", f"t{rnd.randint(0, 9)}", float(rnd.randint(1, 5)),
             f"2024-01-{rnd.randint(1, 28):02d}", i) for i in range(600)]
    rnd.shuffle(rows)
    events = spark.createDataFrame(rows, "user_id string, track_id string, rating double, ts string, seq bigint") \
        .withColumn("ts", F.to_timestamp("ts"))
    src, log, check = (str(tmp_path / d) for d in ("in", "log", "check"))
    for k in range(3):  # three runs, each a restart
        events.where(F.col("seq") % 3 == k).repartition(2).write.mode("append").parquet(src)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.rating_stream(stream, log, check).awaitTermination()
    want = sorted(tuple(r) for r in latest_ratings(events).collect())
    found = jobs.current_ratings(spark, check).select("user_id", "track_id", "rating", "ts", "seq")
    assert sorted(tuple(r) for r in found.collect()) == want
    assert sorted(tuple(r)[:5] for r in jobs.changed_ratings(spark, log).select(
        "user_id", "track_id", "rating", "ts", "seq").collect()) == want


def test_ingest_stream(spark, tmp_path):
    src, path, check = (str(tmp_path / d) for d in ("in", "items", "check"))

    def arrive(*ids):
        df = items(spark, *ids).withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        jobs.ingest_stream(stream, path, check, hashing_encoder()).awaitTermination()
        return sorted(r.id for r in jobs.open_stream_store(spark, path).collect())

    assert arrive("a", "b", "a") == ["a", "b"]
    assert arrive("b", "c") == ["a", "b", "c"]


def test_feature_search_refuses_bad_targets(spark):
    from tonearm.plans.recommend import refused_targets, search_by_features

    targets = spark.createDataFrame([(1, 0.5, 0.4), (2, 1.5, 0.4), (3, None, 0.1)],
                                    "target_id int, danceability double, energy double")
    got = search_by_features(targets, items(spark, "a", "b"), 1).orderBy("target_id").collect()
    # energy is absent in the items, so target 3 shares no feature with them: distance 0
    assert [(r.target_id, r.id, round(r.feature_score, 4)) for r in got] == [
        (1, "a", 0.0), (3, "a", 0.0)]
    assert [r.target_id for r in refused_targets(targets).collect()] == [2]


def test_ingest_stream_takes_late_items(spark, tmp_path):
    src, path, check = (str(tmp_path / d) for d in ("in", "items", "check"))

    def arrive(ts, *ids):
        df = items(spark, *ids).withColumn("ts", F.to_timestamp(F.lit(ts)))
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        jobs.ingest_stream(stream, path, check, hashing_encoder()).awaitTermination()
        return sorted(r.id for r in jobs.open_stream_store(spark, path).collect())

    assert arrive("2024-01-05 12:00:00", "a", "b") == ["a", "b"]
    # days late: a new id is stored, a repeat is not stored again
    assert arrive("2024-01-01 09:00:00", "late", "a") == ["a", "b", "late"]
    jobs.compact_items(spark, path, str(tmp_path / "small"))
    assert jobs.open_stream_store(spark, str(tmp_path / "small")).count() == 3


def test_ingest_opens_only_files_that_may_hold_an_id(spark, tmp_path):
    src, path, check = (str(tmp_path / d) for d in ("in", "items", "check"))

    def arrive(*ids):
        df = items(spark, *ids).withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        jobs.ingest_stream(stream, path, check, hashing_encoder()).awaitTermination()

    arrive(*(f"a{i}" for i in range(400)))
    arrive(*(f"b{i}" for i in range(400)))
    stored = jobs.open_stream_store(spark, path)
    every = stored.select(F.input_file_name()).distinct().count()
    assert stored.count() == 800 and every > 100
    # no id is missed, and unknown ids open hardly anything
    of = {r.id: r.file for r in stored.select("id", F.col("_metadata.file_path").alias("file")).collect()}
    some = [f"a{i}" for i in range(0, 400, 40)] + ["b7"]
    files = jobs.files_with(spark, path, spark.createDataFrame([(i,) for i in some], "id string"))
    assert {of[i] for i in some} <= set(files) and len(files) <= len(some) + 5
    new = spark.createDataFrame([(f"c{i}",) for i in range(30)], "id string")
    assert len(jobs.files_with(spark, path, new)) <= 8
    arrive("a3", "late", "b399", "late")
    assert sorted(r.id for r in jobs.open_stream_store(spark, path).where("batch = 2").collect()) == ["late"]
    jobs.compact_items(spark, path, str(tmp_path / "small"))
    assert jobs.open_stream_store(spark, str(tmp_path / "small")).count() == 801
    assert len(jobs.files_with(spark, str(tmp_path / "small"), spark.createDataFrame(
        [("late",)], "id string"))) == 1


def test_final_windows_and_corrections(spark, tmp_path):
    src, out, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    shape = "ts timestamp, event_type string, value double"
    every = []

    def arrive(*rows):
        every.extend(rows)
        df = spark.createDataFrame(rows, "ts string, event_type string, value double")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
        jobs.final_usage_stream(spark.readStream.schema(shape).parquet(src), out, check,
                                delay="2 hours").awaitTermination()

    def rows(part):
        return sorted((str(r.window_start)[11:16], r.name, r.calls, r.total)
                      for r in jobs.usage_windows(spark, out, part).collect())

    arrive(("2024-01-01 10:10:00", "view", 1.0), ("2024-01-01 12:30:00", "view", 2.0))
    assert rows("final") == [] and len(rows("open")) == 2  # 11:00 is not two hours before 12:30
    arrive(("2024-01-01 10:50:00", "view", 3.0), ("2024-01-01 13:05:00", "buy", 1.0))
    assert rows("final") == [("10:00", "view", 2, 4.0)] and rows("corrections") == []
    # late for a final window: a correction, also for a name that it had not; in time for an open one
    arrive(("2024-01-01 10:55:00", "view", 5.0), ("2024-01-01 10:56:00", "buy", None),
           ("2024-01-01 12:40:00", "view", 7.0))
    assert rows("final") == [("10:00", "view", 2, 4.0)]
    assert rows("corrections") == [("10:00", "buy", 1, None), ("10:00", "view", 1, 5.0)]
    # hours later: what is kept does not grow with the windows that have gone by
    for h in range(16, 24):
        arrive((f"2024-01-01 {h}:00:00", "view", 1.0))
        assert len(rows("open")) <= 4
    import os
    assert all(len([d for d in os.listdir(f"{out}/{part}") if d.startswith("batch=")]) <= 2
               for part in ("open", "seen"))
    finals = [r[:2] for r in rows("final")]
    assert len(finals) == len(set(finals))
    got = {(str(r.window_start)[11:13], r.name): (r.calls, r.mean_value)
           for r in jobs.corrected_usage(spark, out).collect()}
    want = {}
    for ts, name, value in every:
        want.setdefault((ts[11:13], name), []).append(value)
    assert got == {k: (len(v), sum(x for x in v if x is not None) / len([x for x in v if x is not None])
                       if any(x is not None for x in v) else None) for k, v in want.items()}


def test_search_sketches(spark):
    import random

    from tonearm.plans.metrics import merged_sketch, popular_in_sketch, search_sketch

    rnd = random.Random(4)
    rows = [(f"q{int(rnd.random() ** 3 * 60)}", f"2024-01-01 {rnd.randint(0, 5):02d}:{rnd.randint(0, 59):02d}:00")
            for _ in range(4000)] + [(None, "2024-01-01 00:00:00"), ("q1", None)]
    asked = spark.createDataFrame(rows, "q string, at string").withColumn("at", F.to_timestamp("at"))
    true = {}
    for q, at in rows:
        if q and at:
            true[q] = true.get(q, 0) + 1
    sketch = search_sketch(asked, "q", "at", kept=12).persist()
    assert max(r["count"] for r in sketch.groupBy("hour").count().collect()) == 12
    found = popular_in_sketch(sketch, 100).collect()
    assert all(r.n <= true[r.query] <= r.n + r.bound for r in found)
    most_missed = merged_sketch(sketch).where("query IS NULL").first().missed
    listed = {r.query: r.n for r in found}
    assert all(q in listed for q, n in true.items() if n > most_missed)
    assert all(listed[r.query] == true[r.query] for r in found if r.bound == 0)
    assert {r.query for r in found if r.bound == 0}
    # in any order and grouping
    hours = [sketch.where(F.hour("hour") == h) for h in range(6)]
    merged = merged_sketch(hours[5])
    for h in (1, 4, 0, 2, 3):
        merged = merged_sketch(merged.unionByName(merged_sketch(hours[h])))
    assert popular_in_sketch(merged, 100).collect() == found
    whole = popular_in_sketch(search_sketch(asked, "q", "at"), 100).collect()
    assert {r.query: (r.n, r.bound) for r in whole} == {q: (n, 0) for q, n in true.items()}


def test_usage_stream_has_open_windows_and_late_events(spark, tmp_path):
    src, log, check = (str(tmp_path / d) for d in ("in", "log", "check"))
    shape = "ts timestamp, event_type string, value double"

    def arrive(*rows):
        df = spark.createDataFrame(rows, "ts string, event_type string, value double")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
        jobs.usage_stream(spark.readStream.schema(shape).parquet(src), log, check).awaitTermination()
        return {(str(r.window_start)[11:16], r.name): (r.calls, r.mean_value)
                for r in jobs.current_usage(spark, log).collect()}

    assert jobs.current_usage(spark, log).count() == 0
    assert arrive(("2024-01-01 12:30:00", "view", 2.0)) == {("12:00", "view"): (1, 2.0)}
    arrive(("2024-01-01 16:30:00", "view", None), ("2024-01-01 16:59:59", "buy", 1.0))
    want = {("12:00", "view"): (2, 3.0), ("16:00", "view"): (1, None), ("16:00", "buy"): (1, 1.0)}
    assert arrive(("2024-01-01 12:31:00", "view", 4.0)) == want
    jobs.compact_usage(spark, log, str(tmp_path / "small"))
    assert jobs.current_usage(spark, str(tmp_path / "small")).count() == 3


def test_ratings_without_batches(spark, tmp_path):
    assert jobs.current_ratings(spark, str(tmp_path / "none")).count() == 0


def test_add_items_evaluates_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = items(spark, "a", "b")
    assert store.add_items(rows.mapInPandas(count, rows.schema), str(tmp_path / "i"), hashing_encoder())
    assert seen.value == 2
    store.compact_store(spark, str(tmp_path / "i"), str(tmp_path / "j"), 1)
    assert store.open_store(spark, str(tmp_path / "j")).count() == 2


def test_arrivals_of_a_stream_lie_in_files_of_bounded_size(spark, sf, tmp_path, monkeypatch):
    from tonearm.plans import queries as QU
    from tonearm.sources import testbed as tb

    monkeypatch.setattr(QU, "ARRIVALS", 500)
    monkeypatch.setattr(QU, "shared_folder", lambda s, purpose: str(tmp_path / purpose))
    got = QU.QUERIES["rating_stream"](spark, sf).collect()
    assert sorted(got) == sorted(tb.ratings(spark, sf).collect())
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "rating-stream/in")).groupBy(
        F.input_file_name()).count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 550
    log = spark.read.parquet(str(tmp_path / "rating-stream/log"))
    assert sorted(r.batch for r in log.select("batch").distinct().collect()) == [0, 1]
