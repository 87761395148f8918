"""Delivered JSON files as flat, checked track and feature tables.

The remote catalogue calls themselves are not made here: their answers are read as files. Each
reader returns ``(valid, quarantined)``. Nothing delivered vanishes: an answer that is no JSON, is cut
short or has no list is quarantined as a whole, with its text, file and line; one that is readable in
part gives the tracks that could be read and is quarantined besides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.functions import quality as Q
from tonearm.operators.ranking import dedup_last
from tonearm.schemas import (
    ALL_FEATURES, RAW_ARTIST_TOP, RAW_FEATURES, RAW_PLAYLIST, RAW_SEARCH, TRACK,
)

Pair = tuple[DataFrame, DataFrame]


_BROKEN = "_broken"


def read_landing(spark: SparkSession, path: str, schema: T.StructType,
                 whole_file: bool = False) -> DataFrame:
    """One answer per line, or one per file with ``whole_file``: the columns of ``schema``, ``file``,
    ``block`` and ``answer`` (where it came from), ``broken`` and ``record`` (its text).

    Blank lines are no answers.
    """
    lines = spark.read.text(path, wholetext=whole_file).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("answer"))
    read = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    parsed = lines.withColumn("parsed", F.from_json(
        "value", read, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}))
    return parsed.select(*[f"parsed.{c}" for c in schema.names], "file", "block", "answer",
                         F.col(f"parsed.{_BROKEN}").isNotNull().alias("broken"),
                         F.col("value").alias("record")).where(F.trim("record") != "")


def _refused(answers: DataFrame, missing: Column, what: str) -> DataFrame:
    """(seq, errors, file, line, record) of answers that cannot be read, or only in part."""
    # lines are numbered in each block a file is read in; the blocks before it add theirs
    sizes = answers.groupBy("file", "block").agg(
        F.min("answer").alias("first"), F.max("answer").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "block", "first", F.coalesce(
        F.sum(F.col("last") - F.col("first") + 1).over(before), F.lit(0)).alias("earlier"))
    error = F.when(F.col("broken") & missing, "answer unreadable") \
        .when(F.col("broken"), "answer readable in part").when(missing, what)
    bad = answers.select("file", "block", "answer", "record", error.alias("error")).where("error IS NOT NULL")
    return bad.join(starts, ["file", "block"]).select(
        F.struct(F.struct("file", "answer").alias("source"), F.lit(None).cast("int").alias("pos")).alias("seq"),
        F.array("error").alias("errors"), "file",
        (F.col("earlier") + F.col("answer") - F.col("first") + 1).alias("line"), "record")


def _all_read(answers: DataFrame, missing: Column) -> DataFrame:
    """The answers, failing at the first one that cannot be read as a whole."""
    whole = F.when(F.col("broken") | missing, F.raise_error(
        F.concat(F.lit("unreadable answer in "), "file", F.lit(": "), F.substring("record", 1, 200))))
    return answers.where(whole.otherwise(F.lit(True)).cast("boolean"))


def flat_track(raw: str = "t") -> list[Column]:
    """The ten track columns out of a nested track struct; numbers are still text."""
    t = lambda f: F.col(f"{raw}.{f}")
    return [
        t("id").alias("id"),
        t("name").alias("name"),
        F.transform(t("artists"), lambda a: a["name"]).alias("artists"),
        t("album.name").alias("album"),
        t("album.release_date").alias("release_date"),
        t("popularity").alias("popularity"),
        t("duration_ms").alias("duration_ms"),
        t("explicit").alias("explicit"),
        F.get(F.map_values(t("external_urls")), F.lit(0)).alias("external_urls"),
        t("preview_url").alias("preview_url"),
    ]


def report_track(raw: str = "t") -> list[Column]:
    """Track columns for ranking: defaults for what is missing, artist ids, empty genres."""
    t = lambda f: F.col(f"{raw}.{f}")
    none = F.array().cast("array<string>")
    whole = lambda f: F.expr(
        f"coalesce(try_cast(try_cast({raw}.{f} AS DOUBLE) AS BIGINT), 0L)")
    return [
        F.coalesce(t("id"), F.lit("")).alias("id"),
        F.coalesce(t("name"), F.lit("Unknown")).alias("name"),
        F.coalesce(F.transform(t("artists"), lambda a: a["name"]), none).alias("artists"),
        F.coalesce(F.transform(t("artists"), lambda a: a["id"]), none).alias("artist_ids"),
        F.coalesce(t("album.name"), F.lit("")).alias("album"),
        F.coalesce(t("album.release_date"), F.lit("")).alias("release_date"),
        whole("popularity").alias("popularity"),
        whole("duration_ms").alias("duration_ms"),
        F.coalesce(t("explicit"), F.lit(False)).alias("explicit"),
        F.coalesce(F.get(F.map_values(t("external_urls")), F.lit(0)), F.lit("#"))
        .alias("external_urls"),
        t("preview_url").alias("preview_url"),
        none.alias("genres"),
    ]


def _checked(nested: DataFrame, strict: bool) -> Pair:
    """Validate first, then sanitize: a name of blanks passes and ends up empty."""
    valid, bad = Q.split_valid(nested, Q.track_errors(), strict)
    return Q.sanitize_tracks(valid), bad


def _flattened(answers: DataFrame, nested: str, strict: bool, inner: str = "t") -> Pair:
    """Explode the tracks of every answer and check them; null tracks are left out.

    ``seq`` (file, answer, place) keeps the delivered order whatever happens to the rows later.
    """
    if strict:
        answers = _all_read(answers, F.col(nested).isNull())
    raw = answers.select(F.struct("file", "answer").alias("source"), F.posexplode(nested).alias("pos", "t"))
    raw = raw.select(F.struct("source", "pos").alias("seq"), F.col(inner).alias("t")) \
        .filter(F.col("t").isNotNull())
    valid, bad = _checked(raw.select("seq", *flat_track()), strict)
    refused = _refused(answers, F.col(nested).isNull(), "answer without tracks")
    return valid, bad.withColumn("file", F.col("seq.source.file")).unionByName(
        refused, allowMissingColumns=True)


def search_results(spark: SparkSession, path: str, strict: bool = False,
                   whole_file: bool = False) -> Pair:
    return _flattened(read_landing(spark, path, RAW_SEARCH, whole_file), "tracks.items", strict)


def playlist_tracks(spark: SparkSession, path: str, strict: bool = False,
                    whole_file: bool = False) -> Pair:
    return _flattened(read_landing(spark, path, RAW_PLAYLIST, whole_file), "items", strict,
                      "t.track")


def artist_top_tracks(spark: SparkSession, path: str, strict: bool = False,
                      whole_file: bool = False) -> Pair:
    return _flattened(read_landing(spark, path, RAW_ARTIST_TOP, whole_file), "tracks", strict)


def track_features(spark: SparkSession, path: str, wanted: DataFrame | None = None,
                   strict: bool = False) -> Pair:
    """Feature rows for the wanted ids: sanitize first, then validate."""
    answers = read_landing(spark, path, RAW_FEATURES).where(F.trim("record") != "null")
    missing = F.col("id").isNull()
    if strict:
        answers = _all_read(answers, missing)
    raw = answers.where(~missing).select(*RAW_FEATURES.names)
    if wanted is not None:
        raw = raw.join(wanted.select("id"), "id", "left_semi")
    clean = Q.sanitize_features(raw)
    valid, bad = Q.split_valid(clean, Q.feature_errors(clean.columns), strict)
    refused = _refused(answers, missing, "features without id")
    return valid, bad.unionByName(refused.drop("seq"), allowMissingColumns=True)


_ANALYSIS = T.StructType([T.StructField("id", T.StringType()), T.StructField("analysis", T.StringType())])


def track_analysis(spark: SparkSession, ids: DataFrame, path: str) -> Pair:
    """(id, analysis): the opaque analysis as VARIANT, an empty object where there is none; and the
    lines that cannot be read.

    Files hold one ``{"id": ..., "analysis": {...}}`` per line.
    """
    answers = read_landing(spark, path, _ANALYSIS)
    found = ids.select("id").distinct().join(
        answers.where(F.col("id").isNotNull()).select("id", "analysis"), "id", "left").select(
        "id", F.parse_json(F.coalesce("analysis", F.lit("{}"))).alias("analysis"))
    return found, _refused(answers, F.col("id").isNull(), "analysis without id").drop("seq")


def attach_features(tracks: DataFrame, features: DataFrame) -> DataFrame:
    """Tracks with features where there are any; a column both have is the track's."""
    extra = [c for c in features.columns if c not in tracks.columns]
    return tracks.join(features.select("id", *extra), "id", "left")


def collect_tracks(sources: list[DataFrame], features: DataFrame | None = None,
                   spark: SparkSession | None = None) -> DataFrame:
    """Union of the sources in order, last copy of an id wins at the first one's place."""
    if not sources:
        return spark.createDataFrame([], TRACK)
    tagged = [s.withColumn("seq", F.struct(F.lit(i).alias("source"), F.col("seq").alias("at")))
              for i, s in enumerate(sources)]
    merged = dedup_last(reduce(DataFrame.unionByName, tagged))
    if features is None:
        return merged
    return attach_features(merged, features.select(
        "id", *[c for c in features.columns if c in ALL_FEATURES]))


def save_csv(df: DataFrame, path: str) -> str:
    """Write a CSV folder with a header; arrays and structs become JSON text.

    The path gets ``.csv`` when it has not; an empty table writes nothing.
    """
    path = path if path.endswith(".csv") else path + ".csv"
    if df.isEmpty():
        return path
    flat = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map")
            else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("header", True) \
        .option("encoding", "UTF-8").csv(path)
    return path
