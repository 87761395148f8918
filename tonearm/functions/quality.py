"""Validation as error lists and sanitizing as column expressions.

A bad row never stops a job: each rule adds its message to an ``errors`` array and the table is
split into valid and quarantined rows. ``strict`` makes the first bad row fail the job instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions.text import strip
from tonearm.schemas import ALL_FEATURES

# fixed values: ranges each feature must lie in
RANGES = {
    "danceability": (0.0, 1.0),
    "energy": (0.0, 1.0),
    "valence": (0.0, 1.0),
    "tempo": (0.0, 300.0),
    "instrumentalness": (0.0, 1.0),
    "acousticness": (0.0, 1.0),
    "liveness": (0.0, 1.0),
    "speechiness": (0.0, 1.0),
    "key": (0.0, 11.0),
    "mode": (0.0, 1.0),
    "time_signature": (3.0, 7.0),
}
# fixed values: what an unreadable feature becomes; any other becomes 0
FEATURE_DEFAULTS = {
    "danceability": 0.5, "energy": 0.5, "valence": 0.5, "tempo": 120.0, "time_signature": 4.0,
}
REQUIRED = ["id", "name", "artists", "album"]
MAX_RESULTS = 1000


def _errors(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def _broken(condition: Column, message: str) -> Column:
    # an unknown outcome is a failure too
    return F.when(~F.coalesce(condition, F.lit(False)), message)


def track_errors() -> Column:
    return _errors(
        _broken(F.col("id") != "", "id missing"),
        _broken(F.col("name") != "", "name missing"),
        _broken(F.size("artists") > 0, "artists missing"),
        _broken(F.col("album") != "", "album missing"),
        _broken((F.length("id") >= 10) | (F.coalesce("id", F.lit("")) == ""), "id malformed"),
    )


def feature_errors(columns: list[str]) -> Column:
    """Absent features are fine; NaN and values out of range are not."""
    return _errors(*[
        F.when(F.col(f).isNotNull() & ~F.col(f).between(*RANGES[f]), f"{f} out of range")
        for f in RANGES if f in columns])


def _number(c: str) -> Column:
    """A text as a number, or NULL; a type letter after the digits makes it no number."""
    return F.when(~F.col(c).cast("string").rlike(r"[0-9.][dDfF]\s*\z"),
                  F.expr(f"try_cast({c} AS DOUBLE)"))


def rating_errors(rating: str = "rating") -> Column:
    number = _number(rating)
    return _errors(
        _broken(number.isNotNull(), "rating not a number"),
        F.when(number.isNotNull() & ~number.between(1.0, 5.0), "rating out of range"))


def user_id_errors(user_id: str = "user_id") -> Column:
    u = F.col(user_id)
    return _errors(
        _broken(strip(u) != "", "user_id missing"),
        F.when((strip(u) != "") & ~F.length(u).between(3, 50), "user_id length"))


def query_errors(query: str = "query") -> Column:
    q = F.col(query)
    return _errors(
        _broken(strip(q) != "", "query missing"),
        F.when((strip(q) != "") & (F.length(q) > 100), "query too long"))


def source_id_errors(source_id: str) -> Column:
    """Playlist and artist ids: exactly 22 letters or digits of any script."""
    c = F.col(source_id)
    return _errors(_broken(c.rlike(r"\A[\p{L}\p{N}]{22}\z"), f"{source_id} malformed"))


def n_results_errors(n: str = "n") -> Column:
    """What ``check_n_results`` refuses, for a column of whole numbers."""
    return _errors(_broken(F.col(n).between(1, MAX_RESULTS), "number of results out of range"))


def split_valid(df: DataFrame, errors: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with a non-empty ``errors`` array)."""
    checked = df.withColumn("errors", errors)
    if strict:
        ok = F.when(F.size("errors") == 0, True).otherwise(
            F.raise_error(F.concat(F.lit("invalid row: "), F.array_join("errors", ", "))))
        return checked.filter(ok).drop("errors"), checked.limit(0)
    return (checked.filter(F.size("errors") == 0).drop("errors"),
            checked.filter(F.size("errors") > 0))


def check_table(df: DataFrame, required: list[str] = REQUIRED) -> None:
    """Raise unless the table has rows, the required columns and no repeated id."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if df.isEmpty():
        raise ValueError("the table is empty")
    if "id" in df.columns:
        twice = df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if not twice.isEmpty():
            raise ValueError("the table has repeated ids")


def check_n_results(n: int) -> None:
    if isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= MAX_RESULTS:
        raise ValueError(f"the number of results must be 1 to {MAX_RESULTS}")


def check_audio_targets(targets: DataFrame, names: list[str]) -> None:
    if not names:
        raise ValueError(f"targets need at least one of {ALL_FEATURES}")


def _to_long(c: str) -> Column:
    return F.coalesce(_number(c).try_cast("bigint"), F.lit(0))


def sanitize_tracks(df: DataFrame) -> DataFrame:
    """Strip names and artists, drop empty artists, make popularity and duration whole numbers."""
    artists = F.transform(F.filter("artists", lambda a: a.isNotNull() & (a != "")), strip)
    return df.withColumns({
        "name": strip(F.col("name")),
        "album": strip(F.col("album")),
        "artists": artists,
        "popularity": _to_long("popularity"),
        "duration_ms": _to_long("duration_ms"),
    })


def sanitize_features(df: DataFrame) -> DataFrame:
    """Features as numbers, unreadable ones replaced by their default; text fields unchanged."""
    return df.withColumns({
        f: F.coalesce(_number(f), F.lit(FEATURE_DEFAULTS.get(f, 0.0)))
        for f in ALL_FEATURES if f in df.columns})
