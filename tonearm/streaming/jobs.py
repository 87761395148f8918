"""Incremental twins of the batch operators, as Structured Streaming jobs.

Each micro-batch is written to a folder named by its batch id, replacing what an earlier attempt
of the same batch left there. A restarted job therefore never counts a batch twice. What the ratings
job knows lies in Spark's state store; the other jobs keep theirs in such folders.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tonearm.operators.encoder import Encoder
from tonearm.operators.ranking import dedup_first
from tonearm.schemas import RATING, STORED_ITEM
from tonearm.sources.preferences import latest_ratings, path_exists
from tonearm.sources.store import new_items, stored_columns


_USAGE = "window_start timestamp, name string, calls bigint, values bigint, total double"


def _start(stream: DataFrame, sink, checkpoint: str, once: bool, mode: str = "append"):
    writer = stream.writeStream.foreachBatch(sink).outputMode(mode) \
        .option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


# --- ratings: last one wins --------------------------------------------------------------------

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def rating_stream(events: DataFrame, path: str, checkpoint: str, once: bool = True) \
        -> StreamingQuery:
    """Keep the last rating of each user and track in the state store as events arrive.

    The state holds one row per user and track, on the executors' disks and in ``checkpoint``. A batch
    reads and writes only the keys it brings; the ratings it changes, and no others, are written to
    ``path``: events that come too late to win leave no trace. ``current_ratings`` reads the state.
    """
    spark = events.sparkSession
    if spark.conf.get(_PROVIDER, "").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)  # state is not bounded by memory
    # the batch that brought a rating; of equal events the first one counts
    now = -F.unix_micros(F.current_timestamp())
    last = events.withColumn("arrived", now).groupBy("user_id", "track_id").agg(
        F.max(F.struct("ts", "seq", "rating", "arrived")).alias("last"))
    changed = last.where(F.col("last.arrived") == now)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.select("user_id", "track_id", "last.rating", "last.ts", "last.seq") \
            .write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(changed, sink, checkpoint, once, "update")


def current_ratings(spark: SparkSession, checkpoint: str, schema: T.StructType = RATING) -> DataFrame:
    """The ratings as of the last batch, out of the state store: one row each, nothing to merge.

    None if no batch has ended yet; ``schema`` is that of the events.
    """
    if not path_exists(spark, f"{checkpoint}/state/0/0"):
        return spark.createDataFrame([], schema)
    state = spark.read.format("statestore").load(checkpoint)
    names = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    return state.select("key.user_id", "key.track_id", "value.max.rating", "value.max.ts",
                        "value.max.seq").select(*[
                            F.col(f.name).cast(f.dataType).alias(f.name) for f in names
                            if f.name in ("user_id", "track_id", "rating", "ts", "seq")])


def changed_ratings(spark: SparkSession, path: str, since: int = 0,
                    schema: T.StructType = RATING) -> DataFrame:
    """The ratings that batches from ``since`` on changed, the last change of each."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    names = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    log = spark.read.schema(T.StructType([*names, T.StructField("batch", T.LongType())])).parquet(path)
    return latest_ratings(log.where(F.col("batch") >= since))


# --- items: store what is not stored yet -------------------------------------------------------

# Buckets of the store by hash of the id, bits for each id in a file's filter, and places that an id
# sets there: one in a hundred ids that are not in a file seems to be.
BUCKETS, BITS, PLACES = 64, 10, 7
# Ids in one file, which bounds its filter.
_FILE_ROWS = 1_000_000
_FILTER = "bucket int, file string, bits binary"


def _bucket(c: str = "id") -> Column:
    return F.pmod(F.xxhash64(F.col(c).cast("string"), F.lit(1)), F.lit(BUCKETS)).cast("int")


def _hashes(c: str = "id") -> list[Column]:
    own = F.col(c).cast("string")
    return [F.xxhash64(own, F.lit(2)).alias("h"), F.xxhash64(own, F.lit(3)).alias("step")]


def _bits_of(h: np.ndarray, step: np.ndarray, size: int) -> np.ndarray:
    """The places that each id sets among ``size`` bits, a row of them for each."""
    with np.errstate(over="ignore"):
        at = h.astype(np.uint64)[:, None] + np.arange(PLACES, dtype=np.uint64) * (
            step.astype(np.uint64)[:, None] | np.uint64(1))
    return (at % np.uint64(size)).astype(np.int64)


def _filters(spark: SparkSession, here: str) -> DataFrame:
    """A Bloom filter of the ids in each file of a batch."""
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        size = max(64, BITS * len(rows))
        bits = np.zeros(size, bool)
        bits[_bits_of(rows["h"].to_numpy(), rows["step"].to_numpy(), size).ravel()] = True
        return pd.DataFrame({"bucket": [int(rows["bucket"].iloc[0])], "file": pd.Series([rows["file"].iloc[0]], dtype=object),
                             "bits": [size.to_bytes(8, "little") + np.packbits(bits).tobytes()]})

    stored = spark.read.schema("id string, bucket int").parquet(here)
    return stored.select("bucket", F.col("_metadata.file_path").alias("file"), *_hashes()) \
        .groupBy("file").applyInPandas(build, _FILTER)


def files_with(spark: SparkSession, path: str, ids: DataFrame, but: int | None = None) -> list[str]:
    """The store's files that may hold any of ``ids``, by their filters; not those of batch ``but``.

    No file of the store is opened for this. What comes back is a path for each file to be read.
    """
    if not path_exists(spark, f"{path}/_filters"):
        return []
    filters = spark.read.schema(f"{_FILTER}, batch bigint").parquet(f"{path}/_filters")
    filters = filters.where(F.col("batch") != (-2 if but is None else but))
    asked = ids.select(_bucket().alias("bucket"), *_hashes()).distinct()

    def probe(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        h, step = asked["h"].to_numpy(np.int64), asked["step"].to_numpy(np.int64)
        found = []
        for file, packed in zip(rows["file"], rows["bits"]):
            size = int.from_bytes(packed[:8], "little")
            bits = np.unpackbits(np.frombuffer(packed, np.uint8, offset=8), count=size).astype(bool)
            if len(h) and bits[_bits_of(h, step, size)].all(axis=1).any():
                found.append(file)
        return pd.DataFrame({"file": pd.Series(found, dtype=object)})

    # a bucket's filters are dealt to parts, and the ids it is asked for go to each of them
    parts = F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1)))
    met = filters.withColumn("part", F.pmod(F.xxhash64("file"), F.lit(_PARTS)).cast("int")) \
        .groupBy("bucket", "part").cogroup(
            asked.withColumn("part", parts).groupBy("bucket", "part")).applyInPandas(probe, "file string")
    return [r.file for r in met.collect()]


_PARTS = 4


def ingest_stream(items: DataFrame, path: str, checkpoint: str, encoder: Encoder, *,
                  ts: str = "ts", once: bool = True) -> StreamingQuery:
    """Encode and store arriving items whose id is not in the store, however late they come.

    The store lies in buckets by hash of the id, with a Bloom filter of the ids beside each file. A
    batch opens only files whose filter says that they may hold an id it brings, so its work does not
    grow with the store. The first of a batch's rows with one id is taken.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        here = f"{path}/batch={batch_id}"
        one = dedup_first(batch, "id", ts).persist()  # read several times below
        # an earlier attempt of this batch is about to be replaced, so it does not count
        files = files_with(spark, path, one, batch_id)
        stored = spark.read.schema("id string").parquet(*files) if files else \
            spark.createDataFrame([], "id string")
        rows = encoder(stored_columns(new_items(one, stored, small=True)))
        rows.select(*[f.name for f in STORED_ITEM.fields], _bucket().alias("bucket")) \
            .repartition("bucket").write.mode("overwrite").option("maxRecordsPerFile", _FILE_ROWS) \
            .partitionBy("bucket").parquet(here)
        _filters(spark, here).write.mode("overwrite").parquet(f"{path}/_filters/batch={batch_id}")
        one.unpersist()

    return _start(items, sink, checkpoint, once)


def compact_items(spark: SparkSession, path: str, target: str) -> None:
    """Write the items of a store's many batches as one batch of a new store."""
    here = f"{target}/batch=-1"
    open_stream_store(spark, path).drop("batch").withColumn("bucket", _bucket()).repartition("bucket") \
        .write.mode("overwrite").option("maxRecordsPerFile", _FILE_ROWS).partitionBy("bucket").parquet(here)
    _filters(spark, here).write.mode("overwrite").parquet(f"{target}/_filters/batch=-1")


def open_stream_store(spark: SparkSession, path: str) -> DataFrame:
    """Items stored by ``ingest_stream``, with the batch that brought each."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], STORED_ITEM)
    schema = T.StructType([*STORED_ITEM.fields, T.StructField("batch", T.LongType()),
                           T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(schema).parquet(path).drop("bucket")


# --- live metrics ------------------------------------------------------------------------------

def usage_stream(events: DataFrame, path: str, checkpoint: str, *, ts: str = "ts",
                 name: str = "event_type", value: str = "value", window: str = "1 hour",
                 once: bool = True) -> StreamingQuery:
    """Calls and values per name and tumbling window, as events arrive.

    A batch adds its own counts and sums to a log, which is added up on reading: open windows
    show at once, late events count, and no state is kept.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(F.window(ts, window).alias("w"), F.col(name).cast("string").alias("name")) \
            .agg(F.count(F.lit(1)).alias("calls"), F.count(value).alias("values"),
                 F.sum(F.col(value).cast("double")).alias("total")) \
            .select(F.col("w.start").alias("window_start"), "name", "calls", "values", "total") \
            .write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(events, sink, checkpoint, once)


def current_usage(spark: SparkSession, path: str) -> DataFrame:
    """(window_start, name, calls, mean_value) of all batches written so far."""
    if not path_exists(spark, path):
        return spark.createDataFrame(
            [], "window_start timestamp, name string, calls bigint, mean_value double")
    return spark.read.schema(_USAGE).parquet(path).groupBy("window_start", "name").agg(
        F.sum("calls").alias("calls"),
        F.try_divide(F.sum("total"), F.sum("values")).alias("mean_value"))


def compact_usage(spark: SparkSession, path: str, target: str) -> None:
    """Add a log up into a new one with one row per window and name."""
    spark.read.schema(_USAGE).parquet(path).groupBy("window_start", "name").agg(
        *[F.sum(c).alias(c) for c in ("calls", "values", "total")]) \
        .write.mode("overwrite").parquet(f"{target}/batch=-1")


def final_usage_stream(events: DataFrame, path: str, checkpoint: str, *, ts: str = "ts",
                       name: str = "event_type", value: str = "value", window: str = "1 hour",
                       delay: str = "2 hours", once: bool = True) -> StreamingQuery:
    """Calls and values per name and window, each emitted once as final, and corrections to that.

    The watermark is the latest event time of earlier batches less ``delay``. A window that ends before it
    gets its final rows, once; rows that come for it later are not dropped but emitted as corrections,
    so final rows and corrections add up to all events. What is kept between batches is the sums of
    the open windows and the latest event time, in a folder for each batch; only the last two folders stay.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _before(spark, path, batch_id)
        seen = None if before is None else spark.read.schema("seen timestamp").parquet(
            f"{path}/seen/batch={before}").first().seen
        kept = spark.createDataFrame([], _OPEN) if before is None else \
            spark.read.schema(_OPEN).parquet(f"{path}/open/batch={before}")
        counted = batch.groupBy(F.window(ts, window).alias("w"), F.col(name).cast("string").alias("name")) \
            .agg(F.count(F.lit(1)).alias("calls"), F.count(value).alias("values"),
                 F.sum(F.col(value).cast("double")).alias("total"), F.max(ts).alias("latest")) \
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "name",
                    "calls", "values", "total", "latest").persist()
        latest = counted.agg(F.max("latest")).first()[0]
        now = max((t for t in (seen, latest) if t is not None), default=None)
        span = F.expr(f"INTERVAL {delay}")
        late = F.lit(False) if seen is None else F.col("window_end") <= F.lit(seen) - span
        over = F.lit(False) if now is None else F.col("window_end") <= F.lit(now) - span
        _put(counted.where(late).select(*_NAMES), f"{path}/corrections/batch={batch_id}")
        every = kept.unionByName(counted.where(~late).drop("latest")) \
            .groupBy("window_start", "window_end", "name").agg(
                *[F.sum(c).alias(c) for c in ("calls", "values", "total")]).persist()
        _put(every.where(over).select(*_NAMES), f"{path}/final/batch={batch_id}")
        _put(every.where(~over), f"{path}/open/batch={batch_id}")
        _put(spark.range(1).select(F.lit(now).cast("timestamp").alias("seen")), f"{path}/seen/batch={batch_id}")
        every.unpersist()
        counted.unpersist()
        if before is not None:
            _forget(spark, path, before)

    return _start(events, sink, checkpoint, once)


_NAMES = ["window_start", "name", "calls", "values", "total"]
_OPEN = "window_start timestamp, window_end timestamp, name string, calls bigint, values bigint, total double"


def _put(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").parquet(path)  # a few sums


def _batches(spark: SparkSession, path: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[6:]) for n in names if n.startswith("batch="))


def _before(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """The last batch before this one that was written whole."""
    return max((b for b in _batches(spark, f"{path}/seen") if b < batch_id), default=None)


def _forget(spark: SparkSession, path: str, before: int) -> None:
    """Takes away the sums that batches before ``before`` left."""
    for part in ("open", "seen"):
        for batch in _batches(spark, f"{path}/{part}"):
            if batch < before:
                where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}/batch={batch}")
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def usage_windows(spark: SparkSession, path: str, part: str) -> DataFrame:
    """(window_start, name, calls, values, total, batch) of the ``final``, ``corrections`` or ``open`` rows."""
    shape = f"{_USAGE}, batch bigint"
    if not path_exists(spark, f"{path}/{part}"):
        return spark.createDataFrame([], shape)
    rows = spark.read.schema(shape).parquet(f"{path}/{part}")
    # of the open sums only those of the last batch that was written whole count
    return rows.where(F.col("batch") == max(_batches(spark, f"{path}/seen"), default=-1)) \
        if part == "open" else rows


def corrected_usage(spark: SparkSession, path: str, with_open: bool = True) -> DataFrame:
    """(window_start, name, calls, mean_value): final rows with their corrections and, if wanted, the
    windows that are still open."""
    parts = ["final", "corrections", *(["open"] if with_open else [])]
    every = usage_windows(spark, path, parts[0])
    for part in parts[1:]:
        every = every.unionByName(usage_windows(spark, path, part))
    return every.groupBy("window_start", "name").agg(
        F.sum("calls").alias("calls"),
        F.try_divide(F.sum("total"), F.sum("values")).alias("mean_value"))
