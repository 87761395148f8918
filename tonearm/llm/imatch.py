"""I-Match fingerprints in DataFrame functions only.

Terms whose share of documents lies in a band are the lexicon; a large group of near copies counts
there as about one document, or its own terms would leave the lexicon for being in every copy. A document's distinct terms of the
lexicon are sorted and hashed once for each of several random parts of the lexicon; two documents
are alike by the share of parts in which their hashes agree. Parts are of different sizes: large
ones agree for texts that are almost the same, small ones also where half the text has changed.

For the edited texts each document meets its successor by id: ids are cut into ranges, a range's
documents move to one task, and only the first document of each range is fetched for the range
before it. Terms are looked up and gathered inside those ranges, so texts move once.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.common import plain_columns, shuffle_partitions
from tonearm.session import written

# A term counts if it is in at least this share of the rows, and in two at least, and in at most this
# share of the documents that remain when large groups of near copies are one each.
BAND = (0.0005, 0.1)
# Near copies share a sketch: the smallest hashes, so many, of a quarter of their terms. A quarter of
# fewer than the least gives none; sketches of all terms find the copies of short documents.
SKETCH_TERMS, LEAST_SKETCH_TERMS, QUARTERS = 8, 4, 4
# Share of the rows that makes a group of one sketch large: there are at most (QUARTERS + 1) / 0.0005.
LARGE_GROUP = 0.0005
# What a document outside large groups weighs; one of a group of m weighs the m-th part.
_WEIGHT = 1 << 24
# Shares of the lexicon in its random parts.
PARTS = (2 / 3,) * 2 + (1 / 4,) * 2 + (1 / 16,) * 4 + (1 / 64,) * 4 + (1 / 256,) * 4
# Lexicon terms sent to every task at most: mean distinct terms of a document / BAND[0] bounds
# their number, whatever the number of documents; a larger lexicon is joined by shuffle.
BROADCAST_TERMS = 1_000_000
_FIRST = -(2**63)
_DRAWS = 3 << 16


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))


def sketches(words: str) -> list[Column]:
    """For each quarter of the sorted hashes of the terms, and for all of them, a hash that near
    copies share; null for a quarter of few terms. A changed word alters two quarters at most."""
    def of_quarter(k: int):
        return lambda h: F.shiftrightunsigned(h, 62) == k

    least = [F.slice(F.filter(words, of_quarter(k)), 1, SKETCH_TERMS) for k in range(QUARTERS)]
    return [*(F.when(F.size(h) >= LEAST_SKETCH_TERMS, F.xxhash64(F.lit(k), h))
              for k, h in enumerate(least)), F.xxhash64(F.lit(QUARTERS), F.col(words))]


def weighed(docs: DataFrame, n: int) -> DataFrame:
    """``words`` (the distinct terms) and ``weight`` of each of the ``n`` rows."""
    sketched = (
        docs.select(terms(F.col("text")).alias("words"))
        .withColumn("hashes", F.sort_array(F.transform("words", lambda w: F.xxhash64(w))))
        .select("words", *[c.alias(f"sketch{k}") for k, c in enumerate(sketches("hashes"))]))
    each = [f"sketch{k}" for k in range(QUARTERS + 1)]
    large = written(
        sketched.select(F.explode(F.array(*each)).alias("sketch")).where("sketch is not null")
        .groupBy("sketch").agg(F.count("*").alias("m")).where(F.col("m") >= max(2, LARGE_GROUP * n)),
        "large-groups")
    for k, name in enumerate(each):
        sketched = sketched.join(F.broadcast(
            large.select(F.col("sketch").alias(name), F.col("m").alias(f"m{k}"))), name, "left")
    most = F.greatest(F.lit(1), *[F.coalesce(f"m{k}", F.lit(1)) for k in range(len(each))])
    return sketched.select("words", F.ceil(F.lit(_WEIGHT) / most).cast("bigint").alias("weight"))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND,
            parts: tuple[float, ...] = PARTS) -> DataFrame:
    """``term`` (its hash) and ``mask`` (the parts it is in) of all terms inside the band, stored.

    Terms in rows that weigh less than two documents together belong to one group of near copies
    and are in, however few documents remain. The empty word is always there and in no part: it
    stands for documents without terms.
    """
    n = docs.count()
    # the empty word counts the documents that remain
    often = written(
        weighed(docs, n).select("weight", F.explode(F.concat(F.array(F.lit("")), "words")).alias("word"))
        .groupBy(F.xxhash64("word").alias("term"))
        .agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
        .where(F.col("n") >= max(2, band[0] * n)), "often")
    every = F.col("term") == F.xxhash64(F.lit(""))
    remain = sum(r["weight"] for r in often.where(every).collect())
    counted = often.where(~every & (
        (F.col("weight") < 2 * _WEIGHT) | (F.col("weight") <= band[1] * remain)))
    mask = F.lit(0)
    for k, share in enumerate(parts):
        draw = F.pmod(F.xxhash64("term", F.lit(k)), F.lit(_DRAWS))
        mask = mask.bitwiseOR(F.when(draw < int(share * _DRAWS), 1 << k).otherwise(0))
    none = docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term"), F.lit(0).alias("mask"))
    return written(counted.select("term", mask.alias("mask")).unionByName(none), "lexicon")


def with_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """``range`` of each row: about equally many rows each, ascending with ``key``."""
    keyed = docs.withColumn("key_place", F.col("key").cast("double"))
    cuts = sorted(set(keyed.where("doc_id is not null").approxQuantile(
        "key_place", [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    if not cuts:
        return docs.withColumn("range", F.lit(0))
    found = Bucketizer(splits=[-float("inf"), *cuts, float("inf")],
                       inputCol="key_place", outputCol="found").transform(keyed)
    return found.withColumn("range", F.col("found").cast("int")).drop("key_place", "found")


def _hashes(parts: int) -> Column:
    """Hash of the sorted distinct terms of each part; null if it has none, but the first part then
    has the hash of the whole text."""
    each = []

    def of_part(bit: Column):
        return lambda t: t["mask"].bitwiseAND(bit) != 0

    for k in range(parts):
        some = F.col("present").bitwiseAND(F.lit(1 << k)) != 0
        one = F.when(some, F.xxhash64(F.filter("found", of_part(F.lit(1 << k)))))
        each.append(one if k else one.otherwise(F.xxhash64(F.lit("text"), F.col("whole"))))
    return F.array(*each)


def _text_of(hashes: str) -> Column:
    each = F.transform(F.col(hashes), lambda h: F.lower(F.lpad(F.hex(h), 16, "0")))
    return F.array_join(each, ":", "-")


def likeness(a: str, b: str) -> Column:
    """Share of the parts that either text has terms of in which the hashes agree."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull()))
    return same / either


def fingerprint_documents(docs: DataFrame, band: tuple[float, float] = BAND,
                          parts: tuple[float, ...] = PARTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and likenesses.

    The edited text has its last floor(n / 2) of n code points replaced by the first as many (or
    all) of the next document by ascending id; after the last comes the first, and a single
    document follows itself. Null texts are empty. Rows of one id follow each other by text, rows
    without an id come first. Equal texts have equal fingerprints; texts without a term of the
    lexicon are fingerprinted by the whole text, so that they only match their copies; a part
    without terms shows as ``-``. Columns:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    docs = plain_columns(docs, doc_id=doc_id, text=text).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST)).alias("key"))
    known = lexicon(docs, band, parts)
    if known.count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    ranged = with_ranges(docs, 4 * shuffle_partitions(docs.sparkSession))
    # the first text of each range, and the range that follows it: a row for each range
    heads = ranged.groupBy("range").agg(F.min("key").alias("key"))
    after = heads.select("range", F.coalesce(
        F.lead("range").over(Window.orderBy("range")),
        F.min("range").over(Window.partitionBy())).alias("next_range"))
    firsts = written(
        ranged.join(F.broadcast(heads), ["range", "key"]).groupBy("range")
        .agg(F.min("text").alias("first_text")), "first-texts")
    follows = written(
        after.join(firsts.withColumnRenamed("range", "next_range"), "next_range"), "follows")

    order = Window.partitionBy("range").orderBy("key", "text")
    placed = (
        ranged.withColumn("row", F.row_number().over(order))
        .withColumn("after", F.lead("text").over(order))
        .join(follows, "range"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = placed.select(
        "range", "row", "doc_id", n.cast("bigint").alias("n_chars"), "text",
        F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"),
                 F.left(F.coalesce("after", "first_text"), half)).alias("edited"),
        F.when(F.col("after").isNull(), F.col("next_range")).otherwise(F.col("range")).alias("to_range"),
        F.when(F.col("after").isNull(), 1).otherwise(F.col("row") + 1).alias("to_row"))
    # read twice from one shuffle: what a row is, and its terms in narrow rows
    about = edited.select("range", "row", "doc_id", "n_chars", "to_range", "to_row",
                          F.unhex(F.sha2("edited", 256)).alias("sha"))
    both = edited.select("range", "row", "doc_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("which"), F.xxhash64(c).alias("whole"),
                 F.concat(F.array(F.lit("")), terms(F.col(c))).alias("words"))
        for k, c in enumerate(("text", "edited"))])).alias("v"))
    looked_up = (
        both.select("range", "row", "doc_id", "v.which", "v.whole", F.explode("v.words").alias("word"))
        .withColumn("term", F.xxhash64("word")).drop("word").join(known, "term"))
    hashed = (
        looked_up.groupBy("range", "row", "doc_id", "which", "whole")
        .agg(F.bit_or("mask").alias("present"),
             F.array_sort(F.collect_list(F.struct("term", "mask"))).alias("found"))
        .select("range", "row", "which", _hashes(len(parts)).alias("hashes")))
    of = {k: F.max(F.when(F.col("which") == k, F.col("hashes"))) for k in (0, 1)}
    prints = written(
        hashed.groupBy("range", "row").agg(of[0].alias("own"), of[1].alias("other"))
        .join(about, ["range", "row"]), "fingerprints")
    following = prints.select(F.col("range").alias("to_range"), F.col("row").alias("to_row"),
                              F.col("own").alias("next"))
    return prints.join(following, ["to_range", "to_row"]).select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        _text_of("own").alias("fingerprint"), _text_of("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "next").alias("near_next"))
