"""Lines that many documents share, dropped from all of them but the one of largest id.

Lines become hashes of their keys, dealt by ranges of the hash and sorted there by document and
position, so that one streaming pass over a group meets each document's first occurrence in turn.
What goes back to a document is not its text but a bitmap with one bit for each line, of which only
the 64-bit words that drop something are stored. DataFrame functions do all of it.

A line may stand in a third of all documents. Its rows are dealt to ``SALTS`` groups by document, so
a group holds whole documents; each group passes on its first few documents only, and the groups of
a line that is dropped get the verdict back one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.common import plain_columns, shuffle_partitions
from tonearm.session import written

# A line in fewer documents stays.
LEAST_DOCS = 3
# Code points of a key; shorter lines stay.
LEAST_CHARS = 20
# Groups into which the rows of one line are dealt; one bit of a long for each.
SALTS = 64
_BLANKS = " \t\n\v\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Second hash of a key, so that 128 bits tell lines apart.
_SEED = 11


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(_BLANKS))
    plain = F.octet_length(key) == F.char_length(key)
    return F.when(plain, F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def _set(bits: Column, place: Column) -> Column:
    return F.call_function("shiftright", bits, place.cast("int")).bitwiseAND(F.lit(1)) == 1


def _occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    """Hashes of the long lines of each document, with the line's place."""
    lines = docs.where("doc IS NOT NULL AND text IS NOT NULL").select(
        "doc", F.xxhash64("text").alias("version"),
        F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.select("doc", "version", "place", line_key(F.col("line")).alias("key")).where(
        F.char_length("key") >= least_chars).select(
            "doc", "version", "place", F.xxhash64("key").alias("h"),
            F.xxhash64(F.lit(_SEED), "key").alias("h2"),
            F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"))


def keep_bitmaps(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, version, keep)`` for each document that loses a line.

    ``version`` is the hash of its text, which tells rows of one id apart. ``keep`` is the bitmap of
    its lines in 64-bit words, as an array of ``(word, bits)`` by ascending word: a line at ``place``
    stays if bit ``place % 64`` of word ``place // 64`` is set, and words that are left out are all set.
    """
    lines = _occurrences(plain_columns(docs, doc=doc_id, text=text), least_chars)
    # A range of (h, h2, salt) holds whole groups, so the window below needs no other exchange.
    dealt = lines.repartitionByRange(shuffle_partitions(docs.sparkSession), "h", "h2", "salt")
    group = Window.partitionBy("h", "h2", "salt").orderBy(F.desc("doc"), "version", "place")
    before = F.lag("doc").over(group)
    first = dealt.withColumn("first", before.isNull() | (before != F.col("doc")))
    ordered = written(first.withColumn("nth", F.sum(F.col("first").cast("int")).over(
        group.rowsBetween(Window.unboundedPreceding, 0))), "lines")

    heads = ordered.where(F.col("first") & (F.col("nth") <= least_docs))
    verdicts = heads.groupBy("h", "h2").agg(
        F.max("doc").alias("stays"), F.count("*").alias("docs"),
        F.bit_or(_bit(F.col("salt"))).alias("salts")).where(F.col("docs") >= least_docs)
    verdicts = verdicts.select("h", "h2", "stays", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: _set(F.col("salts"), s))).alias("salt"))

    dropped = ordered.join(verdicts, ["h", "h2", "salt"]).where(F.col("doc") < F.col("stays"))
    word = F.floor(F.col("place") / 64).cast("int").alias("word")
    words = dropped.groupBy("doc", "version", word).agg(
        F.bitwise_not(F.bit_or(_bit(F.col("place") % 64))).alias("bits"))
    return words.groupBy("doc", "version").agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def _gone(keep: Column) -> Column:
    """Places of the lines whose bit is not set."""
    bits = F.sequence(F.lit(0), F.lit(63))
    return F.flatten(F.transform(keep, lambda w: F.transform(
        F.filter(bits, lambda b: ~_set(w["bits"], b)), lambda b: w["word"] * 64 + b)))


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``n_lines``, ``n_dropped``, ``keep`` and ``kept_text``.

    Lines lie between line feeds. A line's key is the line without ASCII blanks at its ends and with
    A-Z in lower case. Keys of ``least_chars`` code points and more that ``least_docs`` documents hold
    lose all their lines but those in the document of largest id. ``keep`` is the bitmap of
    ``keep_bitmaps``, null where nothing goes; ``kept_text`` is the other lines, joined by line feeds.

    Null and empty texts are one empty line. A key that a document holds several times counts once
    and goes or stays as a whole. Rows of the same id are one document: they count once for a key, and
    all of them keep a key that stays there; exact copies get the same result. Rows without an id
    neither count nor lose lines. Columns of ``docs`` named like the new ones give way to them.
    """
    new = ("n_lines", "n_dropped", "keep", "kept_text")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in new])
    bitmaps = keep_bitmaps(docs, least_docs, least_chars, doc_id, text)
    rows = docs.select(F.struct("*").alias("row"))
    value = F.col(f"row.`{text}`")
    # the bitmaps of a partition are hashed; texts move once and are not sorted
    found = rows.join(bitmaps.hint("shuffle_hash"), (F.col(f"row.`{doc_id}`") == F.col("doc"))
                      & (F.xxhash64(value) == F.col("version")), "left")
    # explode() of one array: a column of its own, where a projection would be split for each line
    lines = found.select("row", "keep", F.explode(
        F.array(F.split(F.coalesce(value, F.lit("")), "\n"))).alias("lines"), _gone(F.col("keep")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cut = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    kept = F.when(F.col("keep").isNull(), F.coalesce(value, F.lit(""))).otherwise(cut)
    dropped = F.when(F.col("keep").isNull(), 0).otherwise(F.size("gone"))
    result = lines.select(
        "row", F.size("lines").cast("bigint").alias("n_lines"),
        dropped.cast("bigint").alias("n_dropped"), "keep", kept.alias("kept_text"))
    return result.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *new)
