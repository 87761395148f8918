"""Text columns: cleaning, titles, slugs, documents and the free-text request parser.

Letters, digits and blanks of any script count, so patterns name Unicode classes instead of
using \\w and \\s, which mean ASCII to the regex engine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions.dictionaries import (
    GENRE_WORDS, MOOD_WORDS, RECENCY_WORDS, STOPWORDS,
)

WORD = r"\p{L}\p{N}_"
BLANK = r"\t-\r\x1c- \x85\p{Z}"
# the same blanks one by one, for trimming without a pattern
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" \
    + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"

# fixed values: character sequences taken out of search text, in this order
UNSAFE = [";", "--", "/*", "*/", "xp_", "sp_"]
# fixed values: characters a file name cannot hold
SLUG_DROP = r'[\\/:*?"<>|]'
SLUG_LENGTH = 40
SLUG_DEFAULT = "report"
# fixed values: features named in an item's text document
DOCUMENT_FEATURES = ["danceability", "energy", "valence", "tempo", "instrumentalness"]


def strip(c: Column) -> Column:
    """Remove blanks of any kind at both ends; ``trim`` alone would take spaces only."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    # single spaces, most blanks by far, are not matched and so not replaced
    return strip(F.regexp_replace(c, f"[{BLANK}]{{2,}}|[{BLANK}&&[^ ]]", " "))


def words(c: Column) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(squeeze(c)), " "), lambda w: w != ""))


def clean_query(c: Column) -> Column:
    """Search text without the unsafe sequences and with single spaces; NULL gives ''."""
    out = strip(c)
    for token in UNSAFE:
        out = F.replace(out, F.lit(token), F.lit(""))
    return F.coalesce(squeeze(out), F.lit(""))


def normalise_title(c: Column) -> Column:
    """Title without bracketed parts and punctuation, lower case."""
    out = F.regexp_replace(c, r"\([^\n]*?\)|\[[^\n]*?\]", "")
    return strip(F.lower(F.regexp_replace(out, f"[^{WORD}{BLANK}]", "")))


def slug(c: Column, max_len: int = SLUG_LENGTH) -> Column:
    out = strip(F.regexp_replace(c, SLUG_DROP, ""))
    out = F.regexp_replace(F.regexp_replace(out, f"[{BLANK}]+", "-"), "-+", "-")
    out = F.regexp_replace(out, "^-+|-+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", SLUG_DEFAULT).otherwise(
        F.substring(out, 1, max_len))


def text_document(columns: list[str]) -> Column:
    """Name, artists, album, genres if the table has them, and the features present."""
    def shown(f: str) -> Column:
        return F.when(F.col(f).isNotNull(), F.format_string(f"{f}:%.2f", F.col(f).cast("double")))

    genres = [F.when(F.size("genres") > 0, F.array_join("genres", " "))] \
        if "genres" in columns else []
    return F.concat_ws(
        " ", F.col("name"), F.array_join("artists", " "), F.col("album"), *genres,
        *[shown(f) for f in DOCUMENT_FEATURES if f in columns])


def _lookup(words: dict[str, str | list[str]]) -> Column:
    pairs = []
    for word, value in words.items():
        lit = F.lit(value) if isinstance(value, str) else F.array(*[F.lit(v) for v in value])
        pairs += [F.lit(word), lit]
    return F.create_map(*pairs)


def _words(listed) -> Column:
    return F.array(*[F.lit(w) for w in listed])


def parse_request(
    df: DataFrame, text: str = "text", genre_words: dict = GENRE_WORDS,
    mood_words: dict = MOOD_WORDS, recency_words: list = RECENCY_WORDS,
    stopwords: list = STOPWORDS,
) -> DataFrame:
    """Adds ``parsed``: (keyword, genre_queries, mood_terms, prefer_recent) of free text.

    Tokens are made once per row and met with the dictionaries as sets; only the few words
    found are then looked up one by one.
    """
    plain = squeeze(F.regexp_replace(F.col(text), f"[^{WORD}{BLANK}가-힣]", " "))
    hangul = re.compile("[가-힣]")
    dropped = [w for w in dict.fromkeys([*stopwords, *genre_words, *mood_words, *recency_words])
               if hangul.search(w)]
    genres, moods = _lookup(genre_words), _lookup(mood_words)
    tokens = F.col("_tokens")
    # array_intersect keeps first appearances in order, and results are distinct anyway
    found = df.withColumn("_tokens", F.split(plain, " ")).withColumns({
        "_genres": F.array_intersect(tokens, _words(genre_words)),
        "_moods": F.array_intersect(tokens, _words(mood_words))})
    parsed = F.struct(
        # a long list of literals becomes one hash lookup per token
        F.array_join(F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(dropped)), " ")
        .alias("keyword"),
        F.array_distinct(F.flatten(F.transform("_genres", lambda t: genres[t])))
        .alias("genre_queries"),
        F.array_join(F.array_distinct(F.transform("_moods", lambda t: moods[t])), " ")
        .alias("mood_terms"),
        F.arrays_overlap(tokens, _words(recency_words)).alias("prefer_recent"))
    return found.withColumn("parsed", parsed).drop("_tokens", "_genres", "_moods")


def _query(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def seed_searches(parsed: str = "parsed") -> Column:
    """Searches to try for seeds, first choice first: keyword, genre, mood with genre, mood."""
    keyword, mood = F.col(f"{parsed}.keyword"), F.col(f"{parsed}.mood_terms")
    genre = F.get(F.col(f"{parsed}.genre_queries"), F.lit(0))
    return F.array_compact(F.array(
        F.when(keyword != "", _query("text", keyword)),
        F.when(genre.isNotNull(), _query("genre", genre)),
        F.when(genre.isNotNull() & (mood != ""), _query("text", F.concat_ws(" ", mood, genre))),
        F.when(genre.isNull() & (keyword == "") & (mood != ""), _query("text", mood))))


def candidate_searches(parsed: str = "parsed", seed_genres: str = "seed_genres") -> Column:
    """Searches that gather candidates, in order.

    Up to three named genres; mood with the first of them; then the seeds' other genres in
    alphabetical order until there are six searches; then the keyword, with the mood if any;
    the mood alone when nothing else was found.
    """
    keyword, mood = F.col(f"{parsed}.keyword"), F.col(f"{parsed}.mood_terms")
    named = F.col(f"{parsed}.genre_queries")
    seeds = F.array_sort(F.array_distinct(F.coalesce(
        F.col(seed_genres), F.array().cast("array<string>"))))
    explicit = F.concat(
        F.transform(F.slice(named, 1, 3), lambda g: _query("genre", g)),
        F.filter(F.array(F.when((mood != "") & (F.size(named) > 0), _query(
            "text", F.concat_ws(" ", mood, F.get(named, F.lit(0)))))), lambda x: x.isNotNull()))
    # the named part holds four searches at most, so there is always room for seed genres
    new = F.filter(seeds, lambda g: ~F.array_contains(named, g))
    listed = F.concat(explicit, F.transform(F.slice(new, F.lit(1), F.lit(6) - F.size(explicit)),
                                            lambda g: _query("genre", g)))
    fallback = F.filter(F.array(
        F.when(keyword != "", _query("text", F.concat_ws(
            " ", keyword, F.when(mood != "", mood)))),
        F.when((keyword == "") & (F.size(listed) == 0) & (mood != ""), _query("text", mood)),
    ), lambda x: x.isNotNull())
    return F.concat(listed, fallback)
