"""ANSI SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

from tonearm.functions.dictionaries import (
    DEFAULT_PROXY, GENRE_PROXY, GENRE_WORDS, MOOD_WORDS, RECENCY_WORDS, STOPWORDS,
)
from tonearm.functions.quality import FEATURE_DEFAULTS, RANGES
from tonearm.functions.scoring import (
    NO_REASON, REASON_ARTIST, REASON_LABELS, REASON_PREFIX,
)
from tonearm.functions.text import DOCUMENT_FEATURES
from tonearm.plans.given import GIVEN_CENTRES, GIVEN_RANKER, GIVEN_TOWERS, GIVEN_WORDS
from tonearm.schemas import FEATURES
from tonearm.sources.testbed import CUT

F8 = ", ".join(FEATURES)


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_text(w) for w in words) + "]"


RATINGS = """ratings AS (
SELECT user_id, track_id, rating FROM (
  SELECT o.o_custkey AS user_id, l.l_partkey AS track_id,
         CAST(1 + CAST(l.l_quantity AS BIGINT) % 5 AS DOUBLE) AS rating,
         row_number() OVER (PARTITION BY o.o_custkey, l.l_partkey
           ORDER BY l.l_shipdate DESC, l.l_orderkey DESC,
                    l.l_linenumber DESC, l.l_suppkey DESC) AS rn
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) x
WHERE rn = 1)"""

TRACKS = """tracks AS (
SELECT p_partkey AS id, p_name AS name,
       CASE WHEN p_partkey % 3 = 0 THEN [p_brand, 'Maker#' || CAST(p_partkey % 7 AS VARCHAR)]
            ELSE [p_brand] END AS artists,
       p_type AS album, CAST(2019 + p_partkey % 8 AS VARCHAR) || '-01-01' AS release_date,
       CAST(p_size * 2 AS BIGINT) AS popularity,
       CAST(120000 + (p_partkey * 7919) % 240000 AS BIGINT) AS duration_ms,
       p_partkey % 11 = 0 AS explicit,
       'https://tracks.example.org/' || CAST(p_partkey AS VARCHAR) AS external_urls,
       (p_partkey * 37 % 101) / CAST(100 AS DOUBLE) AS danceability,
       (p_partkey * 53 % 101) / CAST(100 AS DOUBLE) AS energy,
       (p_partkey * 71 % 101) / CAST(100 AS DOUBLE) AS valence,
       CAST(60 AS DOUBLE) + (p_partkey * 29 % 140) AS tempo,
       (p_partkey * 13 % 101) / CAST(100 AS DOUBLE) AS instrumentalness,
       CASE WHEN p_partkey % 17 = 0 THEN NULL
            ELSE (p_partkey * 19 % 101) / CAST(100 AS DOUBLE) END AS acousticness,
       (p_partkey * 23 % 101) / CAST(100 AS DOUBLE) AS liveness,
       (p_partkey * 41 % 101) / CAST(100 AS DOUBLE) AS speechiness,
       CASE WHEN p_partkey % 3 <> 2 THEN [lower(p_type), split_part(p_name, ' ', 2)]
            ELSE CAST([] AS VARCHAR[]) END AS genres
FROM part)"""

PROFILES = "profiles AS (SELECT user_id, " + ", ".join(
    f"sum({f} * rating) / sum(CASE WHEN {f} IS NOT NULL THEN rating END) AS {f}"
    for f in FEATURES) + """
FROM ratings r JOIN tracks t ON r.track_id = t.id GROUP BY user_id)"""


def _distance(a: str, b: str, features=FEATURES) -> str:
    return " + ".join(
        f"coalesce(({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f}), 0)" for f in features)


CONTENT = """content AS (
SELECT c.* FROM (
  SELECT user_id, id, name, artists, album, feature_score,
         row_number() OVER (PARTITION BY user_id ORDER BY feature_score, id) AS rank
  FROM (SELECT p.user_id, t.id, t.name, t.artists, t.album, """ + _distance("p", "t") + """
        AS feature_score FROM profiles p CROSS JOIN tracks t) d) c
WHERE rank <= {n} AND NOT EXISTS (
  SELECT 1 FROM ratings r WHERE r.user_id = c.user_id AND r.track_id = c.id))"""

NEIGHBOURS = """sizes AS (SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id),
shared AS (
  SELECT a.user_id AS u, b.user_id AS v, count(*) AS i
  FROM ratings a JOIN ratings b ON a.track_id = b.track_id AND a.user_id <> b.user_id
  GROUP BY a.user_id, b.user_id),
neighbours AS (
SELECT * FROM (
  SELECT u, v, sim, row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS rank
  FROM (SELECT u, v, CAST(i AS DOUBLE) / (x.n + y.n - i) AS sim
        FROM shared JOIN sizes x ON x.user_id = u JOIN sizes y ON y.user_id = v) s) k
WHERE rank <= 5)"""

COLLAB = """collab AS (
SELECT s.user_id, rank, t.id, t.name, t.artists, t.album, recommendation_score FROM (
  SELECT user_id, id, recommendation_score, row_number() OVER (
    PARTITION BY user_id ORDER BY round(recommendation_score, 9) DESC, id) AS rank
  FROM (SELECT n.u AS user_id, r.track_id AS id, sum(n.sim * r.rating) AS recommendation_score
        FROM neighbours n JOIN ratings r ON r.user_id = n.v
        WHERE NOT EXISTS (SELECT 1 FROM ratings m
                          WHERE m.user_id = n.u AND m.track_id = r.track_id)
        GROUP BY n.u, r.track_id) g) s
JOIN tracks t ON t.id = s.id WHERE rank <= {n})"""

HYBRID = """merged AS (
SELECT coalesce(c.user_id, o.user_id) AS user_id, coalesce(c.id, o.id) AS id,
       coalesce(c.name, o.name) AS name, coalesce(c.artists, o.artists) AS artists,
       coalesce(c.album, o.album) AS album,
       CASE WHEN c.id IS NULL THEN 1 ELSE 0 END AS src, coalesce(c.rank, o.rank) AS pos,
       CASE WHEN c.id IS NOT NULL AND o.id IS NOT NULL
              AND (c.feature_score + o.recommendation_score) / 2 <> 0
              THEN (c.feature_score + o.recommendation_score) / 2
            WHEN c.feature_score <> 0 THEN c.feature_score
            ELSE coalesce(o.recommendation_score, 0) END AS score
FROM content c FULL JOIN collab o ON c.user_id = o.user_id AND c.id = o.id),
hybrid AS (
SELECT * FROM (
  SELECT *, row_number() OVER (
    PARTITION BY user_id ORDER BY round(score, 9) DESC, src, pos) AS rank FROM merged) x
WHERE rank <= {n})"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _once(part: str) -> str:
    """A named part whose tables are each computed once."""
    return re.sub(r"^(\w+) AS \(", r"\1 AS MATERIALIZED (", part, flags=re.M)


ORACLE: dict[str, str] = {}

ORACLE["rating_upsert"] = _with(RATINGS) + "SELECT user_id, track_id, rating FROM ratings"

ORACLE["user_profile"] = _with(RATINGS, TRACKS, PROFILES) + "SELECT user_id, " + ", ".join(
    f"CAST(CAST({f} AS FLOAT) AS DOUBLE) AS {f}" for f in FEATURES) + " FROM profiles"

ORACLE["store_stats"] = """SELECT count(*) AS total_tracks, 'part' AS location, 'tracks' AS name
FROM part"""

ORACLE["audio_feature_search"] = _with(TRACKS, "targets AS (SELECT artists[1] AS target_id, "
    + ", ".join(f"avg({f}) AS {f}" for f in FEATURES) + " FROM tracks GROUP BY artists[1])") + """
SELECT target_id, CAST(rank AS INTEGER) AS rank, id, name, album,
       CAST(CAST(feature_score AS FLOAT) AS DOUBLE) AS feature_score FROM (
  SELECT target_id, id, name, album, feature_score,
         row_number() OVER (PARTITION BY target_id ORDER BY feature_score, id) AS rank
  FROM (SELECT g.target_id, t.id, t.name, t.album, """ + _distance("g", "t") + """
        AS feature_score FROM targets g CROSS JOIN tracks t) d) r
WHERE rank <= 20"""

ORACLE["audio_feature_search_pruned"] = ORACLE["audio_feature_search"]

ORACLE["content_based"] = _with(RATINGS, TRACKS, PROFILES, CONTENT.format(n=10)) + """
SELECT user_id, CAST(rank AS INTEGER) AS rank, id, name, artists[1] AS artist, album,
       CAST(CAST(feature_score AS FLOAT) AS DOUBLE) AS feature_score FROM content"""

ORACLE["top_neighbours"] = _with(RATINGS, NEIGHBOURS) + """
SELECT u AS user_id, v AS neighbour_id, CAST(CAST(sim AS FLOAT) AS DOUBLE) AS similarity,
       CAST(rank AS INTEGER) AS rank FROM neighbours"""

ORACLE["top_neighbours_hot"] = ORACLE["top_neighbours"]

ORACLE["collaborative"] = _with(RATINGS, TRACKS, NEIGHBOURS, COLLAB.format(n=10)) + """
SELECT user_id, CAST(rank AS INTEGER) AS rank, id, name, artists[1] AS artist, album,
       CAST(CAST(recommendation_score AS FLOAT) AS DOUBLE) AS recommendation_score FROM collab"""

_HYBRID_PARTS = (RATINGS, TRACKS, PROFILES, CONTENT.format(n=5), NEIGHBOURS, COLLAB.format(n=5),
                 HYBRID.format(n=10))
ORACLE["hybrid"] = _with(*_HYBRID_PARTS) + """
SELECT user_id, CAST(rank AS INTEGER) AS rank, id, name, artists[1] AS artist, album,
       CAST(CAST(score AS FLOAT) AS DOUBLE) AS score,
       CASE WHEN src = 0 THEN 'content_based' ELSE 'collaborative' END AS method FROM hybrid"""

_REASONS = ", ".join(
    f"CASE WHEN round(abs(p.{f} - t.{f}), 9) < 0.2 THEN {_text(label)} END"
    for f, label in REASON_LABELS.items())
ORACLE["pick_reasons"] = _with(*[
    # these are read more than once
    _once(part) for part in (RATINGS, TRACKS, PROFILES, NEIGHBOURS, COLLAB.format(n=10))], """
liked AS MATERIALIZED (SELECT DISTINCT user_id, unnest(artists) AS artist
          FROM ratings r JOIN tracks t ON t.id = r.track_id)""", """
asked AS MATERIALIZED (SELECT user_id, id FROM collab)""", """
same AS (SELECT DISTINCT a.user_id, a.id
         FROM (SELECT user_id, q.id, unnest(t.artists) AS artist
               FROM asked q JOIN tracks t ON t.id = q.id) a
         JOIN liked l ON l.user_id = a.user_id AND l.artist = a.artist)""") + f"""
SELECT user_id, id,
  CASE WHEN len(reasons) = 0 THEN {_text(NO_REASON)}
       ELSE {_text(REASON_PREFIX)} || array_to_string(reasons, ', ') END AS explanation
FROM (SELECT a.user_id, a.id, list_filter([{_REASONS},
        CASE WHEN s.id IS NOT NULL THEN {_text(REASON_ARTIST)} END],
        lambda x: x IS NOT NULL) AS reasons
      FROM asked a JOIN profiles p ON p.user_id = a.user_id JOIN tracks t ON t.id = a.id
      LEFT JOIN same s ON s.user_id = a.user_id AND s.id = a.id) z"""

# --- validation and sanitizing -----------------------------------------------------------------

_BLANK = r"\t-\r\x1c- \x{85}\p{Z}"
_WORD = r"\p{L}\p{N}_"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')"


def _squeeze(c: str) -> str:
    return _strip(f"regexp_replace({c}, '[{_BLANK}]+', ' ', 'g')")


RAW_TRACKS = """raw AS (
SELECT p_partkey AS part,
       CASE WHEN p_partkey % 23 = 0 THEN 'trk' || CAST(p_partkey AS VARCHAR)
            ELSE 'track_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') END AS id,
       CASE WHEN p_partkey % 19 = 0 THEN '' WHEN p_partkey % 29 = 0 THEN '   '
            ELSE '  ' || p_name || chr(9) END AS name,
       CASE WHEN p_partkey % 31 = 0 THEN CAST([] AS VARCHAR[])
            WHEN p_partkey % 5 = 0 THEN ['  ' || p_brand || chr(9), '']
            ELSE [p_brand] END AS artists,
       CASE WHEN p_partkey % 37 <> 0 THEN ' ' || p_type END AS album,
       CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size * 2 AS VARCHAR) || '.5'
            WHEN p_partkey % 4 = 1 THEN 'n/a' WHEN p_partkey % 4 = 2 THEN NULL
            ELSE CAST(p_size AS VARCHAR) || ['', 'd', 'f', 'F ', 'D'][p_partkey % 5 + 1]
            END AS popularity,
       CAST(p_partkey * 1000 AS VARCHAR) || '.0' AS duration_ms
FROM part)"""


def _share(factor: int, modulus: int = 101) -> str:
    v = f"(p_partkey * {factor} % {modulus})"
    return f"CAST({v} // 100 AS VARCHAR) || '.' || lpad(CAST({v} % 100 AS VARCHAR), 2, '0')"


RAW_FEATURES = f"""raw_features AS (
SELECT 'track_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id,
       CASE WHEN p_partkey % 11 = 0 THEN 'invalid' WHEN p_partkey % 11 = 1 THEN {_share(37)} || 'd'
            WHEN p_partkey % 11 = 2 THEN {_share(37)} || 'F' ELSE {_share(37)} END AS danceability,
       {_share(53, 104)} AS energy,
       CASE WHEN p_partkey % 13 <> 0 THEN {_share(71)} END AS valence,
       CASE WHEN p_partkey % 17 = 0 THEN 'fast'
            ELSE CAST(60 + p_partkey % 245 AS VARCHAR) END AS tempo,
       {_share(13)} AS instrumentalness, {_share(19)} AS acousticness, {_share(23)} AS liveness,
       {_share(41)} AS speechiness, CAST(p_partkey % 12 AS VARCHAR) AS key,
       CAST(p_partkey % 2 AS VARCHAR) AS mode,
       CASE WHEN p_partkey % 7 = 0 THEN '?'
            ELSE CAST(3 + p_partkey % 5 AS VARCHAR) END AS time_signature
FROM part)"""

CLEAN_FEATURES = "features AS (SELECT id, " + ", ".join(
    f"coalesce(try_cast({f} AS DOUBLE), {FEATURE_DEFAULTS.get(f, 0.0)}) AS {f}"
    for f in RANGES) + " FROM raw_features)"


def _errors(*rules: tuple[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {bad} THEN '{message}' END" for bad, message in rules)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), '; ') AS errors"


ORACLE["validate_tracks"] = _with(RAW_TRACKS) + "SELECT part, " + _errors(
    ("coalesce(id, '') = ''", "id missing"), ("coalesce(name, '') = ''", "name missing"),
    ("coalesce(len(artists), 0) = 0", "artists missing"),
    ("coalesce(album, '') = ''", "album missing"),
    ("coalesce(id, '') <> '' AND length(id) < 10", "id malformed")) + " FROM raw"

ORACLE["validate_features"] = _with(RAW_FEATURES, CLEAN_FEATURES) + "SELECT id, " + _errors(
    *[(f"NOT ({f} BETWEEN {lo} AND {hi})", f"{f} out of range")
      for f, (lo, hi) in RANGES.items()]) + " FROM features"

ORACLE["validate_ratings"] = "SELECT event_id, " + _errors(
    ("n IS NULL", "rating not a number"),
    ("n IS NOT NULL AND NOT n BETWEEN 1 AND 5", "rating out of range")) + """
FROM (SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value END AS n
      FROM events) e"""

ORACLE["validate_user_ids"] = "SELECT row, " + _errors(
    (f"coalesce({_strip('u')}, '') = ''", "user_id missing"),
    (f"{_strip('u')} <> '' AND length(u) NOT BETWEEN 3 AND 50", "user_id length")) + """
FROM (SELECT 'doc ' || CAST(doc_id AS VARCHAR) AS row, text AS u FROM documents
      UNION ALL SELECT 'event ' || CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR)
      FROM events) x"""

ORACLE["validate_queries"] = _with(RAW_TRACKS) + "SELECT row, " + _errors(
    (f"coalesce({_strip('q')}, '') = ''", "query missing"),
    (f"{_strip('q')} <> '' AND length(q) > 100", "query too long")) + """
FROM (SELECT 'doc ' || CAST(doc_id AS VARCHAR) AS row, text AS q FROM documents
      UNION ALL SELECT 'part ' || CAST(part AS VARCHAR), name FROM raw) x"""

ORACLE["validate_source_ids"] = "SELECT c_custkey, playlist_id, " + _errors(
    (r"NOT regexp_full_match(playlist_id, '[\p{L}\p{N}]{22}')", "playlist_id malformed")) + """
FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0
               THEN substr(d, 1, 2) || '_' || substr(d, 4, CAST(17 + c_custkey % 5 AS INT))
             WHEN c_custkey % 7 = 1 THEN substr(d, 1, 22) || chr(10)
             WHEN c_custkey % 7 = 2 THEN substr(d, 1, 22) || chr(13) || chr(10)
             ELSE substr(d, 1, CAST(20 + c_custkey % 5 AS INT)) END AS playlist_id
      FROM (SELECT c_custkey, md5(c_name) AS d FROM customer) c) x"""

ORACLE["sanitize_tracks"] = _with(RAW_TRACKS) + f"""
SELECT part, id, {_strip('name')} AS name,
       array_to_string(list_transform(list_filter(artists, lambda a: a <> ''),
                                      lambda a: {_strip('a')}), '|') AS artists,
       {_strip('album')} AS album,
       coalesce(CAST(trunc(try_cast(popularity AS DOUBLE)) AS BIGINT), 0) AS popularity,
       coalesce(CAST(trunc(try_cast(duration_ms AS DOUBLE)) AS BIGINT), 0) AS duration_ms
FROM raw"""

ORACLE["sanitize_features"] = _with(RAW_FEATURES, CLEAN_FEATURES) + "SELECT * FROM features"

_unsafe = _strip("text")
for _token in [";", "--", "/*", "*/", "xp_", "sp_"]:
    _unsafe = f"replace({_unsafe}, '{_token}', '')"
ORACLE["clean_query"] = f"SELECT doc_id, coalesce({_squeeze(_unsafe)}, '') AS query FROM documents"

# --- text --------------------------------------------------------------------------------------


def _title(c: str) -> str:
    out = rf"regexp_replace({c}, '\([^\n]*?\)|\[[^\n]*?\]', '', 'g')"
    return _strip(f"lower(regexp_replace({out}, '[^{_WORD}{_BLANK}]', '', 'g'))")


ORACLE["normalize_title"] = f"SELECT doc_id, {_title('text')} AS title FROM documents"

_slug = _strip(r"""regexp_replace(text, '[\\/:*?"<>|]', '', 'g')""")
_slug = f"regexp_replace(regexp_replace({_slug}, '[{_BLANK}]+', '-', 'g'), '-+', '-', 'g')"
_slug = f"regexp_replace({_slug}, '^-+|-+$', '', 'g')"
ORACLE["slug"] = f"""SELECT doc_id, CASE WHEN coalesce(s, '') = '' THEN 'report'
ELSE substr(s, 1, 40) END AS slug FROM (SELECT doc_id, {_slug} AS s FROM documents) x"""

_DOCUMENT = ("concat_ws(' ', name, array_to_string(artists, ' '), album, "
             "CASE WHEN len(genres) > 0 THEN array_to_string(genres, ' ') END, "
             + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN printf('{f}:%.2f', {f}) END"
                         for f in DOCUMENT_FEATURES) + ")")
ORACLE["text_document"] = _with(TRACKS) + f"SELECT id, {_DOCUMENT} AS document FROM tracks"

# --- collection, dedup, store ------------------------------------------------------------------

_FLAT = """SELECT 'track_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id, {name} AS name,
       p_brand AS artists, p_type AS album, '2023-01-01' AS release_date,
       CAST({popularity} AS BIGINT) AS popularity, p_partkey * 1000 AS duration_ms,
       'https://tracks.example.org/' || CAST(p_partkey AS VARCHAR) AS external_urls,
       NULL AS refused
FROM part UNION ALL {cut}"""


def _cut(feed: str, nulls: int, more: str = "") -> str:
    """The lines of a feed that were cut short, behind so many columns of nothing."""
    return f"""SELECT {'NULL, ' * nulls}{more}{_text(CUT[feed])} || CAST(page AS VARCHAR)
FROM (SELECT DISTINCT CAST(floor(p_partkey / 50) AS BIGINT) AS page FROM part) x WHERE page % 7 = 0"""


ORACLE["flatten_search"] = _FLAT.format(name="p_name", popularity="p_size", cut=_cut("search", 8))
ORACLE["flatten_playlist"] = _FLAT.format(
    name="p_name", popularity="p_size + 1", cut=_cut("playlist", 8))
ORACLE["flatten_artist_top"] = _FLAT.format(
    name="'Best of ' || p_name", popularity="p_size", cut=_cut("artist", 8))
ORACLE["normalise_raw"] = """
SELECT 'track_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id, 'Best of ' || p_name AS name,
       'id-' || p_brand AS artist_ids, p_type AS album, CAST(p_size AS BIGINT) AS popularity,
       p_partkey * 1000 AS duration_ms, false AS explicit,
       'https://tracks.example.org/' || CAST(p_partkey AS VARCHAR) AS external_urls,
       0 AS n_genres
FROM part"""
_OK = " AND ".join(f"{f} BETWEEN {lo} AND {hi}" for f, (lo, hi) in RANGES.items())
ORACLE["read_features"] = _with(RAW_FEATURES, CLEAN_FEATURES) + f"""
SELECT id, danceability, energy, valence, tempo, time_signature, {_OK} AS ok, NULL AS refused
FROM features UNION ALL {_cut("features", 6, "false, ")}"""
ORACLE["track_analysis"] = """
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type <> 'error'
       THEN CAST(json_extract(props, '$.k') AS INT) END AS k, NULL AS refused FROM events
UNION ALL SELECT NULL, NULL, """ + _text(CUT["analysis"]) + """ || CAST(event_id AS VARCHAR)
FROM events WHERE event_type = 'signup'"""
ORACLE["collect_tracks"] = _with(RAW_FEATURES, CLEAN_FEATURES) + f"""
SELECT p.id, p.name, p.popularity, 0 AS first_source, f.danceability, f.tempo
FROM (SELECT 'track_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id,
             'Best of ' || p_name AS name, CAST(p_size AS BIGINT) AS popularity
      FROM part) p LEFT JOIN (SELECT * FROM features WHERE {_OK}) f ON f.id = p.id"""
ORACLE["dedup_last"] = """
SELECT user_id, event_type, first AS seq, ts, value, props FROM (
  SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS first,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn
  FROM events) e WHERE rn = 1"""
ORACLE["dedup_first"] = """
SELECT user_id, event_type, event_id AS seq, ts, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn
  FROM events) e WHERE rn = 1"""
ORACLE["dedup_title"] = _with(TRACKS) + f"""
SELECT id, title, artist, popularity FROM (
  SELECT id, title, artist, popularity, row_number() OVER (
    PARTITION BY title, artist ORDER BY popularity DESC, id) AS rn
  FROM (SELECT id, {_title('name')} AS title, lower(artists[1]) AS artist, popularity
        FROM tracks) t) x
WHERE rn = 1"""
ORACLE["left_join_features"] = _with(RAW_TRACKS, RAW_FEATURES, CLEAN_FEATURES) + f"""
SELECT r.id, {_strip('r.name')} AS name,
       coalesce(CAST(trunc(try_cast(r.duration_ms AS DOUBLE)) AS BIGINT), 0) AS duration_ms,
       f.danceability, f.tempo, CASE WHEN f.id IS NOT NULL THEN 'audio_features' END AS type
FROM raw r LEFT JOIN features f ON f.id = r.id"""
ORACLE["artist_cap"] = _with(TRACKS) + """
SELECT id, album, artist, popularity FROM (
  SELECT id, album, artists[1] AS artist, popularity, row_number() OVER (
    PARTITION BY album, lower(artists[1]) ORDER BY popularity DESC, id) AS rn FROM tracks) t
WHERE rn <= 2"""
ORACLE["diverse_seeds"] = _with(TRACKS) + """
SELECT id, album, artist, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (
    PARTITION BY album ORDER BY CASE WHEN nth > 1 THEN 1 ELSE 0 END, popularity DESC, id) AS rank
  FROM (SELECT id, album, lower(artists[1]) AS artist, popularity, row_number() OVER (
          PARTITION BY album, lower(artists[1]) ORDER BY popularity DESC, id) AS nth
        FROM tracks) t) x
WHERE rank <= 3"""
ORACLE["ingest_new"] = _with(TRACKS) + """
SELECT id, name, popularity FROM tracks t
WHERE NOT EXISTS (SELECT 1 FROM tracks s WHERE s.id = t.id AND s.popularity <= 50)"""
ORACLE["add_items"] = _with(TRACKS) + f"""
SELECT CAST(id AS VARCHAR) AS id, {_DOCUMENT} AS document, 384 AS width, popularity, duration_ms,
       array_to_string(artists, '|') AS artists, acousticness, '' AS preview_url FROM tracks"""
ORACLE["point_lookup"] = _with(TRACKS) + """
SELECT id, name, album, popularity FROM tracks
WHERE id IN (SELECT o_custkey FROM orders)"""
ORACLE["preferences_roundtrip"] = _with(RATINGS) + """
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(track_id AS VARCHAR) AS track_id, rating
FROM ratings"""
ORACLE["csv_export"] = _with(TRACKS) + """
SELECT id, name, array_to_string(artists, '|') AS artists, popularity, tempo FROM tracks"""
ORACLE["metadata_filter"] = _with(TRACKS) + """
SELECT id, name, album, tempo FROM tracks
WHERE (tempo >= 100 AND tempo < 160 AND album IN ('PROMO', 'SMALL'))
   OR (acousticness > 0.9 AND NOT explicit) OR (name = 'red ring' AND album <> 'PROMO')"""

# --- requests: parsing, seeds, candidates, rankers, report -------------------------------------

_G = _list(GENRE_PROXY)
ARTISTS = f"""artists AS (
SELECT 'id-' || name AS artist_id, name,
       [{_G}[num % {len(GENRE_PROXY)} + 1],
        'korean ' || {_G}[(num * 3 + 1) % {len(GENRE_PROXY)} + 1]] AS genres
FROM (SELECT name, CAST(split_part(name, '#', 2) AS INT) AS num
      FROM (SELECT DISTINCT unnest(artists) AS name FROM tracks) d) n)"""


def _words(c: str) -> str:
    # order does not matter where this is used
    return f"list_distinct(list_filter(string_split(lower({_squeeze(c)}), ' '), lambda w: w <> ''))"


CATALOGUE = f"""catalogue AS (
SELECT t.* EXCLUDE (genres),
       CASE WHEN len(t.genres) > 0 THEN t.genres
            ELSE coalesce(a.genres, CAST([] AS VARCHAR[])) END AS genres,
       {_words("concat_ws(' ', t.name, array_to_string(t.artists, ' '), t.album)")} AS have
FROM tracks t LEFT JOIN artists a ON a.artist_id = 'id-' || t.artists[1])"""

REQUESTS = f"""requests AS (
SELECT request_id,
       CASE kind WHEN 0 THEN name || ' 같은 ' || genre || ' 추천'
                 WHEN 1 THEN '잔잔하고 감성적인 ' || genre || ' 추천해줘'
                 WHEN 2 THEN '이번 ' || name || ' 신곡 너무 좋더라!'
                 WHEN 3 THEN '신나는 ' || genre || ', ' || name
                 ELSE '슬픈 노래 없어?' END AS text
FROM (SELECT c_custkey AS request_id, c_custkey % 5 AS kind, coalesce(p_name, '') AS name,
             {_list(GENRE_WORDS)}[c_custkey % {len(GENRE_WORDS)} + 1] AS genre
      FROM customer LEFT JOIN part ON p_partkey = c_custkey) x)"""

_GENRE_MAP = "MAP {" + ", ".join(f"{_text(k)}: {_list(v)}" for k, v in GENRE_WORDS.items()) + "}"
_MOOD_MAP = "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in MOOD_WORDS.items()) + "}"
_DROPPED = _list(dict.fromkeys([*STOPWORDS, *GENRE_WORDS, *MOOD_WORDS, *RECENCY_WORDS]))
_PLAIN = _squeeze(f"regexp_replace(text, '[^{_WORD}{_BLANK}가-힣]', ' ', 'g')")


def _parsed(source: str, key: str) -> str:
    return f"""
SELECT {key}, text,
       array_to_string(list_filter(tokens, lambda t: length(t) >= 2
         AND NOT (regexp_matches(t, '[가-힣]') AND list_contains({_DROPPED}, t))), ' ') AS keyword,
       list_filter(gs, lambda x, i: list_position(gs, x) = i) AS genre_queries,
       array_to_string(list_filter(ms, lambda x, i: list_position(ms, x) = i), ' ') AS mood_terms,
       list_has_any(tokens, {_list(RECENCY_WORDS)}) AS prefer_recent
FROM (SELECT {key}, text, tokens,
        flatten(list_transform(list_filter(tokens, lambda t: {_GENRE_MAP}[t] IS NOT NULL),
                               lambda t: {_GENRE_MAP}[t])) AS gs,
        list_filter(list_transform(tokens, lambda t: {_MOOD_MAP}[t]),
                    lambda x: x IS NOT NULL) AS ms
      FROM (SELECT {key}, text,
              list_filter(string_split({_PLAIN}, ' '), lambda t: t <> '') AS tokens
            FROM {source}) a) b"""


PARSED = f"parsed AS ({_parsed('requests', 'request_id')})"
# requests that were understood alike are answered once here too, to keep the SQL quick
NEEDS = """needs AS (
SELECT min(request_id) AS need, keyword, genre_queries, mood_terms, prefer_recent
FROM parsed GROUP BY keyword, genre_queries, mood_terms, prefer_recent),
asks AS (
SELECT p.request_id, p.text, n.* FROM parsed p JOIN needs n
  ON n.keyword = p.keyword AND n.genre_queries = p.genre_queries
 AND n.mood_terms = p.mood_terms AND n.prefer_recent = p.prefer_recent)"""

SEED_SEARCHES = """seed_lists AS (
SELECT need, list_filter([
  CASE WHEN keyword <> '' THEN {'kind': 'text', 'text': keyword} END,
  CASE WHEN len(genre_queries) > 0 THEN {'kind': 'genre', 'text': genre_queries[1]} END,
  CASE WHEN len(genre_queries) > 0 AND mood_terms <> ''
       THEN {'kind': 'text', 'text': mood_terms || ' ' || genre_queries[1]} END,
  CASE WHEN len(genre_queries) = 0 AND keyword = '' AND mood_terms <> ''
       THEN {'kind': 'text', 'text': mood_terms} END], lambda x: x IS NOT NULL) AS searches
FROM needs),
seed_asked AS (
SELECT need, i - 1 AS priority, searches[i].kind AS kind, searches[i].text AS text
FROM (SELECT need, searches, unnest(range(1, len(searches) + 1)) AS i FROM seed_lists) x)"""


def _search(name: str, asked: str, limit: int) -> str:
    return f"""{name} AS (
SELECT kind, text, id, rank FROM (
  SELECT s.kind, s.text, c.id,
         row_number() OVER (PARTITION BY s.kind, s.text ORDER BY c.popularity DESC, c.id) AS rank
  FROM (SELECT kind, text, {_words('text')} AS need FROM (
          SELECT DISTINCT kind, text FROM {asked}) d) s
  JOIN catalogue c ON (s.kind = 'genre' AND list_contains(c.genres, s.text))
    OR (s.kind = 'text' AND len(s.need) > 0 AND list_has_all(c.have, s.need))) r
WHERE rank <= {limit})"""


SEEDS = _search("seed_found", "seed_asked", 20) + f""",
titled AS (
SELECT f.kind, f.text, f.rank AS place, c.id, {_title('c.name')} AS title,
       lower(c.artists[1]) AS artist
FROM seed_found f JOIN catalogue c ON c.id = f.id),
chosen AS (
SELECT kind, text, id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, text
    ORDER BY CASE WHEN nth > 1 THEN 1 ELSE 0 END, place) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY kind, text, artist ORDER BY place) AS nth
        FROM (SELECT *, row_number() OVER (PARTITION BY kind, text, title, artist
                                           ORDER BY place) AS copy FROM titled) u
        WHERE copy = 1) v) w
WHERE rank <= 3),
seeds AS (
SELECT need, rank, id FROM (
  SELECT a.need, c.rank, c.id, a.priority, min(a.priority) OVER (PARTITION BY a.need) AS best
  FROM seed_asked a JOIN chosen c ON c.kind = a.kind AND c.text = a.text) x
WHERE priority = best),
context AS (
SELECT n.*, s.seed_ids, s.seed_genres, s.seed_artists FROM needs n JOIN (
  SELECT s.need, list(s.id) AS seed_ids,
         list_sort(list_distinct(flatten(list(c.genres)))) AS seed_genres,
         list(lower(c.artists[1])) AS seed_artists
  FROM seeds s JOIN catalogue c ON c.id = s.id GROUP BY s.need) s ON s.need = n.need)"""

CANDIDATES = """named AS (
SELECT *, list_concat(
    list_transform(genre_queries[1:3], lambda g: {'kind': 'genre', 'text': g}),
    CASE WHEN mood_terms <> '' AND len(genre_queries) > 0
         THEN [{'kind': 'text', 'text': mood_terms || ' ' || genre_queries[1]}] ELSE [] END)
    AS explicit
FROM context),
listed AS (
SELECT *, list_concat(explicit, list_transform(
    list_filter(seed_genres, lambda g: NOT list_contains(genre_queries, g))[1:6 - len(explicit)],
    lambda g: {'kind': 'genre', 'text': g})) AS searches
FROM named),
all_lists AS (
SELECT need, list_concat(searches,
    CASE WHEN keyword <> '' THEN [{'kind': 'text', 'text':
           CASE WHEN mood_terms <> '' THEN keyword || ' ' || mood_terms ELSE keyword END}]
         WHEN len(searches) = 0 AND mood_terms <> ''
           THEN [{'kind': 'text', 'text': mood_terms}] ELSE [] END) AS searches
FROM listed),
asked AS (
SELECT need, i - 1 AS priority, searches[i].kind AS kind, searches[i].text AS text
FROM (SELECT need, searches, unnest(range(1, len(searches) + 1)) AS i FROM all_lists) x),
""" + _search("found", "asked", 30) + """,
candidates AS (
SELECT h.need, h.priority, h.rank AS place, c.*, x.seed_genres, x.seed_artists, x.prefer_recent
FROM (SELECT *, row_number() OVER (PARTITION BY need, id ORDER BY priority, rank) AS rn
      FROM (SELECT a.need, a.priority, f.rank, f.id FROM asked a
            JOIN found f ON f.kind = a.kind AND f.text = a.text) j) h
JOIN context x ON x.need = h.need JOIN catalogue c ON c.id = h.id
WHERE h.rn = 1 AND NOT list_contains(x.seed_ids, h.id))"""

_JACCARD = """CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0
  ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b})))
  END"""
_JG = _JACCARD.format(a="seed_genres", b="genres")

MULTI = f"""scored AS (
SELECT *, greatest(0.0, round(CAST(0.5 AS DOUBLE) * {_JG} + CAST(0.3 AS DOUBLE)
    * (popularity / CAST(100 AS DOUBLE))
    + CASE WHEN prefer_recent AND substr(release_date, 1, 4) >= '2024'
           THEN CAST(0.1 AS DOUBLE) ELSE 0 END
    - CASE WHEN list_has_any(list_transform(artists, lambda a: lower(a)), seed_artists)
           THEN CAST(0.4 AS DOUBLE) ELSE 0 END, 4)) AS similarity_score
FROM candidates),
picks AS (
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY need
            ORDER BY similarity_score DESC, priority, place) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY need, lower(artists[1])
                  ORDER BY similarity_score DESC, priority, place) AS nth FROM scored) s
  WHERE nth <= 2) r
WHERE rank <= 20)"""

LEGACY = f"""scored AS (
SELECT *, greatest(0.0, round(CAST(0.6 AS DOUBLE) * {_JG}
    + CAST(0.4 AS DOUBLE) * (popularity / CAST(100 AS DOUBLE)), 4)) AS similarity_score
FROM candidates),
picks AS (
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY need
            ORDER BY similarity_score DESC, priority, place) AS rank FROM scored) r
WHERE rank <= 20)"""

_TO_SEEDS = (TRACKS, ARTISTS, CATALOGUE, REQUESTS, PARSED, NEEDS, SEED_SEARCHES, SEEDS)
_TO_CANDIDATES = (*_TO_SEEDS, CANDIDATES)

ORACLE["parse_query"] = _with(REQUESTS, PARSED) + """
SELECT request_id, keyword, array_to_string(genre_queries, '|') AS genre_queries, mood_terms,
       prefer_recent FROM parsed"""
ORACLE["parse_documents"] = f"""
SELECT doc_id, keyword, array_to_string(genre_queries, '|') AS genre_queries, prefer_recent
FROM ({_parsed('documents', 'doc_id')}) p"""
ORACLE["enrich_genres"] = _with(TRACKS, ARTISTS, CATALOGUE) + """
SELECT id, array_to_string(genres, '|') AS genres FROM catalogue"""
ORACLE["catalogue_search"] = _with(TRACKS, ARTISTS, CATALOGUE, """asked AS (
SELECT 'text' AS kind, p_name AS text FROM part
UNION ALL SELECT 'genre', unnest(genres) FROM artists
UNION ALL SELECT 'text', name FROM artists)""", _search("found", "asked", 30)) + """
SELECT kind, text, CAST(rank AS INTEGER) AS rank, id FROM found"""
ORACLE["genre_jaccard"] = _with(TRACKS, ARTISTS, CATALOGUE, """seeds AS (
SELECT brand, list_distinct(flatten(list(genres))) AS seed_genres FROM (
  SELECT artists[1] AS brand, genres, row_number() OVER (
    PARTITION BY artists[1] ORDER BY popularity DESC, id) AS rn FROM catalogue) x
WHERE rn <= 3 GROUP BY brand)""") + f"""
SELECT id, brand, CAST(CAST({_JG} AS FLOAT) AS DOUBLE) AS jaccard
FROM catalogue JOIN seeds ON brand = artists[1]"""
ORACLE["seed_searches"] = _with(REQUESTS, PARSED, NEEDS, SEED_SEARCHES) + """
SELECT request_id, CAST(priority AS INTEGER) AS priority, kind, s.text
FROM asks a JOIN seed_asked s ON s.need = a.need"""
ORACLE["seed_tracks"] = _with(*_TO_SEEDS) + """
SELECT request_id, CAST(rank AS INTEGER) AS rank, c.id, c.name,
       array_to_string(c.genres, '|') AS genres
FROM asks a JOIN seeds s ON s.need = a.need JOIN catalogue c ON c.id = s.id"""
ORACLE["failed_requests"] = _with(*_TO_SEEDS) + """
SELECT request_id, CASE WHEN len(l.searches) = 0 THEN 'no search terms'
                        ELSE 'no search results' END AS error
FROM asks a JOIN seed_lists l ON l.need = a.need
WHERE a.need NOT IN (SELECT need FROM seeds)"""
ORACLE["candidate_queries"] = _with(*_TO_CANDIDATES) + """
SELECT request_id, CAST(priority AS INTEGER) AS priority, kind, s.text
FROM asks a JOIN asked s ON s.need = a.need"""
_PICKS = """
SELECT request_id, CAST(rank AS INTEGER) AS rank, id, name, similarity_score
FROM asks a JOIN picks p ON p.need = a.need"""
ORACLE["multi_signal"] = _with(*_TO_CANDIDATES, MULTI) + _PICKS
ORACLE["genre_jaccard_rank"] = _with(*_TO_CANDIDATES, LEGACY) + _PICKS
ORACLE["report_totals"] = _with(*_TO_CANDIDATES, MULTI) + """
SELECT request_id, CAST(len(x.seed_ids) AS INTEGER) AS n_seeds,
       CAST(len(x.seed_genres) AS INTEGER) AS n_genres,
       coalesce(g.n, 0) AS n_recommendations, coalesce(g.p, 0) AS mean_popularity
FROM asks a JOIN context x ON x.need = a.need LEFT JOIN (
  SELECT need, count(*) AS n, CAST(round_even(avg(popularity), 0) AS BIGINT) AS p
  FROM picks GROUP BY need) g ON g.need = a.need"""
_CARD = """c.id, c.name, array_to_string(c.artists, ', ') AS artists, c.album,
       CAST(c.duration_ms // 60000 AS VARCHAR) || ':'
         || lpad(CAST(c.duration_ms % 60000 // 1000 AS VARCHAR), 2, '0') AS duration,
       c.popularity, substr(c.release_date, 1, 4) >= '2024' AS is_new, c.explicit,
       c.external_urls, CAST(NULL AS VARCHAR) AS preview_url,
       CASE WHEN len(c.genres) > 0 THEN array_to_string(c.genres[1:5], ', ') ELSE '-' END
         AS genres"""
ORACLE["report_cards"] = _with(*_TO_CANDIDATES, MULTI) + f"""
SELECT request_id, CAST(rank AS INTEGER) AS rank, '#' || CAST(rank AS VARCHAR) AS label, {_CARD},
       CAST(round_even(round(similarity_score * 100, 1), 0) AS INTEGER) AS percent,
       CASE WHEN round(similarity_score * 100, 1) >= 50 THEN 'green'
            WHEN round(similarity_score * 100, 1) >= 30 THEN 'orange' ELSE 'muted' END AS colour
FROM asks a JOIN picks c ON c.need = a.need"""
ORACLE["report_seed_cards"] = _with(*_TO_SEEDS) + f"""
SELECT request_id, CAST(rank AS INTEGER) AS rank, 'SEED' AS label, {_CARD}
FROM asks a JOIN seeds s ON s.need = a.need JOIN catalogue c ON c.id = s.id"""
ORACLE["report_genres"] = _with(*_TO_CANDIDATES, MULTI) + """
SELECT request_id, CAST(place AS INTEGER) AS place, genre, n FROM asks a JOIN (
  SELECT need, genre, n, row_number() OVER (PARTITION BY need ORDER BY n DESC, first) AS place
  FROM (SELECT need, genre, count(*) AS n, min(rank * 10 + pos) AS first
        FROM (SELECT need, rank, genres[i] AS genre, i AS pos
              FROM (SELECT need, rank, genres, unnest(range(1, least(len(genres), 2) + 1)) AS i
                    FROM picks) u) v
        GROUP BY need, genre) w) x ON x.need = a.need
WHERE place <= 8"""
_name = "CASE WHEN a.keyword <> '' THEN a.keyword ELSE a.text END"
ORACLE["report_signals"] = _with(*_TO_SEEDS) + f"""
SELECT request_id, array_to_string(x.genre_queries[1:3], ' · ') AS genres, x.mood_terms AS mood,
       x.prefer_recent, x.keyword,
       CASE WHEN len(x.seed_genres) > 0 THEN array_to_string(x.seed_genres[1:5], ', ')
            ELSE '-' END AS seed_genres,
       'MultiSignal_' || substr({_slug.replace("text", _name, 1)}, 1, 40) AS report_name,
       y.ids AS seed_artist_ids
FROM asks a JOIN context x ON x.need = a.need JOIN (
  SELECT need, array_to_string(list(artist ORDER BY first), '|') AS ids FROM (
    SELECT s.need, 'id-' || c.artists[1] AS artist, min(s.rank) AS first
    FROM seeds s JOIN catalogue c ON c.id = s.id GROUP BY s.need, c.artists[1]) z
  GROUP BY need) y ON y.need = x.need"""

# --- vectors -----------------------------------------------------------------------------------

_TOPK = """
SELECT query_id, id, CAST(CAST(score AS FLOAT) AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT query_id, id, score, row_number() OVER (
    PARTITION BY query_id ORDER BY score {order}, id) AS rank
  FROM (SELECT q.vec_id AS query_id, x.vec_id AS id, {score} AS score
        FROM v q CROSS JOIN v x WHERE {where}) p) r
WHERE rank <= 10"""
_V = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
       sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda a: a * a))) + 1e-10 AS n
FROM embeddings)"""
_COSINE = _with(_V) + _TOPK.format(
    order="DESC", score="list_dot_product(q.e, x.e) / (q.n * x.n)", where="true")
ORACLE["vector_topk_cosine"] = _COSINE
ORACLE["index_search"] = _COSINE
ORACLE["vector_topk_blocks"] = _COSINE
ORACLE["vector_topk_cells"] = _with(_V) + _TOPK.format(
    order="", where="true",
    score="list_sum(list_transform(range(1, len(q.e) + 1), "
          "lambda i: (q.e[i] - x.e[i]) * (q.e[i] - x.e[i])))")
ORACLE["vector_topk_few_queries"] = _with(_V, """means AS (
SELECT label, list(x ORDER BY i) AS m FROM (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x
  FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) e
  GROUP BY label, i) z GROUP BY label)""") + """
SELECT query_id, id, CAST(CAST(score AS FLOAT) AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT q.label AS query_id, x.vec_id AS id, list_dot_product(q.m, x.e)
               / ((sqrt(list_sum(list_transform(q.m, lambda a: a * a))) + 1e-10) * x.n) AS score
        FROM means q CROSS JOIN v x) p) r
WHERE rank <= 10"""
ORACLE["ivf_search_all_cells"] = _COSINE
ORACLE["index_after_changes"] = _with(_V) + _TOPK.format(
    order="DESC", score="list_dot_product(q.e, x.e) / (q.n * x.n)",
    where="x.vec_id % 5 <> 0 OR x.vec_id % 10 = 0")
ORACLE["vector_topk_l2_filtered"] = _with(_V) + _TOPK.format(
    order="", where="x.label IN (1, 3, 5, 7)",
    score="list_sum(list_transform(range(1, len(q.e) + 1), "
          "lambda i: (q.e[i] - x.e[i]) * (q.e[i] - x.e[i])))")

_ENTRIES = "[" + ", ".join(
    f"{{'name': {_text(k)}, 'vec': [{', '.join(f'CAST({x} AS DOUBLE)' for x in v)}]}}"
    for k, v in GENRE_PROXY.items()) + "]"
_LIFT = "(0.85 + 0.30 * (c.popularity / CAST(100 AS DOUBLE)))"
_BASE = [f"coalesce(m.p{i}, {d})" for i, d in enumerate(DEFAULT_PROXY)]
_BASE[0] = f"least(1.0, {_BASE[0]} * {_LIFT})"
_BASE[1] = f"least(1.0, {_BASE[1]} * {_LIFT})"
_PROXY_PARTS = [f"""resolved AS (
SELECT g, coalesce(list_filter(entries, lambda e: e.name = g)[1],
                   list_filter(entries, lambda e: contains(g, e.name) OR contains(e.name, g))[1])
            .vec AS vec
FROM (SELECT DISTINCT lower(unnest(genres)) AS g, {_ENTRIES} AS entries FROM catalogue) d)""",
    "means AS (SELECT id, " + ", ".join(f"avg(vec[{i + 1}]) AS p{i}" for i in range(8)) + """
FROM (SELECT id, lower(unnest(genres)) AS g FROM catalogue) c JOIN resolved r ON r.g = c.g
WHERE vec IS NOT NULL GROUP BY id)"""]
_PROXIES = "SELECT c.id, " + ", ".join(f"{b} AS {f}" for b, f in zip(_BASE, FEATURES)) + """
FROM catalogue c LEFT JOIN means m ON m.id = c.id"""
ORACLE["proxy_features"] = _with(TRACKS, ARTISTS, CATALOGUE, *_PROXY_PARTS) + "SELECT id, " + ", ".join(
    f"CAST(CAST({f} AS FLOAT) AS DOUBLE) AS {f}" for f in FEATURES) + f" FROM ({_PROXIES}) p"
ORACLE["mean_vector"] = """
SELECT label, CAST(i - 1 AS INTEGER) AS at, CAST(CAST(avg(CAST(embedding[i] AS DOUBLE)) AS FLOAT) AS DOUBLE) AS x
FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) e
GROUP BY label, i"""

# --- trained rankers: the training table -------------------------------------------------------

ORACLE["training_pairs"] = _with(RATINGS, TRACKS, PROFILES) + f"""
SELECT r.user_id, r.track_id, CASE WHEN rating >= 3 THEN CAST(1 AS DOUBLE) ELSE 0 END AS label,
       least(rating / 5, CAST(1 AS DOUBLE)) AS target,
       {', '.join(f'CAST(CAST(coalesce(p.{f}, 0) AS FLOAT) AS DOUBLE) AS user_vec_{i}' for i, f in enumerate(FEATURES))},
       {', '.join(f'CAST(CAST(coalesce(t.{f}, 0) AS FLOAT) AS DOUBLE) AS item_vec_{i}' for i, f in enumerate(FEATURES))}
FROM ratings r JOIN tracks t ON t.id = r.track_id JOIN profiles p ON p.user_id = r.user_id"""

# --- rankers with given weights ----------------------------------------------------------------


def _double(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _network(name: str, source: str, keys: str, inputs: list[str], weights, net: str) -> list[str]:
    """Parts that run a stack of layers with ReLU between them; outputs are z0, z1, ..."""
    depth, parts = sum(k.startswith(f"{net}.w") for k in weights), []
    for i in range(depth):
        w, b = weights[f"{net}.w{i}"], weights[f"{net}.b{i}"]
        sums = [" + ".join([f"{x} * {_double(w[j, k])}" for j, x in enumerate(inputs)])
                + f" + {_double(b[k])}" for k in range(w.shape[1])]
        last = i == depth - 1
        parts.append(f"{name}{'' if last else i} AS (SELECT {keys}, " + ", ".join(
            f"{x if last else f'greatest({x}, 0)'} AS z{k}" for k, x in enumerate(sums))
            + f" FROM {source})")
        source, inputs = f"{name}{i}", [f"z{k}" for k in range(w.shape[1])]
    return parts


def _tower(name: str, source: str, keys: str, inputs: list[str], net: str) -> list[str]:
    """Parts that end in unit embeddings e0, e1, ..."""
    n = GIVEN_TOWERS[f"{net}.b2"].shape[0]
    norm = "greatest(sqrt(" + " + ".join(f"z{k} * z{k}" for k in range(n)) + "), 1e-12)"
    return [*_network(f"{name}_raw", source, keys, inputs, GIVEN_TOWERS, net),
            f"{name} AS (SELECT {keys}, " + ", ".join(
                f"z{k} / {norm} AS e{k}" for k in range(n)) + f" FROM {name}_raw)"]


_WIDTH = GIVEN_TOWERS["user.b2"].shape[0]
_PRESENT = [f"coalesce({f}, 0)" for f in FEATURES]
_ITEM_TOWER = _tower("item_towers", "tracks", "id", _PRESENT, "item")


def _scaled(side: str) -> str:
    return "(sqrt(" + " + ".join(f"{side}.e{k} * {side}.e{k}" for k in range(_WIDTH)) + ") + 1e-10)"


_NEAR_ITEMS = [*_tower("user_towers", "profiles", "user_id", _PRESENT, "user"), *_ITEM_TOWER,
               f"""near AS (
SELECT * FROM (
  SELECT user_id, id, similarity, row_number() OVER (
    PARTITION BY user_id ORDER BY similarity DESC, id) AS rank
  FROM (SELECT u.user_id, t.id, {' + '.join(
      f'(u.e{k} / {_scaled("u")}) * (t.e{k} / {_scaled("t")})' for k in range(_WIDTH))} AS similarity
        FROM user_towers u CROSS JOIN item_towers t) d) r
WHERE rank <= 100)"""]
ORACLE["two_tower_given"] = _with(RATINGS, TRACKS, PROFILES, *_NEAR_ITEMS) + """
SELECT user_id, id, CAST(CAST(similarity AS FLOAT) AS DOUBLE) AS similarity,
       CAST(rank AS INTEGER) AS rank FROM near"""


def _wide_deep(pairs: str) -> list[str]:
    """Parts that end in ``scored`` (user_id, id, place, score) for a table of pairs."""
    both = [f"coalesce(p.{f}, 0)" for f in FEATURES] + [f"coalesce(t.{f}, 0)" for f in FEATURES]
    names = [f"x{i}" for i in range(len(both))]
    return ["inputs AS (SELECT a.user_id, a.id, a.place, " + ", ".join(
                f"{x} AS {n}" for x, n in zip(both, names)) + f""" FROM {pairs} a
JOIN profiles p ON p.user_id = a.user_id JOIN tracks t ON t.id = a.id)""",
            *_network("wide", "inputs", "user_id, id, place", names, GIVEN_RANKER, "wide"),
            *_network("deep", "inputs", "user_id, id, place", names, GIVEN_RANKER, "deep"),
            """scored AS (
SELECT w.user_id, w.id, w.place, 1 / (1 + exp(-(w.z0 + 1 / (1 + exp(-d.z0))))) AS score
FROM wide w JOIN deep d ON d.user_id = w.user_id AND d.id = w.id)"""]


ORACLE["wide_deep_given"] = _with(
    RATINGS, TRACKS, PROFILES, "pairs AS (SELECT user_id, track_id AS id, 0 AS place FROM ratings)",
    *_wide_deep("pairs")) + """
SELECT user_id, id, CAST(CAST(score AS FLOAT) AS DOUBLE) AS score FROM scored"""
ORACLE["two_stage_given"] = _with(RATINGS, TRACKS, PROFILES, *_NEAR_ITEMS, """pairs AS (
SELECT user_id, id, rank AS place FROM near n WHERE NOT EXISTS (
  SELECT 1 FROM ratings r WHERE r.user_id = n.user_id AND r.track_id = n.id))""",
    *_wide_deep("pairs")) + """
SELECT s.user_id, CAST(rank AS INTEGER) AS rank, s.id, t.name, t.artists[1] AS artist, t.album,
       CAST(CAST(score AS FLOAT) AS DOUBLE) AS score, 'two_stage' AS method
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, place) AS rank
      FROM scored) s JOIN tracks t ON t.id = s.id
WHERE rank <= 10"""



def _wide_deep_steps(rate: float, steps: int) -> str:
    """Weights and losses after Adam steps over all rated pairs at once, from the given ranker."""
    flat = [(f"{n}[{i}]", x) for n in sorted(GIVEN_RANKER) for i, x in enumerate(GIVEN_RANKER[n].ravel())]
    at = {name: f"p{i}" for i, (name, _) in enumerate(flat)}
    width, middle, narrow = (GIVEN_RANKER[f"deep.w{i}"].shape[0] for i in range(3))

    def w(layer, row, column, columns):
        return at[f"{layer}[{row * columns + column}]"]

    xs = [f"x{i}" for i in range(width)]
    both = [f"coalesce({t}.{f}, 0)" for t in ("p", "t") for f in FEATURES]
    parts = ["inputs AS (SELECT CAST(CAST(least(rating / 5, 1) AS FLOAT) AS DOUBLE) AS y, " + ", ".join(
        f"CAST(CAST({b} AS FLOAT) AS DOUBLE) AS {x}" for b, x in zip(both, xs))
        + " FROM ratings r JOIN tracks t ON t.id = r.track_id JOIN profiles p ON p.user_id = r.user_id)",
        "net0 AS (SELECT " + ", ".join(f"{_double(x)} AS p{i}, CAST(0 AS DOUBLE) AS m{i}, "
                                       f"CAST(0 AS DOUBLE) AS s{i}" for i, (_, x) in enumerate(flat)) + ")"]
    for k in range(steps):
        first = [" + ".join(f"{x} * {w('deep.w0', j, i, middle)}" for j, x in enumerate(xs))
                 + f" + {at[f'deep.b0[{i}]']} AS a{i}" for i in range(middle)]
        second = [" + ".join(f"greatest(a{j}, 0) * {w('deep.w1', j, i, narrow)}" for j in range(middle))
                  + f" + {at[f'deep.b1[{i}]']} AS b{i}" for i in range(narrow)]
        deep = " + ".join(f"greatest(b{j}, 0) * {w('deep.w2', j, 0, 1)}" for j in range(narrow)) \
            + f" + {at['deep.b2[0]']}"
        wide = " + ".join(f"{x} * {w('wide.w0', j, 0, 1)}" for j, x in enumerate(xs)) + f" + {at['wide.b0[0]']}"
        grad = {"wide.b0[0]": "d", "deep.b2[0]": "e"}
        grad |= {f"wide.w0[{j}]": f"{x} * d" for j, x in enumerate(xs)}
        grad |= {f"deep.w2[{j}]": f"greatest(b{j}, 0) * e" for j in range(narrow)}
        grad |= {f"deep.b1[{i}]": f"f{i}" for i in range(narrow)}
        grad |= {f"deep.w1[{j * narrow + i}]": f"greatest(a{j}, 0) * f{i}"
                 for j in range(middle) for i in range(narrow)}
        grad |= {f"deep.b0[{i}]": f"g{i}" for i in range(middle)}
        grad |= {f"deep.w0[{j * middle + i}]": f"{x} * g{i}" for j, x in enumerate(xs) for i in range(middle)}
        t = k + 1
        parts += [
            f"one{k} AS (SELECT *, {', '.join(first)} FROM inputs CROSS JOIN net{k})",
            f"two{k} AS (SELECT *, {', '.join(second)} FROM one{k})",
            f"three{k} AS (SELECT *, 1 / (1 + exp(-({deep}))) AS h, {wide} AS o FROM two{k})",
            f"four{k} AS (SELECT *, 1 / (1 + exp(-(o + h))) AS q FROM three{k})",
            f"five{k} AS (SELECT *, q - y AS d, (q - y) * h * (1 - h) AS e FROM four{k})",
            f"six{k} AS (SELECT *, " + ", ".join(
                f"CASE WHEN b{i} > 0 THEN e * {w('deep.w2', i, 0, 1)} ELSE 0 END AS f{i}"
                for i in range(narrow)) + f" FROM five{k})",
            f"seven{k} AS (SELECT *, " + ", ".join(
                f"CASE WHEN a{j} > 0 THEN " + " + ".join(
                    f"f{i} * {w('deep.w1', j, i, narrow)}" for i in range(narrow))
                + f" ELSE 0 END AS g{j}" for j in range(middle)) + f" FROM six{k})",
            f"grad{k} AS MATERIALIZED (SELECT avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS loss, " + ", ".join(
                f"avg({grad[name]}) AS g{i}" for i, (name, _) in enumerate(flat)) + f" FROM seven{k})",
            f"moved{k} AS (SELECT " + ", ".join(
                f"p{i}, 0.9 * m{i} + 0.1 * g{i} AS m{i}, 0.999 * s{i} + 0.001 * g{i} * g{i} AS s{i}"
                for i in range(len(flat))) + f" FROM net{k} CROSS JOIN grad{k})",
            f"net{t} AS MATERIALIZED (SELECT " + ", ".join(
                f"p{i} - {rate} * (m{i} / {1 - 0.9**t!r}) / (sqrt(s{i} / {1 - 0.999**t!r}) + 1e-8) AS p{i}, "
                f"m{i}, s{i}" for i in range(len(flat))) + f" FROM moved{k})"]
    names = _list([name for name, _ in flat] + [f"loss {k}" for k in range(steps)])
    values = ", ".join([f"p{i}" for i in range(len(flat))] + [f"grad{k}.loss" for k in range(steps)])
    return _with(RATINGS, TRACKS, PROFILES, *parts) + f"""
SELECT weight, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM (
  SELECT unnest({names}) AS weight, unnest([{values}]) AS value
  FROM net{steps} CROSS JOIN {' CROSS JOIN '.join(f'grad{k}' for k in range(steps))}) x"""


ORACLE["wide_deep_steps_given"] = _wide_deep_steps(0.01, 2)

_SEED_TOWER = [
    f"proxies AS ({_PROXIES})",
    *_tower("proxy_towers", "proxies", "id", FEATURES, "item"),
    "seed_means AS (SELECT s.need, " + ", ".join(f"avg(e{k}) AS m{k}" for k in range(_WIDTH))
    + " FROM seeds s JOIN proxy_towers p ON p.id = s.id GROUP BY s.need)",
    f"""tower_near AS (
SELECT need, id, score, row_number() OVER (PARTITION BY need ORDER BY place) AS kept, place FROM (
  SELECT *, row_number() OVER (PARTITION BY need ORDER BY score DESC, id) AS place
  FROM (SELECT q.need, t.id, {' + '.join(f'q.m{k} * t.e{k}' for k in range(_WIDTH))} AS score
        FROM seed_means q CROSS JOIN item_towers t) d) r
WHERE place <= 100 AND NOT list_contains((SELECT seed_ids FROM context x WHERE x.need = r.need), id))""",
    """tower_scored AS (
SELECT n.need, n.id, n.place, c.artists, round(n.score, 4) AS plain,
       CASE WHEN list_has_any(list_transform(c.artists, lambda a: lower(a)), x.seed_artists)
            THEN greatest(0.0, round(n.score, 4) - 0.4) ELSE round(n.score, 4) END AS similarity_score
FROM tower_near n JOIN catalogue c ON c.id = n.id JOIN context x ON x.need = n.need
WHERE n.kept <= 60)""",
    """own AS (
SELECT need, id, similarity_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY need
            ORDER BY similarity_score DESC, plain DESC, place) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY need, lower(artists[1])
                  ORDER BY similarity_score DESC, plain DESC, place) AS nth FROM tower_scored) s
  WHERE nth <= 2) r
WHERE rank <= 20)""",
    """short AS (
SELECT x.need, coalesce(o.n, 0) AS have FROM context x
LEFT JOIN (SELECT need, count(*) AS n FROM own GROUP BY need) o ON o.need = x.need
WHERE coalesce(o.n, 0) < 10)"""]
# the default ranker over what is not listed yet, for needs left short
_FILL = MULTI.replace("FROM candidates)", """FROM candidates c WHERE need IN (SELECT need FROM short)
  AND NOT EXISTS (SELECT 1 FROM own o WHERE o.need = c.need AND o.id = c.id))""")
ORACLE["two_tower_rank_given"] = _with(*_TO_CANDIDATES, *_PROXY_PARTS, *_ITEM_TOWER, *_SEED_TOWER,
                                       _FILL, """answers AS (
SELECT need, rank, id, similarity_score FROM own
UNION ALL
SELECT p.need, p.rank + s.have, p.id, p.similarity_score FROM picks p JOIN short s ON s.need = p.need
WHERE p.rank <= 20 - s.have)""") + """
SELECT request_id, CAST(rank AS INTEGER) AS rank, c.id, c.name, similarity_score
FROM asks a JOIN answers p ON p.need = a.need JOIN catalogue c ON c.id = p.id"""

# --- given cells, counted words, stores and checks ---------------------------------------------

_CENTRES = "centres AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, [{', '.join(_double(x) for x in c)}])" for i, c in enumerate(GIVEN_CENTRES)) \
    + ") c(cell, centre))"
_UNIT = """unit AS (SELECT vec_id, CASE WHEN n > 0 THEN list_transform(e, lambda a: a / n) ELSE e END AS u, e, n
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
             sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda a: a * a))) AS n
      FROM embeddings) s)"""


def _away(v: str) -> str:
    return f"""list_sum(list_transform(range(1, 65), lambda i: ({v}[i] - centre[i]) * ({v}[i] - centre[i])))"""


ORACLE["ivf_search_given_cells"] = _with(_CENTRES, _UNIT, f"""cells AS (
SELECT vec_id, cell FROM (SELECT vec_id, cell, row_number() OVER (
  PARTITION BY vec_id ORDER BY {_away('u')}, cell) AS rn FROM unit CROSS JOIN centres) x
WHERE rn = 1)""", """sizes AS (
SELECT c.cell, c.centre, coalesce(n, 0) AS size FROM centres c
LEFT JOIN (SELECT cell, count(*) AS n FROM cells GROUP BY cell) s ON s.cell = c.cell)""", f"""visits AS (
SELECT vec_id, cell FROM (
  SELECT *, sum(size) OVER (PARTITION BY vec_id ORDER BY place) - size AS before FROM (
    SELECT vec_id, e, cell, size, row_number() OVER (
      PARTITION BY vec_id ORDER BY round({_away('e')}, 12), cell) AS place
    FROM unit CROSS JOIN sizes) x) y
WHERE place <= 2 OR before < 10)""") + """
SELECT query_id, id, CAST(CAST(score AS FLOAT) AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT v.vec_id AS query_id, c.vec_id AS id,
               list_dot_product(list_transform(q.e, lambda a: a / (q.n + 1e-10)),
                                list_transform(x.u, lambda a: a / (1 + 1e-10))) AS score
        FROM visits v JOIN cells c ON c.cell = v.cell JOIN unit q ON q.vec_id = v.vec_id
        JOIN unit x ON x.vec_id = c.vec_id) p) r
WHERE rank <= 10"""


def _counted(words: str) -> str:
    """Counts of the given words in a list of words, scaled to length 1, as floats."""
    counts = "[" + ", ".join(
        f"CAST(len(list_filter({words}, lambda x: x = {_text(w)})) AS DOUBLE)" for w in GIVEN_WORDS) + "]"
    return f"""(SELECT CAST(CASE WHEN n > 0 THEN list_transform(c, lambda a: a / n) ELSE c END AS FLOAT[])
FROM (SELECT c, sqrt(list_sum(list_transform(c, lambda a: a * a))) AS n FROM (SELECT {counts} AS c) z) y)"""


_DOCS = f"""docs AS (SELECT *, {_counted("string_split(lower(document), ' ')")} AS e
FROM (SELECT *, {_DOCUMENT} AS document FROM tracks) t)"""
ORACLE["add_items_counted"] = _with(TRACKS, _DOCS) + "SELECT CAST(id AS VARCHAR) AS id, " + ", ".join(
    f"CAST(e[{i + 1}] AS DOUBLE) AS e{i}" for i in range(len(GIVEN_WORDS))) + " FROM docs"
ORACLE["text_search_counted"] = _with(TRACKS, _DOCS, f"""asked AS (
SELECT p_name, CAST({_counted("string_split(lower(p_name), ' ')")} AS DOUBLE[]) AS q
FROM (SELECT DISTINCT p_name FROM part) p)""") + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, name,
       CAST(CAST(score AS FLOAT) AS DOUBLE) AS similarity_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank
  FROM (SELECT a.p_name AS query_id, d.id, d.name, list_sum(list_transform(range(1, len(q) + 1),
               lambda i: (q[i] - d.v[i]) * (q[i] - d.v[i]))) AS score
        FROM asked a CROSS JOIN (SELECT id, name, CAST(e AS DOUBLE[]) AS v FROM docs
                                 WHERE popularity >= 20) d) p) r
WHERE rank <= 10"""
ORACLE["clear_store"] = _with(TRACKS) + """
SELECT CAST(id AS VARCHAR) AS id, name FROM tracks WHERE popularity > 50"""
ORACLE["validate_table"] = _with(RATINGS, TRACKS) + """
SELECT 'tracks' AS name, CASE WHEN count(*) > count(DISTINCT id) THEN 'the table has repeated ids' END AS error
FROM tracks
UNION ALL SELECT 'rated', CASE WHEN count(*) > count(DISTINCT id) THEN 'the table has repeated ids' END
FROM tracks JOIN ratings ON track_id = id
UNION ALL SELECT 'nameless', 'missing columns: [''name'']'
UNION ALL SELECT 'none', CASE WHEN count(*) = 0 THEN 'the table is empty' END FROM tracks WHERE id < 0"""
ORACLE["validate_n_results"] = """
SELECT p_partkey, CAST(p_size * 40 - 40 AS BIGINT) AS n, p_size * 40 - 40 BETWEEN 1 AND 1000 AS accepted
FROM part"""

# --- metrics and streams -----------------------------------------------------------------------

ORACLE["usage_metrics"] = """
SELECT event_type, count(*) AS calls, CAST(CAST(avg(value) AS FLOAT) AS DOUBLE) AS mean_duration,
       CAST(CAST(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0 END) AS FLOAT) AS DOUBLE) AS success_rate,
       CAST(CAST(avg(CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 2 = 0 THEN 1.0 ELSE 0 END) AS FLOAT) AS DOUBLE)
         AS cache_hit_rate
FROM events GROUP BY event_type"""
ORACLE["click_through"] = """
SELECT user_id, views, clicks, CAST(CAST(CAST(clicks AS DOUBLE) / nullif(views, 0) AS FLOAT) AS DOUBLE) AS ctr
FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views,
             count(*) FILTER (WHERE event_type = 'click') AS clicks
      FROM events GROUP BY user_id) e"""
ORACLE["popular_searches"] = """
SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 10"""
ORACLE["rating_stream"] = ORACLE["rating_upsert"]
ORACLE["ingest_stream"] = _with(TRACKS) + """
SELECT CAST(id AS VARCHAR) AS id, name, popularity FROM tracks
WHERE id IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
ORACLE["usage_stream"] = """
SELECT window_start, event_type, count(*) AS calls, CAST(CAST(avg(value) AS FLOAT) AS DOUBLE) AS mean_value
FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, value FROM events) e
GROUP BY window_start, event_type"""
ORACLE["final_usage_stream"] = ORACLE["usage_stream"]
ORACLE["popular_searches_sketch"] = """
SELECT query, count(*) AS n, CAST(0 AS BIGINT) AS bound
FROM (SELECT event_type || ' ' || json_extract_string(props, '$.k') AS query FROM events WHERE ts IS NOT NULL) e
WHERE query IS NOT NULL GROUP BY query ORDER BY n DESC, query LIMIT 20"""
