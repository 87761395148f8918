"""SQL for DuckDB that gives the rows of the registered corpus queries, where SQL can."""

from __future__ import annotations

from tonearm.llm import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP4 = """
WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
least AS (SELECT payload_digest, min(page_id) AS first FROM payloads
    WHERE payload_bytes >= 100 GROUP BY payload_digest),
found AS (SELECT p.*, CASE WHEN p.page_id <> l.first THEN l.first END AS refers_to
    FROM payloads p LEFT JOIN least l
    ON l.payload_digest = p.payload_digest AND p.payload_bytes >= 100)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
    true AS verified FROM found"""

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
OP5 = rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    role AS role0, text AS text0 FROM (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok') c),
whole AS (SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), ''
        ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
        ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST), '') AS loss,
    CAST(sum(17 + length(replace({_ESCAPED.format('role')}, chr(10), '\n'))
        + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    formatted_chars FROM whole"""

OP9 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4
    THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS own FROM words),
having_it AS MATERIALIZED (SELECT doc_id, len(own) AS n, unnest(own) AS shingle FROM sets),
paired AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n_a, b.n AS n_b, count(*) AS shared
    FROM having_it a JOIN having_it b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n),
links AS MATERIALIZED (SELECT a, b FROM paired WHERE 100 * shared >= 80 * (n_a + n_b - shared)
    UNION ALL SELECT b, a FROM paired WHERE 100 * shared >= 80 * (n_a + n_b - shared)),
reach AS (SELECT a AS doc_id, b AS other FROM links
    UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
lowest AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(own) AS n_shingles, least(s.doc_id, coalesce(l.other, s.doc_id)) AS component_id,
    s.doc_id = least(s.doc_id, coalesce(l.other, s.doc_id)) AS kept
FROM sets s LEFT JOIN lowest l ON l.doc_id = s.doc_id"""

OP10 = rf"""
WITH words AS (SELECT row_number() OVER () AS rid, doc_id,
    {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS MATERIALIZED (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS own
    FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words) x),
least AS (SELECT own, min(doc_id) AS first FROM windows GROUP BY own),
again AS (SELECT rid, i FROM windows x JOIN least l ON l.own = x.own WHERE l.first < x.doc_id),
placed AS (SELECT rid, w[j] AS word, j FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS j FROM words) x),
marked AS (SELECT p.rid, word, j, count(a.i) OVER (PARTITION BY p.rid ORDER BY j
    ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) > 0 AS gone
    FROM placed p LEFT JOIN again a ON a.rid = p.rid AND a.i = p.j),
kept AS (SELECT rid, count(*) FILTER (gone) AS n_removed,
    string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY j) AS text FROM marked GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(text, '')) AS kept_sha256
FROM words x LEFT JOIN kept k ON k.rid = x.rid"""

OP11 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
    string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS MATERIALIZED (SELECT rid, doc_id, l[j] AS line, j, translate(trim(l[j],
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS own
    FROM (SELECT rid, doc_id, l, unnest(range(1, len(l) + 1)) AS j FROM docs) x),
shared AS (SELECT own, max(doc_id) AS stays FROM lines WHERE length(own) >= 20
    GROUP BY own HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT rid, line, j, coalesce(doc_id < stays, false) AS gone
    FROM lines x LEFT JOIN shared s ON s.own = x.own),
kept AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY j) AS text FROM marked GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(text, '')) AS kept_sha256
FROM docs d JOIN kept k ON k.rid = d.rid"""


def vector_codes_sql(rounds: int = 4) -> str:
    """Codebooks refined in ``rounds``, by comparing every part with every entry."""
    near = """near{k} AS MATERIALIZED (SELECT rid, p, min({{'d': d, 'e': e}}) AS m FROM (
    SELECT t.rid, t.p, b.e, list_sum(list_transform(list_zip(t.v, b.v),
        lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts t JOIN book{k} b ON b.p = t.p) x GROUP BY rid, p)"""
    book = """book{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT p, e, list(mean ORDER BY i) AS v FROM (
        SELECT t.p, n.m.e AS e, i, floor(sum(t.v[i]) / count(*))::BIGINT AS mean
        FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM parts) t
        JOIN near{k} n ON n.rid = t.rid AND n.p = t.p GROUP BY t.p, n.m.e, i) y GROUP BY p, e) m
    ON m.p = b.p AND m.e = b.e)"""
    steps = [near.format(k=0)]
    for k in range(rounds):
        steps += [book.format(n=k + 1, k=k), near.format(k=k + 1)]
    return f"""
WITH ints AS (SELECT row_number() OVER () AS rid, vec_id, label,
    list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (SELECT rid, vec_id, label, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] AS v
    FROM (SELECT *, unnest(range(0, 4)) AS p FROM ints) y),
book0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, v,
    row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) y WHERE e < 256),
{", ".join(steps)},
codes AS (SELECT rid, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code,
    sum(m.d)::BIGINT AS error FROM near{rounds} GROUP BY rid),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS own FROM book{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
    own AS codebooks_sha256 FROM ints JOIN codes USING (rid), digest"""


ORACLE: dict[str, str] = {
    "op1_license_scan": licenses.oracle_sql(),
    "op4_warc": OP4,
    "op5_chat_formatting": OP5,
    "op9_minhash_near_dedup": OP9,
    "op10_substring_dedup": OP10,
    "op11_line_dedup": OP11,
    "op13_vector_codes": vector_codes_sql(),
}
