import math
import random
from fractions import Fraction

import numpy as np

from tonearm.llm.codes import (
    Codebook, codebooks_digest, compress_vectors, decode, train_codebooks, whole_numbers,
    with_label_error,
)

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, entries=256, parts=4, rounds=4):
    kept = [(i, [math.floor(1024 * Fraction(x)) for x in v], lab) for i, v, lab in rows if usable(v)]
    width = len(kept[0][1])
    cut = [p * width // parts for p in range(parts + 1)]
    cuts = list(zip(cut, cut[1:]))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][a:b] for r in first] for a, b in cuts]

    def nearest(book, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(books[p], v[a:b])[1], []).append(v[a:b])
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, v, lab in kept:
        found = [nearest(book, v[a:b]) for book, (a, b) in zip(books, cuts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    return [(i, c, e, total[lab]) for i, c, e, lab in out], books


def vectors(n, width, seed=3):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss(0, 1) for _ in range(width)], rnd.choice([1, 2, 2, 2, None])) for i in range(n)]


def order(rows):
    return sorted(rows, key=repr)


def run(spark, rows, schema=SCHEMA, **how):
    table = spark.createDataFrame(rows, schema).repartition(3)
    books = train_codebooks(table, **how)
    found = with_label_error(compress_vectors(table, books))
    return [(r.vec_id, r.code, r.error, r.label_error) for r in found.collect()], books


def edge_vectors():
    rows = vectors(120, 8)
    same = rows[5][1]
    return rows + [
        (200, None, 1), (201, [], 1), (202, [0.0] * 7 + [None], 1), (203, [0.0] * 7 + [float("nan")], 1),
        (204, [0.0] * 7 + [float("inf")], 1), (205, [0.0] * 8, None), (206, [-0.0] * 8, 2),
        (5, same, 1), (5, same, 1), (5, rows[6][1], None), (None, same, 2), (None, rows[7][1], 2),
        (-3, [x * 100 for x in same], 2), (207, [2.0**-1074] * 4 + [-(2.0**-1074)] * 4, 1)]


def test_equals_brute_force_on_edge_cases(spark):
    got, books = run(spark, edge_vectors(), entries=16)
    want, want_books = brute(edge_vectors(), 16)
    assert [b.tolist() for b in books] == want_books
    assert order(got) == order(want)


def test_fewer_vectors_than_entries_and_uneven_parts(spark):
    rows = vectors(20, 10)
    got, books = run(spark, rows)
    assert order(got) == order(brute(rows)[0])
    assert [b.shape for b in books] == [(20, 2), (20, 3), (20, 2), (20, 3)]


def test_numbers_of_any_size_are_exact(spark):
    rows = vectors(30, 4) + [(100, [1e30, -1e30, 3.4e38, 0.1], 1), (101, [1e30, -1e30, 3.4e38, 0.2], 1),
                             (102, [5e4, 1.0, 2.0, 3.0], 1)]
    got, books = run(spark, rows, entries=8)
    want, want_books = brute(rows, 8)
    assert [b.tolist() for b in books] == want_books
    def long(x):
        return x if x < 2**63 else None
    sums = {}
    for i, c, e, _ in want:
        lab = dict((r[0], r[2]) for r in rows)[i]
        if long(e) is not None:
            sums[lab] = sums.get(lab, 0) + e
    assert order((i, c, e) for i, c, e, _ in got) == order((i, c, long(e)) for i, c, e, _ in want)


def test_orchard_search_is_exact_and_skips(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-4000, 4000, (256, 6))
    points = centres[rnd.integers(0, 256, 3000)] + rnd.integers(-60, 60, (3000, 6))
    now, least, made = Codebook(centres).nearest(points)
    apart = ((points[:, None, :] - centres) ** 2).sum(axis=2)
    assert (now == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()
    assert made < 3000 * 256 / 4
    # equal entries and equally far ones: the lower index
    entries = np.array([[4, 0], [0, 0], [4, 0], [2, 2], [0, 0], [-4, 0]])
    now, least, _ = Codebook(entries).nearest(np.array([[2, 0], [0, 0], [4, 0], [-2, 0]]))
    assert now.tolist() == [0, 1, 0, 1] and least.tolist() == [4, 0, 0, 4]


def test_whole_numbers_are_floors():
    got = whole_numbers(np.array([[0.9999, -0.0001, -1.0, 1e-320, -1e-320]]))
    assert got.tolist() == [[1023, -1, -1024, 0, -1]]
    assert whole_numbers(np.array([[1e300]]))[0, 0] == int(1e300) * 1024


def test_empty_table_decoding_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert run(spark, [], SCHEMA) == ([], [])
    assert compress_vectors(empty, []).columns == ["vec_id", "label", "code", "error"]
    rows = vectors(40, 8)
    table = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "vec_id", "embedding", "label", "1 AS x", "2 AS code", "3 AS ERROR")
    books = train_codebooks(table, entries=40, rounds=0)
    found = compress_vectors(table, books, label=None)
    assert found.columns == ["vec_id", "code", "error"]
    for r in found.collect():
        assert r.error == 0
        assert decode(r.code, books) == [math.floor(1024 * x) / 1024 for x in rows[r.vec_id][1]]
    assert len(codebooks_digest(books)) == 64


def test_query_equals_its_sql(spark, sf):
    import duckdb
    from tonearm.llm.oracle import ORACLE
    from tonearm.llm.queries import QUERIES
    found = QUERIES["op13_vector_codes"](spark, sf).toPandas()
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = connection.sql(ORACLE["op13_vector_codes"]).df()
    assert sorted(found.columns) == sorted(want.columns)
    got = found[sorted(found.columns)].sort_values("vec_id").values.tolist()
    assert got == want[sorted(want.columns)].sort_values("vec_id").values.tolist()
