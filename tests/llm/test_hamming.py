import numpy as np

from tonearm.llm import hamming
from tonearm.llm.hamming import Index, differing, search

SCHEMA = "vec_id bigint, embedding array<float>"


def exact(rows, queries, k):
    out = {}
    for q in queries:
        own = next(v for i, v in rows if i == q)
        away = sorted((float(np.sqrt(((np.float64(np.float32(v)) - np.float64(np.float32(own))) ** 2).sum())), i)
                      for i, v in rows if i != q)
        out[q] = away[:k]
    return out


def test_index_finds_every_code_within_a_radius():
    rnd = np.random.default_rng(4)
    centre = rnd.integers(0, 256, (1, 16), dtype=np.uint8)
    flips = np.packbits(rnd.random((500, 128)) < rnd.random((500, 1)) * 0.5, axis=1)
    codes = centre ^ flips
    index = Index(codes)
    for radius in (0, 1, 5, 16, 17, 30, 47, 64, 127, 128, 140):
        want = np.flatnonzero(differing(codes, centre[0]) <= radius)
        assert index.within(centre[0], radius).tolist() == want.tolist()
    assert len(index.nearest(codes[0], 0, 37)) >= 37
    assert len(Index(codes[:3]).nearest(centre[0], 0, 50)) == 3


def test_unusable_vectors_ties_and_copies(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # a third are copies
    odd = [(200, None), (201, [0.0] * 8), (202, [None] + [1.0] * 7), (203, [float("nan")] * 8),
           (204, [float("inf")] * 8), (205, [1.0]), (None, rows[1][1]), (206, [])]
    docs = spark.createDataFrame([(*r, "x") for r in rows + odd], SCHEMA + ", RANK string").repartition(3)
    got = {}
    for r in search(docs, docs.where("vec_id in (0, 5, 100, 200, 201, 205)"), k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(rows, [0, 5, 100], 10)
    assert set(got) == {0, 5, 100}
    for q in (0, 100):
        assert [v for _, v, _ in sorted(got[q])] == [i for _, i in want[q]]
    for q, own in got.items():
        assert sorted(r for r, _, _ in own) == list(range(1, 11))
        vectors = dict(rows)
        for _, v, score in own:
            gap = np.float64(np.float32(vectors[v])) - np.float64(np.float32(vectors[q]))
            assert abs(score - np.sqrt((gap ** 2).sum())) < 1e-12


def test_fewer_candidates_than_k_and_none(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [5.0, 5.0])], SCHEMA)
    rows = search(docs, docs.where("vec_id = 1"), k=10).collect()
    assert [(r.rank, r.vec_id) for r in sorted(rows, key=lambda r: r.rank)] == [(1, 2), (2, 3)]
    assert search(docs.limit(0), docs.limit(0)).count() == 0
    assert search(docs.where("vec_id = 1"), docs.where("vec_id = 1")).count() == 0


def test_many_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hamming, "PART_ROWS", 50)
    monkeypatch.setattr(hamming, "QUERY_ROWS", 10)
    rnd = np.random.default_rng(8)
    rows = [(i, rnd.normal(size=16).tolist()) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = search(docs, docs.where("vec_id % 10 = 0"), k=5).collect()
    assert len(found) == 30 * 5
    want = exact(rows, range(0, 300, 10), 5)
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in found)
    assert hits >= 0.9 * len(found)


def test_query_recall(spark):
    from tonearm.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = QUERIES["op7_multi_index_hashing"](spark, sf).collect()
    queries = [i for i, _ in rows if i % 100 == 0]
    assert len(found) == 10 * len(queries)
    want = exact(rows, queries, 10)
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in found)
    assert hits >= 0.9 * len(found)


def test_query_row_repeated_often(spark):
    rnd = np.random.default_rng(9)
    far = [(100 + i, (10 + rnd.normal(size=16) / 100).tolist()) for i in range(40)]
    docs = spark.createDataFrame([(1, [-10.0] * 16)] * 30 + far, SCHEMA)
    found = search(docs, docs.where("vec_id = 1"), k=5).collect()
    assert sorted(r.rank for r in found) == [1, 2, 3, 4, 5]
    assert all(r.vec_id >= 100 for r in found)
