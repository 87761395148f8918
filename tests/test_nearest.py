"""Every plan of the nearest-item search against brute force."""

import math
import random

import pytest

from pyspark.sql import functions as F

from tonearm.operators import index as IX
from tonearm.operators import nearest as NN
from tonearm.operators.index import build_index, open_index, search_index
from tonearm.operators.nearest import nearest


def vectors(n, width, seed, gaps=0.0, same=0):
    rng = random.Random(seed)
    rows = [[rng.random() if rng.random() >= gaps else float("nan") for _ in range(width)]
            for _ in range(n)]
    for i in range(same):
        rows[i] = list(rows[0])
    return rows


def cost(q, x, metric):
    if metric in ("feature", "l2"):
        return sum((a - b) ** 2 for a, b in zip(q, x) if not (math.isnan(a) or math.isnan(b)))
    dot = sum(a * b for a, b in zip(q, x))
    if metric == "ip":
        return -dot
    return -dot / math.sqrt(sum(a * a for a in q)) / math.sqrt(sum(b * b for b in x))


def brute(qs, xs, k, metric):
    return {i: [j for _, j in sorted((round(cost(q, x, metric), 9), j)
                                     for j, x in enumerate(xs))[:k]] for i, q in enumerate(qs)}


def run(spark, qs, xs, k, metric, **options):
    q = spark.createDataFrame(list(enumerate(qs)), "query_id bigint, vec array<double>")
    x = spark.createDataFrame(list(enumerate(xs)), "id bigint, vec array<double>")
    out = {}
    for r in nearest(q, x, k, metric, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("metric", ["feature", "l2", "cosine", "ip"])
@pytest.mark.parametrize("plan", [
    {"broadcast_cells": 10_000},                      # few items
    {"broadcast_cells": 8 * 30},                      # few queries
    {"broadcast_cells": 8, "block_rows": 7},          # blocks
    {"broadcast_cells": 8, "block_rows": 7, "prune_on": 3},
])
def test_plans_agree_with_brute_force(spark, metric, plan):
    gaps = 0.15 if metric == "feature" else 0.0
    qs, xs = vectors(20, 8, 1, gaps), vectors(60, 8, 2, gaps, same=9)
    assert run(spark, qs, xs, 5, metric, **plan) == brute(qs, xs, 5, metric)


def test_one_value_shared_by_most_items(spark):
    """Pruning with a crowded range and an items side smaller than k in places."""
    qs, xs = vectors(25, 3, 5), vectors(80, 3, 6)
    for x in xs[:50]:
        x[0] = 0.5
    for q in qs[:15]:
        q[0] = 0.5
    got = run(spark, qs, xs, 12, "feature", broadcast_cells=3, block_rows=6, prune_on=0)
    assert got == brute(qs, xs, 12, "feature")


def test_cells(spark, tmp_path):
    xs = vectors(120, 6, 7)
    x = spark.createDataFrame(list(enumerate(xs)), "id bigint, embedding array<double>")
    q = x.selectExpr("id AS query_id", "embedding AS vec")
    path = str(tmp_path / "index")
    assert open_index(spark, path) is None
    build_index(x, path, ivf=True, cells=8)

    def found(nprobe):
        out = {}
        for r in search_index(q, spark, path, 10, nprobe=nprobe, block_rows=9).collect():
            out.setdefault(r.query_id, set()).add(r.id)
        return out

    exact = {i: set(js) for i, js in brute(xs, xs, 10, "cosine").items()}
    assert found(8) == exact
    some = found(3)
    assert sum(len(some[i] & exact[i]) for i in exact) / 1200 > 0.6
    # one cell rarely holds ten vectors: more are probed until ten are found
    assert {len(v) for v in found(1).values()} == {10}


def test_given_cells(spark, tmp_path):
    xs = vectors(50, 3, 9)
    x = spark.createDataFrame(list(enumerate(xs)), "id bigint, embedding array<double>")
    path = str(tmp_path / "index")
    build_index(x, path, ivf=True, centres=[[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])
    cells = {r.item_id: r.cell for r in open_index(spark, path).collect()}
    assert all(cells[i] == max(range(3), key=lambda k: v[k]) for i, v in enumerate(xs))


def clusters(n, groups, width, seed, spread=0.01):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(groups)]
    return [[x + rng.gauss(0, spread) for x in centres[i % groups]] for i in range(n)]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_cells_are_skipped(spark, metric, monkeypatch):
    """On clustered vectors most pairs of a query and a cell are never visited."""
    qs, xs = clusters(60, 12, 6, 3), clusters(600, 12, 6, 3)
    made = []
    visits = NN.visits

    def counted(q, cells, odd, k, width, first=None):
        out = visits(q, cells, odd, k, width, first).persist()
        made.append((out.count(), len(cells.pivots)))
        return out

    monkeypatch.setattr(NN, "visits", counted)
    got = run(spark, qs, xs, 5, metric, broadcast_cells=8, block_rows=60)
    assert got == brute(qs, xs, 5, metric)
    assert len(made) == 2 and made[0][1] >= 30
    assert sum(n for n, _ in made) <= 60 * made[0][1] / 4


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("seed", range(2))
def test_cells_on_odd_vectors(spark, metric, seed):
    """Repeated, zero and tiny vectors, fewer items than k in most cells, random directions."""
    qs, xs = vectors(15, 5, seed), vectors(90, 5, seed + 50, same=30)
    xs = [[x - 0.5 for x in v] for v in xs]
    if metric == "l2":
        xs[40], xs[41], qs[3] = [0.0] * 5, [0.0] * 5, [0.0] * 5
    else:
        xs[40], xs[41] = [1e-7 * x for x in xs[50]], [1e3 * x for x in xs[51]]
    got = run(spark, qs, xs, 7, metric, broadcast_cells=8, block_rows=10)
    want = brute(qs, xs, 7, metric)
    if metric == "cosine":  # a tiny vector's length is not quite divided out: compare the others
        got, want = ({i: [j for j in v if j != 40][:6] for i, v in d.items()} for d in (got, want))
    assert got == want


def test_index_takes_additions_and_removals(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = dict(enumerate(clusters(200, 5, 4, 9, 0.2)))

    def table(some):
        return spark.createDataFrame([(i, v) for i, v in some.items()], "id bigint, vec array<double>")

    def check(cells=None):
        qs = clusters(12, 5, 4, 10, 0.3)
        q = spark.createDataFrame(list(enumerate(qs)), "query_id bigint, vec array<double>")
        out = {}
        for r in search_index(q, spark, path, 6, nprobe=1000).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.id)
        ids = sorted(rows)
        want = brute(qs, [rows[i] for i in ids], 6, "cosine")
        assert out == {k: [ids[j] for j in v] for k, v in want.items()}
        live = open_index(spark, path)
        assert sorted(r.item_id for r in live.select("item_id").collect()) == ids
        sizes = {r.cell: r.size for r in IX._sizes(spark, path, IX.index_version(spark, path)).collect()}
        assert {r.cell: r["count"] for r in live.groupBy("cell").count().collect()} == {
            c: n for c, n in sizes.items() if n}
        return sizes

    build_index(table(rows), path, ivf=True, cells=5, vec="vec")
    check()
    gone = {i: rows.pop(i) for i in range(0, 200, 7)}
    assert IX.remove_from_index(table({**gone, 999: [0.0] * 4}), path) == 1
    check()
    new = {i: v for i, v in enumerate(clusters(80, 5, 4, 11, 0.2), 1000)}
    changed = {i: [x + 0.1 for x in rows[i]] for i in (1, 2, 3)}
    back = {7: gone[7]}
    rows |= new | changed | back
    assert IX.add_to_index(table(new | changed | back), path, vec="vec") == 2
    before = check()
    files = {r.f for r in spark.read.parquet(f"{path}/vectors").select(F.input_file_name().alias("f")).collect()}
    assert IX.split_cells(spark, path, 60) == 3
    after = check()
    full = {c for c, n in before.items() if n > 60}
    assert full and not full & set(after) and max(after.values()) <= 60
    assert {c: n for c, n in after.items() if c in before} == {c: n for c, n in before.items() if c not in full}
    # nothing that was stored has been written again
    now = {r.f for r in spark.read.parquet(f"{path}/vectors").select(F.input_file_name().alias("f")).collect()}
    assert files <= now and IX.split_cells(spark, path, 60) is None
    gone = [i for i in rows if i % 3 == 0]
    for i in gone:
        del rows[i]
    IX.remove_from_index(spark.createDataFrame([(i,) for i in gone], "id bigint"), path)
    check()
    # a version that was not written to its end does not count
    open_index(spark, path).limit(3).write.partitionBy("cell").parquet(f"{path}/vectors/version=5")
    check()


def test_flat_index_takes_changes(spark, tmp_path):
    path = str(tmp_path / "flat")
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id bigint, embedding array<double>")
    with pytest.raises(ValueError):
        IX.add_to_index(v, path)
    build_index(v.where("id < 4"), path)
    IX.add_to_index(v.where("id >= 3"), path)
    IX.remove_from_index(v.where("id = 0"), path)
    assert sorted(r.item_id for r in open_index(spark, path).collect()) == [1, 2, 3, 4, 5]
    assert IX.split_cells(spark, path, 2) is None
    build_index(v.where("id = 2"), path)
    assert [r.item_id for r in open_index(spark, path).collect()] == [2]


@pytest.mark.parametrize("metric", ["feature", "l2", "cosine", "ip"])
def test_many_groups_and_chunks(spark, metric, monkeypatch):
    """Groups of a few cells, cells larger than a group, several chunks of queries; equal vectors."""
    monkeypatch.setattr(NN, "GROUP_CELLS", 4 * 15)
    monkeypatch.setattr(NN, "_LEAST_QUERIES", 4)
    qs, xs = vectors(40, 4, 21), vectors(160, 4, 22, same=40)
    got = run(spark, qs, xs, 6, metric, broadcast_cells=4, block_rows=50, prune_on=1)
    assert got == brute(qs, xs, 6, metric)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_a_query_is_sent_once_to_a_group_of_cells(spark, metric, monkeypatch):
    """Random directions, of which no cell can be skipped: not a row for each cell."""
    qs, xs = [[v - 0.5 for v in row] for row in vectors(30, 12, 31)], \
        [[v - 0.5 for v in row] for row in vectors(400, 12, 32)]
    made = []
    visits = NN.visits

    def counted(q, cells, odd, k, width, first=None):
        out = visits(q, cells, odd, k, width, first).persist()
        made.append((out.count(), len(cells.pivots), len(cells.groups)))
        return out

    monkeypatch.setattr(NN, "visits", counted)
    assert run(spark, qs, xs, 5, metric, broadcast_cells=12, block_rows=10) == brute(qs, xs, 5, metric)
    assert made[0][1] > 100 and made[0][2] == 1 and all(n <= 30 for n, _, _ in made)


def test_large_sides_do_not_come_to_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame

    collected = []
    whole = DataFrame.toPandas

    def counted(self):
        out = whole(self)
        collected.append(len(out))
        return out

    monkeypatch.setattr(DataFrame, "toPandas", counted)
    qs, xs = vectors(60, 4, 1), vectors(900, 4, 2)
    assert run(spark, qs, xs, 3, "feature", broadcast_cells=400, prune_on=0) == brute(qs, xs, 3, "feature")
    assert not collected


def test_few_items_are_not_compared_whole_where_blocks_can_be_skipped(spark, monkeypatch):
    monkeypatch.setattr(NN, "_items_to_all", None)
    qs, xs = vectors(10, 3, 1), vectors(300, 3, 2)
    assert run(spark, qs, xs, 3, "l2", block_rows=100, broadcast_cells=2000) == brute(qs, xs, 3, "l2")


def test_exact_costs_of_equal_items_are_computed_in_bounded_steps(monkeypatch):
    import numpy as np

    sizes, cost_of = [], NN._pair_cost
    monkeypatch.setattr(NN, "_EXACT_CELLS", 100)
    monkeypatch.setattr(NN, "_pair_cost", lambda q, x, m: sizes.append(q.size) or cost_of(q, x, m))
    rows, cols, _ = NN.best_in_block(np.ones((3, 5)), np.ones((200, 5)), 4, "cosine")
    assert max(sizes) <= 100 and list(cols) == [0, 1, 2, 3] * 3


def test_all_cells_of_an_index_are_probed_by_one_row_a_query(spark, tmp_path, monkeypatch):
    xs = vectors(200, 5, 3)
    x = spark.createDataFrame(list(enumerate(xs)), "id bigint, embedding array<double>")
    path = str(tmp_path / "index")
    build_index(x, path, ivf=True, cells=20)
    made, written = [], IX.written

    def counted(df, purpose):
        out = written(df, purpose)
        made.append((purpose, out.count()))
        return out

    monkeypatch.setattr(IX, "written", counted)
    q = x.selectExpr("id AS query_id", "embedding AS vec")
    got = {}
    for r in search_index(q, spark, path, 4, nprobe=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == brute(xs, xs, 4, "cosine") and made == [("probes", 200)]


def test_memory_of_a_task_is_bounded(monkeypatch):
    """Costs, and factors of queries, are made for as many queries as are met at once."""
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(3)
    q, x = r.normal(size=(8000, 64)), r.normal(size=(8000, 64))
    for metric in ("l2", "cosine"):
        factors = NN.item_factors(x, metric)
        tracemalloc.start()
        rows, cols, cost = NN.best_in_block(q, x, 3, metric, factors=factors)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(rows) == 24000 and most < 32e6, (metric, most)
        near = NN._pair_cost(q[[5] * 8000], x, metric).argsort(kind="stable")[:3]
        assert list(cols[rows == 5]) == list(near)


def test_blocks_keep_ids_of_text_and_refuse_null_vectors(spark, monkeypatch):
    """Groups come as Arrow tables: ids keep their type, and a null vector is no other row's."""
    xs = [(f"i{n:03d}", [float(n % 7), float(n % 11)]) for n in range(60)]
    x = spark.createDataFrame(xs[::-1], "id string, vec array<double>")
    q = x.selectExpr("id AS query_id", "vec")
    for metric in ("l2", "ip"):
        got = {}
        for r in NN.nearest(q, x, 3, metric, broadcast_cells=4, block_rows=20).orderBy(
                "query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(int(r.id[1:]))
        want = brute([v for _, v in xs], [v for _, v in xs], 3, metric)
        assert got == {f"i{n:03d}": ids for n, ids in want.items()}
    gone = x.selectExpr("id", "IF(id = 'i007', null, vec) AS vec")
    with pytest.raises(Exception, match="null"):
        NN.nearest(q, gone, 3, "ip", broadcast_cells=4, block_rows=20).collect()


def test_groups_of_short_vectors_are_bounded_by_rows(spark, monkeypatch):
    """A query is compared with few rows of a group, and neither queries nor items are sent to every task."""
    import numpy as np

    groups = NN.gathered(np.arange(300), np.full(300, 1000), 3)
    assert max(len(g) for g in groups) * 1000 <= 50_000 and sum(map(len, groups)) == 300
    plans, applied = [], NN.F.broadcast
    monkeypatch.setattr(NN.F, "broadcast", lambda df: plans.append(df.columns) or applied(df))
    xs = vectors(120, 3, 4)
    x = spark.createDataFrame(list(enumerate(xs)), "id bigint, vec array<double>")
    monkeypatch.setattr(NN, "GROUP_ROWS", 30)
    got = run(spark, xs, xs, 5, "cosine", broadcast_cells=3, block_rows=20)
    assert got == brute(xs, xs, 5, "cosine") and x.count() == 120
    assert ["block", "parts", "chunks"] in plans and ["cell", "block", "place"] in plans


def test_queries_that_visit_the_same_cells_meet_them_at_once(monkeypatch):
    import numpy as np

    r = np.random.default_rng(5)
    q, x = r.normal(size=(600, 4)), r.normal(size=(1000, 4))
    cell = np.arange(1000) % 100
    visited = np.zeros((600, 100), bool)
    visited[np.arange(600), np.arange(600) % 2] = True
    monkeypatch.setattr(NN, "_CHUNK_CELLS", 10_000)
    made, factors = [], NN._factors
    monkeypatch.setattr(NN, "_factors", lambda m, metric, side: made.append(side) or factors(m, metric, side))
    rows, cols, cost = NN.best_in_block(q, x, 3, "l2", cell=cell, visited=visited)
    assert made.count("query") <= 4  # 60 of ten queries each, if every step were bounded by all items
    for i in (0, 1, 599):
        own = np.flatnonzero(cell == i % 2)
        want = own[((x[own] - q[i]) ** 2).sum(1).argsort(kind="stable")[:3]]
        assert list(cols[rows == i]) == list(want)


def test_cells_are_not_ranked_when_all_are_probed(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    q, centre, size = r.normal(size=(4, 3)), r.normal(size=(6, 3)), np.array([1, 0, 2, 5, 5, 5])
    few = IX._seen(q, centre, size, 3, 2)
    assert (few.sum(1) >= 2).all() and not few.all()
    monkeypatch.setattr(IX.np, "argsort", None)
    assert IX._seen(q, centre, size, 3, 6).all()
