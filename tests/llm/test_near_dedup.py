import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from conftest_llm import edge_rows
from tonearm.llm import components as graph
from tonearm.llm.components import components
from tonearm.llm.near_dedup import (
    _LONG_FUNCTIONS, band_keys, estimate, minima, near_duplicates, packed, shingle_sets,
)
from tonearm.session import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size):
    """Every pair; rows of one id are one node, rows without an id are alone."""
    sets = []
    for d, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        if len(words) >= size:
            own = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
        else:
            own = {tuple(words)} if words else set()
        sets.append((d, own))
    top = {d: d for d, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    having = defaultdict(set)
    for i, (d, own) in enumerate(sets):
        if d is not None:
            for s in own:
                having[s].add(i)
    for i, (d, own) in enumerate(sets):
        for j in {j for s in own for j in having[s]} if d is not None else ():
            e, other = sets[j]
            if 100 * len(own & other) >= 80 * len(own | other):
                a, b = find(d), find(e)
                top[max(a, b)] = min(a, b)
    return [(d, len(own), None if d is None else find(d), d is None or find(d) == d)
            for d, own in sets]


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_equals_brute_force_on_edge_cases(edge):
    for size in (4, 5):
        assert order(near_duplicates(edge, shingle=size).collect()) == order(brute(edge_rows(), size))


def test_chains_and_groups(spark):
    """Copies that differ more and more: only links between neighbours; a crowded group; a hot text."""
    rnd = np.random.default_rng(3)
    words = [f"w{i}" for i in rnd.permutation(400)]
    rows, text = [], list(words[:200])
    for i in range(30):
        rows.append((1000 - i, " ".join(text)))
        for k in rnd.choice(200, 3, replace=False):
            text[k] = f"n{i}x{k}"
    group = list(words[200:])
    for i in range(60):
        own = list(group)
        own[int(rnd.integers(200))] = f"g{i}"
        rows.append((2000 + i, " ".join(own)))
    rows += [(3000 + i, "the very same words here again") for i in range(80)]
    rows += [(5, "id with two texts and more words"), (5, "the very same words here again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert order(near_duplicates(docs, shingle=4).collect()) == order(brute(rows, 4))


def test_empty_table(empty):
    assert near_duplicates(empty).count() == 0


def test_query_equals_brute_force(spark, sf):
    from tonearm.llm.queries import QUERIES
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op9_minhash_near_dedup"](spark, sf).collect()
    assert order(got) == order(brute(rows, 4))


def test_estimate_follows_similarity():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [np.unique(pool[:1000]), np.unique(pool[200:1000]), np.unique(pool[2000:])]
    signs = packed(minima(sets)).view(np.uint8)
    nibbles = np.stack([signs & 15, signs >> 4], axis=2).reshape(3, -1)[:, :100]
    assert abs(estimate((nibbles[0] == nibbles[1]).sum()) - 0.8) < 0.2
    assert abs(estimate((nibbles[0] == nibbles[2]).sum())) < 0.15
    keys = band_keys(minima(sets))
    assert len(np.unique(keys[0])) == keys.shape[1]
    assert (keys[0] == keys[1]).any() and not (keys[0] == keys[2]).any()


def test_longer_signatures_are_closer():
    pool = np.random.default_rng(5).integers(0, 2**63, 1000, dtype=np.uint64)
    signs = packed(minima([np.unique(pool), np.unique(pool[200:])], _LONG_FUNCTIONS)).view(np.uint8)
    nibbles = np.stack([signs & 15, signs >> 4], axis=2).reshape(2, -1)
    assert nibbles.shape[1] == 1024
    assert abs(estimate((nibbles[0] == nibbles[1]).sum(), 1024) - 0.8) < 0.07


def test_shingle_sets_of_short_texts():
    got = shingle_sets(pa.array(["a b", "A  b", None, "", "a b c d", "b a"]), 4)
    assert [len(s) for s in got] == [1, 1, 0, 0, 1, 1]
    assert got[0] == got[1] and got[0] != got[5]


def test_components(spark):
    edges = spark.createDataFrame(
        [(5, 4), (4, 3), (9, 8), (8, 9), (7, 7), (3, 1), (100, 8), *[(i, i + 1) for i in range(200, 260)]],
        "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 100: 8, **{i: 200 for i in range(200, 261)}}
    assert components(edges.limit(0)).count() == 0


def test_stars_need_no_round(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(graph, "written", lambda df, purpose: steps.append(purpose) or written(df, purpose))
    edges = spark.createDataFrame([(2, 1), (1, 3), (9, 4), (4, 9)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 9: 4}
    assert steps == ["edges", "least"]
