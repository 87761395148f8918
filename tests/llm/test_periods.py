import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from conftest_llm import edge_rows
from tonearm.llm.periods import periodic_runs, periodic_stretches, runs_of, with_echoes


def brute_runs(words, least_length=6, exponent=4):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            # the smallest period of a stretch is met first
            if length >= max(least_length, exponent * q) and (i, length) not in found:
                found[i, length] = q
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def echoed(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return text
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))


def periodic_words(rnd):
    """Words of few letters with powers, powers of powers and overlapping runs put in."""
    out = []
    while len(out) < rnd.randint(5, 120):
        root = [rnd.randint(0, rnd.choice([1, 2, 5])) for _ in range(rnd.randint(1, 9))]
        out += (root * rnd.randint(1, 9))[:rnd.randint(1, 60)]
    return out


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 6), (2, 5)])
def test_runs_equal_brute_force(exponent, least):
    rnd = random.Random(exponent * 10 + least)
    for _ in range(300):
        words = periodic_words(rnd)
        assert runs_of(words, least, exponent) == sorted(
            brute_runs(words, least, exponent), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 4)])
def test_filter_keeps_every_run_whole(exponent, least):
    rnd = random.Random(7)
    for _ in range(150):
        texts = [periodic_words(rnd) for _ in range(3)]
        counts = np.array([len(t) for t in texts])
        words = np.array([w for t in texts for w in t], np.uint64)
        kept = periodic_stretches(words, counts, least, exponent)
        assert kept == sorted(kept)
        for t, base in zip(texts, np.cumsum(counts) - counts):
            for s, length, _ in brute_runs(t, least, exponent):
                assert any(a <= base + s and base + s + length <= b for a, b in kept)


def test_filter_leaves_prose_alone():
    rnd = np.random.default_rng(3)
    words = rnd.integers(0, 2000, 50_000).astype(np.uint64)
    words[1000:1400] = words[30_000:30_400]  # a passage twice, far apart
    words[5000:5040] = words[5040:5080]  # and a square
    assert periodic_stretches(words, np.array([50_000]), 6, 4) == []


def order(rows):
    return sorted(rows, key=repr)


def test_equals_brute_force_on_edge_cases(edge):
    found = periodic_runs(with_echoes(edge))
    assert found.columns == [*edge.columns, "n_words", "runs", "collapsed_text"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in found.collect()]
    want = []
    for d, t, *_ in edge_rows():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if len(words) < 5000:  # the quadratic version is too slow for the long ones
            want.append((d, *brute(echoed(d, t))))
    long = [r for r in got if r[1] >= 5000]
    assert order(r for r in got if r[1] < 5000) == order(want)
    assert len(long) == 2 and all(r[2] == [] and len(r[3].split()) == r[1] for r in long)
    assert any(r[2] for r in want)


def test_long_runs_and_texts(spark):
    rows = [(1, "a " * 20_000), (2, "b c " * 9000 + "x " + "b c " * 9000),
            (3, " ".join(str(i % 4999) for i in range(20_100)))]
    found = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed_text) for r in periodic_runs(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1] == ([(0, 20_000, 1)], "a")
    assert found[2] == ([(0, 18_000, 2), (18_001, 18_000, 2)], "b c x b c")
    assert found[3][0] == [(0, 20_100, 4999)]


def test_empty_table_clashing_columns_and_parameters(spark, empty):
    assert periodic_runs(with_echoes(empty)).count() == 0
    docs = spark.createDataFrame([(1, "p q " * 8)], "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "1 AS RUNS", "2 AS n", "3 AS row", "4 AS words", "5 AS a", "6 AS p", "7 AS g")
    found = periodic_runs(with_echoes(docs))
    assert found.columns == ["doc_id", "text", "n", "row", "words", "a", "p", "g", "n_words", "runs",
                             "collapsed_text"]
    row = found.first()
    assert ([tuple(x) for x in row.runs], row.collapsed_text, row.n) == ([(0, 16, 2)], "p q", 2)
    with pytest.raises(ValueError):
        periodic_runs(docs, least_exponent=1)


def test_echoes(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 50))) for i in range(400)] + [(None, "a b"), (3, None)]
    found = with_echoes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert order(tuple(r) for r in found.collect()) == order((d, echoed(d, t)) for d, t in rows)


def test_query_equals_brute_force(spark, sf):
    from tonearm.llm.queries import QUERIES
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(rows)
    checked = 0
    for d, t in rows:
        text = echoed(d, t)
        if len((t or "").split()) > 1500:
            continue
        n, runs, kept = brute(text)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        said = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want = (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
                hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        assert got[d] == want
        checked += bool(runs)
    assert checked > 3
