"""Word vectors against a dense decomposition, and what the encoder makes of them."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.operators.encoder import hashing_encoder
from tonearm.operators.meaning import company, fit_word_vectors, meaning_encoder
from tonearm.plans.search import search_text

TOPICS = {"sea": "wave shore boat salt tide harbour sail anchor".split(),
          "hill": "peak rock trail summit ridge cliff slope valley".split()}


def corpus(n=300, seed=2):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(TOPICS[rnd.choice(["sea"]) if i % 2 else "hill"]) for _ in range(7))
            for i in range(n)]


def brute_company(texts, window):
    out = Counter()
    for t in texts:
        w = t.lower().split()
        for i, a in enumerate(w):
            for b in w[i + 1:i + 1 + window]:
                if a != b:
                    out[a, b] += 1
                    out[b, a] += 1
    return out


def dense(texts, window):
    counts = brute_company(texts, window)
    words = sorted({a for a, _ in counts})
    m = np.zeros((len(words), len(words)))
    for (a, b), n in counts.items():
        m[words.index(a), words.index(b)] = n
    total, own = m.sum(), m.sum(axis=1)
    with np.errstate(divide="ignore"):
        m = np.maximum(np.log(m * total / np.outer(own, own)), 0)
    return words, m, own, total


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, document string").repartition(3)


@pytest.mark.parametrize("window", [2, 8])
def test_company_is_counted(spark, window):
    texts = ["a b a c", "", "x", "B a", "  c  c d ", None]
    found = {(r.a, r.b): r.n for r in company(table(spark, texts), window).collect()}
    assert found == dict(brute_company([t or "" for t in texts], window))


@pytest.mark.parametrize("block", [5, 4096])
def test_vectors_equal_a_dense_decomposition(spark, block):
    """Inner products of the vectors are those of the leading singular vectors, whatever the blocks."""
    texts = corpus()
    words, m, own, total = dense(texts, 3)
    rows = fit_word_vectors(table(spark, texts), 384, window=3, block=block).collect()
    assert sorted(r.word for r in rows) == words
    by = {r.word: np.array(r.vec) for r in rows}
    got = np.array([[by[a] @ by[b] for b in words] for a in words])
    value, vector = np.linalg.eigh(m)
    assert np.allclose(got, (vector * np.abs(value)) @ vector.T, atol=1e-4)
    assert all(len(v) == 384 for v in by.values())
    assert all(abs(r.weight - np.log(total / own[words.index(r.word)])) < 1e-9 for r in rows)
    # few dimensions: the leading ones
    few = {r.word: np.array(r.vec) for r in fit_word_vectors(
        table(spark, texts), 2, window=3, block=block, rounds=12).collect()}
    order = np.argsort(-np.abs(value))[:2]
    want = (vector[:, order] * np.abs(value[order])) @ vector[:, order].T
    got = np.array([[few[a] @ few[b] for b in words] for a in words])
    assert np.allclose(got, want, atol=0.02 * np.abs(want).max())


def test_words_of_a_topic_are_near(spark):
    rows = fit_word_vectors(table(spark, corpus()), 2, window=6).collect()
    unit = {r.word: np.array(r.vec) / (np.linalg.norm(r.vec) + 1e-12) for r in rows}
    inside = [unit[a] @ unit[b] for own in TOPICS.values() for a in own for b in own if a < b]
    across = [unit[a] @ unit[b] for a in TOPICS["sea"] for b in TOPICS["hill"]]
    assert min(inside) > max(across) and np.mean(inside) > 0.8


@pytest.mark.parametrize("cells", [8_000_000, 10])
def test_encoder_finds_texts_without_a_common_word(spark, cells):
    """Sent to every task, or joined."""
    vectors = fit_word_vectors(table(spark, corpus()), 4, window=6).persist()
    encode = meaning_encoder(vectors, broadcast_cells=cells)
    docs = spark.createDataFrame([("1", "wave shore"), ("2", "peak rock"), ("3", "unknown words"), ("4", None)],
                                 "id string, document string")
    stored = encode(docs).select("*", F.col("document").alias("name"),
                                 F.array(F.lit("A")).alias("artists"), F.lit("L").alias("album")).persist()
    by = {r.id: np.array(r.embedding) for r in stored.collect()}
    assert all(abs(np.linalg.norm(by[i]) - 1) < 1e-5 for i in "12") and not by["3"].any() and not by["4"].any()
    queries = spark.createDataFrame([(1, "boat tide"), (2, "summit")], "query_id int, query string")
    found, _ = search_text(queries, stored.where("id < '3'"), encode, 1)
    assert {r.query_id: r.id for r in found.collect()} == {1: "1", 2: "2"}
    # counting words, these have nothing in common
    plain = hashing_encoder()(docs.where("id = '1'").unionByName(
        spark.createDataFrame([("9", "boat tide")], docs.schema))).collect()
    assert abs(np.dot(*[np.array(r.embedding) for r in plain])) < 0.5


def test_nothing_to_learn(spark):
    empty = fit_word_vectors(table(spark, ["alone", "", None]))
    assert empty.count() == 0
    row = meaning_encoder(empty)(spark.createDataFrame([("a b",)], "document string")).first()
    assert len(row.embedding) == 384 and not any(row.embedding)
