import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np

from tonearm.llm.language import UNKNOWN, WEIGHTS, family_of, grams, identify, learn, train_machine


def test_grams_stay_inside_words_and_texts():
    one = grams(["ab cd"])
    assert one.totals().tolist() == [4 + 3 * 2 + 2 * 2 + 2]
    many = grams(["", None, "ab cd", "12 .", "Ab  CD!"])
    assert many.totals().tolist() == [0, 0, 16, 0, 16]
    weights = np.random.default_rng(0).normal(size=(1 << 15, 2))
    scores = many.scores(weights)
    assert np.allclose(scores[2], scores[4]) and np.allclose(scores[2], one.scores(weights)[0])


def test_machine_separates():
    rnd = np.random.default_rng(0)
    rows = [(np.array([i % 2, 2 + i % 5]), np.array([1.0, 0.3 * rnd.random()])) for i in range(40)]
    signs = np.array([1 if i % 2 else -1 for i in range(40)])
    weights = train_machine(rows, signs, 10)
    assert all(s * (weights[a] @ v + weights[-1]) > 0.9 for (a, v), s in zip(rows, signs))


def test_query_on_held_out_rows(spark, sf):
    from tonearm.llm.queries import QUERIES
    languages = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_language_id"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(languages)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == languages[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark, sf, edge, empty):
    model = learn(spark.read.parquet(f"{sf}/documents.parquet"))
    assert set(model.families) == {family_of("en"), family_of("fr")}
    found = identify(edge.withColumn("LANG_pred", edge["lang"]), model)
    assert found.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == edge.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == UNKNOWN) == (not letters) and 0 <= r.score <= 1
        assert letters or r.score == 0
    same = {r.text: set() for r in rows}
    for r in rows:
        same[r.text].add((r.lang_pred, r.score))
    assert all(len(x) == 1 for x in same.values())
    assert identify(empty, model).count() == 0


def corpus(languages, rows, words=12):
    """Labelled texts of made-up words, each language with letters of its own and some in common."""
    rnd = random.Random(3)
    out = []
    for k, language in enumerate(languages):
        letters = "aeiou" + "bcdfghjklmnpqrstvwxyz"[2 * k:2 * k + 5]
        for i in range(rows):
            text = " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7)))
                            for _ in range(words))
            out.append((1000 * k + i, text, language))
    return out


def test_training_and_voting_by_hand(spark):
    """Families, pairs and votes with plain loops over the same n-grams; machines against the best
    objective that gradient descent finds."""
    languages = ["en", "de", "nl", "fr", "es"]
    rows = corpus(languages, 30)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = learn(docs)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]

    def vector(text):
        found = grams([text])
        own = Counter(np.concatenate(found.buckets).tolist())
        return {b: 8.0 * n / sum(own.values()) for b, n in own.items()}

    vectors = [(vector(t), lang) for _, t, lang in learned]

    def objective(weights, bias, sign):
        loss = sum(max(0.0, 1 - sign(lang) * (sum(weights[b] * x for b, x in v.items()) + bias)) ** 2
                   for v, lang in vectors if sign(lang))
        return (float(np.dot(weights, weights)) + bias * bias) / 2 + 10.0 * loss

    def descend(sign):
        own = [(np.array(list(v)), np.array(list(v.values())), sign(lang)) for v, lang in vectors if sign(lang)]
        weights, bias = np.zeros(1 << 15), 0.0
        for step in range(400):
            gw, gb = weights.copy(), bias
            for at, x, y in own:
                slack = 1 - y * (weights[at] @ x + bias)
                if slack > 0:
                    np.add.at(gw, at, -20.0 * slack * y * x)
                    gb -= 20.0 * slack * y
            rate = 2e-4
            weights, bias = weights - rate * gw, bias - rate * gb
        return objective(weights, bias, sign)

    family = {"en": "germanic", "de": "germanic", "nl": "germanic", "fr": "romance", "es": "romance"}
    names = list(model.families)
    assert names == ["germanic", "romance"] and model.families["germanic"] == ["de", "en", "nl"]
    for k, name in enumerate(names):
        def sign(lang, name=name):
            return 1 if family[lang] == name else -1
        assert objective(model.family_weights[:, k], model.family_bias[k], sign) <= descend(sign) * 1.02
    pairs = list(combinations(model.families["germanic"], 2))
    for p, (a, b) in enumerate(pairs):
        def sign(lang, a=a, b=b):
            return {a: 1, b: -1}.get(lang, 0)
        assert objective(model.pair_weights["germanic"][:, p], model.pair_bias["germanic"][p], sign) \
            <= descend(sign) * 1.02

    for row, (_, text, _) in zip(identify(docs, model).orderBy("doc_id").collect(), sorted(rows)):
        v = vector(text)

        def margin(weights, bias):
            return sum(weights[b] * x for b, x in v.items()) + bias
        margins = [margin(model.family_weights[:, k], model.family_bias[k]) for k in range(len(names))]
        own = model.families[names[int(np.argmax(margins))]]
        votes, belief = Counter(), Counter()
        for p, (a, b) in enumerate(combinations(own, 2)):
            name = names[int(np.argmax(margins))]
            m = margin(model.pair_weights[name][:, p], model.pair_bias[name][p])
            first = 1 / (1 + np.exp(-2 * m))
            votes[a if first >= 0.5 else b] += 1
            belief[a] += first
            belief[b] += 1 - first
        best = max(own, key=lambda x: (votes[x], belief[x]))
        assert row.lang_pred == best
        odds = np.exp(2 * (np.array(margins) - max(margins)))
        assert abs(row.score - max(odds) / odds.sum() * belief[best] / (len(own) - 1)) < 1e-5


def test_every_language_is_learned(spark):
    """A language of one labelled row, and more languages than share the usual number of buckets."""
    rows = corpus(["en", "de"], 40) + [(9001, "жил был кот", "ru"), (9002, "жил был пёс", "ru"),
                                       (9003, "ένα δύο τρία", "el"), (9004, "ένα δύο", "el")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = learn(docs)
    own = [x for family in model.families.values() for x in family]
    assert set(own) == {"en", "de"} | {lang for d, _, lang in rows if zlib.crc32(str(d).encode()) % 5}
    many = [(i, chr(0x4E00 + 40 * i) * 3 + " " + chr(0x4E01 + 40 * i), f"x{i}") for i in range(400)]
    model = learn(spark.createDataFrame(many, "doc_id bigint, text string, lang string"))
    learned = {f"x{i}" for i in range(400) if zlib.crc32(str(i).encode()) % 5}
    assert {x for family in model.families.values() for x in family} == learned
    assert model.buckets < 1 << 15 and model.family_weights.size <= WEIGHTS


def test_sample_is_bounded_and_leaves_no_language_out(spark, monkeypatch):
    from tonearm.llm import language as module

    rows = corpus(["en", "de", "fr"], 200) + corpus(["en"], 1)[:1] * 50
    labelled = module._labelled(spark.createDataFrame(
        [*rows, (5001, "uno", "es")], "doc_id bigint, text string, lang string"), "doc_id", "text", "lang")
    counts = module._counts(labelled)
    taken = Counter(r.lang for r in module._sample(labelled, counts, 40).collect())
    assert all(15 <= taken[x] <= 70 for x in ("en", "de", "fr")) and taken["es"] == counts.get("es", 0)
    monkeypatch.setattr(module, "ROWS_LEARNED", 4)
    few = Counter(r.lang for r in module._sample(labelled, counts, 40).collect())
    assert set(few) == set(counts) and sum(few.values()) <= 20


def test_nothing_to_learn_from(edge, empty):
    for docs in (empty, edge.selectExpr("doc_id", "text", "cast(null as string) as lang")):
        rows = identify(edge, learn(docs)).collect()
        assert {r.lang_pred for r in rows} == {UNKNOWN} and {r.score for r in rows} == {0.0}


def test_families_decide_first(spark):
    words = {"en": "the house", "de": "das haus", "fr": "la maison", "es": "la casa", "xx": "qqq zzz"}
    rows = [(i, f"{words[k]} {i}", k) for i, k in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = learn(docs)
    assert set(model.families) == {"germanic", "romance", "only-xx"}
    assert set(model.pair_weights) == {"germanic", "romance"}
    assert all(r.lang_pred == r.lang for r in identify(docs, model).collect())
