import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from conftest_llm import edge_rows
from test_near_dedup import brute as groups
from test_repeats import brute as repeats


def by_hand(rows):
    """Pieces of the documents that stay: every document with letters, one of each group, cut."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    stay = {d for d, _, _, kept in groups(rows, 5) if kept}
    rows = [r for r in rows if r[0] is None or r[0] in stay]
    want = Counter()
    for (d, text, *_), (_, _, removed, kept) in zip(rows, repeats(rows)):
        ids = [*tokenizer.encode(kept if removed else text, add_special_tokens=False).ids, 2]
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return want


def check(found, rows):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == by_hand(rows)
    rooms = defaultdict(list)
    for r in found:
        rooms[r.sequence_id].append((r.offset, r.length))
    for own in rooms.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_equals_stages_by_hand(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(corpus_pipeline.run(spark, sf).collect(), [tuple(r) for r in rows])


def test_stages_on_edge_cases(spark, sf, tmp_path):
    rows = edge_rows()
    known = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()
    # something to learn from, far from the other ids
    rows += [(10_000 + i, r.text, r.lang, 0.5, "src") for i, r in enumerate(known)]
    docs = spark.createDataFrame(
        [(d, t, lang if d and d >= 10_000 else None, s, len(t or "")) for d, t, lang, _, s in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        if k < 3:
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    check(docs.collect(), rows)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint"
                          ).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_junk_goes_at_any_number_of_languages(spark, sf):
    known = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    junk = ["4734663219866878 $$$ a 0x40d7", "{[(i=0;i<10;++i)]};//--==++ 12", "Привет, как дела сегодня? ok",
            "今日はとても良い天気ですね a"]
    clean = ["Is the one", "Der Tag.", "El día es", "one", "CIÓN!! é"]
    planted = list(enumerate(junk + clean, 10_000))
    for languages in ({"en"}, {"en", "de"}, {"en", "de", "fr", "es"}):
        rows = [(r.doc_id, r.text, r.lang) for r in known if r.lang in languages]
        docs = spark.createDataFrame([*rows, *((d, t, None) for d, t in planted)],
                                     "doc_id bigint, text string, lang string")
        kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf).collect()}
        wanted = [(d, t) for d, t in planted[len(junk):] if t.isascii() or "es" in languages]
        assert {d for d, _ in wanted} <= kept
        assert not kept & {d for d, _ in planted[:len(junk)]}


def test_a_language_of_few_rows_stays(spark, sf):
    known = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    few = [(20_000 + i, f"Это обычный русский текст номер {i}, и он останется здесь", "ru") for i in range(9)]
    docs = spark.createDataFrame([*((r.doc_id, r.text, r.lang) for r in known), *few],
                                 "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf).collect()}
    assert {d for d, _, _ in few} <= kept
