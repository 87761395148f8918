import re

from conftest_llm import edge_rows
from tonearm.llm.repeats import remove_repeats


def brute(rows, window=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows]
    least = {}
    for d, own in words:
        if d is not None:
            for i in range(len(own) - window + 1):
                key = tuple(own[i:i + window])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, own in words:
        gone = [False] * len(own)
        if d is not None:
            for i in range(len(own) - window + 1):
                if least[tuple(own[i:i + window])] < d:
                    gone[i:i + window] = [True] * window
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        out.append((d, len(own), sum(gone), kept))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_equals_brute_force_on_edge_cases(edge):
    found = remove_repeats(edge)
    assert found.columns == [*edge.columns, "n_words", "n_removed", "kept_text"]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()]
    want = brute(edge_rows())
    assert order(got) == order(want)
    assert sum(r[2] for r in want) > 30_000


def test_other_window_and_clashing_columns(spark):
    rows = [(1, "a b c d e f"), (2, "x b c d y"), (3, "b c d e z"), (4, "b c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "1 as N_WORDS", "'k' as kept_text")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text)
           for r in remove_repeats(docs, window=3).collect()}
    assert got == {d: (n, m, k) for d, n, m, k in brute(rows, 3)}


def test_empty_table(empty):
    assert remove_repeats(empty).count() == 0


def test_query_equals_brute_force(spark, sf):
    from tonearm.llm.queries import QUERIES
    import hashlib
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in QUERIES["op10_substring_dedup"](spark, sf).collect()]
    want = [(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in brute(rows)]
    assert order(got) == order(want)


def test_many_small_ranges(spark, edge, monkeypatch):
    """Ranges follow the text, not the setting of the session; passages are found across all of them."""
    from tonearm.llm import repeats

    assert repeats.ranges_for(0) == 8 and repeats.ranges_for(1 << 30) == (1 << 30) // repeats.RANGE_BYTES
    monkeypatch.setattr(repeats, "RANGE_BYTES", 4000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(edge).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert order(got) == order(brute(edge_rows()))


def test_no_table_stays_behind(spark, edge):
    from tonearm.llm.repeats import remove_repeats as remove
    before = {t.name for t in spark.catalog.listTables()}
    remove(edge).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_windows_are_compared_by_both_hashes():
    """Equal first hashes alone make no match."""
    import numpy as np
    from tonearm.llm.repeats import _both, _earlier

    hashes = np.array([5, 9, 5, 9], np.uint64)
    extra = [_both(np.array([1, 2], np.uint64), np.array([10, 10])),
             _both(np.array([1, 3], np.uint64), np.array([20, 20]))]
    order_ = np.argsort(hashes, kind="stable")
    ordered = hashes[order_]
    mark = _earlier(extra, np.array([2, 2]), order_, np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]), ordered)
    assert mark.tolist() == [False, False, True, False]


def test_chunks_are_a_file_a_bucket_however_many_tasks_write_them(spark):
    from tonearm.llm.repeats import _chunks
    rows = [(i, "".join(chr(97 + (i * 7 + j) % 26) for j in range(40_000)) + " end") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(12)
    chunks = _chunks(docs, "doc_id", "text", 3)
    assert chunks.count() >= 12
    assert len(chunks.inputFiles()) <= 3
    # a join by chunk moves no chunk
    other = spark.range(5).withColumnRenamed("id", "chunk")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = chunks.join(other, "chunk", "left")._jdf.queryExecution().sparkPlan().toString()
        full = chunks.join(other, "chunk", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and full.count("Exchange") == 1
