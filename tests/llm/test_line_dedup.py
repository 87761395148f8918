import hashlib
from collections import defaultdict

from conftest_llm import SCHEMA, edge_rows
from tonearm.llm import line_dedup
from tonearm.llm.line_dedup import dedup_lines, keep_bitmaps

BLANKS = " \t\n\v\f\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_docs=3, least_chars=20):
    split = [(d, (t or "").split("\n")) for d, t, *_ in rows]
    holders = defaultdict(set)
    for d, lines in split:
        for line in lines:
            key = line.strip(BLANKS).translate(UPPER)
            if d is not None and len(key) >= least_chars:
                holders[key].add(d)
    out = []
    for d, lines in split:
        def gone(line):
            own = holders.get(line.strip(BLANKS).translate(UPPER), ())
            return d is not None and len(own) >= least_docs and d != max(own)
        kept = [line for line in lines if not gone(line)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def lines_rows():
    common, other = "The common line of many documents", "ÄÖÜ line with other letters"
    rows = [(i, f"own line number {i}, long enough\n{common}", None, 0.1, "s") for i in range(100, 160)]
    rows += [
        (1, f"  {common.upper()}\t\n\n short \n{common}\r\n", None, 0.1, "s"),
        (2, f"{other}\n{other.replace('Ä', 'ä')}", None, 0.1, "s"), (3, other, None, 0.1, "s"),
        (4, f"{other}\n{other}\nnext", None, 0.1, "s"),
        (5, "two documents hold this line", None, 0.1, "s"), (6, "two documents hold this line", None, 0.1, "s"),
        (7, "x" * 19 + "\n" + "x" * 20, None, 0.1, "s"), (8, "x" * 19 + "\n" + "x" * 20, None, 0.1, "s"),
        (9, "x" * 19 + "\n" + "x" * 20, None, 0.1, "s"),
        # one id twice, with the same text and with another
        (10, "repeated id, the same line\na", None, 0.1, "s"), (10, "repeated id, the same line\na", None, 0.1, "s"),
        (10, "b\nrepeated id, the same line", None, 0.1, "s"), (11, "repeated id, the same line", None, 0.1, "s"),
        (12, "repeated id, the same line\n\n", None, 0.1, "s"),
        # all lines go; words of the bitmap in between are left out
        (13, common, None, 0.1, "s"), (14, "\n" * 200 + common + "\n" * 63 + common + "\n", None, 0.1, "s"),
        (None, common, None, 0.1, "s"), (None, common + "\n" + other, None, 0.1, "s"),
    ]
    return rows + edge_rows()


def test_equals_brute_force(spark):
    rows = lines_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped", "keep", "kept_text"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()]
    want = brute(rows)
    assert order(got) == order(want)
    assert sum(r[2] for r in want) > 60
    few = dedup_lines(docs, least_docs=2, least_chars=5)
    assert order((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in few.collect()) == order(
        brute(rows, 2, 5))


def test_bitmaps_hold_only_words_that_drop(spark):
    docs = spark.createDataFrame(lines_rows(), SCHEMA)
    found = {r.doc: [(w.word, w.bits) for w in r.keep] for r in keep_bitmaps(docs).collect()}
    # places 200 and 263 are bit 8 of word 3 and bit 7 of word 4
    assert found[14] == [(3, ~(1 << 8)), (4, ~(1 << 7))]
    assert found[13] == [(0, ~1)]
    assert 159 not in found and 5 not in found


def test_a_line_of_many_documents_is_dealt_to_groups(spark, monkeypatch):
    rows = [(i, f"the line that all documents share\n{i}", None, 0.1, "s") for i in range(3000)]
    kept = {}
    monkeypatch.setattr(line_dedup, "written", lambda df, name: kept.setdefault(name, df))
    found = dedup_lines(spark.createDataFrame(rows, SCHEMA))
    assert found.where("n_dropped = 1").count() == 2999
    sizes = [r["count"] for r in kept["lines"].groupBy("h", "h2", "salt").count().collect()]
    assert len(sizes) == line_dedup.SALTS and max(sizes) < 3 * 3000 / line_dedup.SALTS
    # and each group passes on three documents at most
    assert kept["lines"].where("first AND nth <= 3").count() <= 3 * line_dedup.SALTS


def test_empty_table_and_clashing_columns(spark, empty):
    assert dedup_lines(empty).count() == 0
    docs = spark.createDataFrame([(i, "a line that three documents hold") for i in range(3)],
                                 "doc_id bigint, text string")
    odd = docs.selectExpr("doc_id", "text", "1 AS N_LINES", "'k' AS kept_text", "2 AS keep", "3 AS row",
                          "4 AS doc", "5 AS version", "6 AS h", "7 AS lines")
    found = dedup_lines(odd)
    assert found.columns == ["doc_id", "text", "row", "doc", "version", "h", "lines", "n_lines",
                             "n_dropped", "keep", "kept_text"]
    assert sorted((r.doc_id, r.n_dropped, r.row, r.doc) for r in found.collect()) == [
        (0, 1, 3, 4), (1, 1, 3, 4), (2, 0, 3, 4)]


def test_no_python_in_the_plan(spark, sf):
    from tonearm.llm.queries import QUERIES
    found = QUERIES["op11_line_dedup"](spark, sf)
    plan = found._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in brute(rows)]
    assert order(tuple(r) for r in found.collect()) == order(want)
