import re

from conftest_llm import edge_rows
from tonearm.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, scan_licenses, words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows):
    templates = [(label, set(words_of(t))) for label, t in TEMPLATES]
    out = []
    for d, t, *_ in rows:
        low = (t or "").translate(LOWER)
        words = WORD.findall(low)
        places, base = [], set()
        for phrase, label in PHRASES.items():
            own = phrase.split()
            for i in range(len(words) - len(own) + 1):
                if words[i:i + len(own)] == own:
                    places.append(i)
                    base.add(label)
        labels, best = set(base), 0.0
        for block in low.split("\n\n"):
            have = set(WORD.findall(block))
            for label, own in templates:
                if 100 * len(own & have) >= CONTAINMENT * len(own):
                    labels.add(label)
                    best = max(best, len(own & have) / len(own))
        out.append((d, len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best))
    return sorted(out, key=repr)


def license_rows():
    mit = TEMPLATES[3][1]
    cut = " ".join(mit.split()[:-2])
    return edge_rows() + [
        (100, f"x\n{mit.upper()}\ny"), (101, mit.replace(" ", "\n")), (102, mit.replace(",", "\n\n")),
        (103, cut), (104, " ".join(mit.split()[:-6])), (105, "cc by CC-BY\tcc; by General Public License"),
        (106, "All\x00rights\x7freserved."), (107, "cc"), (108, "by cc"), (109, "all rights reservedé"),
        (110, "\n\n\n".join(t for _, t in TEMPLATES)), (111, "Released under the MIT License. " * 3000),
        (112, "general public"), (113, "license all rights reserved"), (100, f"x\n{mit.upper()}\ny")]


def test_equals_brute_force_on_edge_cases(spark):
    rows = license_rows()
    docs = spark.createDataFrame([(r[0], r[1], "c") for r in rows],
                                 "doc_id bigint, text string, LABELS string").repartition(3)
    found = scan_licenses(docs).collect()
    assert sorted((tuple(r)[:8] for r in found), key=repr) == brute(rows)
    blocks = {r.doc_id: r.blocks for r in found}
    assert [b.label for b in blocks[100]] == ["mit"] and not blocks[104] and len(blocks[110]) >= 12


def test_other_templates_and_lower_containment(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "one two x"), (3, "one"), (4, "")],
                                 "doc_id bigint, text string")
    rows = scan_licenses(docs, templates=(("t", "one two three"),), phrases={"two x": "p"}, containment=60)
    got = {r.doc_id: (r.labels, round(r.score, 3)) for r in rows.collect()}
    assert got == {1: ("t", 1.0), 2: ("p,t", 1.0), 3: ("", 0.0), 4: ("", 0.0)}


def test_empty_table(empty):
    assert scan_licenses(empty).count() == 0


def test_query_equals_brute_force(spark, sf):
    from tonearm.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op1_license_scan"](spark, sf)
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=repr) == brute(rows)
