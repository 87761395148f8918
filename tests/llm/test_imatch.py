import hashlib
from collections import Counter

from conftest_llm import edge_rows
from tonearm.llm import imatch
from tonearm.llm.imatch import fingerprint_documents


def chain(rows):
    """Rows by id (none first) and text, each with its edited text."""
    rows = sorted(((d is not None, d or 0, t or "") for d, t, *_ in rows))
    out = []
    for i, (known, d, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][2]
        half = len(text) // 2
        out.append((d if known else None, text, text[:len(text) - half] + following[:half]))
    return out


def alike(a, b):
    a, b = a.split(":"), b.split(":")
    return (sum(x == y != "-" for x, y in zip(a, b))
            / sum((x, y) != ("-", "-") for x, y in zip(a, b)))


def check(rows, found):
    want = chain(rows)
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for _, _, t in want}
    assert sorted(((d, len(t), digest[e]) for d, t, e in want), key=repr) == sorted(
        ((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr)
    for r in found:
        assert abs(r.near_edited - alike(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert 0 <= r.near_next <= 1
    prints = {}
    by_key = {}
    for r in found:
        by_key.setdefault((r.doc_id, r.n_chars, r.edited_sha256), r)
    for i, (d, t, e) in enumerate(want):
        r = by_key[d, len(t), digest[e]]
        prints.setdefault(t, set()).add(r.fingerprint)
        prints.setdefault(e, set()).add(r.edited_fingerprint)
        after = want[(i + 1) % len(want)]
        other = by_key[after[0], len(after[1]), digest[after[2]]]
        assert abs(r.near_next - alike(r.fingerprint, other.fingerprint)) < 1e-12
    assert all(len(x) == 1 for x in prints.values())  # equal texts, equal fingerprints


def test_edge_cases(edge):
    check(edge_rows(), fingerprint_documents(edge).collect())


def test_lexicon_larger_than_a_broadcast(edge, monkeypatch):
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 0)
    check(edge_rows(), fingerprint_documents(edge).collect())


def test_one_document_and_none(spark, empty):
    one = spark.createDataFrame([(3, "Ein Wort")], "doc_id bigint, text string")
    rows = fingerprint_documents(one).collect()
    check([(3, "Ein Wort")], rows)
    assert rows[0].near_next == 1.0
    assert fingerprint_documents(empty).count() == 0


def test_terms_in_the_band_only(spark):
    rows = [(i, f"common t{i % 3} rare{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.fingerprint for r in fingerprint_documents(docs, band=(0.1, 0.5)).collect()}
    assert all(len({found[i] for i in found if i % 3 == k}) == 1
               for k in range(3) if found[k].split(":")[0] == found[k + 3].split(":")[0])
    assert len({f.split(":")[0] for f in found.values()}) >= 3


def test_query(spark, sf):
    from tonearm.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = QUERIES["op8_imatch_fingerprints"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    found = df.collect()
    check(rows, found)
    assert sum(r.near_edited for r in found) > sum(r.near_next for r in found)


def test_a_third_of_rows_are_near_copies(spark):
    import random
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = rnd.sample(words, 60)
    rows = [(i, " ".join(rnd.sample(words, 60))) for i in range(200)]
    for i in range(100):  # one word each is another one
        at = rnd.randrange(60)
        rows.append((200 + i, " ".join([*base[:at], f"own{i}", *base[at + 1:]])))
    found = {r.doc_id: r for r in fingerprint_documents(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    copies = [found[200 + i].near_next for i in range(99)]
    assert min(copies) > 0 and sum(copies) / 99 > 0.5
    assert max(found[i].near_next for i in range(200)) < 0.5


def by_hand(rows, band):
    """Fingerprints of texts that are not alike: document counts, masks and hashes with plain loops."""
    import regex
    import xxhash

    def long(value, seed):
        return xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=value < 0), seed)

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def of_text(value, seed=42):
        return xxhash.xxh64_intdigest(value.encode(), seed)

    def terms(text):
        return set(regex.findall(r"[\p{L}\p{N}]+", text.lower()))

    count = Counter(t for _, text in rows for t in terms(text))
    lexicon = {}
    for term, n in count.items():
        if n >= max(2, band[0] * len(rows)) and n <= band[1] * len(rows):
            h, mask = signed(of_text(term)), 0
            for k, share in enumerate(imatch.PARTS):
                # a column of two values: the second is hashed with the hash of the first as its seed
                draw = signed(xxhash.xxh64_intdigest(k.to_bytes(4, "little"), long(h, 42)))
                mask |= (draw % imatch._DRAWS < int(share * imatch._DRAWS)) << k
            lexicon[term] = (h, mask)

    def fingerprint(text):
        own = sorted(lexicon[t] for t in terms(text) if t in lexicon)
        out = []
        for k in range(len(imatch.PARTS)):
            h, some = 42, False
            for term, mask in own:
                if mask >> k & 1:
                    h = xxhash.xxh64_intdigest(mask.to_bytes(4, "little"), long(term, h))
                    some = True
            if not some and k == 0:
                h, some = long(signed(of_text(text)), of_text("text")), True
            out.append(f"{h:016x}" if some else "-")
        return ":".join(out)

    return [(d, fingerprint(t), fingerprint(e)) for d, t, e in chain(rows)]


def test_fingerprints_by_hand(spark):
    import random
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(700)] + ["Äther", "naïve", "ß", "42"]
    weights = [1 / (i + 3) for i in range(len(words))]
    rows = [(i * 3, " ".join(rnd.choices(words, weights, k=rnd.randint(25, 60))) + f", own{i}!") for i in range(90)]
    rows.append((1000, "!! ..."))  # no term at all
    band = (0.03, 0.4)
    found = fingerprint_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), band=band)
    got = sorted((r.doc_id, r.fingerprint, r.edited_fingerprint) for r in found.collect())
    assert got == sorted(by_hand(rows, band))
    assert sum(f.count("-") < 8 for _, f, _ in got) > 30
