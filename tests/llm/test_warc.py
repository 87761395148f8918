import glob
import gzip
import hashlib
import io

import pytest

from tonearm.llm import warc
from tonearm.llm.warc import Framing, member, read_archives, record, records, write_archives

BIG = "<p>é</p>" * 30


def pages():
    return [(1, "http://a/1", BIG), (2, "http://a/2 x\n", BIG), (3, None, None), (4, "u", ""),
            (5, "u", "short"), (6, "u", "short"), (0, "u", BIG + "!"), (7, "u", BIG + "!"),
            (None, "u", BIG), (1, "http://a/1", BIG), (8, "u", "x" * 700_000), (-9, "u", "z" * 100),
            (9, "u", "z" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "WARC/1.1\r\n\r\n" * 20)]


def expected():
    least = {}
    for p, _, h in pages():
        if p is not None and h and len(h.encode()) >= 100:
            least[h] = min(p, least.get(h, p))
    out = []
    for p, _, h in pages():
        data = (h or "").encode()
        refers = least.get(h) if p is not None and least.get(h) != p else None
        out.append((p, len(data), hashlib.sha256(data).hexdigest(),
                    "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_round_trip_of_edge_cases(spark, tmp_path):
    folder = str(tmp_path / "w")
    rows = spark.createDataFrame(
        [(p, u, h, "extra") for p, u, h in pages()], "page_id bigint, url string, html string, Digest string")
    archives = write_archives(rows.repartition(3), folder, archive_bytes=1000)
    found = read_archives(archives, folder).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in found), key=repr)
    assert got == expected()
    assert all(r.verified for r in found)
    texts = {p: (h or "").encode() for p, _, h in pages()}
    assert all(bytes(r.payload) == texts[r.page_id] for r in found if r.record_type == "response"
               and r.page_id is not None)
    assert sum(r.records for r in archives.collect()) == len(pages())
    assert {r.url for r in found if r.page_id == 2} == {"http://a/2%20x%0A"}
    # any reader of gzip sees the records one after the other
    whole = b"".join(gzip.open(f).read() for f in glob.glob(folder + "/*.warc.gz"))
    assert whole.count(b"WARC-Record-ID") == len(pages())


def test_reader_in_small_pieces_and_broken_archives(monkeypatch):
    monkeypatch.setattr(warc, "_CHUNK", 7)
    data = b"payload " * 50
    digest = hashlib.sha256(data).hexdigest()
    one = record("response", 1, "u", data, digest, len(data))
    archive = member(one) + member(record("revisit", 2, None, None, digest, len(data), 1))
    found = list(records(io.BytesIO(archive)))
    assert [f["verified"] for f in found] == [True, True] and found[0]["payload"] == data
    assert found[1]["fields"]["warc-refers-to"] == "<urn:page:1>"
    wrong = member(one.replace(b"payload payload", b"payload_payload", 1))
    assert [f["verified"] for f in records(io.BytesIO(wrong))] == [False]
    for broken in (archive[:-5], member(one[:-10]), member(one + b"more"), b"no gzip at all",
                   member(b"HTTP/1.1 200 OK\r\n\r\n")):
        with pytest.raises(Framing):
            list(records(io.BytesIO(broken)))
    assert list(records(io.BytesIO(b""))) == []


def test_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = str(tmp_path / "none")
    assert read_archives(write_archives(rows, folder), folder).count() == 0


def test_query_equals_brute_force(spark, sf):
    from tonearm.llm.queries import QUERIES
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
           for r in QUERIES["op4_warc"](spark, sf).collect()}
    seen, want = {}, {}
    for r in sorted(rows, key=lambda r: r.page_id):
        data = (r.html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        refers = seen.setdefault(digest, r.page_id) if len(data) >= 100 else r.page_id
        want[r.page_id] = (len(data), digest, "response" if refers == r.page_id else "revisit",
                           None if refers == r.page_id else refers)
    assert got == want
