import hashlib
import random
import struct

import pytest
import zstandard

from factorloom.llm import warc as W
from factorloom.llm.common import fresh


def test_archive():
    a = W.Archive()
    for k in range(200):
        body = f"<html><body>page {k} {'the same template ' * 20}</body></html>".encode()
        a.add(W.record_bytes("response", k, "http://x\r\n/", body, hashlib.sha256(body).hexdigest(), None))
    data = a.close()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size > 0 and data[8:12] == b"\x37\xa4\x30\xec"
    got = list(W.read_archive(data))
    assert len(got) == 200 and got[7][0]["X-Page-ID"] == "7" and got[7][1].startswith(b"HTTP/1.1 200 OK\r\n")
    size_, body = W.parse_http(got[7][1])
    assert size_ == len(body) and body.startswith(b"<html><body>page 7 ")
    # a plain reader with the dictionary reads the first record too
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    assert d.decompressobj().decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n")


def test_round_trip(spark):
    big = "x" * 5000
    rows = [(4, "u", big), (2, "u", big), (9, None, big), (1, "u", "short"), (3, "u", "short"), (5, "u", None), (6, "u", ""), (7, "é", "ü" * 50), (8, "u", "ü" * 50), (8, "u", "ü" * 50), (7, "u", "ü" * 50)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    got = list((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.round_trip(df).collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {sha(big): 2, sha("ü" * 50): 7}
    want, seen = [], set()
    for p, _, h in rows:
        d = sha(h)
        again = d in first and (first[d] != p or p in seen)
        seen.add(p)
        want.append((p, len((h or "").encode()), d, "revisit" if again else "response", first[d] if again else None))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert W.round_trip(df.limit(0)).count() == 0


def test_payloads_and_damage(spark):
    df = spark.createDataFrame([(k, f"http://{k}", f"<p>{k}</p>" * 40) for k in range(50)], "page_id long, url string, html string")
    folder = fresh(spark, "warc-test")
    W.write_archives(W.plan(df), folder)
    assert {(r["page_id"], r["url"], r["payload"]) for r in W.read_archives(spark, folder).collect()} == {tuple(r) for r in df.collect()}
    with pytest.raises(ValueError):
        list(W.read_archive(b"\x00" * 20))


def archive(pages):
    a = W.Archive()
    for k, body in enumerate(pages):
        a.add(W.record_bytes("response", k, "u", body, hashlib.sha256(body).hexdigest(), None))
    return a.close()


@pytest.mark.parametrize("pages", [[b""], [b"a"], [b"<p>few</p>" * 9] * 7, [bytes(range(256)) * 20_000], [b"x" * 3_000_000, b"y", b"z" * 70_000]])
def test_every_archive_has_a_dictionary(pages):
    data = archive(pages)
    assert struct.unpack_from("<II", data)[1] > 0
    assert [W.parse_http(b)[1] for _, b in W.read_archive(data)] == pages


def test_dictionaries_see_the_whole_archive():
    # what only the ends of long records have in common gets into the dictionary
    r = random.Random(1)
    common = r.randbytes(3000)
    found = W.build_dictionary([r.randbytes(70_000) + common for _ in range(80)])
    assert any(common[k : k + 32] in found for k in range(0, 2900, 10))


def test_records_of_equal_rows_have_ids_of_their_own(spark):
    rows = [(1, "u", "s")] * 5 + [(None, "u", "l" * 300)] * 3 + [(2, "u", "l2" * 300)] * 4 + [(3, "u", "huge " * 1_200_000)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = fresh(spark, "warc-test")
    got = W.read_archives(spark, folder, W.write_archives(W.plan(df), folder))
    assert got.select("record_id").distinct().count() == len(rows)
    assert {r["payload"] for r in got.where("page_id = 3 and record_type = 'response'").collect()} == {"huge " * 1_200_000}
    revisits = got.where("record_type = 'revisit'")
    assert revisits.count() == 4 and revisits.join(got.selectExpr("record_id as refers_id", "payload_digest as d"), "refers_id").where("d = payload_digest").count() == 4


def test_revisits_need_their_response(spark):
    df = spark.createDataFrame([(1, "u", "a" * 200), (2, "u", "a" * 200)], "page_id long, url string, html string")
    folder = fresh(spark, "warc-test")
    W.write_archives(W.plan(df).where("page_id = 2"), folder)
    with pytest.raises(Exception, match="no such response"):
        W.resolved(W.read_archives(spark, folder)).collect()
