import hashlib
import uuid
from datetime import datetime, timezone

import pytest

from recontact.llm import warc


def expected(rows):
    sizes = {}
    for page, body in rows:
        payload = (body or "").encode()
        sizes.setdefault(payload, []).append(page)
    out = []
    for page, body in rows:
        payload = (body or "").encode()
        holder = max(sizes[payload], key=lambda p: (p is not None, p))
        shared = len(payload) >= warc.LEAST_SHARED and page != holder
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if shared else "response", holder if shared else None))
    return sorted(out, key=str)


def digest_rows(frame):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()], key=str)


def test_round_trip_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert digest_rows(warc.archive(pages)) == expected(rows)


def test_copies_nulls_and_long_bodies(spark):
    big, edge, short = "é" * 700_000, "x" * 1000, "y" * 999
    rows = [(1, "a", big), (2, "b", big), (9, None, big), (None, "u", edge), (3, "c", edge), (4, "d\r\ne", short), (5, "e", short),
            (6, "", None), (7, "", ""), (None, None, None)]
    pages = spark.createDataFrame([(a, b, c, 1, "z") for a, b, c in rows], "page_id long, url string, html string, payload int, address string").repartition(4, "page_id")
    assert digest_rows(warc.archive(pages)) == expected([(a, c) for a, _, c in rows])
    assert warc.archive(pages.limit(0)).collect() == []


def test_records_are_whole_and_payloads_stored_once(spark, tmp_path):
    body = "same body " * 200
    pages = spark.createDataFrame([(i, f"http://h/{i}", body) for i in range(20)], "page_id long, url string, html string")
    warc.store(pages, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/payloads").count() == 1
    for r in warc.reconstruct(spark, str(tmp_path)).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        assert len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        assert bytes(r.payload).decode() == body


def test_records_are_complete_responses_and_urls_come_back(spark, tmp_path):
    urls = ["http://h/a?x=%0D&y=%25", "http://h/b\r\nSet: x\n", "", None, " http://h/c ", "http://h/é", "hex:41", "null", "x\r\nWARC-Type: revisit\r\n"]
    body = "<p>é</p>" * 300
    rows = [(p, u, body if i % 2 else f"short {i}") for i, (p, u) in enumerate(zip([1, 1, 2, None, None, 5, 6, 7, 8], urls, strict=True))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.store(pages, str(tmp_path), date=datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc))
    found = warc.reconstruct(spark, str(tmp_path))
    named = {}
    for r in found.collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert fields["WARC-Date"] == "2024-05-06T07:08:09Z" and fields["Content-Type"] == "application/http; msgtype=response"
        http, _, payload = rest.removesuffix(b"\r\n\r\n").partition(b"\r\n\r\n")
        answer = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and int(answer["Content-Length"]) == len(r.payload)
        assert payload == (b"" if fields["WARC-Type"] == "revisit" else bytes(r.payload))
        assert str(uuid.UUID(fields["WARC-Record-ID"][10:-1])) == fields["WARC-Record-ID"][10:-1]
        named[fields["WARC-Record-ID"]] = (fields["WARC-Type"], bytes(r.payload), fields.get("WARC-Refers-To"))
    assert len(named) == len(rows)
    assert all(named[refers][:2] == ("response", payload) for kind, payload, refers in named.values() if kind == "revisit")
    back = sorted([(r.page_id, r.url, r.payload_bytes) for r in warc.parse(found).collect()], key=str)
    assert back == sorted([(p, u, len(b.encode())) for p, u, b in rows], key=str)


def test_repeated_rows_have_one_response(spark):
    pages = spark.createDataFrame([(5, "u", "z" * 2000)] * 3 + [(4, "u", "z" * 2000)], "page_id long, url string, html string").coalesce(1)
    rows = digest_rows(warc.archive(pages))
    assert [r[3] for r in rows].count("response") == 1 and len(rows) == 4
    assert all(r[4] == 5 for r in rows if r[3] == "revisit")


def test_changed_payload_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    warc.store(pages, f"{tmp_path}/a")
    warc.store(spark.createDataFrame([(1, "u", "abd")], "page_id long, url string, html string"), f"{tmp_path}/b")
    stored = spark.read.parquet(f"{tmp_path}/a/payloads").select("address")
    stored.crossJoin(spark.read.parquet(f"{tmp_path}/b/payloads").select("payload")).write.parquet(f"{tmp_path}/c/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/c/headers")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.parse(warc.reconstruct(spark, f"{tmp_path}/c")).collect()
