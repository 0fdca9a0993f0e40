import gzip
import hashlib
import io
import random
from pathlib import Path

import pytest

from leafwork.llm import warc
from leafwork.llm.common import fresh_path

KIND = "page_id long, url string, html string, row string"


def test_framing():
    payload = bytes(range(256)) * 100
    assert warc.unchunked(warc.chunked(payload, 77)) == payload
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    parts = [(2, None, b"b"), (1, None, b"a"), (3, 3, b"c")]
    assert warc.reassembled(parts) == b"abc"
    for broken in (parts[:2], parts[1:], [(1, None, b"a"), (2, 3, b"b")], [*parts, parts[0]]):
        with pytest.raises(ValueError):
            warc.reassembled(broken)


def test_records_of_a_long_page():
    payload = b"x\r\n\r\n" * 3000
    found = list(warc.records(4, 9, "http://a.b/c d\r\né", payload, segment=1000))
    assert len(found) > 10
    read = list(warc.parse(io.BufferedReader(io.BytesIO(b"\r\n\r\n".join(found) + b"\r\n\r\n"))))
    origin = read[0][0]["warc-record-id"]
    assert {f.get("warc-segment-origin-id", origin) for f, _ in read} == {origin}
    parts = [(int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, b) for f, b in read]
    assert warc.payload_of(warc.reassembled(parts))[0] == payload


def test_archives_give_the_pages_back(spark):
    rng = random.Random(1)
    html = ["", None, "same", "é\r\n\r\nWARC/1.1\r\n", "y" * 200_000, "".join(chr(rng.randint(32, 1000)) for _ in range(60_000))]
    rows = [(i, rng.choice([None, "http://a/ü", "x y\n"]), html[i % len(html)], "clash") for i in range(60)]
    rows += [rows[2], (None, None, "same", None), (None, "u", "only here", None)]
    pages = spark.createDataFrame(rows, KIND)
    got = warc.round_trip(pages).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h, _ in rows:
        h = h or ""
        own = first.get(h) == i
        want.append((i, len(h.encode()), warc.digest(h.encode()), "response" if own else "revisit", None if own else first.get(h)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert warc.round_trip(spark.createDataFrame([], KIND)).count() == 0
    path = fresh_path(spark, "payloads")
    warc.write_archives(pages, path, segment=500)
    read = warc.read_archives(spark, path, payloads=True).collect()
    assert sorted(((str(r.page_id), bytes(r.payload).decode()) for r in read)) == sorted((str(i), h or "") for i, _, h, _ in rows)
    # any reader of the format finds one record a gzip member, and the response that a revisit names
    records = [x for f in Path(path.removeprefix("file://")).glob("part-*") for x in warc.parse(io.BufferedReader(gzip.GzipFile(f)))]
    ids = {f["warc-record-id"]: f["warc-type"] for f, _ in records}
    assert len(ids) == len(records)
    assert {ids[f["warc-refers-to"]] for f, _ in records if f["warc-type"] == "revisit"} == {"response"}


def test_small_payloads_never_revisit(spark):
    rows = [(i, None, "ab" if i % 2 else "abcdef", None) for i in range(6)]
    got = {r.page_id: r.record_type for r in warc.round_trip(spark.createDataFrame(rows, KIND), least=3).collect()}
    assert got == {0: "response", 1: "response", 2: "revisit", 3: "response", 4: "revisit", 5: "response"}


def test_plain_files_are_read_too(tmp_path, spark):
    records = b"\r\n\r\n".join(warc.records(0, 1, "http://a/", b"hello")) + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(records)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(records))
    got = warc.read_archives(spark, f"file://{tmp_path}", payloads=True).collect()
    assert [(r.page_id, bytes(r.payload)) for r in got] == [(1, b"hello")] * 2
    assert warc.digest(b"hello") == __import__("base64").b32encode(hashlib.sha1(b"hello").digest()).decode()


def broken(tmp_path, spark, *records):
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records))
    return warc.read_archives(spark, f"file://{tmp_path}").collect()


def test_wrong_archives_are_errors(tmp_path, spark):
    one, other = list(warc.records(0, 1, None, b"x" * 3000, segment=1000)), next(warc.records(1, 2, None, b"hello"))
    revisit = next(warc.records(2, 3, None, b"hello", refers=1))
    assert [(r.page_id, r.refers_to, r.payload_bytes) for r in broken(tmp_path, spark, other, revisit)] == [(2, None, 5), (3, 2, 5)]
    for records in ([one[0], *one[2:]], [*one[:-1], one[-1].replace(b"Total-Length: ", b"Total-Length: 9")], [other.replace(b"hello", b"jello")], [revisit], [other, next(warc.records(2, 3, None, b"hullo", refers=1))]):
        with pytest.raises(Exception):  # noqa: B017, PT011
            broken(tmp_path, spark, *records)


def test_archives_are_bounded(monkeypatch, spark):
    monkeypatch.setattr(warc, "RECORDS", 3)
    path = fresh_path(spark, "bounded")
    warc.write_archives(spark.range(10).selectExpr("id page_id", "cast(null as string) url", "string(id) html").coalesce(1), path)
    files = list(Path(path.removeprefix("file://")).glob("part-*"))
    assert len(files) == 4
    assert sum(gzip.open(f).read().count(b"WARC-Type") for f in files) == 10
