"""Archives: round trip, revisits, damage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest

from ledgerlens.llm import warc

PAGES = "page_id long, url string, html string, payload string, mark string, n long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p", "m", 1) for r in rows], PAGES).repartition(3)


def test_round_trip_with_copies_and_missing_values(spark):
    long = "<p>é</p>" * 60_000
    rows = [(5, "http://a/ü x\n", "same"), (3, "http://b", "same"), (9, None, "same"), (4, "u", None), (2, "u", ""), (8, "u", long), (None, "u", "same"), (None, "v", "only"), (3, "again", "same"), (11, "z", "other")]
    out = warc.round_trip(pages(spark, rows)).collect()
    assert all(r.error is None for r in out) and len(out) == len(rows)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for i, u, h in rows:
        same = [p for p, _, x in rows if (x or "") == (h or "") and p is not None]
        first = min(same) if same else None
        kind = "response" if first is None or i == first else "revisit"
        want.append((i, u, len((h or "").encode()), sha(h), kind, None if kind == "response" else first, (h or "").encode() if kind == "response" else None))
    have = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in out]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(have, key=key) == sorted(want, key=key)


def test_small_payloads_are_not_shared(spark):
    out = warc.round_trip(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), least=3).collect()
    assert sorted((r.page_id, r.record_type) for r in out) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_files_hold_one_member_per_record_and_roll_over(spark, tmp_path):
    rows = [(i, "u", f"text {i} " * 200) for i in range(50)]
    kinds = warc.with_kinds(pages(spark, rows))
    table = warc.write_archives(kinds, f"file://{tmp_path}", archive_bytes=1000)
    assert table.count() > 5 and table.groupBy().sum("records").first()[0] == 50
    path = table.first()["path"]
    with gzip.open(path) as plain:  # any gzip reader sees the members one after the other
        assert plain.read().count(b"WARC/1.1\r\n") == table.first()["records"]
    assert warc.read_archives(table, f"file://{tmp_path}").count() == 50


def test_reader_reports_damage_after_the_good_records():
    good = [warc.member(warc.record(i, "u", f"payload {i}".encode() * 9000)) for i in range(3)]
    read = lambda data: list(warc.read_records(io.BytesIO(data)))
    assert [r["page_id"] for r in read(b"".join(good))] == [0, 1, 2]
    assert read(b"") == []
    cut = read(b"".join(good)[:-20])
    assert [r.get("page_id") for r in cut] == [0, 1, None] and "ends inside" in cut[-1]["error"]
    body = warc.record(7, "u", b"payload").replace(b"payload\r\n", b"pay1oad\r\n")
    assert "digest" in read(good[0] + warc.member(body))[1]["error"]
    assert "no content length" in read(warc.member(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"))[0]["error"]
    assert "not a gzip" in read(good[0] + b"garbage garbage")[1]["error"]
    assert "after the record" in read(warc.member(warc.record(1, None, b"x") + b"more"))[0]["error"]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_chunks_of_any_size(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    data = b"".join(warc.member(warc.record(i, f"http://x/{i}", bytes([65 + i]) * 300, None if i % 2 else 0 if i else None)) for i in range(4))
    assert [(r["page_id"], r["record_type"], r["payload_bytes"]) for r in warc.read_records(io.BytesIO(data))] == [(0, "response", 300), (1, "response", 300), (2, "revisit", 300), (3, "response", 300)]


@pytest.mark.parametrize("damage", ["cut", "byte", "record"])
def test_records_that_do_not_come_back_are_an_error(spark, tmp_path, damage):
    rows = pages(spark, [(i, "u", f"page {i} " * 50) for i in range(40)]).coalesce(1)
    folder = f"file://{tmp_path}"
    archives = warc.write_archives(warc.with_kinds(rows, 0), folder)
    assert warc.whole(warc.read_archives(archives, folder)).count() == 40
    (path,) = tmp_path.glob("*.warc.gz")
    data = path.read_bytes()
    ends = [i for i in range(1, len(data)) if data[i : i + 3] == b"\x1f\x8b\x08"]
    path.write_bytes({"cut": data[: len(data) - 7], "byte": data[:500] + bytes([data[500] ^ 255]) + data[501:], "record": data[: ends[-1]]}[damage])
    for columns in (["page_id"], ["error"]):
        with pytest.raises(Exception, match="archive: "):
            warc.whole(warc.read_archives(archives, folder)).select(*columns).collect()
