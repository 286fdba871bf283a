"""WARC archives: the written files by the standard gzip module, the reader on
damaged files, and the round trip on odd tables."""

import base64
import gzip
import hashlib
import io

import pytest

from marketlens.llm import warc

SCHEMA = "page_id long, url string, html string, kept boolean, id string, `a.b` int, row string, payload int, verified string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, min_bytes=0):
    out = []
    for i, (pid, _, html) in enumerate(rows):
        n = len((html or "").encode())
        same = [(p is None, p or 0, k) for k, (p, _, h) in enumerate(rows) if (h or "") == (html or "")]
        first = min(same)[2]
        again = n >= min_bytes and first != i
        out.append((pid, n, digest(html), "revisit" if again else "response", rows[first][0] if again else None, True))
    return sorted(out, key=repr)


ROWS = ([(i, f"http://h/{i % 3}", "<p>same é</p>") for i in range(300, 340)]
        + [(1, None, None), (2, "u", ""), (3, "http://x/ä b\r\nContent-Length: 9", "<a>\r\n\r\nWARC/1.1\r\n\r\n</a>"), (4, "u", "x" * 3_000_000),
           (4, "u", "repeated row"), (4, "u", "repeated row"), (None, "u", "no id"), (None, "u", "no id"), (9, "u", "no id"),
           (2 ** 62, "u", "日本" * 1000), (-5, "", "\x00\x01 tail\r\n\r\n")])


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, True, "z", 1, "r", 2, "v") for r in ROWS], SCHEMA).repartition(3)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def in_file_order(df):
    return [(r["page_id"], r["url"], r["html"]) for r in df.collect()]


@pytest.mark.parametrize("min_bytes", [0, 14])
def test_round_trip_equals_brute_force(spark, pages, min_bytes):
    got = warc.round_trip(pages, min_bytes=min_bytes)
    assert got.columns == ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]
    # which of the rows that repeat an id is the response is left to file order
    assert collected(got) == brute(ROWS, min_bytes)


def test_empty_table_has_no_archive(spark, pages):
    manifest = warc.write_archives(pages.limit(0))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_other_id_types(spark):
    df = spark.createDataFrame([("b\n1", "u", "x"), ("a: é", "u", "x"), (None, None, "x")], "page_id string, url string, html string")
    assert collected(warc.round_trip(df).select("id", "refers_to")) == sorted([("b\n1", "a: é"), ("a: é", None), (None, "a: é")], key=repr)


def test_files_are_gzip_members_of_whole_records(spark, pages, tmp_path):
    manifest = warc.write_archives(pages, folder=f"file://{tmp_path}", archive_bytes=2000, date="2020-01-01T00:00:00Z").collect()
    assert len(manifest) > 3 and sum(m["records"] for m in manifest) == len(ROWS)
    payloads = []
    for m in manifest:
        data = open(m["archive"].removeprefix("file://"), "rb").read()
        assert len(data) == m["bytes"]
        plain = gzip.decompress(data)  # all members together
        recs = list(warc.read_records(io.BytesIO(data), "a"))
        assert [r["record_type"] for r in recs][0] == "warcinfo" and len(recs) == m["records"] + 1
        for r in recs:  # every offset begins a member that holds the record alone
            one = list(warc.read_records(io.BytesIO(data[r["offset"]:]), "b"))[0]
            assert one["record_id"] == r["record_id"] and r["verified"]
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and plain.endswith(b"\r\n\r\n")
        payloads += [(r["row_id"], r["payload"]) for r in recs if r["record_type"] == "response"]
    want = {(None if p is None else str(p), (h or "").encode()) for p, _, h in ROWS}
    assert set(payloads) <= want and {b for _, b in payloads} == {b for _, b in want}


def test_target_uri_cannot_break_the_header(spark, pages):
    records = warc.read_archives(warc.write_archives(pages)).where("record_type = 'response' and row_id = '3'").collect()
    assert [r["target_uri"] for r in records] == ["http://x/%C3%A4%20b%0D%0AContent-Length:%209"]
    assert bytes(records[0]["payload"]) == b"<a>\r\n\r\nWARC/1.1\r\n\r\n</a>"


def archive():
    rows = [{"file": 1, "row": i, "id": str(i), "url": "u", "n_bytes": len(p), "digest": hashlib.sha1(p).digest(), "at_file": None,
             "at_row": None, "payload": p} for i, p in enumerate([b"first page", b"", b"y" * 700_000])]
    return [warc._page_record(r, "2020-01-01T00:00:00Z") for r in rows]


class Slow(io.BytesIO):
    """Gives a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7) if n > 0 else n)


def test_reader_does_not_depend_on_chunks():
    data = b"".join(archive())
    assert list(warc.read_records(Slow(data), "a")) == list(warc.read_records(io.BytesIO(data), "a"))
    assert [r["payload_bytes"] for r in warc.read_records(io.BytesIO(data), "a")] == [10, 0, 700_000]
    assert all(r["payload"] is None for r in warc.read_records(io.BytesIO(data), "a", payloads=False))


def test_damaged_archives():
    parts = archive()
    whole = b"".join(parts)

    def read(data):
        return list(warc.read_records(io.BytesIO(data), "name"))

    for cut in (len(whole) - 1, len(whole) - 9, len(parts[0]) + 30, len(parts[0]) + 5):
        with pytest.raises(ValueError, match="name at"):
            read(whole[:cut])
    with pytest.raises(ValueError, match="name at 0"):
        read(b"plain text, no gzip member")
    with pytest.raises(ValueError, match="no WARC record"):
        read(gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n\r\n\r\n"))
    for bad in (gzip.decompress(parts[0]).replace(b"first page", b"first"), gzip.decompress(parts[0]).replace(b"first page", b"first page and more")):
        with pytest.raises(ValueError):
            read(gzip.compress(bad))
    with pytest.raises(ValueError, match="no Content-Length"):
        read(gzip.compress(b"WARC/1.1\r\nContent-Length: x\r\n\r\n\r\n\r\n"))
    changed = read(gzip.compress(gzip.decompress(parts[0]).replace(b"first page", b"other page")) + parts[1])
    assert [r["verified"] for r in changed] == [False, True]


def test_a_revisit_of_something_else_is_not_verified(spark):
    cols = "archive string, offset long, record_type string, record_id string, refers_to_record string, target_uri string, row_id string, payload_bytes long, payload_digest string, verified boolean"
    recs = spark.createDataFrame([
        ("a", 0, "response", "<1>", None, "u", "1", 5, "D", True), ("a", 1, "revisit", "<2>", "<1>", "u", "2", 5, "D", True),
        ("a", 2, "revisit", "<3>", "<1>", "u", "3", 5, "E", True), ("a", 3, "revisit", "<4>", "<9>", "u", "4", 5, "D", True),
        ("a", 4, "warcinfo", "<0>", None, None, None, 0, "x", True)], cols)
    assert {r["id"]: (r["refers_to"], r["verified"]) for r in warc.page_records(recs).collect()} == {
        1: (None, True), 2: (1, True), 3: (1, False), 4: (None, False)}
