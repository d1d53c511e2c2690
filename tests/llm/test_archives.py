"""ARC parsing, WARC writing and reading."""
import gzip
import hashlib
import uuid

from pyspark.sql import functions as F

from lexicor.llm import warc
from lexicor.session import scratch_path

PAYLOADS = [b"", b"short", b"x" * 99, b"y" * 100, b"\r\n\r\n" * 40, b"a\r\n\r\nWARC/1.1\r\n\r\n" * 9, b"tail\r\n" + b"z" * 120 + b"\r\n",
            b"\xff\xfe\x00bin" * 30, "é ü".encode() * 60, b"\r" * 130, b"line\n" * 50, b"end\r\n\r" + b"q" * 100 + b"\r\n\r"]


def arc_file(version, records):
    """Bytes of an ARC file."""
    fields = b"%d 0 Test\nfields\n" % version
    extra = b" 200 - - 0 f.arc" if version == 2 else b""
    out = b"filedesc://f.arc 0.0.0.0 20240101000000 text/plain%s %d\n%s\n" % (extra, len(fields), fields)
    for url, block in records:
        out += b"%s 192.0.2.7 20240102030405 text/html%s %d\n%s\n" % (url, extra, len(block), block)
    return out


def http(order, payload):
    return b"HTTP/1.1 200 OK\r\nX-Order: %d\r\n\r\n" % order + payload


def write(spark, tmp_path, files):
    for i, data in enumerate(files):
        (tmp_path / f"{i}.gz").write_bytes(gzip.compress(data))
    return str(tmp_path)


def converted(spark, path):
    out = scratch_path(spark, "warc")
    order = F.regexp_extract("http", "X-Order: ([0-9]+)", 1)
    warc.convert(warc.read_arc(spark, path), out, order=F.when(order != "", order.cast("long")))
    return out


def test_round_trip_of_any_payload(spark, tmp_path):
    one = [(b"http://a/%d x" % i, http(i, p)) for i, p in enumerate(PAYLOADS)]
    two = [(b"http://b/%d" % i, http(100 + i, p)) for i, p in enumerate(PAYLOADS)]
    rest = [(b"dns:a", b"1.2.3.4"), (b"http://c", b"no head")]
    out = converted(spark, write(spark, tmp_path, [arc_file(1, one + rest), arc_file(2, two)]))
    records = warc.read_warc(spark, out)
    got = records.collect()
    assert sorted(r["warc_type"] for r in got) == sorted(
        ["warcinfo"] * 2 + ["resource"] * 2 + ["response"] * 12 + ["response"] * 3 + ["revisit"] * 9)
    assert all(uuid.UUID(r["id"][10:-1]).version == 5 for r in got)
    by_url = {r["url"]: r for r in got}
    for i, p in enumerate(PAYLOADS):
        first, later = by_url[f"http://a/{i} x"], by_url[f"http://b/{i}"]
        assert bytes(first["payload"]) == p and first["payload_digest"] == hashlib.sha256(p).hexdigest()
        assert first["declared_digest"] == later["declared_digest"] == first["payload_digest"]
        assert first["date"] == "2024-01-02T03:04:05Z"
        if len(p) < 100:
            assert later["warc_type"] == "response" and bytes(later["payload"]) == p
        else:
            assert later["refers_to"] == first["id"] and bytes(later["payload"]) == b""
    for r in warc.resolve(records).where("warc_type = 'revisit'").collect():
        assert r["target"]["payload_digest"] == r["declared_digest"]


def test_damaged_archives(spark, tmp_path):
    good = arc_file(1, [(b"http://a", http(1, b"A" * 5))])
    noise = good + b"not a header\nhttp://x 1 2 3 nan\nhttp://b 1.1.1.1 2024 text/html 3\nabc\nhttp://c 1 2 3 999\ncut"
    got = warc.read_arc(spark, write(spark, tmp_path, [noise, b"", good])).where("url not like 'filedesc%'").collect()
    assert sorted(r["url"] for r in got) == ["http://a", "http://a", "http://b"]
    assert [bytes(r["payload"]) for r in got if r["url"] == "http://b"] == [b"abc"]
    assert list(warc.warc_records([b"junk", b"WARC/1.1\r\nContent-Length: x", b"WARC/1.1\r\nContent-Length: 50", b"short"])) == []


def test_records_with_equal_orders_and_without(spark, tmp_path):
    p = b"p" * 150
    rows = [(b"http://a", http(5, p)), (b"http://a", http(5, p)), (b"http://b", http(5, p)), (b"http://c", b"HTTP/1.0 200\r\n\r\n" + p),
            (b"http://d", http(6, p))]
    got = warc.read_warc(spark, converted(spark, write(spark, tmp_path, [arc_file(1, rows)]))).where("url is not null").collect()
    assert sorted((r["url"], r["warc_type"]) for r in got) == [
        ("http://a", "response"), ("http://a", "response"), ("http://b", "response"), ("http://c", "response"), ("http://d", "revisit")]


def test_page_query_handles_odd_pages(spark, tmp_path):
    from lexicor.llm.queries import op4_arc_to_warc

    rows = [(3, "http://x/a b\n", "h" * 120), (1, None, "h" * 120), (1, "u", "h" * 120), (None, "u", "h" * 120), (7, "u", None), (8, "", ""),
            (9, "u", "é" * 60), (4, "u", "é" * 60), (11, "u", "é" * 40), (10, "u", "é" * 40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"])
                  for r in op4_arc_to_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(3, 120, "revisit", 1), (1, 120, "response", None), (1, 120, "response", None), (None, 120, "response", None),
                          (7, 0, "response", None), (8, 0, "response", None), (9, 120, "revisit", 4), (4, 120, "response", None),
                          (11, 80, "response", None), (10, 80, "response", None)], key=str)
