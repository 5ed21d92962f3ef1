import base64
import datetime as dt
import gzip
import hashlib
import io
import random


from loginlens.llm import queries, warc
from loginlens.session import run_dir

from .conftest import SF

STAMP = dt.datetime(2024, 5, 1, 12)
PAGE = "page_id long, url string, html string, key string, sha string, at int"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, least_bytes=0):
    """(page, bytes, digest, type, refers to) of (page_id, html) rows."""
    best = {}
    for page, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if page is None else page)
    out, served = [], set()
    for page, html in sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True):
        data = (html or "").encode()
        again = len(data) >= least_bytes and (html or "") in served
        served.add(html or "")
        kept = best[html or ""]
        out.append((page, len(data), digest(data), "revisit" if again else "response", kept if again and kept >= 0 else None))
    return sorted(out, key=repr)


def written(spark, rows, **options):
    frame = spark.createDataFrame([(p, u, h, "k", "s", 1) for p, u, h in rows], PAGE)
    return warc.write_archives(frame, run_dir(spark, "warc"), date=STAMP, **options)


def results(spark, manifest):
    captures = warc.assemble(warc.read_records(manifest))
    return captures, sorted((tuple(r) for r in queries.pages_of(captures).collect()), key=repr)


def raw(*records):
    return io.BytesIO(b"".join(records))


def test_query_equals_plain_python(spark):
    want = expected([tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()])
    got = queries.op13_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_odd_pages_and_round_trip(spark):
    rows = [(1, "http://a.example/x?y=1", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "", None), (4, "http://b.example/", ""),
            (None, "http://c.example/", "<p>one</p>"), (None, "http://d.example/", "only null"), (None, "x", "only null"),
            (5, "bad\r\nWARC-Type: response", "\r\n\r\nHTTP/1.1 404\r\n\r\n"), (6, "http://[broken", "ÄÖ "),
            (7, "http://l.example/", "long " * 400_000), (1, "http://a.example/again", "<p>one</p>"), (8, "http://e.example/", "\x00")]
    captures, got = results(spark, written(spark, rows, max_bytes=2_000))
    assert got == expected([(p, h) for p, _, h in rows])
    kept = {bytes(r.payload).decode() for r in captures.where("capture.type = 'response'").select("capture.payload").collect()}
    assert kept == {h or "" for _, _, h in rows}
    sizes = captures.selectExpr("size(requests) AS q", "size(metadata) AS m", "capture IS NULL AS none").distinct().collect()
    assert [tuple(s) for s in sizes] == [(1, 1, False)]
    assert captures.where("capture.target_uri = 'bad%0D%0AWARC-Type: response'").count() == 1
    assert results(spark, written(spark, []))[1] == []


def test_short_payloads_are_no_revisits(spark):
    rows = [(i, "u", h) for i, h in enumerate(["", "", "abc", "abc", "abcd", "abcd", "é", "é"])]
    assert results(spark, written(spark, rows, least_bytes=4))[1] == expected([(p, h) for p, _, h in rows], 4)


def test_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_ROWS", 20)
    rng = random.Random(2)
    rows = [(i, "u", rng.choice(["same", "same", f"own {i}", f"few {i % 50}"])) for i in range(600)]
    assert results(spark, written(spark, rows))[1] == expected([(p, h) for p, _, h in rows])


def test_files_are_plain_warc(spark):
    manifest = written(spark, [(1, "http://a.example/p", "<p>x</p>"), (2, "http://a.example/q", "<p>x</p>")]).collect()
    text = b"".join(gzip.open(m.path.replace("file:", "")).read() for m in manifest).decode()
    assert text.count("WARC/1.1\r\n") == 6 + len(manifest) and sum(m.n_records for m in manifest) == 6 + len(manifest)
    assert "WARC-Type: revisit" in text and f"WARC-Payload-Digest: sha1:{digest(b'<p>x</p>')}" in text
    assert text.count("<p>x</p>") == 1 and "GET /p HTTP/1.1\r\nHost: a.example" in text


def test_parsing_of_foreign_and_broken_records():
    def one(block, *lines):
        return "\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    good = one(b"HTTP/1.1 404 Gone\r\nX: a\r\n b\r\n\r\nbody", "warc-type: response", "WARC-RECORD-ID: <a>",
               "Content-Type: application/http;msgtype=response", "WARC-Concurrent-To: <b>", "WARC-Concurrent-To: <c>")
    rows = list(warc.parse_records(raw(good, b"noise\r\nmore noise\r\n", one(b"x"), b"WARC/1.0\r\nContent-Length: -4\r\n\r\n", good)))
    assert [r["problem"] for r in rows] == [None, "no record begins here", None, "no valid length", None]
    assert rows[0]["payload"] == b"body" and rows[0]["http_status"] == 404 and rows[0]["http_headers"] == [("x", "a b")]
    assert rows[0]["concurrent_to"] == ["<b>", "<c>"] and rows[2]["payload"] == b"x" and rows[2]["record_id"] is None
    assert [r["problem"] for r in warc.parse_records(raw(good, good[:-20]))] == [None, "the block is cut off"]
    packed = gzip.compress(good)
    assert len(list(warc.parse_records(raw(packed, packed)))) == 2
    assert "unreadable" in list(warc.parse_records(raw(packed, packed[:-30])))[-1]["problem"]
    assert list(warc.parse_records(raw())) == [] and list(warc.parse_records(raw(b"\r\n\r\n"))) == []


def test_assembly_over_links(spark):
    """Links in both directions, over other records, to two captures, to nothing; repeated and missing ids."""
    def row(path, number, identity, kind, *names):
        return (path, number, identity, kind, list(names))
    rows = [row("a", 0, "r1", "response"), row("a", 1, "q1", "request", "r1"), row("a", 2, "m1", "metadata", "q1"),
            row("a", 3, "m2", "metadata", "m1"), row("b", 0, "r2", "response", "q2"), row("b", 1, "q2", "request"),
            row("b", 2, None, "metadata", "r2"), row("c", 0, "q3", "request", "nowhere"), row("c", 1, "m3", "metadata", "q3"),
            row("c", 2, "m4", "metadata", "r2", "r1"), row("d", 0, "r1", "response"), row("d", 1, "q1", "request", "r1"),
            row("e", 0, "w", "warcinfo"), row("e", 1, None, "resource"), row("e", 2, "m5", "metadata", "m5"), row("e", 3, None, None)]
    frame = spark.createDataFrame(rows, "path string, number long, record_id string, type string, concurrent_to array<string>")
    frame = frame.selectExpr("*", "CAST(NULL AS string) AS problem", "map('k', record_id) AS fields")
    got = {(tuple(r.at), r.capture and r.capture.record_id, tuple(x.record_id for x in r.requests), tuple(x.record_id for x in r.metadata))
           for r in warc.assemble(frame).collect()}
    assert got == {(("a", 0), "r1", ("q1",), ("m1", "m2", "m4")), (("b", 0), "r2", ("q2",), (None,)), (("c", 0), None, ("q3",), ()),
                   (("c", 1), None, (), ("m3",)), (("e", 1), None, (), ()), (("e", 2), None, (), ("m5",))}
    assert warc.assemble(frame.limit(0)).count() == 0


def test_archives_are_found_by_folder(spark):
    root = run_dir(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "x", "k", "s", 1)], PAGE), root)
    records = warc.read_records(warc.archive_paths(spark, root))
    assert sorted(r.type for r in records.collect()) == ["metadata", "request", "response", "warcinfo"]
    assert records.where("payload_bytes IS NOT NULL").count() == 4
    assert warc.read_records(warc.archive_paths(spark, root), payload=False).where("payload IS NOT NULL").count() == 0
