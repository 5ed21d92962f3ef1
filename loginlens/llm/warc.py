"""WARC archives: writing pages, reading records, and joining records to captures.

Writing: a page becomes three records, a response with the page as payload, a
request and a metadata record, the latter two naming the response in
WARC-Concurrent-To. Of pages with equal payloads of at least `least_bytes` bytes, the
one with the largest `page_id` is the response; the others are revisits that name it
in WARC-Refers-To and carry no payload. Every record is a gzip member of its own, and
files are closed at `max_bytes`. Record ids are derived from the row, so a revisit can
name a response that another task writes, and a repeated task writes the same ids into
files of new names; the manifest lists the files that count.

Reading: one row per record, read in a stream, from gzip members or plain text.
Payloads are what follows the HTTP headers, or the block of records of other kinds.

Assembly: records are joined through concurrent-to identifiers, in either direction.
Responses, revisits and resources are captures. A record that names, or is named by, a
capture belongs to it; one that reaches a capture over other records belongs to the
capture it reaches in the fewest steps, ties to the smallest place (path, number).
Records are read from the archives once and kept as a table meanwhile. One nested row
per capture holds its record, its requests and its metadata; all records of a capture
meet in that row, so its size is theirs. A request or metadata record that reaches no
capture gets a row without one. Payloads are shuffled once at most.

Joins with one hot key (one payload, one response that many revisits name) are split:
keys above a 1024th of the rows, and a thousand, are at most 1024 and are broadcast.

Cases: a null page is an empty payload. Null ids come last among equal payloads and
are written without a page-id. Pages of one id and payload are told apart by row: one
is the response and the rest revisit it. Null or empty addresses give records without
a target; line breaks in addresses are percent-encoded. Records of one id count once
in assembly (the first by path and number); records without an id can name others only.
Text that is no record, bad lengths and cut-off files come back as rows with a
`problem` and are no captures. Empty tables give empty results. Other columns of pages
are not read. A block must fit into memory.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlens.llm.common import small_batches, with_row_id
from loginlens.session import discard, durable

MAX_BYTES = 128 << 20
#: Bytes read at once; what follows a gzip member is copied per member, so few.
CHUNK = 32 << 10
HOT_ROWS, HOT_SHARE = 1_000, 1_024
#: Rows handed on at once, by number and by bytes of payload.
ROWS, BYTES = 2_000, 8 << 20

CAPTURES = ("response", "revisit", "resource")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
FIELDS = [("path", pa.string()), ("number", pa.int64()), ("record_id", pa.string()), ("type", pa.string()),
          ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()),
          ("date", pa.string()), ("content_type", pa.string()), ("http_status", pa.int32()),
          ("http_headers", pa.map_(pa.string(), pa.string())), ("fields", pa.map_(pa.string(), pa.string())),
          ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())]
RECORDS = ("path string, number long, record_id string, type string, concurrent_to array<string>, refers_to string, "
           "target_uri string, date string, content_type string, http_status int, http_headers map<string,string>, "
           "fields map<string,string>, payload_bytes long, payload_digest string, payload binary, problem string")


# ---- writing

def write_archives(pages: DataFrame, root: str, least_bytes: int = 0, max_bytes: int = MAX_BYTES,
                   date: dt.datetime | None = None) -> DataFrame:
    """Write `page_id, url, html` below `root`; returns the manifest (path, n_records, n_bytes)."""
    small_batches(pages.sparkSession)
    stamp = (date or dt.datetime.now(dt.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"), *_metadata(pages))
    rows = with_row_id(source).withColumn("key", F.struct(
        F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("h")))
    light = durable(rows.select("key", F.struct("page_id", "_row").alias("page")))
    groups = light.where(F.col("key.size") >= least_bytes).groupBy("key").agg(F.max("page").alias("kept"), F.count("*").alias("n"))
    known = join_unique(rows, durable(groups.where("n > 1").select("key", "kept")), "key", counted=light)
    kept = F.when(F.col("kept._row") != F.col("_row"), F.col("kept._row"))
    written = known.select("page_id", "url", "payload", F.col("_row.file").alias("file"), F.col("_row.at").alias("at"),
                           F.col("key.sha").alias("sha"), kept["file"].alias("kept_file"), kept["at"].alias("kept_at"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Files(root, max_bytes, stamp)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                out.add(_page_records(*row, stamp))
        done = out.close()
        if done:
            yield pa.RecordBatch.from_pydict({n: pa.array([d[i] for d in done], t) for i, (n, t) in enumerate(
                [("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])})

    return durable(written.mapInArrow(write, MANIFEST))


def _metadata(df: DataFrame) -> list[str]:
    try:
        df.select("_metadata.row_index")
    except Exception:  # not a file scan
        return []
    return ["_metadata"]


class _Files:
    """Archive files of one task, opened when there is something to write."""

    def __init__(self, root: str, max_bytes: int, stamp: str) -> None:
        self.root, self.max_bytes, self.stamp = root, max_bytes, stamp
        self.stream, self.done = None, []

    def add(self, records: list[bytes]) -> None:
        if self.stream is None:
            from pyarrow import fs

            store, folder = fs.FileSystem.from_uri(self.root)
            store.create_dir(folder, recursive=True)
            self.name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
            self.stream, self.records, self.bytes = store.open_output_stream(f"{folder}/{self.name}", compression=None), 0, 0
            records = [record("warcinfo", record_id(self.name), self.stamp, b"software: loginlens\r\n",
                              [("Content-Type", "application/warc-fields")]), *records]
        for raw in records:
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = packer.compress(raw) + packer.flush()
            self.stream.write(member)
            self.bytes += len(member)
        self.records += len(records)
        if self.bytes >= self.max_bytes:
            self.close()

    def close(self) -> list[tuple]:
        if self.stream is not None:
            self.stream.close()
            self.done.append((f"{self.root}/{self.name}", self.records, self.bytes))
            self.stream = None
        return self.done


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('/'.join(map(str, parts)).encode()).digest())}>"


def record(kind: str, identity: str, stamp: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identity}", f"WARC-Date: {stamp}",
             *[f"{name}: {value}" for name, value in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_records(page_id: int | None, url: str | None, payload: bytes, file: int, at: int, sha: str,
                  kept_file: int | None, kept_at: int | None, stamp: str) -> list[bytes]:
    own = record_id(file, at, "response")
    safe = (url or "").strip().replace("\r", "%0D").replace("\n", "%0A")
    target = [("WARC-Target-URI", safe)] if safe else []
    digest = [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha)).decode())]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    answer = [("Content-Type", "application/http; msgtype=response"), *target, *digest]
    if kept_at is None:
        main = record("response", own, stamp, http + payload, answer)
    else:
        main = record("revisit", own, stamp, http, [*answer, ("WARC-Profile", PROFILE),
                                                   ("WARC-Refers-To", record_id(kept_file, kept_at, "response"))])
    together = [*target, ("WARC-Concurrent-To", own)]
    try:
        parts = urlsplit(safe)
        place, host = (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), parts.netloc
    except ValueError:  # not an address
        place, host = "/", ""
    asked = f"GET {place} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    about = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    return [main, record("request", record_id(file, at, "request"), stamp, asked,
                         [("Content-Type", "application/http; msgtype=request"), *together]),
            record("metadata", record_id(file, at, "metadata"), stamp, about, [("Content-Type", "application/warc-fields"), *together])]


# ---- reading

def archive_paths(spark: SparkSession, location: str) -> DataFrame:
    """`path` of every archive below a folder or matched by a pattern; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
    return found.where(F.col("path").rlike(r"\.warc(\.gz)?$")).select("path")


def read_records(paths: DataFrame, payload: bool = True) -> DataFrame:
    """One row per record of the archives in `path`; without payloads unless they are asked for.

    `payload_bytes` and `payload_digest` (bare base32 SHA-1) are those of the whole payload: taken
    from what was read, or for a revisit from its headers.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                # Spark lists local files under a URI of one slash, which from_uri does not know.
                store, name = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
                held, size = [], 0
                with store.open_input_stream(name, compression=None) as raw:
                    for number, row in enumerate(parse_records(raw)):
                        size += len(row["payload"] or b"")
                        if not payload:
                            row["payload"] = None
                        held.append({"path": path, "number": number, **row})
                        if len(held) >= ROWS or payload and size >= BYTES:
                            yield _as_batch(held)
                            held, size = [], 0
                if held:
                    yield _as_batch(held)

    files = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(files, "path").mapInArrow(read, RECORDS)


def _as_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in FIELDS], [n for n, _ in FIELDS])


class Inflated(io.RawIOBase):
    """The bytes of a stream, gzip members unpacked one after another; plain streams as they are."""

    def __init__(self, raw) -> None:
        self.raw, self.packed, self.member, self.rest, self.out = raw, None, None, b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.out:
            rest = self.rest or self.raw.read(CHUNK)
            self.rest = b""
            if not rest:
                if self.member is not None:
                    raise EOFError("a gzip member is cut off")
                return 0
            if self.packed is None:
                self.packed = rest[:2] == b"\x1f\x8b"
            if not self.packed:
                self.out = rest
                break
            if self.member is None:
                self.member = zlib.decompressobj(31)
            self.out = self.member.decompress(rest)
            if self.member.eof:
                self.rest, self.member = self.member.unused_data, None
        n = min(len(into), len(self.out))
        into[:n], self.out = self.out[:n], self.out[n:]
        return n


def parse_records(raw) -> Iterator[dict]:
    """The records of one archive, as dictionaries of FIELDS without path and number."""
    stream = io.BufferedReader(Inflated(raw), 1 << 16)
    lost = False
    while True:
        try:
            line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                if line.strip() and not lost:
                    lost = True
                    yield _broken("no record begins here")
                continue
            lost = False
            headers = _headers(stream)
            first = dict(reversed(headers))
            length = first.get("content-length", "")
            if not (length.isascii() and length.isdigit()):
                lost = True
                yield _broken("no valid length", first)
                continue
            block = stream.read(int(length))
            if len(block) < int(length):
                yield _broken("the block is cut off", first)
                return
            yield _parsed(headers, first, block)
        except (EOFError, zlib.error, OSError) as e:
            yield _broken(f"unreadable from here: {e}")
            return


def _broken(problem: str, first: dict[str, str] | None = None) -> dict:
    first = first or {}
    return {"record_id": first.get("warc-record-id"), "type": first.get("warc-type"), "payload": None, "problem": problem}


def _headers(stream) -> list[tuple[str, str]]:
    """Lower-cased names and values up to the empty line; folded lines are joined."""
    found: list[tuple[str, str]] = []
    while line := stream.readline().rstrip(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {text.strip()}")
        elif ":" in text:
            name, value = text.split(":", 1)
            found.append((name.strip().lower(), value.strip()))
    return found


def _parsed(headers: list[tuple[str, str]], first: dict[str, str], block: bytes) -> dict:
    kind, content = first.get("warc-type"), first.get("content-type", "")
    payload, status, http, fields, claimed = block, None, None, None, None
    if content.lower().startswith("application/http"):
        head, gap, body = block.partition(b"\r\n\r\n")
        start, _, rest = head.partition(b"\r\n")
        http = dict(reversed(_headers(io.BytesIO(rest + b"\r\n\r\n"))))
        payload, word = (body if gap else b""), start.split(b" ")
        status = int(word[1]) if start.startswith(b"HTTP/") and len(word) > 1 and word[1].isdigit() and len(word[1]) < 9 else None
        claimed = http.get("content-length")
    elif content.lower().startswith("application/warc-fields"):
        fields = dict(reversed(_headers(io.BytesIO(block + b"\r\n\r\n"))))
    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind == "revisit":
        named = first.get("warc-payload-digest", "")
        digest = named[5:].upper() if named.lower().startswith("sha1:") else None
        size = int(claimed) if claimed and claimed.isascii() and claimed.isdigit() and len(claimed) < 19 else None
    return {"record_id": first.get("warc-record-id"), "type": kind,
            "concurrent_to": [v for n, v in headers if n == "warc-concurrent-to"], "refers_to": first.get("warc-refers-to"),
            "target_uri": first.get("warc-target-uri"), "date": first.get("warc-date"), "content_type": content or None,
            "http_status": status, "http_headers": None if http is None else list(http.items()),
            "fields": None if fields is None else list(fields.items()), "payload_bytes": size, "payload_digest": digest,
            "payload": payload, "problem": None}


# ---- assembly

def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: `capture` (its record, with `at`), `requests` and `metadata` (arrays of theirs, by place)."""
    place = F.struct("path", "number").alias("at")
    records = durable(records)  # archives are read once
    whole = records.where(F.col("problem").isNull()).select(
        place, "type", F.struct(*[c for c in records.columns if c != "problem"]).alias("record"))
    light = durable(whole.select("at", "type", F.col("record.record_id").alias("id"), F.col("record.concurrent_to").alias("names")))
    by_id = durable(light.where("id IS NOT NULL").groupBy("id").agg(F.min("at").alias("target"), F.count("*").alias("n")))
    repeated = by_id.where("n > 1").select(F.col("id").alias("same"), "target")
    gone = durable(light.join(repeated, (F.col("id") == F.col("same")) & (F.col("at") != F.col("target"))).select("at"))
    firsts = light.join(gone, "at", "left_anti")
    owners = _owners(firsts, by_id.select("id", "target"))
    main = whole.where(F.col("type").isin(*CAPTURES)).join(gone, "at", "left_anti").select("at", F.col("record").alias("main"))
    # A record that belongs to nothing stands for itself.
    mine = firsts.where(F.col("type").isin("request", "metadata")).select("at").join(owners, "at", "left").select(
        "at", F.coalesce("owner", "at").alias("owner"))
    by_place = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    group = {kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("at", "record"))), by_place),
                               lambda m: m["record"]) for kind in ("request", "metadata")}
    others = whole.where(F.col("type").isin("request", "metadata")).join(mine, "at").groupBy("owner").agg(
        group["request"].alias("requests"), group["metadata"].alias("metadata"))
    none = F.array().cast(others.schema["requests"].dataType)
    return main.join(others, F.col("at") == F.col("owner"), "full").select(
        F.coalesce("at", "owner").alias("at"), F.col("main").alias("capture"),
        F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))


def _owners(firsts: DataFrame, by_id: DataFrame) -> DataFrame:
    """`at, owner`: the capture of every other record that reaches one, a step further in each round."""
    named = join_unique(firsts.select("at", F.explode("names").alias("id")), by_id, "id").where(
        F.col("target").isNotNull() & (F.col("target") != F.col("at"))).select("at", "target")
    links = durable(named.union(named.select(F.col("target"), F.col("at"))).distinct())
    is_capture = F.coalesce(F.col("type").isin(*CAPTURES), F.lit(False))
    fresh = firsts.where(is_capture).select("at", F.col("at").alias("owner"))
    waiting = durable(firsts.where(~is_capture).join(links.select("at"), "at", "left_semi").select("at"))
    owners = fresh.limit(0)
    while not waiting.isEmpty():
        near = links.join(waiting, "at", "left_semi")
        step = durable(near.join(fresh.select(F.col("at").alias("target"), "owner"), "target").groupBy("at").agg(
            F.min("owner").alias("owner")))
        if step.isEmpty():
            break
        owners, fresh = owners.unionByName(step), step
        done, waiting = waiting, durable(waiting.join(step, "at", "left_anti"))
        discard(done)
    return owners


def join_unique(left: DataFrame, right: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """`left` with the columns of `right`, which has one row a key, or nulls; hot keys of `left` are not shuffled.

    `counted` is a cheaper table with the same keys as `left`, if there is one.
    """
    sizes = (left if counted is None else counted).groupBy(key).agg(F.count("*").alias("rows"))
    sizes = durable(sizes.where(F.col("rows") > HOT_ROWS))
    if not sizes.isEmpty():
        total = (left if counted is None else counted).count()
        hot = sizes.where(F.col("rows") > total // HOT_SHARE).select(key)  # HOT_SHARE keys at most
        few = durable(right.join(F.broadcast(hot), key, "left_semi"))
        rest = left.join(F.broadcast(few.select(key)), key, "left_anti").join(right, key, "left")
        return left.join(F.broadcast(few), key).unionByName(rest)
    return left.join(right, key, "left")


ORACLE = """
WITH held AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS r FROM pages),
ordered AS (
    SELECT page_id, html, sha1(html) AS h,
           row_number() OVER w AS nth, first_value(page_id) OVER w AS kept
    FROM held WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, r))
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN kept END AS refers_to
FROM ordered
"""
