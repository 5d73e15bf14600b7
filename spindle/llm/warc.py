"""WARC archives of pages: writing with revisit records, and reading with salvage of damaged files.

Writing: each task writes files of gzip members, one record per member, below a fresh folder of the shared
checkpoint folder. A task that runs twice writes other file names, and only files listed in the manifest that Spark committed
are read. Reading: a record must decompress, begin with a version line, have the promised length and, if it
says so, the promised payload digest. Otherwise the reader looks for the next gzip member or version line that
begins a valid record, goes on there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import table
from spindle.session import materialize, scratch_path

FILE_BYTES = 16 << 20  # a file is closed once it has so many bytes
REVISIT_BYTES = 1000  # fixed value: payloads from this size on are written once
BROADCAST_ROWS = 100_000  # response digests shared by several pages, above which they are joined by shuffle
SALT = 16

_VERSION = b"WARC/1."
_FIRST_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


def record_bytes(kind: str, uri: str, record_id: str, payload: bytes, digest: str, refers_to: str | None,
                 full_bytes: int) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", uri)), ("Content-Type", "text/html; charset=utf-8"),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(full_bytes))]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(payload))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode("utf-8", "replace") + payload + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse_plain(data: bytes, at: int) -> tuple[Record, int]:
    """The record that begins at ``at`` and the offset behind it; ``ValueError`` if it fails a check."""
    if data[at:at + len(_VERSION)] != _VERSION:
        raise ValueError("no version line")
    first = _FIRST_LINE.match(data, at)
    if not first:
        raise ValueError("unknown version")
    headers, start = {}, first.end()
    while True:  # line by line: a header may be as long as its record, but the first line that is none ends the search
        end = data.find(b"\r\n", start)
        if end < 0:
            raise ValueError("header does not end")
        if end == start:
            break
        k, sep, v = data[start:end].partition(b":")
        if not sep or _MAGIC in v:
            raise ValueError("header line without colon" if not sep else "header runs into a member")
        name = k.decode("utf-8", "replace").strip().lower()
        if name in headers and name != "warc-concurrent-to":  # two headers run into each other
            raise ValueError("header repeats")
        headers[name] = v.decode("utf-8", "replace").strip()
        start = end + 2
    if not headers.get("content-length", "").isdecimal() or "warc-type" not in headers:
        raise ValueError("missing header")
    size = int(headers["content-length"])
    payload = data[end + 2:end + 2 + size]
    stop = end + 2 + size
    if len(payload) < size or data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError("length does not hold")
    kind, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if kind == "sha1" and headers["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("payload digest does not hold")
    return Record(at, headers, payload), stop + 4


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Valid records of an archive, plain or gzip by record, and the gaps between them, in file order."""
    at, gap, why = 0, None, ""
    size = len(data)
    ahead = {_MAGIC: -1, _VERSION: -1}  # the next place of each mark behind ``at``, looked for once it has been passed
    while at < size:
        try:
            if data[at:at + 3] == _MAGIC:
                found, nxt = _read_member(data, at)
            else:
                record, nxt = parse_plain(data, at)
                found = [record]
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            for mark, p in ahead.items():
                if p <= at:
                    p = data.find(mark, at + 1)
                    ahead[mark] = p if p >= 0 else size
            at = min(ahead.values())
            continue
        if gap is not None:
            yield Gap(gap, at - gap, why)
            gap = None
        yield from found
        at = nxt
    if gap is not None:
        yield Gap(gap, size - gap, why)


def _read_member(data: bytes, at: int) -> tuple[list[Record], int]:
    """All records of the gzip member at ``at``; its bytes are fed in steps, so only the member is inflated."""
    d = zlib.decompressobj(31)
    out, p, step = [], at, 512  # most bytes that only look like a member fail at once
    try:
        while not d.eof and p < len(data):
            out.append(d.decompress(data[p:p + step]))
            p, step = p + step, min(2 * step, 65_536)
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    if not d.eof:
        raise ValueError("gzip member does not end")
    end = min(p, len(data)) - len(d.unused_data)
    plain, records, k = b"".join(out), [], 0
    while k < len(plain):
        r, k = parse_plain(plain, k)
        r.offset = at
        records.append(r)
    if not records:
        raise ValueError("empty gzip member")
    return records, end


def mark_revisits(pages: DataFrame, id_col: str, payload: str, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``payload_bytes``, ``payload_digest`` and ``refers_to`` (of equal payloads of at least ``min_bytes``,
    the largest id; NULL for that one and all others). Digests are counted with partial sums; only those
    shared by several rows are joined back: broadcast below a counted bound, else by salted shuffle."""
    rows = pages.withColumn(payload, F.coalesce(payload, F.lit(""))).withColumns({
        "payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha1(payload)})
    shared = (rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
              .agg(F.max(id_col).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    shared = materialize(shared, "warc-shared")
    if shared.count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(shared), "payload_digest", "left")
    else:
        salted = shared.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = rows.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(SALT)).cast("int")).join(
            salted, ["payload_digest", "__salt"], "left").drop("__salt")
    return out.withColumn("refers_to", F.when(F.col("__first") != F.col(id_col), F.col("__first"))).drop("__first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri: str = "url",
                   payload: str = "html") -> DataFrame:
    """Writes one record per row below ``folder`` and returns the manifest (path, bytes, records).

    NULL payloads are empty payloads, NULL ids and addresses are written as empty text. Rows equal in all
    columns are separate records. An empty table has an empty manifest.
    """
    marked = mark_revisits(pages.select(id_col, uri, payload), id_col, payload)

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        out, done = None, []
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, size, n = fs.open_output_stream(path, compression=None), 0, 0
                data = r[payload].encode()
                again = r["refers_to"] is not None
                m = gzip_member(record_bytes(
                    "revisit" if again else "response", r[uri] or "", f"urn:page:{'' if r[id_col] is None else r[id_col]}",
                    b"" if again else data, r["payload_digest"], f"urn:page:{r['refers_to']}" if again else None, len(data)))
                out.write(m)
                size += len(m)
                n += 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "bytes": [x[1] for x in done],
                                          "records": [x[2] for x in done]},
                                         schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return materialize(marked.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Records (path, offset, type, id, uri, digest, full length, refers_to, payload) and quarantined gaps
    (path, offset, length, reason) of the files of a manifest. A file is one task's work; damaged parts are skipped and logged."""
    schema = ("path string, offset long, gap_bytes long, reason string, record_type string, record_id string, uri string,"
              " payload_digest string, payload_bytes long, refers_to string, payload binary")

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs

        fs, _ = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        kinds = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("gap_bytes", pa.int64()), ("reason", pa.string()),
                           ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()),
                           ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()),
                           ("payload", pa.binary())])
        for b in batches:
            for path in b.column("path").to_pylist():
                with fs.open_input_file(path) as f:
                    data = f.read()
                rows, size = [], 0
                for x in salvage(data):
                    if isinstance(x, Gap):
                        rows.append({"path": path, "offset": x.offset, "gap_bytes": x.length, "reason": x.reason})
                    else:
                        h = x.headers
                        rows.append({"path": path, "offset": x.offset, "record_type": h["warc-type"],
                                     "record_id": h.get("warc-record-id", "").strip("<>"), "uri": h.get("warc-target-uri"),
                                     "payload_digest": h.get("warc-payload-digest", "").partition(":")[2],
                                     "payload_bytes": int(h.get("x-payload-length") or len(x.payload)),
                                     "refers_to": h.get("warc-refers-to", "").strip("<>") or None, "payload": x.payload})
                        size += len(x.payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    tasks = manifest.sparkSession.sparkContext.defaultParallelism + manifest.count() // 8
    found = manifest.select("path").repartition(tasks).mapInArrow(run, schema)
    return (found.where("gap_bytes IS NULL").drop("gap_bytes", "reason"),
            found.where("gap_bytes IS NOT NULL").select("path", "offset", F.col("gap_bytes").alias("length"), "reason"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    records, _ = read_archives(manifest, folder)
    number = lambda c: F.expr(f"try_cast(replace({c}, 'urn:page:', '') AS bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          number("refers_to").alias("refers_to"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
