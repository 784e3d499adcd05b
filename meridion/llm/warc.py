"""WARC archives: a writer with revisits and a splittable reader (operator 11).

Method of the reader: a task is given a range of bytes of an archive.  It looks for the magic of a gzip member, decodes what
stands there and takes it for a member only if it inflates, with a right checksum, to a record with a WARC header and
all of its content; else the bytes were part of another member and the search goes on one byte later.  A task owns
the records whose member starts inside its range, and reads past the range's end to finish the last one.

Both sides use archives as they are: one record to a gzip member, which any WARC tool reads.  Files are opened in
tasks by their URI, in any store that pyarrow opens, in the folder that driver and executors share.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.session import ScratchTables, materialize, table

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 1000
#: A file is closed once it has so many bytes.
FILE_BYTES = 256 << 20
#: Bytes of an archive that one task scans.
RANGE_BYTES = 16 << 20
#: Payloads with at least this part of all rows are joined apart; there are no more of them than this number.
HOT_SHARE = 1024
DATE = "1970-01-01T00:00:00Z"

_MAGIC = b"\x1f\x8b\x08"
_WINDOW = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _line(text: str) -> str:
    """A header's value cannot hold line breaks or other controls; in a URI they are written by number."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in text)


def record_id(key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}/{key}')}>"


def member(kind: str, headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member."""
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(key: str | None, uri: str | None, payload: bytes, digest: str, size: int, original: str | None, revisits: bool, date: str, level: int) -> bytes:
    """A response with its payload, or a revisit of the one with the key ``original``; ``digest``: SHA-1 in hex."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", record_id(key or "", digest)), ("WARC-Date", date), ("Content-Type", "application/http;msgtype=response")]
    headers += [("WARC-Target-URI", _line(uri))] if uri is not None else []
    headers += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    headers += [("X-Page-Id", _line(key))] if key is not None else []
    if not revisits:
        return member("response", headers, http + payload, level)
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(original or "", digest))]
    headers += [("X-Refers-To-Page-Id", _line(original))] if original is not None else []
    return member("revisit", headers, http, level)


def _write(folder: str, file_bytes: int, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(folder)
        out, name, size, n = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["file", "bytes", "records"])

        for b in batches:
            for key, uri, payload, digest, length, original, revisits in zip(*(b.column(c).to_pylist() for c in ("key", "uri", "payload", "digest", "length", "original", "revisits")), strict=True):
                if out is None:  # a name of its own for each attempt, so that only files of finished tasks are known
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    raw = member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
                    size += out.write(raw) or len(raw)
                raw = page_record(key, uri, payload or b"", digest, length, original, revisits, date, level)
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def referred(rows: DataFrame, tables: ScratchTables, least_bytes: int) -> DataFrame:
    """``rows`` (id, payload, digest, length, ..) with ``newest``, the largest id of those with the same payload.

    It is null where the payload is short or in one row only.  Payloads of many rows are few and joined by themselves, so
    that no task gets all rows of one; which join the others take goes by the size of their written table.
    """
    large = rows.where(F.col("length") >= least_bytes).groupBy("digest").agg(F.max("id").alias("newest"), F.count("*").alias("copies"))
    groups = tables.put(large.where("copies > 1"))
    total = rows.agg(F.count("*").alias("n")).head()["n"]
    often = F.col("copies") * HOT_SHARE >= total
    hot = groups.where(often).select(F.col("digest").alias("hot_digest"), F.col("newest").alias("hot_newest"))
    long = F.col("length") >= least_bytes
    t = rows.join(F.broadcast(hot), long & (F.col("digest") == F.col("hot_digest")), "left")  # at most HOT_SHARE rows
    # Rows that need no partner get a key of their own, or they would all meet in one task.
    t = t.withColumn("_key", F.when(long & F.col("hot_digest").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "uri").cast("string"))))
    cold = groups.where(~often).select(F.col("digest").alias("_key"), "newest")
    return t.join(cold, "_key", "left").withColumn("newest", F.coalesce("hot_newest", "newest")).drop("_key", "hot_digest", "hot_newest")


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE, level: int = 6,
) -> DataFrame:
    """(file, bytes, records): archives with a record per row of ``pages``, written once, in ``folder``.

    Of rows with equal payloads of at least ``least_bytes`` that with the largest id is a response and the others are
    revisits of it; a null id is smaller than all others, and rows that share the largest id are all responses.  A null
    payload is empty, a null url leaves out the target URI; repeated rows are written each; an empty table gives no file;
    columns that are not named are not looked at.  One payload has to fit a task.
    """
    tables = ScratchTables(pages.sparkSession)
    folder = folder or f"{tables.root}/warc"
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})
    t = referred(rows, tables, least_bytes)
    grouped = F.col("newest").isNotNull() & ~F.col("id").eqNullSafe(F.col("newest"))
    t = t.select(F.col("id").cast("string").alias("key"), "uri", F.when(grouped, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", "length", F.col("newest").cast("string").alias("original"), grouped.alias("revisits"))
    return materialize(t.mapInArrow(_write(folder, file_bytes, date, level), "file string, bytes long, records long"))


class _Bytes:
    """A file by position, read in windows."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.window = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.window):
            self.at, self.window = at, self.file.read_at(min(max(n, _WINDOW), max(0, self.size - at)), at)
        return self.window[at - self.at : at - self.at + n]


def _inflate(source: _Bytes, at: int) -> tuple[bytes, int] | None:
    """What the gzip member at ``at`` holds and where it ends; nothing if there is none with a WARC record."""
    z, out, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        raw = source.read(pos, 1 << 12 if pos == at else 1 << 17)
        if not raw:
            return None
        try:
            out.append(z.decompress(raw))
        except zlib.error:
            return None
        pos += len(raw)
        if len(out) == 1 and out[0][:5] != b"WARC/"[: len(out[0])]:
            return None
    return b"".join(out), pos - len(z.unused_data)


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]] | None:
    """(headers by lower-case name, content) of the records in ``data``; nothing if it is not whole records."""
    found, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/" or end < 0:
            return None
        headers: dict[str, str] = {}
        last = ""
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if line[:1] in " \t" and last:
                headers[last] += " " + line.strip()
            elif colon:
                last = name.strip().lower()
                headers[last] = value.strip()
        length = headers.get("content-length", "")
        if not length.isdigit() or end + 8 + int(length) > len(data) or data[end + 4 + int(length) : end + 8 + int(length)] != b"\r\n\r\n":
            return None
        found.append((headers, data[end + 4 : end + 4 + int(length)]))
        at = end + 8 + int(length)
    return found


def records_in(source: _Bytes, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, content) of the records of members that start in ``[start, end)``."""
    at = start
    while at < end:
        seen = source.read(at, min(_WINDOW, end + len(_MAGIC) - 1 - at))
        k = seen.find(_MAGIC)
        if k < 0:
            at += max(1, len(seen) - len(_MAGIC) + 1)
            continue
        at += k
        whole = _inflate(source, at)
        records = parse_records(whole[0]) if whole else None
        if records:
            for headers, content in records:
                yield at, headers, content
            at = whole[1]
        else:
            at += 1


def _http(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = content.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, body


def _hex_digest(value: str) -> str | None:
    kind, _, text = value.partition(":")
    try:
        return base64.b32decode(text).hex() if kind.lower() == "sha1" and len(text) == 32 else text.lower() if kind.lower() == "sha1" else None
    except ValueError:
        return None


_FIELDS = [("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]


def _row(file: str, offset: int, headers: dict[str, str], content: bytes, payloads: bool) -> tuple:
    kind = headers.get("warc-type", "")
    http, body = _http(content) if headers.get("content-type", "").lower().startswith("application/http") else ({}, content)
    if kind == "revisit":  # it stands for a payload that is elsewhere
        length = http.get("content-length", "")
        return file, offset, kind, headers, int(length) if length.isdigit() else None, _hex_digest(headers.get("warc-payload-digest", "")), None
    return file, offset, kind, headers, len(body), hashlib.sha1(body).hexdigest(), body if payloads else None


def _read(payloads: bool):
    schema = pa.schema(_FIELDS)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, size, start, end in zip(*(b.column(c).to_pylist() for c in ("file", "bytes", "start", "end")), strict=True):
                fs, at = _open(file)
                rows, held = [], 0
                with fs.open_input_file(at) as f:
                    for offset, headers, content in records_in(_Bytes(f, size), start, end):
                        rows.append(_row(file, offset, headers, content, payloads))
                        held += len(content) if payloads else 0
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """(file, offset, record_type, headers, payload_bytes, payload_digest, payload): all records of ``files`` (file, bytes).

    ``headers`` are by lower-case name; ``payload`` is the body of an HTTP message, else the whole content.  Length and
    digest (SHA-1, hex) are taken from the payload; a revisit has none and gives those of the payload that it stands for.
    Bytes that are in no whole member are passed over.  A member that another one holds as it is, without packing it,
    looks like a record if a range begins inside: binary payloads may hold such, UTF-8 text cannot.  No files give no rows.
    """
    total = files.agg(F.sum("bytes")).head()[0] or 0
    ranges = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + range_bytes, F.col("bytes")))
    # Rows of ranges are small; their number, not their bytes, says how many tasks they need.
    tasks = max(1, total // range_bytes + 1, min(files.sparkSession.sparkContext.defaultParallelism, total // _WINDOW + 1))
    return ranges.repartition(int(tasks), "file", "start").mapInArrow(_read(payloads), "file string, offset long, record_type string, headers map<string, string>, payload_bytes long, payload_digest string, payload binary")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    number = lambda c: F.element_at("headers", c).cast("long")
    found = read_archives(files, payloads=False).where(F.col("record_type").isin("response", "revisit"))
    return found.select(number("x-page-id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("x-refers-to-page-id").alias("refers_to"))


OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, CASE WHEN strlen(html) >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY html) END AS newest FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN newest IS DISTINCT FROM page_id AND newest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN newest IS DISTINCT FROM page_id THEN newest END AS refers_to FROM m
"""
