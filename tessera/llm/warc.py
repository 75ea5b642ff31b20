"""WARC archives with a two-level capture index.

Writing: every row becomes a record in its own gzip member. Of records with equal payloads of at least
``min_payload`` bytes, that with the largest id is the response and the others are revisits, which carry the
response's id and the payload's digest and HTTP header but no payload. Each task writes one archive in the
shared folder under a name of its own and returns where its records lie; only archives of tasks that ended
well are in that list, which is itself written.

Index: lines of (reversed-host URL key, id, archive, offset, length), range-partitioned and sorted by key,
in compressed blocks; and a sparse directory with the first key and the place of each block. A lookup
searches the directory by halves, reads one block by its range (or its neighbours, if a key runs on), searches
its lines by halves, and reads the record by its range. :func:`lookup` does so for a few URLs on the driver, and
:func:`seek` for a table of URLs of any size: tasks search the directory, each block that is wanted is read once by
the task that its keys were dealt to (so a key with many captures is many tasks), and lines go to the records' ranges,
archive by archive. :func:`read_all` walks the index without keys.

Defined cases: a null payload is empty; a null URL has the key ``-`` and no target header. Ids may repeat (each
row has its record; rows with the response's own id are responses). A null id is written and read as null, is never
referred to, and equal payloads that have null ids only are all responses. Payloads under ``min_payload`` bytes are all responses. An
empty table gives no archive and an empty index. Columns other than the named ones are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_dir

INDEX_DDL = "key string, id long, archive string, offset long, length long"
DIRECTORY_DDL = "first_key string, last_key string, block_file string, offset long, length long, n_lines int"


@dataclass
class Archive:
    """What a written archive consists of: its folder, and the directory of its index as a DataFrame."""

    folder: str
    directory: DataFrame


def url_key(url: str | None) -> str:
    """The URL with its host reversed, lower-cased, without scheme, leading www. and default port: ``com,example)/path?query``."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url if "://" in url else "http://" + url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url
    if host.startswith("www."):
        host = host[4:]
    at = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + at + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record_bytes(rid: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with a response record, or a revisit record if ``refers_to`` is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if rid is None else rid}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> dict:
    """id, type, url, refers_to, digest (hex, of the payload that the record holds, else as stated), payload_bytes, payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    stated = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    name = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
    number = lambda x: None if name(x) == "null" else int(name(x))
    refers = fields.get("WARC-Refers-To")
    return {"id": number(fields["WARC-Record-ID"]), "type": kind, "url": fields.get("WARC-Target-URI"), "refers_to": number(refers) if refers else None, "digest": stated, "payload_bytes": length, "payload": payload if kind == "response" else None}


def _open(path: str):
    fs, p = pfs.FileSystem.from_uri(path)
    return fs, p


def read_range(path: str, offset: int, length: int) -> bytes:
    fs, p = _open(path)
    with fs.open_input_file(p) as f:
        return f.read_at(length, offset)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 1000, lines_per_block: int = 3000) -> Archive:
    """Writes the archives and their index below the shared folder."""
    spark = pages.sparkSession
    folder = fresh_dir(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    digest = F.when(F.length("payload") >= min_payload, F.unhex(F.sha1("payload")))
    # of each payload met twice or more, the response's id; ids and digests alone are shuffled for it
    short = rows.select("id", digest.alias("digest")).filter("digest IS NOT NULL")
    shared = short.groupBy("digest").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # rows without a digest get an 8-byte key of their own that no digest equals, so that they are not one key
    alone = F.unhex(F.lpad(F.hex(F.xxhash64("id", "url", "payload")), 16, "0"))
    marked = rows.withColumn("digest", F.coalesce(digest, alone)).join(shared, "digest", "left").select("id", "url", "payload", "response")

    def save(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for b in batches:
                lines = []
                for i, url, payload, response in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    member = record_bytes(i, url, payload, response if response != i else None)
                    out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    lines.append((url_key(url), i, name, at, len(member)))
                    at += len(member)
                cols = list(zip(*lines, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "id", "archive", "offset", "length"])
        finally:
            if out:
                out.close()

    lines = cut(marked.mapInArrow(save, INDEX_DDL), "warc-lines")

    def blocks(batches):
        fs, base = _open(folder)
        name, at, out, held = f"{uuid.uuid4().hex}.index", 0, None, []

        def put():
            nonlocal at, out
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode())
            out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
            out.write(data)
            row = (held[0][0], held[-1][0], name, at, len(data), len(held))
            at += len(data)
            held.clear()
            return row

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["first_key", "last_key", "block_file", "offset", "length", "n_lines"])

        try:
            for b in batches:
                rows = []
                for line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.append(line)
                    if len(held) >= lines_per_block:
                        rows.append(put())
                if rows:
                    yield batch(rows)
            if held:
                yield batch([put()])
        finally:
            if out:
                out.close()

    parts = max(1, lines.rdd.getNumPartitions() // 8)
    ordered = lines.repartitionByRange(parts, "key", "id", "archive", "offset").sortWithinPartitions("key", "id", "archive", "offset")
    return Archive(folder, cut(ordered.mapInArrow(blocks, DIRECTORY_DDL), "warc-directory"))


def _block(folder: str, entry) -> list[list]:
    raw = zlib.decompress(read_range(f"{folder}/{entry['block_file']}", entry["offset"], entry["length"]))
    return [json.loads(x) for x in raw.decode().split("\n")]


def lookup(archive: Archive, urls: list[str]) -> list[dict]:
    """The records of some URLs, by key and id: directory search, one block read for each key, range reads.

    The directory (one row for ``lines_per_block`` captures) is read to the driver; use :func:`read_all` and a
    join for URL lists of unbounded size.
    """
    entries = sorted(archive.directory.collect(), key=lambda r: (r["first_key"], r["last_key"]))
    firsts, out = [r["first_key"] for r in entries], []
    for key in sorted({url_key(u) for u in urls}):
        i = max(0, bisect.bisect_left(firsts, key) - 1)
        while i < len(entries) and entries[i]["first_key"] <= key:
            lines = _block(archive.folder, entries[i]) if entries[i]["last_key"] >= key else []
            at = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while at < len(lines) and lines[at][0] == key:
                _, _, name, offset, length = lines[at]
                out.append(parse_record(read_range(f"{archive.folder}/{name}", offset, length)))
                at += 1
            i += 1
    return out


def url_keys(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(key) the distinct keys of a table's URLs."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({url_key(u) for u in b.column(0).to_pylist()}), pa.string())], ["key"])

    return urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(run, "key string").distinct()


def seek(spark: SparkSession, archive: Archive, keys: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of all captures of the keys in ``keys`` (key), as :func:`read_all` returns them.

    Each task reads the directory (a row for ``lines_per_block`` captures) and searches it by halves for its keys.
    """
    folder, files = archive.folder, archive.directory.inputFiles()

    def blocks(batches):
        found = [pq.read_table(p, filesystem=fs) for fs, p in map(_open, files)]
        directory = pa.concat_tables(found).sort_by([("first_key", "ascending"), ("last_key", "ascending")]) if found else None
        n = directory.num_rows if directory else 0
        first, last, place = (directory.column(c).combine_chunks() for c in ("first_key", "last_key", "block_file")) if n else ([], [], [])
        offset, length = (directory.column(c).to_numpy() for c in ("offset", "length")) if n else ([], [])
        for b in batches:
            out = []
            for key in b.column(0).to_pylist():
                i = max(0, bisect.bisect_left(range(n), key, key=lambda k: first[k].as_py()) - 1)
                while i < n and first[i].as_py() <= key:
                    if last[i].as_py() >= key:
                        out.append((place[i].as_py(), int(offset[i]), int(length[i]), key))
                    i += 1
                    if len(out) >= 10_000:
                        yield table(out)
                        out = []
            yield table(out)

    def table(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["block_file", "offset", "length", "key"])

    def lines(batches):
        held, block = None, []
        for b in batches:
            out = []
            for entry in b.to_pylist():
                if held != (entry["block_file"], entry["offset"]):
                    held, block = (entry["block_file"], entry["offset"]), _block(folder, entry)
                at = bisect.bisect_left(block, entry["key"], key=lambda x: x[0])
                while at < len(block) and block[at][0] == entry["key"]:
                    out.append(block[at])
                    at += 1
            yield _line_batch(out)

    wanted = keys.mapInArrow(blocks, "block_file string, offset long, length long, key string")
    at = wanted.repartition("block_file", "offset").sortWithinPartitions("block_file", "offset", "key").mapInArrow(lines, INDEX_DDL)
    return _records(at, folder, payloads, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _line_batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "id", "archive", "offset", "length"])


def read_all(spark: SparkSession, archive: Archive, payloads: bool = False, tasks: int | None = None) -> DataFrame:
    """Every record: id, url, record_type, refers_to, payload_digest (hex), payload_bytes and, if asked for, payload."""
    folder = archive.folder

    def lines(batches):
        for b in batches:
            for entry in b.to_pylist():
                yield _line_batch(_block(folder, entry))

    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _records(archive.directory.repartition(tasks).mapInArrow(lines, INDEX_DDL), folder, payloads, tasks)


def _records(lines: DataFrame, folder: str, payloads: bool, tasks: int) -> DataFrame:
    """The records of index lines, which go to their archive's task in order of offset; lines that adjoin are read at once, up to 8 MB."""

    def records(batches):
        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            k = 0
            while k < len(rows):
                name, start, end = rows[k][0], rows[k][1], rows[k][1] + rows[k][2]
                j = k + 1
                while j < len(rows) and rows[j][0] == name and rows[j][1] == end and end - start < 8_000_000:
                    end += rows[j][2]
                    j += 1
                data = read_range(f"{folder}/{name}", start, end - start)
                found = [parse_record(data[o - start : o - start + n]) for _, o, n in rows[k:j]]
                cols = [pa.array([r[c] for r in found], t) for c, t in (("id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array([r["payload"] for r in found], pa.binary())] if payloads else [])], ["id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", *["payload"] * payloads])
                k = j

    # an archive's lines are dealt by ranges of offsets, so that a large archive is read by many tasks
    ordered = lines.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.select("archive", "offset", "length").mapInArrow(records, "id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads)
