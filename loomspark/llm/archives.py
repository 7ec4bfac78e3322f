"""Legacy web archives (ARC, versions 1 and 2) read, written, and converted to WARC.

An ARC file opens with a ``filedesc:`` record, whose body names the version and the fields of all later header lines. A
record is a header line, a body of the length that the line declares, and a line end. The converter reads lines by their
version, takes bodies by their lengths, and makes for each record what its WARC form needs and ARC lacks: an identifier, a
timestamp, a type and digests. Records whose payload an earlier-numbered record holds become revisits.

Archives are files of a shared folder, written by Spark's own text sink, so a lost executor leaves no half file behind. Each
file is one row of bounded size, and what reads it holds one file at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, P, few, new_folder, saved

#: Fixed values of the two formats: the fields of a header line by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}

#: The profile of a revisit whose payload equals that of another record.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

_ID_HEADER = "X-Record-Key"
_UNSAFE = re.compile(r"[^\x21-\x7e]|^-$")


@dataclass(frozen=True)
class ArchiveRules:
    """``size`` bounds a file before it is compressed, unless one record alone is larger. Payloads of under ``min_revisit``
    bytes are never revisits."""

    size: int = 16 << 20
    min_revisit: int = 0
    date: str = "20000101000000"
    ip: str = "0.0.0.0"
    origin: str = "archive"


def base32_sha1(data: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_url(url: str | None) -> str:
    """A url as one word of printable ASCII: other characters are percent-encoded, null is ``-``."""
    if not url:
        return "-"
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url)


# ---------------------------------------------------------------- ARC


def arc_line(version: int, url: str, ip: str, date: str, kind: str, length: int, code: str = "-", checksum: str = "-", location: str = "-", offset: int = 0, filename: str = "-") -> bytes:
    """A header line with the fields of its version; an empty field is ``-``."""
    values = dict(zip(ARC_FIELDS[2], (url, ip, date, kind, code, checksum, location, str(offset), filename, str(length))))
    return (" ".join(values[f] or "-" for f in ARC_FIELDS[version]) + "\n").encode()


def arc_opening(version: int, name: str, rules: ArchiveRules) -> bytes:
    """The record that opens a file and says how the lines after it are to be read."""
    body = f"{version} 0 {rules.origin}\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    return arc_line(version, f"filedesc://{name}", rules.ip, rules.date, "text/plain", len(body), code="200", filename=name) + body


def arc_record(version: int, url: str | None, body: bytes, date: str, kind: str, code: str, offset: int, filename: str, rules: ArchiveRules) -> bytes:
    return b"\n" + arc_line(version, safe_url(url), rules.ip, date, kind, len(body), code, hashlib.md5(body).hexdigest(), "-", offset, filename) + body


@dataclass(frozen=True)
class ArcRecord:
    """One record of an ARC file: ``at`` is the place of its header line, ``body`` a view of the file's bytes."""

    at: int
    version: int
    fields: dict[str, str]
    body: memoryview


class ArcError(ValueError):
    """Bytes that are no ARC file, or one that is cut short."""


def parse_arc(data: bytes | memoryview) -> Iterator[ArcRecord]:
    """The records of a file, the opening one among them.

    The opening line has the fields of its version; those of later lines are read from the opening body, and where that
    names none they are the version's own. Fields are told apart by single spaces; a url that holds spaces, as old crawlers
    wrote them, takes what the other fields leave over. Line ends between records may be missing or several. A line that
    doesn't fit, a length that is no number, and a body that ends after the file raise :class:`ArcError` with the place.
    """
    view = memoryview(data)
    whole = bytes(view) if not isinstance(data, bytes) else data
    at, version, names = 0, 0, ()
    while True:
        while at < len(whole) and whole[at] in b"\r\n":
            at += 1
        if at == len(whole):
            return
        end = whole.find(b"\n", at)
        if end < 0:
            raise ArcError(f"a header line at {at} has no end")
        line = whole[at:end].rstrip(b"\r").decode("utf-8", "replace")
        opening = not version
        if opening:
            if not line.startswith("filedesc:"):
                raise ArcError("the file does not open with a filedesc record")
            version = next((v for v, f in ARC_FIELDS.items() if len(line.split(" ")) == len(f)), 0)
            if not version:
                raise ArcError("the opening line has the fields of no known version")
            names = ARC_FIELDS[version]
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names):
            raise ArcError(f"a header line at {at} has {len(parts)} fields of {len(names)}")
        fields = dict(zip(names, parts))
        length = fields["Archive-length"]
        if not (length.isascii() and length.isdigit()):
            raise ArcError(f"a header line at {at} declares no length")
        stop = end + 1 + int(length)
        if stop > len(whole):
            raise ArcError(f"the record at {at} declares {length} bytes, of which {len(whole) - end - 1} are there")
        body = view[end + 1 : stop]
        if opening:
            said = bytes(body).decode("utf-8", "replace").split("\n")
            number = said[0].split(" ")[0]
            if not number.isdigit() or int(number) not in ARC_FIELDS:
                raise ArcError(f"version {number!r} is not known")
            version = int(number)
            names = tuple(said[1].split()) if len(said) > 1 and said[1].strip() else ARC_FIELDS[version]
            if "Archive-length" not in names or "URL" != names[0]:
                raise ArcError("the opening record names no url or no length")
        yield ArcRecord(at, version, fields, body)
        at = stop


def http_parts(block: bytes | memoryview) -> tuple[dict[str, str] | None, int]:
    """Header fields, lower-cased, and the place where the payload begins; ``(None, 0)`` for what is no HTTP response."""
    head = bytes(block[:5])
    if head != b"HTTP/":
        return None, 0
    whole = bytes(block)
    ends = [(i, i + len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (i := whole.find(mark)) >= 0]
    end, start = min(ends, default=(len(whole), len(whole)))
    rows = whole[:end].decode("latin-1").replace("\r\n", "\n").split("\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (r.partition(":") for r in rows)}, start


# ---------------------------------------------------------------- WARC


def warc_date(date: str, otherwise: str | None = None) -> str:
    """A timestamp of a WARC record from the digits of an ARC date; short ones are filled up with their first moment. What
    is no date gives that of ``otherwise``, at last the first second of 1970."""
    digits = date[:14] if date.isascii() and date.isdigit() and len(date) >= 4 else ""
    filled = digits + "00000101000000"[len(digits) :]
    try:
        return datetime.strptime(filled, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ") if digits else _otherwise(otherwise)
    except ValueError:
        return _otherwise(otherwise)


def _otherwise(date: str | None) -> str:
    return warc_date(date) if date is not None else "1970-01-01T00:00:00Z"


def record_id(*parts: object) -> str:
    """An identifier that follows from what it names, so a task that is run again gives the same one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def warc_type(url: str, kind: str, http: bool) -> str:
    """Type of a record by its scheme and content: HTTP responses, file descriptions, and resources of any other kind."""
    if url.startswith("filedesc:"):
        return "warcinfo"
    return "response" if http else "resource"


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Header fields, names lower-cased, and blocks of the records of a file, by their declared lengths."""
    view = memoryview(data)
    whole = bytes(view) if not isinstance(data, bytes) else data
    at = 0
    while at < len(whole):
        end = whole.find(b"\r\n\r\n", at)
        if end < 0 or whole[at : at + 5] != b"WARC/":
            raise ValueError(f"no record begins at {at}")
        rows = whole[at:end].decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (r.partition(":") for r in rows)}
        stop = end + 4 + int(fields["content-length"])
        if whole[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where its length says")
        yield fields, view[end + 4 : stop]
        at = stop + 4


# ---------------------------------------------------------------- files


def _write_files(rows: DataFrame, path: str) -> None:
    """One compressed file for each row of ``content``. The bytes go through the text sink, which ends each file with a
    line end of its own; the row's last byte, a line end, is left to it. Spark moves files into place only when their
    task has been accepted, so tasks may fail or run twice."""
    ends = F.expr("substring(content, 1, length(content) - 1)").cast("string").alias("value")
    rows.select(ends).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _unpacked(content: pa.Scalar) -> bytes:
    import gzip

    raw = content.as_buffer()
    return gzip.decompress(raw) if bytes(raw[:2]) == b"\x1f\x8b" else bytes(raw)


class _Batches:
    """Rows of a schema, given out as Arrow batches of bounded rows and bytes."""

    def __init__(self, schema: pa.Schema, rows: int = 2_000, size: int = 8 << 20):
        self.schema, self.rows, self.size, self.held, self.bytes = schema, rows, size, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.held.append(row)
        self.bytes += size
        if len(self.held) >= self.rows or self.bytes >= self.size:
            yield self.rest()

    def rest(self) -> pa.RecordBatch:
        columns = list(zip(*self.held)) if self.held else [[] for _ in self.schema]
        self.held, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", rules: ArchiveRules = ArchiveRules()) -> None:
    """Write rows as HTTP responses into ARC files of bounded size, versions 1 and 2 by turns.

    The key travels in a header field of the response, absent for null. Null payloads are empty ones, null urls are ``-``.
    Extra columns are not read; repeated rows give a record each; an empty table gives an empty folder.
    """
    sent = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").cast("binary").alias("payload"))
    schema = pa.schema([("content", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part, made, out, held = TaskContext.get().partitionId(), 0, [], 0

        def opened() -> tuple[int, str, bytes]:
            version, name = 1 + (part + made) % 2, f"{part:05d}-{made:05d}.arc"
            return version, name, arc_opening(version, name, rules)

        version, name, first = opened()
        for batch in batches:
            keys, urls, payloads = batch.columns
            for i in range(batch.num_rows):
                body = payloads[i].as_buffer().to_pybytes() if payloads[i].is_valid else b""
                k = keys[i].as_py()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{'' if k is None else f'{_ID_HEADER}: {k}{chr(13)}{chr(10)}'}Content-Length: {len(body)}\r\n\r\n".encode()
                if not out:
                    out, held = [first], len(first)
                record = arc_record(version, urls[i].as_py(), head + body, rules.date, "text/html", "200", held + 1, name, rules)
                out.append(record)
                held += len(record)
                if held >= rules.size:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out) + b"\n"], type=pa.binary())], schema=schema)
                    made, out = made + 1, []
                    version, name, first = opened()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out) + b"\n"], type=pa.binary())], schema=schema)

    _write_files(sent.mapInArrow(run, "content binary"), path)


_ARC_ROW = "archive string, at long, version int, url string, date string, kind string, type string, key long, payload_bytes long, payload_digest string"


def read_arc(spark: SparkSession, path: str, with_block: bool = False) -> DataFrame:
    """Records of all ARC files under a folder but for the opening ones: where they stand, their header fields, type, key,
    and size and digest of their payload; with ``block``, the whole body, on demand.

    Files may be compressed or plain. A file that is no ARC or is cut short fails the job with its path and place.
    """
    schema = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("type", pa.string()), ("key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + ([("block", pa.binary())] if with_block else []))

    def run(batches):
        out = _Batches(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                archive = batch.column(0)[i].as_py()
                opened = None
                try:
                    for r in parse_arc(_unpacked(batch.column(1)[i])):
                        if opened is None:
                            opened = r.fields["Archive-date"]
                            continue
                        http, start = http_parts(r.body)
                        key = (http or {}).get(_ID_HEADER.lower(), "")
                        payload = r.body[start:]
                        row = (archive, r.at, r.version, r.fields["URL"], warc_date(r.fields.get("Archive-date", ""), opened), r.fields.get("Content-type", "-"), warc_type(r.fields["URL"], r.fields.get("Content-type", ""), http is not None), int(key) if re.fullmatch(r"-?[0-9]+", key) else None, len(payload), base32_sha1(payload))
                        yield from out.add((*row, bytes(r.body)) if with_block else row, len(r.body) if with_block else 0)
                except ArcError as e:
                    raise ArcError(f"{archive}: {e}") from e
        yield out.rest()

    return _files(spark, path).mapInArrow(run, _ARC_ROW + (", block binary" if with_block else ""))


def _looked_up(rows: DataFrame, on: list[str], keys: DataFrame, many: str, total: int) -> DataFrame:
    """``rows`` left-joined to a saved table with one row for each key and the number ``many`` of rows it will meet.

    A table that is small goes to all tasks. Otherwise its keys of over a thousandth of all rows do, of which there are
    fewer than a thousand, and the others, none of them hot, shuffle.
    """
    if few(keys) is not keys:
        return rows.join(F.broadcast(keys), on, "left")
    hot = F.broadcast(keys.where(F.col(many) * 1_000 > total))
    known = hot.select(*on, F.lit(True).alias(f"{P}hot"))
    marked = rows.join(known, on, "left")
    apart = [marked.where(f"{P}hot").drop(f"{P}hot").join(hot, on, "left"), marked.where(f"{P}hot is null").drop(f"{P}hot").join(keys.where(F.col(many) * 1_000 <= total), on, "left")]
    return apart[0].unionByName(apart[1])


def _order(key: Column, archive: Column, at: Column) -> Column:
    """Places of records: by key, nulls last, then by file and place in it."""
    return F.struct(key.isNull().alias("none"), key.alias("key"), archive.alias("archive"), at.alias("at"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, rules: ArchiveRules = ArchiveRules()) -> None:
    """Convert all ARC files under a folder into WARC files.

    Of HTTP responses with equal payloads (length and digest) that of the least key is a response, and the others are
    revisits that refer to it; where the key repeats or is missing, the place in the archives decides. Payload digests are
    gathered first, without bodies; bodies are then read once more and do not shuffle unless the table of repeated payloads
    is too large to broadcast.
    """
    index = saved(read_arc(spark, arc_path).where("type = 'response'").select("archive", "at", "key", "url", "date", "payload_bytes", "payload_digest"))
    first = F.min(F.struct(_order(F.col("key"), F.col("archive"), F.col("at")).alias("place"), "url", "date")).alias("first")
    groups = index.where(F.col("payload_bytes") >= rules.min_revisit).groupBy("payload_digest", "payload_bytes").agg(first, F.count("*").alias("many")).where("many > 1")
    repeated = saved(groups.select("payload_digest", "payload_bytes", F.col("first.place.archive").alias("f_archive"), F.col("first.place.at").alias("f_at"), F.col("first.url").alias("f_url"), F.col("first.date").alias("f_date"), "many"))
    records = _looked_up(read_arc(spark, arc_path, with_block=True), ["payload_digest", "payload_bytes"], repeated, "many", index.count())
    sent = records.select("archive", "at", "url", "date", "kind", "type", "payload_digest", "payload_bytes", "block", "f_archive", "f_at", "f_url", "f_date")
    schema = pa.schema([("content", pa.binary())])

    def made(r: dict) -> bytes:
        own = record_id(r["archive"], r["at"])
        fields = {
            "WARC-Type": r["type"], "WARC-Record-ID": own, "WARC-Date": r["date"], "WARC-Target-URI": r["url"],
            "WARC-Payload-Digest": f"sha1:{r['payload_digest']}",
        }
        block = r["block"]
        if r["type"] != "response":
            fields |= {"Content-Type": r["kind"]}
        else:
            fields |= {"Content-Type": "application/http; msgtype=response"}
            if r["f_at"] is not None and (r["f_archive"], r["f_at"]) != (r["archive"], r["at"]):
                fields |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(r["f_archive"], r["f_at"]), "WARC-Refers-To-Target-URI": r["f_url"], "WARC-Refers-To-Date": r["f_date"], "WARC-Truncated": "length"}
                block = block[: http_parts(block)[1]]
        fields["WARC-Block-Digest"] = f"sha1:{base32_sha1(block)}"
        return warc_record(fields, block)

    def run(batches):
        from pyspark import TaskContext

        part, n, out, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                if not out:
                    info = b"software: loomspark\r\nformat: WARC File Format 1.0\r\n"
                    out = [warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("warcinfo", warc_path, part, n), "WARC-Date": warc_date(rules.date), "Content-Type": "application/warc-fields", "WARC-Filename": f"{part:05d}-{n:05d}.warc", "WARC-Block-Digest": f"sha1:{base32_sha1(info)}"}, info)]
                    held, n = len(out[0]), n + 1
                out.append(made({c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}))
                held += len(out[-1])
                if held >= rules.size:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], type=pa.binary())], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], type=pa.binary())], schema=schema)

    _write_files(sent.mapInArrow(run, "content binary"), warc_path)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of all WARC files under a folder but for file descriptions: identifier, type, address, date, key, what they
    refer to, and the payload's size and digest; a revisit has the digest its header names and no size, as it holds no
    payload. A block that does not have the digest its header names fails the job."""
    names = [("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("key", pa.int64()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    schema = pa.schema(names + ([("payload", pa.binary())] if with_payload else []))

    def run(batches):
        out = _Batches(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                for f, block in parse_warc(_unpacked(batch.column(1)[i])):
                    if f.get("warc-block-digest", "") not in ("", f"sha1:{base32_sha1(block)}"):
                        raise ValueError(f"{batch.column(0)[i].as_py()}: {f['warc-record-id']} does not have the digest it names")
                    if f["warc-type"] == "warcinfo":
                        continue
                    http, start = http_parts(block)
                    key, revisit = (http or {}).get(_ID_HEADER.lower(), ""), f["warc-type"] == "revisit"
                    payload = None if revisit else block[start:]
                    digest = f["warc-payload-digest"].removeprefix("sha1:") if revisit else base32_sha1(payload)
                    row = (f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), f["warc-date"], int(key) if re.fullmatch(r"-?[0-9]+", key) else None, f.get("warc-refers-to"), None if revisit else len(payload), digest)
                    yield from out.add((*row, None if payload is None else bytes(payload)) if with_payload else row, len(block) if with_payload else 0)
        yield out.rest()

    return _files(spark, path).mapInArrow(run, "record_id string, type string, url string, date string, key long, refers_to_id string, payload_bytes long, payload_digest string" + (", payload binary" if with_payload else ""))


def resolved(records: DataFrame) -> DataFrame:
    """Read records with the size of each revisit's payload, and the key of the record it refers to as ``refers_to``."""
    records = saved(records)
    asked = records.where("refers_to_id is not null").groupBy(F.col("refers_to_id").alias("record_id")).agg(F.count("*").alias("many"))
    found = saved(records.select("record_id", F.col("key").alias("f_key"), F.col("payload_bytes").alias("f_bytes")).join(few(saved(asked), size=BROADCAST_BYTES), "record_id"))
    revisits = _looked_up(records.where("refers_to_id is not null"), ["refers_to_id"], found.withColumnRenamed("record_id", "refers_to_id"), "many", records.count())
    others = records.where("refers_to_id is null").withColumns({"f_key": F.lit(None).cast("long"), "f_bytes": F.lit(None).cast("long"), "many": F.lit(None).cast("long")})
    return others.unionByName(revisits).select("record_id", "type", "url", "date", "key", F.coalesce("payload_bytes", "f_bytes").alias("payload_bytes"), "payload_digest", F.col("f_key").alias("refers_to"))


def converted(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", rules: ArchiveRules = ArchiveRules()) -> DataFrame:
    """Write rows into ARC files, convert those to WARC, read these back: one row for each page.

    ``(key, payload_bytes, payload_digest, record_type, refers_to)``. Null payloads are empty; null urls are ``-``; null
    keys stay null, come last where the least key is sought, and give a null ``refers_to``; repeated rows give a record
    each, of which one at most is a response; very long pages are files of their own; an empty table gives an empty result;
    other columns are not read.
    """
    spark = pages.sparkSession
    arcs, warcs = new_folder(spark), new_folder(spark)
    write_arc(pages, arcs, key, url, payload, rules)
    convert(spark, arcs, warcs, rules)
    done = resolved(read_warc(spark, warcs))
    return done.select(F.col("key").alias(key), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


#: What the pages give, in SQL: equal payloads by their digests, the least page of each as response.
ORACLE_SQL = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
coded AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST(list_sum(list_transform(range(5), lambda b: CAST(
        ((instr('0123456789abcdef', substr(hex, 1 + (5 * i + b) // 4, 1)) - 1) >> (3 - (5 * i + b) % 4)) & 1 AS BIGINT) << (4 - b))) AS BIGINT), 1)), 'string_agg', '') AS payload_digest
  FROM hashed),
grouped AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM grouped
"""
