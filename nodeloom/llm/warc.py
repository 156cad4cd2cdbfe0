"""WARC archives: pages written as records, and a reader that salvages what damaged archives still hold.

A record is ``version line, header fields, empty line, block, two line ends``. Spark's text writer puts the
records of a task into one file: plain ones with the two line ends as its line separator, compressed ones as
one gzip member each with a zero byte of padding between them. Archives are kept near ``ARCHIVE_BYTES``, as a
task reads an archive as one row.

The reader checks every member (its CRC) and every record (version, fields, lengths, end, digests). After a
failed check it looks for the next member or version line that passes all checks, goes on there, and logs the
bytes in between as a gap. A whole record inside the payload of a broken one is recovered like any other.

Defined cases: NULL html is the empty payload, which counts as equal to other empty payloads. A NULL page_id is
less than any other; a revisit of a record without an id refers to NULL. Rows alike in id, url and html are
records of their own: the first is the response, the others revisit it. A NULL url is left out. Other columns
are not read. No pages make an empty archive folder, which reads as no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators.skew import hot_keys, join_hot
from nodeloom.runtime import store_table

# Fixed values of the format.
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
VERSION_START, MEMBER_START = b"WARC/1.", b"\x1f\x8b\x08"
RECORD_END = "\r\n\r\n"
PADDING = "\x00"
FIELD = re.compile(r"([!#$%&'*+\-.^_`|~0-9A-Za-z]+):[ \t]*([^\x00-\x1f\x7f]*?)[ \t]*")
REPEATABLE = "warc-concurrent-to"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
URN = "urn:page:"
# Most bytes of a header, aimed size of an archive before compression, bytes a batch holds, rows of one payload in a task.
HEADER_BYTES = 65_536
ARCHIVE_BYTES = 32_000_000
BATCH_BYTES = 8_000_000
HOT_PAYLOAD = 10_000

FOUND = (
    "path string, start bigint, end bigint, inner_start bigint, inner_end bigint, problem string, record_id string, "
    "record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
)


class Record(NamedTuple):
    fields: dict[str, str]
    payload: bytes | None
    payload_bytes: int | None


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1, as WARC headers write it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- writing -------------------------------------------------------------------------------


def record_bytes(kind: str, name: str, url: str | None, payload_digest: str, size: int, payload: bytes | None, refers: str | None) -> bytes:
    """One record without its end; a revisit holds the HTTP header of its payload only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += payload or b""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    fields.append(("WARC-Payload-Digest", f"sha1:{payload_digest}"))
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers}>")]
    fields += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response")]
    fields.append(("Content-Length", str(len(block))))
    return VERSIONS[1] + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp, so that reruns write the same bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def keyed_pages(pages: DataFrame) -> DataFrame:
    """``name, page_id, url, payload, n_bytes, sha1, body``: rows alike in id, url and html share ``name``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    given = given.withColumns({"body": F.sha2("payload", 256), "sha1": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    place = F.coalesce(F.concat(F.lit("u"), F.md5(F.col("url").cast("binary"))), F.lit("-"))
    return given.withColumn("name", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), place, "body"))


def label(pages: DataFrame, revisit_from: int = 0, hot_rows: int = HOT_PAYLOAD) -> DataFrame:
    """``name, page_id, url, n_bytes, sha1, copies, lead_name, lead``: per distinct page the record that it revisits.

    Of equal payloads the one of the largest (page_id, url) leads; payloads of less than ``revisit_from`` bytes all do.
    Only names and digests travel here.
    """
    keyed = keyed_pages(pages).drop("payload")
    facts = keyed.groupBy("name", "page_id", "url", "n_bytes", "sha1", "body").agg(F.count(F.lit(1)).alias("copies"))
    per_body = keyed.groupBy("body").agg(
        F.max(F.struct("page_id", "url", "name")).alias("top"), F.approx_count_distinct("name").alias("names")
    )
    per_body = store_table(per_body.select("body", F.col("top.name").alias("lead_name"), "names"))
    hot = hot_keys(per_body, ["body"], "names", hot_rows)
    met = join_hot(facts, per_body.drop("names"), ["body"], hot, [F.col("name")])
    small = F.col("n_bytes") < revisit_from
    return met.drop("body").withColumn("lead", small | (F.col("name") == F.col("lead_name"))).withColumn("small", small)


def _urn(name: Column, copy: Column) -> Column:
    return F.concat(F.lit(URN), F.concat_ws(":", name, copy.cast("string")))


def _copies(rows: DataFrame, first: int | Column, *columns: str) -> DataFrame:
    """A row per copy from ``first`` to ``copies``."""
    return rows.select(*columns, F.explode(F.sequence(F.lit(first) if isinstance(first, int) else first, F.col("copies"))).alias("copy"))


def response_rows(pages: DataFrame) -> DataFrame:
    """``name, kind, urn, url, sha1, n_bytes, payload, refers`` of each page, as if it were a response."""
    return keyed_pages(pages).select(
        "name", F.lit("response").alias("kind"), _urn(F.col("name"), F.lit(1)).alias("urn"), "url", "sha1", "n_bytes", "payload",
        F.lit(None).cast("string").alias("refers"),
    )


def revisit_rows(labels: DataFrame) -> DataFrame:
    """The same columns of the records without a payload."""
    first = F.when(F.col("lead"), 2).otherwise(1).cast("long")
    rest = _copies(labels.where("not small and (not lead or copies > 1)"), first, "name", "url", "sha1", "n_bytes", "lead_name")
    return rest.select(
        "name", F.lit("revisit").alias("kind"), _urn(F.col("name"), F.col("copy")).alias("urn"), "url", "sha1", "n_bytes",
        F.lit(None).cast("binary").alias("payload"), _urn(F.col("lead_name"), F.lit(1)).alias("refers"),
    )


def further_responses(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The same columns of the second and further copies of pages whose payload is too small to be revisited."""
    again = _copies(labels.where("small and copies > 1"), F.lit(2).cast("long"), "name", "copy")
    return response_rows(pages).dropDuplicates(["name"]).join(again, "name").withColumn("urn", _urn(F.col("name"), F.col("copy"))).drop("copy")


def build_records(rows: DataFrame, compress: bool) -> DataFrame:
    """``name, record``: the bytes of each row's record. Rows of one ``urn`` in a batch are built once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, made, held, seen = [], [], 0, set()
            for row in range(batch.num_rows):
                name, kind, urn, url, sha1, n, payload, refers = (batch.column(k)[row].as_py() for k in range(8))
                if urn not in seen:
                    seen.add(urn)
                    written = record_bytes(kind, urn, url, base64.b32encode(bytes.fromhex(sha1)).decode(), n, payload, refers)
                    made.append(member(written + RECORD_END.encode()) if compress else written)
                    names.append(name)
                    held += len(made[-1])
                if held >= BATCH_BYTES or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(made, type=pa.binary())], names=["name", "record"])
                    names, made, held = [], [], 0

    columns = ("name", "kind", "urn", "url", "sha1", "n_bytes", "payload", "refers")
    return rows.select(*columns).mapInArrow(build, "name string, record binary")


def write_archives(pages: DataFrame, path: str, compress: bool = True, revisit_from: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``page_id, url, html`` to archives below ``path``.

    Every page is built as a response where it is read and shuffled once, compressed, to its archive; there the
    records of pages that do not lead, and those of copies, are left out.
    """
    labels = store_table(label(pages, revisit_from))
    sizes = labels.agg(
        F.sum(F.when(F.col("lead"), F.col("n_bytes") + 800)).alias("leading"),
        F.sum(F.when(~F.col("small"), F.lit(1000) * F.col("copies"))).alias("others"),
    ).first()
    archives = lambda size: max(1, -(-(size or 0) // archive_bytes))
    built = build_records(response_rows(pages), compress).repartition(archives(sizes.leading), "name")
    leading = built.join(labels.where("lead").select("name"), "name").dropDuplicates(["name"])
    whole = leading.unionByName(build_records(revisit_rows(labels), compress).repartition(archives(sizes.others), "record"))
    if revisit_from > 0:
        whole = whole.unionByName(build_records(further_responses(pages, labels), compress))
    # The bytes of a record are carried as a string, which the text writer puts out unread.
    lines = whole.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", PADDING if compress else RECORD_END).text(path)


# -- reading -------------------------------------------------------------------------------


def parse_record(data: bytes, at: int) -> tuple[Record, int] | str:
    """The record at ``at`` and the place after it, or what is wrong with it."""
    if not data.startswith(VERSIONS, at):
        return "version line"
    head = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    if head < 0:
        return "end of header"
    fields: dict[str, str] = {}
    try:
        lines = re.sub(r"\r\n[ \t]+", " ", data[at:head].decode("utf-8")).split("\r\n")[1:]
    except UnicodeDecodeError:
        return "header field"
    for line in lines:
        field = FIELD.fullmatch(line)
        if field is None:
            return "header field"
        name = field[1].lower()
        # A header cut off within a field would go on into the next record, which repeats fields.
        if name in fields and name != REPEATABLE:
            return "repeated field"
        fields.setdefault(name, field[2])
    if not {"warc-type", "warc-record-id", "warc-date", "content-length"} <= fields.keys():
        return "mandatory field"
    if not re.fullmatch(r"[0-9]{1,18}", fields["content-length"]):
        return "content length"
    start, end = head + 4, head + 4 + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "end of record"
    block = data[start:end]
    if not _agrees(fields.get("warc-block-digest"), block):
        return "block digest"
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            return "http header"
        said = re.search(rb"\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|\Z)", http, re.IGNORECASE)
        size = len(payload) if fields["warc-type"] != "revisit" else int(said[1]) if said else None
    if fields["warc-type"] == "revisit":
        payload = None
    elif not _agrees(fields.get("warc-payload-digest"), payload):
        return "payload digest"
    return Record(fields, payload, size), end + 4


def _agrees(said: str | None, data: bytes) -> bool:
    """Whether a SHA-1 digest, if given, is that of the data; other algorithms are not checked."""
    if said is None or not said.lower().startswith("sha1:"):
        return True
    value = said[5:]
    return value.upper() == digest(data) if len(value) == 32 else value.lower() == hashlib.sha1(data).hexdigest()


def unpack_member(data: bytes, at: int, step: int = 65_536) -> tuple[bytes, int] | str:
    """The content of the gzip member at ``at`` and the place after it, or what is wrong with it."""
    unpacker, out = zlib.decompressobj(31), []
    try:
        while not unpacker.eof:
            if at >= len(data):
                return "end of member"
            out.append(unpacker.decompress(data[at : at + step]))
            at = min(at + step, len(data))
    except zlib.error:
        return "member check"
    return b"".join(out), at - len(unpacker.unused_data)


def salvage(data: bytes, packed: bool = True) -> Iterator[tuple]:
    """``start, end, inner start, inner end, problem, Record`` for each record and each gap, in order.

    Inner places count in the content of a member and are None elsewhere; a gap has a problem and no record.
    """
    at, bad, problem = 0, None, None
    while at < len(data):
        if packed and data.startswith(MEMBER_START, at):
            found = unpack_member(data, at)
            if not isinstance(found, str):
                inner = list(salvage(found[0], packed=False))
                if any(x[5] is not None for x in inner):
                    if bad is not None:
                        yield bad, at, None, None, problem, None
                    for x in inner:
                        yield at, found[1], x[0], x[1], x[4], x[5]
                    at, bad = found[1], None
                    continue
                found = inner[0][4] if inner else "empty member"
        elif bad is None and packed and data[at] == 0:
            # Padding after a member.
            at = len(data) - len(data[at:].lstrip(b"\x00")) if data[at : at + 2] == b"\x00\x00" else at + 1
            continue
        else:
            found = parse_record(data, at)
            if not isinstance(found, str):
                if bad is not None:
                    yield bad, at, None, None, problem, None
                yield at, found[1], None, None, None, found[0]
                at, bad = found[1], None
                continue
        if bad is None:
            bad, problem = at, found
        marks = (VERSION_START, MEMBER_START) if packed else (VERSION_START,)
        at = min((p for p in (data.find(m, at + 1) for m in marks) if p >= 0), default=len(data))
    if bad is not None:
        yield bad, len(data), None, None, problem, None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``, see ``FOUND``; ``problem`` is NULL for records.

    A revisit has no payload; its ``payload_bytes`` come from the HTTP header that it keeps.
    """
    schema = pa.schema([
        ("path", pa.string()), *((n, pa.int64()) for n in ("start", "end", "inner_start", "inner_end")),
        *((n, pa.string()) for n in ("problem", "record_id", "record_type", "target_uri", "refers_to", "payload_digest")),
        ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ])

    def row(path: str, start: int, end: int, inner_start: int | None, inner_end: int | None, problem: str | None, record: Record | None) -> tuple:
        if record is None:
            return (path, start, end, inner_start, inner_end, problem, *[None] * 7)
        held = record.fields
        plain = lambda name: held[name].strip("<>") if name in held else None
        if record.payload is not None:
            sha1 = digest(record.payload)
        else:
            said = held.get("warc-payload-digest", "")
            sha1 = said[5:] if said.lower().startswith("sha1:") else None
        facts = (plain("warc-record-id"), held["warc-type"], plain("warc-target-uri"), plain("warc-refers-to"), sha1)
        return (path, start, end, inner_start, inner_end, None, *facts, record.payload_bytes, record.payload if payloads else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for n in range(batch.num_rows):
                name, rows, held = batch.column(0)[n].as_py(), [], 0
                for found in salvage(batch.column(1)[n].as_py()):
                    rows.append(row(name, *found))
                    held += 300 + len(rows[-1][-1] or b"")
                    if held >= BATCH_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(read, FOUND)


def gaps(found: DataFrame) -> DataFrame:
    """The quarantined byte ranges; inner places are those in the content of a sound member."""
    return found.where("problem is not null").select("path", "start", "end", "inner_start", "inner_end", "problem")


def page_of(record: Column) -> Column:
    """The page_id within a record id that this module made."""
    return F.regexp_extract(record, f"^{URN}(-?[0-9]*):", 1).try_cast("bigint")
