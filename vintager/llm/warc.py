"""WARC archives: writing with segmented records, and reassembly.

A record's block is an HTTP response with chunked transfer framing. A block longer than
``SEGMENT_BYTES`` is cut: the first part is the record, the rest are continuation records that name
it as their origin, number themselves, and give the total length in the last one. Reading groups the
parts by origin, orders them by segment number, verifies numbering and total length, and decodes the
chunks. A payload that occurred before is a revisit record without a block.

Archives are written with Spark's text writer (one record per row, separated by the format's two
empty lines) into the shared folder, a bounded number of records per file, so reading back one file
at a time is bounded as well. Equal payloads are found by digest and length; a digest that many
pages share is reduced before the shuffle and joined by a join that adaptive execution splits.

Of equal payloads the smallest (page_id, url) is the response, null last. Defined cases: a null
payload is empty; rows equal in all of these are one record listed twice and have the same type;
an empty table writes nothing and reads nothing; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintager.llm.common import stored
from vintager.session import ensure_checkpoint_dir

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 400
END = "\r\n\r\n"
HTTP_HEAD = (
    b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    b"Transfer-Encoding: chunked\r\n\r\n"
)
RECORD = (
    "page_id long, url string, record_type string, refers_to long, digest string, length long,"
    " origin string, segment int, total long, block binary"
)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out.append(b"%x\r\n%b\r\n" % (len(part), part))
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions are skipped, trailers ignored."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size
        if len(out[-1]) != size or body[at : at + 2] != b"\r\n":
            raise ValueError("A chunk is cut short.")
        at += 2


def _quoted(text: str) -> str:
    """A header value in one line."""
    return re.sub(r"[%\r\n]", lambda m: f"%{ord(m[0]):02X}", text)


def _unquoted(text: str) -> str:
    return re.sub(r"%(25|0D|0A)", lambda m: chr(int(m[1], 16)), text)


def _record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines += [f"{name}: {value}" for name, value in fields.items() if value is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _page(page_id: int | None) -> str | None:
    return None if page_id is None else f"<urn:page:{page_id}>"


def records(page_id, url, payload: bytes, digest: str, revisit: bool, refers_to) -> Iterator[bytes]:
    """The record of a page, or its parts."""
    target = None if url is None else _quoted(url)
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target} {digest}')}>"
    fields = {
        "WARC-Record-ID": name, "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": target,
        "X-Page": _page(page_id), "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": len(payload),
    }
    if revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields |= {"WARC-Profile": profile, "WARC-Refers-To": _page(refers_to)}
        yield _record("revisit", fields, b"")
        return
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        yield _record("response", fields, block)
        return
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    yield _record("response", fields | {"WARC-Segment-Number": 1}, parts[0])
    for number, part in enumerate(parts[1:], 2):
        own = uuid.uuid5(uuid.NAMESPACE_URL, f"{name} {number}")
        more = {
            "WARC-Record-ID": f"<urn:uuid:{own}>", "WARC-Date": "1970-01-01T00:00:00Z",
            "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": number,
            "WARC-Segment-Total-Length": len(block) if number == len(parts) else None,
        }
        yield _record("continuation", more, part)


def with_roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``pages`` (page_id, url, payload) with digest, revisit and refers_to."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"sha": F.sha1("payload"), "bytes": F.octet_length("payload")})
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    repeated = stored(
        rows.filter(F.col("bytes") >= least_bytes).groupBy("sha", "bytes")
        .agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
        .select(
            F.col("sha").alias("s"), F.col("bytes").alias("b"),
            F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"),
        )
    )
    same = (F.col("sha") == F.col("s")) & (F.col("bytes") == F.col("b"))
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(
        F.col("first_url")
    )
    revisit = F.col("s").isNotNull() & ~is_first
    return rows.join(repeated, same, "left").select(
        "page_id", "url", "payload", "sha", revisit.alias("revisit"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, sha, revisit, refers_to = (
                    c[row].as_py() for c in batch.columns
                )
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                out = list(records(page_id, url, payload, digest, revisit, refers_to))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = with_roles(pages, least_bytes).mapInArrow(run, "record binary")
    (
        rows.select(F.col("record").cast("string").alias("value"))
        .write.mode("overwrite").option("lineSep", END).option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    )


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of an archive, by content length."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"No record at {at}.")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        at = end + 4 + int(fields["Content-Length"])
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError("A record is cut short.")
        yield fields, raw[end + 4 : at]
        at += 4


def _number(text: str | None) -> int | None:
    return None if text is None else int(text.removeprefix("<urn:page:").rstrip(">"))


def _rows(fields: dict[str, str], block: bytes) -> tuple:
    url = fields.get("WARC-Target-URI")
    kind = fields["WARC-Type"]
    segment = fields.get("WARC-Segment-Number")
    return (
        _number(fields.get("X-Page")), None if url is None else _unquoted(url), kind,
        _number(fields.get("WARC-Refers-To")),
        fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
        int(fields.get("X-Payload-Length", 0)),
        fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]),
        None if segment is None else int(segment),
        _number(fields.get("WARC-Segment-Total-Length")), block,
    )


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [
        pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(),
        pa.int32(), pa.int64(), pa.binary(),
    ]
    for batch in batches:
        for content in batch.column("content"):
            found = [_rows(*x) for x in parse(gzip.decompress(content.as_py()))]
            columns = list(zip(*found, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, or lists of parts in order, to pages with their payload verified."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            parts = row["parts"]
            head = parts[0]
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                raise ValueError(f"{row['origin']}: segments are missing.")
            block = b"".join(p["block"] for p in parts)
            total = parts[-1]["total"]
            if len(parts) > 1 and total != len(block):
                raise ValueError(f"{row['origin']}: {len(block)} bytes of {total}.")
            payload, length = None, head["length"]
            if head["record_type"] == "response":
                payload = dechunked(block[block.index(b"\r\n\r\n") + 4 :])
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if digest != head["digest"] or len(payload) != length:
                    raise ValueError(f"{row['origin']}: the payload differs from its digest.")
            out.append(
                (head["page_id"], head["url"], length, head["digest"], head["record_type"],
                 head["refers_to"], len(parts), payload)
            )
        columns = list(zip(*out, strict=True)) or [[]] * 8
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                 pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            [x.split()[0] for x in PAGE.split(", ")],
        )


PAGE = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, n_segments long, payload binary"
)


def read(spark, path: str) -> DataFrame:
    """Pages of all archives under ``path``; a revisit has no payload of its own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    found = files.select("content").mapInArrow(_parse_files, RECORD)
    part = F.struct(
        F.coalesce("segment", F.lit(1)).alias("segment"), "page_id", "url", "record_type",
        "refers_to", "digest", "length", "total", "block",
    )
    # Equal rows written twice have one origin; each occurrence is a page.
    whole = found.filter("segment IS NULL").select("origin", F.array(part).alias("parts"))
    cut = (
        found.filter("segment IS NOT NULL").groupBy("origin")
        .agg(F.sort_array(F.collect_list(part)).alias("all"))
        .withColumn("copies", F.size(F.filter("all", lambda p: p.segment == 1)))
        .select("origin", F.explode(F.expr("sequence(1, copies)")).alias("copy"), "all", "copies")
        .select("origin", F.expr("filter(all, (p, i) -> i % copies = copy - 1)").alias("parts"))
    )
    return whole.unionByName(cut).mapInArrow(_decode, PAGE)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` written to a new folder of the shared checkpoint folder and read back."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{shared}/warc-{uuid.uuid4().hex}"
    write(pages, path, least_bytes)
    return read(spark, path)
