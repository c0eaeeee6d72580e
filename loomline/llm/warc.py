"""WARC archives: a gzip member for each record; equal payloads are stored once and revisited.

Each task writes its records to one file, in the shared folder. Of rows with equal payloads (by SHA-1 and length) the one of the
largest id is the response; the others are revisits of the profile for identical digests, which keep the
payload's headers and digest and name the response. The reader goes through a file once: it inflates member by member in
small pieces, frames blocks by Content-Length, and verifies block and payload digests and that a member ends with its record.

Defined cases: a null payload is an empty one; rows of the largest id that are repeated are all responses; a null id
is read back as null, such a row is a response only if no row of its payload has an id; a null URL gives no target header;
an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.files import locate, written_whole

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
PIECE = 1 << 16
BATCH_BYTES = 8 << 20
MIN_BYTES = 0


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _head(fields: list[tuple[str, str | None]], first: bytes) -> bytes:
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    return first + b"\r\n" + b"".join(f"{k}: {clean(v)}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, payload_digest: str, refers_to: int | None) -> bytes:
    """One compressed record; without ``payload`` it is a revisit."""
    block = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))], b"HTTP/1.1 200 OK") + (payload or b"")
    revisit = payload is None
    head = _head([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", _urn(refers_to) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], VERSION)
    return gzip.compress(head + block + b"\r\n\r\n", 6, mtime=0)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = MIN_BYTES) -> list[tuple[str, int]]:
    """Writes the archives; returns (file, records) of each, one for each task that had rows."""
    raw = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), raw.alias("payload"),
                        F.sha1(raw).alias("sha"), F.octet_length(raw).cast("long").alias("size"))
    tops = rows.groupBy("sha", "size").agg(F.max("page_id").alias("top"))
    joined = rows.join(tops, ["sha", "size"])
    revisit = (F.col("size") >= min_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    records = joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "sha", F.when(revisit, F.col("top")).alias("refers_to"))

    def write(batches):
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        name, n = f"{folder}/part-{TaskContext.get().partitionId():07d}.warc.gz", 0
        with written_whole(name) as out:
            info = b"format: WARC/1.1\r\n"
            out.write(gzip.compress(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:archive>"), ("WARC-Date", DATE),
                                           ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))], VERSION) + info + b"\r\n\r\n", 6, mtime=0))
            while batch is not None:
                for page, url, payload, size, sha, refers in zip(*batch.columns):
                    out.write(record(page.as_py(), url.as_py(), payload.as_py(), size.as_py(), base64.b32encode(bytes.fromhex(sha.as_py())).decode(), refers.as_py()))
                    n += 1
                batch = next(batches, None)
        yield pa.record_batch([[name], [n]], names=["file", "records"])

    return sorted((r.file, r.records) for r in records.mapInArrow(write, "file string, records long").collect())


class WarcError(ValueError):
    """The archive is damaged."""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive, in order; holds one record at a time."""
    rest = b""
    while True:
        rest = rest or stream.read(PIECE)
        if not rest:
            return
        member, data, fields, need = zlib.decompressobj(wbits=31), bytearray(), None, None
        while not member.eof:
            if not rest:
                rest = stream.read(PIECE)
            try:
                data += member.decompress(member.unconsumed_tail or rest, PIECE) if rest else member.flush()
            except zlib.error as error:
                raise WarcError(str(error)) from error
            if not rest and not member.eof:
                raise WarcError("the archive ends within a member")
            if not member.unconsumed_tail:
                rest = b""
            if fields is None and (end := data.find(b"\r\n\r\n")) >= 0:
                if not data.startswith(b"WARC/"):
                    raise WarcError("a record doesn't begin with its version")
                fields = _fields(bytes(data[:end]))
                need = end + 4 + int(fields["content-length"])
                begin = end + 4
        rest = member.unused_data
        if fields is None or len(data) != need + 4 or data[need:] != b"\r\n\r\n":
            raise WarcError("a record's length is not the one it states")
        yield fields, bytes(data[begin:need])


def parse(fields: dict[str, str], block: bytes) -> tuple | None:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload); None for other records."""
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    if "sha1:" + digest(block) != fields["warc-block-digest"]:
        raise WarcError(f"{fields['warc-record-id']}: the block is not the one of its digest")
    head, _, payload = block.partition(b"\r\n\r\n")
    size, own = int(_fields(head)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (digest(payload) != own or len(payload) != size):
        raise WarcError(f"{fields['warc-record-id']}: the payload is not the one of its digest")
    number = lambda urn: None if urn == "<urn:page:none>" else int(urn[10:-1])
    refers = number(fields["warc-refers-to"]) if kind == "revisit" else None
    return number(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, refers, size, own, payload if kind == "response" else None


def read_archives(spark: SparkSession, files: list[str]) -> DataFrame:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    if not files:
        return spark.createDataFrame([], ddl)

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = locate(name)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for fields, block in read_records(stream):
                        row = parse(fields, block)
                        if row is None:
                            continue
                        rows.append(row)
                        held += len(row[6] or b"")
                        if held > BATCH_BYTES or len(rows) >= 5000:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files)).mapInArrow(read, ddl)
