"""WARC archives: written by tasks, read back by a splittable reader.

Every record is a gzip member of its own. A task that reads gets a range of bytes of an archive, looks
in it for gzip magic, and takes a candidate as a record once its member decodes to a WARC header, a block
of the stated length and the end marks. From there members follow each other. A task owns the records that
start inside its range and reads the last one past its end.

A payload may itself hold an archive, whose members look like records to a task that starts inside it.
So the members found in an archive must cover its bytes exactly; one that they do not cover is read again from
its start, as one range, where every member's place is certain.

Archives are named by their task's attempt, and only those in the manifest that the successful attempts leave
are read: what a lost executor has begun counts for nothing.

Defined results: a null payload is an empty one, a null address is left out. Of equal payloads (digest, length and a
second hash) of at least `least` bytes, rows with the smallest id are responses, all others revisit it; repeated rows
of that id are all responses. A null id is no smallest one unless all are null; it comes back as null. An empty table
gives no archive and an empty report. A damaged member is skipped. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.shared import shared_dir, small, staged, table

MAGIC = b"\x1f\x8b\x08"
#: Bytes that a task is given to read; bytes after which a task begins another archive; bytes read at once.
SPLIT, ARCHIVE, PIECE = 16 << 20, 1 << 30, 16 << 10
#: Pages and members handled at once.
ROWS = 256
#: The tables name no time of capture; records need one.
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
MANIFEST = "path string, bytes bigint, records bigint"
FOUND = "path string, offset bigint, length bigint, record_type string, id string, uri string, refers_to string, payload_bytes bigint, payload_digest string, intact boolean"


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five bytes are eight digits of base 32, spelled with other signs."""
    fives = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*fives)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(page: str | None) -> str:
    return "<urn:page-null:0>" if page is None else f"<urn:page:{urllib.parse.quote(page, safe='')}>"


def of_urn(name: str | None) -> str | None:
    return urllib.parse.unquote(name[10:-1]) if name and name.startswith("<urn:page:") else None


def _headers(first: str, fields: dict[str, str]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields.items())]).encode() + END


def member(fields: dict[str, str], block: bytes) -> bytes:
    """A record as a gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = _headers("WARC/1.1", {**fields, "Content-Length": str(len(block))})
    return packer.compress(head) + packer.compress(block) + packer.compress(END) + packer.flush()


def page_record(page: str | None, url: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    """first: the page whose payload is the same, if that is to be referred to."""
    http = _headers("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))})
    fields = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": urn(page), "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    if first is not None:
        fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": urn(first)}
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    return member(fields, http + payload if first is None else http)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, most: int = ARCHIVE) -> DataFrame:
    """Writes a record per row into archives in the folder; (path, bytes, records) of each archive."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(bytearray()))
    key = [F.sha1("_payload").alias("_sha"), F.octet_length("_payload").alias("_bytes"), F.xxhash64("_payload").alias("_check")]
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload")).select("*", *key)
    names = ["_sha", "_bytes", "_check"]
    several = rows.groupBy(*names).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) & (F.col("_bytes") >= least))
    first = small(staged(several.drop("_n"), "warc-first"))
    refers = F.when(F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first").cast("string"))
    records = rows.join(first, names, "left").select(F.col("_id").cast("string"), "_url", "_payload", base32(F.col("_sha")), refers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        at, out, n, done = "", None, 0, []

        def close() -> None:
            done.append((f"{folder}/{at}", out.tell(), n))
            out.close()

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                for page in zip(*(c.to_pylist() for c in batch.slice(start, ROWS).columns)):
                    if out is not None and out.tell() >= most:
                        close()
                        out = None
                    if out is None:
                        at, n = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{at}", compression=None)
                        out.write(member({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                    out.write(page_record(*page))
                    n += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return staged(records.mapInArrow(run, MANIFEST), "warc-manifest")


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes
    end: int

    def payload(self) -> tuple[dict[str, str], bytes]:
        """HTTP headers and what follows them; a block of another type is all payload."""
        if not self.fields.get("content-type", "").startswith("application/http"):
            return {}, self.block
        head, _, body = self.block.partition(END)
        return _fields(head), body


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def record_at(f: io.BufferedReader, at: int) -> Record | None:
    """The record whose member starts at this byte; None if none does."""
    f.seek(at)
    unpacker, data, read = zlib.decompressobj(31), bytearray(), 0
    try:
        while not unpacker.eof:
            piece = f.read(PIECE)
            if not piece:
                return None
            read += len(piece)
            data += unpacker.decompress(piece)
            if len(data) >= 5 and data[:5] != b"WARC/":
                return None
    except zlib.error:
        return None
    head, mark, rest = bytes(data).partition(END)
    fields = _fields(head)
    length = fields.get("content-length", "")
    if not (head.startswith(b"WARC/") and mark and length.isdigit() and len(rest) == int(length) + len(END) and rest.endswith(END)):
        return None
    return Record(fields, rest[: -len(END)], at + read - len(unpacker.unused_data))


def owned(f: io.BufferedReader, start: int, end: int) -> Iterator[tuple[int, Record]]:
    """The records whose members start in [start, end), with their places."""
    at: int | None = start
    certain = False
    while at is not None and at < end:
        found = record_at(f, at) if certain or start == 0 == at else None
        if found is None:
            at = _next_magic(f, at + certain, end)
            while at is not None and (found := record_at(f, at)) is None:
                at = _next_magic(f, at + 1, end)
            if at is None:
                return
        yield at, found
        at, certain = found.end, True


def _next_magic(f: io.BufferedReader, at: int, end: int) -> int | None:
    while at < end:
        f.seek(at)
        piece = f.read(min(PIECE, end - at) + len(MAGIC) - 1)
        if (i := piece.find(MAGIC)) >= 0:
            return at + i
        at += PIECE
    return None


def read(archives: DataFrame, split: int = SPLIT, payloads: bool = False) -> DataFrame:
    """The records of archives (path, bytes): place, type, ids, and size and digest of the full payload.

    Digests of responses are taken from their payload, and `intact` says that the record states the same one; those of revisits are
    as stated. payloads: with the payload itself, null for revisits.
    """
    ranges = archives.filter("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"), "bytes")
    n = archives.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, "bytes").alias("end")).repartition(min(int(n), 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *((c, pa.string()) for c in ("record_type", "id", "uri", "refers_to")), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())] + [("payload", pa.binary())] * payloads)
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t.type) for i, t in enumerate(schema)], schema=schema)
            held.clear()
            return out

        for ranges_ in batches:
            for path, start, end in zip(*(c.to_pylist() for c in ranges_.columns)):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as raw, io.BufferedReader(raw, 1 << 20) as f:
                    for offset, r in owned(f, start, end):
                        held.append((path, offset, r.end - offset, *_described(r, payloads)))
                        if len(held) >= ROWS:
                            yield batch()
        yield batch()

    return ranges.mapInArrow(run, FOUND + ", payload binary" * payloads)


def _described(r: Record, payloads: bool) -> tuple:
    kind, stated = r.fields.get("warc-type"), r.fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    http, body = r.payload()
    if kind == "revisit":
        length = http.get("content-length", "")
        size, digest, intact = int(length) if length.isdigit() else None, stated, None
    else:
        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        intact = None if stated is None else stated == digest
    said = (kind, of_urn(r.fields.get("warc-record-id")), r.fields.get("warc-target-uri"), of_urn(r.fields.get("warc-refers-to")), size, digest, intact)
    return (*said, None if kind == "revisit" else body) if payloads else said


def uncovered(archives: DataFrame, found: DataFrame) -> DataFrame:
    """(path, bytes) of archives whose bytes the members found do not cover exactly."""
    covered = found.groupBy("path").agg(F.sum("length").alias("covered"))
    return archives.join(covered, "path", "left").filter(~F.col("bytes").eqNullSafe(F.col("covered"))).select("path", "bytes")


def read_whole(archives: DataFrame, split: int = SPLIT, payloads: bool = False) -> DataFrame:
    """What read() finds, archives that it does not cover exactly read again as one range."""
    found = staged(read(archives, split, payloads), "warc-records")
    odd = staged(uncovered(archives, found), "warc-uncovered")
    if odd.isEmpty():
        return found
    names = small(odd.select("path"))
    return found.join(names, "path", "left_anti").unionByName(read(odd, 1 << 60, payloads))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex[:12]}"
    records = read_whole(write(pages, folder)).filter(F.col("record_type").isin("response", "revisit"))
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact")


_DIGEST = "translate(concat(" + ", ".join(f"to_base(('0x' || substr(sha, {1 + 10 * i}, 10))::BIGINT, 32, 8)" for i in range(4)) + "), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
OP11_SQL = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM payloads
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       CASE WHEN page_id = first THEN true END AS intact
FROM firsts
"""
