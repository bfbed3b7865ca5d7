"""WARC: archives of pages, the monolithic gzip normaliser and the indexed reader.

``write_archives`` writes one gzip stream per file, as crawlers' plain dumps do.  ``normalise``
inflates each stream once, rewrites every record as a gzip member of its own and writes a sidecar
index of (offset, size) beside the archive; ``read_archives`` uses the index to read members in
parallel, whatever the file they lie in.

Defined cases: a null payload is empty; a null url is left out of the record; records with a null
page_id are kept and are never the original of others; of equal payloads whose records all lack a
page_id each is a response; records that share the largest page_id of equal payloads are all
responses; an empty table gives no records; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, pieces, written
from .files import create, open_at, open_stream

#: Payloads below this many bytes are never replaced by revisit records.
MIN_REVISIT = 1000
#: Up to this many repeated payloads their table is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 250_000
READ_CHARS = 8_000_000
#: Members of a run, and bytes that one read of it fetches at most, unless a member is longer.
RUN, FETCH = 128, 8 << 20
#: Bytes of a sidecar's line.
ENTRY = 32
#: Tasks that read, per file on average, at most.
READS = 4
_BUFFER = 1 << 20
_END = b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None) -> bytes:
    """One WARC record; a revisit of ``original`` if that is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:sha1:{digest}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~' + chr(39))}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if original is not None:
        head += [f"WARC-Refers-To: <urn:page:{original}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + _END + payload + _END


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    at = raw.index(_END)
    lines = raw[:at].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    return head, raw[at + 4 : at + 4 + int(head["Content-Length"])]


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of an inflated stream that comes in chunks."""
    held = bytearray()
    length = re.compile(rb"\r\nContent-Length: (\d+)\r\n\r\n")
    need = 0
    for chunk in chunks:
        held += chunk
        while len(held) >= need:
            if not need:
                found = length.search(held)
                if not found:
                    break
                need = found.end() + int(found[1]) + 4
                continue
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the stream ends within a record")


def inflated(uri: str) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of one or several members, in chunks of bounded size."""
    with open_stream(uri) as f:
        z = zlib.decompressobj(31)
        while raw := f.read(_BUFFER):
            while raw:
                yield z.decompress(raw, _BUFFER * 4)
                raw = z.unconsumed_tail
                if z.eof:
                    raw, z = z.unused_data, zlib.decompressobj(31)


def originals(pages: DataFrame, payload: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``pages`` with original: the page_id that a page's record refers to, null for responses.

    Only digests are grouped; payloads meet the repeated ones without being shuffled while those
    are few (counted), else in a join.
    """
    text = F.coalesce(F.col(payload), F.lit(""))
    big = pages.where(F.octet_length(text) >= min_bytes).select("page_id", F.sha1(text).alias("digest"))
    grouped = big.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = written(grouped.where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"), "repeated")
    few = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    # small payloads never match: their digest is left null
    keyed = pages.select("page_id", "url", payload, F.when(F.octet_length(text) >= min_bytes, F.sha1(text)).alias("own"))
    met = keyed.join(few, F.col("own") == F.col("digest"), "left")
    original = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return met.select("page_id", "url", payload, original.alias("original"))


def write_archives(pages: DataFrame, folder: str, payload: str = "html") -> DataFrame:
    """One whole-file gzip stream per task; returns the written list of files (file, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n = None, None, 0
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        for batch, texts in pieces(batches, payload, READ_CHARS):
            ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for i, text in enumerate(texts):
                if out is None:
                    name, out = create(folder, "whole")
                out.write(z.compress(record(ids[i], urls[i], text.encode("utf-8", "surrogatepass"), refers[i])))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name] if n else [], pa.string()), pa.array([n] if n else [], pa.int64())], ["file", "records"])

    return written(originals(pages, payload).mapInArrow(run, "file string, records long"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite every archive with one member per record; returns the written list of files (file, sidecar, records).

    A sidecar index has a line of ENTRY bytes, offset and size, for each record in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                name, out = create(folder, "members")
                sidecar, side = create(folder, name.rpartition("/")[2] + ".index")
                at = records = 0
                for raw in records_of(inflated(uri)):
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = z.compress(raw) + z.flush()
                    out.write(member)
                    side.write(b"%016d %014d\n" % (at, len(member)))
                    at += len(member)
                    records += 1
                out.close()
                side.close()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sidecar]), pa.array([records], pa.int64())], ["file", "sidecar", "records"])

    files = max(1, archives.count())  # names of files, not records
    return written(archives.select("file").repartitionByRange(files, "file").mapInArrow(run, "file string, sidecar string, records long"), "members")


def fetched(uri: str, entries: list[tuple[int, int]]) -> Iterator[memoryview]:
    """The members of neighbouring entries (offset, size), cut by their sizes out of reads of FETCH bytes (or one member)."""
    first = 0
    while first < len(entries):
        last, size = first + 1, entries[first][1]
        while last < len(entries) and size + entries[last][1] <= FETCH:
            size += entries[last][1]
            last += 1
        begin = entries[first][0]
        raw = memoryview(open_at(uri, begin, size))
        for at, n in entries[first:last]:
            yield raw[at - begin : at - begin + n]
        first = last


def read_archives(members: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to, url of every record.

    Each read looks up a run of neighbouring members in the sidecar index and fetches them in few reads,
    whatever the file they lie in; the digests of responses are computed anew.
    """
    counted = members.agg(F.count("*").alias("files"), F.sum(F.ceil(F.col("records") / RUN)).alias("runs")).first()
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(RUN).cast("long")))
    runs = members.where("records > 0").select("file", "sidecar", "records", starts.alias("start"))
    tasks = max(1, min(counted["runs"] or 0, READS * counted["files"]))
    runs = runs.repartitionByRange(tasks, "file", "start").select("file", "sidecar", "start", F.least(F.col("records") - F.col("start"), F.lit(RUN)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = open_at(row["sidecar"], row["start"] * ENTRY, row["n"] * ENTRY).splitlines()
                out: list[tuple] = []
                for member in fetched(row["file"], [tuple(map(int, line.split())) for line in lines]):
                    head, block = parse(zlib.decompress(member, 31))
                    told = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind = head["WARC-Type"]
                    if kind == "response" and hashlib.sha1(block).hexdigest() != told:
                        raise ValueError("a payload doesn't have its digest")
                    page = head.get("X-Page-ID")
                    refers = head.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
                    out.append((int(page) if page else None, int(head["X-Payload-Length"]), told, kind, int(refers) if refers else None, head.get("WARC-Target-URI")))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    return runs.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, payload: str = "html") -> DataFrame:
    """Write the archives, normalise them and read them back, all in the shared folder."""
    spark = pages.sparkSession
    archives = write_archives(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload), new_folder(spark, "warc"), payload)
    return read_archives(normalise(archives, new_folder(spark, "warc-members")))


ORACLE_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM d)
SELECT m.page_id, m.payload_bytes, m.payload_digest,
       CASE WHEN m.last IS NOT NULL AND m.last <> m.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.last <> m.page_id THEN m.last END AS refers_to,
       pages.url AS target_uri
FROM m JOIN pages USING (page_id)
"""
