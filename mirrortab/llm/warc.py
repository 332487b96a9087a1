"""WARC archives: writing, reading, and putting segmented records together again.

A payload is the body of an HTTP response in chunked transfer framing. Equal payloads are written once and revisited
by the other records. A block above ``SEGMENT_BYTES`` is cut into a first segment and continuation records that name it
as their origin. Reading gives one row per record; the segments of a record meet by origin, in order of segment number,
their total length is verified, and the framing is taken off.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mirrortab.llm.arrays import balanced
from mirrortab.llm.files import Written, one_per_task, read_stream
from mirrortab.llm.registry import query, table
from mirrortab.llm.scratch import new_path, saved

LEAST_REVISITED = 1000
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
FILE_BYTES = 64_000_000
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(piece), piece) for piece in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Take chunked framing off; raises where a size line, a chunk or the end is missing."""
    out, at = [], 0
    while True:
        line_end = body.index(b"\r\n", at)
        size = int(body[at:line_end].split(b";")[0].strip(), 16)
        at = line_end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("damaged chunk")
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP message without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    framed = any(h.lower().startswith(b"transfer-encoding:") and h.lower().rstrip().endswith(b"chunked") for h in head.split(b"\r\n")[1:])
    return dechunked(body) if framed else body


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def one_line(text: str | None) -> str:
    """A header value: line ends and blanks are escaped."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def segments(headers: list[tuple[str, str]], own: str, block: bytes, size: int) -> Iterator[bytes]:
    """One record, or the first segment and its continuations."""
    if len(block) <= size:
        yield record(headers, block)
        return
    pieces = [block[i:i + size] for i in range(0, len(block), size)]
    yield record([*headers, ("WARC-Segment-Number", "1")], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(pieces) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{own}/{n}>"), ("WARC-Date", DATE),
                      ("WARC-Segment-Origin-ID", f"<{own}>"), ("WARC-Segment-Number", str(n)), *last], piece)


def with_roles(pages: DataFrame, key: str, body: str, least: int = LEAST_REVISITED) -> DataFrame:
    """Add digest (SHA-1 of the UTF-8 payload) and ``original``: the largest key with the same payload of at least
    ``least`` bytes where the row has another one, else null. A row without a key revisits one that has; rows
    that all lack a key, and rows that share the largest one, are originals each."""
    text = F.coalesce(F.col(f"`{body}`"), F.lit(""))
    hashed = pages.withColumn("digest", F.sha1(F.encode(text, "UTF-8")))
    large = hashed.where(F.octet_length(text) >= least)
    several = (large.groupBy("digest").agg(F.max(f"`{key}`").alias("_top"), F.count(F.lit(1)).alias("_n"))
               .where((F.col("_n") > 1) & F.col("_top").isNotNull()).select("digest", "_top"))
    met = hashed.join(several, "digest", "left")
    return met.withColumn("original", F.when((F.octet_length(text) >= least) & ~F.col(f"`{key}`").eqNullSafe(F.col("_top")), F.col("_top"))).drop("_top")


def write_archives(pages: DataFrame, key: str, url: str, body: str, folder: str, segment_bytes: int = SEGMENT_BYTES,
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row into ``.warc.gz`` files, one gzip member per record; returns the manifest, a row per file.

    Null payloads are empty; null addresses are left out of the headers. Rows of one key get records of their own.
    Keys are long integers. Payloads are whole, whatever their size; an empty table gives no file.
    """
    rows = with_roles(pages.select(pages[f"`{key}`"].cast("bigint").alias("key"), pages[f"`{url}`"].cast("string").alias("url"),
                                   pages[f"`{body}`"].alias("body")), "key", "body")

    def run(batches):
        out, records = None, 0
        place = 0
        for batch in batches:
            for part in balanced(batch, "body"):
                for r in part.to_pylist():
                    if out is None:
                        out, records = Written(folder, ".warc.gz"), 0
                    # The file's name makes ids of rows of one key differ.
                    own = f"urn:record:{out.name[:32]}:{place}"
                    place += 1
                    payload = (r["body"] or "").encode()
                    sha = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    headers = [("WARC-Type", "response" if r["original"] is None else "revisit"), ("WARC-Record-ID", f"<{own}>"),
                               ("WARC-Date", DATE), ("Content-Type", "application/http;msgtype=response"),
                               ("WARC-Payload-Digest", f"sha1:{sha}")]
                    if r["url"] is not None:
                        headers.append(("WARC-Target-URI", one_line(r["url"])))
                    if r["key"] is not None:
                        headers.append(("X-Capture-Key", str(r["key"])))
                    if r["original"] is None:
                        made = segments(headers, own, HTTP_HEAD + chunked(payload), segment_bytes)
                    else:
                        made = [record([*headers, ("WARC-Profile", PROFILE), ("X-Refers-To-Key", str(r["original"]))], HTTP_HEAD)]
                    for data in made:
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        out.write(packer.compress(data) + packer.flush())
                        records += 1
                        if out.size >= file_bytes:
                            yield _file_row(out, records)
                            out, records = Written(folder, ".warc.gz"), 0
        if out is not None:
            yield _file_row(out, records)

    return saved(rows.select("key", "url", "body", "digest", "original").mapInArrow(run, "file string, records bigint, bytes bigint"), "archives")


def _file_row(out: Written, records: int) -> pa.RecordBatch:
    out.close()
    return pa.RecordBatch.from_arrays([pa.array([out.name]), pa.array([records], pa.int64()), pa.array([out.size], pa.int64())],
                                      names=["file", "records", "bytes"])


class _Unpacked:
    """Bytes of a file of gzip members, or of plain records, read as far as asked for."""

    def __init__(self, raw):
        self.raw, self.held, self.packer = raw, bytearray(), None
        first = raw.read(2)
        self.zipped, self.rest = first == b"\x1f\x8b", first

    def _more(self) -> bool:
        data, self.rest = self.rest + self.raw.read(1 << 18), b""
        if not data:
            return False
        while self.zipped and data:
            self.packer = self.packer or zlib.decompressobj(31)
            self.held += self.packer.decompress(data)
            data = b""
            if self.packer.eof:
                data, self.packer = self.packer.unused_data, None
        self.held += data
        return True

    def line(self) -> bytes | None:
        """Up to the next line end, without it; None at the end of the file."""
        begin = 0
        while (at := self.held.find(b"\r\n", begin)) < 0:
            begin = max(0, len(self.held) - 1)
            if not self._more():
                if self.held:
                    raise ValueError("damaged record")
                return None
        return self._take(at + 2)[:-2]

    def _take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("damaged record")
        return self._take(n)


def records_in(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, names in lower case, and block of every record."""
    source = _Unpacked(stream)
    while (version := source.line()) is not None:
        if not version.startswith(b"WARC/"):
            raise ValueError("no record begins here")
        headers = {}
        while line := source.line():
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = source.exactly(int(headers["content-length"]))
        if source.exactly(4) != b"\r\n\r\n":
            raise ValueError("damaged record")
        yield headers, block


RECORDS = ("type string, id string, origin string, number int, total bigint, key bigint, refers_to bigint, url string, "
           "claimed string, block binary")
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
_NAMES = [f.split()[0] for f in RECORDS.split(", ")]
HELD_BYTES = 4_000_000


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the files: its headers and block; a segmented record is a row per segment."""
    def run(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with read_stream(folder, name) as stream:
                    for h, block in records_in(stream):
                        number = h.get("warc-segment-number")
                        own = h["warc-record-id"]
                        rows.append((h["warc-type"], own, h.get("warc-segment-origin-id", own if number else None), int(number) if number else None,
                                     _int(h.get("warc-segment-total-length")), _int(h.get("x-capture-key")), _int(h.get("x-refers-to-key")),
                                     h.get("warc-target-uri"), h.get("warc-payload-digest"), block))
                        held += len(block)
                        if held >= HELD_BYTES:
                            yield _record_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _record_batch(rows)

    return one_per_task(manifest.select("file")).mapInArrow(run, RECORDS)


def _int(text: str | None) -> int | None:
    return None if text is None else int(text)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def reassembled(records: DataFrame) -> DataFrame:
    """Rows of :func:`read_archives` with each segmented record in one row.

    Segments may stand in any files and any order. A record whose numbers are not 1 to n, each once, or whose length is
    not the total that the last segment names, has a null block; so has one without its first segment.
    """
    whole = records.where(F.col("number").isNull())
    parts = (records.where(F.col("number").isNotNull()).groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("type", "key", "refers_to", "url", "claimed")]))
    in_order = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("parts"))
    length = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.octet_length(p["block"]))
    joined = F.when(in_order & (length == F.col("total")), F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    one = parts.select("type", F.col("origin").alias("id"), "origin", F.lit(None).cast("int").alias("number"), "total", "key", "refers_to", "url",
                       "claimed", F.unhex(joined).alias("block"))
    return whole.unionByName(one)


def payloads(records: DataFrame) -> DataFrame:
    """(type, key, refers_to, url, claimed, payload_bytes, payload_digest) of whole records: SHA-1 in hex of the unframed
    body, null where a block is null, damaged or belongs to a revisit."""
    def run(batches):
        for batch in batches:
            sizes, digests = [], []
            for kind, block in zip(batch.column("type").to_pylist(), batch.column("block").to_pylist()):
                body = None
                if block is not None and kind != "revisit":
                    try:
                        body = payload_of(block)
                    except ValueError:
                        pass
                sizes.append(None if body is None else len(body))
                digests.append(None if body is None else hashlib.sha1(body).hexdigest())
            kept = [batch.column(c) for c in ("type", "key", "refers_to", "url", "claimed")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                                             names=["type", "key", "refers_to", "url", "claimed", "payload_bytes", "payload_digest"])

    return records.select("type", "key", "refers_to", "url", "claimed", "block").mapInArrow(
        run, "type string, key bigint, refers_to bigint, url string, claimed string, payload_bytes bigint, payload_digest string")


def resolved(found: DataFrame) -> DataFrame:
    """Rows of :func:`payloads` with revisits given size and digest of the response they name, where it has the digest they claim."""
    plain = found.where("type != 'revisit'")
    targets = plain.where(F.col("payload_digest").isNotNull()).groupBy(F.col("key").alias("refers_to"), "claimed").agg(
        F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    again = found.where("type = 'revisit'").drop("payload_bytes", "payload_digest").join(targets, ["refers_to", "claimed"], "left")
    return plain.unionByName(again)


@query("op5_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
top AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM h)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISITED} AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISITED} AND page_id <> best THEN best END AS refers_to
FROM top""")
def op5_warc(spark, folder):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives."""
    target = new_path(spark, "warc")
    manifest = write_archives(table(spark, folder, "pages"), "page_id", "url", "html", target)
    found = saved(payloads(reassembled(read_archives(manifest, target))), "records")
    return resolved(found).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
