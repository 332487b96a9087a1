"""Token ids in length-delimited binary records, with a separate index for shuffled reads.

A data file is a run of records, each

    length of the payload   unsigned 64-bit
    masked CRC-32 of these eight bytes   unsigned 32-bit
    payload: the ids, unsigned 16-bit where the vocabulary allows, else 32-bit
    masked CRC-32 of the payload   unsigned 32-bit

all little-endian; masked(c) = ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32, so that checksums of data that hold
checksums stay sound. The index file has one unsigned 64-bit offset per record. Documents are sorted by key over all files:
a range partition is a file, the manifest has its number, and the ids before a file follow from it.
"""

from __future__ import annotations

import struct
import sys
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from mirrortab.llm.arrays import balanced
from mirrortab.llm.files import Written, one_per_task, read_random, read_stream
from mirrortab.llm.pieces import loaded
from mirrortab.llm.registry import query, table
from mirrortab.llm.scratch import new_path, saved

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: A file is closed at about this size and the next one begun.
FILE_BYTES = 256_000_000

#: Bytes of text that are encoded together.
ENCODED_BYTES = 4_000_000

MANIFEST = "part int, piece int, data string, offsets string, keys string, width int, docs bigint, tokens bigint"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframed(stream) -> bytes | None:
    """Next payload of a stream, None at its end; raises where a length or a checksum does not hold."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(zlib.crc32(head[:8])):
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    payload, check = stream.read(size), stream.read(4)
    if len(payload) < size or len(check) < 4 or struct.unpack("<I", check)[0] != masked(zlib.crc32(payload)):
        raise ValueError("damaged record")
    return payload


def payloads(path: str, texts: list[str], end_id: int | None) -> tuple[list[bytes], int]:
    """Ids of each text with the end id, and their width in bytes."""
    width = _width(path)
    last = b"" if end_id is None else int(end_id).to_bytes(width, "little")
    return [ids.tobytes() + last for ids in loaded(path, f"u{width}", _packed(width)).ids(texts, f"<u{width}")], width


def _packed(width: int):
    code = {array(c).itemsize: c for c in "IH"}[width]

    def pack(ids: list[int]) -> bytes:
        out = array(code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    return pack


_widths: dict[str, int] = {}


def _width(path: str) -> int:
    if path not in _widths:
        _widths[path] = 2 if loaded(path, "u2", _packed(2)).vocabulary <= 1 << 16 else 4
    return _widths[path]


def write_records(df: DataFrame, key: str, text: str, path: str, folder: str, end_id: int | None = END_ID,
                  file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of every text in ascending order of ``key``; returns the manifest, one row per file.

    Null keys come first; rows of one key follow each other by a hash of the text, repeated ones too. A null or empty text is a
    record of the end id alone. An empty table gives no files. Other columns are not read. Keys are long integers.
    """
    ordered = (df.select(df[f"`{key}`"].cast("bigint").alias("key"), F.coalesce(df[f"`{text}`"], F.lit("")).alias("text"))
               .repartitionByRange("key").sortWithinPartitions("key", F.xxhash64("text")))

    def run(batches):
        part, piece, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for chunk in balanced(batch, "text", ENCODED_BYTES):
                ids, width = payloads(path, chunk.column("text").to_pylist(), end_id)
                for k, payload in zip(chunk.column("key").to_pylist(), ids):
                    if out is None:
                        out = _Open(folder, width)
                    out.add(k, payload)
                    if out.data.size >= file_bytes:
                        yield out.row(part, piece)
                        piece, out = piece + 1, None
        if out is not None:
            yield out.row(part, piece)

    return saved(ordered.mapInArrow(run, MANIFEST), "manifest")


class _Open:
    """A data file in the making, with its index and keys."""

    def __init__(self, folder: str, width: int):
        self.data, self.folder, self.width = Written(folder, ".records"), folder, width
        self.offsets, self.keys, self.known, self.tokens = [], [], [], 0

    def add(self, key: int | None, payload: bytes) -> None:
        self.offsets.append(self.data.write(framed(payload)))
        self.keys.append(0 if key is None else key)
        self.known.append(key is not None)
        self.tokens += len(payload) // self.width

    def row(self, part: int, piece: int) -> pa.RecordBatch:
        self.data.close()
        index, keys = Written(self.folder, ".index"), Written(self.folder, ".keys")
        index.write(np.array(self.offsets, "<u8").tobytes())
        keys.write(np.array(self.keys, "<i8").tobytes() + np.array(self.known, "u1").tobytes())
        index.close()
        keys.close()
        values = [part, piece, self.data.name, index.name, keys.name, self.width, len(self.offsets), self.tokens]
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)],
                                          names=["part", "piece", "data", "offsets", "keys", "width", "docs", "tokens"])


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``before``: ids in all files ahead of each; one row per file is all that meets."""
    order = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)).cast("bigint"))


def read_records(manifest: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every record, in file order; every length and checksum is verified.

    ids_crc32 is taken over the ids as little-endian unsigned 32-bit integers.
    """
    def run(batches):
        for batch in batches:
            for f in batch.to_pylist():
                keys, known = _keys(folder, f["keys"], f["docs"])
                rows, start, held = [], f["before"], 0
                with read_stream(folder, f["data"]) as stream:
                    for k, real in zip(keys.tolist(), known.tolist()):
                        payload = unframed(stream)
                        if payload is None:
                            raise ValueError("a record is missing")
                        wide = np.frombuffer(payload, "<u2" if f["width"] == 2 else "<u4").astype("<u4")
                        rows.append((k if real else None, start, len(wide), zlib.crc32(wide), wide.tobytes() if ids else None))
                        start, held = start + len(wide), held + len(payload)
                        if len(rows) == 5000 or ids and held >= 4_000_000:
                            yield _batch(rows, ids)
                            rows, held = [], 0
                yield _batch(rows, ids)

    return one_per_task(placed(manifest)).mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if ids else ""))


def _keys(folder: str, name: str, docs: int) -> tuple[np.ndarray, np.ndarray]:
    with read_stream(folder, name) as f:
        raw = f.read()
    return np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "u1", docs, 8 * docs).astype(bool)


def _batch(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + ([pa.binary()] if ids else [])
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      names=["key", "start", "n_tokens", "ids_crc32"] + (["ids"] if ids else []))


def read_at(folder: str, data: str, index: str, numbers: list[int], width: int) -> list[np.ndarray]:
    """Ids of single records by number, through the index file: what a shuffled reader of training data does."""
    with read_random(folder, index) as f:
        offsets = []
        for n in numbers:
            f.seek(8 * n)
            offsets.append(struct.unpack("<Q", f.read(8))[0])
    out = []
    with read_random(folder, data) as f:
        for at in offsets:
            f.seek(at)
            out.append(np.frombuffer(unframed(f), "<u2" if width == 2 else "<u4"))
    return out


@query("op9_token_records")
def op9_token_records(spark, folder):
    """doc_id, start, n_tokens, ids_crc32 of every document, as read back from the files."""
    target = new_path(spark, "records")
    manifest = write_records(table(spark, folder, "documents"), "doc_id", "text", public_tokenizers.path(VOCABULARY), target)
    return read_records(manifest, target).withColumnRenamed("key", "doc_id")
