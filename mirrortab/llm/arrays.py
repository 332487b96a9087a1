"""Arrow batches as flat NumPy arrays: byte-balanced slices, words, hashes of words and of word windows.

A batch of texts is one byte array plus one offset per text; everything here works on whole arrays. Hashes
are 64-bit: a polynomial in the bytes of a word, or in the hashes of a window's words, with a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1_000_000

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
WINDOW_BASE = U64(0xD6E8FEB86659FD93)

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that belong to no word of letters, digits and non-ASCII characters (after lower-casing A-Z).
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _offset_type(values: pa.Array) -> type:
    return np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32


def balanced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch that hold about ``limit`` bytes of ``column``; one text is never cut."""
    texts = batch.column(column)
    if not batch.num_rows:
        return
    offsets = np.frombuffer(texts.buffers()[1], _offset_type(texts))
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the len + 1 offsets into them; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], _offset_type(texts))[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 4096)
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, BASE))])
    return _powers[:n]


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the words per text, where ``gaps`` marks the bytes between words."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(docs, np.int64)
    inside = ~gaps[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, np.flatnonzero(ends) + 1, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], lengths)
    values = BYTE_VALUES[data[np.repeat(starts, lengths) + place]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first[:-1]) + lengths.astype(np.uint64))


def _weights(size: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, WINDOW_BASE))])


def windows(hashes: np.ndarray, counts: np.ndarray, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first word of every window of ``size`` words, and the windows per text.

    A text of fewer words, but not none, has one window of all its words if ``short``.
    """
    total = len(hashes)
    sums = np.zeros(total, np.uint64)
    weights = _weights(size)
    for k in range(min(size, total)):
        sums[:total - k] += hashes[k:] * weights[k]
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    full = np.maximum(counts - size + 1, 0)
    lone = (counts > 0) & (counts < size) if short else np.zeros(len(counts), bool)
    per_text = full + lone
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(per_text)[:-1]]), per_text) + np.arange(per_text.sum())
    out = mix(sums[at] + U64(size)) if total else np.zeros(0, np.uint64)
    if lone.any():
        where = np.cumsum(per_text) - per_text
        for i in np.flatnonzero(lone):
            part = hashes[first[i]:first[i + 1]]
            out[where[i]] = mix(np.array([(part * weights[:len(part)]).sum() + U64(len(part))], np.uint64))[0]
    return out, at, per_text


def text_digest(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit hash per text, the same for equal bytes only (but for chance)."""
    import hashlib
    raw = data.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little")
                     for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())
