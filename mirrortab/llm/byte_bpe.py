"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation is a finite automaton over character classes. Each character is a function from state to state;
functions compose associatively, so a batch is cut into blocks, every block's function is found for all states at
once, block functions are composed by a doubling scan, and with the state before each block known the states of all
characters follow. Boundaries between slices are read off the states. Slices are looked up in a bounded table of
merged ones. Byte offsets of the tokens are kept, so that a span of ids can be decoded to its place in the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mirrortab.llm.arrays import balanced, flat
from mirrortab.llm.registry import query, table

VOCABULARY = "byte_bpe_50k.tiktoken"
KEPT_SLICES = 500_000
KEPT_LENGTH = 64
#: From this many bytes on a slice is merged with a heap: the library's loop takes quadratic time.
LONG_SLICE = 512
BLOCK = 256

LETTER, NUMBER, OTHER, SPACE, BLANK, MARK1, MARK2 = range(7)
FIRST = 8  # added to the class of a text's first character: whatever came before is forgotten
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)


def _transitions() -> np.ndarray:
    """(state, class) to state; flat, 16 classes per state."""
    t = np.zeros((8, 16), np.uint8)
    for q in range(8):
        t[q, LETTER] = {TWO_LEFT: ONE_LEFT, ONE_LEFT: START}.get(q, IN_LETTERS)
        t[q, NUMBER], t[q, OTHER], t[q, SPACE], t[q, BLANK] = IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK
        joined = q in (IN_OTHERS, AFTER_SPACE)
        t[q, MARK1], t[q, MARK2] = (IN_OTHERS, IN_OTHERS) if joined else (ONE_LEFT, TWO_LEFT)
    t[:, FIRST:] = t[START, :FIRST]
    return t.reshape(-1)


def _begins() -> np.ndarray:
    """Whether a visible character of a class begins a slice, by the state before it."""
    b = np.ones((8, 16), bool)
    b[[IN_LETTERS, AFTER_SPACE, ONE_LEFT, TWO_LEFT], LETTER] = False
    b[[IN_NUMBERS, AFTER_SPACE], NUMBER] = False
    for c in (OTHER, MARK1, MARK2):
        b[[IN_OTHERS, AFTER_SPACE], c] = False
    return b.reshape(-1)


TRANSITIONS, BEGINS = _transitions(), _begins()
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point: letter, number, blank, other."""
    global _classes
    if _classes is None:
        out = np.full(0x110000, OTHER, np.uint8)
        kinds = {"L": LETTER, "N": NUMBER}
        for cp in range(0x110000):
            kind = kinds.get(unicodedata.category(chr(cp))[0])
            if kind is not None:
                out[cp] = kind
        for cp in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            out[cp] = BLANK
        out[0x20] = SPACE
        _classes = out
    return _classes


def scan(codes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """State before each character, by composing the blocks' functions."""
    n = len(codes)
    lanes = -(-n // block)
    grid = np.full(lanes * block, BLANK, np.uint8)
    grid[:n] = codes
    columns = np.ascontiguousarray(grid.reshape(lanes, block).T)
    through = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    for c in columns:
        through = TRANSITIONS[(through << 4) | c[:, None]]
    step = 1
    while step < lanes:
        through[step:] = np.take_along_axis(through[step:], through[:-step].copy(), axis=1)
        step *= 2
    state = np.full(lanes, START, np.uint8)
    state[1:] = through[:-1, START]
    out = np.empty_like(columns)
    for j, c in enumerate(columns):
        out[j] = state
        state = TRANSITIONS[(state << 4) | c]
    return out.T.reshape(-1)[:n]


def slice_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every slice, and the slices per text, for UTF-8 ``data`` of texts cut at ``offsets``."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(docs, np.int64)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    edges = np.searchsorted(chars, offsets)
    first = np.zeros(len(points) + 1, bool)
    first[edges] = True
    first, last = first[:-1], first[1:]
    nxt = np.zeros_like(points)
    nxt[:-1] = np.where(last[:-1], 0, points[1:])
    after = np.zeros_like(points)
    after[:-1] = np.where(last[:-1], 0, nxt[1:])
    mark = points == ord("'")
    if mark.any():
        kind[mark & np.isin(nxt, [ord(x) for x in "stmd"])] = MARK1
        for a, b in ("re", "ve", "ll"):
            kind[mark & (nxt == ord(a)) & (after == ord(b))] = MARK2
    codes = kind + np.where(first, np.uint8(FIRST), np.uint8(0))
    before = scan(codes)
    blank = (kind == SPACE) | (kind == BLANK)
    follows = np.concatenate([[False], blank[:-1]]) & ~first
    precedes = np.concatenate([~blank[1:], [False]]) & ~last
    starts = np.where(blank, ~follows | precedes, BEGINS[(before << 4) | codes] | first)
    at = np.flatnonzero(starts)
    return chars[at], np.diff(np.searchsorted(at, edges))


class Codec:
    """Ids of bytes by a rank file, and back."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("slices", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.known: dict[bytes, bytes] = {}

    def merge_long(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost of equals, with a heap of neighbouring pairs."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        ends, left, right, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        rank = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or right[i] >= n or ends[right[i]] != end:
                continue
            j = right[i]
            alive[j], ends[i], right[i] = False, end, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := rank(piece[i:ends[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[right[i]]))
            k = left[i]
            if k >= 0 and (r := rank(piece[k:end])) is not None:
                heapq.heappush(heap, (r, k, end))
        return [self.ranks[piece[i:ends[i]]] for i in range(n) if alive[i]]

    def merge(self, piece: bytes) -> bytes:
        ids = self.merge_long(piece) if len(piece) >= LONG_SLICE else self.core._encode_single_piece(piece)
        return np.array(ids, "<u4").tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        starts, counts = slice_starts(data, offsets)
        raw = data.tobytes()
        at = starts.tolist()
        slices = [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]
        if len(self.known) > KEPT_SLICES:
            self.known.clear()
        known = self.known
        found = list(map(known.get, slices))
        for i, v in enumerate(found):
            if v is None:
                piece = slices[i]
                v = known.get(piece)
                if v is None:
                    v = self.merge(piece)
                    if len(piece) <= KEPT_LENGTH:
                        known[piece] = v
                found[i] = v
        out, begin = [], 0
        for n in counts.tolist():
            out.append(b"".join(found[begin:begin + n]))
            begin += n
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def token_ends(self, ids: bytes) -> np.ndarray:
        """Byte of the text after each token."""
        return np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _mapped(df: DataFrame, columns: list[str], text: str, make, outputs: str, names: list[str]) -> DataFrame:
    """Columns of ``df`` as they are, plus what ``make`` gives for each slice of texts."""
    body = df.select(F.struct(*[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(columns)]).alias("kept"),
                     df[f"`{text}`"].alias("text"))

    def run(batches):
        for batch in batches:
            for part in balanced(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("kept"), *make(part.column("text"))], names=["kept", *names])

    out = body.mapInArrow(run, f"kept {body.schema['kept'].dataType.simpleString()}, {outputs}")
    return out.select(*[F.col("kept").getField(f"c{i}").alias(c) for i, c in enumerate(columns)], *names)


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids binary, ends array<bigint>): ids as little-endian unsigned 32-bit integers, and where each token ends.

    One row per row of ``df``, in any order; equal rows give equal rows. A null or empty text has no ids, an empty
    table gives an empty one, other columns are not read.
    """
    def make(texts):
        c = codec(path)
        ids = c.encode(*flat(texts))
        ends = [c.token_ends(x) for x in ids]
        cuts = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
        values = pa.array(np.concatenate(ends) if ends else np.zeros(0, np.int64), pa.int64())
        return pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(cuts), values)

    return _mapped(df, [key], text, make, "ids binary, ends array<bigint>", ["ids", "ends"])


def decode(encoded: DataFrame, path: str, first: str | None = None, count: str | None = None) -> DataFrame:
    """Add ``bytes`` to rows of :func:`encode`: the decoded bytes, or those of ``count`` ids from number ``first`` on.

    With a span given, ``begin`` is the byte of the text at which it stands, from the kept offsets. Ids of null give
    null bytes.
    """
    def run(batches):
        c = codec(path)
        for batch in batches:
            out = []
            for i, ids in enumerate(batch.column("ids").to_pylist()):
                if ids is not None and first is not None:
                    a = 4 * batch.column(first)[i].as_py()
                    ids = ids[a:a + 4 * batch.column(count)[i].as_py()]
                out.append(None if ids is None else c.decode(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "bytes"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    out = encoded.mapInArrow(run, f"{fields}, bytes binary")
    if first is None:
        return out
    begin = F.when(F.col(first) == 0, F.lit(0).cast("bigint")).otherwise(F.try_element_at("ends", F.col(first).cast("int")))
    return out.withColumn("begin", begin)


def round_trip(df: DataFrame, columns: list[str], text: str, path: str) -> DataFrame:
    """``columns`` plus n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded from the ids, in one pass.

    Rows are independent of each other; a null text counts as empty.
    """
    def make(texts):
        c = codec(path)
        ids = c.encode(*flat(texts))
        return (pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()))

    return _mapped(df, columns, text, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                   ["n_tokens", "ids_sha256", "decoded_sha256"])


@query("op4_byte_bpe")
def op4_byte_bpe(spark, folder):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return round_trip(table(spark, folder, "documents"), ["doc_id"], "text", public_tokenizers.path(VOCABULARY))
