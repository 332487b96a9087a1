"""Encoding with the tokenizers library, one distinct piece of text at a time.

Texts are cut where the pre-tokenizer cuts in any case: before a single space between two visible characters, and between a
letter and a common sign after it.
The tokens of a text are then those of its pieces in order, so a piece is encoded once per worker and looked up
afterwards. Where the cut is not known to be safe for a vocabulary file, texts stay whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from mirrortab.llm.tables import held

#: Before a space that stands between two visible characters (``\\w`` and ASCII signs are never white space), or after a letter.
SAFE_CUT = re.compile(r"(?<=[!-~\w])(?= [!-~\w])|(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[,.;:!?])")
#: A word, and signs after it, each of which every pre-tokenizer here keeps whole; the letters are their own normal form.
PLAIN_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([,.;:!?]*)")
#: What Python takes for white space beyond the six blanks of ASCII, in the first 256 code points.
ODD_BLANKS = bytes([0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0])
KEPT_PIECES = 500_000
#: Runs of letters and of signs whose ids are kept, where texts are lower-cased and lose their white space.
KEPT_RUNS = 1_000_000
KEPT_LENGTH = 64
CALL_BYTES = 65_536


#: Kinds of the first 256 code points: blanks, letters, signs and digits that no token joins with letters, and the rest.
BLANK, LETTER, SIGN, REST = range(4)
KINDS = np.full(256, REST, np.uint8)
KINDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BLANK
KINDS[0x61:0x7B] = KINDS[0xDF:0xF7] = KINDS[0xF8:0x100] = LETTER
KINDS[0x21:0x41] = KINDS[0x5B:0x61] = KINDS[0x7B:0x7F] = SIGN
KINDS[0x27] = REST  # an apostrophe can begin a token of letters


def drops_spaces(config: dict) -> bool:
    """Whether texts are lower-cased and split into runs of letters, single digits and runs of signs, white space dropped."""
    first = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return bool(first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
                and r"[^\s\p{L}\p{N}]+" in str(first["pattern"].get("Regex")) and config.get("normalizer"))


def cuts_are_safe(config: dict) -> bool:
    """Whether no token can span a space that follows a visible character."""
    if any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in config.get("added_tokens") or []):
        return False
    if config.get("truncation") or config.get("padding"):
        return False
    pre = config.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    if not steps or any(s.get("add_prefix_space") for s in steps):
        return False
    byte_level = steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex", True)
    kinds = {n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])}
    return bool(byte_level or drops_spaces(config)) and kinds <= {"NFC", "Replace", "Lowercase"}


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies have for each byte: itself where it is one, else from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


BYTE_LETTERS = byte_letters()


class Pieces:
    """Encodings of pieces by a ``.json`` vocabulary; ``value`` turns ids into what is kept of them."""

    def __init__(self, path: str, value):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.safe = cuts_are_safe(config)
        # Plain words go straight to the library's merges, past the normaliser and the pre-tokenizer, which leave them whole.
        self.direct = self.safe and (config.get("model") or {}).get("type") == "BPE"
        self.lowered = drops_spaces(config)
        self.added = [t["content"].lower() for t in config.get("added_tokens") or []]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.value, self.known, self.runs = value, {}, {}

    def _parts(self, text: str) -> list[str]:
        if not self.safe:
            return [text] if text else []
        if self.lowered:
            # Case and white space make no difference to this kind of vocabulary, where they are plain.
            low = text.lower()
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                raw = ODD_BLANKS
            if len(raw.translate(None, ODD_BLANKS)) == len(raw) and not any(a in low for a in self.added):
                return low.split()
        return SAFE_CUT.split(text) if text else []

    def _plain(self, text: str) -> bytes | None:
        """The lower-cased text in Latin-1, where case and white space make no difference to this kind of vocabulary; else None."""
        low = text.lower()
        try:
            raw = low.encode("latin-1")
        except UnicodeEncodeError:
            return None
        odd = len(raw.translate(None, ODD_BLANKS)) < len(raw) or any(a in low for a in self.added)
        # A letter whose lower case is one of these, but that is none itself, is left to the library.
        return None if odd or len(low) != len(text) or not _is_latin(text) else raw

    def ids(self, texts: list[str], dtype: str) -> list[np.ndarray]:
        """Ids of each text."""
        out: list = [None] * len(texts)
        plain = [(i, raw) for i, t in enumerate(texts) if self.lowered and self.direct and (raw := self._plain(t)) is not None]
        if plain:
            for (i, _), found in zip(plain, self._runs([raw for _, raw in plain], dtype)):
                out[i] = found
        rest = [i for i, found in enumerate(out) if found is None]
        if rest:
            values, counts = self.values([texts[i] for i in rest])
            ends = np.cumsum(counts)
            for i, end, n in zip(rest, ends.tolist(), counts.tolist()):
                out[i] = np.frombuffer(b"".join(values[end - n:end]), dtype)
        return out

    def _runs(self, texts: list[bytes], dtype: str) -> list[np.ndarray]:
        """Ids of lower-cased Latin-1 texts: runs of letters and of signs are found on whole arrays, each different one is encoded once,
        and the ids of all are gathered by place."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        kind = KINDS[data]
        inside = kind != BLANK
        fresh = np.ones(len(data), bool)
        fresh[1:] = ~inside[:-1]
        fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
        words = np.flatnonzero(fresh & inside)
        # A word with anything but letters and signs stays whole.
        odd = np.add.reduceat(kind == REST, words, dtype=np.int64) > 0 if len(words) else np.zeros(0, bool)
        number = np.cumsum(fresh & inside, dtype=np.int32) - 1
        turns = np.zeros(len(data), bool)
        turns[1:] = kind[1:] != kind[:-1]
        starts = np.flatnonzero(inside & (fresh | turns & ~odd[np.maximum(number, 0)])) if len(words) else words
        place = np.cumsum(inside, dtype=np.int32) - inside  # among the bytes that are not blank
        cuts = np.append(place[starts], inside.sum()).astype(np.int32)
        spans = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[inside].tobytes())])
        coded = spans.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.runs) > KEPT_RUNS:
            self.runs.clear()
        found = list(map(self.runs.get, distinct))
        missing = [i for i, v in enumerate(found) if v is None]
        merged, value = self.model.tokenize, self.value
        for i in missing:
            # Letters of ASCII are what the merges have for them.
            if distinct[i].isalpha():
                found[i] = value([t.id for t in merged(distinct[i].decode("ascii"))])
        others = {i: distinct[i].decode("latin-1") for i in missing if found[i] is None}
        fresh_ids = self._encode(list(others.values()))
        for i, run in others.items():
            found[i] = fresh_ids[run]
        self.runs.update((distinct[i], found[i]) for i in missing if len(distinct[i]) <= KEPT_LENGTH)
        ids = np.frombuffer(b"".join(found), dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        begins = np.cumsum(sizes) - sizes
        at = np.asarray(coded.indices)
        n = sizes[at]
        ends = np.cumsum(n)
        out = ids[np.repeat(begins[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return [out[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def _merged(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_LETTERS))]

    def _encode(self, pieces: list[str]) -> dict:
        out, rest = {}, []
        for p in pieces:
            found = PLAIN_WORD.fullmatch(p) if self.direct else None
            if found is None:
                rest.append(p)
                continue
            word, signs = found.groups()
            ids = self._merged(word.lstrip(" ").lower() if self.lowered else word)
            out[p] = self.value(ids + self._merged(signs) if signs else ids)
        out.update(zip(rest, self._called(rest)))
        return out

    def _called(self, pieces: list[str]) -> list:
        """In calls of about ``CALL_BYTES`` characters."""
        out, begin, held = [], 0, 0
        for i, p in enumerate(pieces):
            held += len(p)
            if held >= CALL_BYTES or i == len(pieces) - 1:
                out += [self.value(e.ids) for e in self.tokenizer.encode_batch_fast(pieces[begin:i + 1], add_special_tokens=False)]
                begin, held = i + 1, 0
        return out

    def values(self, texts: list[str]) -> tuple[list, np.ndarray]:
        """The values of all pieces in order, and the number of pieces per text."""
        parts = list(map(self._parts, texts))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = [p for ps in parts for p in ps]
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        found = list(map(self.known.get, flat))
        missing = [i for i, v in enumerate(found) if v is None]
        fresh = self._encode(list({flat[i] for i in missing}))
        for i in missing:
            found[i] = fresh[flat[i]]
        self.known.update((p, v) for p, v in fresh.items() if len(p) <= KEPT_LENGTH)
        return found, counts


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def loaded(path: str, kind: str, value) -> Pieces:
    """One per worker process."""
    return held(("pieces", path, kind), lambda: Pieces(path, value))
