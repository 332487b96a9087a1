"""Secrets in texts: fixed patterns, and strings that compression finds new.

Strings in a sensitive context are candidates. Each is measured by what it adds to the compressed size of the code around it, with a
zstandard dictionary of the identifiers that the corpus uses most: a name that is built from known parts adds little, a
random string nearly its own length. Candidates above a share of their length are reported beside the matches of the patterns.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from mirrortab.llm.arrays import balanced
from mirrortab.llm.registry import query, table

#: Kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "novel")

# The patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: What a text must hold in lower case for the first pattern to match at all.
ASSIGNED_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make the characters after them sensitive.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|pwd|secret|token|credential|bearer|auth(?:orization)?|(?:api|access|private|signing|account)[ _-]?key",
                       re.IGNORECASE | re.ASCII)
SENSITIVE_PARTS = ("pass", "pwd", "secret", "token", "credential", "bearer", "auth", "key")
#: A candidate begins at most so many characters after a sensitive word.
REACH = 48
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Text around a candidate that it is compressed with.
BEFORE, AFTER = 256, 64
#: A candidate is new if it adds this percentage of its length, or more.
LEAST_NOVELTY = 70
#: From here on the library looks for short matches thoroughly enough to see known parts in a name of 20 characters.
LEVEL = 12

#: No part of a longer string, so that pieces of secrets do not count.
IDENTIFIER = re.compile(r"\b[A-Za-z_]{4,32}\b", re.ASCII)
#: Identifiers of the dictionary: the most frequent ones over all texts.
DICTIONARY_WORDS = 8192
HELD_WORDS = 200_000
RANKED_PARTS = 64
STRETCH = 1_000_000

#: Parts of names that code has in any corpus; they stand in the dictionary ahead of the counted identifiers.
CODE_WORDS = """
access account action address admin agent application archive args array async attribute authentication author authorization backend
base batch bearer binary boolean bucket buffer builder bundle button bytes cache callback certificate channel child class client
cluster collection column command comment component config configuration connection console container content context control cookie
count create credential credentials custom customer database default delete device digest directory document domain download element
email enable encoding endpoint engine entity environment error event exception expires expression factory field file filter folder
format function gateway generate group handler hash header history hostname http https icon identifier image import index input
instance integer internal interval item json label layout length level library license limit list listener loader local location
logger manager mapping master message metadata method middleware migration model module monitor name network node notification null
number object offset option output owner package parameter password path pattern payment permission pipeline platform plugin policy
private production project property protocol provider proxy public query refresh region remote repository request response route schema
secret secure server service session signature staging storage stream string system table template token transaction update user
username version warehouse webhook worker
""".split()

SPANS = "array<struct<kind: string, start: bigint, end: bigint, novelty: double>>"


@dataclass(frozen=True)
class Limits:
    """When a candidate is reported, and how much text around it is compressed with it."""
    least_novelty: int = LEAST_NOVELTY
    reach: int = REACH
    before: int = BEFORE
    after: int = AFTER
    level: int = LEVEL


def _stretches(text: str, size: int = STRETCH):
    """Parts of a text of about ``size`` characters that cut no identifier."""
    gap, begin = re.compile("[^A-Za-z0-9_]"), 0
    while begin < len(text):
        cut = gap.search(text, min(begin + size, len(text)))
        end = cut.end() if cut else len(text)
        yield text[begin:end]
        begin = end


def identifiers(df: DataFrame, text: str, words: int = DICTIONARY_WORDS) -> list[str]:
    """The ``words`` most frequent identifiers over all texts, ties in code-point order, the most frequent last.

    Whole ones of letters and underscores, so that no secret with digits becomes part of it, however often it is repeated.
    """
    def counted(batches):
        held: Counter = Counter()
        for batch in batches:
            for part in balanced(batch, "text"):
                for body in part.column("text").to_pylist():
                    for stretch in _stretches(body or ""):
                        held.update(IDENTIFIER.findall(stretch))
                        if len(held) > HELD_WORDS:
                            yield _counts(held)
                            held = Counter()
        yield _counts(held)

    counts = df.select(df[f"`{text}`"].alias("text")).mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # The first of each of a fixed number of parts, so that what meets in one place does not grow with the number of tasks.
    within = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("word"), F.lit(RANKED_PARTS))).orderBy(F.desc("n"), "word"))
    firsts = counts.withColumn("rank", within).where(F.col("rank") <= words)
    top = firsts.orderBy(F.desc("n"), "word").limit(words).collect()
    return [r["word"] for r in reversed(top)]


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


class Novelty:
    """Bytes that a string adds to the compressed text around it."""

    def __init__(self, words: list[str], level: int = LEVEL):
        known = " ".join([*CODE_WORDS, *words]).encode()
        primed = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self._compressor.compress(text.encode("utf-8", "surrogatepass")))

    def added(self, before: str, candidate: str, after: str) -> int:
        return self.size(before + candidate + after) - self.size(before + after)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the matches of the patterns that are long enough, by start and kind."""
    out = []
    low = text.lower()
    if any(n in low for n in ASSIGNED_NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: A run of hexadecimal digits is long enough or not as a whole, so the length can stand in the pattern.
_LONG_HEX = re.compile(f"[0-9a-f]{{{LEAST_HEX},}}")


def candidates(text: str, reach: int = REACH):
    """(start, end) of the strings of token characters, with a digit and a letter, that begin shortly after a sensitive word; leftmost, without overlaps."""
    low = text.lower()
    if not any(p in low for p in SENSITIVE_PARTS):
        return
    last = 0
    for word in SENSITIVE.finditer(text):
        begin = max(word.end(), last)
        while found := CANDIDATE.search(text, begin, min(len(text), word.end() + reach + 16)):
            # The window bounds where it begins only.
            found = CANDIDATE.match(text, found.start())
            if found.start() > word.end() + reach:
                break
            begin = last = found.end()
            if any(c.isdigit() for c in found[0]) and any(c.isalpha() for c in found[0]):
                yield found.span()


def spans_of(text: str, novelty: Novelty, limits: Limits = Limits()) -> list[dict]:
    """All spans of a text, by start and kind, in code points, the end exclusive."""
    base = base_spans(text)
    out = [{"kind": k, "start": a, "end": b, "novelty": None} for k, a, b in base]
    taken, at = sorted((a, b) for _, a, b in base), 0
    reached = 0  # the furthest end of base spans that begin before the candidate's end
    for a, b in candidates(text, limits.reach):
        while at < len(taken) and taken[at][0] < b:
            reached = max(reached, taken[at][1])
            at += 1
        if reached > a:
            continue
        added = novelty.added(text[max(0, a - limits.before):a], text[a:b], text[b:b + limits.after])
        if 100 * added >= limits.least_novelty * (b - a):
            out.append({"kind": "novel", "start": a, "end": b, "novelty": added / (b - a)})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


def scan(df: DataFrame, key: str, text: str, words: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """(key, spans) of every row of ``df``: kind, start, end (code points, exclusive) and, of kind ``novel``, the added bytes per character.

    ``words`` are the identifiers of the dictionary; without them they are counted over all texts of ``df``.

    A null or empty text has no spans. Repeated rows each get the same ones; a null key stays null. Spans that begin together are listed in the order of
    ``KINDS``; a candidate that overlaps a match of a pattern is not reported again. Candidates compressing to exactly the limit are. Texts are looked
    at whole and one at a time: a worker holds the text and its spans. An empty table gives an empty one; other columns are not read.
    """
    words = identifiers(df, text) if words is None else words
    known = df.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        novelty = Novelty(known.value, limits.level)
        for batch in batches:
            for part in balanced(batch, "text"):
                spans = [spans_of(t, novelty, limits) if t else [] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(spans, _SPANS)], names=["key", "spans"])

    kind = df.schema[key].dataType.simpleString()
    body = df.select(df[f"`{key}`"].alias("key"), df[f"`{text}`"].alias("text"))
    return body.mapInArrow(run, f"key {kind}, spans {SPANS}").select(F.col("key").alias(key), "spans")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def _joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


@query("op13_secret_scan")
def op13_secret_scan(spark, folder):
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = scan(table(spark, folder, "documents"), "doc_id", "text")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    counts = [F.size(_of_kind(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
