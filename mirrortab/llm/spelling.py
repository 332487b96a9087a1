"""Groups of spelling variants, by products of letter counts.

Two words one edit apart have letter counts whose squared distance is 1 (a letter more) or 2 (a letter replaced). A matrix product
of the counts of a block of words gives all squared distances in it; pairs at most 2 apart whose lengths are equal or adjacent are
kept, and the edit is verified letter by letter.

Blocks come from lengths and halves: of two words of length L, or L and L + 1, that are one edit apart, one edit can touch one half only,
so they share the first floor(L / 2) letters or the last L - floor(L / 2). A block holds the words of length L and L + 1 with one such half. Words
enter a block four times at most, whatever the number of words. Blocks above ``TILE`` words are cut into tiles, and a task
gets two tiles at a time, so that neither a frequent half nor a task holds more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mirrortab.llm.arrays import balanced
from mirrortab.llm.registry import query, table
from mirrortab.llm.scratch import forget, saved

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A word's form has at least this many times its occurrences.
DOMINANCE = 5
#: One distinct word in so many of a document loses a letter.
TYPO_ONE_IN = 199
#: Words of one tile of a block, and of one product of several small blocks.
TILE = 2048
PACK = 512
#: Words that a task counts before it hands the counts on.
HELD_WORDS = 200_000
#: Characters of a text that are looked at in one go; a word is never cut.
STRETCH = 1_000_000

_LETTERS = "A-Za-zÀ-ÿ"
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def stretches(text: str, size: int = STRETCH):
    """Consecutive parts of a text, each about ``size`` characters, cut where no letter is."""
    gap = re.compile(f"[^{_LETTERS}]")
    begin = 0
    while begin < len(text):
        cut = gap.search(text, min(begin + size, len(text)))
        end = cut.end() if cut else len(text)
        yield text[begin:end]
        begin = end


def ascii_lower(text: str) -> str:
    return text.encode().translate(_ASCII_LOWER).decode()


def word_counts(df: DataFrame, key: str, text: str, least: int = LEAST_LETTERS, typo_one_in: int = TYPO_ONE_IN) -> DataFrame:
    """(word, n): how often each word of ``least`` letters occurs over all rows.

    Words are maximal runs of letters of ASCII and of U+00C0 to U+00FF, with A-Z in lower case. If ``typo_one_in`` divides the
    CRC-32 h of "<key>:<run>", the run loses its letter h mod length there; 0 leaves all as they are. A null key is an empty one.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def counted(batches):
        held: Counter = Counter()
        for batch in batches:
            for part in balanced(batch, "text"):
                for k, body in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                    if not body:
                        continue
                    seed = zlib.crc32(f"{k or ''}:".encode())
                    for stretch in stretches(body):
                        for run, n in Counter(runs.findall(ascii_lower(stretch))).items():
                            h = zlib.crc32(run.encode(), seed) if typo_one_in else 1
                            if typo_one_in and h % typo_one_in == 0:
                                at = h % len(run)
                                run = run[:at] + run[at + 1:]
                                if len(run) < least:
                                    continue
                            held[run] += n
                        if len(held) > HELD_WORDS:
                            yield _counts(held)
                            held = Counter()
        yield _counts(held)

    body = df.select(df[f"`{key}`"].cast("string").alias("key"), df[f"`{text}`"].alias("text"))
    return body.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced between two words, ``b`` no shorter than ``a``."""
    if len(b) - len(a) > 1 or a == b:
        return False
    at, end = 0, len(a)
    while at < end and a[at] == b[at]:
        at += 1
    return a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:]


def letter_counts(words: list[str]) -> np.ndarray:
    """A row per word with how often each letter that the words have occurs in it."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    letters, which = np.unique(points, return_inverse=True)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(owner * len(letters) + which, minlength=len(words) * len(letters)).reshape(len(words), len(letters))
    # Products are exact up to 2**24 in single precision.
    return counts.astype(np.float32 if len(points) == 0 or max(map(len, words)) < 4096 else np.float64)


def close_pairs(words: list[str], block: np.ndarray, base: np.ndarray, split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of words in the same block, the first of length ``base``, the second of this length or one more, at squared distance 1 or 2.

    With ``split`` only pairs of a word before that place and one from it on.
    """
    counts, lengths = letter_counts(words), np.array([len(w) for w in words])
    norms = (counts * counts).sum(axis=1)
    rows = slice(0, split) if split else slice(0, len(words))
    columns = slice(split, len(words)) if split else rows
    apart = norms[rows, None] + norms[None, columns] - 2 * (counts[rows] @ counts[columns].T)
    i, j = np.nonzero(apart <= 2)
    j = j + split
    ok = (block[i] == block[j]) & (i < j)
    i, j = i[ok], j[ok]
    # The shorter one first; two words of length L + 1 belong to the blocks of that length.
    swap = lengths[i] > lengths[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    ok = (lengths[i] == base[i]) & (lengths[j] - lengths[i] <= 1)
    return i[ok], j[ok]


def _blocks(vocabulary: DataFrame) -> DataFrame:
    """(block, base, first, word, n): a word in the blocks of its own length and of one less, by first and by last half."""
    length = F.char_length("word")
    each = vocabulary.select("word", "n", F.explode(F.array(length, length - 1)).alias("base"))
    half = F.expr("base div 2")
    first = F.substring("word", F.lit(1), half.cast("int"))
    last = F.expr("right(word, cast(base - base div 2 as int))")
    each = each.select("word", "n", F.col("base").cast("int").alias("base"), F.explode(F.array(
        F.struct(F.lit(True).alias("first"), first.alias("part")), F.struct(F.lit(False).alias("first"), last.alias("part")))).alias("side"))
    return each.select(F.xxhash64("base", "side.first", "side.part").alias("block"), "base", F.col("side.first").alias("first"), "word", "n")


def near_pairs(vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, na, b, nb): every pair of different words of (word, n) that are one edit apart, once; a is no longer than b."""
    members = saved(_blocks(vocabulary), "blocks")
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.min(F.char_length("word") - F.col("base")).alias("least")).where("m > 1 AND least = 0")
    # Tiles of a large block: a word goes to every pair of tiles with its own.
    tiled = members.join(sizes.select("block", F.ceil(F.col("m") / tile).cast("int").alias("tiles")), "block")
    mine = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    spread = tiled.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = spread.select("block", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "base", "first", "word", "n")
    ordered = placed.repartition("block", "p", "q").sortWithinPartitions("block", "p", "q", "mine")

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                # Whole groups of (block, p, q), several small ones together.
                if len(held) >= PACK and row[:3] != held[-1][:3]:
                    yield _verified(held)
                    held = []
                held.append(row)
        if held:
            yield _verified(held)

    found = saved(ordered.mapInArrow(run, "a string, na bigint, b string, nb bigint"), "near")
    forget(members)
    return found


def _verified(rows: list[tuple]) -> pa.RecordBatch:
    """Near pairs of rows (block, p, q, mine, base, first, word, n) that are sorted by the first four."""
    out: list[tuple] = []
    # Small blocks are one product; two tiles of a large block meet in one of their own.
    begin = 0
    while begin < len(rows):
        two = rows[begin][1] != rows[begin][2]
        end = begin
        while end < len(rows) and (rows[end][:3] == rows[begin][:3] if two else rows[end][1] == rows[end][2]):
            end += 1
        _, p, _, mine, base, first, words, counts = zip(*rows[begin:end])
        # Tiles of one block are told apart here: they meet as pairs of tiles.
        names = {b: i for i, b in enumerate(dict.fromkeys(r[:3] for r in rows[begin:end]))}
        block = np.array([names[r[:3]] for r in rows[begin:end]])
        split = sum(m == p[0] for m in mine) if two else 0
        if not two or 0 < split < len(words):
            for i, j in zip(*[x.tolist() for x in close_pairs(list(words), block, np.array(base), split)]):
                a, b, half = words[i], words[j], base[i] // 2
                # Those that share the first half, too, are found in its block.
                if one_edit(a, b) and (first[i] or a[:half] != b[:half]):
                    out.append((a, counts[i], b, counts[j]))
        begin = end
    columns = list(zip(*out)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2)], names=["a", "na", "b", "nb"])


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word on the way along the forms. A way has no circles, as n grows along it; its steps are doubled."""
    at = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.toDF("via", "next")
        after = saved(at.join(further, at["root"] == further["via"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(at)
        at = after.select("word", "root")
        at._saved_path = after._saved_path
        if after.where("moved").isEmpty():
            return at


def variants(df: DataFrame, key: str, text: str, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
             dominance: int = DOMINANCE, typo_one_in: int = TYPO_ONE_IN, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with ``least_letters`` letters and ``least_count`` occurrences.

    form is the near word (one letter inserted, deleted or replaced) with most occurrences, the first in code-point order of several,
    if it has ``dominance`` times those of the word; root is where forms lead in the end, the word itself without a form.

    Null and empty texts have no words; a null key is an empty one. Repeated rows count each time. Texts are looked at in
    stretches that cut no word, so memory follows the longest word. Empty tables give an empty table; other columns are not read.
    """
    vocabulary = saved(word_counts(df, key, text, least_letters, typo_one_in).where(F.col("n") >= least_count), "vocabulary")
    pairs = near_pairs(vocabulary, tile)
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    strong = -F.col("best.m") >= dominance * F.col("n")
    around = saved(best.select("word", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")), "around")
    ends = roots_of(around.where(F.col("form").isNotNull()).select("word", "form"))
    return (vocabulary.join(around, "word", "left").join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                    F.col("form_n").cast("bigint").alias("form_n")))


@query("op12_spelling_variants")
def op12_spelling_variants(spark, folder):
    """word, form, root, n, n_near, form_n of every word of the documents with 6 letters and 5 occurrences."""
    return variants(table(spark, folder, "documents"), "doc_id", "text")
