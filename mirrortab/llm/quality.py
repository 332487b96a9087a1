"""Quality rules: repetition inside a text, and lines that stand in many documents of a host.

One map over the texts gives counts per row and one hash and word count per normalised line. Hashes of the lines
of a host are then counted over its different documents, map side first; a line above the limit counts as removed
from every document of that host, and a document that has too little left is rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mirrortab.llm.arrays import SPACES, U64, balanced, flat, mix, text_digest, windows, word_hashes, words
from mirrortab.llm.registry import query, table
from mirrortab.llm.scratch import by_verdict, saved

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent
#: A line is above the limit in more than so many different documents of a host, whatever the size of the host.
LINE_DOCS = 20
#: A document is depleted with fewer words left than ``LEAST_WORDS``, or over this share of them removed.
MOST_REMOVED = 0.8

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_DIGITS = re.compile("[0-9]+")


def line_key(line: str) -> bytes:
    """Lower case, runs of digits as one 0, single blanks."""
    return b" ".join(_DIGITS.sub("0", line.lower()).encode().split())


def line_hashes(keys: list[bytes]) -> np.ndarray:
    cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
    return text_digest(np.frombuffer(b"".join(keys), np.uint8), cuts).view(np.int64)


def repeated_words(hashes: np.ndarray, counts: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Words per text that lie in a window which its text has twice or more."""
    docs = len(counts)
    keys, at, per_text = windows(hashes, counts, size, short=False)
    if not len(keys):
        return np.zeros(docs, np.int64)
    owner = np.repeat(np.arange(docs), per_text)
    _, where, number = np.unique(mix(keys + owner.astype(np.uint64) * U64(0xA24BAED4963EE407)), return_inverse=True, return_counts=True)
    begins = at[number[where] > 1]
    marks = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(marks, begins, 1)
    np.add.at(marks, begins + size, -1)
    covered = np.cumsum(marks[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(covered)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def _measure(texts: pa.Array) -> dict[str, pa.Array]:
    data, offsets = flat(texts)
    starts, ends, counts = words(data, offsets, SPACES)
    hashes = word_hashes(data, starts, ends)
    doc_of_word = np.repeat(np.arange(len(counts)), counts)
    # Code points are the bytes that continue none.
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.bincount(doc_of_word, heads[ends] - heads[starts], len(counts)).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    repeated = repeated_words(hashes, counts)
    raw = data.tobytes()
    duplicates, keys, sizes, per_doc = [], [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        seen, again, kept = set(), 0, 0
        for line in raw[a:b].split(b"\n"):
            n = len(line.split())
            if not n:
                continue
            again += line in seen
            seen.add(line)
            keys.append(line_key(line.decode("utf-8")))
            sizes.append(n)
            kept += 1
        duplicates.append(again)
        per_doc.append(kept)
    cuts = pa.array(np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32))
    lines = pa.StructArray.from_arrays([pa.array(line_hashes(keys), pa.int64()), pa.array(sizes, pa.int32())], names=["h", "w"])
    return {"n_words": pa.array(counts, pa.int64()),
            "word_chars": pa.array(chars), "n_symbols": pa.array(symbols[offsets[1:]] - symbols[offsets[:-1]], pa.int64()),
            "n_dup_lines": pa.array(duplicates, pa.int64()), "n_repeat_words": pa.array(repeated, pa.int64()),
            "lines": pa.ListArray.from_arrays(cuts, lines)}


MEASURES = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
            "lines array<struct<h: bigint, w: int>>")


def measured(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """key, host and the counts of each row; bytes.split() and words use the same six blanks of ASCII."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in balanced(batch, "text"):
                found = _measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("host"), part.column("digest"), *found.values()],
                                                 names=["key", "host", "digest", *found])

    body = df.select(df[f"`{key}`"].alias("key"), F.coalesce(df[f"`{host}`"].cast("string"), F.lit("")).alias("host"),
                     F.xxhash64(df[f"`{text}`"]).alias("digest"), df[f"`{text}`"].alias("text"))
    return body.mapInArrow(run, f"key {kind}, host string, digest bigint, {MEASURES}")


def common_lines(rows: DataFrame, docs: int = LINE_DOCS) -> DataFrame:
    """(host, h) of the lines above the limit; documents with equal texts count once."""
    once = rows.select("host", "digest", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    spread = once.groupBy("host", "h", "digest").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("one").alias("n"))
    return spread.where(F.col("n") > docs).select("host", "h")


def verdicts(df: DataFrame, key: str, text: str, host: str, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED,
             line_docs: int = LINE_DOCS, most_removed: float = MOST_REMOVED) -> DataFrame:
    """One row per row of ``df``: key, digest of the text (its xxhash64), the base counts, the
    hashes of its removed lines and the words in them, base_failed, kept.

    A null text has no words and fails; a null host counts as the host ''. Repeated rows each get a row with the same
    verdict, and documents with equal texts count once towards a line's limit, so copies never make their own
    lines common. A line is compared in lower case with digits as one 0 and single blanks. An empty table
    gives an empty one; other columns are not read.
    """
    rows = saved(measured(df, key, text, host).withColumn("uid", F.monotonically_increasing_id()), "quality")
    common = common_lines(rows, line_docs)
    lines = rows.select("uid", "host", F.explode("lines").alias("line")).select("uid", "host", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    removed = lines.join(common, ["host", "h"]).groupBy("uid").agg(
        F.sum("w").alias("n_removed_words"), F.collect_set("h").alias("removed"))
    out = rows.drop("lines", "host").join(removed, "uid", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("bigint"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < least_words) | (F.col("n_removed_words") > F.col("n_words") * most_removed)
    return out.select(F.col("key").alias(key), "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "n_removed_words", "removed", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def cleaned(df: DataFrame, key: str, text: str, host: str, **limits) -> DataFrame:
    """The kept rows of ``df``, with the lines above the limits taken out of ``text``; other columns stay as they are.

    Rows meet their verdict by key and digest, so repeated rows stay repeated and null keys find theirs.
    """
    found = verdicts(df, key, text, host, **limits).where("kept").groupBy(F.col(key).alias("_key"), F.col("digest").alias("_digest")).agg(
        F.first("removed").alias("_removed"))
    met = by_verdict(df, key, text, found)

    @F.pandas_udf("string")
    def without(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([t if gone is None or t is None else _without(t, set(gone)) for t, gone in zip(texts, removed)], dtype=object)

    row = F.col("row")
    return met.select(*[without(row[c], F.col("_removed")).alias(c) if c == text else row[c].alias(c) for c in df.columns])


def _without(text: str, gone: set[int]) -> str:
    lines = text.split("\n")
    keys = [line_key(x) for x in lines]
    return "\n".join(x for x, k, h in zip(lines, keys, line_hashes(keys).tolist()) if not k or h not in gone)


SQL = f"""
WITH d AS (SELECT doc_id, text, coalesce(source, '') AS host, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents),
base AS (SELECT doc_id, host, text, len(ws) AS n_words, CAST(length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
raw AS (SELECT doc_id, host, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
lines AS (SELECT doc_id, host, text, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS k,
  len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) AS w FROM raw WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
grams AS (SELECT doc_id, i, string_agg(word, ' ') OVER g AS gram, count(*) OVER g AS n FROM pos
  WINDOW g AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams WHERE n = {WINDOW}),
rep AS (SELECT doc_id, count(DISTINCT i + s.s) AS n_repeat_words FROM twice, (SELECT unnest(range({WINDOW})) AS s) s WHERE c > 1 GROUP BY doc_id),
common AS (SELECT host, k FROM lines GROUP BY host, k HAVING count(DISTINCT text) > {LINE_DOCS}),
removed AS (SELECT doc_id, CAST(sum(w) AS BIGINT) AS n_removed_words FROM lines JOIN common USING (host, k) GROUP BY doc_id),
facts AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_removed_words, 0) AS gone FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words OR n_words - gone < {LEAST_WORDS} OR gone > n_words * {MOST_REMOVED}) AS kept
FROM facts"""


@query("op8_quality_rules", SQL)
def op8_quality_rules(spark, folder):
    """doc_id, the counts, base_failed and kept of every document; a host is a source."""
    return verdicts(table(spark, folder, "documents"), "doc_id", "text", "source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
