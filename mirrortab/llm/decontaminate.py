"""Benchmark decontamination by winnowing.

Of every ``SPAN - GRAM + 1`` consecutive word grams the one with the smallest hash is a fingerprint, so any shared run
of ``SPAN`` words has a fingerprint in common. Fingerprints of documents and items are joined; around each shared one
the windows of ``SPAN`` words that contain it are joined with the windows of the items, which extends the hit to
the whole shared run. Items of fewer words are one window, looked up at every place.

Documents are read once. A bitmap of fixed size, made of the items' fingerprints, lets most fingerprints of documents
go before they leave the map; it only ever passes too many, whatever the number of items, and the joins decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mirrortab.llm.arrays import LOWER, NOT_ALNUM, U64, as_long, balanced, flat, mix, windows, word_hashes, words
from mirrortab.llm.registry import query, table
from mirrortab.llm.scratch import by_verdict, saved

SPAN = 13
GRAM = 9
BITS = 23
SECOND = U64(0xC2B2AE3D27D4EB4F)

CANDIDATE = "fp: bigint, start: int, size: int, wh: bigint, wc: bigint"


def fingerprints(keys: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Whether each gram is the last smallest one of some ``width`` consecutive grams of its text."""
    chosen = np.zeros(len(keys), bool)
    starts = len(keys) - width + 1
    if starts <= 0:
        return chosen
    least, at = keys[:starts].copy(), np.arange(starts)
    for d in range(1, width):
        lower = keys[d:d + starts] <= least
        least = np.where(lower, keys[d:d + starts], least)
        at = np.where(lower, np.arange(d, d + starts), at)
    ends = np.repeat(np.cumsum(counts), counts)
    chosen[at[np.arange(starts) + width <= ends[:starts]]] = True
    return chosen


class Prepared:
    """Hashed words of a slice of texts."""

    def __init__(self, texts: pa.Array):
        data, offsets = flat(texts)
        data = LOWER[data]
        starts, ends, self.counts = words(data, offsets, NOT_ALNUM)
        self.first = np.cumsum(self.counts) - self.counts
        self.hashes = word_hashes(data, starts, ends)
        self.second = mix(self.hashes ^ SECOND)

    def grams(self, size: int, checked: bool = True):
        """Hash, check hash, text and first word within the text of every run of ``size`` words, and the runs per text."""
        keys, at, per_text = windows(self.hashes, self.counts, size, short=False)
        checks = windows(self.second, self.counts, size, short=False)[0] if checked else None
        owner = np.repeat(np.arange(len(self.counts)), per_text)
        return keys, checks, owner, at - self.first[owner], per_text


def _item_rows(items: DataFrame, key: str, text: str, span: int, gram: int) -> DataFrame:
    """(item, size, wh, wc, is_fp): the windows of every item and, marked, its fingerprints."""
    def run(batches):
        for batch in batches:
            for part in balanced(batch, "text"):
                p = Prepared(part.column("text"))
                ids = part.column("item")
                keys, checks, owner, _, _ = p.grams(span)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner)), pa.array(np.full(len(keys), span), pa.int32()), as_long(keys), as_long(checks),
                     pa.array(np.zeros(len(keys), bool))], names=["item", "size", "wh", "wc", "is_fp"])
                keys, _, owner, _, per_text = p.grams(gram, checked=False)
                chosen = fingerprints(keys, per_text, span - gram + 1) & (p.counts[owner] >= span)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner[chosen])), pa.array(np.full(chosen.sum(), gram), pa.int32()), as_long(keys[chosen]),
                     as_long(keys[chosen]), pa.array(np.ones(chosen.sum(), bool))], names=["item", "size", "wh", "wc", "is_fp"])
                for size in range(1, span):
                    lone = p.counts == size
                    if lone.any():
                        keys, checks, owner, _, _ = p.grams(size)
                        mine = lone[owner]
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(owner[mine])), pa.array(np.full(mine.sum(), size), pa.int32()), as_long(keys[mine]),
                             as_long(checks[mine]), pa.array(np.zeros(mine.sum(), bool))], names=["item", "size", "wh", "wc", "is_fp"])

    kind = items.schema[key].dataType.simpleString()
    body = items.select(items[f"`{key}`"].alias("item"), items[f"`{text}`"].alias("text"))
    return body.mapInArrow(run, f"item {kind}, size int, wh bigint, wc bigint, is_fp boolean")


def bitmap(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """2 ** ``bits`` flags, set where some key has that remainder; built in pieces of 4 KB, at most 2 ** bits / 8 bytes in all."""
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    pieces = keys.select(F.bitmap_bucket_number(place).alias("piece"), F.bitmap_bit_position(place).alias("bit")).groupBy("piece").agg(
        F.bitmap_construct_agg("bit").alias("flags"))
    out = np.zeros(1 << bits, bool)
    for r in pieces.toLocalIterator():
        part = np.unpackbits(np.frombuffer(bytes(r["flags"]), np.uint8), bitorder="little")
        begin = (r["piece"] - 1) * len(part)
        out[begin:begin + len(part)] = part[:len(out) - begin]
    return np.packbits(out, bitorder="little")


def flagged(flags: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    place = (keys & U64((1 << bits) - 1)).astype(np.int64)
    return (flags[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _candidates(p: Prepared, flags: np.ndarray, bits: int, sizes: list[int], span: int, gram: int):
    """(text, fingerprint, first word, size, hash, check) of the windows that a flagged fingerprint lies in."""
    found = []
    keys, _, owner, at, per_text = p.grams(gram, checked=False)
    hit = np.flatnonzero(fingerprints(keys, per_text, span - gram + 1) & flagged(flags, keys, bits))
    if len(hit):
        whole, checks, _, _, full = p.grams(span)
        base = np.cumsum(full) - full
        for back in range(span - gram + 1):
            start = at[hit] - back
            ok = (start >= 0) & (start < full[owner[hit]])
            h, start = hit[ok], start[ok]
            where = base[owner[h]] + start
            found.append((owner[h], keys[h], start, np.full(len(h), span), whole[where], checks[where]))
    for size in sizes:
        keys, checks, owner, at, _ = p.grams(size)
        h = np.flatnonzero(flagged(flags, keys, bits))
        found.append((owner[h], keys[h], at[h], np.full(len(h), size), keys[h], checks[h]))
    if not found:
        return [np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64, np.uint64)]
    return [np.concatenate(c) for c in zip(*found)]


def _documents(docs: DataFrame, key: str, text: str, flags: np.ndarray, bits: int, sizes: list[int], span: int, gram: int) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches):
        for batch in batches:
            for part in balanced(batch, "text"):
                p = Prepared(part.column("text"))
                owner, fp, start, size, wh, wc = _candidates(p, shipped.value, bits, sizes, span, gram)
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(len(p.counts) + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays(
                    [as_long(fp[order]), pa.array(start[order], pa.int32()), pa.array(size[order], pa.int32()), as_long(wh[order]), as_long(wc[order])],
                    names=["fp", "start", "size", "wh", "wc"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("digest"), pa.array(p.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), values)],
                    names=["key", "digest", "n_words", "candidates"])

    kind = docs.schema[key].dataType.simpleString()
    body = docs.select(docs[f"`{key}`"].alias("key"), F.xxhash64(docs[f"`{text}`"]).alias("digest"), docs[f"`{text}`"].alias("text"))
    return body.mapInArrow(run, f"key {kind}, digest bigint, n_words bigint, candidates array<struct<{CANDIDATE}>>")


def contamination(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str,
                  span: int = SPAN, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: key, digest (xxhash64 of the text), n_words, n_hit, item_ids (sorted as strings).

    A hit word lies in a run of ``span`` words that an item has too, or in the whole of an item of fewer words. Null
    and empty texts have no words and no hits on either side. Repeated rows get equal rows; an item that stands
    several times counts once, one of null id marks words but is not listed. Empty tables give no rows or no hits.
    """
    windows_of = saved(_item_rows(items, item_key, item_text, span, gram), "items")
    short = sorted(r["size"] for r in windows_of.where(~F.col("is_fp") & (F.col("size") < span)).select("size").distinct().collect())
    prints = windows_of.where(F.col("is_fp") | (F.col("size") < span)).select(F.col("wh").alias("fp")).distinct()
    rows = saved(_documents(docs, key, text, bitmap(prints, "fp", bits), bits, short, span, gram)
                 .withColumn("uid", F.monotonically_increasing_id()), "fingerprints")
    candidates = rows.select("uid", F.inline("candidates"))
    shared = candidates.join(prints, "fp", "left_semi").select("uid", "start", "size", "wh", "wc").distinct()
    known = windows_of.where(~F.col("is_fp"))
    hits = saved(shared.join(known.select("wh", "wc").distinct(), ["wh", "wc"]), "hits")
    runs = hits.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("runs"))
    # Runs in order: words counted so far, and the word after the last one counted.
    covered = F.aggregate(
        "runs", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["upto"], x["start"]))).alias("n"),
                              F.greatest(a["upto"], x["start"] + x["size"]).alias("upto")))["n"]
    named = (hits.select("uid", "wh", "wc").distinct().join(known.select("wh", "wc", F.col("item").cast("string").alias("item")).distinct(), ["wh", "wc"])
             .select("uid", "item").distinct().groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("item_ids")))
    found = runs.select("uid", covered.alias("n_hit")).join(named, "uid", "left")
    out = rows.drop("candidates").join(found, "uid", "left")
    return out.select(F.col("key").alias(key), "digest", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                      F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def is_contaminated(share: int = 20):
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def clean_rows(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """``docs`` without contaminated rows; rows meet their verdict by key and digest, nulls included."""
    bad = (contamination(docs, key, text, items, item_key, item_text).where(is_contaminated())
           .select(F.col(key).alias("_key"), F.col("digest").alias("_digest")).distinct())
    return by_verdict(docs, key, text, bad, "left_anti").select("row.*")


_WORDS = "regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS ws FROM (SELECT doc_id, {_LOWER} AS lower_ascii FROM documents)),
iw AS (SELECT item_id, {_WORDS} AS ws FROM (SELECT item_id, {_LOWER} AS lower_ascii FROM benchmark)),
starts AS (SELECT item_id, least(len(ws), {SPAN}) AS size, ws, unnest(range(1, greatest(len(ws) - {SPAN - 1}, 1) + 1)) AS s FROM iw WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(ws, s, s + size - 1), ' ') AS g FROM starts),
sizes AS (SELECT DISTINCT size FROM win),
places AS (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS s FROM dw, sizes WHERE len(ws) >= size),
occ AS (SELECT doc_id, size, s, array_to_string(list_slice(ws, s, s + size - 1), ' ') AS g FROM places),
hit AS (SELECT DISTINCT doc_id, size, s, g FROM occ SEMI JOIN win USING (size, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, size, g FROM hit) JOIN win USING (size, g) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query("op3_decontaminate", SQL)
def op3_decontaminate(spark, folder):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = contamination(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))
