"""Near duplicates by HyperMinHash.

A text is the set of its word shingles. Each of ``REGISTERS`` buckets keeps the smallest of its hashes of the set, as a
count of leading zeros and ``MANTISSA`` bits after them. Texts with equal sets are one class. Classes that agree on all
registers of a band meet in a bucket; candidates whose estimated similarity, corrected for chance collisions, cannot
reach the threshold go, and the rest are confirmed by intersecting the full sets.

Only links that can still change the components are looked for. First every class meets the smallest class it shares
a bucket with. Then the buckets that still hold several components are compared as a whole, by matrix products: a block of classes is one
table of registers, whose estimates say which pairs across components are worth it, and one incidence matrix of the shingles that
several of them have, whose product counts the intersections exactly. Large buckets are cut into tiles, of which a task gets two at a time, those of the
largest component with those outside it only, and a block hands on
only as many links as join components. So a group of copies above the threshold costs rows in proportion to its size; one of texts
just below it, which share buckets but no links, costs its products, but no rows. No link between components is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mirrortab.llm.arrays import LOWER, SPACES, U64, as_long, balanced, flat, mix, windows, word_hashes, words
from mirrortab.llm.components import components
from mirrortab.llm.decontaminate import bitmap, flagged
from mirrortab.llm.registry import query, table
from mirrortab.llm.scratch import by_verdict, forget, saved
from mirrortab.llm.tables import release

SHINGLE = 5
#: Percent of the union that two sets share at least.
SIMILAR = 80
REGISTERS = 160
BAND = 5
MANTISSA = 10
#: Candidates estimated this far below the threshold are dropped: five standard errors of the estimate.
SLACK = 5.0
#: Classes, and bytes of their shingles, of a tile of a large bucket; small buckets are compared together up to ``PACK`` classes.
TILE = 512
TILE_BYTES = 8_000_000
PACK = 256
#: Shingles of one matrix product.
COLUMNS = 4096
BITS = 23

_rng = np.random.Generator(np.random.PCG64(71))
FACTORS = _rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)
BAND_SALTS = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


class Sets:
    """Distinct shingle hashes of a slice of texts, sorted within each text."""

    def __init__(self, texts: pa.Array, shingle: int):
        data, offsets = flat(texts)
        data = LOWER[data]
        starts, ends, counts = words(data, offsets, SPACES)
        keys, _, per_text = windows(word_hashes(data, starts, ends), counts, shingle)
        owner = np.repeat(np.arange(len(counts)), per_text)
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        self.keys = keys[new]
        self.sizes = np.bincount(owner[new], minlength=len(counts))
        self.cuts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums that name each set."""
        a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.keys ^ BAND_SALTS[0]), dtype=np.uint64)])
        b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.keys ^ BAND_SALTS[1]), dtype=np.uint64)])
        return a[self.cuts[1:]] - a[self.cuts[:-1]], b[self.cuts[1:]] - b[self.cuts[:-1]]

    def sketches(self, registers: int) -> np.ndarray:
        """A row of registers per text with shingles; rows of empty texts are zero."""
        out = np.zeros((len(self.sizes), registers), np.uint16)
        full = np.flatnonzero(self.sizes)
        if not len(full):
            return out
        short, begins = (self.keys >> U64(32)).astype(np.uint32), self.cuts[:-1][full]
        least = np.empty((registers, len(full)), np.uint32)
        for i in range(registers):
            least[i] = np.minimum.reduceat(short * FACTORS[i] + SHIFTS[i], begins)
        out[full] = compressed(least).T
        return out


def compressed(x: np.ndarray) -> np.ndarray:
    """Leading zeros of 32-bit values above the ``MANTISSA`` bits that follow the first one."""
    top = np.frexp(x.astype(np.float64))[1]  # bits in use; 0 for 0
    zeros = 32 - top
    body = (x.astype(np.uint64) << zeros.astype(np.uint64)) & U64(0x7FFFFFFF)
    return ((zeros.astype(np.uint64) << U64(MANTISSA)) | (body >> U64(31 - MANTISSA))).astype(np.uint16)


def collision_share(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Chance that registers of disjoint sets of these sizes agree.

    The smallest of n hashes is about exponential with rate n; the chance is summed over the cells of the register.
    """
    zeros = np.arange(0, 33)
    low, width = 2.0 ** -(zeros + 1.0), 2.0 ** -(zeros + 1.0) / 2 ** MANTISSA
    middle = low * 1.5
    n, m = na[:, None].astype(float), nb[:, None].astype(float)
    dense = n * m * np.exp(-(n + m) * middle) * width * width * 2 ** MANTISSA
    return np.minimum(dense.sum(axis=1), 0.5)


def estimated(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal registers, chance agreements taken off."""
    share = (a == b).mean(axis=1)
    chance = collision_share(na, nb)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def sketched(df: DataFrame, key: str, text: str, shingle: int, registers: int = REGISTERS) -> DataFrame:
    """(key, digest, n, a, b, regs) of each row: size and name of its set, and its registers."""
    def run(batches):
        release()
        for batch in batches:
            for part in balanced(batch, "text"):
                sets = Sets(part.column("text"), shingle)
                a, b = sets.names()
                regs = sets.sketches(registers)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("digest"), pa.array(sets.sizes, pa.int64()), as_long(a), as_long(b),
                     pa.array([r.tobytes() for r in regs], pa.binary())], names=["key", "digest", "n", "a", "b", "regs"])

    kind = df.schema[key].dataType.simpleString()
    body = df.select(df[f"`{key}`"].alias("key"), F.xxhash64(df[f"`{text}`"]).alias("digest"), df[f"`{text}`"].alias("text"))
    return body.mapInArrow(run, f"key {kind}, digest bigint, n bigint, a bigint, b bigint, regs binary")


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = flat(column)
    return data.view(np.uint16).reshape(len(column), -1)


def _bands(classes: DataFrame, band: int) -> DataFrame:
    """(node, n, bucket) of every class and band."""
    def run(batches):
        for batch in batches:
            regs = _matrix(batch.column("regs")).astype(np.uint64)
            for j in range(regs.shape[1] // band):
                h = np.full(len(regs), BAND_SALTS[j], np.uint64)
                for k in range(band):
                    h = mix(h ^ (regs[:, j * band + k] + U64(1)) * U64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), as_long(h)], names=["node", "n", "bucket"])

    return classes.select("node", "n", "regs").mapInArrow(run, "node bigint, n bigint, bucket bigint")


def _likely(pairs: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """Pairs whose sizes and registers allow the similarity."""
    one = classes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("regs").alias("ru"))
    two = classes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("regs").alias("rv"))
    met = pairs.join(one, "u").join(two, "v").where(100 * F.least("nu", "nv") >= similar * F.greatest("nu", "nv"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ru, rv = _matrix(batch.column("ru")), _matrix(batch.column("rv"))
                s = similar / 100
                guess = estimated(ru, rv, np.asarray(batch.column("nu")), np.asarray(batch.column("nv")))
                ok = guess >= s - SLACK * np.sqrt(s * (1 - s) / ru.shape[1])
                yield batch.select(["u", "v"]).filter(pa.array(ok))

    return met.select("u", "v", "nu", "nv", "ru", "rv").mapInArrow(run, "u bigint, v bigint")


def _full_sets(df: DataFrame, key: str, text: str, shingle: int, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted classes, from one source row each.

    A bitmap of fixed size over those rows' hashes thins the second reading; the join decides.
    """
    chosen = wanted.join(classes, "node").select("node", "at", "n")
    flags = df.sparkSession.sparkContext.broadcast(bitmap(chosen, "at", BITS))

    def run(batches):
        for batch in batches:
            hit = flagged(flags.value, np.asarray(batch.column("at")).view(np.uint64), BITS)
            batch = batch.filter(pa.array(hit))
            for part in balanced(batch, "text"):
                sets = Sets(part.column("text"), shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column("at"), pa.ListArray.from_arrays(pa.array(sets.cuts.astype(np.int32)), as_long(sets.keys))], names=["at", "shingles"])

    body = df.select(_place(df[f"`{key}`"], F.xxhash64(df[f"`{text}`"])).alias("at"), df[f"`{text}`"].alias("text"))
    found = body.mapInArrow(run, "at bigint, shingles array<bigint>")
    # Two rows of one hash are told apart by the size of the set; equal rows are taken once.
    return (found.join(chosen, (found["at"] == chosen["at"]) & (F.size("shingles") == chosen["n"])).select("node", "shingles").dropDuplicates(["node"]))


def _place(key, digest):
    return F.xxhash64(key, digest)


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    one, two = sets.toDF("u", "su"), sets.toDF("v", "sv")
    shared = F.size(F.array_intersect("su", "sv")).cast("bigint")
    met = pairs.join(one, "u").join(two, "v").select("u", "v", shared.alias("both"), (F.size("su") + F.size("sv")).alias("sum"))
    return met.where(100 * F.col("both") >= similar * (F.col("sum") - F.col("both"))).select("u", "v")


def _shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal registers of each row of ``a`` with each row of ``b``."""
    equal = np.zeros((len(a), len(b)), np.uint16)
    for i in range(a.shape[1]):
        equal += a[:, i, None] == b[None, :, i]
    return equal / a.shape[1]


def _intersections(keys: np.ndarray, cuts: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``rows`` with the sets ``columns``, by products of incidence matrices."""
    def gathered(which):
        sizes = cuts[which + 1] - cuts[which]
        at = np.repeat(cuts[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return keys[at], np.repeat(np.arange(len(which)), sizes)

    (ka, oa), (kb, ob) = gathered(rows), gathered(columns)
    # Shingles on one side only are in no intersection.
    shared = np.intersect1d(ka, kb)
    out = np.zeros((len(rows), len(columns)))
    for first in range(0, len(shared), COLUMNS):
        part = shared[first:first + COLUMNS]

        def incidence(k, owner, size):
            at = np.minimum(np.searchsorted(part, k), len(part) - 1)
            hit = part[at] == k
            m = np.zeros((size, len(part)), np.float32)
            m[owner[hit], at[hit]] = 1
            return m

        out += incidence(ka, oa, len(rows)) @ incidence(kb, ob, len(columns)).T
    return out


def joining_links(block: np.ndarray, root: np.ndarray, n: np.ndarray, regs: np.ndarray, keys: np.ndarray, cuts: np.ndarray, similar: int,
                  split: int = 0) -> list[tuple[int, int]]:
    """Places of pairs in the same block that are linked, as many as it takes to join the components (``root``) that are linked.

    With ``split`` only pairs of a class before that place with one from it on.
    """
    rows, columns = np.arange(split or len(root)), np.arange(split, len(root))
    s = similar / 100
    slack = SLACK * np.sqrt(s * (1 - s) / regs.shape[1])
    small, large = np.minimum(n[rows, None], n[None, columns]), np.maximum(n[rows, None], n[None, columns])
    ok = (block[rows, None] == block[None, columns]) & (root[rows, None] != root[None, columns]) & (100 * small >= similar * large)
    if not split:
        ok &= rows[:, None] < columns[None, :]
    if not ok.any():
        return []
    # The estimate is no more than the share of equal registers.
    i, j = np.nonzero(ok & (_shares(regs[rows], regs[columns]) >= s - slack))
    j = columns[j]
    if not len(i):
        return []
    good = np.concatenate([estimated(regs[i[k:k + 4096]], regs[j[k:k + 4096]], n[i[k:k + 4096]], n[j[k:k + 4096]]) for k in range(0, len(i), 4096)]) >= s - slack
    i, j = i[good], j[good]
    if not len(i):
        return []
    a, b = np.unique(i), np.unique(j)
    both = _intersections(keys, cuts, a, b)[np.searchsorted(a, i), np.searchsorted(b, j)]
    linked = 100 * both >= similar * (n[i] + n[j] - both)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    out = []
    for x, y in zip(i[linked].tolist(), j[linked].tolist()):
        p, q = top(int(root[x])), top(int(root[y]))
        if p != q:
            above[p] = q
            out.append((x, y))
    return out


def _compared(blocks: DataFrame, similar: int) -> DataFrame:
    """(u, v): links that join components, over rows (bucket, p, q, mine, root, node, n, regs, shingles) in the order of the first four."""
    def flushed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        bucket, p, q, mine, root, node, n = (np.asarray(t.column(c).chunk(0)) for c in ("bucket", "p", "q", "mine", "root", "node", "n"))
        lists = t.column("shingles").chunk(0)
        keys = np.asarray(lists.flatten()).view(np.uint64)
        cuts = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))])
        regs = _matrix(t.column("regs").chunk(0))
        new = np.ones(len(node), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        block = np.cumsum(new)
        pairs = []
        # Whole buckets and tiles with themselves are compared at once, two tiles of a bucket apart.
        within = np.flatnonzero(p == q)
        parts = [(within, 0)] if len(within) else []
        for b in np.unique(block[p != q]).tolist():
            at = np.flatnonzero(block == b)
            first = int((mine[at] == p[at[0]]).sum())
            if 0 < first < len(at):
                parts.append((at, first))
        for at, split in parts:
            sizes = cuts[at + 1] - cuts[at]
            own = np.concatenate([[0], np.cumsum(sizes)])
            mine_keys = keys[np.repeat(cuts[at] - own[:-1], sizes) + np.arange(own[-1])]
            found = joining_links(block[at], root[at], n[at], regs[at], mine_keys, own, similar, split)
            pairs += [(node[at[x]], node[at[y]]) for x, y in found]
        u, v = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches):
        held, rows, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.array([np.asarray(batch.column(c)).astype(np.int64) for c in ("bucket", "p", "q")])
            changes = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            begin = 0
            for at in [*([0] if last is not None and (key[:, 0] != last).any() else []), *changes.tolist()]:
                if rows + at - begin >= PACK:
                    if at > begin:
                        held.append(batch.slice(begin, at - begin))
                    yield flushed(held)
                    held, rows, begin = [], 0, at
            held.append(batch.slice(begin))
            rows += batch.num_rows - begin
            last = key[:, -1]
        if held:
            yield flushed(held)

    return blocks.mapInArrow(run, "u bigint, v bigint")


def links_of(df: DataFrame, key: str, text: str, shingle: int, similar: int, classes: DataFrame, band: int) -> DataFrame:
    """(node, root) of the components among classes."""
    sketches = classes.where("n > 0")
    crowded = _bands(sketches, band).groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("low")).where("m > 1").select("bucket", "low")
    members = saved(_bands(sketches, band).join(crowded, "bucket"), "members")
    pivots = members.groupBy("node").agg(F.min("low").alias("v"))
    pairs = pivots.where(F.col("node") != F.col("v")).select(F.col("node").alias("u"), "v")
    likely = saved(_likely(pairs, sketches, similar), "pairs")
    sets = saved(_full_sets(df, key, text, shingle, classes, members.select("node").distinct()), "sets")
    links = saved(_confirmed(likely, sets, similar), "links")
    forget(likely)
    roots = saved(components(links), "roots")
    forget(links)
    tagged = members.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    tagged = saved(tagged, "tagged")
    forget(members)
    # Buckets of several components, with their largest one; of buckets with the same classes, one.
    each = tagged.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                                F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 24)).alias("y"))
    facts = each.groupBy("bucket").agg(F.sum("m").alias("m"), F.sum("total").alias("total"), F.bit_xor("x").alias("x"), F.sum("y").alias("y"),
                                       F.count(F.lit(1)).alias("roots"), F.max(F.struct("m", "root", "total")).alias("main")).where("roots > 1")
    several = facts.groupBy("m", "total", "x", "y").agg(F.min(F.struct("bucket", "main")).alias("one")).select("one.bucket", "one.main", "m", "total")

    def tiles(m, total):
        return F.greatest(F.ceil(m / TILE), F.ceil(8 * total / TILE_BYTES)).cast("int")

    # Classes of the largest component, in the first tiles of a large bucket, meet those outside it only; a small bucket is one tile.
    sized = several.select("bucket", F.col("main.root").alias("main"), tiles(F.col("m"), F.col("total")).alias("tiles"),
                           tiles(F.col("main.m"), F.col("main.total")).alias("inner"), tiles(F.col("m") - F.col("main.m"), F.col("total") - F.col("main.total")).alias("outer"))
    one, inner, outer, spot = F.col("tiles") == 1, F.col("inner"), F.col("outer"), F.xxhash64("node")
    is_main = F.col("root") == F.col("main")
    mine = F.when(one, F.lit(0)).when(is_main, F.pmod(spot, inner)).otherwise(inner + F.pmod(spot, outer)).cast("int")
    others = (F.when(one, F.array(F.lit(0))).when(is_main, F.sequence(inner, inner + outer - 1)).otherwise(F.sequence(F.lit(0), inner + outer - 1)))
    spread = tagged.join(sized, "bucket").withColumn("mine", mine).withColumn("other", F.explode(others))
    placed = spread.select("bucket", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "root", "node", "n")
    whole = placed.join(sketches.select("node", "regs"), "node").join(sets, "node")
    ordered = (whole.select("bucket", "p", "q", "mine", "root", "node", "n", "regs", "shingles")
               .repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "mine"))
    new = saved(_compared(ordered, similar), "links")
    forget(tagged)
    forget(sets)
    if new.isEmpty():
        return roots
    # Known components stand in for the links they came from.
    final = saved(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new)), "roots")
    forget(roots)
    forget(new)
    return final


def groups(df: DataFrame, key: str, text: str, shingle: int = SHINGLE, similar: int = SIMILAR, band: int = BAND) -> DataFrame:
    """One row per row of ``df``: key, digest (xxhash64 of the text), n_shingles, component_id, kept, picked.

    Texts with equal sets are linked, and texts whose sets share at least ``similar`` percent of their union. component_id
    is the smallest key that links reach, the own one included; a null key counts only where its group has no
    other. kept: the key is that smallest one. picked: of one row text per group, the first by key and digest. A text of
    fewer words than a shingle is one shingle; null and empty texts have none and stand alone, each row by itself.
    Repeated rows are linked to each other. An empty table gives an empty one; other columns are not read.
    """
    rows = saved(sketched(df, key, text, shingle), "sketches")
    # One class per set; its source row for the full set is that of the smallest hash.
    classes = saved(rows.where("n > 0").groupBy("a", "b", "n").agg(
        F.min(_place(F.col("key"), F.col("digest"))).alias("at"), F.first("regs").alias("regs"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = links_of(df, key, text, shingle, similar, classes, band)
    named = classes.select("a", "b", "n", "node").join(roots, "node", "left").select("a", "b", "n", F.coalesce("root", "node").alias("root"))
    placed = saved(rows.select("key", "digest", "n", "a", "b").where("n > 0").join(named, ["a", "b", "n"]).select("key", "digest", "n", "root"), "placed")
    lone = saved(rows.where("n = 0").select("key", "digest", "n"), "lone")
    for done in (rows, classes, roots):
        forget(done)
    first = placed.groupBy("root").agg(F.min("key").alias("low"), F.min(F.struct(F.col("key").isNull().alias("no"), "key", "digest")).alias("pick"))
    out = placed.join(first, "root").select(
        F.col("key").alias(key), "digest", F.col("n").alias("n_shingles"), F.col("low").alias("component_id"), F.col("key").eqNullSafe(F.col("low")).alias("kept"),
        (F.col("key").eqNullSafe(F.col("pick.key")) & (F.col("digest") == F.col("pick.digest"))).alias("picked"))
    alone = lone.select(F.col("key").alias(key), "digest", F.col("n").alias("n_shingles"), F.col("key").alias("component_id"),
                                       F.lit(True).alias("kept"), F.lit(True).alias("picked"))
    return out.unionByName(alone)


def one_per_group(df: DataFrame, key: str, text: str, **how) -> DataFrame:
    """One row of ``df`` per group; repeated rows of the picked text are one, rows without a word all stay."""
    found = groups(df, key, text, **how).where("picked")
    several = found.groupBy(F.col(key).alias("_key"), F.col("digest").alias("_digest")).agg(F.max("n_shingles").alias("_n"))
    met = by_verdict(df, key, text, several)
    single = met.where("_n > 0").groupBy("_key", "_digest").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(met.where("_n = 0").select("row")).select("row.*")


_BLANKS = " \\t\\n\\x0B\\f\\r"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^{_BLANKS}]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) > 1 THEN ws[i] || ' ' || ws[i + 1] ELSE ws[1] END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= {SIMILAR} * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x),
low AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN low ON doc_id = node"""


@query("op7_near_dup", SQL)
def op7_near_dup(spark, folder):
    """doc_id, n_shingles, component_id, kept of every document, on 2-word shingles."""
    return groups(table(spark, folder, "documents"), "doc_id", "text", shingle=2).select("doc_id", "n_shingles", "component_id", "kept")
