"""Shards of equal row counts that keep linked rows together, by balanced label propagation.

Rows are linked through keys: rows of one key are neighbours. Linked rows are first dealt out evenly, rows of one key side
by side and small keys whole. In each step the rows of every key and shard are counted, every row asks for the shard where
most of its neighbours are, among those that still take rows, and asks are granted up to the room that is left, those of
small keys first. A shard that has to refuse some is closed, to small keys only when it refuses those. When nothing moves any
more, rows without neighbours fill the shards up, so that all counts differ by one at most. A key of more rows than a shard
holds fills one shard after the other.

Counts of a key are one row per key, summed map side first; rows meet them by an equi-join that adaptive execution splits
where a key is hot. What reaches the driver is one number per shard and cell of a fixed histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mirrortab.llm.registry import query, table
from mirrortab.llm.scratch import forget, saved
from mirrortab.operators.ordering import dense_index

SHARDS = 16
#: Asks for a shard are granted in cells: first of rows of the same small keys together, then of single rows of large keys.
CELLS = 256
#: Label propagation stops after this many steps at the latest; what it has by then is balanced, too.
MOST_STEPS = 64


def _small(rows: Column, capacity: Sequence[int]) -> Column:
    """Whether a key of so many rows is kept whole."""
    return rows * CELLS <= min(capacity)


def _near(state: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """(uid, near, link, keys): rows of the uid's keys per shard, itself included, its smallest key, how many keys it has."""
    counts = links.join(state, "uid").groupBy("link").agg(*[F.count(F.when(F.col("shard") == s, 1)).alias(f"n{s}") for s in range(shards)])
    summed = links.join(counts, "link").groupBy("uid").agg(F.min("link").alias("link"), F.count("link").alias("keys"),
                                                           *[F.sum(f"n{s}").alias(f"n{s}") for s in range(shards)])
    return summed.select("uid", "link", "keys", F.array(*[F.col(f"n{s}") for s in range(shards)]).alias("near"))


def _favourite(near: Column, own: Column, link: Column, stays: Column, open_to: Column, shards: int) -> Column:
    """Shard with most neighbours among those in ``open_to`` and, where the row ``stays``, the own one; ties are broken the
    same way for all rows of a key."""
    turn = F.pmod(F.xxhash64(link), F.lit(shards)).cast("int")
    ranked = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(
        F.when(open_to[s] | (stays & (s == own)), near[s]).otherwise(-1).alias("n"), F.pmod(s + turn, F.lit(shards)).alias("turn"), s.alias("shard")))
    return F.array_max(ranked)["shard"]


def _asks(state: DataFrame, links: DataFrame, capacity: Sequence[int], takes: Sequence[bool], takes_small: Sequence[bool]) -> DataFrame:
    """(uid, to, cell) of the rows that want to move.

    Rows whose only key is small and in several shards leave an own shard that takes none, so that all of them ask for the same one.
    """
    rows_near = F.aggregate("near", F.lit(0).cast("bigint"), lambda a, b: a + b)
    body = state.join(_near(state, links, len(capacity)), "uid").withColumn("small", _small(rows_near, capacity))
    apart = F.col("small") & (F.col("keys") == 1) & (F.col("near")[F.col("shard")] < rows_near) & F.lit(any(takes_small))
    open_to = F.when(F.col("small"), F.array(*[F.lit(t) for t in takes_small])).otherwise(F.array(*[F.lit(t) for t in takes]))
    asked = body.withColumn("to", _favourite(F.col("near"), F.col("shard"), F.col("link"), ~apart, open_to, len(capacity)))
    cell = F.when(F.col("small"), F.pmod(F.xxhash64("link"), F.lit(CELLS))).otherwise(CELLS + F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(CELLS)))
    return asked.where("to != shard").select("uid", "to", cell.cast("int").alias("cell"))


def _granted(asks: DataFrame, room: list[int]) -> tuple[DataFrame | None, dict[int, int]]:
    """Asks in the cells that fit into the room of their shard, and the first cell that does not, by shard."""
    limit, full = {}, {}
    sizes = asks.groupBy("to", "cell").count().collect()
    for s in sorted({r["to"] for r in sizes}):
        left, upto = room[s], -1
        for r in sorted((r for r in sizes if r["to"] == s), key=lambda r: r["cell"]):
            if r["count"] > left:
                full[s] = r["cell"]
                break
            left, upto = left - r["count"], r["cell"]
        limit[s] = upto
    if all(u < 0 for u in limit.values()):
        return None, full
    table = F.create_map(*[F.lit(x) for pair in sorted(limit.items()) for x in pair])
    return asks.where(F.col("cell") <= F.try_element_at(table, F.col("to"))), full


def _dealt(links: DataFrame, capacity: Sequence[int]) -> DataFrame:
    """(uid, shard): as many rows in each shard, rows of the same smallest key side by side, small keys whole.

    Only where whole small keys leave a shard too little room, one key at its end is cut.
    """
    shards = len(capacity)
    keyed = links.groupBy("uid").agg(F.min("link").alias("link"))
    sizes = keyed.groupBy("link").agg(F.count(F.lit(1)).alias("n"))
    sized = keyed.join(sizes, "link").select("uid", "link", _small(F.col("n"), capacity).alias("small"))
    lined = saved(dense_index(sized, [~F.col("small"), F.xxhash64("link", F.lit(3)), "link", "uid"], "_at"), "lined")
    counts = {r["small"]: r["count"] for r in lined.groupBy("small").count().collect()}
    few, rows = counts.get(True, 0), sum(counts.values())
    firsts = lined.where("small").groupBy("link").agg(F.min("_at").alias("first"))
    small = lined.where("small").join(firsts, "link").select("uid", _within(F.col("first"), shares(few, shards)).alias("shard"))
    loads = {r["shard"]: r["count"] for r in small.groupBy("shard").count().collect()}
    if any(n > capacity[s] for s, n in loads.items()):
        small = lined.where("small").select("uid", _within(F.col("_at"), shares(few, shards)).alias("shard"))
        loads = dict(enumerate(shares(few, shards)))
    gaps = [max(n - loads.get(s, 0), 0) for s, n in enumerate(shares(rows, shards))]
    large = lined.where("not small").select("uid", _within(F.col("_at") - few, gaps).alias("shard"))
    state = saved(small.unionByName(large), "state")
    forget(lined)
    return state


def propagated(links: DataFrame, capacity: Sequence[int], steps: int = MOST_STEPS) -> DataFrame:
    """(uid, shard) of every row in ``links`` (uid, link), no shard above its capacity; capacities differ by one at most."""
    state = _dealt(links, capacity)
    closed: set[int] = set()
    closed_small: set[int] = set()
    for _ in range(steps):
        loads = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
        room = [c - loads.get(s, 0) for s, c in enumerate(capacity)]
        takes, takes_small = ([s not in shut and r > 0 for s, r in enumerate(room)] for shut in (closed, closed_small))
        asks = saved(_asks(state, links, capacity, takes, takes_small), "asks")
        moves, full = _granted(asks, room)
        closed.update(full)
        closed_small.update(s for s, cell in full.items() if cell < CELLS)
        if moves is not None:
            after = saved(state.join(moves.select("uid", "to"), "uid", "left").select("uid", F.coalesce("to", "shard").alias("shard")), "state")
            forget(state)
            state = after
        forget(asks)
        if moves is None and not full:
            break
    return state


def shares(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _within(place: Column, sizes: Sequence[int]) -> Column:
    """Shard of the row at this place, when shards of these sizes are filled one after the other."""
    ends = F.array(*[F.lit(sum(sizes[:s + 1])).cast("bigint") for s in range(len(sizes))])
    return F.size(F.filter(ends, lambda e: e <= place)).cast("int")


def balanced_shards(rows: DataFrame, links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` with the columns shard and slot: counts per shard differ by one at most, slots are 0, 1, ... in each.

    ``rows`` and ``links`` are written tables; rows have a unique long ``uid``, links are (uid, link), a null link is none.
    Neighbours stay in one shard except where a shard fills up; keys of at most 1/256 of a shard, whose
    rows have no other key, are not split for that, unless small keys alone fill the shards to the last 1/256. An empty table gives an empty one; with fewer rows than shards some stay empty; other columns pass through, but
    columns called shard and slot are replaced.
    """
    rows = rows.drop("shard", "slot")
    several = links.where(F.col("link").isNotNull()).distinct()
    several = saved(several.join(several.groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("link"), "link").select("uid", "link"), "links")
    capacity = shares(rows.count(), shards)
    linked = propagated(several, capacity)
    loads = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}
    alone = dense_index(rows.select("uid").join(linked.select("uid"), "uid", "left_anti"), [F.xxhash64("uid", F.lit(5)), "uid"], "_at")
    filled = _within(F.col("_at"), [c - loads.get(s, 0) for s, c in enumerate(capacity)])
    placed = linked.unionByName(alone.select("uid", filled.alias("shard")))
    starts = [sum(capacity[:s]) for s in range(shards)]
    numbered = dense_index(placed, ["shard", "uid"], "_at")
    slot = F.col("_at") - F.array(*[F.lit(s).cast("bigint") for s in starts])[F.col("shard")]
    return rows.join(numbered.select("uid", "shard", slot.alias("slot")), "uid")


@query("op10_sharding")
def op10_sharding(spark, folder):
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; documents of equal texts are neighbours,
    those without a text have none."""
    text = F.coalesce("text", F.lit(""))
    rows = saved(table(spark, folder, "documents").select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("link")), "sizes")
    found = balanced_shards(rows.drop("link"), rows.select("uid", "link"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
