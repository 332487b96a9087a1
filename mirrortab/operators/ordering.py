"""Order-dependent building blocks that never put a whole table into one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mirrortab.functions.values import doubles, ref

BUCKETS = 1024
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16_000_000
ROWS_PER_BUCKET = 500_000

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor sees: spark.checkpoint.dir, or a scratch one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="mirrortab-")
    return _local_folders[application]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_index(df: DataFrame, order_by: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """Number the rows start, start+1, ... in the given order.

    A range-partitioned sort gives each row its place within a partition; the rows per partition,
    one number each, give the offsets. The sorted rows are written once so that both uses agree.
    """
    place = F.monotonically_increasing_id()
    ordered = cut_lineage(df.orderBy(*order_by).withColumn("_place", place))
    part = F.shiftrightunsigned("_place", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    offsets = sizes.select("_part", before.alias("_before"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (ordered.withColumn("_part", part)
            .join(F.broadcast(offsets), "_part")
            .withColumn(name, (within + F.col("_before") + F.lit(start)).cast("bigint"))
            .drop("_part", "_place", "_before"))


def add_bucket(df: DataFrame, value: Column, bounds: Column, name: str, buckets: int = BUCKETS) -> DataFrame:
    """Add how many of the sorted ``buckets`` - 1 numbers in the array ``bounds`` are <= value.

    Bisection, one small projection per step, so that it stays in generated code.
    """
    df, step = df.withColumn(name, F.lit(0)), buckets // 2
    while step:
        middle = bounds[F.col(name) + F.lit(step - 1)]
        df = df.withColumn(name, F.col(name) + F.when(value >= middle, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return df


def bucket_of(value: Column, bounds: Column, start: Column, buckets: int = BUCKETS) -> Column:
    """The same as one expression, for tables of distinct values; the bounds begin at ``start``."""
    steps = [buckets >> k for k in range(1, buckets.bit_length())]
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                        lambda at, s: F.when(value >= bounds[start + at + s - 1], at + s).otherwise(at))
    return F.coalesce(found, F.lit(0))


def bucket_bounds(value: Column, buckets: int = BUCKETS) -> Column:
    """Aggregate that yields approximately even bucket bounds for :func:`add_bucket`."""
    shares = [i / buckets for i in range(1, buckets)]
    return F.percentile_approx(value, doubles(shares), F.lit(10 * buckets))


def bottom_k(df: DataFrame, k: int, score: Column, span: int, key: Sequence[str],
             window_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Exactly the ``k`` rows with the smallest ``score`` (a long in [0, span)), ties by ``key``.

    Histograms of at most 1,024 counts narrow the cut-off down until few rows share its cell;
    only those are ranked. Nothing is sorted as a whole.
    """
    scored = df.withColumn("_score", score)
    low, width, need = 0, span, k
    while True:
        step = -(-width // 1024)
        inside = scored.where((F.col("_score") >= low) & (F.col("_score") < low + width))
        cell = F.floor((F.col("_score") - F.lit(low)) / F.lit(step)).alias("cell")
        counts = {r["cell"]: r["count"] for r in inside.groupBy(cell).count().collect()}
        edge = None
        for at in sorted(counts):
            if counts[at] >= need:
                edge = at
                break
            need -= counts[at]
        if edge is None:
            return scored.drop("_score") if low == 0 and width == span else \
                scored.where(F.col("_score") < low + width).drop("_score")
        low, width = low + edge * step, step
        if counts[edge] <= window_rows or step == 1:
            break
    below = scored.where(F.col("_score") < low)
    rank = F.row_number().over(Window.orderBy("_score", *key))
    edge_rows = (scored.where((F.col("_score") >= low) & (F.col("_score") < low + width))
                 .withColumn("_rank", rank).where(F.col("_rank") <= need).drop("_rank"))
    return below.unionByName(edge_rows).drop("_score")


def skew_join(many: DataFrame, one: DataFrame, key: str, spread: Column, how: str = "inner",
              rows: int | None = None, heavy: int = 1000, floor: int = BROADCAST_ROWS) -> DataFrame:
    """Join many rows per key to one row per key, splitting the keys that hold most rows.

    A key is split when it holds more than max(floor, rows / heavy) rows, so at most ``heavy``
    keys are broadcast. ``spread`` decides which split of its key a row goes to.
    """
    rows = many.count() if rows is None else rows
    if rows <= floor:
        return many.join(one, key, how)
    limit = max(floor, rows // heavy)
    hot = (many.groupBy(ref(key)).count().where(F.col("count") > limit)
           .select(ref(key), F.ceil(F.col("count") / limit).cast("int").alias("_parts")))
    hot = F.broadcast(hot)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    split = many.join(hot, key, "left").withColumn("_split", F.pmod(F.xxhash64(spread), parts).cast("int"))
    copies = one.join(hot, key, "left").withColumn("_split", F.explode(F.sequence(F.lit(0), parts - 1)))
    return split.drop("_parts").join(copies.drop("_parts"), [key, "_split"], how).drop("_split")


def head_rows(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in order; the cut-off is found on the order columns alone and pushed down."""
    cut = (df.select([ref(c) for c in order_by]).orderBy(*[ref(c) for c in order_by]).limit(n)
           .agg(F.max(F.struct(*[ref(c) for c in order_by])).alias("cut")).first()["cut"])
    if cut is None:
        return df.limit(0)
    upto = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order_by, cut)])
    here = F.struct(*[ref(c) for c in order_by])
    # Nulls come first; the condition on the first column alone can be pushed to the scan.
    lead = ref(order_by[0])
    near = lead.isNull() if cut[0] is None else lead.isNull() | (lead <= F.lit(cut[0]).cast(df.schema[order_by[0]].dataType))
    return df.where(near & (here <= upto))
