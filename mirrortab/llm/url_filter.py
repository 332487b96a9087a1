"""URL filters with dated lists.

A list is a log of dated entries: from a time on, a key (a whole address, or a domain with all below it) is blocked,
allowed, or no longer listed. Entries of a key become validity intervals. An as-of join, by running last values in cells of
time, gives every capture the entries that were valid when it was fetched, and the most specific of them decides. Everything is
DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

from mirrortab.llm.registry import query, table
from mirrortab.llm.scratch import saved
from mirrortab.operators.ordering import skew_join

BLOCK, ALLOW, REMOVE = "block", "allow", "remove"
MOST_LABELS = 127


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no default port."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host_of(url), rest))


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    place = F.regexp_extract(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(place), "^.*@", ""), ":[0-9]*$", "")
    host = F.regexp_replace(host, "[.]+$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame, key: str, action: str, at: str) -> DataFrame:
    """(key, since, until, action): one row per stretch of time in which a key is listed; until is null where it still is.

    Entries of one key and time count as one, the strictest: block before allow before remove. A repeated action
    changes nothing, so an interval ends only where the action changes; null keys, times or actions say nothing.
    """
    rank = F.when(F.col("action") == BLOCK, 2).when(F.col("action") == ALLOW, 1).otherwise(0)
    dated = (entries.select(F.col(f"`{key}`").alias("key"), F.lower(F.col(f"`{action}`")).alias("action"), F.col(f"`{at}`").alias("at")).dropna()
             .where(F.col("action").isin(BLOCK, ALLOW, REMOVE)).groupBy("key", "at").agg(F.max(rank).alias("rank")))
    by_key = Window.partitionBy("key").orderBy("at")
    changed = dated.withColumn("before", F.lag("rank").over(by_key)).where(F.col("before").isNull() | (F.col("before") != F.col("rank")))
    spans = changed.withColumn("until", F.lead("at").over(by_key)).where("rank > 0")
    return spans.select("key", F.col("at").alias("since"), "until", F.when(F.col("rank") == 2, BLOCK).otherwise(ALLOW).alias("action"))


def hour_of(at: Column, dtype: DataType) -> Column:
    """A number that never falls while time goes on: hours of clock time, or 3,600 units of numbers; one cell for other types."""
    if isinstance(dtype, (DateType, TimestampType, TimestampNTZType)):
        return (F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")) * 24 + F.hour(at)).cast("bigint")
    return F.floor(at / 3600).cast("bigint") if isinstance(dtype, NumericType) else F.lit(0).cast("bigint")


def as_of(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, at, action) of the different (key, at) of ``points`` that lie in one of the ``spans``, which do not overlap in a key.

    Points and starts of intervals stand in one order of time; a running last value gives each point the interval that began last.
    Time is cut into cells, so that a key with very many points or intervals is many groups; one row per key and cell carries the
    last interval over to the cells behind. A group is at most the different times of a cell, and a key has at most a cell an hour.
    """
    span = F.struct("since", "until", "action")
    starts = spans.select("key", F.col("since").alias("at"), span.alias("span"))
    asked = points.select("key", "at").distinct().select("key", "at", F.lit(None).cast(starts.schema["span"].dataType).alias("span"))
    # Intervals come first among equal times: they hold from their own time on.
    timed = starts.unionByName(asked)
    timed = timed.select("*", hour_of(F.col("at"), timed.schema["at"].dataType).alias("cell"))
    last = timed.groupBy("key", "cell").agg(F.max_by("span", F.when(F.col("span").isNotNull(), F.col("at"))).alias("last"))
    earlier = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("key", "cell", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("key", "cell").orderBy("at", F.col("span").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = timed.withColumn("here", F.last("span", ignorenulls=True).over(inside)).where(F.col("span").isNull()).select("key", "cell", "at", "here")
    met = here.join(carried, ["key", "cell"]).select("key", "at", F.coalesce("here", "carried").alias("now"))
    return met.where(F.col("now").isNotNull() & (F.col("now.until").isNull() | (F.col("at") < F.col("now.until")))).select("key", "at", "now.action")


def domains_of(host: Column) -> Column:
    """(key, level) of a host and every domain above it, the nearest first."""
    labels = F.split(host, "[.]")
    count = F.size(labels)
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.struct(
        F.array_join(F.slice(labels, i, count), ".").alias("key"), (F.lit(MOST_LABELS) - i).alias("level")))


def judged(captures: DataFrame, ident: str, url: str, at: str, entries: DataFrame, key: str, action: str, since: str) -> DataFrame:
    """(ident, host, at, matched, action, blocked): one row per different (ident, url, at) of ``captures``.

    matched is the most specific key that is listed at the time of the fetch, from its own time on and until just before
    the next change; an address beats its host, a host the domains above. Nothing listed: matched and action are null and
    the capture passes. A capture without an address, host or time passes too. Repeated captures give one row; empty tables on
    either side give none, or all passed. Entries' domains are keys like ``example.com``, addresses are in :func:`canonical` form.

    What holds for a capture depends on its host and time, or its address and time, alone. So the as-of join sees each different
    (key, time) once, and only keys that have an entry: hosts learn theirs first, captures are never sent to a domain that
    no list names. Joins of captures split hot hosts.
    """
    own = captures.schema[at].dataType
    # Both sides count time in the wider of their types.
    times = captures.select(F.col(f"`{at}`")).union(entries.select(F.col(f"`{since}`"))).schema[0].dataType
    entries = entries.select(F.col(f"`{key}`").alias("key"), F.col(f"`{action}`").alias("action"), F.col(f"`{since}`").cast(times).alias("since"))
    asked = saved(captures.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{url}`").alias("url"), F.col(f"`{at}`").cast(times).alias("at")).distinct()
                  .select("*", host_of(F.col("url")).alias("host"), canonical(F.col("url")).alias("address")), "captures")
    spans = saved(intervals(entries, "key", "action", "since"), "intervals")
    listed = spans.select("key").distinct()
    known = asked.where(F.col("host").isNotNull() & F.col("at").isNotNull())
    # One row per host: its listed domains, at most one a label.
    above = (known.select("host").distinct().select("host", F.inline(domains_of(F.col("host")))).join(listed, "key")
             .groupBy("host").agg(F.collect_list(F.struct("key", "level")).alias("keys")))
    by_host = saved(skew_join(known.select("host", "at").distinct(), above, "host", F.col("at")).select("host", "at", F.inline("keys")), "hosts")
    by_address = known.select(F.col("address").alias("key"), "at").distinct().join(listed, "key")
    found = saved(as_of(by_host.select("key", "at").unionByName(by_address), spans).select(F.struct("key", "at").alias("point"), "action"), "found")
    hits = skew_join(by_host.select("host", "at", "level", F.struct("key", "at").alias("point")), found, "point", F.col("host"))
    best = hits.groupBy("host", "at").agg(F.max(F.struct("level", F.col("point.key").alias("key"), "action")).alias("best"))
    hosts = best.select(F.struct("host", "at").alias("place"), F.struct("best.key", "best.action").alias("by_host"))
    addresses = found.select(F.col("point").alias("page"), F.struct("point.key", "action").alias("by_address"))
    rows = asked.select("*", F.struct("host", "at").alias("place"), F.struct(F.col("address").alias("key"), "at").alias("page"))
    whole = skew_join(skew_join(rows, hosts, "place", F.col("ident"), "left"), addresses, "page", F.col("ident"), "left")
    won = F.coalesce("by_address", "by_host")
    return whole.select(
        F.col("ident").alias(ident), F.col("url").alias(url), F.col("host"), F.col("at").cast(own).alias(at), won["key"].alias("matched"),
        won["action"].alias("action"), (F.coalesce(won["action"], F.lit(ALLOW)) == BLOCK).alias("blocked"))


# The pages table has no fetch times and no lists, so both follow from it: a page is fetched on a day of 2024 that its id
# gives; a third of the pages report their domain, and a thirteenth their own address, as an entry of a later or earlier day.
DAYS = 366


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 89 % DAYS).cast("int")).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 53 % DAYS).cast("int"))
    kind = F.col("page_id") % 5
    action = F.when(kind < 2, BLOCK).when(kind == 2, ALLOW).otherwise(REMOVE)
    host = host_of(F.col("url"))
    domain = F.when(F.col("page_id") % 2 == 0, host).otherwise(F.regexp_extract(host, "[^.]+[.][^.]+[.][^.]+$", 0))
    domains = pages.where("page_id % 3 = 0").select(domain.alias("key"), action.alias("action"), day.alias("since"))
    addresses = pages.where("page_id % 13 = 0").select(canonical(F.col("url")).alias("key"), action.alias("action"), day.alias("since"))
    return domains.unionByName(addresses)


SQL = f"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 89 % {DAYS} AS INTEGER) AS fetched, DATE '2024-01-01' + CAST(page_id * 53 % {DAYS} AS INTEGER) AS day,
  CASE WHEN page_id % 5 < 2 THEN 2 WHEN page_id % 5 = 2 THEN 1 ELSE 0 END AS rank,
  nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '[.]+$', ''), '') AS host,
  lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
  regexp_extract(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1) AS rest FROM pages),
e AS (SELECT CASE WHEN page_id % 2 = 0 THEN host ELSE regexp_extract(host, '[^.]+[.][^.]+[.][^.]+$') END AS key, day, rank FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT scheme || '://' || host || rest, day, rank FROM p WHERE page_id % 13 = 0),
d AS (SELECT key, day, max(rank) AS rank FROM e WHERE key IS NOT NULL GROUP BY key, day),
s AS (SELECT key, day, rank, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM d),
k AS (SELECT page_id, url, host, fetched, 127 AS level, scheme || '://' || host || rest AS key FROM p WHERE host IS NOT NULL
  UNION ALL SELECT page_id, url, host, fetched, 127 - i, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p WHERE host IS NOT NULL)),
hit AS (SELECT page_id, arg_max(k.key, level) AS matched, arg_max(rank, level) AS won FROM k JOIN s ON k.key = s.key AND s.day <= fetched AND (until IS NULL OR fetched < until)
  WHERE rank > 0 GROUP BY page_id)
SELECT page_id, url, host, fetched, matched, CASE won WHEN 2 THEN '{BLOCK}' WHEN 1 THEN '{ALLOW}' END AS action, coalesce(won = 2, false) AS blocked
FROM p LEFT JOIN hit USING (page_id)"""


@query("op6_url_filter", SQL)
def op6_url_filter(spark, folder):
    """page_id, url, host, fetched, matched, action, blocked of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judged(captures_of(pages), "page_id", "url", "fetched", entries_of(pages), "key", "action", "since")
