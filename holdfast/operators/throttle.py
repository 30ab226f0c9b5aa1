"""Per-key request quota over a log.

A window opens at a key's first request and lasts ``window_us``; the first ``quota``
requests in it pass, later ones are rejected with the seconds until it closes. A
request at exactly the closing time still belongs to the window; the next one opens
a new window.

Which requests open windows is a chain: the first request later than a window's end opens
the next. All keys go one way, whatever their size. Distinct (key, time) points and, one
window later, their ends lie in one global order, cut into ranges; there each end sees the
next point. A point behind a gap longer than the window opens one for certain, so a key's
log falls into chains, and pointers that lead to such a point are left out. Then pointers
are doubled and openings are marked in the same round: after n rounds all openings of the
first 2^n windows of every chain are known. Rounds grow with the logarithm of the longest
chain, every join is by (key, time), and no task needs a whole key.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numbers import int_div
from holdfast.sources.workspace import publish

MINUTE_US = 60_000_000
DAY_US = 86_400_000_000
# The quota of a window of a minute, and the key of a request without one.
QUOTA = 15
# Rows of points and ends in a range, or of hops in a part of a join, which one task sorts.
RANGE_ROWS = 1 << 18
NOBODY = "unknown"


def client_key(forwarded: Column, address: Column) -> Column:
    """The first address of a forwarding header, else the request's own, else ``NOBODY``."""
    first = F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit(""))
    return F.coalesce(first, F.nullif(address, F.lit("")), F.lit(NOBODY))


def _epoch_micros(events: DataFrame) -> Column:
    """Microseconds since 1970, from either timestamp type, free of the session's zone."""
    ts = F.col("ts")
    if events.schema["ts"].dataType.typeName() == "timestamp":
        return F.unix_micros(ts)
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = (days * 24 + F.hour(ts)) * 60 + F.minute(ts)
    seconds = F.extract(F.lit("SECOND"), ts).cast("decimal(8,6)")
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("long")


def request_log(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(event_id, user_id, at) with at in microseconds and the key, a number or a text, as user_id.

    Requests without a key share the key -1, or ``NOBODY`` among texts; those without a time
    count at the epoch.
    """
    named = F.col(key) if events.schema[key].dataType.typeName() == "string" else F.col(key).cast("long")
    nobody = F.lit(NOBODY) if events.schema[key].dataType.typeName() == "string" else F.lit(-1).cast("long")
    at = F.coalesce(_epoch_micros(events), F.lit(0).cast("long"))
    return events.select("event_id", F.coalesce(named, nobody).alias("user_id"), at.alias("at"))


def window_walk(window_us: int, quota: int):
    """Returns ``walk(at, opened, seen)`` over one key's ascending request times.

    It steps from window to window, not from row to row, and gives each row's opening
    time and verdict together with the window left open. Defined inside the call so
    that it travels to the workers whole.
    """

    def walk(at: np.ndarray, opened: int | None, seen: int):
        opened_at = np.empty(len(at), dtype=np.int64)
        accepted = np.zeros(len(at), dtype=bool)
        row = 0
        while row < len(at):
            if opened is None or at[row] > opened + window_us:
                opened, seen = int(at[row]), 0
            end = row + int(np.searchsorted(at[row:], opened + window_us, side="right"))
            opened_at[row:end] = opened
            accepted[row : min(end, row + max(0, quota - seen))] = True
            seen += end - row
            row = end
        return opened_at, accepted, opened, seen

    return walk


def first_hops(log: DataFrame, window_us: int) -> DataFrame:
    """(user_id, at, next): the points that open windows for certain, with no next, and the hops from
    each point to the first one later than its window, unless that one opens a window for certain."""
    points = log.select("user_id", "at").distinct()
    # At one time an end (kind 1) stands behind a point, which still belongs to the window.
    rows = points.select("user_id", F.col("at").alias("t"), F.lit(0).alias("kind")).union(
        points.select("user_id", F.col("at") + window_us, F.lit(1))
    )
    ranges = max(log.sparkSession.sparkContext.defaultParallelism, -(-2 * log.count() // RANGE_ROWS))
    ranged = publish(
        rows.repartitionByRange(ranges, "user_id", "t", "kind").withColumn("_range", F.spark_partition_id()), "throttle-ranges"
    )
    point = F.when(F.col("kind") == 0, F.struct("user_id", "t"))
    ends = ranged.groupBy("_range").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so this side stays small at any data size.
    around = ends.select(
        "_range", F.last("last", True).over(earlier).alias("_before"), F.last("first", True).over(later).alias("_after")
    )
    # Both neighbours in one order; the number is given so that ranges are not put together again by their bytes.
    place = "OVER (PARTITION BY _range ORDER BY user_id, t, kind)"
    dealt = ranged.withColumn("_point", point).repartition(ranges, "_range").join(F.broadcast(around), "_range")
    near = dealt.select(
        "user_id",
        "t",
        "kind",
        F.coalesce(F.expr(f"lag(_point) IGNORE NULLS {place}"), "_before").alias("before"),
        F.coalesce(F.expr(f"lead(_point) IGNORE NULLS {place}"), "_after").alias("after"),
    )
    before, after = (F.when(F.col(f"{side}.user_id") == F.col("user_id"), F.col(f"{side}.t")) for side in ("before", "after"))
    told = near.select("user_id", "t", "kind", before.alias("before"), after.alias("after"))
    point_row = F.col("kind") == 0
    certain = point_row & (F.col("before").isNull() | (F.col("t") - F.col("before") > window_us))
    hop = ~point_row & (F.col("after") - F.col("before") <= window_us)
    at = F.when(point_row, F.col("t")).otherwise(F.col("t") - window_us)
    return told.where(certain | hop).select("user_id", at.alias("at"), F.when(~point_row, F.col("after")).alias("next"))


def openings(log: DataFrame, window_us: int) -> DataFrame:
    """(user_id, opened) of every window.

    Parts of the joins follow the number of rows: adaptive execution would put them together
    by their compressed bytes, which say little of what a task sorts.
    """
    start = publish(first_hops(log, window_us), "throttle-hops")
    parts = [start.where("next IS NULL").select("user_id", "at")]
    hops = start.where("next IS NOT NULL")
    while rows := hops.count():
        tasks = -(-rows // RANGE_ROWS)
        ahead = hops.select("user_id", F.col("at").alias("next"), F.col("next").alias("over")).repartition(tasks, "user_id", "next")
        dealt = hops.repartition(tasks, "user_id", "next")
        doubled = dealt.join(ahead, ["user_id", "next"]).select("user_id", "at", F.col("over").alias("next"))
        known = reduce(DataFrame.union, parts).repartition(tasks, "user_id", "at")
        reached = known.join(hops.repartition(tasks, "user_id", "at"), ["user_id", "at"]).select("user_id", F.col("next").alias("at"))
        marked = reached.select("user_id", "at", F.lit(None).cast("long").alias("next"))
        both = publish(doubled.union(marked), "throttle-hops")
        parts.append(both.where("next IS NULL").select("user_id", "at"))
        hops = both.where("next IS NOT NULL")
    return reduce(DataFrame.union, parts).select("user_id", F.col("at").alias("opened"))


def with_openings(log: DataFrame, window_us: int) -> DataFrame:
    """The log with the opening of each request's window.

    Time is cut into slices of one window's length, so a slice holds at most one opening of
    a key, and a request's window opened in its own slice or in the one before.
    """

    def slice_of(at: str) -> Column:
        return int_div(F.col(at) - F.pmod(at, F.lit(window_us)), window_us)

    starts = publish(openings(log, window_us).withColumn("slice", slice_of("opened")), "throttle-starts")
    here = starts.withColumnRenamed("opened", "opened_here")
    before = starts.select("user_id", (F.col("slice") + 1).alias("slice"), F.col("opened").alias("opened_before"))
    sliced = log.withColumn("slice", slice_of("at"))
    met = sliced.join(here, ["user_id", "slice"], "left").join(before, ["user_id", "slice"], "left")
    in_new = F.col("at") >= F.col("opened_here")
    opened = F.when(in_new, F.col("opened_here")).otherwise(F.col("opened_before"))
    return met.select("event_id", "user_id", "at", opened.alias("opened"))


def _retry_after(window_us: int) -> Column:
    left = F.col("opened") + window_us - F.col("at")
    return int_div(left + 999_999, 1_000_000).cast("int")


def _judged(marked: DataFrame, quota: int) -> DataFrame:
    """Accept the first ``quota`` rows of each window, ranking no more than those.

    The rank filter keeps at most ``quota`` rows per window in each task before the
    shuffle; every row is then compared with its window's last accepted one.
    """
    place = Window.partitionBy("user_id", "opened").orderBy("at", "event_id")
    last_passed = (
        marked.withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= quota)
        .groupBy("user_id", "opened")
        .agg(F.max(F.struct("at", "event_id")).alias("last_passed"))
    )
    within = F.struct("at", "event_id") <= F.col("last_passed")
    return marked.join(last_passed, ["user_id", "opened"], "left").withColumn("accepted", F.coalesce(within, F.lit(False)))


def throttle_batch(
    events: DataFrame, window_us: int = MINUTE_US, quota: int = QUOTA, key: str = "user_id"
) -> DataFrame:
    """(event_id, the key, accepted, retry_after) for every request of the log."""
    marked = publish(with_openings(request_log(events, key), window_us), "throttle-marks")
    wait = F.when(~F.col("accepted"), _retry_after(window_us))
    return _judged(marked, quota).select(
        "event_id", F.col("user_id").alias(key), "accepted", wait.alias("retry_after")
    )
