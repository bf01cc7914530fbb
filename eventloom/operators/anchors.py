"""Windows that open at an identity's first request after the last one closed.

Openings depend on each other, so an identity is walked in order - but only over its distinct milliseconds, and an
identity with many of them is cut into segments of time that are worked on by different tasks:

1. What a segment does to the window that is open before it is a step function: the first request at or after the end of
   that window opens the next one, and so on to the segment's last opening.  `steps` has a row per step; only requests
   within one window's length of the segment's beginning, and the one behind, can be such first ones.
2. The end of the window that a step leaves open leads to a step of a later segment (`pointers`).  `visited` follows
   these pointers from each identity's first segment by pointer doubling: every round composes the functions of twice as
   many segments, so the rounds grow with the logarithm of their number.
3. With the opening before each segment known, every segment is walked by itself (`openings`).

An identity's segments are as many as its span of time has, whatever its traffic.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.plans.scratch import written

#: Distinct milliseconds of an identity that one task walks.
MOST = 1_000_000
#: Length of a segment, which bounds its distinct milliseconds too.
SEGMENT_MILLIS = 1 << 22

_NODE = ["identity", "segment", "upto"]


def opened(
    times: DataFrame, span: int, carried: DataFrame | None = None, most: int = MOST, length: int = SEGMENT_MILLIS
) -> DataFrame:
    """For distinct rows (identity, millis) the start of the window each falls in: identity, millis, opened.

    `span` is the windows' length in milliseconds; `carried` (identity, opened) has windows that were open before.
    """
    if carried is None:
        times = written(times, "times")
        return first_opened(times, span, most, length)
    held = carried.select("identity", F.col("opened").cast("long").alias("opened"))
    times = written(times.join(held, "identity", "left"), "times")
    held_over = F.coalesce(F.col("millis") < F.col("opened") + span, F.lit(False))
    fresh = times.where(~held_over).select("identity", "millis")  # these begin with an opening
    return times.where(held_over).select("identity", "millis", "opened").unionByName(
        first_opened(fresh, span, most, length).select("identity", "millis", "opened")
    )


def first_opened(times: DataFrame, span: int, most: int, length: int) -> DataFrame:
    """As `opened`, where no window was open before; `times` is written."""
    large = times.groupBy("identity").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("identity")
    large = written(large, "large")
    whole, none = F.lit(0).cast("long").alias("segment"), F.lit(None).cast("long").alias("before")
    if large.isEmpty():
        return openings(times.select("identity", whole, "millis", none), span)
    small = times.join(large, "identity", "left_anti").select("identity", whole, "millis", none)
    cut = F.floor(F.col("millis") / length).cast("long").alias("segment")
    segments = times.join(large, "identity", "left_semi").select("identity", cut, "millis")
    before = before_segments(segments, span, length)
    busy = segments.join(before, ["identity", "segment"]).select("identity", "segment", "millis", "before")
    return openings(small.unionByName(busy), span)


def before_segments(segments: DataFrame, span: int, length: int) -> DataFrame:
    """The last opening before each segment, null for none: identity, segment, before."""
    table = written(steps(segments, span, length), "steps")
    ends = table.groupBy("identity", "segment").agg(F.max("last").alias("last"))
    nodes = written(pointers(table, ends, span, length), "pointers")
    # an identity's first request opens a window, which is the first step of its first segment
    heads = table.groupBy("identity").agg(F.min(F.struct("segment", "upto")).alias("_head")).select("identity", "_head.*")
    exits = visited(heads, nodes).join(table, _NODE).select("identity", "segment", "exit")
    earlier = Window.partitionBy("identity").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    known = ends.join(exits, ["identity", "segment"], "left")
    return known.select("identity", "segment", F.last("exit", ignorenulls=True).over(earlier).alias("before"))


def steps(segments: DataFrame, span: int, length: int) -> DataFrame:
    """A segment as a function: where a window ends after the step before and up to `upto`, `exit` is its last opening.

    `last` is the segment's last millisecond.
    """

    def run(table: pa.Table) -> pa.Table:
        at = np.sort(table.column("millis").to_numpy())
        n = len(at)
        follows = np.searchsorted(at, at + span)
        reach = np.where(follows < n, follows, np.arange(n))
        while (far := reach[reach]).tolist() != reach.tolist():
            reach = far
        begin = table.column("segment")[0].as_py() * length
        many = min(n, int(np.searchsorted(at, begin + span)) + 1)
        exits = at[reach[:many]]
        ends = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
        size = len(ends)
        return pa.table(
            {
                "identity": pa.repeat(table.column("identity")[0], size),
                "segment": pa.repeat(table.column("segment")[0], size),
                "upto": at[ends],
                "exit": exits[ends],
                "last": np.full(size, at[-1]),
            }
        )

    schema = "identity string, segment long, upto long, exit long, last long"
    return segments.groupBy("identity", "segment").applyInArrow(run, schema)


def pointers(table: DataFrame, ends: DataFrame, span: int, length: int) -> DataFrame:
    """Of every step the step that the window it leaves open leads to."""
    wanted = table.select(*_NODE, (F.col("exit") + span).alias("want"))
    return located(wanted, table, ends, length).where(F.col("next_upto").isNotNull()).drop("want")


def located(wanted: DataFrame, table: DataFrame, ends: DataFrame, length: int) -> DataFrame:
    """Add `next_segment` and `next_upto`, the first step at or after `want`; null for none.

    It lies in the segment of `want` if that reaches so far, else in the next one that there is.
    """
    aimed = wanted.withColumn("_aim", F.floor(F.col("want") / length).cast("long"))
    aims = aimed.select("identity", F.col("_aim").alias("segment")).distinct()
    both = aims.join(ends, ["identity", "segment"], "full")  # a row for each segment at most, not for each request
    later = Window.partitionBy("identity").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    there = F.last(F.when(F.col("last").isNotNull(), F.col("segment")), ignorenulls=True).over(later)
    both = both.select("identity", F.col("segment").alias("_aim"), "last", there.alias("_later"))
    target = F.when(F.col("last") >= F.col("want"), F.col("_aim")).otherwise(F.col("_later"))
    aimed = aimed.join(both, ["identity", "_aim"]).withColumn("next_segment", target).drop("_aim", "last", "_later")
    # steps and wanted ends in one descending order: the step that was last seen is the first at or after an end
    names = [x for x in aimed.columns if x not in ("identity", "next_segment", "want")]
    marks = [F.lit(None).cast(aimed.schema[x].dataType).alias(x) for x in names]
    step = table.select(
        "identity", F.col("segment").alias("next_segment"), F.col("upto").alias("want"), *marks, F.col("upto").alias("_step")
    )
    ask = aimed.select("identity", "next_segment", "want", *names, F.lit(None).cast("long").alias("_step"))
    order = Window.partitionBy("identity", "next_segment").orderBy(F.desc("want"), F.asc_nulls_last("_step"))
    merged = step.withColumn("_ask", F.lit(False)).unionByName(ask.withColumn("_ask", F.lit(True)))
    found = merged.withColumn("next_upto", F.last("_step", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.where("_ask").drop("_step", "_ask")


def visited(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """The steps that the pointers lead to from the heads, these included."""
    known, jump = written(heads, "visited"), nodes.select(*_NODE, "next_segment", "next_upto")
    count = known.count()
    while True:
        ahead = known.join(jump, _NODE).select(
            "identity", F.col("next_segment").alias("segment"), F.col("next_upto").alias("upto")
        )
        known = written(known.union(ahead).distinct(), "visited")
        if (now := known.count()) == count:
            return known
        count = now
        twice = jump.select("identity", F.col("segment").alias("_s"), F.col("upto").alias("_u"), "next_segment", "next_upto")
        composed = twice.withColumnsRenamed({"next_segment": "segment", "next_upto": "upto"}).join(jump, _NODE)
        composed = composed.select("identity", F.col("_s").alias("segment"), F.col("_u").alias("upto"), "next_segment", "next_upto")
        jump = written(composed, "jump")


def openings(segments: DataFrame, span: int) -> DataFrame:
    """The opening that holds at each millisecond of each segment; `before` is the last one before it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_segments(batches):
            identity, segment = table.column("identity").to_numpy(zero_copy_only=False), table.column("segment").to_numpy()
            at = table.column("millis").to_numpy()
            earlier = table.column("before")
            known = ~np.array(earlier.is_null())
            earlier = earlier.fill_null(0).to_numpy()
            first = np.append(True, (identity[1:] != identity[:-1]) | (segment[1:] != segment[:-1]))
            group = np.cumsum(first) - 1
            width = int(at.max() - at.min()) + span + 1
            key = group * width + (at - at.min())  # ascends over all groups
            heads = np.flatnonzero(first)
            end = np.append(heads[1:], len(at))
            start = np.where(known[heads], earlier[heads] + span, at[heads])
            here = np.searchsorted(key, np.arange(len(heads)) * width + np.clip(start - at.min(), 0, width - 1))
            opens = np.full(len(at), -1)
            on = np.flatnonzero(here < end)
            here = here[on]
            while len(on):
                opens[here] = here
                here = np.searchsorted(key, key[here] + span)
                stays = here < end[on]
                on, here = on[stays], here[stays]
            latest = np.maximum.accumulate(opens)
            inside = latest >= heads[group]
            out = np.where(inside, at[np.maximum(latest, 0)], earlier)
            yield pa.RecordBatch.from_arrays([table.column("identity").combine_chunks(), pa.array(at), pa.array(out)], ["identity", "millis", "opened"])

    ordered = segments.repartition("identity", "segment").sortWithinPartitions("identity", "segment", "millis")
    return ordered.mapInArrow(run, "identity string, millis long, opened long")


def whole_segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows as tables that hold whole segments only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        identity, segment = batch.column("identity"), batch.column("segment")
        last = pa.compute.and_(
            pa.compute.equal(identity, identity[-1]), pa.compute.equal(segment, segment[-1])
        ).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(last))  # where the batch's last segment begins
        same = held and held[-1].column("identity")[-1] == identity[0] and held[-1].column("segment")[-1] == segment[0]
        if cut or not same:
            if cut and same:
                held.append(batch.slice(0, cut))
                yield pa.Table.from_batches(held)
            else:
                if held:
                    yield pa.Table.from_batches(held)
                if cut:
                    yield pa.Table.from_batches([batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
