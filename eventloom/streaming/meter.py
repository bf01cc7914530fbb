"""Quotas over a stream with keyed operator state and timers, next to the ledger of `streaming.quota`.

A key is an identity's clock-aligned window; its state is how many requests were admitted, and a timer removes it.  A busy
window is not one task's load: before the shuffle every task keeps only as many of a window's first requests as its quota
allows, since no other can be admitted, and only these go to the window's key.  The others are refused anyway; they are
spread over keys that hold no state.  Within a micro-batch the earliest requests are admitted, as by the ledger.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventloom.settings import Settings

SPREAD = 64
_REQUEST = "identity string, window long, at long, request_id string, quota long"
_NARROW = f"{_REQUEST}, share int"
_DECISION = "request_id string, identity string, window long, admitted boolean"
_WINDOW = 0  # share of the requests that may be admitted; others are negative (not metered) or positive (refused)


def metered_stream(requests: DataFrame, settings: Settings, keep_seconds: int = 86_400) -> DataFrame:
    """Decisions (request_id, identity, window_start, admitted) on a stream of requests with `identity` and `quota`.

    `keep_seconds` is how long after its end a window is remembered, by the times of receipt that have been read: requests
    of it that come later than that are counted anew.
    """
    seconds = settings.quota_window_seconds
    narrow = requests.withWatermark("received_at", f"{keep_seconds} seconds").select(
        "identity",
        (F.floor(F.unix_seconds("received_at") / seconds) * seconds).cast("long").alias("window"),
        F.unix_micros("received_at").alias("at"),
        "request_id",
        F.col("quota").cast("long").alias("quota"),
    )
    keyed = narrow.mapInPandas(first_requests, _NARROW).groupBy("identity", "window", "share")
    decided = keyed.transformWithStateInPandas(
        statefulProcessor=Meter(seconds * 1000),
        outputStructType=_DECISION,
        outputMode="Append",
        timeMode="EventTime",
    )
    return decided.select(
        "request_id",
        "identity",
        F.when(F.col("identity").isNotNull(), F.timestamp_seconds("window")).alias("window_start"),
        "admitted",
    )


def first_requests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tell a task's first requests of each window, as many as its quota, from those that are refused anyway."""
    kept: dict[tuple, list] = {}  # the latest of those kept first
    columns = [x.split()[0] for x in _NARROW.split(", ")]
    spread = 0
    for batch in batches:
        out = []
        for identity, window, at, request_id, quota in batch.itertuples(index=False):
            spread = (spread + 1) % SPREAD
            if identity is None or pd.isna(identity):
                out.append((None, window, at, request_id, None, -1 - spread))
                continue
            heap = kept.setdefault((identity, window, quota), [])
            heapq.heappush(heap, _Later(at, request_id))
            if len(heap) > quota:
                late = heapq.heappop(heap)
                out.append((identity, window, late.at, late.request_id, quota, 1 + spread))
        yield pd.DataFrame(out, columns=columns)
    out = [(*key[:2], x.at, x.request_id, key[2], _WINDOW) for key, heap in kept.items() for x in heap]
    yield pd.DataFrame(out, columns=columns)


class _Later:
    """A request; the later one is the smaller."""

    __slots__ = ("at", "request_id")

    def __init__(self, at: int, request_id: str) -> None:
        self.at, self.request_id = at, request_id

    def __lt__(self, other: _Later) -> bool:
        return (self.at, self.request_id) > (other.at, other.request_id)


class Meter(StatefulProcessor):
    """Admits a window's requests up to its quota, over all micro-batches."""

    def __init__(self, window_millis: int) -> None:
        self._length = window_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._used = handle.getValueState("used", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        identity, window, share = key
        if share != _WINDOW:
            for batch in rows:
                yield self._decisions(batch, identity, window, share < 0)
            return
        batch = pd.concat(list(rows))  # no more than the quota from each task
        batch = batch.sort_values(["at", "request_id"], ignore_index=True)
        known = self._used.exists()
        used = self._used.get()[0] if known else 0
        admitted = batch.index < int(batch["quota"].iloc[0]) - used
        self._used.update((int(used + admitted.sum()),))
        if not known:
            end = window * 1000 + self._length
            self._handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._decisions(batch, identity, window, admitted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._used.clear()
        return iter(())

    def close(self) -> None:
        pass

    @staticmethod
    def _decisions(batch: pd.DataFrame, identity, window, admitted) -> pd.DataFrame:
        return pd.DataFrame(
            {"request_id": batch["request_id"], "identity": identity, "window": window, "admitted": admitted}
        )
