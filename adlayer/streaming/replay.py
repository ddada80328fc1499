"""An event log that comes in any order, replayed as it comes: each event's state before and after, site by site.

Sites are kept in buckets, by a hash: a bucket's events wait in state until the
watermark has passed their time; then they are applied site by site in the order
of time and number, and given out. So the result
is that of operators.replay over the whole log, whatever order rows come in, as
long as none comes later than the watermark's delay. A row that does is neither
applied nor given out: Spark drops it and counts it (numRowsDroppedByWatermark).

What waits is what a bucket has within the delay, and is one list in the store of
states, an entry of packed events for what a batch brings; one timer, at the
earliest of them, wakes it. So a batch's calls to the store follow the buckets,
not the sites or events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: An event that waits.
_EVENT = np.dtype([("site_idx", "<i8"), ("micros", "<i8"), ("ord", "<i8"), ("transition", "<i4")])
#: A site's state.
_SITE = np.dtype([("site_idx", "<i8"), ("state", "<i4")])
BUCKETS = 4096
STATES = "site_idx long, ord long, micros long, state_before int, state_after int"


class _Replay(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "sites binary")
        self.timer = handle.getValueState("timer", "at long")
        self.waiting = handle.getListState("waiting", "events binary")

    def _wake(self, at: int) -> None:
        """A timer at that millisecond, unless one is set that comes first."""
        known = self.timer.get()
        if known is None or at < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = []
        for frame in rows:
            part = np.empty(len(frame), _EVENT)
            for name in _EVENT.names:
                part[name] = frame[name].to_numpy()
            own.append(part)
        events = np.concatenate(own) if own else np.empty(0, _EVENT)
        if len(events):
            self.waiting.appendValue((events.tobytes(),))
            self._wake(max(int(events["micros"].min()) // 1000, 0))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = np.concatenate([np.frombuffer(x, _EVENT) for (x,) in self.waiting.get()] or [np.empty(0, _EVENT)])
        over = events["micros"] // 1000 <= passed
        due, rest = events[over], events[~over]
        due = due[np.lexsort((due["transition"], due["ord"], due["micros"], due["site_idx"]))]
        found = self.state.get()
        known = np.frombuffer(b"" if found is None else found[0], _SITE)
        states, before, after = dict(zip(known["site_idx"].tolist(), known["state"].tolist())), [], []
        for site, transition in zip(due["site_idx"].tolist(), due["transition"].tolist()):
            state = states.get(site, 0)
            before.append(state)
            states[site] = state & ~(transition >> 8) | transition & 255
            after.append(states[site])
        self.state.update((np.array(list(states.items()), _SITE).tobytes(),))
        self.timer.clear()
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
            self._wake(max(int(rest["micros"].min()) // 1000, 0))
        else:
            self.waiting.clear()
        if len(due):
            yield pd.DataFrame({"site_idx": due["site_idx"], "ord": due["ord"], "micros": due["micros"], "state_before": np.array(before, np.int32), "state_after": np.array(after, np.int32)})

    def close(self) -> None:
        pass


def use_store(spark: SparkSession) -> None:
    """Such operators need RocksDB as the store of states."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def states(events: DataFrame, late: str, time: str = "time", buckets: int = BUCKETS) -> DataFrame:
    """STATES of a stream of events (ord, `time`, site_idx, transition); all sites begin vacant.

    late: how much later than a later event's a row may come. Times are of
    microseconds; equal ones go by ord. Rows without a site, time or transition
    are left out. What is within the delay at a stream's end is given out when a
    later row moves the watermark. buckets: of sites; a progress folder keeps to
    the number that it began with.
    """
    use_store(events.sparkSession)
    own = events.select("site_idx", F.col("ord").cast("long").alias("ord"), F.col(time).cast("timestamp").alias("time"), F.col("transition").cast("int").alias("transition"))
    own = own.where("site_idx is not null and time is not null and transition is not null").withColumn("site_idx", F.col("site_idx").cast("long")).withColumn("micros", F.unix_micros("time"))
    own = own.withColumn("bucket", F.pmod(F.xxhash64("site_idx"), F.lit(buckets)))
    return own.withWatermark("time", late).groupBy("bucket").transformWithStateInPandas(_Replay(), STATES, "Append", "EventTime")
