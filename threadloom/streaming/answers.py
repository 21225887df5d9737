"""The answer side as streams: lives of event streams that may never end, and answers met with their requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.sources.events import event_facts

LIFE_ROWS = "stream_id bigint, complete boolean, actual bigint, ended timestamp"
NONE = -1


class Lifecycles(StatefulProcessor):
    """Events of a stream to one row when it has been silent for `silence_ms`: whether it was one start, then one stop, both well formed.

    Keeps six numbers for each open stream; a stream that never ends leaves by its timer, so state is bounded by the
    streams of one such span.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "starts bigint, stops bigint, first bigint, last bigint, bad boolean, actual bigint, ts bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts, stops, first, last, bad, actual, ts = self.life.get() if self.life.exists() else (0, 0, NONE, NONE, False, NONE, 0)
        for r in pd.concat(list(rows)).itertuples():
            if r.start:
                starts, first = starts + 1, r.seq if first == NONE else min(first, r.seq)
                actual = max(actual, NONE if pd.isna(r.actual) else int(r.actual))
            if r.stop:
                stops, last = stops + 1, max(last, r.seq)
            bad, ts = bool(bad or r.bad), max(ts, int(r.ts.timestamp() * 1000))
        self.life.update((int(starts), int(stops), int(first), int(last), bad, int(actual), ts))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ts + self.silence_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        starts, stops, first, last, bad, actual, ts = self.life.get()
        self.life.clear()
        ok = starts == 1 and stops == 1 and first < last and not bad
        yield pd.DataFrame({"stream_id": [key[0]], "complete": [ok], "actual": pd.array([actual if ok else None], "Int64"), "ended": [pd.Timestamp(ts, unit="ms")]})

    def close(self) -> None:
        pass


def streamed_lifecycles(events: DataFrame, silence: str = "10 minutes", lateness: str = "1 minute") -> DataFrame:
    """(stream_id, complete, actual, ended) of event rows with a timestamp ts, as lifecycles() gives them, each when its stream has been silent for so long."""
    facts = event_facts(events).select("stream_id", "seq", "ts", "start", "stop", "bad", "actual").withWatermark("ts", lateness)
    return facts.groupBy("stream_id").transformWithStateInPandas(Lifecycles(int(pd.Timedelta(silence).total_seconds() * 1000)), LIFE_ROWS, "Append", "EventTime")


def answered(requests: DataFrame, answers: DataFrame, patience: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Requests (stream_id, asked, and what else they have) with their answers (stream_id, ended, complete, actual): a stream-stream join.

    An answer counts from its request's time on and for `patience` after it; a request whose answer is lost, or comes
    later than both watermarks allow, goes on without one (complete is null) when the watermarks have passed it. State holds what lies
    within patience and lateness. minus is actual less the request's selected tokens.
    """
    r = requests.withWatermark("asked", lateness).alias("r")
    a = answers.select(F.col("stream_id").alias("answer_of"), "ended", "complete", "actual").withWatermark("ended", lateness).alias("a")
    near = F.col("ended").between(F.col("asked"), F.col("asked") + F.expr(f"interval {patience}"))
    met = r.join(a, (F.col("stream_id") == F.col("answer_of")) & near, "leftOuter").drop("answer_of")
    return met.withColumn("minus", F.col("actual") - F.col("selected"))
