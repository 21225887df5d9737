"""Stateful forms of the continuity operators for streams of requests.

Each processor keeps little per session (hashes, counters, times), never texts, and expires with its session.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EPOCH_ROWS = "session_id bigint, seq bigint, epoch bigint, common_prefix bigint, reason string"
TRIGGER_ROWS = "session_id bigint, request_id bigint, trigger string"
BASELINE_ROWS = "session_id bigint, generation bigint, actual bigint, accepted boolean"
STICKY_ROWS = "session_id bigint, tool_use_id string, seq bigint, since bigint"
SNAPSHOT_ROWS = "session_id bigint, seq bigint, kind string, usable boolean"


def compared(hashes: list[str] | None, before: list[str] | None, epoch: int) -> tuple[int, int, str]:
    """(epoch, common prefix, reason) of a history after `before` in `epoch` (0: the first)."""
    if epoch == 0:
        return 1, 0, "initial"
    if hashes is None or before is None:
        return epoch + 1, 0, "invalid_history"
    shared = next((i for i, (a, b) in enumerate(zip(hashes, before, strict=False)) if a != b), min(len(hashes), len(before)))
    if shared == len(before):
        return epoch, shared, "unchanged" if len(hashes) == shared else "appended"
    return epoch + 1, shared, "history_shrunk" if shared == len(hashes) else "history_changed"


class Epochs(StatefulProcessor):
    """Requests (session_id, seq, hashes) to epochs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "epoch bigint, readable boolean, hashes array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        epoch, before = 0, None
        if self.last.exists():
            epoch, readable, hashes = self.last.get()
            before = list(hashes) if readable else None
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            now = None if r.hashes is None else list(r.hashes)
            epoch, shared, reason = compared(now, before, epoch)
            out.append((key[0], r.seq, epoch, shared, reason))
            before = now
        self.last.update((epoch, before is not None, before or []))
        yield pd.DataFrame(out, columns=["session_id", "seq", "epoch", "common_prefix", "reason"])

    def close(self) -> None:
        pass


class Triggers(StatefulProcessor):
    """Requests (session_id, request_id, ts, selected) to triggers; ts is compared with the session's last."""

    def __init__(self, threshold: int, pause_seconds: float, margin: int = 10_000):
        self.threshold, self.pause, self.margin = threshold, pause_seconds, margin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows, timerValues):
        at = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "request_id"]).itertuples():
            now = r.ts.timestamp()
            paused = at is not None and r.selected > self.threshold // 2 and now - at > self.pause
            kind = "emergency" if r.selected > self.threshold + self.margin else "tokens" if r.selected > self.threshold else "pause" if paused else "none"
            out.append((key[0], r.request_id, kind))
            at = now
        self.last.update((at,))
        yield pd.DataFrame(out, columns=["session_id", "request_id", "trigger"])

    def close(self) -> None:
        pass


class Baselines(StatefulProcessor):
    """Responses (session_id, generation, actual): one is accepted unless a later generation was."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "generation bigint, actual bigint")

    def handleInputRows(self, key, rows, timerValues):
        kept = self.kept.get() if self.kept.exists() else None
        out = []
        for r in pd.concat(list(rows)).itertuples():
            ok = kept is None or r.generation >= kept[0]
            if ok:
                kept = (int(r.generation), int(r.actual))
            out.append((key[0], r.generation, r.actual, ok))
        self.kept.update(kept)
        yield pd.DataFrame(out, columns=["session_id", "generation", "actual", "accepted"])

    def close(self) -> None:
        pass


class Sticky(StatefulProcessor):
    """Stubbed answers (session_id, tool_use_id, seq) to the request that stubbed each first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getMapState("since", "tool_use_id string", "seq bigint")

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if not self.since.containsKey((r.tool_use_id,)):
                self.since.updateValue((r.tool_use_id,), (int(r.seq),))
            out.append((key[0], r.tool_use_id, r.seq, self.since.getValue((r.tool_use_id,))[0]))
        yield pd.DataFrame(out, columns=["session_id", "tool_use_id", "seq", "since"])

    def close(self) -> None:
        pass


class Snapshots(StatefulProcessor):
    """Frozen prefixes with a time to live: rows of kind store keep (cutoff, hash of the prefix), rows of kind get say if it still holds."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "cutoff int, prefix string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            hashes = list(r.hashes)
            if r.kind == "store":
                self.kept.update((len(hashes), _prefix(hashes, len(hashes))))
                out.append((key[0], r.seq, r.kind, True))
                continue
            ok = False
            if self.kept.exists():
                cutoff, prefix = self.kept.get()
                ok = 0 < cutoff <= len(hashes) and _prefix(hashes, cutoff) == prefix
            out.append((key[0], r.seq, r.kind, ok))
        yield pd.DataFrame(out, columns=["session_id", "seq", "kind", "usable"])

    def close(self) -> None:
        pass


def _prefix(hashes: list[str], n: int) -> str:
    return hashlib.sha256(",".join(hashes[:n]).encode()).hexdigest()


def with_state(requests: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Requests grouped by session through a processor; works on streams, with the RocksDB state store."""
    time_mode = "ProcessingTime" if isinstance(processor, Snapshots) else "None"
    return requests.groupBy("session_id").transformWithStateInPandas(processor, schema, "Append", time_mode)
