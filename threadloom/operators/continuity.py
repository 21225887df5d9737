"""Continuity of histories between requests, pressure, triggers and kept snapshots, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import tokens as T


def by_request() -> WindowSpec:
    return W.partitionBy("session_id").orderBy("seq")


def row_hash(role: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(role, F.lit("")), F.lit("\x1f"), F.coalesce(content, F.lit(""))), 256)


def histories(rows: DataFrame) -> DataFrame:
    """(session_id, seq, hashes): the row hashes of every request's history, in order."""
    h = rows.select("session_id", "seq", "idx", row_hash(F.col("role"), F.col("text")).alias("h"))
    return h.groupBy("session_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"]).alias("hashes"))


def common_prefix(a: Column, b: Column) -> Column:
    """The length of the beginning that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(n.cast("bigint"))


def epochs(histories_: DataFrame) -> DataFrame:
    """(session_id, seq, epoch, common_prefix, reason): a new epoch wherever a history doesn't continue the one before.

    histories_: session_id, seq, hashes (null: the history couldn't be read). Only neighbours are compared.
    """
    h = histories_.withColumn("prev", F.lag("hashes").over(by_request())).withColumn("first", F.row_number().over(by_request()) == 1)
    h = h.withColumn("common_prefix", F.when(F.col("prev").isNull() | F.col("hashes").isNull(), F.lit(0)).otherwise(common_prefix(F.col("hashes"), F.col("prev"))))
    bad = F.col("hashes").isNull() | (F.col("prev").isNull() & ~F.col("first"))
    shrunk = (F.col("common_prefix") == F.size("hashes")) & (F.size("hashes") < F.size("prev"))
    kept = F.col("common_prefix") == F.size("prev")
    reason = F.when(F.col("first"), "initial").when(bad, "invalid_history").when(kept & (F.size("hashes") == F.size("prev")), "unchanged").when(kept, "appended").when(shrunk, "history_shrunk").otherwise("history_changed")
    h = h.withColumn("reason", reason).withColumn("new", F.col("reason").isin("initial", "invalid_history", "history_shrunk", "history_changed").cast("int"))
    return h.withColumn("epoch", F.sum("new").over(by_request().rowsBetween(W.unboundedPreceding, 0))).select("session_id", "seq", "epoch", "common_prefix", "reason")


def current_only(responses: DataFrame, epochs_: DataFrame) -> DataFrame:
    """Responses of a session's latest epoch; later ones of earlier epochs go."""
    last = epochs_.groupBy("session_id").agg(F.max("epoch").alias("epoch"))
    return responses.join(last, ["session_id", "epoch"], "left_semi")


def baselines(responses: DataFrame) -> DataFrame:
    """(session_id, epoch, baseline columns): of each session and epoch the response of the largest generation."""
    cols = [c for c in responses.columns if c not in ("session_id", "epoch", "generation")]
    return responses.groupBy("session_id", "epoch").agg(F.max_by(F.struct(*cols), "generation").alias("b"), F.max("generation").alias("generation")).select("session_id", "epoch", "generation", "b.*")


FINGERPRINT = "^[0-9a-f]{64}$"


def pressure(now: DataFrame, threshold: int) -> DataFrame:
    """Adds selected, source and reset to requests beside their baseline.

    now: n, messages_tok, system_tok, tools_tok, system_fp, tools_fp, prefix_fp (of the first base_n messages),
    delta_tok (of those after), base_actual, base_n, base_system_fp, base_tools_fp, base_prefix_fp, base_conservative.
    """
    full = T.saturating_add(T.saturating_add(F.col("messages_tok"), F.col("system_tok")), F.col("tools_tok"))
    good = (F.col("base_actual") > 0) & (F.col("base_n") >= 0)
    for c in ("base_system_fp", "base_tools_fp", "base_prefix_fp"):
        good &= F.coalesce(F.col(c).rlike(FINGERPRINT), F.lit(False))
    good = F.coalesce(good, F.lit(False))
    actual = F.coalesce("base_actual", F.lit(0))
    old = ~good & (actual > threshold) & (F.col("base_n") >= 0) & (F.col("base_n") <= F.col("n"))
    conservative = F.coalesce("base_conservative", F.lit(False))
    changed = F.col("base_prefix_fp") != F.col("prefix_fp")
    reset = (
        F.when(conservative, "legacy_unverified").when(old, "legacy_unverified").when(~good, "no_actual").when(F.col("base_n") > F.col("n"), "message_shrink")
        .when(F.col("base_system_fp") != F.col("system_fp"), "system_changed").when(F.col("base_tools_fp") != F.col("tools_fp"), "tools_changed").when(changed, "messages_changed").otherwise("none")
    )
    high = (F.col("reset") == "messages_changed") & (actual > threshold) & (actual > full)
    source = F.when(conservative, "local_full").when(old, "legacy_high_water").when(F.col("reset") == "none", "actual_plus_delta").when(high, "conservative_high_water").otherwise("local_full")
    chosen = F.when(F.col("source") == "legacy_high_water", F.greatest(actual, full)).when(F.col("source") == "actual_plus_delta", T.saturating_add(actual, F.col("delta_tok"))).when(F.col("source") == "conservative_high_water", actual).otherwise(full)
    return now.withColumn("reset", reset).withColumn("source", source).withColumn("selected", chosen)


def triggers(requests: DataFrame, threshold: int, pause_seconds: int, margin: int = 10_000) -> DataFrame:
    """Adds trigger: emergency, tokens or pause (a gap since the session's last request), or none. requests: session_id, ts, selected."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(W.partitionBy("session_id").orderBy("ts", "request_id"))
    pause = (F.col("selected") > threshold // 2) & (gap > pause_seconds * 1_000_000)
    return requests.withColumn("trigger", F.when(F.col("selected") > threshold + margin, "emergency").when(F.col("selected") > threshold, "tokens").when(F.coalesce(pause, F.lit(False)), "pause").otherwise("none"))


def frozen_replay(snapshots: DataFrame, histories_: DataFrame) -> DataFrame:
    """(session_id, seq, usable): whether a snapshot's prefix (cutoff, prefix_hash) is still that of each later history."""
    m = histories_.join(snapshots.select("session_id", "cutoff", "prefix_hash", F.col("seq").alias("taken")), "session_id").filter(F.col("seq") > F.col("taken"))
    now = prefix_hash(F.col("hashes"), F.col("cutoff"))
    return m.select("session_id", "seq", ((F.col("cutoff") > 0) & (F.col("cutoff") <= F.size("hashes")) & (now == F.col("prefix_hash"))).alias("usable"))


def prefix_hash(hashes: Column, n: Column) -> Column:
    """The fingerprint of the first n row hashes."""
    return F.sha2(F.array_join(F.slice(hashes, F.lit(1), F.greatest(n.cast("int"), F.lit(0))), ","), 256)


def evicted(snapshots: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Snapshots accessed within the time to live."""
    return snapshots.filter(F.col("last_access") > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def sticky(stubs: DataFrame) -> DataFrame:
    """(session_id, epoch, tool_use_id, since): the first request that stubbed each answer."""
    return stubs.groupBy("session_id", "epoch", "tool_use_id").agg(F.min("seq").alias("since"))


def decay_state(marks: DataFrame) -> DataFrame:
    """(session_id, epoch, idx, stubbed_at, intensity, file_path): the first mark of each message stays."""
    return marks.groupBy("session_id", "epoch", "idx").agg(F.min("seq").alias("stubbed_at"), F.min_by("intensity", "seq").alias("intensity"), F.min_by("file_path", "seq").alias("file_path"))


def warned_once(mismatches: DataFrame) -> DataFrame:
    """The first of each digest in a session."""
    return mismatches.withColumn("_n", F.row_number().over(W.partitionBy("session_id", "digest").orderBy("seq"))).filter("_n = 1").drop("_n")


def pinned(path: Column, active_paths: Column) -> Column:
    """Whether a path ends like an active one or the other way round."""
    return F.coalesce((path != "") & F.exists(active_paths, lambda p: path.endswith(p) | p.endswith(path)), F.lit(False))


def migrated(legacy: DataFrame, current: DataFrame) -> DataFrame:
    """(session_id, epoch, value): state that was kept by bare session (session_id, value) becomes that of epoch 1 where there is none yet."""
    old = legacy.select("session_id", F.lit(1).cast("bigint").alias("epoch"), "value")
    return current.select("session_id", "epoch", "value").unionByName(old.join(current.select("session_id", "epoch"), ["session_id", "epoch"], "left_anti"))
