"""Operators over the order of a session's messages.

Frames have session_id, idx and what each operator names. Windows are partitioned by session, so one shuffle
serves all of an operator; histories are cut to `max_messages` rows before, which bounds a session's window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_session() -> WindowSpec:
    return W.partitionBy("session_id")


def in_order() -> WindowSpec:
    return in_session().orderBy("idx")


def rows_before() -> WindowSpec:
    return in_order().rowsBetween(W.unboundedPreceding, -1)


def from_the_end() -> WindowSpec:
    return in_session().orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, 0)


def first_messages(messages: DataFrame, most: int = 10_000) -> DataFrame:
    return messages.filter(F.col("idx") < most)


def last_messages(messages: DataFrame, most: int = 10_000) -> DataFrame:
    return messages.withColumn("_n", F.count("*").over(in_session())).filter(F.col("idx") >= F.col("_n") - most).drop("_n")


def with_active_pair(messages: DataFrame) -> DataFrame:
    """Adds `active`: whether a row is one of a session's last two, a call and the answer to it.

    Frames have role, use_ids and result_ids (arrays of ids).
    """
    n = F.count("*").over(in_session())
    answered = lambda use, result: F.arrays_overlap(F.coalesce(use, F.array().cast("array<string>")), F.coalesce(result, F.array().cast("array<string>")))
    last = (F.col("idx") == n - 1) & (F.col("role") == "user") & (F.lag("role").over(in_order()) == "assistant") & answered(F.lag("use_ids").over(in_order()), F.col("result_ids"))
    one_before = (F.col("idx") == n - 2) & (F.col("role") == "assistant") & (F.lead("role").over(in_order()) == "user") & answered(F.col("use_ids"), F.lead("result_ids").over(in_order()))
    return messages.withColumn("active", F.coalesce(last | one_before, F.lit(False)))


def collapse_cutoff(messages: DataFrame, floor: int, keep_recent: int, max_messages: int = 10_000) -> DataFrame:
    """(session_id, n, cutoff, archived_tokens): where the kept tail begins, -1 if there is nothing to fold.

    Frames have tok, and may have role, has_use, has_result and active. The tail is the shortest that has
    `floor` tokens, at least keep_recent rows, and never begins inside the active pair; if it would begin with
    an answer, its call and it go together.
    """
    m = first_messages(messages, max_messages)
    for name, value in (("has_use", F.lit(False)), ("has_result", F.lit(False)), ("active", F.lit(False))):
        if name not in m.columns:
            m = m.withColumn(name, value)
    m = m.withColumn("n", F.count("*").over(in_session())).withColumn("kept", F.sum("tok").over(from_the_end()))
    m = m.withColumn("found", F.max(F.when((F.col("kept") >= floor) & (F.col("idx") >= 1), F.col("idx"))).over(in_session()))
    m = m.withColumn("most", F.least(F.col("n") - keep_recent, F.coalesce(F.min(F.when(F.col("active"), F.col("idx"))).over(in_session()), F.col("n"))))
    m = m.withColumn("cut", F.least("found", "most")).withColumn("pair", (F.lag("role").over(in_order()) == "assistant") & F.lag("has_use").over(in_order()))
    m = m.withColumn("archived", F.sum("tok").over(rows_before()) - F.first("tok").over(in_order().rowsBetween(W.unboundedPreceding, 0)))
    at = (F.col("role") == "user") & F.col("has_result")
    moved = F.when(at & (F.col("idx") + 1 <= F.col("most")), F.col("idx") + 1).when(at & (F.col("idx") > 1) & F.coalesce(F.col("pair"), F.lit(False)), F.col("idx") - 1).otherwise(F.col("idx"))
    m = m.withColumn("final", F.max(F.when(F.col("idx") == F.col("cut"), moved)).over(in_session()))
    good = (F.col("n") >= 2) & (F.col("found") >= 2) & (F.col("n") - keep_recent >= 1) & (F.col("final") >= 2) & (F.col("final") < F.col("n")) & (F.col("final") <= F.col("most"))
    m = m.withColumn("cutoff", F.when(F.coalesce(good, F.lit(False)), F.col("final")).otherwise(F.lit(-1)))
    return m.groupBy("session_id").agg(F.first("n").alias("n"), F.first("cutoff").alias("cutoff"), F.coalesce(F.max(F.when(F.col("idx") == F.col("cutoff"), F.col("archived"))), F.lit(0)).alias("archived_tokens"))


def islands(rows: DataFrame, flag: Column, by: list[str] | None = None) -> DataFrame:
    """Rows where flag holds, with `run`: the idx at which their unbroken run begins."""
    by = by or ["session_id"]
    order = W.partitionBy(*by).orderBy("idx")
    kept = rows.filter(flag).withColumn("_step", F.col("idx") - F.row_number().over(order))
    return kept.withColumn("run", F.min("idx").over(W.partitionBy(*by, "_step"))).drop("_step")


def compactable_runs(stages: DataFrame, least: int = 50, tail: int = 5) -> DataFrame:
    """(session_id, start, end) of runs of stage 3 of at least so many rows within [1, n - tail]."""
    m = stages.withColumn("n", F.count("*").over(in_session()))
    found = islands(m, (F.col("stage") == 3) & (F.col("idx") >= 1) & (F.col("idx") <= F.col("n") - tail))
    return found.groupBy("session_id", "run").agg(F.max("idx").alias("end")).filter(F.col("end") - F.col("run") + 1 >= least).select("session_id", F.col("run").alias("start"), "end")


def in_runs(rows: DataFrame, runs: DataFrame, at: str = "idx", parts: int | None = None) -> DataFrame:
    """Rows with `run`: the run (start, end and what else runs have) of their session in which they lie, null outside of all.

    Runs of a session are disjoint, so the last one that began before a row is the only one that can hold it: one
    window over both instead of a join of a session's rows with all its runs. parts: into how many tasks sessions are dealt.
    """
    run = F.struct(*(c for c in runs.columns if c != "session_id"))
    marks = runs.select("session_id", F.col("start").alias(at), run.alias("_mark"), F.lit(0).alias("_row"))
    both = rows.withColumn("_row", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    both = both.repartition(parts, "session_id") if parts else both
    before = W.partitionBy("session_id").orderBy(at, "_row").rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("_last", F.last("_mark", ignorenulls=True).over(before)).filter("_row = 1")
    return met.withColumn("run", F.when(F.col(at) <= F.col("_last")["end"], F.col("_last"))).drop("_row", "_mark", "_last")


def roles_between(left: Column, right: Column) -> Column:
    """The roles of the one or two rows that can stand between two rows so that users and assistants alternate."""
    known = lambda r: F.when(r.isin("user", "assistant"), r)
    other = lambda r: F.when(r == "user", "assistant").otherwise("user")
    a, b = known(left), known(right)
    return (
        F.when(a.isNull() & b.isNull(), F.array(F.lit("user"))).when(a.isNull(), F.array(other(b))).when(b.isNull() | (a == b), F.array(other(a))).otherwise(F.array(other(a), other(b)))
    )


def compacted_rows(roles: DataFrame, runs: DataFrame, parts: int | None = None) -> DataFrame:
    """(session_id, start, end, role): what replaces each run; roles has session_id, idx, role.

    A run between two different roles becomes two rows that halve it, any other run one row. The places beside runs
    find their rows by one window over both: no join that could send all rows to every task. parts: as for in_runs.
    """
    beside = F.array(F.struct((F.col("start") - 1).alias("idx"), F.lit(True).alias("_before")), F.struct((F.col("end") + 1).alias("idx"), F.lit(False).alias("_before")))
    both = roles.select("session_id", "idx", "role").unionByName(runs.select("session_id", "start", "end", F.inline(beside)), allowMissingColumns=True)
    both = both.repartition(parts, "session_id") if parts else both
    there = F.when(F.col("session_id").isNotNull(), F.max("role").over(W.partitionBy("session_id", "idx")))
    met = both.withColumn("role", there).filter("_before is not null").groupBy("session_id", "start", "end")
    r = met.agg(F.max(F.when(F.col("_before"), F.col("role"))).alias("left_role"), F.max(F.when(~F.col("_before"), F.col("role"))).alias("right_role")).withColumn("roles", roles_between(F.col("left_role"), F.col("right_role")))
    half = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2)
    piece = lambda a, b, role: F.struct(a.alias("start"), b.alias("end"), role.alias("role"))
    parts = F.when(F.size("roles") == 1, F.array(piece(F.col("start"), F.col("end"), F.element_at("roles", 1)))).otherwise(F.array(piece(F.col("start"), half, F.element_at("roles", 1)), piece(half + 1, F.col("end"), F.element_at("roles", -1))))
    return r.select("session_id", F.explode(parts).alias("p")).select("session_id", "p.*")


def fold_events(events: DataFrame, key: Column) -> DataFrame:
    """(session_id, idx, event, n): three or more neighbours of one key become their first with its count; empty keys never fold."""
    m = events.withColumn("_key", key)
    new = F.coalesce((F.col("_key") == "") | (F.col("_key") != F.lag("_key").over(in_order())), F.lit(True))
    m = m.withColumn("_run", F.sum(F.when(new, 1).otherwise(0)).over(in_order().rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("session_id", "_run")
    m = m.withColumn("n", F.count("*").over(run)).withColumn("_first", F.row_number().over(run.orderBy("idx")))
    return m.filter((F.col("n") <= 2) | (F.col("_first") == 1)).select("session_id", "idx", F.when(F.col("n") > 2, F.concat("event", F.lit(" ("), F.col("n").cast("string"), F.lit("x)"))).otherwise(F.col("event")).alias("event"), F.when(F.col("n") > 2, F.col("n")).otherwise(1).alias("n"))


def merge_adjacent(messages: DataFrame) -> DataFrame:
    """(session_id, idx, role, texts): neighbours of one role become one row with all their texts in order."""
    new = F.coalesce(F.col("role") != F.lag("role").over(in_order()), F.lit(True))
    m = messages.withColumn("_run", F.sum(F.when(new, 1).otherwise(0)).over(in_order().rowsBetween(W.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    return m.groupBy("session_id", "_run").agg(F.min("idx").alias("idx"), F.first("role").alias("role"), texts.alias("texts")).drop("_run")


def keep_last_marks(blocks: DataFrame, limit: int = 4) -> DataFrame:
    """Blocks with `marked`, of which each session keeps the last `limit`."""
    rank = F.row_number().over(in_session().orderBy(F.col("marked").desc(), F.desc("idx"), F.desc("pos")))
    return blocks.withColumn("marked", F.col("marked") & (rank <= limit))


def boundary_mark(blocks: DataFrame, boundary: Column, limit: int = 4, ttl: str = "ephemeral") -> DataFrame:
    """Strips all marks, sets one on the last block of the row before the boundary, and gives marks one time to live: 1h if any had it."""
    last = F.max(F.when(F.col("idx") == boundary - 1, F.col("pos"))).over(in_session())
    hour = F.max((F.col("marked") & (F.coalesce(F.col("ttl"), F.lit("")) == "1h")).cast("int")).over(in_session())
    m = blocks.withColumn("_hour", hour).withColumn("marked", F.coalesce((F.col("idx") == boundary - 1) & (F.col("pos") == last), F.lit(False)))
    return keep_last_marks(m, limit).withColumn("ttl", F.when(F.col("marked"), F.when((F.col("_hour") == 1) | F.lit(ttl == "1h"), "1h").otherwise(ttl))).drop("_hour")


def request_sequence(requests: DataFrame) -> DataFrame:
    """Adds seq: 1, 2, ... within session and epoch by time."""
    return requests.withColumn("seq", F.row_number().over(W.partitionBy("session_id", "epoch").orderBy("ts", "request_id")))


def latest_user_text(messages: DataFrame, skip_empty: bool = False) -> DataFrame:
    """(session_id, latest) of the last user row; with skip_empty of the last that says something."""
    m = messages.filter("role = 'user'")
    return (m.filter("text <> ''") if skip_empty else m).groupBy("session_id").agg(F.max_by("text", "idx").alias("latest"))
