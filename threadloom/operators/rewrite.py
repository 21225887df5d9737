"""Rewriting of large blocks, and repair of pairs of calls and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions import tokens as T
from threadloom.operators.history import in_session, rows_before


def with_calls(results: DataFrame, uses: DataFrame, previous_only: bool = False) -> DataFrame:
    """Answers with use_idx, name, input and keywords of their calls, of calls that share an id the last; with previous_only just the call in the row before counts.

    Calls and answers meet in a window of their session, so that the answers' texts are shuffled once, by session:
    what joins them by session afterwards moves no text.
    """
    calls = uses.filter("id <> ''").select("session_id", F.col("id").alias("tool_use_id"), F.struct(F.col("idx").alias("use_idx"), "name", "input").alias("_call"))
    both = results.withColumn("_answer", F.lit(True)).unionByName(calls, allowMissingColumns=True).repartition("session_id")
    call = F.max_by("_call", F.col("_call.use_idx")).over(W.partitionBy("session_id", "tool_use_id"))
    met = both.withColumn("_call", call).filter("_answer").select(*results.columns, "_call.*")
    known = F.col("use_idx").isNotNull()
    if previous_only:
        known = F.col("use_idx") == F.col("idx") - 1
        met = met.withColumns({c: F.when(known, F.col(c)) for c in ("name", "input")})
    return met.withColumn("keywords", F.when(known, X.tool_keywords(F.col("name"), F.col("input"))))


def orphans(results: DataFrame, uses: DataFrame) -> DataFrame:
    """Answers whose call is nowhere in their session."""
    calls = uses.filter("id <> ''").select("session_id", F.col("id").alias("tool_use_id")).distinct()
    return results.filter("tool_use_id <> ''").join(calls, ["session_id", "tool_use_id"], "left_anti")


def repaired(results: DataFrame, uses: DataFrame) -> DataFrame:
    """Answers without orphans."""
    calls = uses.filter("id <> ''").select("session_id", F.col("id").alias("tool_use_id")).distinct()
    return results.filter("tool_use_id = '' or tool_use_id is null").unionByName(results.filter("tool_use_id <> ''").join(calls, ["session_id", "tool_use_id"], "left_semi").select(results.columns))


def with_texts(answers: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Answers with their content: their own, or that of texts (text_id, content)."""
    return answers if texts is None else answers.join(texts, "text_id")


def compress(results: DataFrame, uses: DataFrame, sizes: DataFrame, keep_recent: int, least: int = 500, texts: DataFrame | None = None) -> DataFrame:
    """(session_id, idx, tool_use_id, content, compressed): large answers before the recent rows become summaries.

    sizes: session_id, n, active_from (the first row of the active pair, null if there is none). Where answers share
    texts, results may have text_id in place of content; texts (text_id, content) are joined last then.
    """
    m = with_texts(with_calls(results, uses).join(sizes, "session_id"), texts)
    within = (F.col("idx") >= 1) & (F.col("idx") < F.greatest(F.col("n") - keep_recent, F.lit(1))) & (F.col("active_from").isNull() | (F.col("idx") < F.col("active_from")))
    large = within & (T.estimate(F.col("content")) > least)
    summary = X.result_summary(F.coalesce("name", F.lit("tool")), X.result_facts(F.col("content")), F.coalesce("keywords", F.lit("")))
    return m.select("session_id", "idx", "tool_use_id", F.when(large, summary).otherwise(F.col("content")).alias("content"), large.alias("compressed"))


def saved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(compressed, saved): how many answers were compressed and the tokens that saves, 0 at least."""
    tokens = F.coalesce(F.sum(T.estimate(F.col("content"))), F.lit(0))
    whole = before.agg(tokens.alias("n")).scalar()
    return after.agg(F.count_if("compressed").alias("compressed"), tokens.alias("left")).select("compressed", F.greatest(whole - F.col("left"), F.lit(0)).alias("saved"))


def compress_thinking(blocks: DataFrame, least: int = 500) -> DataFrame:
    """Thinking blocks of old rows: large signed ones go unless the row has nothing else, large unsigned ones become a placeholder."""
    row = W.partitionBy("session_id", "idx")
    signed = (F.col("type") == "thinking") & (F.coalesce("signature", F.lit("")) != "")
    m = blocks.withColumn("_other", F.max((~signed).cast("int")).over(row))
    large = (F.col("type") == "thinking") & (T.estimate(F.col("thinking")) > least) & (F.col("_other") == 1)
    return m.filter(~(large & signed)).withColumn("thinking", F.when(large, "[context compressed: thinking block]").otherwise(F.col("thinking"))).drop("_other")


def eager(results: DataFrame, uses: DataFrame, rows: DataFrame, boundary: int = 0, least: int = 500, remembered: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(session_id, idx, tool_use_id, content, fresh, sticky): answers that an assistant has seen become stubs if large or once stubbed.

    rows: session_id, n, last_assistant, active_result (null if there is none). texts: as for compress.
    """
    m = with_calls(results, uses, previous_only=True).join(rows, "session_id")
    known = F.lit(False)
    if remembered is not None:
        m = m.join(remembered.select("session_id", "tool_use_id", F.lit(True).alias("_known")).distinct(), ["session_id", "tool_use_id"], "left")
        known = F.coalesce("_known", F.lit(False))
    m = with_texts(m, texts)
    usable = (F.col("idx") >= boundary) & (F.col("active_result").isNull() | (F.col("idx") != F.col("active_result")))
    seen = F.col("last_assistant") > F.col("idx")
    sticky = usable & known
    fresh = usable & ~known & seen & (T.estimate(F.col("content")) > least)
    stub = X.eager_stub(F.col("name"), F.col("input"), F.col("content"))
    return m.select("session_id", "idx", "tool_use_id", F.when(sticky | fresh, stub).otherwise(F.col("content")).alias("content"), fresh.alias("fresh"), sticky.alias("sticky"))


def stubbed_rows(blocks: DataFrame, keep_recent: int, pivot: DataFrame | None = None, least: int = 80) -> DataFrame:
    """Adds to message rows (session_id, idx, role, text, tok, has_use, has_result, active) what stubbing does with them: `action`.

    keep for row 0, the active pair, short rows without tools and recent or protected rows, else stub. A recent
    or protected answer whose call was stubbed is stubbed too: the call is in the last stubbed row before it, and
    a run of such rows is settled by the nearest row that isn't a candidate, so one window over the rows suffices.
    """
    m = blocks if pivot is None else blocks.join(pivot, "session_id", "left")
    latest = F.col("latest") if pivot is not None else F.lit("")
    n = F.count("*").over(in_session())
    tools = F.col("has_use") | F.col("has_result")
    fixed = (F.col("idx") == 0) | F.col("active") | ((F.col("tok") <= least) & ~tools)
    guarded = (F.col("idx") >= n - keep_recent) | X.is_pivot(F.coalesce("text", F.lit("")), latest) | X.is_task_list(F.coalesce("text", F.lit("")))
    m = m.withColumn("_sure", F.when(fixed, F.lit(None)).when(~guarded, F.lit(True)))
    had_use = F.last(F.when(F.col("_sure"), F.col("has_use")), ignorenulls=True).over(rows_before())
    forced = ~fixed & guarded & F.col("has_result") & F.coalesce(had_use, F.lit(False))
    return m.withColumn("action", F.when(F.coalesce("_sure", F.lit(False)) | forced, "stub").otherwise("keep")).drop("_sure")
