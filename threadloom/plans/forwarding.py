"""The whole way of a request's history: cleaned, measured, cut, folded, repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.config import EngineConfig
from threadloom.functions import text as X
from threadloom.functions import tokens as T
from threadloom.operators import archive as A
from threadloom.operators import history as H


def cleaned(messages: DataFrame) -> DataFrame:
    """Reminders out of all rows but the last user's; rows that would become empty stay as they are."""
    m = messages.withColumn("_last", F.max(F.when(F.col("role") == "user", F.col("idx"))).over(H.in_session()))
    out = X.strip_reminders(F.col("text"))
    return m.withColumn("text", F.when((F.col("idx") == F.col("_last")) | (F.coalesce(out, F.lit("")) == ""), F.col("text")).otherwise(out)).drop("_last")


def detached(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history without persistent context, (session_id, context)): the earliest span is a session's context; emptied rows go."""
    m = messages.withColumn("_spans", F.when(F.col("role") == "user", X.persistent_spans(F.col("text"))))
    context = m.filter(F.size("_spans") > 0).groupBy("session_id").agg(F.min_by(F.get("_spans", F.lit(0)), "idx").alias("context"))
    kept = m.withColumn("_rest", F.when(F.size("_spans") > 0, X.without_persistent(F.col("text"))).otherwise(F.col("text"))).filter((F.size("_spans") <= 0) | F.col("_spans").isNull() | (X.trim(F.col("_rest")) != ""))
    kept = kept.withColumn("text", F.col("_rest")).withColumn("idx", (F.row_number().over(H.in_order()) - 1).cast("bigint"))
    return kept.drop("_spans", "_rest"), context


def with_context(messages: DataFrame, context: DataFrame) -> DataFrame:
    """A session's context once, in front of its history."""
    m = messages.join(context.select("session_id", F.lit(1).alias("_c")), "session_id", "left")
    m = m.withColumn("idx", F.col("idx") + F.coalesce("_c", F.lit(0))).drop("_c")
    first = context.select("session_id", F.lit(0).cast("bigint").alias("idx"), F.lit("user").alias("role"), F.col("context").alias("text"))
    return m.unionByName(first, allowMissingColumns=True)


def forwarded(messages: DataFrame, config: EngineConfig | None = None, floor: int | None = None) -> DataFrame:
    """(session_id, idx, role, text) of what goes on: context taken out, cleaned, context in front, folded where the history is over the floor.

    messages: session_id, idx, role, text. All steps keep the session as their key.
    """
    c = config or EngineConfig()
    history, context = detached(messages)
    history = cleaned(history).withColumn("tok", T.message_tokens(F.col("role"), T.estimate(F.col("text"))))
    cuts = H.collapse_cutoff(history, floor if floor is not None else c.collapse_floor, c.keep_recent, c.max_messages)
    prefix = history.join(cuts.filter("cutoff > 0").select("session_id", "cutoff"), "session_id").filter("idx < cutoff")
    no_uses = history.sparkSession.createDataFrame([], "session_id bigint, idx bigint, name string, input map<string,string>, tok bigint")
    no_results = history.sparkSession.createDataFrame([], "session_id bigint, idx bigint, is_error boolean, tok bigint")
    summaries = A.archive_blocks(no_uses, no_results, prefix).select("session_id", "summary_text")
    return with_context(A.collapsed(history.select("session_id", "idx", "role", "text"), cuts, summaries), context)


def shares(messages: DataFrame) -> DataFrame:
    """Adds each row's share of its session's tokens and the running total."""
    w = W.partitionBy("session_id")
    return messages.withColumn("share", F.col("tok") / F.sum("tok").over(w)).withColumn("running", F.sum("tok").over(w.orderBy("idx")))
