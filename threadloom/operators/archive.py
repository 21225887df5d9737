"""Folding the beginning of a history into one archive row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions import tokens as T
from threadloom.operators.history import fold_events


def tool_counts(uses: DataFrame) -> DataFrame:
    return uses.filter("name <> ''").groupBy("session_id", "name").agg(F.count("*").alias("n"))


def top_counts(counts: DataFrame, *by: str, most: int = 5) -> DataFrame:
    """(by, line) of counts (by, key, n): the largest as key(n), and how many more. Only `most` keys of a group are ever in one place."""
    order = W.partitionBy(*by).orderBy(F.desc("n"), "key")
    top = counts.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("_k", "key", "n"))), lambda x: F.concat(x["key"], F.lit("("), x["n"].cast("string"), F.lit(")")))
    rest = F.when(F.col("all") > most, F.concat(F.lit(", +"), (F.col("all") - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    lines = top.groupBy(*by).agg(F.array_join(shown, ", ").alias("line")).join(counts.groupBy(*by).agg(F.count("*").alias("all")), list(by))
    return lines.select(*by, F.concat("line", rest).alias("line"))


def files(uses: DataFrame) -> DataFrame:
    """(session_id, path): the distinct paths that calls name."""
    return uses.select("session_id", F.explode(X.all_paths(F.col("input"))).alias("path")).distinct()


def file_counts(uses: DataFrame, *by: str) -> DataFrame:
    """(session_id, key, n), or of other columns than session_id: how often calls name each file, by its base name."""
    by = by or ("session_id",)
    named = F.array_compact(F.array(X.filled(F.col("input"), "file_path"), X.filled(F.col("input"), "path")))
    return uses.select(*by, F.explode(named).alias("p")).groupBy(*by, F.substring_index("p", "/", -1).alias("key")).agg(F.count("*").alias("n"))


def timeline(uses: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(session_id, idx, event) of calls that do something and of what users say."""
    events = uses.select("session_id", "idx", X.timeline_event(F.col("name"), F.col("input"), F.col("idx")).alias("event"))
    if texts is not None:
        events = events.unionByName(texts.filter("role = 'user'").select("session_id", "idx", X.user_event(F.col("text"), F.col("idx")).alias("event")))
    return events.filter("event is not null")


def keywords(uses: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(session_id, keyword, source): paths, tools and words of users, each once."""
    found = files(uses).select("session_id", F.col("path").alias("keyword"), F.lit("file_path").alias("source"))
    found = found.unionByName(tool_counts(uses).select("session_id", F.col("name").alias("keyword"), F.lit("tool_name").alias("source")))
    if texts is not None:
        said = texts.filter("role = 'user'").select("session_id", F.explode(X.content_words(F.col("text"))).alias("keyword")).distinct()
        found = found.unionByName(said.withColumn("source", F.lit("user_message")))
    return found


def archive_blocks(uses: DataFrame, results: DataFrame, texts: DataFrame) -> DataFrame:
    """(session_id, message_count, estimated_tokens, range_start, range_end, summary_text, content_hash) of whole frames.

    Callers cut the frames to the range to be archived. uses: session_id, idx, name, input, tok; results:
    session_id, idx, is_error, tok; texts: session_id, idx, role, text, tok. Each part is one grouped
    aggregation by session, so the parts meet on one key.
    """
    by = ["session_id"]
    rows = uses.select("session_id", "idx", "tok").unionByName(results.select("session_id", "idx", "tok")).unionByName(texts.select("session_id", "idx", "tok"))
    span = rows.groupBy(*by).agg(F.min("idx").alias("range_start"), F.max("idx").alias("range_end"), F.countDistinct("idx").alias("message_count"), F.sum("tok").alias("estimated_tokens"))
    tools = tool_counts(uses).groupBy(*by).agg(F.collect_list(F.struct(F.col("name").alias("key"), "n")).alias("tools"))
    paths = files(uses).groupBy(*by).agg(F.array_sort(F.collect_list("path")).alias("files"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("idx", c))), lambda x: x[c])
    told = fold_events(timeline(uses, texts), X.run_key(F.col("event"))).groupBy(*by).agg(ordered("event").alias("timeline"))
    commits = uses.filter((F.col("name") == "Bash") & F.try_element_at("input", F.lit("command")).contains("git commit")).withColumn("message", X.commit_message(F.try_element_at("input", F.lit("command")))).filter("message <> ''")
    commits = commits.groupBy(*by).agg(ordered("message").alias("commits"))
    errors = results.groupBy(*by).agg(F.count_if(F.coalesce("is_error", F.lit(False))).alias("errors"))
    ends = texts.filter("role = 'assistant'").withColumn("said", X.conclusion(F.col("text"))).filter("said <> ''").groupBy(*by).agg(F.max_by("said", "idx").alias("conclusion"))
    out = span
    for part in (tools, paths, told, commits, errors, ends):
        out = out.join(part, by, "left")
    none = F.array().cast("array<string>")
    text = X.archive_text(
        F.col("range_start"), F.col("range_end"), F.col("message_count"), F.col("estimated_tokens"), F.coalesce("tools", F.array().cast("array<struct<key:string,n:bigint>>")),
        F.coalesce("files", none), F.coalesce("commits", none), F.coalesce("timeline", none), F.coalesce("errors", F.lit(0)), F.coalesce("conclusion", F.lit("")),
    )
    out = out.withColumn("summary_text", text)
    return out.select("session_id", "range_start", "range_end", "message_count", "estimated_tokens", "summary_text", F.sha2("summary_text", 256).alias("content_hash"))


def collapsed(messages: DataFrame, cutoffs: DataFrame, summaries: DataFrame) -> DataFrame:
    """(session_id, idx, role, text): a placeholder for row 0, the archive row, the tail; sessions without a cutoff as they were.

    cutoffs: session_id, cutoff, archived_tokens; summaries: session_id, summary_text.
    """
    m = messages.join(cutoffs.filter("cutoff > 0").select("session_id", "cutoff", "archived_tokens"), "session_id", "left")
    placeholder = F.concat(F.lit("[Earlier conversation archived — "), (F.col("cutoff") - 1).cast("string"), F.lit(" messages, ~"), F.col("archived_tokens").cast("string"), F.lit(" tokens. Operations: file reads, edits, tool calls, commits. Use reexpand to retrieve specific details.]"))
    kept = m.filter("cutoff is null or idx = 0 or idx >= cutoff")
    first = F.col("cutoff").isNotNull() & (F.col("idx") == 0) & ~X.is_persistent(F.coalesce("text", F.lit("")))
    rows = kept.select("session_id", F.when(F.col("cutoff").isNull() | (F.col("idx") == 0), F.col("idx")).otherwise(F.col("idx") - F.col("cutoff") + 2).alias("idx"), "role", F.when(first, placeholder).otherwise(F.col("text")).alias("text"))
    row = cutoffs.filter("cutoff > 0").join(summaries, "session_id").select("session_id", F.lit(1).cast("bigint").alias("idx"), F.lit("user").alias("role"), F.col("summary_text").alias("text"))
    return rows.unionByName(row)


def full_messages(rows: DataFrame, room: int) -> DataFrame:
    """(session_id, text): the last messages that fit into `room` code points, in order, and how many are left out before them."""
    line = F.concat(F.lit("["), F.col("role"), F.lit("]: "), X.truncate(F.col("text"), 2000))
    m = rows.filter("text <> ''").select("session_id", "idx", line.alias("line"))
    down = W.partitionBy("session_id").orderBy(F.desc("idx"))
    m = m.withColumn("used", F.sum(F.length("line") + 1).over(down.rowsBetween(W.unboundedPreceding, 0)))
    fits = m.filter(F.col("used") <= room)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n")
    left = m.filter(F.col("used") > room).groupBy("session_id").agg((F.max("idx") + 1).alias("omitted"))
    out = fits.groupBy("session_id").agg(text.alias("text")).join(left, "session_id", "left")
    return out.select("session_id", F.when(F.col("omitted").isNotNull(), F.concat(F.lit("[..."), F.col("omitted").cast("string"), F.lit(" earlier messages omitted...]\n"), F.col("text"))).otherwise(F.col("text")).alias("text"))


def message_lines(blocks: DataFrame) -> DataFrame:
    """(session_id, lines) of histories of blocks (session_id, idx, pos, role, type, text, name, content): what a full expansion can show, for last_lines."""
    # A block's piece is cut before anything is shuffled: whole answers and thinking stay where they are read.
    told = blocks.filter(F.col("type").isin("text", "tool_use", "tool_result")).select("session_id", "idx", "pos", "role", X.message_piece(F.struct("type", "text", "name", "content")).alias("piece"))
    b = told.filter("piece <> ''").repartition("session_id").groupBy("session_id", "idx").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"))
    m = b.select("session_id", "idx", X.line_of_pieces(F.col("role"), F.transform("pieces", lambda p: p["piece"])).alias("line"))
    return m.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("lines"))


def tokens_of(frame: DataFrame, role: str, column: str) -> DataFrame:
    return frame.withColumn("tok", T.message_tokens(F.lit(role), T.estimate(F.col(column))))
