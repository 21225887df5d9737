"""Lines of messages are made of pieces that are cut before anything is shuffled, and are the same."""

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import archive as A
from threadloom.plans import recall, views


def test_no_answer_is_shuffled(spark, sf):
    blocks = views.histories(spark, sf)
    plan = A.message_lines(blocks)._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(line for line in plan.splitlines() if "collect_list" in line and "piece" in line)
    assert "content" not in grouped
    assert "substring(text" in recall.full_blocks(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_same_lines(spark):
    long = "```x " * 500
    rows = [("s", 0, 0, "user", "text", long, None, None), ("s", 0, 1, "user", "tool_result", None, None, long), ("s", 1, 0, "assistant", "thinking", None, None, None), ("s", 1, 1, "assistant", "tool_use", None, None, None), ("s", 2, 0, "user", "tool_result", None, None, ""), ("s", 3, 0, "user", "text", "a" * 1999, None, None), ("s", 3, 1, "user", "text", "", None, None), ("s", 4, 0, "user", "text", None, None, None), ("s", 4, 1, "user", "tool_result", None, None, "b" * 200), ("s", 5, 0, "user", "text", "é" * 2001, None, None), ("s", 6, 0, "user", "text", "c" * 2000, None, None)]
    b = spark.createDataFrame(rows, "session_id string, idx bigint, pos int, role string, type string, text string, name string, content string")
    whole = b.groupBy("idx").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("pos", "type", "text", "name", "content"))).alias("blocks"))
    answer = lambda x: F.when(F.coalesce(x["content"], F.lit("")) != "", F.concat(F.lit("[result] "), X.truncate(x["content"], 200)))
    piece = lambda x: F.when(x["type"] == "text", x["text"]).when(x["type"] == "tool_use", F.concat(F.lit("[tool: "), F.coalesce(x["name"], F.lit("")), F.lit("]"))).when(x["type"] == "tool_result", answer(x))
    said = F.array_join(F.filter(F.transform("blocks", piece), lambda p: F.coalesce(p, F.lit("")) != ""), "\n")
    want = whole.select("idx", F.when(said != "", F.concat(F.lit("["), F.col("role"), F.lit("]: "), X.truncate(said, 2000))).alias("line")).filter("line is not null").orderBy("idx").collect()
    assert [tuple(r) for r in A.message_lines(b).first().lines] == [tuple(r) for r in want] and len(want) == 6
