"""Full expansion and the figures of a recall, by hand."""

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import search as S

BLOCKS = "role string, blocks array<struct<type:string,text:string,name:string,content:string>>"


def line(role, blocks):
    said = []
    for kind, text, name, content in blocks:
        if kind == "text" and text:
            said.append(text)
        if kind == "tool_use":
            said.append(f"[tool: {name or ''}]")
        if kind == "tool_result" and content:
            said.append("[result] " + (content if len(content) <= 200 else content[:200] + "…"))
    said = "\n".join(said)
    return f"[{role}]: " + (said if len(said) <= 2000 else said[:2000] + "…") if said else None


MESSAGES = [
    ("user", [("text", "héllo", None, None)]), ("assistant", [("text", "", None, None), ("tool_use", None, "Read", None), ("tool_use", None, None, None)]), ("user", [("tool_result", None, None, "r" * 300), ("text", "and", None, None)]),
    ("assistant", [("thinking", None, None, None)]), ("user", []), ("assistant", [("text", "x" * 3000, None, None)]), ("user", [("tool_result", None, None, ""), ("text", "😀 end", None, None)]),
]


def test_lines_and_room(spark):
    rows = spark.createDataFrame([(r, b) for r, b in MESSAGES], BLOCKS)
    got = [r[0] for r in rows.coalesce(1).select(X.message_line(F.col("role"), F.col("blocks"))).collect()]
    assert got == [line(r, b) for r, b in MESSAGES]
    lines = [(i, x) for i, x in enumerate(got) if x]
    frame = spark.createDataFrame([(lines, room) for room in (0, 5, 14, 15, 16, 2000, 2040, 2400, 9000)] + [([], 50)], "lines array<struct<idx:bigint,line:string>>, room int")
    for r in frame.withColumn("got", X.last_lines(F.col("lines"), F.col("room"))).collect():
        used, taken, left = 0, [], 0
        for i, x in reversed(r.lines):
            used += len(x) + 1
            if used > r.room:
                left = i + 1
                break
            taken.insert(0, x)
        want = (f"[...{left} earlier messages omitted...]\n" if left else "") + "\n".join(taken) if taken else None
        assert r.got == want


def test_one_expansion_a_request(spark):
    """The first block that can brings its messages; none whose messages are still there or that has none; the next fall back to summaries."""
    line_ = [(0, "[user]: " + "a" * 400), (1, "[assistant]: bb")]
    rows = [("q", 1, 10, "p ", "sum one", line_, True), ("q", 2, 20, "p ", "sum two", line_, False), ("q", 3, 30, "p ", "sum three", line_, False), ("r", 1, 40, "p ", "sum", None, False), ("s", 1, 50, "p ", "s" * 90, line_, False)]
    c = spark.createDataFrame(rows, "query_id string, place int, block_id bigint, prefix string, summary_text string, lines array<struct<idx:bigint,line:string>>, raw_there boolean")
    got = {(r.query_id, r.block_id): (r.level, r.cost, r.full) for r in S.budgeted(c, F.when(F.col("query_id") == "s", 24).otherwise(200)).collect()}
    whole = line_[0][1] + "\n" + line_[1][1]
    part = f"[...1 earlier messages omitted...]\n{line_[1][1]}"
    assert got["q", 10] == (2000, len("p sum one") // 4, None)
    assert got["q", 20] in [(0, len("p sum two" + S.FULL + t) // 4, t) for t in (whole, part)]
    assert got["q", 30] == (2000, len("p sum three") // 4, None) and got["r", 40] == (2000, len("p sum") // 4, None) and got["s", 50] == (2000, 23, None)


def test_figures_of_a_run(spark):
    rows = [(1, 2, 2, 1, 1, 30, 700, 670), (2, 0, 0, 0, 0, 0, 700, 700)]
    out = spark.createDataFrame(rows, "session_id bigint, candidates bigint, selected bigint, injected bigint, discarded bigint, cost bigint, budget_limit bigint, remaining bigint")
    frame, seen = S.outcome_totals(out)
    assert frame.count() == 2
    assert seen.get == {"attempted": 2, "candidates": 2, "selected": 2, "injected": 1, "discarded": 1, "cost": 30, "remaining": 1370}
