"""Blocks that show shared texts give the same without them, and get them last."""

from test_blocks import NAMES, SCHEMA, WORDS, answer, block, call, text
from test_texts_last import exchanged

from threadloom.operators import blocks as B
from threadloom.plans import catalog

TEXTS = ["ok", WORDS, "a\n" * 600, "func run(x)\ntype T\n" * 150, "", "l\n" * 5 + WORDS, None]
FLAT = ", ".join(f"cast({c} as string)" for c in ("session_id", "idx", "pos", "role", "type", "text", "thinking", "id", "name", "to_json(input)", "tool_use_id", "content", "is_error"))


def history(session, n):
    rows = [text(0, "user", "first", session=session)]
    for k in range(1, n + 1):
        said = TEXTS[(k + session) % len(TEXTS)]
        name, input_ = [("Read", {"file_path": f"f{k}.py"}), ("Bash", {"command": "ls"}), ("Glob", {"pattern": "*.py"}), ("Agent", {"description": "look"}), ("Grep", {"pattern": "x", "path": "src"})][k % 5]
        rows += [block(2 * k - 1, 0, "assistant", "thinking", session, thinking=said, signature="s" if k % 2 else None), call(2 * k - 1, f"c{k}", name, session, 1, **input_)]
        rows += [answer(2 * k, f"c{k}" if k % 7 else "gone", said, session=session, error=k % 3 == 0)]
    return rows


def test_same_without_texts(spark):
    rows = [r for session in range(6) for r in history(session, 24)]
    whole = spark.createDataFrame(rows, SCHEMA)
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "text_id bigint, content string")
    place = NAMES.index("content"), NAMES.index("thinking")
    apart = [(*(None if i in place else v for i, v in enumerate(r)), TEXTS.index(r[place[0]] if r[place[0]] is not None else r[place[1]]) if r[NAMES.index("type")] in ("tool_result", "thinking") else None) for r in rows]
    shown = spark.createDataFrame(apart, SCHEMA + ", text_id bigint").join(texts.select("text_id", B.text_facts(texts["content"]).alias("facts")), "text_id", "left")
    for threshold, floor in ((1000, 1000), (1000, 10**9)):
        want = B.forwarded_blocks(whole, threshold, floor, keep_recent=2)
        got = B.forwarded_blocks(shown, threshold, floor, keep_recent=2, texts=texts)
        assert got.columns == want.columns
        assert sorted(map(str, got.selectExpr(f"array({FLAT})").collect())) == sorted(map(str, want.selectExpr(f"array({FLAT})").collect()))


def test_no_text_by_session(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        plan = catalog.queries()["e2e_blocks"](spark, sf)._jdf.queryExecution()
        found = list(exchanged(plan.executedPlan()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    carried = [columns for how, columns in found if "session_id" in how.split("]")[0] and "facts" in columns]
    assert len(carried) == 1
    assert len([how for how, columns in found if columns & {"_text"}]) == 1
