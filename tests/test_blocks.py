"""Whole histories of blocks: one exchange, and what each stage does on small ones."""

import re

from threadloom.operators.blocks import forwarded_blocks
from threadloom.plans.views import BLOCK

SCHEMA = f"session_id bigint, idx bigint, pos int, role string, {BLOCK}, seq int, stubbed_at int, heat double, pinned boolean"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
WORDS = "word " * 600  # 750 tokens


def block(idx, pos, role, type_, session=1, **known):
    row = {"session_id": session, "idx": idx, "pos": pos, "role": role, "type": type_, "seq": 300, "pinned": False, "heat": 0.0, **known}
    return tuple(row.get(c) for c in NAMES)


def text(idx, role, said, **more):
    return block(idx, 0, role, "text", text=said, **more)


def call(idx, id_, name="Read", session=1, pos=0, **input_):
    return block(idx, pos, "assistant", "tool_use", session, id=id_, name=name, input=input_ or {"file_path": "a/b.py"})


def answer(idx, id_, content, pos=0, session=1, error=False):
    return block(idx, pos, "user", "tool_result", session, tool_use_id=id_, content=content, is_error=error)


def out(spark, rows, threshold=10**9, floor=10**9, **options):
    df = forwarded_blocks(spark.createDataFrame(rows, SCHEMA), threshold, floor, **options)
    return [tuple(r) for r in df.orderBy("session_id", "idx", "pos").selectExpr("session_id", "idx", "pos", "role", "type", "coalesce(content, text, thinking) as body").collect()]


def test_one_exchange(spark):
    plan = forwarded_blocks(spark.createDataFrame([text(0, "user", "x")], SCHEMA), 10, 5)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange \w+partitioning", plan)) == 1 and "Join" not in plan


def test_below_the_threshold(spark):
    """Large answers that were taken up become stubs, orphans go and neighbours join; nothing else changes."""
    rows = [text(0, "user", "go"), call(1, "a"), answer(2, "a", WORDS), text(3, "user", "and"), text(4, "assistant", "ok"), answer(5, "gone", "lost"), text(6, "assistant", "done"), text(7, "user", "last")]
    got = out(spark, rows)
    assert got == [
        (1, 0, 0, "user", "text", "go"), (1, 1, 0, "assistant", "tool_use", None), (1, 2, 0, "user", "tool_result", "[Read a/b.py — 1 lines]"), (1, 2, 1, "user", "text", "and"),
        (1, 3, 0, "assistant", "text", "ok"), (1, 3, 1, "assistant", "text", "done"), (1, 4, 0, "user", "text", "last"),
    ]
    assert [r[5] for r in out(spark, [text(0, "user", "go"), call(1, "a"), answer(2, "a", WORDS)])] == ["go", None, WORDS]  # the active pair


def test_thinking(spark):
    """Large signed thinking goes unless it stands alone, unsigned becomes a placeholder; stubbing takes that of long rows, and a row of thinking alone stays empty."""
    thought = lambda idx, pos, sign: block(idx, pos, "assistant", "thinking", thinking=WORDS, signature=sign)
    rows = [text(0, "user", "q"), thought(1, 0, "s"), block(1, 1, "assistant", "text", text="said"), text(2, "user", "r"), thought(3, 0, None), block(3, 1, "assistant", "text", text="more"), text(4, "user", "t"), thought(5, 0, "s"), text(6, "user", "end")]
    got = {(i, p): (t, b) for _, i, p, _, t, b in out(spark, rows, threshold=100, keep_recent=1)}
    assert got == {(0, 0): ("text", "q"), (1, 0): ("text", "said"), (2, 0): ("text", "r"), (3, 0): ("thinking", "[context compressed: thinking block]"), (3, 1): ("text", "more"), (4, 0): ("text", "t"), (5, 0): (None, None), (6, 0): ("text", "end")}


def test_folding_and_stubs(spark):
    rows = [text(0, "user", "first")]
    for k in range(1, 21):
        rows += [call(2 * k - 1, f"c{k}", "Edit", file_path=f"f{k}.py"), answer(2 * k, f"c{k}", WORDS, error=k == 3)]
    folded = out(spark, rows, threshold=1000, floor=1000, keep_recent=2)
    assert folded[0][5].startswith("[Earlier conversation archived — ") and folded[0][3] == "user"
    summary = next(r[5] for r in folded if r[5] and r[5].startswith("Archived messages 0–"))
    assert "### Tools Used\nEdit(" in summary and "- f1.py\n" in summary and "- [1] Edit: f1.py\n" in summary and "### Gotchas\n- [tool error]\n" in summary
    stubs = out(spark, rows, threshold=1000, keep_recent=2)
    assert [r[5] for r in stubs[:3]] == ["first", "[→] Edit f1.py -- file on disk is current → deep_search('Edit f1.py')", "[tool result archived] → deep_search('Edit f1.py')"]
    assert stubs[-1][5] == WORDS and stubs[-2][4] == "tool_use"  # the active pair
    roles = [r[3] for r in stubs]
    assert all(a != b for a, b in zip(roles, roles[1:], strict=False))


def test_forced_answers(spark):
    """A recent answer whose call became a stub becomes one too, a second answer in a row of its own does not and goes as an orphan."""
    rows = [text(0, "user", "x"), call(1, "a"), call(1, "b", pos=1), answer(2, "a", "one"), answer(3, "b", "two"), text(4, "assistant", "z " * 400)]
    got = out(spark, rows, threshold=50, keep_recent=3)
    assert [r[5] for r in got if r[3] == "user"] == ["x", "[tool result archived] → deep_search('Read a/b.py')"]


def test_compaction(spark):
    """A run of 60 old rows becomes one row or two so that roles alternate; files and tools are counted."""
    rows = [text(0, "user", "go " * 100)]
    for k in range(1, 41):
        rows += [call(2 * k - 1, f"c{k}", "Edit" if k % 2 else "Read", file_path=f"d/f{k % 3}.py"), answer(2 * k, f"c{k}", "ok")]
    old = NAMES.index("stubbed_at")
    rows = [(*r[:old], 1, *r[old + 1 :]) if 1 <= r[1] <= 60 else r for r in rows]
    got = out(spark, rows, threshold=100, keep_recent=4)
    made = [r for r in got if r[5] and r[5].startswith("[Compacted: ")]
    assert [r[5].split("\n")[0] for r in made] == ["[Compacted: Messages 1-60 (60 msgs)]"] and made[0][3] == "assistant" or len(made) == 2
    assert "Tools: Edit(" in made[0][5] and "Files: f" in made[0][5]


def test_nulls_and_empty(spark):
    assert out(spark, []) == []
    rows = [block(0, 0, "user", None), text(1, "assistant", None), text(2, "user", ""), answer(3, None, None), call(4, None), text(0, "user", "other", session=2)]
    assert len(out(spark, rows)) == 6 and len(out(spark, rows, threshold=1, floor=1, keep_recent=0)) >= 2
