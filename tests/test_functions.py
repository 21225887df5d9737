"""Values of column functions on small inputs."""

import base64
import json
import struct

from pyspark.sql import functions as F

from threadloom.config import EngineConfig
from threadloom.functions import requests as RQ
from threadloom.functions import text as X
from threadloom.functions import tokens as T
from threadloom.functions import usage as U
from threadloom.sources import bodies as B


def value(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in cols.items())) if cols else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_truncate_closes_fences(spark):
    assert value(spark, X.truncate(F.col("t"), 5), t="```abcdef") == "```ab…\n```"
    assert value(spark, X.truncate(F.col("t"), 3), t="a🌲b") == "a🌲b"


def test_commit_messages(spark):
    assert value(spark, X.commit_message(F.col("c")), c='git commit -m "fix it" -a') == "fix it"
    assert value(spark, X.commit_message(F.col("c")), c="git commit -m 'one two'") == "one two"
    assert value(spark, X.commit_message(F.col("c")), c="git commit -m bare words") == "bare words"
    assert value(spark, X.commit_message(F.col("c")), c="git commit -F - <<E") == "commit (heredoc format)"
    assert value(spark, X.commit_message(F.col("c")), c="git commit") == ""


def test_run_keys(spark):
    assert value(spark, X.run_key(F.col("e")), e="- [3] Edit: a/b.go") == "edit:a/b.go"
    assert value(spark, X.run_key(F.col("e")), e="- [3] build") == "build"
    for e in ("- [3] U: hi", "- [3] git commit", "- [3] Bash: ls", "plain"):
        assert value(spark, X.run_key(F.col("e")), e=e) == ""


def test_result_summary_signatures(spark):
    text = "func Foo(\nType Bar\nclass A.B\n"
    got = value(spark, X.result_summary(F.lit("Read"), X.result_facts(F.col("t")), F.lit("")), t=text)
    assert got == "[context compressed: Read, 4 lines, key: func Foo; type Bar; class A.B]"


def test_eager_stub_functions(spark):
    got = value(spark, X.eager_stub(F.lit("Read"), F.create_map(F.lit("file_path"), F.lit("a.go")), F.col("t")), t="func (s *S) Run(x)\nfunc main()\n")
    assert got == "[Read a.go — 3 lines | Run(), main()]"


def test_reminders(spark):
    kept = "<system-reminder>SessionStart: noise</system-reminder>"
    assert value(spark, X.strip_reminders(F.col("t")), t=f" {kept} <system-reminder>noise</system-reminder>") == kept
    assert value(spark, X.strip_reminders(F.col("t")), t="<system-reminder>open") == "<system-reminder>open"


def test_png_and_media(spark):
    head = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 1920, 897)
    assert value(spark, T.image_tokens(F.col("d")), d=base64.b64encode(head).decode()) == 2277
    assert value(spark, T.image_tokens(F.col("d")), d="abc") == 32


def test_saturation(spark):
    assert value(spark, T.saturating_add(F.lit(T.MOST), F.lit(1))) == T.MOST
    assert value(spark, T.saturating_subtract(F.lit(-T.MOST - 1), F.lit(1))) == -T.MOST - 1


def test_usage(spark):
    fields = {"input_tokens": F.lit("10"), "cache_creation_input_tokens": F.lit("-3"), "cache_read_input_tokens": F.lit(None).cast("string")}
    assert value(spark, U.total_input(fields)) == 10
    assert value(spark, U.strict_total(F.lit("message"), fields)) is None
    assert value(spark, U.strict_total(F.lit("message"), fields | {"cache_creation_input_tokens": F.lit("4")})) == 14


def test_envelopes(spark):
    deep = "<session>" * 33 + "</session>" * 33
    for text, want in (("<session>x</session>", True), ("<session>x", False), ("<session><session>x</session></session>", True), (deep, False), ("a<session></session>", False)):
        assert value(spark, RQ.title_envelope(F.col("t")), t=text) is want


def test_content_round_trip(spark):
    raw = '[{"type":"text","text":"a"},{"type":"thinking","thinking":""},{"type":"tool_use","id":"1","name":"Read"}]'
    kind, blocks = B.parse_content(F.col("r"))
    assert value(spark, B.rebuild_content(kind, blocks), r=raw) == '[{"type":"text","text":"a"},{"type":"tool_use","id":"1","name":"Read","input":{}}]'
    assert value(spark, B.rebuild_content(kind, blocks), r='"say \\"x\\""') == '"say \\"x\\""'
    assert value(spark, kind, r="{bad") == "invalid"
    marked = '[{"type":"text","text":"a","cache_control":{"type":"ephemeral"},"note":"x\\"y","none":null}]'
    assert json.loads(value(spark, B.rebuild_content(kind, blocks), r=marked)) == json.loads(marked)


def test_unknown_fields_stay(spark):
    body = '{"model":"m","messages":[{"role":"user","content":[{"type":"text","text":"a","cache_control":{"type":"ephemeral"}}],"more":null}]}'
    df = spark.createDataFrame([("s", 1, body)], "session_id string, request_id bigint, body string")
    ok, rest = B.usable(df)
    assert rest.count() == 0
    row = B.message_rows(ok).first()
    assert row.content_kind == "array" and row.blocks[0].extra["cache_control"] == '{"type":"ephemeral"}'
    assert row.extra == {"more": "null"} and B.block_rows(B.message_rows(ok)).count() == 1
    said = spark.createDataFrame([("s", 1, '{"messages":[{"role":"user","content":"say \\"x\\""},{"role":"user"}]}')], "session_id string, request_id bigint, body string")
    rows = B.message_rows(said).orderBy("idx").collect()
    assert (rows[0].content_kind, rows[0].blocks[0].text) == ("string", 'say "x"') and rows[1].content_kind == "empty"


def test_config_defaults():
    assert EngineConfig(token_threshold=5, cache_ttl="x", deflation=0).checked() == EngineConfig()
    assert EngineConfig().collapse_floor == 50_000
