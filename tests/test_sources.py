"""The store, media heads, byte-pair counts and the whole way of a history."""

import base64
import json
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadloom.config import EngineConfig
from threadloom.functions import text as X
from threadloom.functions import tokens as T
from threadloom.operators import rewrite as R
from threadloom.plans import forwarding as W
from threadloom.plans import views
from threadloom.sources import events as E
from threadloom.sources.store import Store, scratch


def test_store(spark, sf):
    store = Store(spark, scratch(spark))
    assert store.blocks() is None and store.state().count() == 0
    a = views.archives(spark, sf)
    store.save_blocks(a.filter("block_id < 50"))
    n = store.blocks().count()
    store.save_blocks(a.filter("block_id < 50"))
    assert store.blocks().count() == n > 0
    store.put_state([("a", "1"), ("b", "2")])
    store.put_state([("a", "3")])
    store.delete_state("b")
    assert [(r.key, r.value) for r in store.state().collect()] == [("a", "3")]
    store.commit_transition("a", "4", "src3", 0)
    assert store.blocks().filter("session_id = 'src3' and isolated = 0").count() == 0 and store.state().first().value == "4"
    store.vacuum()
    assert store.blocks().count() == n
    with pytest.raises(ValueError):
        store.commit_transition("", "x", "s", 0)


def test_store_old_schema(spark):
    path = scratch(spark)
    store = Store(spark, path)
    old = spark.createDataFrame([(1, "s", 0, 9)], "block_id bigint, session_id string, block_range_start bigint, block_range_end bigint")
    store._commit(lambda now: {"blocks": ([], old)})
    row = store.blocks().first()
    assert (row.history_epoch, row.isolated, row.content_hash) == (1, 0, None)


def test_store_two_writers(spark, sf):
    """A writer whose number is taken starts again, so that neither change is lost."""
    path = scratch(spark)
    one, two = Store(spark, path), Store(spark, path)
    a = views.archives(spark, sf)
    one.save_blocks(a.filter("block_id < 10"))
    real, turns = one._current, []

    def late():
        found = real()
        if not turns:
            turns.append(1)
            two.save_blocks(a.filter("block_id between 10 and 19"))
        return found

    one._current = late
    one.save_blocks(a.filter("block_id between 15 and 29"))
    one._current = real
    ids = [r.block_id for r in two.blocks().select("block_id").collect()]
    assert len(set(ids)) == len(ids) == Store(spark, path).blocks().count() and max(ids) > 19
    assert {10, 11} & set(ids) and len(one._current()[1]["blocks"]) == 3
    one.compact()
    assert len(one._current()[1]["blocks"]) == 1 and one.blocks().count() == len(ids)


def encoded(raw):
    return base64.b64encode(raw).decode()


def test_media_heads(spark):
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"x" * 14 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 600, 800) + b"y" * 10
    vp8x = b"RIFF" + b"\0" * 4 + b"WEBPVP8X" + b"\0" * 8 + (799).to_bytes(3, "little") + (599).to_bytes(3, "little")
    vp8l = b"RIFF" + b"\0" * 4 + b"WEBPVP8L" + b"\0" * 4 + b"\x2f" + struct.pack("<I", 799 | 599 << 14) + b"\0" * 8
    vp8 = b"RIFF" + b"\0" * 4 + b"WEBPVP8 " + b"\0" * 7 + b"\x9d\x01\x2a" + struct.pack("<HH", 800, 600)
    gif = b"GIF89a" + struct.pack("<HH", 800, 600) + b"\0" * 4
    rows = [("image/jpeg", encoded(jpeg)), ("image/webp", encoded(vp8x)), ("image/webp", encoded(vp8l)), ("image/webp", encoded(vp8)), ("image/gif", encoded(gif)), ("image/jpeg", "////"), ("image/png", None)]
    df = spark.createDataFrame(rows, "m string, d string")
    got = [r[0] for r in df.select(T.image_tokens(F.col("d"), F.col("m"))).collect()]
    tiles = -(-800 // 28) * -(-600 // 28)
    assert got[:6] == [tiles] * 5 + [32]
    assert T.frame_size("!!!") is None and T.frame_size(encoded(jpeg)) == {"width": 800, "height": 600}


def test_bpe_tokens(spark):
    path = Path("/opt/tokenizers/byte_bpe_50k.tiktoken")
    if not path.exists():
        pytest.skip("no vocabulary here")
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    df = spark.createDataFrame([("hello world",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.bpe_tokens(F.col("t"), str(path), pattern)).collect()] == [2, 0, 0]


def test_forwarded(spark):
    context = "<system-reminder>\n# currentDate\nToday\n</system-reminder>"
    rows = [(1, 0, "user", f"{context} begin"), (1, 1, "assistant", "a" * 400), (1, 2, "user", "<system-reminder>noise</system-reminder> go on. Done."), (1, 3, "assistant", "b" * 4000), (1, 4, "user", "<system-reminder>noise</system-reminder> last")]
    m = spark.createDataFrame(rows, "session_id bigint, idx bigint, role string, text string")
    out = {r.idx: r for r in W.forwarded(m, EngineConfig(keep_recent=1), floor=500).collect()}
    assert out[0].text == context and out[1].text.startswith("[Earlier conversation archived — 2 messages")
    assert out[2].text.startswith("Archived messages 0–2") and "Done." in out[2].text
    assert out[3].text == "b" * 4000 and "noise" in out[4].text and len(out) == 5


def test_stub_pairs(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", "x" * 2000, 500, k % 2 == 1, k % 2 == 0 and k > 0, False) for k in range(8)]
    m = spark.createDataFrame(rows, "session_id bigint, idx bigint, role string, text string, tok bigint, has_use boolean, has_result boolean, active boolean")
    got = {r.idx: r.action for r in R.stubbed_rows(m, 2).collect()}
    assert got == {0: "keep", 1: "stub", 2: "stub", 3: "stub", 4: "stub", 5: "stub", 6: "stub", 7: "keep"}


def test_scaling_keeps_the_event(spark):
    start = '{"type":"message_start","message":{"id":"msg_1","content":[{"type":"text","text":"input_tokens"}],"usage":{"input_tokens":7,"cache_read_input_tokens":0,"cache_creation_input_tokens":"5","cache_creation":{"x":1.5},"output_tokens":2,"total_tokens":9,"service_tier":"standard"}}}'
    delta = '{"type":"message_delta","delta":{"stop_reason":"end_turn"},"usage":{"input_tokens":5,"output_tokens":7,"total_tokens":12}}'
    bare = ['{"type":"message_start","message":{"usage":null}}', '{"type":"message_start", bad', '{"type": "ping"}']
    text = "".join(f"event: x\ndata: {d}\n\n" for d in (start, delta, *bare))
    for factor, total, inputs in ((0.5, 5, 3), (1.0, 9, 7)):
        got = [r.data for r in E.scaled_events(E.event_rows(spark.createDataFrame([(1, text)], "stream_id bigint, text string")), factor).orderBy("seq").collect()]
        want = json.loads(start)
        want["message"]["usage"] |= {"input_tokens": inputs, "total_tokens": total}
        assert json.loads(got[0]) == want
        assert json.loads(got[1]) == {"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 7, "total_tokens": 7 if factor < 1 else 12}}
        assert got[2:] == bare


def test_summary_sections_keep_the_end(spark):
    s = "head\n### Files\n" + "f" * 500 + "\n### Gotchas\nbad\n### Conclusion\nend\n"
    got = spark.createDataFrame([(s,)], "s string").select(X.shorten_summary(F.col("s"), 200)).first()[0]
    assert got == "head\n[...omitted: Files...]\n\n### Gotchas\nbad\n### Conclusion\nend\n"
