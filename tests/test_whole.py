"""Queries over whole texts, by brute force on small tables."""

import json
import re
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.plans import catalog

QUERIES = catalog.queries()


def run(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]


def paths(text):
    tokens = [w.strip('.,;:!?()[]{}<>"') for w in re.split("[ \n\t,;\"']", text)]
    return {w for w in tokens if len(w.encode()) >= 3 and (re.match(r".:[\\/]", w) or w.startswith("/") or ("/" in w and "." in w))}


def test_paths_past_the_head(spark, tmp_path):
    pages = [(1, "http://a.b/c", "<p>" + "word " * 200 + '<a href="/late/one">x</a> see src/late.go; C:\\\\d'), (2, "http://a.b/d", "/x"), (3, "u", "y" * 400 + " (lib/end.py)")]
    got = run(spark, tmp_path, "c29_paths", "pages", pages, "page_id bigint, url string, html string")
    want = {(k, w) for k, url, html in pages for w in paths(f"see {url}, src/a.py and /tmp/x; {html}")}
    assert len(got) == len(want) and set(got) == want
    assert {(1, "/late/one"), (1, "src/late.go"), (3, "lib/end.py")} <= want


NOISE, CONTEXT = "<system-reminder>noise</system-reminder>", "<system-reminder>\n# claudeMd\nrules</system-reminder>"
TAGGED = [
    "plain", "", "a < b", "x" * 90 + f" {NOISE} y", "x" * 90 + "\n[skill-hint]use\nit[/skill-hint] y", f"{CONTEXT}{NOISE}" + "z" * 60 + CONTEXT,
    f"<system-reminder>open {NOISE} mid {NOISE} end", f"<system-reminder>\n# userEmail\n{CONTEXT} mid {CONTEXT} {NOISE}", NOISE + "w" * 70 + "<system-reminder>never closed",
    "q" * 60 + "<system-reminder>SessionStart: this is ambient context</system-reminder>", f" {NOISE}{NOISE} ", "[skill-hint]open" + "k" * 80,
]
LEADS = (" a <system-reminder> noise </system-reminder> b ", "<system-reminder>SessionStart: This is just a gentle reminder</system-reminder>", "<system-reminder>\n# claudeMd\nrules</system-reminder> tail", "x\n[skill-hint]use it[/skill-hint] y", "<system-reminder>This is ambient context</system-reminder>z", "<system-reminder>unknown</system-reminder>")


def persistent(body):
    return any(x.strip() in ("# claudeMd", "# currentDate", "# userEmail", "# attachedProject") for x in body.split("\n"))


def parted(text, goes):
    """text without the reminders whose body goes() names, and how many those are."""
    out, at, n = "", 0, 0
    while (a := text.find("<system-reminder>", at)) >= 0 and (b := text.find("</system-reminder>", a)) >= 0:
        gone = goes(text[a + 17 : b].strip())
        out, n, at = out + (text[at:a] if gone else text[at : b + 18]), n + gone, b + 18
    return out + text[at:], n


def cleaned(text):
    said = ("task tools haven't been used recently", "this is just a gentle reminder", "this is ambient context", "this may or may not be related")
    out, _ = parted(text, lambda b: (b.lower() == "noise" or any(k in b.lower() for k in said)) and "SessionStart:" not in b and not persistent(b))
    out = re.sub(r"(?s)\n?\[skill-hint\].*?\[/skill-hint\]", "", out)
    return text if out == text else out.strip(" \t\n\r")


def test_reminders_anywhere(spark, tmp_path):
    rows = [(k * 6 + lead, text) for k, text in enumerate(TAGGED) for lead in range(6)]
    whole = {k: LEADS[k % 6] + text + LEADS[k % 6] for k, text in rows}
    got = run(spark, tmp_path, "c31_strip_reminders", "documents", rows, "doc_id bigint, text string")
    assert len(got) == len(rows) and dict(got) == {k: cleaned(t) for k, t in whole.items()}
    got = [tuple(r) for r in QUERIES["c32_detach_context"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((k, *parted(t, persistent)) for k, t in whole.items())


def test_reminders_go_at_their_own_place(spark):
    open_ = f"<system-reminder>open {NOISE}"
    row = spark.createDataFrame([(f"{open_} mid {NOISE}",)], "t string").select(X.strip_reminders(F.col("t"))).first()
    assert row[0] == f"{open_} mid"


HARD = ["", "plain", 'say "x"' + "q" * 50, "back\\slash \\n \\u0041", "two\nlines\r\n\tand" + " more" * 40, "it's 'so'", '[{"type":"text"}]', "é\u2028🌲\x01\x1b", "  blank  ", "deep_search('in it') and deep_search('') 'x'"]


def test_result_text_of_any_text(spark, tmp_path):
    rows = [(2 * k + odd, t) for k, t in enumerate(HARD) for odd in (0, 1)]
    got = run(spark, tmp_path, "c20_result_text", "documents", rows, "doc_id bigint, text string")
    assert len(got) == len(rows) and dict(got) == {k: t if k % 2 == 0 else "\n".join(x for x in (t, "two") if x) for k, t in rows}
    got = [tuple(r) for r in QUERIES["c28_hints"](spark, str(tmp_path)).collect()]
    marks = {k: re.findall(r"(?s)deep_search\('(.*?)'\)", f"{t} deep_search('{t}') and deep_search('  Read src/k{k % 9}.py ')") for k, t in rows}
    assert sorted(got) == sorted((k, h.strip(" \t\n\r")) for k, found in marks.items() for h in found if h.strip(" \t\n\r"))


def test_every_stream_is_scaled(spark, tmp_path):
    n = list(range(24))
    got = run(spark, tmp_path, "n4_sse", "events", [(k,) for k in n], "event_id bigint")
    compact = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    use = lambda k: {"input_tokens": k // 2, "cache_read_input_tokens": 4, "output_tokens": 1, "total_tokens": k // 2 + 5}
    start = lambda k: ("message_start", compact({"type": "message_start", "message": {"id": f"msg_{k}", "type": "message", "role": "assistant", "model": "m", "content": [], "usage": use(k)}}))
    spent = ("message_delta", compact({"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 7, "total_tokens": 7}}))
    stop, delta, ping = ("message_stop", '{"type":"message_stop"}'), ("content_block_delta", '{"type":"content_block_delta"}'), ("message_stop", '{"type":"ping"}')
    kinds = lambda k: ([start(k), delta, stop], [stop, start(k)], [start(k), start(k), stop], [start(k), spent], [start(k), ping, stop], [delta])[k % 6]
    assert sorted(got) == sorted((k, i, *e) for k in n for i, e in enumerate(kinds(k)))


def test_files_of_every_run(spark, tmp_path):
    events = [(k, datetime(2024, 1, 1) + timedelta(minutes=k), 7, ("view", "click", "purchase", "error", "signup")[k % 5], 1.0, f'{{"k": {k % 4}}}') for k in range(100)]
    spark.createDataFrame([(k, "a text") for k in range(5)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = run(spark, tmp_path, "f9_compaction_stats", "events", events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    want = Counter((7, a, b, f"k{k % 4}" + ("" if kind == "click" else ".py")) for k, _, _, kind, *_ in events for a, b in ((1, 66), (68, 133), (135, 195)) if a <= 2 * k <= b and kind != "error")
    assert sorted(got) == sorted((*k, n) for k, n in want.items())
