"""Queries of request bodies, title requests, media heads, stored state, and recall as a whole.

Bodies are JSON made of the conversations; DuckDB takes them apart by JSON functions of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import fingerprints as FP
from threadloom.functions import requests as RQ
from threadloom.functions import tokens as T
from threadloom.operators import continuity as C
from threadloom.operators import requests as Q
from threadloom.operators import storage as ST
from threadloom.plans.registry import query
from threadloom.plans.views import ARCHIVE, MSG, archives, list_sql, messages, table
from threadloom.sources import bodies as B
from threadloom.sources.store import Store, scratch


def requests_of(spark, sf, *parts):
    """(session_id, request_id, idx, role, text, body): a request for each message, its body put together from parts."""
    m = messages(spark, sf).select("session_id", F.col("idx").alias("request_id"), "role", "text")
    said = F.to_json(F.struct("role", F.col("text").alias("content")))
    return m.withColumn("said", said).withColumn("body", F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts)))


@query("a2_usable", f"""WITH {MSG}, b AS (SELECT session_id, idx AS request_id, CASE idx % 4 WHEN 0 THEN '{{"messages":[' || said || ']}}' WHEN 1 THEN '{{"messages":' || said || '}}' WHEN 2 THEN '[' || said || ']' ELSE '{{"messages":[' || said END AS body FROM (SELECT *, json_object('role', role, 'content', text)::VARCHAR AS said FROM msg))
SELECT session_id, request_id, CASE WHEN json_valid(body) THEN coalesce(json_type(body) = 'OBJECT' AND json_type(body, '$.messages') = 'ARRAY', false) ELSE false END AS usable FROM b""")
def usable(spark, sf):
    k = F.col("request_id") % 4
    body = F.when(k == 0, F.concat(F.lit('{"messages":['), "said", F.lit("]}"))).when(k == 1, F.concat(F.lit('{"messages":'), "said", F.lit("}"))).when(k == 2, F.concat(F.lit("["), "said", F.lit("]"))).otherwise(F.concat(F.lit('{"messages":['), "said"))
    good, rest = B.usable(requests_of(spark, sf, body))
    return good.select("session_id", "request_id", F.lit(True).alias("usable")).unionByName(rest.select("session_id", "request_id", F.lit(False).alias("usable")))


TWO = """b AS (SELECT session_id, idx AS request_id, '{"messages":[{"cache":{"k":' || idx || '},"content":' || CASE idx % 3 WHEN 0 THEN to_json(text)::VARCHAR WHEN 1 THEN '[{"type":"text","text":' || to_json(text) || ',"mark":{"type":"ephemeral"}},{"type":"tool_use","id":"t' || idx || '","name":"Read","input":{"file_path":"a/' || idx || '.py"}},{"type":"tool_result","tool_use_id":"t' || idx || '","is_error":true,"content":"no"}]' ELSE '[]' END || ',"role":"' || role || '"},{"role":"user","content":"more","note":1.5}]}' AS body FROM msg),
m AS (SELECT session_id, request_id, i AS idx, json_extract(body, '$.messages[' || i || ']') AS m FROM b, unnest(range(json_array_length(body, '$.messages')::BIGINT)) AS u(i))"""


def two_messages(spark, sf):
    k, n = F.col("request_id") % 3, F.col("request_id").cast("string")
    one = F.to_json(F.array("text"))
    blocks = F.concat(F.lit('[{"type":"text","text":'), F.substr(one, F.lit(2), F.length(one) - 2), F.lit(',"mark":{"type":"ephemeral"}},{"type":"tool_use","id":"t'), n, F.lit('","name":"Read","input":{"file_path":"a/'), n, F.lit('.py"}},{"type":"tool_result","tool_use_id":"t'), n, F.lit('","is_error":true,"content":"no"}]'))
    content = F.when(k == 0, F.substr(one, F.lit(2), F.length(one) - 2)).when(k == 1, blocks).otherwise(F.lit("[]"))
    return requests_of(spark, sf, '{"messages":[{"cache":{"k":', n, '},"content":', content, ',"role":"', F.col("role"), '"},{"role":"user","content":"more","note":1.5}]}')


@query("a3_message_rows", f"""WITH {MSG}, {TWO} SELECT session_id, request_id, idx, m->>'$.role' AS role, CASE json_type(m, '$.content') WHEN 'VARCHAR' THEN 'string' ELSE 'array' END AS kind,
CASE json_type(m, '$.content') WHEN 'VARCHAR' THEN 1 ELSE json_array_length(m, '$.content') END::INT AS n, coalesce(CASE json_type(m, '$.content') WHEN 'VARCHAR' THEN m->>'$.content' END, m->>'$.content[0].text') AS first, (m->'$.cache')::VARCHAR AS cache, (m->'$.note')::VARCHAR AS note FROM m""")
def message_rows(spark, sf):
    m = B.message_rows(two_messages(spark, sf))
    more = lambda k: F.try_element_at("extra", F.lit(k)).alias(k)
    return m.select("session_id", "request_id", "idx", "role", F.col("content_kind").alias("kind"), F.size("blocks").alias("n"), F.get("blocks", F.lit(0))["text"].alias("first"), more("cache"), more("note"))


@query("a4_block_rows", f"""WITH {MSG}, {TWO}, k AS (SELECT * EXCLUDE (m), CASE json_type(m, '$.content') WHEN 'VARCHAR' THEN '[' || json_object('type', 'text', 'text', m->>'$.content') || ']' ELSE (m->'$.content')::VARCHAR END::JSON AS c FROM m),
e AS (SELECT session_id, request_id, idx, p AS pos, json_extract(c, '$[' || p || ']') AS b FROM k, unnest(range(json_array_length(c)::BIGINT)) AS u(p))
SELECT session_id, request_id, idx, pos, b->>'$.type' AS type, b->>'$.text' AS text, b->>'$.name' AS name, b->>'$.input.file_path' AS file_path, b->>'$.tool_use_id' AS tool_use_id, (b->>'$.is_error')::BOOLEAN AS is_error, b->>'$.content' AS content, (b->'$.mark')::VARCHAR AS mark FROM e""")
def block_rows(spark, sf):
    b = B.block_rows(B.message_rows(two_messages(spark, sf)))
    return b.select("session_id", "request_id", "idx", "pos", "type", "text", "name", F.try_element_at("input", F.lit("file_path")).alias("file_path"), "tool_use_id", "is_error", "content", F.try_element_at("extra", F.lit("mark")).alias("mark"))


@query("a8_older_parts", f"""WITH {ARCHIVE}, f AS (SELECT *, row_number() OVER (PARTITION BY session_id, block_range_start, block_range_end, content_hash ORDER BY block_id) AS k FROM archive WHERE block_id % 2 = 1)
SELECT block_id, 'old ' || session_id AS session_id, 1::BIGINT AS history_epoch, 0 AS isolated, NULL AS content_hash FROM archive WHERE block_id % 2 = 0 UNION ALL SELECT block_id, session_id, history_epoch, isolated, content_hash FROM f WHERE k = 1""")
def older_parts(spark, sf):
    """A store whose first part was written before three columns were there."""
    a = archives(spark, sf)
    store = Store(spark, scratch(spark))
    old = a.filter("block_id % 2 = 0").withColumn("session_id", F.concat(F.lit("old "), F.col("session_id"))).drop("history_epoch", "isolated", "content_hash")
    store._commit(lambda now: {"blocks": ([], old)})
    store.save_blocks(a.filter("block_id % 2 = 1"))
    return store.blocks().select("block_id", "session_id", "history_epoch", "isolated", "content_hash")


@query("a10_state", "SELECT key, value FROM (SELECT event_type || user_id % 10 AS key, CASE WHEN event_id % 7 <> 0 THEN props END AS value, row_number() OVER (PARTITION BY event_type || user_id % 10 ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND value IS NOT NULL")
def state(spark, sf):
    e = table(spark, sf, "events").select(F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("key"), F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("value"), F.struct("ts", "event_id").alias("at"))
    return ST.current_state(e)


@query("a19_passed_through", "SELECT event_id, 100 + event_id * 37 % 500 AS status FROM events WHERE 100 + event_id * 37 % 500 NOT BETWEEN 200 AND 299")
def passed_through(spark, sf):
    return Q.passed_through(table(spark, sf, "events").select("event_id", (100 + F.col("event_id") * 37 % 500).alias("status")))


@query("b2_block_texts", """WITH r AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN to_json(text)::VARCHAR WHEN 1 THEN '[{"type":"text","text":' || to_json(text) || '},{"type":"text","text":"end"}]' WHEN 2 THEN '[{"type":"text","text":' || to_json(text) || '},{"type":"image"}]' ELSE '[]' END::JSON AS raw FROM documents)
SELECT doc_id, CASE WHEN json_type(raw) = 'VARCHAR' THEN raw->>'$' WHEN json_array_length(raw) > 0 AND len(list_filter(json_extract_string(raw, '$[*].type'), lambda t: t <> 'text')) = 0 THEN array_to_string(json_extract_string(raw, '$[*].text'), chr(10)) END AS said FROM r""")
def block_texts(spark, sf):
    k, one = F.col("doc_id") % 4, F.to_json(F.array("text"))
    text = F.substr(one, F.lit(2), F.length(one) - 2)
    raw = F.when(k == 0, text).when(k == 1, F.concat(F.lit('[{"type":"text","text":'), text, F.lit('},{"type":"text","text":"end"}]'))).when(k == 2, F.concat(F.lit('[{"type":"text","text":'), text, F.lit('},{"type":"image"}]'))).otherwise(F.lit("[]"))
    return table(spark, sf, "documents").select("doc_id", RQ.block_texts(raw).alias("said"))


@query("b3_envelopes", "SELECT doc_id, n_chars % 36 = (doc_id // 36) % 36 AND n_chars % 36 BETWEEN 1 AND 32 AS whole FROM documents WHERE text IS NOT NULL")
def envelopes(spark, sf):
    """Texts in some opening and some closing tags, up to 35 of each, as many as lengths and ids say."""
    t = F.concat(F.repeat(F.lit("<session>"), (F.col("n_chars") % 36).cast("int")), "text", F.repeat(F.lit("</session>"), (F.floor(F.col("doc_id") / 36) % 36).cast("int")))
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", RQ.title_envelope(t).alias("whole"))


LETTERS = r"[\p{L}\p{M} \-]"


@query("b4_languages", rf"""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents), i AS (SELECT doc_id, trim(w || CASE WHEN doc_id % 3 = 0 THEN ' (x-y)' ELSE '' END, ' ') AS i FROM w)
SELECT doc_id, count(*) FILTER (length(i) <= 64 AND (regexp_full_match(i, '{LETTERS}+(\({LETTERS}*\){LETTERS}*)?') OR regexp_full_match(i, '\({LETTERS}*\){LETTERS}*')) AND len(list_intersect(regexp_split_to_array(lower(i), '[ \-()]+'), {list_sql(RQ.BLOCKED_WORDS)})) = 0) AS n FROM i GROUP BY 1""")
def languages(spark, sf):
    """How many of a text's words would do as the name of a language."""
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("w"))
    asked = F.concat(F.lit(RQ.LANGUAGE_PREFIX), "w", F.when(F.col("doc_id") % 3 == 0, " (x-y)").otherwise(""), F.lit(RQ.LANGUAGE_SUFFIX))
    return w.groupBy("doc_id").agg(F.count_if(RQ.is_language_request(asked)).alias("n"))


PIECES = ("Coding Session", "generate", "title", "3-7 words", 'single "title" field', "SESSION TITLE", "sentence case")


@query("b5_title_system", "SELECT doc_id, (contains(t, 'coding session') OR contains(t, 'session title')) AND contains(t, 'generate') AND contains(t, 'title') AND (contains(t, '3-7 words') OR contains(t, 'sentence-case') OR contains(t, 'sentence case')) AND (contains(t, 'single \"title\" field') OR contains(t, 'single title field')) AS titles FROM (SELECT doc_id, lower(text" + "".join(f" || CASE WHEN doc_id >> {k} & 1 = 1 THEN ' {p}' ELSE '' END" for k, p in enumerate(PIECES)) + ") AS t FROM documents) WHERE t IS NOT NULL")
def title_system(spark, sf):
    n = F.col("doc_id")
    t = F.concat("text", *(F.when(F.shiftright(n, k).bitwiseAND(1) == 1, f" {p}").otherwise("") for k, p in enumerate(PIECES)))
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", RQ.is_title_system(t).alias("titles"))


#: Ways in which an output configuration can miss the closed form: (what stands there, what stands there instead).
MISSES = (('"title":{"type":"string"}', '"title":{"type":"string"},"more":{"type":"string"}'), ('"required":["title"]', '"required":["title","more"]'), ('"additionalProperties":false', '"additionalProperties":true'), ('"type":"json_schema"', '"type":"json"'), ('{"format"', '{"effort":"low","format"'), ('{"format"', '{"other":1,"format"'), ("}}", "}"))
CONFIG = '{"format":{"type":"json_schema","schema":{"type":"object","properties":{"title":{"type":"string"}},"required":["title"],"additionalProperties":false}}}'


@query("b6_output_config", f"""WITH c AS (SELECT event_id, CASE WHEN event_id % 9 = 8 THEN NULL ELSE replace(x, '<', '') END AS raw FROM (SELECT event_id, {"CASE event_id % 9 " + " ".join(f"WHEN {k} THEN replace('{CONFIG}', '{a}', '{b}')" for k, (a, b) in enumerate(MISSES)) + f" ELSE '{CONFIG}' END"} AS x FROM events)), s AS (SELECT *, raw->'$.format.schema' AS s, list_sort(json_keys(raw)) AS top FROM (SELECT event_id, raw IS NULL AS none, CASE WHEN json_valid(raw) THEN raw::JSON END AS raw FROM c))
SELECT event_id, CASE WHEN none THEN 'missing' WHEN coalesce(top IN (['format'], ['effort', 'format']) AND list_sort(json_keys(raw, '$.format')) = ['schema', 'type'] AND raw->>'$.format.type' = 'json_schema' AND s->>'$.type' = 'object' AND json_keys(s, '$.properties') = ['title'] AND json_keys(s, '$.properties.title') = ['type'] AND s->>'$.properties.title.type' = 'string' AND (s->'$.required')::VARCHAR = '["title"]' AND (s->'$.additionalProperties')::VARCHAR = 'false', false) THEN 'title_only' ELSE 'invalid' END AS kind FROM s""")
def output_config(spark, sf):
    k, raw = F.col("event_id") % 9, F.lit(CONFIG)
    for i, (a, b) in enumerate(MISSES):
        raw = F.when(k == i, F.lit(CONFIG.replace(a, b))).otherwise(raw)
    return table(spark, sf, "events").select("event_id", RQ.output_config(F.when(k != 8, raw)).alias("kind"))


@query("d7_gif_header", "SELECT event_id AS id, w AS width, h AS height, CASE WHEN w > 0 AND h > 0 AND ((w + 27) // 28) * ((h + 27) // 28) <= 8192 THEN ((w + 27) // 28) * ((h + 27) // 28) ELSE 32 END AS tok FROM (SELECT event_id, event_id * 7 % 5000 AS w, event_id * 13 % 4000 AS h FROM events)")
def gif_header(spark, sf):
    n = F.col("event_id")
    little = lambda c: F.concat(F.unhex(F.lpad(F.hex(c % 256), 2, "0")), F.unhex(F.lpad(F.hex(F.floor(c / 256)), 2, "0")))
    made = table(spark, sf, "events").select(n.alias("id"), (n * 7 % 5000).alias("w"), (n * 13 % 4000).alias("h"))
    made = made.withColumn("data", F.base64(F.concat(F.lit("GIF89a").cast("binary"), little(F.col("w")), little(F.col("h")))))
    size = T.gif_size(F.col("data"))
    return made.select("id", size["width"].alias("width"), size["height"].alias("height"), T.image_tokens(F.col("data")).alias("tok"))


@query("d9_media_blocks", "SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 32 ELSE least(greatest((4 * ((strlen(html) + 2) // 3)) * 3 // 32, 32), 8192) END::BIGINT AS tok FROM pages WHERE html IS NOT NULL")
def media_blocks(spark, sf):
    """Sources that are base64 data of no known kind, and those that aren't data: 32 for these."""
    p = table(spark, sf, "pages").filter("html is not null").select(F.col("page_id").alias("id"), F.regexp_replace(F.base64(F.col("html").cast("binary")), "[\r\n]", "").alias("data"))
    return p.select("id", T.source_tokens(F.when(F.col("id") % 3 == 0, "url").otherwise("base64"), F.col("data")).alias("tok"))


KINDS = ("text", "thinking", "tool_result", "tool_use")


@query("l4_boundary", f"""WITH {MSG}, b AS (SELECT session_id, idx, {list_sql(KINDS)}[idx % 4 + 1] AS type, idx % 3 = 0 AS none, text FROM msg)
SELECT session_id, idx, 'future,' || CASE WHEN type = 'tool_use' OR NOT none THEN 'input,' ELSE '' END || 'text,type' AS keys, text, type FROM b""")
def boundary(spark, sf):
    """Blocks of every type with an input, null or not: only a null one of a block that has no use for it goes."""
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (F.col("idx") % 4 + 1).cast("int"))
    one = F.to_json(F.array("text"))
    raw = F.concat(F.lit('[{"type":"'), kind, F.lit('","input":'), F.when(F.col("idx") % 3 == 0, "null").otherwise('{"a":1}'), F.lit(',"future":null,"text":'), F.substr(one, F.lit(2), F.length(one) - 2), F.lit("}]"))
    c = messages(spark, sf).select("session_id", "idx", FP.boundary_content(raw).alias("c"))
    return c.select("session_id", "idx", F.array_join(F.array_sort(F.json_object_keys(F.get_json_object("c", "$[0]"))), ",").alias("keys"), F.get_json_object("c", "$[0].text").alias("text"), F.get_json_object("c", "$[0].type").alias("type"))


@query("k13_migrated", """WITH l AS (SELECT user_id AS session_id, 1::BIGINT AS epoch, max(event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT user_id AS session_id, event_id % 3 AS epoch, max(event_id) AS value FROM events WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY 1, 2)
SELECT * FROM c UNION ALL SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = l.session_id AND c.epoch = 1)""")
def migrated(spark, sf):
    e = table(spark, sf, "events").withColumn("session_id", F.col("user_id"))
    old = e.filter("event_type = 'view'").groupBy("session_id").agg(F.max("event_id").alias("value"))
    now = e.filter("event_type = 'click' and user_id % 2 = 0").groupBy("session_id", (F.col("event_id") % 3).alias("epoch")).agg(F.max("event_id").alias("value"))
    return C.migrated(old, now)
