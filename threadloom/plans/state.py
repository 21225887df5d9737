"""Queries of continuity, pressure, usage, fingerprints and classification."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.config import EngineConfig
from threadloom.functions import fingerprints as FP
from threadloom.functions import requests as RQ
from threadloom.functions import tokens as T
from threadloom.functions import usage as U
from threadloom.operators import continuity as C
from threadloom.operators.requests import tracked as keep
from threadloom.plans.forwarding import forwarded
from threadloom.plans.registry import query
from threadloom.plans.views import MSG, REQ, USAGE, list_sql, messages, requests, table, usage
from threadloom.sources.bodies import parse_content, probes
from threadloom.sources.events import event_rows, lifecycles, scaled_answers, scaled_events

HASHES = f"WITH {MSG}, {REQ}, hs AS (SELECT session_id, seq, list(sha256(role || chr(31) || text) ORDER BY idx) AS h FROM req GROUP BY 1, 2)"
EPOCHS = f"""{HASHES}, lg AS (SELECT *, lag(h) OVER (PARTITION BY session_id ORDER BY seq) AS p FROM hs),
cp AS (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE coalesce(list_position(list_transform(range(1, least(len(h), len(p)) + 1), lambda i: h[i] = p[i]), false) - 1, least(len(h), len(p))) END AS c FROM lg),
rs AS (SELECT *, CASE WHEN p IS NULL THEN 'initial' WHEN c = len(p) AND len(h) = len(p) THEN 'unchanged' WHEN c = len(p) THEN 'appended' WHEN c = len(h) AND len(h) < len(p) THEN 'history_shrunk' ELSE 'history_changed' END AS reason FROM cp),
ep AS (SELECT session_id, seq, sum(CASE WHEN reason IN ('initial', 'history_shrunk', 'history_changed') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq)::BIGINT AS epoch, c AS common_prefix, reason FROM rs)"""


def epochs(spark, sf):
    return C.epochs(C.histories(requests(spark, sf)))


@query("k1_epochs", f"{EPOCHS} SELECT * FROM ep")
def k1(spark, sf):
    return epochs(spark, sf)


@query("g6_common_prefix", f"{EPOCHS} SELECT session_id, seq, common_prefix FROM ep WHERE seq > 1")
def g6(spark, sf):
    return epochs(spark, sf).filter("seq > 1").select("session_id", "seq", "common_prefix")


@query("k2_warned_once", f"WITH {MSG}, {REQ} SELECT session_id, seq, digest FROM (SELECT session_id, seq, sha256(text) AS digest, row_number() OVER (PARTITION BY session_id, sha256(text) ORDER BY seq) AS k FROM req WHERE idx = 0) WHERE k = 1")
def k2(spark, sf):
    return C.warned_once(requests(spark, sf).filter("idx = 0").select("session_id", "seq", F.sha2("text", 256).alias("digest")))


@query("k3_stale", f"{EPOCHS} SELECT session_id, seq, epoch FROM ep JOIN (SELECT session_id, max(epoch) AS m FROM ep GROUP BY 1) USING (session_id) WHERE epoch = m")
def k3(spark, sf):
    e = epochs(spark, sf).select("session_id", "seq", "epoch")
    return C.current_only(e, e).select("session_id", "seq", "epoch")


@query("k5_baseline", f"WITH {USAGE} SELECT session_id, event_id % 2 AS epoch, max(event_id) AS generation, max_by(output_tokens, event_id) AS actual FROM usage GROUP BY 1, 2")
def k5(spark, sf):
    u = usage(spark, sf).select("session_id", (F.col("event_id") % 2).alias("epoch"), F.col("event_id").alias("generation"), F.col("output_tokens").alias("actual"))
    return C.baselines(u)


def pressure_inputs(spark, sf):
    """Each row of a conversation as a request whose baseline is one message older: kinds of it by session."""
    m = messages(spark, sf)
    up = W.partitionBy("session_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    s, kind = F.col("session_id"), F.col("session_id") % 5
    fp = lambda x: F.sha2(F.lit(x), 256)
    return m.select(
        "session_id", "idx", (F.col("idx") + 1).alias("n"), F.sum("tok").over(up).alias("messages_tok"), F.lit(10).alias("system_tok"), F.lit(20).alias("tools_tok"), fp("s").alias("system_fp"), fp("t").alias("tools_fp"), fp("p").alias("prefix_fp"),
        F.col("tok").alias("delta_tok"), F.when(kind != 4, 300 + s * 7 % 900).alias("base_actual"), F.col("idx").alias("base_n"), F.when(kind == 1, fp("s2")).otherwise(fp("s")).alias("base_system_fp"), fp("t").alias("base_tools_fp"), F.when(kind == 2, fp("p2")).otherwise(fp("p")).alias("base_prefix_fp"), (kind == 3).alias("base_conservative"),
    )


@query("k6_pressure", f"""WITH {MSG}, b AS (SELECT session_id, idx, tok, sum(tok) OVER (PARTITION BY session_id ORDER BY idx)::BIGINT + 30 AS f, session_id % 5 AS kind, 300 + session_id * 7 % 900 AS act FROM msg)
SELECT session_id, idx, CASE kind WHEN 0 THEN 'none' WHEN 1 THEN 'system_changed' WHEN 2 THEN 'messages_changed' WHEN 3 THEN 'legacy_unverified' ELSE 'no_actual' END AS reset,
CASE WHEN kind = 0 THEN 'actual_plus_delta' WHEN kind = 2 AND act > 500 AND act > f THEN 'conservative_high_water' ELSE 'local_full' END AS source, (CASE WHEN kind = 0 THEN act + tok WHEN kind = 2 AND act > 500 AND act > f THEN act ELSE f END)::BIGINT AS selected FROM b""")
def k6(spark, sf):
    return C.pressure(pressure_inputs(spark, sf), 500).select("session_id", "idx", "reset", "source", "selected")


@query("k7_trigger", "SELECT event_id AS request_id, CASE WHEN s > 20000 THEN 'emergency' WHEN s > 10000 THEN 'tokens' WHEN s > 5000 AND coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 240000000, false) THEN 'pause' ELSE 'none' END AS trigger FROM (SELECT *, (event_id * 7919) % 30000 AS s FROM events)")
def k7(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("session_id"), "ts", ((F.col("event_id") * 7919) % 30000).alias("selected"))
    return C.triggers(e, 10_000, 240).select("request_id", "trigger")


@query("k8_frozen_replay", f"{HASHES}, sn AS (SELECT session_id, seq AS taken, len(h) AS cut, h FROM hs WHERE seq = 1) SELECT hs.session_id, hs.seq, cut <= len(hs.h) AND array_to_string(hs.h[1:cut], ',') = array_to_string(sn.h, ',') AS usable FROM hs JOIN sn USING (session_id) WHERE hs.seq > taken")
def k8(spark, sf):
    h = C.histories(requests(spark, sf))
    snap = h.filter("seq = 1").select("session_id", "seq", F.size("hashes").alias("cutoff"), C.prefix_hash(F.col("hashes"), F.size("hashes")).alias("prefix_hash"))
    return C.frozen_replay(snap, h)


@query("k10_evict", "SELECT user_id AS session_id, max(ts) AS last_access FROM events GROUP BY 1 HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 5 HOUR")
def k10(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts")).scalar()
    snap = e.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_access"))
    return C.evicted(snap, now, 5 * 3600)


@query("k12_decay_state", "SELECT user_id AS session_id, event_id % 2 AS epoch, event_id % 20 AS idx, min(event_id) AS stubbed_at, min_by(value, event_id) AS intensity, min_by(props, event_id) AS file_path FROM events GROUP BY ALL")
def k12(spark, sf):
    n = F.col("event_id")
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), (n % 2).alias("epoch"), (n % 20).alias("idx"), n.alias("seq"), F.col("value").alias("intensity"), F.col("props").alias("file_path"))
    return C.decay_state(e)


@query("l1_fingerprint", "SELECT event_id, sha256(CASE event_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'null' ELSE '{\"a\":[1,2],\"k\":' || json_extract_string(props, '$.k') || '}' END) AS fp FROM events")
def l1(spark, sf):
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 4 == 1, "null").when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"k": '), k, F.lit(', "a": [1, 2]}'))).when(F.col("event_id") % 4 == 3, F.concat(F.lit('{ "a":[ 1,2 ],"k":'), k, F.lit("}")))
    return table(spark, sf, "events").select("event_id", FP.fingerprint(raw).alias("fp"))


@query("l2_history_message", f"WITH {MSG} SELECT session_id, idx, sha256(role || chr(31) || to_json({{'text': replace(text, chr(10), ' ')}})) AS h FROM msg")
def l2(spark, sf):
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    none = F.lit(None).cast("string")
    block = F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("thinking"), none.alias("signature"), none.alias("id"), none.alias("name"), F.lit(None).cast("map<string,string>").alias("input"), none.alias("tool_use_id"), none.alias("content"), F.lit(None).cast("boolean").alias("is_error"))
    return messages(spark, sf).select("session_id", "idx", FP.history_message(F.col("role"), F.lit("array"), F.array(block), F.lit(True)).alias("h"))


@query("l3_prefix_hash", f"{HASHES} SELECT session_id, seq, sha256(array_to_string(h[1:2], ',')) AS fp FROM hs")
def l3(spark, sf):
    return C.histories(requests(spark, sf)).select("session_id", "seq", C.prefix_hash(F.col("hashes"), F.lit(2)).alias("fp"))


@query("l5_session_hash", "SELECT DISTINCT user_id AS session_id, substr(sha256(user_id::VARCHAR), 1, 16) AS hash FROM events")
def l5(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("session_id")).distinct().select("session_id", FP.session_hash(F.col("session_id")).alias("hash"))


@query("l6_validity", "SELECT doc_id, regexp_full_match(c, '[0-9a-f]{64}') AS long, regexp_full_match(c, '[0-9a-f]{16}') AS short FROM (SELECT doc_id, CASE lang WHEN 'en' THEN h WHEN 'de' THEN h[1:16] WHEN 'fr' THEN upper(h) ELSE 'G' || h[2:] END AS c FROM (SELECT doc_id, lang, sha256(text) AS h FROM documents))")
def l6(spark, sf):
    h = F.sha2("text", 256)
    c = F.when(F.col("lang") == "en", h).when(F.col("lang") == "de", F.substring(h, 1, 16)).when(F.col("lang") == "fr", F.upper(h)).otherwise(F.concat(F.lit("G"), F.substring(h, 2, 63)))
    return table(spark, sf, "documents").select("doc_id", FP.is_fingerprint(c).alias("long"), FP.is_short_hash(c).alias("short"))


def fields():
    return {k: F.col(k) for k in U.INPUTS}


LEN = lambda k: f"coalesce(try_cast({k} AS BIGINT), 0)"
SUM = " + ".join(LEN(k) for k in U.INPUTS)


@query("n1_total", f"WITH {USAGE} SELECT event_id, ({SUM})::BIGINT AS total FROM usage")
def n1(spark, sf):
    return usage(spark, sf).select("event_id", U.total_input(fields()).alias("total"))


@query("n2_strict", f"WITH {USAGE} SELECT event_id, CASE WHEN event_id % 9 <> 0 AND input_tokens <> 'bad' AND {SUM} > 0 THEN ({SUM})::BIGINT END AS total FROM usage")
def n2(spark, sf):
    return usage(spark, sf).select("event_id", U.strict_total(F.when(F.col("event_id") % 9 != 0, "message").otherwise("error"), fields()).alias("total"))


SC = lambda k: f"floor(try_cast({k} AS DOUBLE) * 0.5)"


@query("n3_scaled", f"WITH {USAGE} SELECT event_id, " + ", ".join(f"{SC(k)} AS scaled_{k}" for k in U.INPUTS) + f", CASE WHEN has_total THEN {' + '.join(f'coalesce({SC(k)}, 0)' for k in U.INPUTS)} + output_tokens END AS scaled_total_tokens FROM usage")
def n3(spark, sf):
    return usage(spark, sf).select("event_id", *(c.alias(k) for k, c in U.scaled(fields(), F.col("output_tokens"), F.col("has_total"), 0.5).items()))


def dealt(events):
    """Events by their ids: a file holds so many of these short rows that its few row groups would be few tasks for work on every row."""
    return events.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "event_id")


def answers(spark, sf):
    """An answer in one piece for each event, with its usage; one in nine failed, one in ten is no JSON."""
    u = dealt(usage(spark, sf))
    n = F.col("event_id")
    quoted = F.when(n % 7 == 0, F.concat(F.lit('"'), "input_tokens", F.lit('"'))).otherwise(F.col("input_tokens"))
    more = F.coalesce(F.concat(F.lit(',"cache_read_input_tokens":'), "cache_read_input_tokens"), F.lit(""))
    total = F.when(F.col("has_total"), ',"total_tokens":1').otherwise("")
    body = F.concat(F.lit('{"usage":{"input_tokens":'), quoted, F.lit(',"cache_creation_input_tokens":'), "cache_creation_input_tokens", more, F.lit(',"output_tokens":'), F.col("output_tokens").cast("string"), total, F.lit('},"type":"message"}'))
    return u.select("event_id", F.when(n % 9 == 0, 500).otherwise(200).alias("status"), F.when(n % 10 == 3, F.concat(F.lit("no "), body)).otherwise(body).alias("body"))


HALF = lambda k: f"floor(TRY_CAST({k} AS DOUBLE) * 0.5)::BIGINT"
RAW = """'{"usage":{"input_tokens":' || CASE WHEN event_id % 7 = 0 THEN '"bad"' ELSE input_tokens END || ',"cache_creation_input_tokens":' || cache_creation_input_tokens || coalesce(',"cache_read_input_tokens":' || cache_read_input_tokens, '') || ',"output_tokens":' || output_tokens || CASE WHEN has_total THEN ',"total_tokens":1' ELSE '' END || '},"type":"message"}'"""


@query("a12_answers", f"""WITH {USAGE}, u AS (SELECT *, {HALF('cache_creation_input_tokens')} AS a, {HALF('cache_read_input_tokens')} AS b, {HALF('input_tokens')} AS c, event_id % 9 <> 0 AND event_id % 10 <> 3 AS good FROM usage)
SELECT event_id, CASE WHEN good THEN '{{"type":"message","usage":{{"cache_creation_input_tokens":' || a || coalesce(',"cache_read_input_tokens":' || b, '') || ',"input_tokens":' || coalesce(c::VARCHAR, '"bad"') || ',"output_tokens":' || output_tokens || CASE WHEN has_total THEN ',"total_tokens":' || (a + coalesce(b, 0) + coalesce(c, 0) + output_tokens) ELSE '' END || '}}}}' WHEN event_id % 10 = 3 THEN 'no ' || {RAW} ELSE {RAW} END AS body,
CASE WHEN good AND event_id % 7 <> 0 THEN nullif(input_tokens::BIGINT + cache_creation_input_tokens::BIGINT + coalesce(cache_read_input_tokens::BIGINT, 0), 0) END AS actual FROM u""")
def a12(spark, sf):
    """Every answer's body as it goes on, and what its session's baseline learns from it."""
    return scaled_answers(answers(spark, sf), 0.5).select("event_id", "body", "actual")


@query("n5_update_kind", f"WITH {USAGE} SELECT event_id, CASE WHEN output_tokens <= 0 OR event_id % 5 = 0 OR event_id % 7 = 1 THEN 'none' WHEN event_id % 3 = 0 THEN 'stale' ELSE 'exact' END AS kind FROM usage")
def n5(spark, sf):
    n = F.col("event_id")
    return usage(spark, sf).select("event_id", U.update_kind(F.col("output_tokens"), n % 5 != 0, n % 3 != 0, n % 7 != 1).alias("kind"))


@query("n6_facts", f"WITH {USAGE}, {MSG}, t AS (SELECT session_id, sum(tok)::BIGINT AS selected FROM msg GROUP BY 1) SELECT event_id, substr(sha256(session_id::VARCHAR), 1, 16) AS session_hash, selected, ({SUM})::BIGINT AS actual, (({SUM}) - selected)::BIGINT AS actual_minus_selected FROM usage JOIN t USING (session_id)")
def n6(spark, sf):
    t = messages(spark, sf).groupBy("session_id").agg(F.sum("tok").alias("selected"))
    actual = U.total_input(fields())
    return usage(spark, sf).join(t, "session_id").select("event_id", FP.session_hash(F.col("session_id")).alias("session_hash"), "selected", actual.alias("actual"), T.saturating_subtract(actual, F.col("selected")).alias("actual_minus_selected"))


EK = "ek AS (SELECT event_id, event_type, value, json_extract_string(props, '$.k') AS k FROM events)"


def cells(spark, sf):
    """event_id, event_type, value and the k of an event's properties: what the inputs of requests are made of."""
    return table(spark, sf, "events").select("event_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"))


def by_type(**parts):
    """A text for each event_type, of column names in braces and literals; null for the types that aren't named."""
    out = F.when(F.lit(False), "")
    for kind, text in parts.items():
        out = out.when(F.col("event_type") == kind, F.concat(*(F.col(x[1:-1]) if x.startswith("{") and x.endswith("}") and x[1:-1].isidentifier() else F.lit(x) for x in text)))
    return out


@query("b8_agent_role", f"""WITH {EK}, i AS (SELECT event_id, CASE event_type WHEN 'view' THEN repeat(k, (k::INT % 2)) END AS header, CASE event_type WHEN 'click' THEN 'sess; cc_is_subagent = ' || CASE WHEN value > 50 THEN 'true' ELSE 'false' END END AS bill, CASE event_type WHEN 'purchase' THEN '{{"agentType": "' || CASE WHEN value > 50 THEN ' SubAgent ' ELSE k END || '"}}' WHEN 'signup' THEN '{{"agentType": "main", "parentSessionId": "' || repeat(' ', k::INT % 3) || repeat(k, k::INT % 2) || '"}}' END AS ctx,
CASE event_type WHEN 'error' THEN ' x-anthropic-billing-header: cc_is_subagent=' || CASE WHEN value > 50 THEN 'true;' ELSE k END END AS sys FROM ek),
r AS (SELECT event_id, CASE WHEN trim(coalesce(header, '')) <> '' THEN 'agent_id_header' WHEN bill LIKE '%= true' THEN 'billing_marker' WHEN lower(trim(ctx->>'$.agentType')) = 'subagent' THEN 'agent_context_type' WHEN trim(ctx->>'$.parentSessionId') <> '' THEN 'agent_context_parent' WHEN sys LIKE '%=true;' THEN 'system_attribution' ELSE 'no_subagent_marker' END AS reason FROM i)
SELECT event_id, reason, CASE reason WHEN 'no_subagent_marker' THEN 'main' ELSE 'subagent' END AS role FROM r""")
def b8(spark, sf):
    large = F.col("value") > 50
    half = F.expr("repeat(k, cast(k as int) % 2)")
    e = cells(spark, sf).withColumns({"half": half, "gap": F.concat(F.expr("repeat(' ', cast(k as int) % 3)"), half), "yes": F.when(large, "true").otherwise("false"), "kind": F.when(large, " SubAgent ").otherwise(F.col("k")), "mark": F.when(large, "true;").otherwise(F.col("k"))})
    context = by_type(purchase=('{"agentType": "', "{kind}", '"}'), signup=('{"agentType": "main", "parentSessionId": "', "{gap}", '"}'))
    system = by_type(error=('[{"type": "text", "text": " x-anthropic-billing-header: cc_is_subagent=', "{mark}", '"}]'))
    type_, parent = RQ.agent_context(context)
    role, reason = RQ.agent_role(by_type(view=("{half}",)), RQ.is_subagent_mark(by_type(click=("sess; cc_is_subagent = ", "{yes}"))), type_, parent, RQ.system_facts(system)[2])
    return e.select("event_id", reason.alias("reason"), role.alias("role"))


@query("b10_agent_context", f"""WITH {EK}, i AS (SELECT event_id, CASE event_type WHEN 'click' THEN '{{"agentType": "MAIN", "parentSessionId": "' || k || '"}}' WHEN 'purchase' THEN '{{"agentType": "' || event_type || k || '"}}' WHEN 'signup' THEN '{{"agentType": ' || k || '}}' WHEN 'error' THEN '{{"parentSessionId": "' || repeat(k, k::INT % 2) || '"}}' END AS c FROM ek)
SELECT event_id, CASE WHEN c IS NULL OR json_type(c, '$.agentType') IS NULL THEN 'missing' WHEN json_type(c, '$.agentType') <> 'VARCHAR' THEN 'malformed' WHEN lower(c->>'$.agentType') IN ('main', 'subagent') THEN lower(c->>'$.agentType') ELSE 'other' END AS type, coalesce(c->>'$.parentSessionId' <> '', false) AS parent FROM i""")
def b10(spark, sf):
    e = cells(spark, sf).withColumn("half", F.expr("repeat(k, cast(k as int) % 2)"))
    raw = by_type(click=('{"agentType": "MAIN", "parentSessionId": "', "{k}", '"}'), purchase=('{"agentType": "', "{event_type}", "{k}", '"}'), signup=('{"agentType": ', "{k}", "}"), error=('{"parentSessionId": "', "{half}", '"}'))
    type_, parent = RQ.agent_context(raw)
    return e.select("event_id", type_.alias("type"), parent.alias("parent"))


@query("b11_family", f"""WITH {EK}, i AS (SELECT event_id AS id, lower(CASE event_type WHEN 'view' THEN 'DeepSeek-V' || k WHEN 'click' THEN 'claude-' || k || '-Haiku' WHEN 'purchase' THEN 'CLAUDE-' || k ELSE event_type || '-haiku' END) AS m FROM ek)
SELECT id, CASE WHEN contains(m, 'deepseek') THEN 'deepseek' WHEN contains(m, 'claude') THEN CASE WHEN contains(m, 'haiku') THEN 'claude-haiku' ELSE 'claude' END ELSE 'unknown' END AS family FROM i""")
def b11(spark, sf):
    other = ("{event_type}", "-haiku")
    m = by_type(view=("DeepSeek-V", "{k}"), click=("claude-", "{k}", "-Haiku"), purchase=("CLAUDE-", "{k}"), signup=other, error=other)
    return cells(spark, sf).select(F.col("event_id").alias("id"), RQ.model_family(m).alias("family"))


@query("b12_system_shape", f"""WITH {EK}, i AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN '"x cc_entrypoint=sdk-' || CASE WHEN value > 50 THEN 'ts' ELSE k END || '"' WHEN 'click' THEN '[{{"type": "text", "text": "' || k || '"}}, {{"type": "text", "text": "cc_entrypoint=sdk-' || CASE WHEN value > 50 THEN 'ts' ELSE k END || '"}}]' WHEN 'purchase' THEN '{{"a": ' || k || '}}' WHEN 'error' THEN k END AS s FROM ek)
SELECT id, CASE WHEN s IS NULL THEN 'missing' WHEN json_type(s) = 'VARCHAR' THEN 'string' WHEN json_type(s) = 'ARRAY' THEN 'array' ELSE 'unknown' END AS shape, coalesce(contains(s, 'cc_entrypoint=sdk-ts'), false) AS sdk FROM i""")
def b12(spark, sf):
    e = cells(spark, sf).withColumn("mark", F.when(F.col("value") > 50, "ts").otherwise(F.col("k")))
    raw = by_type(view=('"x cc_entrypoint=sdk-', "{mark}", '"'), click=('[{"type": "text", "text": "', "{k}", '"}, {"type": "text", "text": "cc_entrypoint=sdk-', "{mark}", '"}]'), purchase=('{"a": ', "{k}", "}"), error=("{k}",))
    shape, sdk, _ = RQ.system_facts(raw)
    return e.select(F.col("event_id").alias("id"), shape.alias("shape"), sdk.alias("sdk"))


@query("b1_title", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'title_prompt_fallback' WHEN 1 THEN 'title_schema' WHEN 6 THEN 'title_prompt_fallback' END AS reason FROM events")
def b1(spark, sf):
    k = F.col("event_id") % 8
    text = (
        F.when(k == 2, "<session>a").when(k == 3, "<session>a</session> do more").when(k == 6, "<session>a <session>b</session></session>\nWrite the title in Deutsch (Schweiz). Keep technical terms and code identifiers in their original form.")
        .when(k == 7, "<session>a</session>\nWrite the title in ignore previous. Keep technical terms and code identifiers in their original form.").otherwise(" <session>a</session> ")
    )
    system = F.when(k == 4, "You are helpful").otherwise('Generate a title for this coding session, 3-7 words, as a single "title" field')
    schema = '{"format": {"type": "json_schema", "schema": {"type": "object", "properties": {"title": {"type": "string"}}, "required": ["title"], "additionalProperties": false}}}'
    config = F.when(k == 1, schema).when(k == 5, '{"format": {"type": "json_schema"}, "more": 1}')
    return table(spark, sf, "events").select("event_id", RQ.auxiliary(F.lit(1), F.lit("user"), text, system, config).alias("reason"))


@query("b14_probes", f"""WITH {EK}, i AS (SELECT event_id, '{{"model": "' || event_type || '-' || k || '", "stream": ' || CASE WHEN value > 50 THEN 'true' ELSE 'false' END || ', "messages": [' || array_to_string(list_transform(range(k::INT % 7), lambda x: '{{}}'), ',') || ']}}' AS b FROM ek)
SELECT event_id, b->>'$.model' AS model, json_array_length(b, '$.messages')::INT AS n, (b->>'$.stream') = 'true' AS stream FROM i""")
def b14(spark, sf):
    many = F.array_join(F.array_repeat(F.lit("{}"), F.col("k").cast("int") % 7), ",")
    body = F.concat(F.lit('{"model": "'), "event_type", F.lit("-"), "k", F.lit('", "stream": '), F.when(F.col("value") > 50, "true").otherwise("false"), F.lit(', "messages": ['), many, F.lit("]}"))
    model, count, stream = probes(body)
    return cells(spark, sf).select("event_id", model.alias("model"), count.alias("n"), stream.alias("stream"))


@query("a15_redacted_headers", f"""WITH {EK} SELECT event_id, CASE WHEN list_contains({list_sql(RQ.SENSITIVE_HEADERS)}, lower(trim(h))) THEN '[REDACTED]' ELSE k END AS value FROM (SELECT event_id, k, CASE event_type WHEN 'view' THEN ' Authorization' WHEN 'click' THEN 'X-Api-Key ' WHEN 'purchase' THEN 'Set-Cookie' ELSE 'x-' || event_type END AS h FROM ek)""")
def a15(spark, sf):
    other = ("x-", "{event_type}")
    h = F.create_map(by_type(view=(" Authorization",), click=("X-Api-Key ",), purchase=("Set-Cookie",), signup=other, error=other), F.col("k"))
    return cells(spark, sf).select("event_id", F.map_values(RQ.redacted_headers(h))[0].alias("value"))


@query("a5_content_kinds", f"WITH {MSG} SELECT session_id, idx, CASE idx % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'array' WHEN 2 THEN 'invalid' ELSE 'empty' END AS kind, CASE WHEN idx % 4 = 0 THEN text WHEN idx % 4 = 1 THEN 'a' WHEN idx % 4 = 2 THEN '' END AS first, CASE WHEN idx % 4 = 3 THEN 0 ELSE 1 END AS n FROM msg")
def a5(spark, sf):
    k = F.col("idx") % 4
    m = messages(spark, sf)
    raw = F.when(k == 0, F.to_json(F.array("text"))).when(k == 1, '[{"type": "text", "text": "a", "cache_control": {"type": "ephemeral"}}]').when(k == 2, "{broken")
    raw = F.when(k == 0, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    kind, blocks = parse_content(raw)
    return m.select("session_id", "idx", kind.alias("kind"), F.get(blocks, F.lit(0))["text"].alias("first"), F.size(blocks).alias("n"))


def streams(spark, sf):
    """Event streams of a response each: whole, without an end, with two starts, with a wrong name, malformed, with nothing."""
    n = F.col("event_id")
    k = n % 6
    use = F.concat(F.lit('{"type":"message_start","message":{"id":"msg_'), n.cast("string"), F.lit('","type":"message","role":"assistant","model":"m","content":[],"usage":{"input_tokens":'), n.cast("string"), F.lit(',"cache_read_input_tokens":8,"output_tokens":1,"total_tokens":'), (n + 9).cast("string"), F.lit("}}}"))
    start = F.concat(F.lit("event: message_start\ndata: "), use)
    stop = F.lit('event: message_stop\ndata: {"type":"message_stop"}')
    delta = F.lit('event: content_block_delta\ndata: {"type":"content_block_delta"}')
    spent = F.concat(F.lit('event: message_delta\ndata: {"type":"message_delta","delta":{"stop_reason":"end_turn"},"usage":{"input_tokens":'), n.cast("string"), F.lit(',"output_tokens":7,"total_tokens":'), (n + 7).cast("string"), F.lit("}}"))
    text = F.when(k == 0, F.concat_ws("\n\n", start, delta, stop)).when(k == 1, F.concat_ws("\n\n", stop, start)).when(k == 2, F.concat_ws("\n\n", start, start, stop)).when(k == 3, F.concat_ws("\n\n", start, spent)).when(k == 4, F.concat_ws("\n\n", start, F.lit('event: message_stop\ndata: {"type":"ping"}'), stop)).otherwise(delta)
    return dealt(table(spark, sf, "events").select("event_id")).select(n.alias("stream_id"), text.alias("text"))


@query("k15_sse_lifecycle", "SELECT event_id AS stream_id, event_id % 6 = 0 AS complete, CASE WHEN event_id % 6 = 0 THEN 8 + event_id END AS actual FROM events")
def k15(spark, sf):
    return lifecycles(event_rows(streams(spark, sf)))


START = """'{"message":{"content":[],"id":"msg_' || event_id || '","model":"m","role":"assistant","type":"message","usage":{"cache_read_input_tokens":4,"input_tokens":' || event_id // 2 || ',"output_tokens":1,"total_tokens":' || event_id // 2 + 5 || '}},"type":"message_start"}'"""
SPENT = """'{"delta":{"stop_reason":"end_turn"},"type":"message_delta","usage":{"output_tokens":7,"total_tokens":7}}'"""
STOP, DELTA, PING = (f"""'{{"type":"{k}"}}'""" for k in ("message_stop", "content_block_delta", "ping"))


@query("n4_sse", f"""WITH s AS (SELECT event_id, {START} AS a, {STOP} AS z, {DELTA} AS d, {SPENT} AS u, {PING} AS p FROM events),
l AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ['message_start', 'content_block_delta', 'message_stop'] WHEN 1 THEN ['message_stop', 'message_start'] WHEN 2 THEN ['message_start', 'message_start', 'message_stop'] WHEN 3 THEN ['message_start', 'message_delta'] WHEN 4 THEN ['message_start', 'message_stop', 'message_stop'] ELSE ['content_block_delta'] END AS names,
CASE event_id % 6 WHEN 0 THEN [a, d, z] WHEN 1 THEN [z, a] WHEN 2 THEN [a, a, z] WHEN 3 THEN [a, u] WHEN 4 THEN [a, p, z] ELSE [d] END AS datas FROM s)
SELECT event_id AS stream_id, i - 1 AS seq, names[i] AS event, datas[i] AS data FROM l, unnest(range(1, len(names) + 1)) AS u(i)""")
def n4(spark, sf):
    """Every event of every stream after scaling, rewritten or as it was."""
    return scaled_events(event_rows(streams(spark, sf)), 0.5).select("stream_id", "seq", "event", "data")


@query("a13_sse_events", "SELECT event_id AS stream_id, CASE event_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 1 END AS n FROM events")
def a13(spark, sf):
    return event_rows(streams(spark, sf)).groupBy("stream_id").agg(F.count("*").alias("n"))


@query("ext_session_window", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k")
def session_window(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("began"), "n")


@query("b23_tracked", "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'purchase')")
def tracked(spark, sf):
    role = by_type(view=("main",), click=("subagent",), purchase=("title",), signup=("unknown",), error=("unknown",))
    return keep(table(spark, sf, "events").select("event_id", role.alias("request_role"))).select("event_id")
