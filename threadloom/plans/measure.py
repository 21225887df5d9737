"""Queries that measure tokens, media and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import tokens as T
from threadloom.operators import history as H
from threadloom.plans.registry import query
from threadloom.plans.views import ACT, MSG, messages, table, tool_results, tool_uses


@query("d_message_tokens", f"WITH {MSG} SELECT session_id, idx, tok FROM msg")
def message_tokens(spark, sf):
    return messages(spark, sf).select("session_id", "idx", "tok")


@query("d_conversation_tokens", f"WITH {MSG} SELECT session_id, count(*) AS n, sum(tok)::BIGINT AS tokens FROM msg GROUP BY 1")
def conversation_tokens(spark, sf):
    return messages(spark, sf).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("tok").alias("tokens"))


@query("d5_block_tokens", f"WITH {ACT} SELECT session_id, idx, strlen(content) // 4 AS tok FROM results UNION ALL SELECT session_id, idx, strlen(name) // 4 + strlen('{{\"file_path\":\"' || file_path || '\"}}') // 4 FROM uses WHERE file_path IS NOT NULL")
def block_tokens(spark, sf):
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    r = tool_results(spark, sf).select("session_id", "idx", T.block_tokens(F.lit("tool_result"), none, none, none, empty, F.col("content")).alias("tok"))
    u = tool_uses(spark, sf).filter(F.map_contains_key("input", F.lit("file_path")))
    return r.unionByName(u.select("session_id", "idx", T.block_tokens(F.lit("tool_use"), none, none, F.col("name"), F.col("input"), none).alias("tok")))


@query("d_budget_split", "SELECT o_orderkey AS id, t, t * 2 // 100 AS narrative, t * 3 // 100 AS retrieval, t * 25 // 100 AS re_expansion, t * 30 // 100 AS fresh, t - t * 2 // 100 - t * 3 // 100 - t * 25 // 100 - t * 30 // 100 AS stub FROM (SELECT o_orderkey, 1000 + (o_orderkey * 37) % 200000 AS t FROM orders)")
def budget_split(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (1000 + (F.col("o_orderkey") * 37) % 200000).alias("t"))
    return o.select("id", "t", *(c.alias(k) for k, c in T.budget(F.col("t")).items()))


SIZES = "SELECT p_partkey AS id, p_partkey % 4001 AS w, (p_partkey * 7) % 3001 AS h FROM part"


def _sizes(spark, sf):
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(p.alias("id"), (p % 4001).alias("w"), ((p * 7) % 3001).alias("h"))


@query("d_visual_tokens", f"SELECT id, CASE WHEN w > 0 AND h > 0 AND ((w + 27) // 28) * ((h + 27) // 28) <= 8192 THEN ((w + 27) // 28) * ((h + 27) // 28) END AS tok FROM ({SIZES})")
def visual(spark, sf):
    return _sizes(spark, sf).select("id", T.visual_tokens(F.col("w"), F.col("h")).alias("tok"))


@query("d_payload_fallback", "SELECT page_id AS id, least(greatest(length(html) * 3 // 32, 32), 8192)::BIGINT AS tok FROM pages")
def fallback(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), T.payload_fallback(F.length("html")).alias("tok"))


@query("d_png_header", f"SELECT id, w AS width, h AS height, CASE WHEN w > 0 AND h > 0 AND ((w + 27) // 28) * ((h + 27) // 28) <= 8192 THEN ((w + 27) // 28) * ((h + 27) // 28) ELSE 32 END AS tok FROM ({SIZES})")
def png_header(spark, sf):
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    head = F.unhex(F.lit("89504E470D0A1A0A0000000D49484452"))
    made = _sizes(spark, sf).withColumn("data", F.base64(F.concat(head, number(F.col("w")), number(F.col("h")))))
    size = T.png_size(F.col("data"))
    return made.select("id", size["width"].alias("width"), size["height"].alias("height"), T.image_tokens(F.col("data")).alias("tok"))


@query("d10_saturating", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 9223372036854775807 ELSE event_id + 5 END AS total, event_id - 5 AS rest FROM events")
def saturating(spark, sf):
    n = F.col("event_id")
    big = F.when(n % 2 == 0, F.lit(T.MOST)).otherwise(n)
    return table(spark, sf, "events").select("event_id", T.saturating_add(big, F.lit(5)).alias("total"), T.saturating_subtract(n, F.lit(5)).alias("rest"))


LENGTHS = "SELECT c_custkey AS id, (c_custkey * 17) % 4000 AS n, ((c_custkey * 13) % 40) / 10.0 AS p FROM customer"


@query("d13_boundaries", f"""SELECT id, trunc((CASE WHEN n < 500 THEN 5 WHEN n < 2000 THEN 5 ELSE 4 END) * s)::BIGINT AS s0, trunc((CASE WHEN n < 500 THEN 15 WHEN n < 2000 THEN 12 ELSE 10 END) * s)::BIGINT AS s1,
trunc((CASE WHEN n < 500 THEN 50 WHEN n < 2000 THEN 40 ELSE 30 END) * s)::BIGINT AS s2 FROM (SELECT id, n, CASE WHEN p < 2.5 THEN greatest(least(1 + (2.5 - p::DOUBLE) / 0.75, 4.0), 1.0) ELSE 1.0 END::DOUBLE AS s FROM ({LENGTHS}))""")
def boundaries(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("id"), ((k * 17) % 4000).alias("n"), (((k * 13) % 40) / 10.0).alias("p"))
    return c.select("id", *(x.alias(f"s{i}") for i, x in enumerate(T.stage_bounds(F.col("n"), F.col("p")))))


@query("d14_intensity", f"""WITH {ACT}, n AS (SELECT session_id, count(*) * 2 AS n FROM ev GROUP BY 1),
e AS (SELECT r.session_id, count(*) FILTER (is_error) AS errors FROM results r JOIN n USING (session_id) WHERE idx >= n - 10 GROUP BY 1),
u AS (SELECT u.session_id, count(*) AS calls FROM uses u JOIN n USING (session_id) WHERE idx >= n - 10 GROUP BY 1)
SELECT n.session_id, round(least(1.0, coalesce(errors, 0) * 0.15 + CASE WHEN coalesce(calls, 0) > 5 THEN 0.2 ELSE 0 END), 6)::DOUBLE AS intensity FROM n LEFT JOIN e USING (session_id) LEFT JOIN u USING (session_id)""")
def intensity(spark, sf):
    r = tool_results(spark, sf).select("session_id", "idx", F.col("is_error").cast("int").alias("error"), F.lit(0).alias("use"))
    u = tool_uses(spark, sf).select("session_id", "idx", F.lit(0).alias("error"), F.lit(1).alias("use"))
    last = H.last_messages(r.unionByName(u), 10)
    return last.groupBy("session_id").agg(F.round(T.intensity(F.sum("error"), F.sum("use"), F.lit(0)), 6).alias("intensity"))


@query("c35_approximate", "SELECT o_orderkey AS id, CASE WHEN n < 1000 THEN n::VARCHAR WHEN (n % 1000) // 100 = 0 THEN (n // 1000) || 'k' ELSE (n // 1000) || '.' || ((n % 1000) // 100) || 'k' END AS shown FROM (SELECT o_orderkey, (o_orderkey * 31) % 150000 AS n FROM orders)")
def approximate(spark, sf):
    n = (F.col("o_orderkey") * 31) % 150000
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.approximate(n).alias("shown"))


@query("d16_media_facts", "SELECT page_id AS id, strlen(html) AS bytes, (page_id % 3 <> 0) AS strict FROM pages WHERE html IS NOT NULL")
def media_facts(spark, sf):
    data = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("!"), F.base64(F.col("html").cast("binary")))).otherwise(F.base64(F.col("html").cast("binary")))
    p = table(spark, sf, "pages").filter("html is not null").select(F.col("page_id").alias("id"), "html", F.regexp_replace(data, "[\r\n]", "").alias("data"))
    good = F.col("data").rlike("^[A-Za-z0-9+/]*={0,2}$")
    size = F.octet_length(F.unbase64(F.regexp_replace("data", "^!", "")))
    return p.select("id", size.cast("bigint").alias("bytes"), good.alias("strict"))


@query("ext_token_rollup", f"WITH {MSG} SELECT session_id, role, sum(tok)::BIGINT AS tokens, count(*) AS n FROM msg GROUP BY ROLLUP (session_id, role)")
def token_rollup(spark, sf):
    return messages(spark, sf).rollup("session_id", "role").agg(F.sum("tok").alias("tokens"), F.count("*").alias("n"))


@query("d12_spending", "SELECT p_partkey AS id, [true, c1 <= 100 - 40, c2 <= 100 - 40 - CASE WHEN c1 <= 60 THEN c1 ELSE 0 END] AS fits FROM (SELECT p_partkey, p_partkey % 90 AS c1, p_partkey % 50 AS c2 FROM part)")
def spending(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), T.spent_in_order(F.array(F.lit(40).cast("bigint"), k % 90, k % 50), F.lit(100)).alias("fits"))


@query("d15_cache_gap", "SELECT event_id AS id, CASE WHEN event_type = 'view' AND value > 50 THEN 3660 ELSE 240 END AS gap, CASE WHEN event_type = 'view' AND value > 50 THEN 3900 ELSE 1800 END AS keep FROM events")
def cache_gap(spark, sf):
    ttl = F.when((F.col("event_type") == "view") & (F.col("value") > 50), "1h").when(F.col("event_type") == "click", "ephemeral")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), T.cache_gap_seconds(ttl).alias("gap"), T.snapshot_ttl_seconds(ttl).alias("keep"))
