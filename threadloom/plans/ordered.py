"""Queries of operators over the order of messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions import tokens as T
from threadloom.operators import history as H
from threadloom.plans.registry import query
from threadloom.plans.texts import EVENT
from threadloom.plans.views import ACT, MSG, messages, tool_results, tool_uses
from threadloom.sources.tables import kept

CUT = """n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, sum(tok) OVER (PARTITION BY session_id ORDER BY idx DESC) AS kept FROM rows),
f AS (SELECT session_id, any_value(n) AS n, max(CASE WHEN kept >= {floor} AND idx >= 1 THEN idx END) AS found, min(CASE WHEN active THEN idx END) AS act FROM n GROUP BY 1),
c AS (SELECT *, least(n - {keep}, coalesce(act, n)) AS most, least(found, least(n - {keep}, coalesce(act, n))) AS cut FROM f),
g AS (SELECT c.*, CASE WHEN r.role = 'user' AND r.has_result THEN CASE WHEN cut + 1 <= most THEN cut + 1 WHEN cut > 1 AND p.role = 'assistant' AND p.has_use THEN cut - 1 ELSE cut END ELSE cut END AS fin FROM c LEFT JOIN rows r ON r.session_id = c.session_id AND r.idx = cut LEFT JOIN rows p ON p.session_id = c.session_id AND p.idx = cut - 1),
o AS (SELECT session_id, n, CASE WHEN coalesce(n >= 2 AND found >= 2 AND n - {keep} >= 1 AND fin >= 2 AND fin < n AND fin <= most, false) THEN fin ELSE -1 END AS cutoff FROM g)"""
CUT_END = "SELECT o.session_id, o.n, o.cutoff, coalesce((SELECT sum(tok) FROM rows WHERE rows.session_id = o.session_id AND rows.idx >= 1 AND rows.idx < o.cutoff), 0)::BIGINT AS archived_tokens FROM o"
MSG_ROWS = f"{MSG}, rows AS (SELECT *, false AS has_result, false AS has_use, false AS active FROM msg)"


@query("g1_collapse_cutoff", f"WITH {MSG_ROWS}, {CUT.format(floor=400, keep=2)} {CUT_END}")
def cutoff(spark, sf):
    return H.collapse_cutoff(messages(spark, sf), 400, 2)


def act_rows(spark, sf):
    """A row for each call and answer: role, tok, has_use, has_result, use_ids, result_ids."""
    u = tool_uses(spark, sf).select("session_id", "idx", F.lit("assistant").alias("role"), (4 + 2 + T.estimate(F.col("name"))).alias("tok"), F.lit(True).alias("has_use"), F.lit(False).alias("has_result"), F.array("id").alias("use_ids"), F.array().cast("array<string>").alias("result_ids"))
    r = tool_results(spark, sf).select("session_id", "idx", F.lit("user").alias("role"), (4 + 1 + T.estimate(F.col("content"))).alias("tok"), F.lit(False).alias("has_use"), F.lit(True).alias("has_result"), F.array().cast("array<string>").alias("use_ids"), F.array("tool_use_id").alias("result_ids"))
    return u.unionByName(r)


ACT_ROWS = f"{ACT}, rows AS (SELECT session_id, idx, 'assistant' AS role, 6 + strlen(name) // 4 AS tok, true AS has_use, false AS has_result, idx >= m - 1 AS active FROM uses JOIN (SELECT session_id, max(2 * r) + 1 AS m FROM ev GROUP BY 1) USING (session_id) UNION ALL SELECT session_id, idx, 'user', 5 + strlen(content) // 4, false, true, idx >= m - 1 FROM results JOIN (SELECT session_id, max(2 * r) + 1 AS m FROM ev GROUP BY 1) USING (session_id))"


@query("b22_active_pair", f"WITH {ACT_ROWS} SELECT session_id, idx, role FROM rows WHERE active")
def active(spark, sf):
    return H.with_active_pair(act_rows(spark, sf)).filter("active").select("session_id", "idx", "role")


@query("g1_cutoff_tool_pairs", f"WITH {ACT_ROWS}, {CUT.format(floor=3000, keep=2)} {CUT_END}")
def cutoff_pairs(spark, sf):
    return H.collapse_cutoff(H.with_active_pair(act_rows(spark, sf)), 3000, 2)


@query("g2_event_runs", f"""WITH {ACT}, e AS (SELECT session_id, idx, {EVENT} AS event FROM uses WHERE name NOT IN ('Grep', 'Read')),
k AS (SELECT *, CASE WHEN event LIKE '%] git commit' OR event LIKE '%] Bash: %' THEN '' WHEN event LIKE '%] Edit: %' OR event LIKE '%] Write: %' THEN lower(split_part(split_part(event, '] ', 2), ': ', 1)) || ':' || split_part(event, ': ', 2) ELSE lower(split_part(event, '] ', 2)) END AS key FROM e),
s AS (SELECT *, CASE WHEN key = '' OR key IS DISTINCT FROM lag(key) OVER w THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY session_id ORDER BY idx)),
g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY idx) AS run FROM s),
c AS (SELECT *, count(*) OVER (PARTITION BY session_id, run) AS m, row_number() OVER (PARTITION BY session_id, run ORDER BY idx) AS f FROM g)
SELECT session_id, idx, CASE WHEN m > 2 THEN event || ' (' || m || 'x)' ELSE event END AS event, CASE WHEN m > 2 THEN m ELSE 1 END AS n FROM c WHERE m <= 2 OR f = 1""")
def event_runs(spark, sf):
    e = tool_uses(spark, sf).select("session_id", "idx", X.timeline_event(F.col("name"), F.col("input"), F.col("idx")).alias("event")).filter("event is not null")
    return H.fold_events(e, X.run_key(F.col("event")))


STAGES = "st AS (SELECT session_id, idx, role, CASE WHEN idx % 67 = 0 THEN 1 ELSE 3 END AS stage FROM rows)"
RUNS = f"""{STAGES}, sn AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM st), k AS (SELECT *, idx - row_number() OVER (PARTITION BY session_id ORDER BY idx) AS s FROM sn WHERE stage = 3 AND idx >= 1 AND idx <= n - 5),
runs AS (SELECT session_id, min(idx) AS start, max(idx) AS "end" FROM k GROUP BY session_id, s HAVING count(*) >= 50)"""


def stages(spark, sf):
    return act_rows(spark, sf).select("session_id", "idx", "role", F.when(F.col("idx") % 67 == 0, 1).otherwise(3).alias("stage"))


@query("g3_stage3_islands", f'WITH {ACT_ROWS}, {RUNS} SELECT session_id, start, "end" FROM runs')
def stage3(spark, sf):
    return H.compactable_runs(stages(spark, sf))


PIECES = f"""{RUNS}, b AS (SELECT runs.*, l.role AS lr, r.role AS rr FROM runs LEFT JOIN rows l ON l.session_id = runs.session_id AND l.idx = start - 1 LEFT JOIN rows r ON r.session_id = runs.session_id AND r.idx = "end" + 1),
pieces AS (SELECT session_id, start, "end", CASE lr WHEN 'user' THEN 'assistant' ELSE 'user' END AS role FROM b WHERE lr = rr OR rr IS NULL
UNION ALL SELECT session_id, start, start + ("end" - start) // 2, CASE lr WHEN 'user' THEN 'assistant' ELSE 'user' END FROM b WHERE lr <> rr UNION ALL SELECT session_id, start + ("end" - start) // 2 + 1, "end", CASE rr WHEN 'user' THEN 'assistant' ELSE 'user' END FROM b WHERE lr <> rr)"""


@query("g4_roles", f'WITH {ACT_ROWS}, {PIECES} SELECT session_id, start, "end", role FROM pieces')
def roles(spark, sf):
    s = stages(spark, sf)
    return H.compacted_rows(s, H.compactable_runs(s))


#: Rows that a task sorts by session, about.
ROWS = 200_000


@query("g5_compact", f"""WITH {ACT_ROWS}, {PIECES}, t AS (SELECT p.session_id, p.start, p."end", p.role, name, count(*) AS c FROM pieces p JOIN uses u ON u.session_id = p.session_id AND u.idx BETWEEN p.start AND p."end" GROUP BY ALL),
l AS (SELECT session_id, start, "end", role, string_agg(name || '(' || c || ')', ', ' ORDER BY c DESC, name) AS tools FROM t GROUP BY ALL)
SELECT session_id, start AS idx, role, '[Compacted: Messages ' || start || '-' || "end" || ' (' || ("end" - start + 1) || ' msgs)]' || chr(10) || 'Tools: ' || tools AS text FROM l
UNION ALL SELECT r.session_id, r.idx, r.role, NULL FROM rows r WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.session_id = r.session_id AND r.idx BETWEEN start AND "end")""")
def compact(spark, sf):
    # Rows are written, and dealt to tasks by their number: such rows shrink so much that a task of some bytes would sort very many.
    s = kept(stages(spark, sf))
    parts = s.count() // ROWS + 1
    runs = kept(H.compactable_runs(s.repartition(parts, "session_id")))
    pieces = H.compacted_rows(s, runs, parts)
    u = tool_uses(spark, sf).select("session_id", "idx", F.col("name").alias("key"))
    counts = H.in_runs(u, pieces.select("session_id", "start", "end", "role"), parts=parts).filter("run is not null").groupBy("session_id", "run.start", "run.end", "run.role", "key").agg(F.count("*").alias("n"))
    line = counts.groupBy("session_id", "start", "end", "role").agg(X.counts_line(F.collect_list(F.struct("key", "n"))).alias("tools"))
    made = line.select("session_id", F.col("start").alias("idx"), "role", X.compacted_text(F.col("start"), F.col("end"), F.lit(""), F.col("tools")).alias("text"))
    left = H.in_runs(s, runs.select("session_id", "start", "end"), parts=parts).filter("run is null")
    return left.select("session_id", "idx", "role", F.lit(None).cast("string").alias("text")).unionByName(made)


@query("g7_merge_adjacent", f"""WITH {MSG}, d AS (SELECT * FROM msg WHERE idx % 5 <> 1), s AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY session_id ORDER BY idx) THEN 1 ELSE 0 END AS new FROM d),
g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY idx) AS run FROM s) SELECT session_id, min(idx) AS idx, any_value(role) AS role, string_agg(text, '|' ORDER BY idx) AS texts FROM g GROUP BY session_id, run""")
def merged(spark, sf):
    return H.merge_adjacent(messages(spark, sf).filter("idx % 5 <> 1")).withColumn("texts", F.array_join("texts", "|"))


@query("g8_following_assistant", f"WITH {MSG} SELECT session_id, idx, coalesce(max(CASE WHEN role = 'assistant' THEN idx END) OVER (PARTITION BY session_id) > idx, false) AS answered FROM msg")
def following(spark, sf):
    return messages(spark, sf).select("session_id", "idx", F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("idx"))).over(H.in_session()) > F.col("idx"), F.lit(False)).alias("answered"))


@query("g9_last_rows", f"WITH {MSG} SELECT session_id, idx FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM msg) WHERE idx >= n - 3")
def last_rows(spark, sf):
    return H.last_messages(messages(spark, sf), 3).select("session_id", "idx")


@query("g11_stage", f"""WITH {MSG}, s AS (SELECT session_id, idx, count(*) OVER (PARTITION BY session_id) AS n, CASE WHEN idx % 4 <> 0 THEN idx * 11 END AS age, (idx % 5) / 5.0 AS heat, idx % 3 = 0 AS pin FROM msg),
b AS (SELECT *, floor(heat * 20) + CASE WHEN pin THEN 30 ELSE 0 END AS boost FROM s)
SELECT session_id, idx, CASE WHEN age IS NULL OR age < 15 + boost THEN 0 WHEN age < 45 + boost THEN 1 WHEN age < 150 + boost THEN 2 ELSE 3 END AS stage FROM b""")
def stage(spark, sf):
    m = messages(spark, sf).withColumn("n", F.count("*").over(H.in_session()))
    age = F.when(F.col("idx") % 4 != 0, F.col("idx") * 11)
    return m.select("session_id", "idx", T.stage(age, (F.col("idx") % 5) / F.lit(5.0), F.col("idx") % 3 == 0, F.col("n"), F.lit(1.0)).alias("stage"))


@query("g13_seq", "SELECT event_id AS request_id, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) AS seq FROM events")
def seq(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("session_id"), (F.col("event_id") % 3).alias("epoch"), "ts")
    return H.request_sequence(e).select("request_id", "seq")


MARKS = "mk AS (SELECT session_id, idx, idx % 7 = 3 OR idx % 11 = 0 AS marked, CASE WHEN session_id % 2 = 0 AND idx % 7 = 3 THEN '1h' END AS ttl FROM rows)"


def marks(spark, sf):
    return act_rows(spark, sf).select("session_id", "idx", F.lit(0).alias("pos"), ((F.col("idx") % 7 == 3) | (F.col("idx") % 11 == 0)).alias("marked"), F.when((F.col("session_id") % 2 == 0) & (F.col("idx") % 7 == 3), "1h").alias("ttl"))


@query("g14_keep_last_markers", f"WITH {ACT_ROWS}, {MARKS} SELECT session_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS k FROM mk WHERE marked) WHERE k <= 4")
def keep_last(spark, sf):
    return H.keep_last_marks(marks(spark, sf)).filter("marked").select("session_id", "idx")


@query("g15_boundary_marker", f"WITH {ACT_ROWS}, {MARKS} SELECT session_id, 9 AS idx, CASE WHEN bool_or(coalesce(ttl = '1h' AND marked, false)) THEN '1h' ELSE 'ephemeral' END AS ttl FROM mk GROUP BY 1 HAVING max(idx) >= 9")
def boundary(spark, sf):
    return H.boundary_mark(marks(spark, sf), F.lit(10)).filter("marked").select("session_id", "idx", "ttl")


@query("g16_first_rows", f"WITH {MSG} SELECT session_id, idx FROM msg WHERE idx < 3")
def first_rows(spark, sf):
    return H.first_messages(messages(spark, sf), 3).select("session_id", "idx")
