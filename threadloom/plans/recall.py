"""Queries of recall from beginning to end: full expansion, its text, what is taken, and the figures of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import archive as A
from threadloom.operators import search as S
from threadloom.plans.archived import COST, FOLDED, FOUND, HINTED, KWS, LEVEL, NL, OWN, RANKING, TRY, UNDOMINATED, candidates, hinted, kw_posts, own, undominated
from threadloom.plans.path import HIST
from threadloom.plans.registry import query
from threadloom.plans.views import ACT, ARCHIVE, MSG, archives, histories, truncate_sql
from threadloom.sources.tables import kept

PIECE = f"CASE type WHEN 'text' THEN text WHEN 'tool_use' THEN '[tool: ' || name || ']' WHEN 'tool_result' THEN CASE WHEN content <> '' THEN '[result] ' || {truncate_sql('content', 200)} END END"
LINES = f"""lt AS (SELECT session_id, idx, any_value(role) AS role, string_agg(piece, {NL} ORDER BY pos) AS said FROM (SELECT *, {PIECE} AS piece FROM hist) WHERE coalesce(piece, '') <> '' GROUP BY 1, 2),
ln AS (SELECT session_id AS hs, idx, line, sum(length(line) + 1) OVER (PARTITION BY session_id ORDER BY idx DESC) AS cum FROM (SELECT session_id, idx, '[' || role || ']: ' || {truncate_sql('said', 2000)} AS line FROM lt))"""


def shown(room: str) -> str:
    """SQL, grouped: the last lines of ln that fit."""
    return f"coalesce('[...' || max(CASE WHEN cum > {room} THEN idx + 1 END) || ' earlier messages omitted...]' || {NL}, '') || string_agg(line, {NL} ORDER BY idx) FILTER (cum <= {room})"


@query("c27_full_blocks", f"WITH {ACT}, {HIST}, {LINES} SELECT hs AS session_id, {shown('3000')} AS text FROM ln GROUP BY 1 HAVING count(*) FILTER (cum <= 3000) > 0")
def full_blocks(spark, sf):
    """The last messages of histories with calls and answers that fit into 3000 code points."""
    return A.message_lines(histories(spark, sf, X.ANSWER + 1)).select("session_id", X.last_lines(F.col("lines"), F.lit(3000)).alias("text")).filter("text is not null")


def budget_sql(source: str, limit: int, whole: bool = False) -> str:
    """CTEs up to inj (query_id, block_id, place, cost, level): three places in turn, each with what those before have left. source: query_id, block_id, place, p, summary_text, and with whole hs and raw."""
    out = [f"pc AS (SELECT *, {COST(2000)} AS c0, {COST(1000)} AS c1, {COST(500)} AS c2 FROM {source})"]
    for i in (1, 2, 3):
        past = " UNION ALL ".join(f"SELECT query_id, cost, whole FROM e{j}" for j in range(1, i)) or "SELECT NULL::BIGINT AS query_id, 0 AS cost, false AS whole WHERE false"
        out.append(f"q{i} AS (SELECT pc.*, {limit} - coalesce(spent, 0) AS room, coalesce(was, false) AS was FROM pc LEFT JOIN (SELECT query_id, sum(coalesce(cost, 0)) AS spent, bool_or(whole) AS was FROM ({past}) GROUP BY 1) USING (query_id) WHERE place = {i})")
        body = f"SELECT query_id, {shown('(2 * (room - c0))')} AS body FROM q{i} JOIN ln USING (hs) WHERE NOT was AND NOT raw AND room > c0 GROUP BY 1" if whole else f"SELECT query_id, NULL::VARCHAR AS body FROM q{i}"
        cut = "CASE WHEN length(summary_text) <= 2000 THEN summary_text ELSE substr(summary_text, 1, 2000) || '…' END"
        out.append(f"w{i} AS (SELECT q.*, strlen(p || {cut} || {NL} || {NL} || '--- Full messages ---' || {NL} || body) // 4 AS all_ FROM q{i} q LEFT JOIN ({body}) USING (query_id))")
        out.append(f"e{i} AS (SELECT query_id, block_id, place, coalesce(all_ <= room, false) AS whole, CASE WHEN all_ <= room THEN all_ ELSE {TRY('room')} END AS cost, CASE WHEN all_ <= room THEN 0 ELSE {LEVEL('room')} END AS level FROM w{i})")
    out.append("inj AS (" + " UNION ALL ".join(f"SELECT query_id, block_id, place, cost, level FROM e{i} WHERE cost IS NOT NULL" for i in (1, 2, 3)) + ")")
    return ", ".join(out)


EXPANDABLE = f"""ch AS (SELECT query_id, block_id, place, summary_text, '[Retrieved archive #' || place || ']' || {NL} AS p, CASE WHEN block_id % 3 <> 0 THEN block_id % 97 END AS hs, {OWN} AND block_range_end < 60 AS raw FROM und JOIN archive USING (block_id))"""


@query("h9_full", f"WITH {FOUND}, {RANKING}, {UNDOMINATED}, {ACT}, {HIST}, {LINES}, {EXPANDABLE}, {budget_sql('ch', 2500, True)} SELECT query_id, block_id, place, cost, level FROM inj")
def full_expansion(spark, sf):
    """Injection within a budget where the first block that can brings its last messages along (level 0); a third of blocks have none, and those of the own session may still be there."""
    blocks = archives(spark, sf).select("block_id", "session_id", "block_range_end", "summary_text", F.when(F.col("block_id") % 3 != 0, F.col("block_id") % 97).alias("hs"))
    c = kept(own(undominated(spark, sf, candidates(spark, sf)).join(blocks, "block_id")))
    # Only of the histories that a chosen block comes from lines are made.
    asked = c.select(F.col("hs").alias("session_id")).distinct()
    lines = A.message_lines(histories(spark, sf, X.ANSWER + 1).join(asked, "session_id", "left_semi")).select(F.col("session_id").alias("hs"), "lines")
    c = c.join(lines, "hs", "left")
    c = c.withColumn("prefix", F.concat(F.lit("[Retrieved archive #"), F.col("place").cast("string"), F.lit("]\n"))).withColumn("raw_there", F.col("same_session") & (F.col("block_range_end") < 60))
    return S.budgeted(c.select("query_id", "place", "block_id", "prefix", "summary_text", "lines", "raw_there"), F.lit(2500)).drop("full")


def recall_inputs(spark, sf):
    """Conversations that hint at earlier ones or ask to recall them, and archives with the words of documents."""
    return hinted(spark, sf), kw_posts(spark, sf)[0], archives(spark, sf)


PROBED = f"""probe AS (SELECT DISTINCT query_id, term, phrase FROM (SELECT query_id, term, {FOLDED('term')} AS phrase FROM (SELECT session_id || ':' || place AS query_id, unnest(CASE WHEN query = 'src/alpha.py' THEN [query] ELSE terms END) AS term FROM sgt)) WHERE len(phrase) > 0),
held AS"""


def searched() -> str:
    """SQL of the search with the signals' terms in place of benchmark's words."""
    before, rest = KWS.split("probe AS (", 1)
    return before + PROBED + rest.split("held AS", 1)[1]


def recalled_sql() -> str:
    from threadloom.plans.archived import recall_terms_sql

    return f"""{MSG}, {HINTED}, sgt AS (SELECT *, {recall_terms_sql('query')} AS terms FROM sg), {searched()}, {ARCHIVE},
fb AS (SELECT query_id, a.*, count(DISTINCT keyword) AS matched, round(sum(rank), 9) AS rank FROM mt JOIN archive a ON a.block_id = mt.block_id WHERE isolated = 0 GROUP BY ALL),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, rank, created_at DESC, block_id) AS k FROM fb) WHERE k = 1),
cd0 AS (SELECT *, row_number() OVER (PARTITION BY asker, block_id ORDER BY signal) AS nth FROM (SELECT tp.* EXCLUDE (k), split_part(query_id, ':', 1)::BIGINT AS asker, split_part(query_id, ':', 2)::BIGINT AS signal FROM tp)),
cd1 AS (SELECT cd0.*, sg.kind FROM cd0 JOIN sg ON sg.session_id = asker AND sg.place = signal WHERE nth = 1),
ranked AS (SELECT * EXCLUDE (query_id), asker AS query_id, row_number() OVER (PARTITION BY asker ORDER BY matched DESC, rank, created_at DESC, block_range_end - block_range_start DESC, block_id) AS k FROM cd1 WHERE matched >= 3),
{UNDOMINATED}, ch AS (SELECT query_id, block_id, place, summary_text, '[Retrieved archive #' || place || ' — source=' || session_id || ', range=' || block_range_start || '-' || block_range_end || ', ~' || estimated_tokens || ' tokens]' || {NL} || {NL} AS p FROM und JOIN archive USING (block_id) WHERE summary_text <> ''), {budget_sql('ch', 700)}"""


@query("h11_recall", f"WITH {recalled_sql()} SELECT i.query_id AS session_id, i.block_id, i.place, kind, cost, level FROM inj i JOIN cd1 ON cd1.asker = i.query_id AND cd1.block_id = i.block_id")
def recall(spark, sf):
    """What every conversation recalls from the archives within its budget: signals, search, threshold, order, dominance, budget."""
    m, posts, blocks = recall_inputs(spark, sf)
    return S.recalled(m, posts, blocks, 700).select("session_id", "block_id", "place", "kind", "cost", "level")


@query("f15_outcomes", f"""WITH {recalled_sql()}, o AS (SELECT session_id, (SELECT count(*) FROM cd1 WHERE asker = s.session_id) AS candidates, (SELECT count(*) FROM ch WHERE query_id = s.session_id) AS selected, (SELECT count(*) FROM inj WHERE query_id = s.session_id) AS injected, (SELECT coalesce(sum(cost), 0)::BIGINT FROM inj WHERE query_id = s.session_id) AS cost FROM (SELECT DISTINCT session_id FROM sg) s)
SELECT *, selected - injected AS discarded, 700 AS budget_limit, 700 - cost AS remaining FROM o""")
def outcomes(spark, sf):
    """The figures of each conversation's recall."""
    return S.recall_outcomes(*recall_inputs(spark, sf), 700)
