"""Queries of whole histories with calls and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import blocks as B
from threadloom.plans.archived import NL, SECTION
from threadloom.plans.ordered import CUT
from threadloom.plans.registry import query
from threadloom.plans.texts import EAGER, EVENT, STUB
from threadloom.plans.views import ACT, KW_SQL, answer_texts, histories, list_sql, words_sql

THRESHOLD, FLOOR = 50_000, 17_000
HIST = """he AS (SELECT ev.*, count(*) OVER (PARTITION BY session_id) AS n_ev, event_id % (SELECT count(*) FROM benchmark) AS item_id, event_id % (SELECT count(*) FROM documents) AS doc_id, CASE WHEN event_id % 4 = 0 THEN (event_id * 7) % (SELECT count(*) FROM documents) END AS thought_id FROM ev),
hj AS (SELECT he.*, b.text AS item, d.text AS doc, t.text AS thought FROM he JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) LEFT JOIN documents t ON t.doc_id = thought_id),
h0 AS (SELECT session_id, event_id, r, n_ev, 0 AS off, 0 AS pos, 'user' AS role, 'text' AS type, item || CASE WHEN event_id % 4 = 1 THEN ' TODO: k' || k ELSE '' END AS text, NULL::VARCHAR AS thinking, false AS signed, NULL::VARCHAR AS content, false AS is_error FROM hj
UNION ALL SELECT session_id, event_id, r, n_ev, 1, 0, 'assistant', 'thinking', NULL, thought, event_id % 8 = 0, NULL, false FROM hj WHERE thought IS NOT NULL
UNION ALL SELECT session_id, event_id, r, n_ev, 1, 1, 'assistant', 'text', 'Next ' || event_type || ' of k' || k || '.', NULL, false, NULL, false FROM hj
UNION ALL SELECT session_id, event_id, r, n_ev, 1, 2, 'assistant', 'tool_use', NULL, NULL, false, NULL, false FROM hj WHERE event_id % 13 <> 0
UNION ALL SELECT session_id, event_id, r, n_ev, 2, 0, 'user', 'tool_result', NULL, NULL, false, doc, event_type = 'error' FROM hj),
calls AS (SELECT *, CASE WHEN file_path IS NOT NULL THEN 16 + strlen(file_path) WHEN pattern IS NOT NULL THEN 24 + strlen(pattern) + strlen(path) ELSE 14 + strlen(command) + 2 * length(command) - length(replace(command, '"', '')) - length(replace(command, chr(10), '')) END AS input_size FROM uses),
hist AS (SELECT h0.*, 3 * r + off AS idx, name, file_path, pattern, path, command, input_size FROM h0 LEFT JOIN (SELECT event_id, name, file_path, pattern, path, command, input_size FROM calls) USING (event_id) WHERE NOT (session_id % 3 = 0 AND r = n_ev - 1 AND off > 0))"""
OWN = "CASE type WHEN 'text' THEN strlen(text) // 4 WHEN 'thinking' THEN strlen(thinking) // 4 WHEN 'tool_use' THEN strlen(name) // 4 + input_size // 4 ELSE strlen(content) // 4 END"
ROW = f"sum({OWN})::BIGINT + 4 + strlen(any_value(role)) // 4"


def pair(rows: str, n: str) -> str:
    """SQL: (session_id) of histories that end with a call and its answer."""
    return f"(SELECT a.session_id FROM {rows} a JOIN {n} USING (session_id) JOIN {rows} u ON u.session_id = a.session_id AND u.event_id = a.event_id WHERE a.type = 'tool_result' AND a.idx = n - 1 AND u.type = 'tool_use' AND u.idx = n - 2)"


HINT = "coalesce(' → deep_search(''' || replace(kw, ''')', ' )') || ''')', '')"
KW = f"CASE WHEN event_id % 13 <> 0 THEN {KW_SQL} END"
SMALL = f"""r0 AS (SELECT session_id, idx, {ROW} AS tok FROM hist GROUP BY 1, 2),
z0 AS (SELECT session_id, max(idx) + 1 AS n, sum(tok) > {THRESHOLD} AS over FROM r0 GROUP BY 1),
a0 AS (SELECT session_id FROM {pair('hist', 'z0')}),
old AS (SELECT h.*, n, over, {KW} AS kw, over AND idx >= 1 AND idx < greatest(n - 8, 1) AND NOT (a0.session_id IS NOT NULL AND idx >= n - 2) AS old FROM hist h JOIN z0 USING (session_id) LEFT JOIN a0 USING (session_id)),
cp AS (SELECT * REPLACE (CASE WHEN old AND type = 'tool_result' AND strlen(content) // 4 > 500 THEN '[context compressed: ' || CASE WHEN event_id % 13 <> 0 THEN name ELSE 'tool' END || ', ' || len(string_split(content, {NL})) || ' lines]' || {HINT} ELSE content END AS content,
  CASE WHEN old AND type = 'thinking' AND strlen(thinking) // 4 > 500 THEN '[context compressed: thinking block]' ELSE thinking END AS thinking) FROM old WHERE NOT (old AND signed AND strlen(thinking) // 4 > 500)),
rows AS (SELECT session_id, idx, any_value(role) AS role, {ROW} AS tok, bool_or(type = 'tool_use') AS has_use, bool_or(type = 'tool_result') AS has_result, bool_or(a0.session_id IS NOT NULL AND idx >= n - 2) AS active FROM cp LEFT JOIN a0 USING (session_id) GROUP BY 1, 2),
{CUT.format(floor=FLOOR, keep=8)},
ct AS (SELECT session_id, over, CASE WHEN over THEN cutoff ELSE -1 END AS cutoff, (SELECT sum(tok) FROM rows WHERE rows.session_id = o.session_id AND rows.idx >= 1 AND rows.idx < o.cutoff)::BIGINT AS archived, (SELECT sum(tok) FROM rows WHERE rows.session_id = o.session_id)::BIGINT AS remaining FROM o JOIN z0 USING (session_id))"""
SAID = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"
ARCHIVED = f"""su AS (WITH pu AS (SELECT * FROM hist JOIN ct USING (session_id) WHERE idx < cutoff AND type = 'tool_use'), pr AS (SELECT * FROM hist JOIN ct USING (session_id) WHERE idx < cutoff AND type = 'tool_result'),
{SECTION.replace('FROM uses', 'FROM pu').replace('FROM results', 'FROM pr')},
e AS (SELECT session_id, idx, pos, false AS said, {EVENT} AS event FROM pu WHERE name NOT IN ('Grep', 'Read') UNION ALL SELECT session_id, idx, pos, true, '- [' || idx || '] U: ' || CASE WHEN length({SAID}) <= 120 THEN {SAID} ELSE substr({SAID}, 1, 120) || '…' END FROM hist JOIN ct USING (session_id) WHERE idx < cutoff AND role = 'user' AND type = 'text' AND {SAID} <> '' AND {SAID} NOT LIKE '[%'),
k AS (SELECT *, CASE WHEN said OR event LIKE '%] git commit' OR event LIKE '%] Bash: %' THEN '' WHEN event LIKE '%] Edit: %' OR event LIKE '%] Write: %' THEN lower(split_part(split_part(event, '] ', 2), ': ', 1)) || ':' || split_part(event, ': ', 2) ELSE lower(split_part(event, '] ', 2)) END AS key FROM e),
s AS (SELECT *, CASE WHEN key = '' OR key IS DISTINCT FROM lag(key) OVER w THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY session_id ORDER BY idx, pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY idx, pos) AS run FROM s),
m AS (SELECT *, count(*) OVER (PARTITION BY session_id, run) AS m, row_number() OVER (PARTITION BY session_id, run ORDER BY idx, pos) AS f FROM g),
tl AS (SELECT session_id, list((CASE WHEN m > 2 THEN event || ' (' || m || 'x)' ELSE event END) || {NL} ORDER BY idx, pos) AS l FROM m WHERE m <= 2 OR f = 1 GROUP BY 1),
cn AS (SELECT session_id, max_by(text, idx) AS said FROM hist JOIN ct USING (session_id) WHERE idx < cutoff AND role = 'assistant' AND type = 'text' GROUP BY 1),
sp AS (SELECT session_id, cutoff, sum(tok)::BIGINT AS tokens FROM r0 JOIN ct USING (session_id) WHERE idx < cutoff GROUP BY 1, 2)
SELECT session_id, 'Archived messages 0–' || (cutoff - 1) || '（共 ' || cutoff || ' 条，约 ' || tokens || ' tokens）' || coalesce({NL} || {NL} || '### Tools Used' || {NL} || tools || {NL}, '') || coalesce({NL} || '### Files' || {NL} || files, '') || coalesce({NL} || '### Commits' || {NL} || commits, '')
|| CASE WHEN l IS NULL THEN '' WHEN len(l) > 120 THEN {NL} || '### Timeline' || {NL} || array_to_string(l[1:20], '') || '  [...' || (len(l) - 120) || ' events omitted...]' || {NL} || array_to_string(l[-100:], '') ELSE {NL} || '### Timeline' || {NL} || array_to_string(l, '') END
|| CASE WHEN errors > 0 THEN {NL} || '### Gotchas' || {NL} || repeat('- [tool error]' || {NL}, errors) ELSE '' END || coalesce({NL} || '### Conclusion' || {NL} || said || {NL}, '') AS text
FROM sp LEFT JOIN t USING (session_id) LEFT JOIN fl USING (session_id) LEFT JOIN cm USING (session_id) LEFT JOIN tl USING (session_id) LEFT JOIN er USING (session_id) LEFT JOIN cn USING (session_id)),
fd AS (SELECT session_id, event_id, CASE WHEN cutoff > 0 THEN idx - cutoff + 2 ELSE idx END AS idx, pos, role, type, text, thinking, content, name, file_path, pattern, path, command, input_size FROM cp JOIN ct USING (session_id) WHERE cutoff < 0 OR idx >= cutoff
UNION ALL SELECT session_id, -1, 0, 0, 'user', 'text', '[Earlier conversation archived — ' || (cutoff - 1) || ' messages, ~' || archived || ' tokens. Operations: file reads, edits, tool calls, commits. Use reexpand to retrieve specific details.]', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ct WHERE cutoff > 0
UNION ALL SELECT session_id, -1, 1, 0, 'user', 'text', text, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM su)"""
STUBBED = f"""z1 AS (SELECT session_id, max(idx) + 1 AS n FROM fd GROUP BY 1), a1 AS (SELECT session_id FROM {pair('fd', 'z1')}),
lu AS (SELECT session_id, coalesce(max_by(said, idx), '') AS latest FROM (SELECT session_id, idx, coalesce(string_agg(text, ' ') FILTER (type = 'text'), '') AS said FROM fd WHERE role = 'user' GROUP BY 1, 2) GROUP BY 1),
rw AS (SELECT session_id, idx, any_value(role) AS role, {ROW} AS tok, bool_or(type = 'tool_use') AS has_use, bool_or(type = 'tool_result') AS has_result, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (type = 'text'), '') AS said FROM fd GROUP BY 1, 2),
gd AS (SELECT rw.*, n, over AND cutoff < 0 AS stubs, remaining, a1.session_id IS NOT NULL AND idx >= n - 2 AS active, idx >= greatest(n - 8, 1) OR len(list_filter({list_sql(X.TASK_MARKERS)}, lambda w: contains(said, w))) > 0 OR (latest <> '' AND len(list_intersect(list_distinct({words_sql('said')}), list_distinct({words_sql('latest')}))) >= 3) AS guarded
  FROM rw JOIN z1 USING (session_id) JOIN ct USING (session_id) JOIN lu USING (session_id) LEFT JOIN a1 USING (session_id)),
op AS (SELECT *, stubs AND NOT (idx = 0 OR active OR (tok <= 80 AND NOT has_use AND NOT has_result)) AS open FROM gd),
sr AS (SELECT *, open AND NOT guarded AS sure, open AND guarded AND has_result AS maybe FROM op),
ls AS (SELECT *, coalesce(max(CASE WHEN sure THEN idx END) OVER w, -1) AS since FROM sr WINDOW w AS (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cd AS (SELECT ls.*, coalesce(p.has_use, false) AS used, min(CASE WHEN ls.maybe THEN ls.has_use::INT END) OVER (PARTITION BY ls.session_id, ls.since ORDER BY ls.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chain FROM ls LEFT JOIN sr p ON p.session_id = ls.session_id AND p.idx = ls.since),
st AS (SELECT session_id, idx, n, role, open, active, stubs, remaining, sure OR (maybe AND used AND coalesce(chain, 1) = 1) AS stub FROM cd),
am AS (SELECT *, CASE WHEN NOT stubs OR age IS NULL OR age < s1 + boost THEN 0 WHEN age < s2 + boost THEN 1 WHEN age < s3 + boost THEN 2 ELSE 3 END AS stage FROM (SELECT *, floor(CASE WHEN n < 500 THEN 5 WHEN n < 2000 THEN 5 ELSE 4 END * stretch) AS s1, floor(CASE WHEN n < 500 THEN 15 WHEN n < 2000 THEN 12 ELSE 10 END * stretch) AS s2, floor(CASE WHEN n < 500 THEN 50 WHEN n < 2000 THEN 40 ELSE 30 END * stretch) AS s3 FROM
  (SELECT st.*, m.age, floor(m.heat * 20) + CASE WHEN m.pinned THEN 30 ELSE 0 END AS boost, CASE WHEN remaining / {THRESHOLD}.0::DOUBLE < 2.5 THEN greatest(least(1 + (2.5 - remaining / {THRESHOLD}.0::DOUBLE) / 0.75, 4.0::DOUBLE), 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS stretch FROM st
  LEFT JOIN (SELECT DISTINCT session_id, idx, 300 - CASE WHEN idx * 2 < n_ev * 3 THEN CASE WHEN idx % 67 = 0 THEN 280 ELSE 10 END WHEN idx * 4 < n_ev * 9 THEN 240 END AS age, (idx % 5) / 5.0::DOUBLE AS heat, idx % 31 = 0 AS pinned FROM hist) m ON m.session_id = st.session_id AND m.idx = st.idx))),
sb AS (SELECT fd.* REPLACE (CASE WHEN stub AND type IN ('tool_use', 'tool_result') THEN 'text' ELSE type END AS type, CASE WHEN stub AND type = 'tool_use' THEN {STUB} WHEN stub AND type = 'tool_result' THEN '[tool result archived]' || {HINT} WHEN stub AND type = 'text' AND fd.role = 'user' AND length(text) > 800 THEN substr(text, 1, 500) || '…' WHEN stub AND type = 'text' AND fd.role = 'assistant' AND length(text) > 400 THEN substr(text, 1, 300) || '…' ELSE text END AS text,
  CASE WHEN NOT stub THEN content END AS content), type = 'tool_use' AS was_call, stage, active, n, kw FROM (SELECT *, {KW} AS kw FROM fd) fd JOIN am USING (session_id, idx) WHERE NOT (open AND type = 'thinking')),
dy AS (SELECT * REPLACE (CASE WHEN type <> 'text' OR active OR stage = 0 THEN text WHEN stage = 3 THEN '' WHEN length(text) > (CASE role WHEN 'user' THEN CASE stage WHEN 1 THEN 200 ELSE 80 END ELSE CASE stage WHEN 1 THEN 120 ELSE 50 END END) THEN substr(text, 1, CASE role WHEN 'user' THEN CASE stage WHEN 1 THEN 200 ELSE 80 END ELSE CASE stage WHEN 1 THEN 120 ELSE 50 END END) || '...' ELSE text END AS text) FROM sb)"""
MENDED = f"""ik AS (SELECT session_id, idx, role, idx - row_number() OVER (PARTITION BY session_id ORDER BY idx) AS s FROM am WHERE stage = 3 AND idx >= 1 AND idx <= n - 5),
rn AS (SELECT session_id, min(idx) AS a, max(idx) AS b FROM ik GROUP BY session_id, s HAVING count(*) >= 50),
rr AS (SELECT rn.*, l.role AS lr, r.role AS rr FROM rn LEFT JOIN am l ON l.session_id = rn.session_id AND l.idx = a - 1 LEFT JOIN am r ON r.session_id = rn.session_id AND r.idx = b + 1),
pc AS (SELECT session_id, a, b, CASE lr WHEN 'user' THEN 'assistant' ELSE 'user' END AS role FROM rr WHERE lr = rr OR rr IS NULL UNION ALL SELECT session_id, a, a + (b - a) // 2, CASE lr WHEN 'user' THEN 'assistant' ELSE 'user' END FROM rr WHERE lr <> rr
  UNION ALL SELECT session_id, a + (b - a) // 2 + 1, b, CASE rr WHEN 'user' THEN 'assistant' ELSE 'user' END FROM rr WHERE lr <> rr),
tc AS (SELECT session_id, a, what, key, count(*) AS c FROM (SELECT pc.session_id, a, 'Tools' AS what, name AS key FROM pc JOIN dy ON dy.session_id = pc.session_id AND dy.idx BETWEEN a AND b WHERE was_call UNION ALL SELECT pc.session_id, a, 'Files', regexp_extract(coalesce(file_path, path), '[^/]*$') FROM pc JOIN dy ON dy.session_id = pc.session_id AND dy.idx BETWEEN a AND b WHERE was_call AND coalesce(file_path, path) IS NOT NULL) GROUP BY ALL),
tk AS (SELECT *, row_number() OVER (PARTITION BY session_id, a, what ORDER BY c DESC, key) AS i, count(*) OVER (PARTITION BY session_id, a, what) AS m FROM tc),
tx AS (SELECT session_id, a, {NL} || what || ': ' || string_agg(key || '(' || c || ')', ', ' ORDER BY i) FILTER (i <= 5) || CASE WHEN any_value(m) > 5 THEN ', +' || (any_value(m) - 5) || ' more' ELSE '' END AS line, what FROM tk GROUP BY session_id, a, what),
co AS (SELECT session_id, event_id, idx, pos, role, type, text, thinking, content, name, file_path, pattern, path, command FROM dy WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.session_id = dy.session_id AND dy.idx BETWEEN a AND b)
  UNION ALL SELECT pc.session_id, -1, a, 0, role, 'text', '[Compacted: Messages ' || a || '-' || b || ' (' || (b - a + 1) || ' msgs)]' || coalesce((SELECT string_agg(line, '' ORDER BY what) FROM tx WHERE tx.session_id = pc.session_id AND tx.a = pc.a), ''), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pc),
dn AS (SELECT * REPLACE (dense_rank() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS idx) FROM co),
z2 AS (SELECT session_id, max(idx) + 1 AS n, max(CASE WHEN role = 'assistant' THEN idx END) AS la FROM dn GROUP BY 1), a2 AS (SELECT session_id FROM {pair('dn', 'z2')}),
eg AS (SELECT dn.* REPLACE (CASE WHEN dn.type = 'tool_result' AND la > dn.idx AND NOT (a2.session_id IS NOT NULL AND dn.idx >= z2.n - 2) AND strlen(dn.content) // 4 > 500 THEN (SELECT {EAGER.replace("'[' || name ||", "'[' || coalesce(name, '') ||")} FROM (SELECT u.name, u.file_path, u.pattern, u.path, u.command, dn.content AS content, string_split(dn.content, {NL}) AS l, len(string_split(dn.content, {NL})) AS n)) ELSE dn.content END AS content), c.event_id IS NOT NULL AS met
  FROM dn JOIN z2 USING (session_id) LEFT JOIN a2 USING (session_id) LEFT JOIN (SELECT * FROM dn WHERE type = 'tool_use') u ON dn.type = 'tool_result' AND u.session_id = dn.session_id AND u.event_id = dn.event_id AND u.idx = dn.idx - 1 LEFT JOIN (SELECT session_id, event_id FROM dn WHERE type = 'tool_use') c ON c.session_id = dn.session_id AND c.event_id = dn.event_id),
ok AS (SELECT *, bool_or(type = 'tool_result' AND NOT met) OVER (PARTITION BY session_id) AS lacks FROM eg),
ro AS (SELECT session_id, idx, any_value(role) AS role FROM ok WHERE NOT (type = 'tool_result' AND NOT met) GROUP BY 1, 2),
rt AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS new, row_number() OVER w - 1 AS place FROM ro WINDOW w AS (PARTITION BY session_id ORDER BY idx)),
ru AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY idx) - 1 AS run FROM rt),
fin AS (SELECT ok.*, CASE WHEN lacks THEN run ELSE place END::BIGINT AS at_row FROM ok JOIN ru USING (session_id, idx) WHERE NOT (ok.type = 'tool_result' AND NOT met))"""


@query("e2e_blocks", f"""WITH {ACT}, {HIST}, {SMALL}, {ARCHIVED}, {STUBBED}, {MENDED}
SELECT session_id, at_row AS idx, (row_number() OVER (PARTITION BY session_id, at_row ORDER BY idx, pos) - 1)::INT AS pos, role, type, coalesce(content, text, thinking) AS body, CASE WHEN type = 'tool_use' THEN name END AS name FROM fin""")
def blocks_forwarded(spark, sf):
    """Every history of calls and answers as it would go on: compressed, folded or stubbed, aged, compacted, mended."""
    out = B.forwarded_blocks(histories(spark, sf, facts=B.text_facts), THRESHOLD, FLOOR, texts=answer_texts(spark, sf))
    return out.select("session_id", "idx", "pos", "role", "type", F.coalesce("content", "text", "thinking").alias("body"), "name")
