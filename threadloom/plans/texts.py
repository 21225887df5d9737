"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import archive as A
from threadloom.operators import history as H
from threadloom.plans.registry import query
from threadloom.plans.views import ACT, KW_SQL, MSG, answer_texts, drop_uses, list_sql, messages, table, tool_answers, tool_results, tool_uses, truncate_sql, words_sql
from threadloom.sources.tables import kept


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


NL = "chr(10)"


@query("c1_truncate", f"SELECT doc_id, {truncate_sql('t', 120)} AS cut FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '```' || text ELSE text END AS t FROM documents)")
def truncate(spark, sf):
    return docs(spark, sf).select("doc_id", X.truncate(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("```"), F.col("text"))).otherwise(F.col("text")), 120).alias("cut"))


@query("c2_role_truncate", f"WITH {MSG} SELECT session_id, idx, CASE WHEN role = 'user' AND length(text) > 800 THEN {truncate_sql('text', 500)} WHEN role = 'assistant' AND length(text) > 400 THEN {truncate_sql('text', 300)} ELSE text END AS text FROM msg")
def role_truncate(spark, sf):
    return messages(spark, sf).select("session_id", "idx", X.truncate_by_role(F.col("text"), F.col("role")).alias("text"))


@query("c3_truncate_middle", "SELECT doc_id, CASE WHEN length(text) <= 350 THEN text ELSE substr(text, 1, 200) || '[...' || (length(text) - 300) || ' chars compressed...]' || right(text, 100) END AS cut FROM documents")
def truncate_middle(spark, sf):
    return docs(spark, sf).select("doc_id", X.truncate_middle(F.col("text"), 200, 100).alias("cut"))


@query("c4_truncate_lines", f"SELECT doc_id, CASE WHEN len(l) <= 30 THEN text ELSE array_to_string(l[1:15], {NL}) || {NL} || '[...' || (len(l) - 25) || ' lines compressed...]' || {NL} || array_to_string(l[-10:], {NL}) END AS cut FROM (SELECT doc_id, text, string_split(text, {NL}) AS l FROM documents)")
def truncate_lines(spark, sf):
    return docs(spark, sf).select("doc_id", X.truncate_lines(F.col("text")).alias("cut"))


@query("c5_words", f"SELECT doc_id, array_to_string({words_sql('text')}, ' ') AS words FROM documents")
def words(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(X.words(F.col("text")), " ").alias("words"))


@query("c6_content_words", f"SELECT DISTINCT doc_id, w AS word FROM (SELECT doc_id, unnest({words_sql('text')}) AS w FROM documents) WHERE NOT list_contains({list_sql(X.STOP_WORDS)}, w)")
def content_words(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(X.content_words(F.col("text"))).alias("word"))


SENTENCES = "list_filter(list_transform(regexp_extract_all(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '([^.!?。！？]*[.!?。！？]|[^.!?。！？]+$)'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


@query("c7_sentences", f"SELECT doc_id, len(s) AS n, array_to_string(s, '|') AS s FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def sentences(spark, sf):
    s = X.sentences(X.trim(F.col("text")))
    return docs(spark, sf).select("doc_id", F.size(s).cast("bigint").alias("n"), F.array_join(s, "|").alias("s"))


@query("c8_conclusion", f"SELECT doc_id, CASE WHEN len(s) = 0 THEN '' ELSE {truncate_sql('c', 300)} END AS said FROM (SELECT doc_id, s, array_to_string(s[-2:], ' ') AS c FROM (SELECT doc_id, {SENTENCES} AS s FROM documents))")
def conclusion(spark, sf):
    return docs(spark, sf).select("doc_id", X.conclusion(F.col("text")).alias("said"))


@query("c10_basepath", "SELECT page_id, CASE WHEN len(p) <= 2 THEN url ELSE p[-2] || '/' || p[-1] END AS base FROM (SELECT page_id, url, string_split(url, '/') AS p FROM pages)")
def basepath(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.base_path(F.col("url")).alias("base"))


@query("c12_arguments", f"WITH {ACT} SELECT id, CASE WHEN pattern IS NOT NULL THEN 'pattern=' || pattern WHEN command IS NOT NULL THEN 'command=' || {truncate_sql('command', 72)} ELSE '' END AS args, CASE WHEN file_path IS NOT NULL THEN 'file_path=' || file_path WHEN path IS NOT NULL THEN 'path=' || path ELSE '' END AS note FROM uses")
def arguments(spark, sf):
    return tool_uses(spark, sf).select("id", X.arguments(F.col("input")).alias("args"), X.annotation(F.col("input")).alias("note"))


@query("c13_tool_keywords", f"WITH {ACT} SELECT id, {KW_SQL} AS kw FROM uses")
def tool_keywords(spark, sf):
    return tool_uses(spark, sf).select("id", X.tool_keywords(F.col("name"), F.col("input")).alias("kw"))


@query("c14_fallback_keywords", f"WITH {ACT} SELECT id, 'Other' || CASE WHEN file_path IS NOT NULL THEN ' ' || file_path WHEN command IS NOT NULL THEN CASE WHEN strlen(command) BETWEEN 3 AND 50 THEN ' ' || command ELSE '' END ELSE ' ' || path || CASE WHEN strlen(pattern) >= 3 THEN ' ' || pattern ELSE '' END END AS kw FROM uses")
def fallback_keywords(spark, sf):
    return tool_uses(spark, sf).select("id", X.fallback_keywords(F.lit("Other"), F.col("input")).alias("kw"))


STUB = f"""'[→] ' || CASE name WHEN 'Read' THEN 'Read ' || file_path WHEN 'Grep' THEN 'Grep ''' || pattern || ''' in ' || path WHEN 'Bash' THEN 'Bash: ' || command ELSE name || ' ' || file_path || ' -- file on disk is current' END
|| ' → deep_search(''' || replace({KW_SQL}, ''')', ' )') || ''')'"""


@query("c16_tool_stub", f"WITH {ACT} SELECT id, {STUB} AS stub FROM uses")
def tool_stub(spark, sf):
    return tool_uses(spark, sf).select("id", X.tool_use_stub(F.col("name"), F.col("input")).alias("stub"))


@query("c17_result_stub", f"WITH {ACT}, kw AS (SELECT session_id, id, {KW_SQL} AS kw FROM uses WHERE event_id % 13 <> 0) SELECT r.tool_use_id, '[tool result archived]' || coalesce(' → deep_search(''' || replace(kw, ''')', ' )') || ''')', '') AS stub FROM results r LEFT JOIN kw ON kw.session_id = r.session_id AND kw.id = r.tool_use_id")
def result_stub(spark, sf):
    kw = drop_uses(tool_uses(spark, sf)).select("session_id", F.col("id").alias("tool_use_id"), X.tool_keywords(F.col("name"), F.col("input")).alias("kw"))
    return tool_results(spark, sf).join(kw, ["session_id", "tool_use_id"], "left").select("tool_use_id", X.result_stub(F.col("kw")).alias("stub"))


@query("c18_result_summary", f"WITH {ACT}, c AS (SELECT r.tool_use_id, u.name, {KW_SQL} AS kw, 'def Alpha' || {NL} || content AS t FROM results r JOIN uses u ON u.session_id = r.session_id AND u.id = r.tool_use_id) SELECT tool_use_id, '[context compressed: ' || name || ', ' || len(string_split(t, {NL})) || ' lines, key: def Alpha] → deep_search(''' || replace(kw, ''')', ' )') || ''')' AS summary FROM c")
def result_summary(spark, sf):
    u = tool_uses(spark, sf).select("session_id", F.col("id").alias("tool_use_id"), "name", "input")
    r = tool_results(spark, sf, facts=X.result_facts(F.concat(F.lit("def Alpha\n"), F.col("text"))))
    return r.join(u, ["session_id", "tool_use_id"]).select("tool_use_id", X.result_summary(F.col("name"), F.col("facts"), X.tool_keywords(F.col("name"), F.col("input"))).alias("summary"))


EAGER = f"""CASE name WHEN 'Read' THEN '[Read ' || file_path || ' — ' || n || ' lines]' WHEN 'Grep' THEN '[Grep ''' || pattern || ''' in ' || path || ' — ' || n || ' matches]'
WHEN 'Bash' THEN '[Bash: ' || command || ' — ' || n || ' lines]' || {NL} || CASE WHEN n <= 6 THEN content ELSE array_to_string(l[1:3], {NL}) || {NL} || '[...]' || {NL} || array_to_string(l[-3:], {NL}) END
ELSE '[' || name || ' result — ' || n || ' lines archived]' END"""


@query("c19_eager_stub", f"WITH {ACT}, c AS (SELECT r.tool_use_id, u.*, content, string_split(content, {NL}) AS l, len(string_split(content, {NL})) AS n FROM results r JOIN uses u ON u.session_id = r.session_id AND u.id = r.tool_use_id) SELECT tool_use_id, {EAGER} AS stub FROM c")
def eager_stub(spark, sf):
    u = tool_uses(spark, sf).select("session_id", F.col("id").alias("tool_use_id"), "name", "input")
    r = tool_answers(spark, sf).join(u, ["session_id", "tool_use_id"]).join(answer_texts(spark, sf), "text_id")
    return r.select("tool_use_id", X.eager_stub(F.col("name"), F.col("input"), F.col("content")).alias("stub"))


@query("c21_commits", f"WITH {ACT} SELECT id, 'fix k' || k AS message FROM uses JOIN ev USING (event_id) WHERE command LIKE 'git commit%'")
def commits(spark, sf):
    u = tool_uses(spark, sf).filter("name = 'Bash'").select("id", X.commit_message(F.element_at("input", "command")).alias("message"), F.element_at("input", "command").alias("c"))
    return u.filter(F.col("c").contains("git commit")).drop("c")


EVENT = f"""'- [' || idx || '] ' || CASE WHEN name IN ('Edit', 'Write') THEN name || ': ' || file_path WHEN command LIKE 'git commit%' THEN 'git commit' WHEN command LIKE 'make build%' THEN 'build' WHEN command LIKE 'go test%' THEN 'test' ELSE 'Bash: ' || replace(command, {NL}, ' ') END"""


@query("c22_timeline_label", f"WITH {ACT} SELECT id, {EVENT} AS event FROM uses WHERE name NOT IN ('Grep', 'Read')")
def timeline_label(spark, sf):
    return tool_uses(spark, sf).select("id", X.timeline_event(F.col("name"), F.col("input"), F.col("idx")).alias("event")).filter("event is not null")


@query("c24_top5_counts", "WITH c AS (SELECT source, w, count(*) AS n FROM (SELECT source, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS k, count(*) OVER (PARTITION BY source) AS m FROM c) SELECT source, string_agg(w || '(' || n || ')', ', ' ORDER BY k) || CASE WHEN max(m) > 5 THEN ', +' || (max(m) - 5) || ' more' ELSE '' END AS line FROM r WHERE k <= 5 GROUP BY 1")
def top5_counts(spark, sf):
    w = table(spark, sf, "documents").select("source", F.explode(F.split("text", " ", -1)).alias("key")).groupBy("source", "key").agg(F.count("*").alias("n"))
    return A.top_counts(w, "source")


@query("c28_hints", rf"SELECT doc_id, trim(h, ' ' || chr(9) || chr(10) || chr(13)) AS hint FROM (SELECT doc_id, unnest(regexp_extract_all(text || ' deep_search(''' || text || ''') and deep_search(''  Read src/k' || (doc_id % 9) || '.py '')', '(?s)deep_search\(''(.*?)''\)', 1)) AS h FROM documents) WHERE hint <> ''")
def hints(spark, sf):
    t = F.concat(F.col("text"), F.lit(" deep_search('"), F.col("text"), F.lit("') and deep_search('  Read src/k"), (F.col("doc_id") % 9).cast("string"), F.lit(".py ')"))
    return docs(spark, sf).select("doc_id", F.explode(X.hints(t)).alias("hint"))


@query("c29_paths", f"SELECT DISTINCT page_id, w AS path FROM (SELECT page_id, unnest(list_transform(regexp_split_to_array('see ' || url || ', src/a.py and /tmp/x; ' || html, '[ ' || chr(10) || chr(9) || ',;\"'']'), lambda w: trim(w, '.,;:!?()[]{{}}<>\"'))) AS w FROM pages) WHERE strlen(w) >= 3 AND (regexp_matches(w, '^.:[\\\\/]') OR w LIKE '/%' OR (w LIKE '%/%' AND w LIKE '%.%'))")
def paths(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.explode(X.paths(F.concat(F.lit("see "), F.col("url"), F.lit(", src/a.py and /tmp/x; "), F.col("html")))).alias("path"))


def lead():
    k = F.col("doc_id") % 6
    return (
        F.when(k == 0, " a <system-reminder> noise </system-reminder> b ").when(k == 1, "<system-reminder>SessionStart: This is just a gentle reminder</system-reminder>").when(k == 2, "<system-reminder>\n# claudeMd\nrules</system-reminder> tail")
        .when(k == 3, "x\n[skill-hint]use it[/skill-hint] y").when(k == 4, "<system-reminder>This is ambient context</system-reminder>z").otherwise("<system-reminder>unknown</system-reminder>")
    )


SPAN = "(?s)<system-reminder>.*?</system-reminder>"
BODY = r"regexp_extract(s, '(?s)^<system-reminder>\s*(.*?)\s*</system-reminder>$', 1)"
PERSISTENT = rf"regexp_matches({BODY}, '(?m)^\s*# ({'|'.join(X.CONTEXT_HEADINGS)})\s*$')"
TEMPORARY = f"(lower({BODY}) = 'noise' OR len(list_filter({list_sql(X.TEMPORARY_MARKERS)}, lambda k: contains(lower({BODY}), k))) > 0)"
#: The rule for any text: pieces between reminders, each followed by its reminder unless that goes. The lead of c31 stands before and after all of the text.
WITHOUT = lambda goes: f"array_to_string(list_transform(string_split_regex(t, '{SPAN}'), lambda p, i: p || coalesce(list_transform(spans, lambda s: CASE WHEN {goes} THEN '' ELSE s END)[i], '')), '')"
LEAD = """CASE doc_id % 6 WHEN 0 THEN ' a <system-reminder> noise </system-reminder> b ' WHEN 1 THEN '<system-reminder>SessionStart: This is just a gentle reminder</system-reminder>' WHEN 2 THEN '<system-reminder>
# claudeMd
rules</system-reminder> tail' WHEN 3 THEN 'x
[skill-hint]use it[/skill-hint] y' WHEN 4 THEN '<system-reminder>This is ambient context</system-reminder>z' ELSE '<system-reminder>unknown</system-reminder>' END"""
TAGGED = f"SELECT doc_id, t, regexp_extract_all(t, '{SPAN}') AS spans FROM (SELECT doc_id, lead || text || lead AS t FROM (SELECT doc_id, text, {LEAD} AS lead FROM documents))"


def tagged(spark, sf):
    return docs(spark, sf).select("doc_id", F.concat(lead(), F.col("text"), lead()).alias("t"))


@query("c31_strip_reminders", rf"SELECT doc_id, CASE WHEN c = t THEN t ELSE trim(c, ' ' || chr(9) || chr(10) || chr(13)) END AS clean FROM (SELECT doc_id, t, regexp_replace({WITHOUT(f"{TEMPORARY} AND NOT contains({BODY}, 'SessionStart:') AND NOT {PERSISTENT}")}, '(?s)\n?\[skill-hint\].*?\[/skill-hint\]', '', 'g') AS c FROM ({TAGGED}))")
def strip(spark, sf):
    return tagged(spark, sf).select("doc_id", X.strip_reminders(F.col("t")).alias("clean"))


@query("c32_detach_context", f"SELECT doc_id, {WITHOUT(PERSISTENT)} AS detached, len(list_filter(spans, lambda s: {PERSISTENT}))::BIGINT AS n FROM ({TAGGED})")
def detach(spark, sf):
    return tagged(spark, sf).select("doc_id", X.without_persistent(F.col("t")).alias("detached"), F.size(X.persistent_spans(F.col("t"))).cast("bigint").alias("n"))


@query("c33_decay_text", f"WITH {MSG} SELECT session_id, idx, CASE idx % 4 WHEN 0 THEN text WHEN 3 THEN '' ELSE CASE WHEN length(text) > lim THEN substr(text, 1, lim) || '...' ELSE text END END AS text FROM (SELECT *, CASE role WHEN 'user' THEN CASE idx % 4 WHEN 1 THEN 200 ELSE 80 END WHEN 'assistant' THEN CASE idx % 4 WHEN 1 THEN 120 ELSE 50 END END AS lim FROM msg)")
def decay(spark, sf):
    return messages(spark, sf).select("session_id", "idx", X.decayed(F.col("text"), F.col("idx") % 4, F.col("role")).alias("text"))


@query("c34_decay_stub", "SELECT item_id, stage, CASE stage WHEN 0 THEN '[→] T ' || item_id || ' — ' || text WHEN 1 THEN '[→] T ' || item_id || CASE WHEN array_to_string(string_split(text, ' ')[1:3], ' ') = '' THEN '' ELSE ' — ' || array_to_string(string_split(text, ' ')[1:3], ' ') END WHEN 2 THEN '[→] T ' || item_id ELSE '' END AS stub FROM benchmark, (SELECT unnest([0, 1, 2, 3]) AS stage)")
def decay_stub(spark, sf):
    """Stubs with benchmark's texts as notes, in each stage."""
    b = table(spark, sf, "benchmark").withColumn("stage", F.explode(F.array(*(F.lit(k) for k in range(4)))))
    return b.select("item_id", "stage", X.decayed_stub(F.concat(F.lit("[→] T "), F.col("item_id").cast("string"), F.lit(" — "), "text"), F.col("stage")).alias("stub"))


@query("c36_recall_terms", f"SELECT item_id, array_to_string(list_filter(list_distinct_in_order, lambda w: NOT list_contains({list_sql([*X.STOP_WORDS, *X.COMMON_RECALL_WORDS])}, w))[1:8], ' ') AS terms FROM (SELECT item_id, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS list_distinct_in_order FROM (SELECT item_id, {words_sql('text')} AS ws FROM benchmark))")
def recall_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.recall_terms(F.col("text")), " ").alias("terms"))


@query("c37_userinfo", "SELECT page_id, 'https://' || substr(url, strpos(url, '://') + 3) AS url FROM pages")
def userinfo(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.without_userinfo(F.concat(F.lit("https://me:pw@"), F.expr("substr(url, instr(url, '://') + 3)"))).alias("url"))


@query("c38_log_text", "SELECT doc_id, replace(replace(replace(text, chr(27), ''), chr(13), '\\r'), chr(10), '\\n') || ' [REDACTED]' AS line FROM documents")
def log_text(spark, sf):
    return docs(spark, sf).select("doc_id", X.log_safe(F.concat(F.col("text"), F.lit(" sess-9")), F.lit("sess-9")).alias("line"))


@query("b16_decisions", f"WITH {MSG}, m AS (SELECT *, lag(role) OVER w AS pr, lag(text) OVER w AS pt, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM msg WINDOW w AS (PARTITION BY session_id ORDER BY idx)) SELECT session_id, idx, role = 'user' AND s <> '' AND s NOT LIKE '%?' AND (length(s) < 30 OR coalesce(length(s) < 100 AND pr = 'assistant' AND length(trim(pt, ' ' || chr(9) || chr(10) || chr(13))) > 400, false) OR len(list_filter({list_sql(X.DECISION_MARKERS)}, lambda k: contains(lower(text), k))) > 0) AS decision FROM m")
def decisions(spark, sf):
    return messages(spark, sf).select("session_id", "idx", X.is_decision(F.col("role"), F.col("text"), F.lag("role").over(H.in_order()), F.lag("text").over(H.in_order())).alias("decision"))


@query("b17_tasklist", f"WITH {MSG} SELECT session_id, idx, idx % 3 = 1 OR contains(text, 'TODO:') OR contains(text, '- [x]') OR contains(text, '- [X]') OR contains(text, '- [ ]') AS tasks FROM msg")
def tasklist(spark, sf):
    t = F.when(F.col("idx") % 3 == 1, F.concat(F.col("text"), F.lit("\n- [ ] do"))).otherwise(F.col("text"))
    return messages(spark, sf).select("session_id", "idx", X.is_task_list(t).alias("tasks"))


@query("b18_pivot", f"WITH {MSG}, l AS (SELECT session_id, max_by(text, idx) AS latest FROM msg WHERE role = 'user' GROUP BY 1) SELECT m.session_id, idx, latest <> '' AND len(list_intersect(list_distinct({words_sql('text')}), list_distinct({words_sql('latest')}))) >= 3 AS pivot FROM msg m JOIN l USING (session_id)")
def pivot(spark, sf):
    m = messages(spark, sf)
    return m.join(H.latest_user_text(m), "session_id").select("session_id", "idx", X.is_pivot(F.col("text"), F.col("latest")).alias("pivot"))


@query("b20_latest_user", f"WITH {MSG} SELECT session_id, max_by(text, idx) AS latest FROM msg WHERE role = 'user' GROUP BY 1")
def latest_user(spark, sf):
    return H.latest_user_text(messages(spark, sf))


@query("c20_result_text", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text WHEN text = '' THEN 'two' ELSE text || {NL} || 'two' END AS text FROM documents")
def result_text(spark, sf):
    none = F.lit(None).cast("string")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    one = F.to_json(F.array("text"))
    nested = F.to_json(F.array(block("text", F.col("text")), block("image", none), block("text", F.lit("two"))))
    raw = F.when(F.col("doc_id") % 2 == 0, F.substr(one, F.lit(2), F.length(one) - 2)).otherwise(nested)
    return docs(spark, sf).select("doc_id", X.result_text(raw).alias("text"))


@query("c30_match_terms", "SELECT item_id, array_to_string(list_filter(string_split(text, ' '), lambda w: w <> '')[1:20], ' ') AS terms FROM benchmark")
def match_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.match_terms(F.split("text", " ", -1)), " ").alias("terms"))


@query("a16_log_lines", "SELECT event_id, 'WARN #' || event_id || ' said [REDACTED] kind=' || event_type AS line FROM events")
def log_lines(spark, sf):
    e = table(spark, sf, "events")
    attrs = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("api-key"), F.lit("k"), F.lit("my_session_id"), F.lit("s"), F.lit("body"), F.lit("b"))
    return e.select("event_id", X.log_line(F.lit("WARN"), F.col("event_id"), F.lit("said sess-1"), attrs, F.lit("sess-1")).alias("line"))


@query("b21_pinned_paths", f"WITH {ACT} SELECT session_id, string_agg(DISTINCT file_path, ',' ORDER BY file_path) AS paths FROM uses WHERE file_path IS NOT NULL GROUP BY 1")
def pinned_paths(spark, sf):
    u = tool_uses(spark, sf).withColumn("p", F.try_element_at("input", F.lit("file_path"))).filter("p is not null")
    return u.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("paths"))


@query("e4_overlap", f"WITH w AS (SELECT DISTINCT item_id, unnest({words_sql('text')}) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({words_sql('text')}) AS w FROM documents) SELECT item_id, doc_id, count(*) AS shared FROM w JOIN d USING (w) GROUP BY ALL HAVING count(*) >= 8")
def overlap(spark, sf):
    w = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("w"))
    d = docs(spark, sf).select("doc_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("w"))
    return shared_words(w, d, 8)


def shared_words(items, documents, least):
    """(item_id, doc_id, shared) of items (item_id, w) and documents (doc_id, w) that share at least so many words.

    A prefix filter: without its `least // 2` most frequent words an item still shares least - least // 2 with each
    such document. Only those words are joined; what the frequent ones add is looked up for the pairs that are left.
    Words that no item has go first, and the rest is written, so that texts are read and cut once.
    """
    set_aside = least // 2
    documents = kept(documents.join(items.select("w").distinct(), "w", "left_semi").select("doc_id", "w"))
    # So small a table would be few tasks, but pairs are many; dealt by document they are counted where they are made.
    documents = documents.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    often = documents.groupBy("w").agg(F.count("*").alias("n"))
    order = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc_nulls_last("n"), "w"))
    ranked = items.join(often, "w", "left").withColumn("k", order)
    met = ranked.filter(F.col("k") > set_aside).select("item_id", "w").join(documents, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("rare")).filter(F.col("rare") >= least - set_aside)
    more = met.join(ranked.filter(F.col("k") <= set_aside).select("item_id", "w"), "item_id", "left").join(documents.withColumn("there", F.lit(1)), ["doc_id", "w"], "left")
    return more.groupBy("item_id", "doc_id").agg((F.first("rare") + F.count("there")).alias("shared")).filter(F.col("shared") >= least)
