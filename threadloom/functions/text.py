"""Text of messages: cutting, words, hints, stubs and summaries, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r"
FENCE = "```"
# What words are trimmed of, and the words that never count.
WORD_EDGES = ".,;:!?\"'()[]{}…—"
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall",
    "should", "may", "might", "must", "can", "could", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your",
    "his", "its", "our", "their", "this", "that", "these", "those", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into",
    "through", "during", "before", "after", "above", "below", "between", "and", "but", "or", "nor", "not", "so", "yet", "both", "either", "neither",
    "each", "every", "all", "any", "few", "more", "most", "other", "some", "such", "no", "only", "own", "same", "than", "too", "very", "just",
    "because", "as", "until", "while", "if", "when", "where", "how", "what", "which", "who", "whom", "here", "there", "then", "now",
)
# Words that a recall is never looked up by, and phrases that ask for one.
COMMON_RECALL_WORDS = (
    "archive", "recall", "restore", "retrieve", "search", "earlier", "previous", "before", "request", "tool", "user", "assistant", "bash", "read", "write", "edit", "grep", "glob", "mcp", "agent",
    "恢复", "找回", "之前", "存档", "搜索",
)
RECALL_PHRASES = (
    "recall archive", "restore archive", "retrieve archive", "search archive", "recall earlier", "restore earlier", "find earlier", "from earlier",
    "恢复存档", "找回存档", "恢复之前", "找回之前", "搜索存档",
)
# Names of inputs that hold paths, signs of decisions, tasks and passing reminders, headings of lasting context, sections of an archive.
PATH_KEYS = ("file_path", "path", "filename", "file", "dir", "directory", "filePath")
FILE_KEYS = ("file_path", "path", "filename", "file", "filePath")
DECISION_MARKERS = ("nimm", "mach", "ja bitte", "nein", "bitte nicht", "so lassen", "lass uns", "entscheidung", "option", "variante", "ansatz", "take", "use", "go with", "let's do", "ja -", "ok -")
TASK_MARKERS = ("- [ ]", "- [x]", "TODO:", "- [X]")
TEMPORARY_MARKERS = ("your task tools haven't been used recently", "task tools haven't been used recently", "this is just a gentle reminder", "this is ambient context", "this may or may not be related")
CONTEXT_HEADINGS = ("claudeMd", "currentDate", "userEmail", "attachedProject")
SECTIONS = ("Tools Used", "Files", "Commits", "Timeline", "Gotchas", "Conclusion")


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def strings(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def occurrences(text: Column, part: str) -> Column:
    return F.size(F.split(text, F.lit("\\Q" + part + "\\E"), -1)) - 1


def truncate(text: Column, most: int | Column) -> Column:
    """At most so many code points and an ellipsis; a code fence that this leaves open is closed."""
    cut = F.concat(F.substring(text, 1, most), F.lit("…"))
    return F.when(F.length(text) <= most, text).otherwise(F.when(occurrences(cut, FENCE) % 2 == 1, F.concat(cut, F.lit("\n" + FENCE))).otherwise(cut))


def truncate_by_role(text: Column, role: Column) -> Column:
    return F.when((role == "user") & (F.length(text) > 800), truncate(text, 500)).when((role == "assistant") & (F.length(text) > 400), truncate(text, 300)).otherwise(text)


def truncate_middle(text: Column, head: int, tail: int) -> Column:
    n = F.length(text)
    return F.when(n <= head + tail + 50, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("[..."), (n - head - tail).cast("string"), F.lit(" chars compressed...]"), F.right(text, F.lit(tail))))


def truncate_lines(text: Column) -> Column:
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    return F.when(n <= 30, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, 15), "\n"), F.lit("\n[..."), (n - 25).cast("string"), F.lit(" lines compressed...]\n"), F.array_join(F.slice(lines, -10, 10), "\n")))


def words(text: Column) -> Column:
    """Lower-case words of three code points or more, trimmed of punctuation."""
    parts = F.transform(F.split(F.lower(text), r"\s+", -1), lambda w: F.btrim(w, F.lit(WORD_EDGES)))
    return F.filter(parts, lambda w: F.length(w) >= 3)


def content_words(text: Column) -> Column:
    return F.array_except(F.array_distinct(words(text)), strings(STOP_WORDS))


def recall_terms(text: Column) -> Column:
    """The first eight words that say what is looked for."""
    return F.slice(F.array_except(content_words(text), strings(COMMON_RECALL_WORDS)), 1, 8)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([^.!?。！？]*[.!?。！？]|[^.!?。！？]+$)"), F.lit(1)), trim), lambda s: s != "")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed one time however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def conclusion(text: Column) -> Column:
    """The last two sentences, at most 300 code points."""
    last = once(sentences(trim(text)), lambda s: F.when(F.size(s) > 0, trim(F.array_join(F.slice(s, -F.least(F.size(s), F.lit(2)), F.lit(2)), " "))))
    return once(last, lambda c: F.when(c.isNull(), "").otherwise(truncate(c, 300)))


def base_path(path: Column) -> Column:
    plain = F.translate(path, "\\", "/")
    return F.when(F.coalesce(path, F.lit("")) == "", "?").when(occurrences(plain, "/") <= 1, path).otherwise(F.substring_index(plain, "/", -2))


def filled(input_: Column, key: str) -> Column:
    return F.coalesce(F.nullif(F.try_element_at(input_, F.lit(key)), F.lit("")), F.lit(None).cast("string"))


def first_path(input_: Column) -> Column:
    return F.coalesce(*(filled(input_, k) for k in FILE_KEYS))


def all_paths(input_: Column) -> Column:
    return F.array_compact(F.array(*(filled(input_, k) for k in PATH_KEYS)))


def annotation(input_: Column) -> Column:
    parts = F.array_compact(F.array(*(F.concat(F.lit(k + "="), filled(input_, k)) for k in PATH_KEYS)))
    return truncate(F.array_join(parts, ", "), 100)


def arguments(input_: Column) -> Column:
    """Arguments that are no paths, by key, at most 80 code points."""
    rest = F.filter(F.array_sort(F.map_entries(input_)), lambda e: ~e["key"].isin(*PATH_KEYS))
    return truncate(F.coalesce(F.array_join(F.transform(rest, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "), F.lit("")), 80)


def hint_safe(text: Column) -> Column:
    return F.replace(text, F.lit("')"), F.lit(" )"))


def fallback_keywords(name: Column, input_: Column) -> Column:
    usable = F.filter(F.array_sort(F.map_entries(input_)), lambda e: ~e["key"].isin("thinking", "signature", "cache_control") & F.octet_length(e["value"]).between(3, 50))
    return F.array_join(F.concat(F.array(name), F.coalesce(F.transform(F.slice(usable, 1, 3), lambda e: e["value"]), F.array().cast("array<string>"))), " ")


def tool_keywords(name: Column, input_: Column) -> Column:
    """What a tool call can be found by."""
    at = lambda key: filled(input_, key)
    named = lambda value: F.concat_ws(" ", name, value)
    command = F.when(F.length(at("command")) > 40, F.concat(F.substring(at("command"), 1, 40), F.lit("..."))).otherwise(at("command"))
    return (
        F.when(name.isin("Read", "Edit", "Write"), named(at("file_path")))
        .when(name == "Bash", named(command))
        .when(name == "Grep", F.when(at("pattern").isNotNull(), F.concat_ws(" ", name, at("pattern"), at("path"))).otherwise(name))
        .when(name == "Glob", named(at("pattern")))
        .when(name == "Agent", named(truncate(at("description"), 60)))
        .when(name == "WebSearch", F.coalesce(truncate(at("query"), 60), name))
        .when(name == "WebFetch", F.coalesce(truncate(at("url"), 60), name))
        .when(name == "Skill", named(truncate(at("skill"), 60)))
        .otherwise(fallback_keywords(name, input_))
    )


def with_hint(text: Column, keywords: Column) -> Column:
    return F.when(F.coalesce(keywords, F.lit("")) == "", text).otherwise(F.concat(text, F.lit(" → deep_search('"), hint_safe(keywords), F.lit("')")))


def tool_use_stub(name: Column, input_: Column) -> Column:
    """One line in place of a tool call, with a hint by which it can be found again."""
    at = lambda key: F.coalesce(F.try_element_at(input_, F.lit(key)), F.lit(""))
    say = lambda *parts: F.concat(F.lit("[→] "), *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    note = annotation(input_)
    line = (
        F.when(name == "Read", say("Read ", at("file_path")))
        .when(name == "Edit", say("Edit ", at("file_path"), " -- file on disk is current"))
        .when(name == "Write", say("Write ", at("file_path"), " -- file on disk is current"))
        .when(name == "Bash", say("Bash: ", truncate(at("command"), 80)))
        .when(name == "Grep", say("Grep '", truncate(at("pattern"), 40), "' in ", at("path")))
        .when(name == "Glob", say("Glob '", at("pattern"), "'"))
        .when(name == "Agent", say("Agent: ", truncate(at("description"), 60)))
        .when(name == "WebSearch", say("WebSearch '", truncate(at("query"), 60), "'"))
        .when(name == "WebFetch", say("WebFetch ", truncate(at("url"), 60)))
        .otherwise(F.concat(say(name, " ", arguments(input_)), F.when(note != "", F.concat(F.lit(" — "), note)).otherwise(F.lit(""))))
    )
    return with_hint(line, tool_keywords(name, input_))


def result_stub(keywords: Column) -> Column:
    return with_hint(F.lit("[tool result archived]"), keywords)


def line_count(text: Column) -> Column:
    return occurrences(text, "\n") + 1


# The patterns of a signature and of a function's line.
SIGNATURE = r"(?i)\b(func|type|class|def|export)\s+(\w[\w.]*)"
FUNCTION = r"(?m)^func\s+(\([^)]+\)\s+)?(\w+)\s*\("


def signatures(text: Column, most: int = 5) -> Column:
    found = F.slice(F.regexp_extract_all(text, F.lit(SIGNATURE), F.lit(0)), 1, most)
    return F.transform(found, lambda s: F.concat(F.lower(F.regexp_extract(s, SIGNATURE, 1)), F.lit(" "), F.regexp_extract(s, SIGNATURE, 2)))


def result_facts(content: Column) -> Column:
    """What a summary says of a tool result's text, so that it is read once however many calls answer with it: lines and up to five signatures."""
    return F.struct(line_count(content).alias("lines"), F.array_join(signatures(content), "; ").alias("key"))


def result_summary(name: Column, facts: Column, keywords: Column) -> Column:
    """What stands for a large tool result: the tool, the lines, up to five signatures, a hint."""
    # Names the key once: signatures of a large text are worth finding only once.
    key = F.array_join(F.transform(F.filter(F.array(facts["key"]), lambda k: k != ""), lambda k: F.concat(F.lit(", key: "), k)), "")
    return with_hint(F.concat(F.lit("[context compressed: "), F.coalesce(name, F.lit("tool")), F.lit(", "), facts["lines"].cast("string"), F.lit(" lines"), key, F.lit("]")), keywords)


def eager_facts(content: Column) -> Column:
    """What eager stubs say of an answer's text, so that it is read once however many calls answer with it; ends and first are null where they are the whole text."""
    lines = F.split(content, "\n", -1)
    n = F.size(lines)
    names = F.transform(F.slice(F.regexp_extract_all(content, F.lit(FUNCTION), F.lit(2)), 1, 20), lambda f: F.concat(f, F.lit("()")))
    named = F.when(F.size(names) > 0, F.concat(F.lit(" | "), F.array_join(names, ", "))).otherwise(F.lit(""))
    ends = F.when(n > 6, F.concat(F.array_join(F.slice(lines, 1, 3), "\n"), F.lit("\n[...]\n"), F.array_join(F.slice(lines, -3, 3), "\n")))
    first = F.when(n > 10, F.concat(F.array_join(F.slice(lines, 1, 10), "\n"), F.lit("\n[... +"), (n - 10).cast("string"), F.lit(" more]")))
    return F.struct(n.alias("lines"), named.alias("named"), ends.alias("ends"), first.alias("first"))


def eager_stub(name: Column, input_: Column, content: Column, facts: Column | None = None) -> Column:
    """What stands for an answer that was taken up; facts: eager_facts of its content, if they are there."""
    at = lambda key: F.coalesce(F.try_element_at(input_, F.lit(key)), F.lit(""))
    facts = eager_facts(content) if facts is None else facts
    count, named = facts["lines"].cast("string"), facts["named"]
    ends, first = F.coalesce(facts["ends"], content), F.coalesce(facts["first"], content)
    return (
        F.when(name == "Read", F.concat(F.lit("[Read "), at("file_path"), F.lit(" — "), count, F.lit(" lines"), named, F.lit("]")))
        .when(name == "Grep", F.concat(F.lit("[Grep '"), at("pattern"), F.lit("' in "), at("path"), F.lit(" — "), count, F.lit(" matches]")))
        .when(name == "Bash", F.concat(F.lit("[Bash: "), truncate(at("command"), 80), F.lit(" — "), count, F.lit(" lines]\n"), ends))
        .when(name == "Glob", F.concat(F.lit("[Glob '"), at("pattern"), F.lit("' — "), count, F.lit(" results]\n"), first))
        .when(name == "Agent", F.concat(F.lit("[Agent: "), at("description"), F.lit(" — "), truncate(content, 200), F.lit("]")))
        .otherwise(F.concat(F.lit("["), F.coalesce(name, F.lit("")), F.lit(" result — "), count, F.lit(" lines archived]")))
    )


def commit_message(command: Column) -> Column:
    """The message of a git commit command; empty if it has none."""
    after = trim(F.regexp_extract(command, r"(?s)-m (.*)$", 1))
    double, single = F.regexp_extract(after, r'(?s)^"([^"]*)"', 1), F.regexp_extract(after, r"(?s)^'([^']*)'", 1)
    quoted = F.when(after.rlike(r'(?s)^"[^"]*"'), double).when(after.rlike(r"(?s)^'[^']*'"), single).otherwise(truncate(after, 200))
    return F.when(command.contains("-m "), quoted).when(command.contains("<<"), "commit (heredoc format)").otherwise("")


def timeline_event(name: Column, input_: Column, idx: Column) -> Column:
    """A line of the timeline; null for tools that only look."""
    head = F.concat(F.lit("- ["), idx.cast("string"), F.lit("] "))
    path = first_path(input_)
    command = trim(F.coalesce(F.try_element_at(input_, F.lit("command")), F.lit("")))
    bash = (
        F.when(command.contains("git commit"), "git commit")
        .when(command.contains("go build") | command.contains("make build"), "build")
        .when(command.contains("go test"), "test")
        .otherwise(F.concat(F.lit("Bash: "), truncate(F.replace(command, F.lit("\n"), F.lit(" ")), 80)))
    )
    what = (
        F.when(name.isin("Edit", "Write"), F.concat(name, F.coalesce(F.concat(F.lit(": "), base_path(path)), F.lit(""))))
        .when(name == "Bash", bash)
        .when(name == "Skill", F.concat(name, F.coalesce(F.concat(F.lit(": "), filled(input_, "skill")), F.lit(""))))
        .otherwise(name)
    )
    return F.when(~F.lower(name).isin("grep", "glob", "read"), F.concat(head, what))


def user_event(text: Column, idx: Column) -> Column:
    said = trim(text)
    return F.when((said != "") & ~said.startswith("["), F.concat(F.lit("- ["), idx.cast("string"), F.lit("] U: "), truncate(said, 120)))


def run_key(event: Column) -> Column:
    """Events with one key fold into one line; empty for those that never do."""
    rest = F.regexp_extract(event, r"(?s)^- \[.*?\] (.*)$", 1)
    at = F.instr(rest, ": ")
    alone = ~event.rlike(r"(?s)^- \[.*?\] ") | rest.startswith("U: ") | (rest == "git commit") | rest.startswith("Bash: ")
    return F.when(alone, "").when(at > 0, F.concat(F.lower(F.substring_index(rest, ": ", 1)), F.lit(":"), F.substr(rest, at + 2))).otherwise(F.lower(rest))


def counts_line(pairs: Column) -> Column:
    """The five largest of array<struct<key, n>> as `key(n)`, and how many more."""
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct((-p["n"]).alias("a"), p["key"].alias("key"))))
    top = F.transform(F.slice(ordered, 1, 5), lambda p: F.concat(p["key"], F.lit("("), (-p["a"]).cast("string"), F.lit(")")))
    more = F.when(F.size(pairs) > 5, F.array(F.concat(F.lit("+"), (F.size(pairs) - 5).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(top, more), ", ")


def compacted_text(start: Column, end: Column, files: Column, tools: Column) -> Column:
    part = lambda name, line: F.when(F.coalesce(line, F.lit("")) != "", F.concat(F.lit(f"\n{name}: "), line)).otherwise(F.lit(""))
    return F.concat(F.lit("[Compacted: Messages "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" ("), (end - start + 1).cast("string"), F.lit(" msgs)]"), part("Files", files), part("Tools", tools))


def archive_text(start: Column, end: Column, count: Column, tokens: Column, tools: Column, files: Column, commits: Column, timeline: Column, errors: Column, conclusion_: Column) -> Column:
    """The text of an archive: range, tools, files, commits, timeline, errors, conclusion; empty parts are left out.

    tools is counts_line's array, files a sorted array, errors the number of them.
    """
    lines = lambda array, form=lambda x: F.concat(x, F.lit("\n")): F.array_join(F.transform(array, form), "")
    section = lambda name, body, shown, lead="\n": F.when(shown, F.concat(F.lit(f"{lead}### {name}\n"), body)).otherwise(F.lit(""))
    listed = F.concat(lines(F.slice(files, 1, 40), lambda f: F.concat(F.lit("- "), f, F.lit("\n"))), F.when(F.size(files) > 40, F.concat(F.lit("- [..."), (F.size(files) - 40).cast("string"), F.lit(" more files omitted...]\n"))).otherwise(F.lit("")))
    long = F.concat(lines(F.slice(timeline, 1, 20)), F.lit("  [..."), (F.size(timeline) - 120).cast("string"), F.lit(" events omitted...]\n"), lines(F.slice(timeline, -100, 100)))
    told = F.when(F.size(timeline) > 120, long).otherwise(lines(timeline))
    s = lambda c: c.cast("string")
    return F.concat(
        F.lit("Archived messages "), s(start), F.lit("–"), s(end), F.lit("（共 "), s(count), F.lit(" 条，约 "), s(tokens), F.lit(" tokens）"),
        section("Tools Used", F.concat(counts_line(tools), F.lit("\n")), F.size(tools) > 0, "\n\n"), section("Files", listed, F.size(files) > 0), section("Commits", lines(commits), F.size(commits) > 0), section("Timeline", told, F.size(timeline) > 0),
        section("Gotchas", F.repeat(F.lit("- [tool error]\n"), errors.cast("int")), errors > 0), section("Conclusion", F.concat(conclusion_, F.lit("\n")), F.coalesce(conclusion_, F.lit("")) != ""),
    )


def summary_parts(text: Column) -> Column:
    """(text, some, head, must, sections) of an archive text, each section searched for once: what shortened() folds over."""
    marks = F.struct(*(F.instr(text, f"\n### {s}\n").alias(f"m{i}") for i, s in enumerate(SECTIONS)), F.length(text).alias("n"))

    def cut(m: Column) -> Column:
        starts = [F.when(m[f"m{i}"] > 0, m[f"m{i}"]) for i in range(len(SECTIONS))]
        ends = [F.least(*starts[i + 1 :], m["n"] + 1) if i + 1 < len(SECTIONS) else m["n"] + 1 for i in range(len(SECTIONS))]
        bodies = [F.when(start > 0, F.substring(text, start, end - start)) for start, end in zip(starts, ends, strict=True)]
        head = F.substring(text, F.lit(1), F.least(*starts) - 1)
        parts = F.array(*(F.struct(F.lit(s).alias("name"), c.alias("body"), F.lit(i >= 4).alias("kept")) for i, (s, c) in enumerate(zip(SECTIONS, bodies, strict=True))))
        must = F.concat(head, F.coalesce(bodies[4], F.lit("")), F.coalesce(bodies[5], F.lit("")))
        return F.struct(text.alias("text"), F.least(*starts).isNotNull().alias("some"), head.alias("head"), must.alias("must"), F.filter(parts, lambda p: p["body"].isNotNull()).alias("sections"))

    return _let(marks, cut)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shortened(found: Column, most: Column) -> Column:
    """An archive text of summary_parts cut by sections: head, errors and conclusion stay, others in order as they fit.

    A fold over the sections: what is kept, room left, and names left out since the last kept one.
    """
    zero = F.struct(found["head"].alias("out"), (most - F.length(found["must"])).alias("room"), F.lit("").alias("left_out"))

    def note(acc: Column) -> Column:
        return F.when(acc["left_out"] == "", F.lit("")).otherwise(F.concat(F.lit("\n[...omitted: "), acc["left_out"], F.lit("...]\n")))

    def step(acc: Column, p: Column) -> Column:
        fits = p["kept"] | (F.length(p["body"]) <= acc["room"])
        used = F.when(fits & ~p["kept"], F.length(p["body"])).otherwise(0)
        return F.struct(
            F.when(fits, F.concat(acc["out"], note(acc), p["body"])).otherwise(acc["out"]).alias("out"),
            (acc["room"] - used).alias("room"),
            F.when(fits, F.lit("")).when(acc["left_out"] == "", p["name"]).otherwise(F.concat(acc["left_out"], F.lit(", "), p["name"])).alias("left_out"),
        )

    folded = F.aggregate(found["sections"], zero, step, lambda acc: F.concat(acc["out"], note(acc)))
    text = found["text"]
    return F.when(F.length(text) <= most, text).when(~found["some"], truncate(text, most)).when(F.length(found["must"]) > most, truncate(found["must"], most)).otherwise(folded)


def shorten_summary(text: Column, most: int | Column) -> Column:
    """shortened() of a text."""
    limit = F.lit(most) if isinstance(most, int) else most
    return _let(summary_parts(text), lambda p: shortened(p, limit))


#: Code points of a message that a full expansion shows, and of an answer in it.
LINE, ANSWER = 2000, 200


def message_piece(block: Column) -> Column:
    """What a block (type, text, name, content) adds to its message's line: its text, [tool: name] for a call, [result] and 200 code points for an answer. A text is cut where no line shows more of it."""
    answer = F.when(F.coalesce(block["content"], F.lit("")) != "", F.concat(F.lit("[result] "), truncate(block["content"], ANSWER)))
    text = F.substring(block["text"], 1, LINE + 1)
    return F.when(block["type"] == "text", text).when(block["type"] == "tool_use", F.concat(F.lit("[tool: "), F.coalesce(block["name"], F.lit("")), F.lit("]"))).when(block["type"] == "tool_result", answer)


def line_of_pieces(role: Column, pieces: Column) -> Column:
    """A message as one entry of a full expansion, of its pieces in order, none of them empty; null if there are none."""
    said = F.array_join(pieces, "\n")
    return F.when(said != "", F.concat(F.lit("["), role, F.lit("]: "), truncate(said, LINE)))


def message_line(role: Column, blocks: Column) -> Column:
    """A message as one entry of a full expansion, of its blocks; null if that says nothing."""
    return line_of_pieces(role, F.filter(F.transform(blocks, message_piece), lambda p: F.coalesce(p, F.lit("")) != ""))


def last_lines(lines: Column, room: Column) -> Column:
    """The last of lines (array<struct<idx, line>> in order) that fit into `room` code points, and how many messages are left out before them; null if none fits.

    A fold from the end: room used, lines taken, and the message at which it stopped.
    """
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("taken"), F.lit(-1).cast("bigint").alias("left_out"))

    def step(acc: Column, x: Column) -> Column:
        used = acc["used"] + F.length(x["line"]) + 1
        stop = F.struct(acc["used"].alias("used"), acc["taken"].alias("taken"), (x["idx"] + 1).alias("left_out"))
        return F.when(acc["left_out"] >= 0, acc).when(used > room, stop).otherwise(F.struct(used.alias("used"), (acc["taken"] + 1).alias("taken"), acc["left_out"].alias("left_out")))

    def told(acc: Column) -> Column:
        shown = F.array_join(F.transform(F.slice(lines, F.size(lines) - acc["taken"] + 1, acc["taken"]), lambda x: x["line"]), "\n")
        head = F.when(acc["left_out"] > 0, F.concat(F.lit("[..."), acc["left_out"].cast("string"), F.lit(" earlier messages omitted...]\n"))).otherwise(F.lit(""))
        return F.when(acc["taken"] > 0, F.concat(head, shown))

    return F.aggregate(F.reverse(lines), zero, step, told)


def hints(text: Column) -> Column:
    """What stands in deep_search('...') marks."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)deep_search\('(.*?)'\)"), F.lit(1)), trim), lambda h: h != "")


def paths(text: Column) -> Column:
    """Tokens that look like absolute or relative file paths, in order."""
    tokens = F.transform(F.split(text, "[ \n\t,;\"']", -1), lambda w: F.btrim(w, F.lit('.,;:!?()[]{}<>"')))
    shaped = lambda w: (F.octet_length(w) >= 3) & (w.rlike(r"^.:[\\/]") | w.startswith("/") | (w.contains("/") & w.contains(".")))
    return F.array_distinct(F.filter(tokens, shaped))


def plain_path(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def is_temporary(body: Column) -> Column:
    said = F.lower(trim(body))
    return (said == "noise") | any_of(said, TEMPORARY_MARKERS)


def is_persistent(body: Column) -> Column:
    return body.rlike(r"(?m)^\s*# (" + "|".join(CONTEXT_HEADINGS) + r")\s*$")


REMINDER = r"(?s)(<system-reminder>\s*.*?\s*</system-reminder>)"


def _body(span: Column) -> Column:
    return F.regexp_extract(span, r"(?s)^<system-reminder>\s*(.*?)\s*</system-reminder>$", 1)


def _without(text: Column, drops) -> Column:
    """Without the reminders whose body drops() names, each at its own place: what stands between reminders is put together again with the others."""
    spans = F.regexp_extract_all(text, F.lit(REMINDER), F.lit(1))
    kept = F.transform(spans, lambda s: F.when(drops(_body(s)), F.lit("")).otherwise(s))
    between = F.split(text, REMINDER, -1)
    return F.array_join(F.transform(between, lambda p, k: F.concat(p, F.coalesce(F.get(kept, k), F.lit("")))), "")


def strip_reminders(text: Column) -> Column:
    """Without temporary reminders and skill hints; session starts, persistent context and unknown ones stay. Trimmed only if changed."""
    out = F.regexp_replace(_without(text, lambda b: is_temporary(b) & ~b.contains("SessionStart:") & ~is_persistent(b)), r"(?s)\n?\[skill-hint\].*?\[/skill-hint\]", "")
    return F.when(out == text, text).otherwise(trim(out))


def persistent_spans(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(REMINDER), F.lit(1)), lambda s: is_persistent(_body(s)))


def without_persistent(text: Column) -> Column:
    return _without(text, is_persistent)


def decayed(text: Column, stage: Column, role: Column) -> Column:
    """Shorter with each stage, nothing in the last."""
    def cut(user: int, assistant: int) -> Column:
        limit = F.when(role == "user", user).when(role == "assistant", assistant)
        return F.when(F.length(text) > limit, F.concat(F.substring(text, F.lit(1), limit), F.lit("..."))).otherwise(text)

    return F.when(stage == 0, text).when(stage == 1, cut(200, 120)).when(stage == 2, cut(80, 50)).when(stage == 3, "").otherwise(text)


def decayed_stub(stub: Column, stage: Column) -> Column:
    """A tool stub whose note is cut to three words, dropped, or all dropped."""
    at = F.instr(stub, " — ")
    head, note = F.substring(stub, F.lit(1), at - 1), F.substr(stub, at + 3)
    few = F.array_join(F.slice(F.split(note, " ", -1), 1, 3), " ")
    return F.when(stage == 3, "").when((at == 0) | (stage == 0), stub).when(stage == 1, F.when(few != "", F.concat(head, F.lit(" — "), few)).otherwise(head)).when(stage == 2, head).otherwise(stub)


def without_userinfo(url: Column) -> Column:
    return F.regexp_replace(url, "//[^/@]*@", "//")


def log_safe(text: Column, session_id: Column) -> Column:
    """Without the session's id and escape characters, line ends spelt out."""
    known = F.when(F.coalesce(session_id, F.lit("")) == "", text).otherwise(F.replace(text, session_id, F.lit("[REDACTED]")))
    return F.replace(F.replace(F.replace(known, F.lit("\x1b"), F.lit("")), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


# Parts of keys that no log line shows.
HIDDEN_KEYS = ("authorization", "proxy-authorization", "api-key", "cookie", "set-cookie", "body", "messages", "system", "tools", "prompt", "payload", "base64", "fingerprint")


def is_shown_key(key: Column) -> Column:
    low = F.lower(key)
    return (key != "") & ~any_of(low, HIDDEN_KEYS) & ~low.endswith("session_id")


def log_line(level: Column, request_id: Column, message: Column, attributes: Column, session_id: Column) -> Column:
    """Level, #request, message and the attributes (map) that may be shown, by key."""
    shown = F.filter(F.array_sort(F.map_entries(attributes)), lambda e: is_shown_key(e["key"]) & (e["key"] != "request_id") & (e["value"] != ""))
    pairs = F.array_join(F.transform(shown, lambda e: F.concat(e["key"], F.lit("="), log_safe(e["value"], session_id))), " ")
    return F.concat_ws(" ", F.nullif(level, F.lit("")), F.concat(F.lit("#"), request_id.cast("string")), log_safe(message, session_id), F.nullif(pairs, F.lit("")))


def joined_text(blocks: Column) -> Column:
    """The text blocks of a message with a blank between."""
    said = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"])
    return trim(F.array_join(said, " "))


def result_text(content: Column, end: str = "\n", closed: bool = False) -> Column:
    """The text of an answer's raw content: a string, or the texts of nested blocks joined by (closed: each ended with) `end`."""
    kind = F.schema_of_variant(F.try_parse_json(content))
    nested = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(nested, lambda b: F.coalesce(b["text"], F.lit("")) != ""), lambda b: b["text"])
    joined = F.array_join(F.transform(texts, lambda t: F.concat(t, F.lit(end))), "") if closed else F.array_join(texts, end)
    return F.when(kind == "STRING", F.try_variant_get(F.try_parse_json(content), "$", "string")).when(kind.startswith("ARRAY"), joined).otherwise(F.lit(""))


def match_terms(terms: Column, most: int = 20) -> Column:
    """The terms of a search, any of which may match: not empty, the first twenty."""
    return F.slice(F.filter(terms, lambda t: t != ""), 1, most)


def is_task_list(text: Column) -> Column:
    return any_of(text, TASK_MARKERS)


def is_pivot(text: Column, latest: Column) -> Column:
    return (F.coalesce(latest, F.lit("")) != "") & (F.size(F.array_intersect(words(text), words(latest))) >= 3)


def is_decision(role: Column, text: Column, previous_role: Column, previous_text: Column) -> Column:
    said = trim(text)
    short = (F.length(said) < 100) & (previous_role == "assistant") & (F.length(trim(previous_text)) > 400)
    return (role == "user") & (said != "") & ~said.endswith("?") & ((F.length(said) < 30) | F.coalesce(short, F.lit(False)) | any_of(F.lower(text), DECISION_MARKERS))
