"""From transcript lines to turns, session headers and rendered text.

A rendered session is a table of lines in order rather than one string per session: a session may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.instants import instant_ms
from threadlake.functions.text import is_blank, strip
from threadlake.session import staged

# Line types that are no conversation, and the input field that sums up a call of each tool.
NOISE_TYPES = ("file-history-snapshot", "system", "progress")
TOOL_FIELD = {
    "Bash": "command", "Read": "file_path", "Write": "file_path", "Edit": "file_path", "Glob": "pattern",
    "Grep": "pattern", "WebFetch": "url", "WebSearch": "query", "Agent": "description",
}
IDLE_CAP_MS = 900_000


def strip_markup(text: Column | str) -> Column:
    """Without paired markup (shortest match, across lines) and self-closing tags, trimmed. It is a pattern, no parser."""
    c = F.col(text) if isinstance(text, str) else text
    return strip(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>[\s\S]*?</[^>]+>", ""), r"<[^>]+/>", ""))


def tool_summary(name: Column, input_json: Column) -> Column:
    """``Name: `…```: the tool's telling field if it is a string, else its whole input, cut to 80 characters."""
    fields, value = F.try_parse_json(input_json), F.lit(None).cast("string")
    for tool, key in TOOL_FIELD.items():
        field = F.try_variant_get(fields, f"$.{key}", "variant")
        value = F.when(name == tool, F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(fields, f"$.{key}", "string"))).otherwise(value)
    raw = F.coalesce(value, F.get_json_object(input_json, "$"), F.lit("{}"))
    cut = F.when(F.length(raw) > 80, F.concat(F.substring(raw, 1, 80), F.lit("…"))).otherwise(raw)
    return F.concat(name, F.lit(": `"), cut, F.lit("`"))


def preview(text: Column | str, size: int = 300) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def session_of_chunk(chunk_id: Column | str) -> Column:
    """A chunk's session: its id without the last part."""
    return F.regexp_replace(F.col(chunk_id) if isinstance(chunk_id, str) else chunk_id, "_[^_]*$", "")


def short_id(uuid: Column | str) -> Column:
    """The first eight hex digits of a full UUID; anything else as it is."""
    c = F.col(uuid) if isinstance(uuid, str) else uuid
    found = F.regexp_extract(c, "(?i)^([0-9a-f]{8})-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", 1)
    return F.when(found != "", found).otherwise(c)


def unique_lines(messages: DataFrame) -> DataFrame:
    """Lines counted once per (session_id, line_no): the copy with the lowest ``line_id``."""
    cols = [c for c in messages.columns if c not in ("session_id", "line_no")]
    kept = messages.groupBy("session_id", "line_no").agg(F.min_by(F.struct(*cols), "line_id").alias("x"))
    return kept.select("session_id", "line_no", "x.*").withColumn("ms", instant_ms("timestamp"))


def conversation_lines(lines: DataFrame) -> DataFrame:
    """Lines that aren't noise, meta or side chain."""
    flags = ~F.coalesce("ismeta", F.lit(False)) & ~F.coalesce("issidechain", F.lit(False))
    return lines.where(~F.coalesce(F.col("type").isin(*NOISE_TYPES), F.lit(False)) & flags)


def turns(lines: DataFrame) -> DataFrame:
    """Turns: ``role`` is the line's ``type``, user or assistant, and there is text."""
    text = strip("content_text")
    return (
        conversation_lines(lines)
        .where(F.col("type").isin("user", "assistant") & (F.col("role") == F.col("type")) & ~is_blank("content_text"))
        .withColumn("text", F.when(F.col("role") == "user", strip_markup("content_text")).otherwise(text))
        .where("text != ''")
    )


def active_duration(events: DataFrame, key: str, ts_ms: str, cap_ms: int = IDLE_CAP_MS, block_ms: int = 86_400_000) -> DataFrame:
    """Active seconds per key: gaps between consecutive events, each counted up to ``cap_ms``.

    Windows run over (key, day); the gap from one day's last to the next day's first event is added from a row per day, so no
    window holds a whole key.
    """
    rows = events.select(F.col(key).alias("k"), F.col(ts_ms).alias("t")).where("t IS NOT NULL").withColumn("day", F.floor(F.col("t") / block_ms))

    def capped(gap: Column) -> Column:
        return F.when(gap.isNotNull(), F.least(gap, F.lit(cap_ms)))  # least() skips nulls

    gap = capped(F.col("t") - F.lag("t").over(Window.partitionBy("k", "day").orderBy("t")))
    days = rows.withColumn("gap", gap).groupBy("k", "day").agg(F.sum("gap").alias("within"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    across = capped(F.col("lo") - F.lag("hi").over(Window.partitionBy("k").orderBy("day")))
    total = days.withColumn("across", across).groupBy("k").agg((F.coalesce(F.sum("within"), F.lit(0)) + F.coalesce(F.sum("across"), F.lit(0))).alias("ms"))
    return total.select(F.col("k").alias(key), F.round(F.col("ms") / 1000).cast("bigint").alias("duration_seconds"))


def session_headers(messages: DataFrame) -> DataFrame:
    """One header per session: title, date, project, turns, last message, active seconds.

    The copy of a line that counts is chosen from narrow columns and staged once; texts are read in one more scan, where the first turn of a user alone is
    wanted, and cut to what a title needs as early as it can be. Blank ``date`` and ``project`` stay ''.
    """
    turn = F.col("type").isin("user", "assistant") & (F.col("role") == F.col("type")) & ~is_blank("content_text")
    said = F.when(F.col("role") == "user", strip_markup("content_text")).otherwise(strip("content_text"))
    narrow = messages.select(
        "session_id", "line_no", "line_id", instant_ms("timestamp").alias("ms"), "type", "role", "ismeta", "issidechain", F.when(~is_blank("cwd"), F.col("cwd")).alias("cwd"),
        F.when(turn & (said != ""), F.substring(said, 1, 120)).alias("said"),
    )
    kept = narrow.groupBy("session_id", "line_no").agg(F.min_by(F.struct("ms", "type", "role", "ismeta", "issidechain", "cwd", "said"), "line_id").alias("x"))
    lines = staged(kept.select("session_id", "line_no", "x.*"), "header-lines")
    talk = conversation_lines(lines).groupBy("session_id").agg(
        F.min_by("ms", F.when(F.col("ms").isNotNull(), F.col("line_no"))).alias("first_ms"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"),
        F.min_by("said", F.when(F.col("said").isNotNull() & (F.col("role") == "user"), F.col("line_no"))).alias("title"),
        F.count_if(F.col("said").isNotNull() & (F.col("role") == "user")).alias("n_user"),
        F.count_if(F.col("said").isNotNull()).alias("n_turns"),
    )
    every = lines.groupBy("session_id").agg(F.max("ms").alias("last_message_at"), F.count("*").alias("n_lines"))
    return (
        every.join(talk, "session_id", "left").join(active_duration(lines, "session_id", "ms"), "session_id", "left")
        .select(
            "session_id",
            "title",
            F.coalesce(F.date_format(F.timestamp_millis("first_ms"), "yyyy-MM-dd"), F.lit("")).alias("date"),
            F.coalesce(F.element_at(F.split(F.regexp_replace("cwd", "/+$", ""), "/"), -1), F.lit("")).alias("project"),
            F.coalesce("n_user", F.lit(0)).alias("n_user"), F.coalesce("n_turns", F.lit(0)).alias("n_turns"),
            "n_lines", "last_message_at", F.coalesce("duration_seconds", F.lit(0)).alias("duration_seconds"),
        )
    )


def indexable(headers: DataFrame, least_user_turns: int = 2) -> DataFrame:
    """Sessions with enough user turns to be worth an index entry."""
    return headers.where(F.col("n_user") >= least_user_turns)


def rendered_lines(messages: DataFrame, markdown: bool) -> DataFrame:
    """A session's text as lines in order: ``session_id, line_no, line``; as Markdown or flat for an index."""
    said = turns(unique_lines(messages))
    who = F.initcap("role")
    line = F.concat(F.lit("## "), who, F.lit("\n\n"), F.col("text"), F.lit("\n")) if markdown else F.concat(F.lit("["), who, F.lit("] "), F.col("text"))
    return said.select("session_id", "line_no", line.alias("line"))


def session_lines(messages: DataFrame, blocks: DataFrame, markdown: bool, headers: DataFrame | None = None) -> DataFrame:
    """A session as one document, in lines: ``session_id, line_no, part_no, line``, to be read in the order of the two numbers.

    Beside what ``rendered_lines`` gives come the calls of each turn that survives (``blocks`` of the same lines, outermost ``tool_use`` ones), as ``[Tool]`` lines or quotes,
    and in Markdown, with ``headers`` (``session_headers``), the head with project, date and title. A turn that only calls tools counts. A session may
    hold a third of all rows, so it stays a table of lines; blank lines never follow one another.
    """
    lines = unique_lines(messages)
    said = rendered_lines(messages, markdown).withColumn("part_no", F.lit(0).cast("bigint"))
    talk = conversation_lines(lines).where((F.col("type") == "assistant") & (F.col("role") == "assistant")).select("session_id", "line_no", "line_id")
    summary = tool_summary(F.col("tool_name"), F.col("body"))
    calls = blocks.where("depth = 0 AND block_type = 'tool_use' AND tool_name != ''").select("line_id", (F.col("position") + 1).cast("bigint").alias("part_no"), F.concat(F.lit("> **Tool:** " if markdown else "[Tool] "), summary).alias("line"))
    out = said.unionByName(talk.join(calls, "line_id").select("session_id", "line_no", "line", "part_no"))
    if headers is not None and markdown:
        head = F.concat(F.lit("# Session: "), F.col("project"), F.lit(" — "), F.col("date"), F.lit("\n"), F.coalesce(F.concat(F.lit("\n_"), F.col("title"), F.lit("_\n")), F.lit("")))
        out = out.unionByName(headers.select("session_id", F.lit(-1).alias("line_no"), head.alias("line"), F.lit(0).cast("bigint").alias("part_no")))
    return out.select("session_id", "line_no", "part_no", "line")


def with_summaries(lines: DataFrame, summaries: DataFrame) -> DataFrame:
    """``session_lines`` with the summary header (``id, header``) before the head of its session, runs of blank lines in it collapsed."""
    head = summaries.select(F.col("id").alias("session_id"), F.lit(-2).alias("line_no"), F.lit(0).cast("bigint").alias("part_no"), F.regexp_replace("header", "\n{3,}", "\n\n").alias("line"))
    return lines.unionByName(head.join(lines.select("session_id").distinct(), "session_id", "left_semi"))
