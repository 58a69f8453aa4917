"""Quotation linking: reply-ordered conversations without quotes, in DataFrame functions only.

A line's quote level is the number of ``>`` before it.  Consecutive lines of one level without
a blank line between them are one passage.  Passages are normalised (lower case, white space
as one space) and hashed, whole and by line, and meet the earliest message of their
conversation whose own words hold the same paragraph, line or whole text.  A message answers
the latest message that its outermost linked quotes come from.  Quoted lines, and the line that
announces a quote, leave the text.  Threads (a first message and all that answers it, directly
or not) stand together in a conversation, and each message after the one it answers.

Hashes are grouped by (conversation, hash), numbers come from slices of turns, and texts are dealt by
(conversation, turn) or parts of turns, so that a conversation of any length is never one group.
Texts of any length and depth of quotation pass: lines are worked on as arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import common

SLICE = 1_000
SALTS = 32
QUOTED = r"(?m)^[ \t]*>"
#: Quote signs at the beginning of a line.  Repeated groups would recurse; classes of characters do not.
PREFIX = r"^[ \t>]*>"
#: The line before a quote that names its author.
ANNOUNCED = "(?m)^0\u0001(?i:(?:on|am|le|el)\\b[^\n]*(?:wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*)\n(?=[1-9][0-9]*\u0001)"
BLANK = " \t\r\f\n"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[ \t\r\f\n]+", " "))


def levelled(text: Column) -> Column:
    """The text with each line as level, a mark, and the line without its quote signs."""
    plain = F.translate(F.regexp_replace(text, "\r\n?", "\n"), "\u0001", "")

    def line(x: Column) -> Column:
        signs = F.regexp_extract(x, PREFIX, 0)
        level = F.length(F.translate(signs, " \t", ""))
        rest = F.regexp_replace(F.substr(x, F.length(signs) + 1), "^[ \t]", "")
        return F.concat(level.cast("string"), F.lit("\u0001"), F.when(level > 0, rest).otherwise(x))

    return F.regexp_replace(F.array_join(F.transform(F.split(plain, "\n"), line), "\n"), ANNOUNCED, "")


def parsed(messages: DataFrame) -> DataFrame:
    """Adds own (the text without quotes) and quotes (level, passage) to every row.

    A text without quoted lines stays as it is; a null one stays null.
    """
    lines = F.split(F.when(F.col("text").rlike(QUOTED), levelled(F.col("text"))), "\n")
    level = lambda x: F.substring_index(x, "\u0001", 1)
    body = lambda x: F.substring_index(x, "\u0001", -1)
    filled = lambda x: F.btrim(body(x), F.lit(BLANK)) != ""
    own = F.array_join(F.transform(F.filter("__lines", lambda x: level(x) == "0"), body), "\n")
    # lines of one level follow each other in a run; a mark that no line begins with divides runs
    before = F.concat(F.array(F.lit("")), F.slice("__lines", F.lit(1), F.greatest(F.size("__lines") - 1, F.lit(0))))
    together = lambda x, y: (level(x) == level(y)) & filled(x) & filled(y)
    marked = F.zip_with("__lines", before, lambda x, y: F.concat(F.when(together(x, y), F.lit("\n")).otherwise(F.lit("\n\u0001")), x))
    runs = F.filter(F.split(F.array_join(marked, ""), "\n\u0001"), lambda r: (r != "") & (level(r) != "0") & filled(r))
    passage = F.transform(
        F.coalesce(runs, F.array().cast("array<string>")),
        lambda r: F.struct(level(r).cast("int").alias("level"), F.regexp_replace(r, "(?m)^[0-9]+\u0001", "").alias("passage")),
    )
    return (
        messages.withColumn("__lines", lines)
        .withColumn("own", F.when(F.col("__lines").isNull(), F.col("text")).otherwise(F.btrim(own, F.lit(BLANK))))
        .withColumn("quotes", passage)
        .drop("__lines")
    )


def hashes(text: Column, separators: tuple[str, ...]) -> Column:
    """Hashes of the normalised text and of its parts between each of the separators; blank ones are left out."""
    parts = F.flatten(F.array(F.array(text), *[F.split(text, s) for s in separators]))
    kept = F.filter(F.transform(parts, lambda x: normalised(x)), lambda x: x != "")
    return F.array_distinct(F.transform(kept, lambda x: F.xxhash64(x)))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) for every message with a quote whose original is known.

    ``messages`` has conv_id, turn, own and quotes.  A passage that stands in several earlier
    messages comes from the first of them.
    """
    quoted = messages.where("size(quotes) > 0 and conv_id is not null and turn is not null")
    each = quoted.select("conv_id", "turn", F.posexplode("quotes").alias("i", "q")).select(
        "conv_id", "turn", "i", "q.level", F.explode(hashes(F.col("q.passage"), ("\n",))).alias("h")
    )
    # a long conversation's messages are dealt into parts; each part meets the conversation's id
    salt = F.pmod(F.col("turn"), F.lit(SALTS)).cast("int").alias("salt")
    wanted = each.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    sources = messages.where("turn is not null").select("conv_id", "turn", "own", salt).join(wanted, ["conv_id", "salt"], "left_semi")
    units = sources.select("conv_id", "turn", F.explode(hashes(F.col("own"), ("\n[ \t\r\f]*\n", "\n"))).alias("h"))
    first = units.groupBy("conv_id", "h").agg(F.min("turn").alias("source"))
    met = each.join(first, ["conv_id", "h"]).where("source < turn")
    by_level = met.groupBy("conv_id", "turn", "level").agg(F.max("source").alias("source"), F.collect_set("i").alias("found"))
    return by_level.groupBy("conv_id", "turn").agg(F.min_by("source", "level").alias("reply_to"), F.sum(F.size("found")).alias("n_linked"))


def threads(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth): first message and distance from it of every answer in ``linked``, a table on disk.

    Every round doubles the distance that is known, so that the rounds are few.
    """
    now = common.stage(linked.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        above = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"))
        joined = now.join(above, ["conv_id", "thread"], "left")
        if joined.where("further is not null").isEmpty():
            return now
        step = joined.select("conv_id", "turn", F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        now = common.stage(step, "threads")


def positions(keys: DataFrame) -> DataFrame:
    """Adds position, from 0, to ``keys`` (conv_id, thread, turn), by thread and turn in each conversation."""
    sliced = keys.withColumn("__slice", F.floor(F.col("turn") / SLICE))
    before = Window.partitionBy("conv_id").orderBy("thread", "__slice").rowsBetween(Window.unboundedPreceding, -1)
    counted = sliced.groupBy("conv_id", "thread", "__slice").agg(F.count("*").alias("n"))
    offsets = counted.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("conv_id", "thread", "__slice").orderBy("turn"))
    numbered = sliced.withColumn("__own", own).join(offsets, ["conv_id", "thread", "__slice"])
    return numbered.withColumn("position", F.col("__before") + F.col("__own") - 1).drop("__slice", "__before", "__own")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, text (without quotes), reply_to, thread, depth, n_quotes, n_linked of every row.

    position orders a conversation: threads by their first turn, messages of a thread by turn.
    Messages that answer nothing known are first messages (thread is their own turn, depth 0,
    reply_to null).  Repeated (conv_id, turn) share all of this except their text.  A row without
    conv_id or turn stays, outside any order (position null).  Quotes with other quotes inside
    count by passage.  Columns other than these are left out; an empty table stays empty.
    """
    read = parsed(messages.select("conv_id", "turn", "role", "text"))
    linked = common.stage(links(read), "links")
    found = linked.join(threads(linked), ["conv_id", "turn"])
    keys = read.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    placed = keys.join(found, ["conv_id", "turn"], "left").withColumns({"thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    ordered = positions(placed)
    return read.join(ordered, ["conv_id", "turn"], "left").select(
        "conv_id", "position", "turn", "role", F.col("own").alias("text"), "reply_to",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )


def assembled(ordered: DataFrame, part: int = 1_000) -> DataFrame:
    """(conv_id, part, messages): conversations in their order, in parts of at most ``part`` positions."""
    numbered = ordered.where("position is not null").withColumn("part", F.expr(f"position div {int(part)}L"))
    item = F.struct("position", "turn", "role", "text", "reply_to")
    return numbered.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(item)).alias("messages"))


SQL = r"""
WITH RECURSIVE m AS (
    SELECT row_number() OVER () AS id, conv_id, turn, role, text,
           regexp_matches(text, '(?m)^[ \t]*>') AS quoted
    FROM conversations
), l AS (
    SELECT id, conv_id, turn, unnest(string_split(p, chr(10))) AS line, generate_subscripts(string_split(p, chr(10)), 1) AS pos
    FROM (SELECT *, replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(1), '') AS p FROM m WHERE quoted)
), v AS (
    SELECT id, conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')) AS level,
           regexp_replace(line, '^((?:[ \t]*>)*)[ \t]?', '') AS body, line
    FROM l
), a AS (
    SELECT *, CASE WHEN level = 0 THEN line ELSE body END AS own_line,
           level = 0 AND lead(level) OVER (PARTITION BY id ORDER BY pos) > 0
           AND regexp_matches(line, '(?i)^(?:on|am|le|el)\b.*(?:wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*$') AS announced
    FROM v
), w AS (
    SELECT *, trim(own_line, ' ' || chr(9) || chr(13) || chr(12)) = '' AS blank,
           lag(level) OVER (PARTITION BY id ORDER BY pos) AS level_before,
           lag(trim(own_line, ' ' || chr(9) || chr(13) || chr(12)) = '') OVER (PARTITION BY id ORDER BY pos) AS blank_before
    FROM a WHERE NOT announced
), r AS (
    SELECT *, sum(CASE WHEN blank OR blank_before OR level_before IS NULL OR level <> level_before THEN 1 ELSE 0 END)
              OVER (PARTITION BY id ORDER BY pos) AS run
    FROM w
), q AS (
    SELECT id, conv_id, turn, run, min(level) AS level, string_agg(body, chr(10) ORDER BY pos) AS passage
    FROM r WHERE level > 0 AND NOT blank GROUP BY ALL
), o AS (
    SELECT m.id, m.conv_id, m.turn, m.role,
           CASE WHEN quoted THEN coalesce(trim(s.own, ' ' || chr(9) || chr(10) || chr(12) || chr(13)), '') ELSE text END AS own
    FROM m LEFT JOIN (SELECT id, string_agg(own_line, chr(10) ORDER BY pos) AS own FROM w WHERE level = 0 GROUP BY id) s USING (id)
), u AS (
    SELECT conv_id, turn, trim(regexp_replace(lower(unit), '[ \t\r\f\n]+', ' ', 'g'), ' ') AS unit FROM (
        SELECT conv_id, turn, own AS unit FROM o
        UNION ALL SELECT conv_id, turn, unnest(string_split_regex(own, '\n[ \t\r\f]*\n')) FROM o
        UNION ALL SELECT conv_id, turn, unnest(string_split(own, chr(10))) FROM o
    )
), f AS (
    SELECT conv_id, unit, min(turn) AS source FROM u WHERE unit <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), e AS (
    SELECT conv_id, turn, run, id, level, trim(regexp_replace(lower(unit), '[ \t\r\f\n]+', ' ', 'g'), ' ') AS unit FROM (
        SELECT *, passage AS unit FROM q UNION ALL SELECT *, unnest(string_split(passage, chr(10))) FROM q
    )
), met AS (
    SELECT e.conv_id, e.turn, e.level, e.id, e.run, f.source FROM e JOIN f USING (conv_id, unit) WHERE f.source < e.turn
), k AS (
    SELECT conv_id, turn, arg_min(source, level) AS reply_to, sum(n)::BIGINT AS n_linked
    FROM (SELECT conv_id, turn, level, max(source) AS source, count(DISTINCT run) AS n FROM met GROUP BY ALL) GROUP BY ALL
), t AS (
    SELECT conv_id, turn, reply_to AS thread, 1::BIGINT AS depth FROM k
    UNION ALL
    SELECT t.conv_id, t.turn, k.reply_to, t.depth + 1 FROM t JOIN k ON t.conv_id = k.conv_id AND t.thread = k.turn
), top AS (
    SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM t GROUP BY ALL
), d AS (
    SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), n AS (
    SELECT d.conv_id, d.turn, k.reply_to, k.n_linked, coalesce(top.thread, d.turn) AS thread, coalesce(top.depth, 0) AS depth,
           row_number() OVER (PARTITION BY d.conv_id ORDER BY coalesce(top.thread, d.turn), d.turn) - 1 AS position
    FROM d LEFT JOIN k USING (conv_id, turn) LEFT JOIN top USING (conv_id, turn)
)
SELECT o.conv_id, n.position, o.turn, o.role, o.own AS text, n.reply_to, coalesce(n.thread, o.turn) AS thread,
       coalesce(n.depth, 0) AS depth, coalesce(c.n, 0) AS n_quotes, coalesce(n.n_linked, 0) AS n_linked
FROM o LEFT JOIN n ON o.conv_id = n.conv_id AND o.turn = n.turn
LEFT JOIN (SELECT id, count(*) AS n FROM q GROUP BY id) c ON o.id = c.id
"""
