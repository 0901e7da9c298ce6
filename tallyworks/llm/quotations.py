"""Conversations put in order by what their messages quote.

Nested quote levels are parsed line by line; runs of lines of one level are passages. Passages are normalised and
hashed, quoted ones are joined to the first message of the conversation that says them itself; those that are found
nowhere whole are looked up by runs of words. The links give threads. Messages come out without quotes, replies after what they reply to. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import number_rows
from ..session import durable
from .common import BREAK, words
from .rule_ledger import bind

MARKS = r"^((?:[\x20\x09]*>)+)[\x20\x09]?"
ATTRIBUTION = r"(?i)^\s*(on\b.*\s)?.*\b(wrote|writes|schrieb|escribió|a écrit)\s*:\s*$"
# Control characters that divide passages while a message is taken apart; texts lose them first.
CUT, LEVEL = "\x01", "\x02"
# Words of a run, and the marks of what a quote leaves out.
RUN, LEFT_OUT = 4, r"[\[(]?(?:\.{3,}|…)[\])]?"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, BREAK, " ")))


def passages(text: Column) -> Column:
    """array<struct<level, text>>: runs of lines of one quote level, divided at blank lines too.

    A line that only introduces the quote after it ("... wrote:") is in no passage.
    """
    clean = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[{CUT}{LEVEL}]", "")
    lines = F.transform(F.split(clean, "\r?\n", -1), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("text")))

    def runs(ls: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before, after = F.get(ls, i - 1), F.get(ls, i + 1)
            intro = (x["level"] == 0) & x["text"].rlike(ATTRIBUTION) & (F.coalesce(after["level"], F.lit(0)) > 0)
            starts = before.isNull() | (before["level"] != x["level"]) | (F.trim(before["text"]) == "")
            return F.when(intro, F.lit("")).otherwise(F.concat(F.when(starts, F.concat(F.lit(CUT), x["level"].cast("string"), F.lit(LEVEL))).otherwise(F.lit("\n")), x["text"]))
        return F.split(F.array_join(F.transform(ls, piece), ""), CUT, -1)

    parted = F.transform(F.filter(bind(lines, runs), lambda p: F.contains(p, F.lit(LEVEL))), lambda p: F.struct(F.substring_index(p, LEVEL, 1).cast("int").alias("level"), F.regexp_replace(F.substring_index(p, LEVEL, -1), r"^\n+|\n+$", "").alias("text")))
    return F.filter(parted, lambda p: F.trim(F.regexp_replace(p["text"], BREAK, " ")) != "")


def key(text: Column) -> Column:
    """Two hashes and the length of a normalised passage."""
    n = normalised(text)
    return F.struct(F.xxhash64(n).alias("h1"), F.hash(n).alias("h2"), F.length(n).alias("size"))


def parsed(messages: DataFrame) -> DataFrame:
    """(id, conv_id, turn, role, body, own, quoted) of every row; own and quoted hold passage keys, quoted with levels."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), passages(F.col("text")).alias("p"))
    own, quoted = F.filter("p", lambda x: x["level"] == 0), F.filter("p", lambda x: x["level"] > 0)
    return rows.select(
        F.monotonically_increasing_id().alias("id"), "conv_id", "turn", "role",
        F.trim(F.array_join(F.transform(own, lambda x: x["text"]), "\n\n")).alias("body"),
        F.array_distinct(F.transform(own, lambda x: key(x["text"]))).alias("own"),
        F.array_distinct(F.transform(quoted, lambda x: F.struct(x["level"].alias("level"), key(x["text"]).alias("key"), normalised(x["text"]).alias("text")))).alias("quoted"),
    )


def bare_words(text: Column) -> Column:
    return words(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")))


def word_runs(text: Column) -> Column:
    """Keys of all runs of RUN words of a text, of all words of a shorter one; none without words."""
    def runs(ws: Column) -> Column:
        longer = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - RUN + 1, F.lit(1))), lambda i: key(F.array_join(F.slice(ws, i, F.lit(RUN)), " ")))
        return F.when(F.size(ws) > 0, longer)
    return bind(bare_words(text), runs)


def found_in_parts(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, level, key, part_first) of quoted passages whose runs of words were all said before.

    part_first is the latest of the messages that said a run first, which is the message quoted unless others said all its
    runs before. Quotes of fewer than RUN words have to be a whole line or sentence. Only conversations with such
    quotes are read again, and one row per run and conversation is joined.
    """
    said = rows.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").filter("turn is not null").select("conv_id", "turn", "id", F.explode(F.split("body", r"\n\n+")).alias("text"))
    short = F.filter(F.split("text", r"\n|(?<=[.!?])\s+"), lambda x: F.size(bare_words(x)) < RUN)
    pieces = said.select("conv_id", "turn", "id", F.explode(F.concat(F.array("text"), short)).alias("text"))
    first = pieces.select("conv_id", "turn", "id", F.explode(word_runs(F.col("text"))).alias("run")).groupBy("conv_id", "run").agg(F.min(F.struct("turn", "id")).alias("first"))
    parts = asked.select("id", "conv_id", "turn", "level", "key", F.explode(F.split("text", LEFT_OUT)).alias("part"))
    wanted = parts.select("id", "conv_id", "turn", "level", "key", F.explode(word_runs(F.col("part"))).alias("run"))
    met = wanted.join(first, ["conv_id", "run"], "left").withColumn("first", F.when(F.col("first.turn") < F.col("turn"), F.col("first")))
    return met.groupBy("id", "level", "key").agg(F.count("*").alias("n"), F.count("first").alias("found"), F.max("first").alias("first")).filter("n = found").select("id", "level", "key", F.col("first").alias("part_first"))


def parents(rows: DataFrame) -> DataFrame:
    """(id, n_quotes, n_linked, parent) of every message with quotes; parent is the (turn, id) of the message replied to.

    Every quoted passage is joined to the earliest message of the conversation that says it unquoted, whole or, where
    none does, in parts. The parent is the latest such message among the outermost quotes that are found; of messages
    of one turn the one stored first said it. One row per passage and conversation is joined, so that passages said
    very often add nothing.
    """
    said = rows.filter("turn is not null").select("conv_id", "turn", "id", F.explode("own").alias("key")).groupBy("conv_id", "key").agg(F.min(F.struct("turn", "id")).alias("first"))
    asked = rows.select("id", "conv_id", "turn", F.explode("quoted").alias("q")).select("id", "conv_id", "turn", F.col("q.level").alias("level"), F.col("q.key").alias("key"), F.col("q.text").alias("text"))
    met = durable(asked.join(said, ["conv_id", "key"], "left").withColumn("first", F.when(F.col("first.turn") < F.col("turn"), F.col("first"))))
    open_ = met.filter("first is null and conv_id is not null and turn is not null")
    if open_.limit(1).count():
        met = met.join(durable(found_in_parts(rows, open_)), ["id", "level", "key"], "left").withColumn("first", F.coalesce("first", "part_first"))
    nearest = F.max(F.when(F.col("first").isNotNull(), F.struct((-F.col("level")).alias("l"), F.col("first"))))
    return met.groupBy("id").agg(F.count("*").alias("n_quotes"), F.count("first").alias("n_linked"), nearest["first"].alias("parent"))


def roots(replies: DataFrame) -> DataFrame:
    """(id, root_turn, depth) of every message that replies; replies has (id, parent), which turns make acyclic.

    Pointer jumping over rows: each round doubles the stretch of the thread that is known, written to the shared folder.
    """
    at = durable(replies.select("id", F.col("parent.id").alias("root"), F.col("parent.turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = at.select(F.col("id").alias("root"), F.col("root").alias("further"), F.col("root_turn").alias("further_turn"), F.col("depth").alias("more"))
        step = durable(at.join(up, "root", "left").select(
            "id", F.coalesce("further", "root").alias("root"), F.coalesce("further_turn", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")))
        at = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            return at.drop("root")


def linked_conversations(messages: DataFrame) -> DataFrame:
    """One row per row of messages (conv_id, turn, role, text): (conv_id, position, turn, role, body, parent_turn,
    root_turn, depth, n_quotes, n_linked), position counting from 1 in each conversation.

    Threads follow each other by the turn of their first message, messages in a thread by turn, so that a reply
    comes after its parent. A message without a quote that is found starts a thread, also where another message of its
    turn replies. Null texts have empty bodies; rows without conv_id or turn link with nothing; repeated rows repeat, in
    a fixed order; other columns are not read. Quotes of later messages, or of nothing that was said, are dropped from
    bodies all the same.
    """
    rows = durable(parsed(messages))
    found = durable(parents(rows))
    threads = roots(found.filter("parent is not null").select("id", "parent"))
    named = rows.drop("own", "quoted").join(found, "id", "left").join(threads, "id", "left").withColumns({
        "parent_turn": F.col("parent.turn"), "root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0)), "n_quotes": F.coalesce("n_quotes", F.lit(0)), "n_linked": F.coalesce("n_linked", F.lit(0)), "text_hash": F.xxhash64("role", "body")})
    order = [F.col(c) for c in ("root_turn", "turn", "role", "text_hash", "id")]
    placed = number_rows(named.drop("parent"), ["conv_id"], order, "position")
    return placed.select("conv_id", F.col("position").cast("long").alias("position"), "turn", "role", "body", "parent_turn", "root_turn", "depth", "n_quotes", "n_linked")
