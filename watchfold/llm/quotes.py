"""Quotation linking: reply-ordered conversations without quotes.

A line's quote level is the number of `>` that lead it. Quoted passages are runs of lines of one level, without blank
lines; they are normalised (lower case, single blanks) and hashed, and so are, of what each message says itself, the whole, its
paragraphs and its lines. A passage belongs to the first message of the conversation that says it; where that is no
earlier one, each of its lines of MIN_WORDS words or more is looked up by itself. A message replies to the latest
message that a passage of the shallowest level found belongs to, passages before single lines; so where the message
quoted at level 1 is missing or was edited, what that one quoted links. A message of whose quotes none is found opens a
thread, as does one without quotes.

Threads are found by pointer doubling over the replies. A conversation's order is thread by thread, by the place of the
thread's first message, and in order of turn within, so that a reply stands behind what it answers.
What a message says without its quotes, and without the line that announces a quote, is its body.

Defined results: a null text has a null body and takes part as a message without quotes; messages without a turn come
last in their conversation; messages that agree in conversation, turn and text are one and get the same results but
for their position; a null conv_id is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_key

#: Blanks and `>` up to the last `>`: one character class, which Java's expressions repeat without recursion.
LEAD = r"^([ \t>]*>)?"
ANNOUNCE = r"(?i)^\s*(on .{3,200} wrote|am .{3,200} schrieb .{1,200}|le .{3,200} a écrit|el .{3,200} escribió)\s*:\s*$"
BLANK = r"\n\s*\n"
#: What opens a quoted passage, and what ends its level's number; in texts they count as white space.
OPEN, UPTO = "\x01", "\x02"
MIN_WORDS = 3
CONV = ["no_conv", "conv"]


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, rf"[\s{OPEN}{UPTO}]+", " ")))


def passages(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, BLANK, -1), normalised), lambda p: p != "")


def hashed(x: Column) -> Column:
    return F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"))


def parsed(messages: DataFrame) -> DataFrame:
    """row, CONV, key (the message's place in its conversation), lines (level, said), body and quotes (level, kind, h)."""
    text = F.coalesce("text", F.lit(""))
    led = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), F.regexp_extract(x, LEAD, 1).alias("lead")))
    split = F.transform(led, lambda x: F.struct((F.length(x.lead) - F.length(F.replace(x.lead, F.lit(">")))).alias("level"), F.substr(x.line, F.length(x.lead) + 1).alias("said")))
    blank = lambda x: normalised(x) == ""
    level_at = lambda ls, k: F.coalesce(F.get(ls, k)["level"], F.lit(0))
    # of each line, whether its message says it, and whether it goes on with the passage before
    own = lambda ls, x, k: (x.level == 0) & ~(x.said.rlike(ANNOUNCE) & (level_at(ls, k + 1) > 0))
    goes_on = lambda ls, x, k: (k > 0) & F.when(k > 0, (level_at(ls, k - 1) == x.level) & ~blank(F.get(ls, k - 1)["said"])).otherwise(F.lit(False))
    # the array as a lambda's variable: as a column it could be computed anew for each of its elements
    lines = F.transform(F.array(split), lambda ls: F.transform(ls, lambda x, k: F.struct(x.level.alias("level"), x.said.alias("said"), own(ls, x, k).alias("own"), goes_on(ls, x, k).alias("goes_on"))))[0]
    key = F.struct(F.col("turn").isNull().alias("no_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), *text_key(F.col("text"))).alias("key")
    rows = messages.select(
        F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("row"), F.col("conv_id").isNull().alias("no_conv"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), key, "text", lines.alias("lines"),
    )
    rows = rows.withColumn("depth", F.array_max(F.transform("lines", lambda x: x.level)))
    said = F.array_join(F.transform("lines", lambda x: F.when(x.own, x.said).otherwise("")), "\n")
    kept = F.array_join(F.transform(F.filter("lines", lambda x: x.own), lambda x: x.said), "\n")
    wordy = lambda p: F.filter(F.transform(F.split(p, "\n", -1), normalised), lambda x: F.size(F.split(x, " ")) >= MIN_WORDS)
    bare = lambda x: F.translate(x, OPEN + UPTO, "  ")
    marked = F.transform("lines", lambda x: F.when((x.level == 0) | blank(x.said), OPEN).when(x.goes_on, bare(x.said)).otherwise(F.concat(F.lit(OPEN), x.level.cast("string"), F.lit(UPTO), bare(x.said))))
    pieces = F.filter(F.split(F.array_join(marked, "\n"), OPEN, -1), lambda p: F.contains(p, F.lit(UPTO)))
    tagged = lambda p, kind, text: F.struct(F.substring_index(p, UPTO, 1).cast("int").alias("level"), F.lit(kind).alias("kind"), hashed(text).alias("h"))
    quoted = lambda p: F.substring_index(p, UPTO, -1)
    quotes = F.flatten(F.transform(pieces, lambda p: F.concat(F.array(tagged(p, 0, normalised(quoted(p)))), F.transform(wordy(quoted(p)), lambda x: tagged(p, 1, x)))))
    units = F.array_distinct(F.concat(passages(F.col("said")), F.array(normalised(F.col("said"))), wordy(F.col("said"))))
    return (
        rows.withColumn("said", said)
        .withColumn("body", F.when(F.col("text").isNotNull(), F.when(F.col("depth") > 0, F.btrim(F.regexp_replace(kept, r"\n{3,}", "\n\n"), F.lit(" \t\n\r\v\f"))).otherwise(F.col("text"))))
        .withColumn("quotes", quotes)
        .withColumn("units", F.transform(F.filter(units, lambda u: u != ""), hashed))
        .select("row", *CONV, "key", "body", "quotes", "units")
    )


def replies(messages: DataFrame) -> DataFrame:
    """(CONV, key, parent, linked) of the messages that quote an earlier one. messages: as parsed."""
    quoted = messages.where(F.size("quotes") > 0).select(*CONV, "key", F.explode("quotes").alias("q")).select(*CONV, "key", "q.level", "q.kind", F.col("q.h.h1").alias("h1"), F.col("q.h.h2").alias("h2")).distinct()
    spoken = messages.select(*CONV, "key", F.explode("units").alias("u")).select(*CONV, "key", F.col("u.h1").alias("h1"), F.col("u.h2").alias("h2"))
    wanted = quoted.select(*CONV, "h1", "h2").distinct()
    by = [*CONV, "h1", "h2"]
    first = spoken.join(wanted, by, "left_semi").groupBy(*by).agg(F.min("key").alias("original"))
    found = quoted.join(first, by).where(F.col("original") < F.col("key"))
    nearest = F.struct((-F.col("level")).alias("shallow"), (-F.col("kind")).alias("whole"), "original")
    return found.groupBy(*CONV, "key").agg(F.max(nearest)["original"].alias("parent"), F.countDistinct(F.when(F.col("kind") == 0, F.struct("level", "h1", "h2"))).alias("linked"))


def threads(links: DataFrame) -> DataFrame:
    """(CONV, key, parent, root, depth, linked): pointers double until all stand at messages that answer nothing."""
    now = checkpointed(links.select(*CONV, "key", "parent", "linked", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select(*CONV, F.col("key").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        step = now.join(up, [*CONV, "root"], "left")
        now = checkpointed(
            step.select(*CONV, "key", "parent", "linked", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved"))
        )
        if now.where("moved").isEmpty():
            return now.drop("moved")


def grouped_position(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with position, from 0, within their group. Range partitions split a large group; only their counts meet."""
    sorted_ = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = checkpointed(sorted_.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("mid")))
    counts = placed.groupBy("pid", *group).agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("pid")) - F.col("n")
    starts = counts.select("pid", *group, "first", before.alias("before"))
    return placed.join(starts, ["pid", *group]).withColumn("position", F.col("before") + F.col("mid") - F.col("first")).drop("pid", "mid", "first", "before")


def link_quotes(messages: DataFrame) -> DataFrame:
    """row (all columns), body, quotes (passages), linked (those found), reply_to and thread (turns), depth and position."""
    read = parsed(messages)
    tied = threads(replies(read))
    rows = read.select("row", *CONV, "key", "body", F.size(F.filter("quotes", lambda q: q.kind == 0)).alias("quotes")).join(tied, [*CONV, "key"], "left")
    rows = rows.withColumn("root", F.coalesce("root", "key"))
    turn = lambda c: F.when(~F.col(f"{c}.no_turn"), F.col(f"{c}.turn"))
    return grouped_position(rows, CONV, ["root", "key"]).select(
        "row", "body", "quotes", F.coalesce("linked", F.lit(0)).cast("long").alias("linked"),
        turn("parent").alias("reply_to"), turn("root").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "position",
    )
