"""Line dedup by a suffix array over line-ID sequences.

Every document is a sequence of its lines with words (blank lines aside), each line an ID of 128 hashed bits, taken
without the white space at its end (lines that end in \\r\\n equal those that end in \\n). The
suffixes of all sequences are ordered by distributed prefix doubling: rank 0 orders suffixes by their first line,
and rank k + 1 by the pair of rank k at the suffix and rank k at 2**k lines on. Each round sorts the distinct pairs
by range over the cluster and numbers them in that order. Suffixes that differ from all others are settled and leave
the rounds, so the work falls from round to round.

Suffixes of equal rank k form a longest-common-prefix interval of depth 2**k, and two such intervals that overlap make
one of any depth between. A repeated run counts from min_words words. To find all of them it is enough to look at
the shortest run of that many words from each line forwards and from each line backwards: a line lies in a repeated
run of min_words words exactly if it lies in one of those that occurs earlier. They have at most min_words lines,
and so log2(min_words) rounds suffice.

Of each such run the first occurrence stays, first by (doc_id with nulls last, text hash, line), and the lines of all
later ones are deleted. Occurrences may overlap: of a line of enough words that fills a document only the first stays.

Defined results: a blank line goes with the line before it, and stays at a text's start; null and empty texts stay as
they are; rows that agree in doc_id and text are one document and get the same result; a document of which all lines
went has an empty text; an empty table gives an empty result; lines are split at \\n alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, discard, stored, text_key, whole_row

MIN_WORDS = 50
BLANKS = " \t\r\v\f"
DOC = ["no_id", "id", "th1", "th2"]


def sequences(docs: DataFrame) -> DataFrame:
    """The lines with words of each document: DOC, pos (from 0), line (number in the text), upto (the last of the
    blank lines behind it, or itself), l1, l2 (ID) and words."""
    bare = lambda x: F.rtrim(x, F.lit(BLANKS))
    numbered = F.transform(
        F.split("text", "\n", -1),
        lambda x, k: F.struct(k.alias("line"), F.xxhash64(bare(x)).alias("l1"), F.xxhash64(F.lit(7), bare(x)).alias("l2"), F.regexp_count(x, F.lit(WORD)).alias("words")),
    )
    keyed = docs.where("text IS NOT NULL").select(
        *doc_key(), F.size(F.split("text", "\n", -1)).alias("n"), F.filter(numbered, lambda x: x.words > 0).alias("lines")
    )
    once = keyed.where(F.size("lines") > 0).groupBy(*DOC).agg(F.first("n").alias("n"), F.first("lines").alias("lines"))
    upto = F.coalesce(F.get("lines", F.col("pos") + 1)["line"], F.col("n")) - 1
    lines = once.select(*DOC, "n", "lines", F.posexplode("lines").alias("pos", "x"))
    return lines.select(*DOC, "pos", "x.line", upto.alias("upto"), "x.l1", "x.l2", "x.words")


def doc_key() -> list[Column]:
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"), *text_key(F.col("text"))]


def ranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows numbered in the order of by, as rank: range-partitioned, sorted, and numbered across partitions."""
    return checkpointed(pairs.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))


def repeated(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def doubled_ranks(first: DataFrame, rounds: int) -> DataFrame:
    """(DOC, pos, k, rank) for each k up to rounds of the suffixes whose first 2**k lines occur more than once.

    first: the ranks of k = 0. Equal ranks of one k are a longest-common-prefix interval of depth 2**k.
    """
    level = first.select(*DOC, "pos", "rank")
    levels = [level.withColumn("k", F.lit(0))]
    along = Window.partitionBy(*DOC).orderBy("pos")
    for k in range(rounds):
        ahead = F.max("rank").over(along.rangeBetween(1 << k, 1 << k))
        pairs = level.withColumn("next", ahead).where("next IS NOT NULL").withColumnRenamed("rank", "head")
        names = ranked(repeated(pairs, ["head", "next"]), ["head", "next"])
        level = checkpointed(pairs.join(names, ["head", "next"]).select(*DOC, "pos", "rank"))
        levels.append(level.withColumn("k", F.lit(k + 1)))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def shortest_runs(first: DataFrame, min_words: int) -> DataFrame:
    """(DOC, start, size): from each line forwards, and from each backwards, the fewest lines that have min_words words.

    Only runs without a line that is unique count. With the words before each line as its place, the lines of the run
    forwards are those that begin within min_words words; backwards, those that end within them.
    """
    doc = Window.partitionBy(*DOC).orderBy("pos")
    part = Window.partitionBy(*DOC, "part")
    forwards = part.orderBy("before").rangeBetween(0, min_words - 1)
    backwards = part.orderBy("after").rangeBetween(-min_words + 1, 0)
    lines = (
        first.withColumn("part", F.col("pos") - F.row_number().over(doc))
        .withColumn("after", F.sum(F.col("words").cast("long")).over(part.orderBy("pos")))
        .withColumn("before", F.col("after") - F.col("words"))
        .withColumn("ahead", F.count(F.lit(1)).over(forwards))
        .withColumn("end", F.max("after").over(forwards))
        .withColumn("behind", F.count(F.lit(1)).over(backwards))
        .withColumn("begin", F.min("before").over(backwards))
    )
    ahead = F.when(F.col("end") - F.col("before") >= min_words, F.struct(F.col("pos").alias("start"), F.col("ahead").cast("int").alias("size")))
    behind = F.when(
        F.col("after") - F.col("begin") >= min_words, F.struct((F.col("pos") - F.col("behind") + 1).cast("int").alias("start"), F.col("behind").cast("int").alias("size"))
    )
    return lines.select(*DOC, F.explode(F.array_distinct(F.array_compact(F.array(ahead, behind)))).alias("run")).select(*DOC, "run.start", "run.size").distinct()


def later_copies(runs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The (DOC, start, size) that occur earlier."""
    power = sum(((F.col("size") >= 1 << k).cast("int") for k in range(1, 31)), F.lit(0))
    at = runs.withColumn("k", power).withColumn("pos2", (F.col("start") + F.col("size") - F.expr("shiftleft(1, k)")).cast("int"))
    head = ranks.select(*DOC, "k", F.col("pos").alias("start"), F.col("rank").alias("head"))
    tail = ranks.select(*DOC, "k", F.col("pos").alias("pos2"), F.col("rank").alias("tail"))
    # both are written, so that a class of many copies meets its first one in a join that can be split
    named = checkpointed(at.join(head, [*DOC, "k", "start"]).join(tail, [*DOC, "k", "pos2"]).select("size", "head", "tail", F.struct(*DOC, "start").alias("place")))
    firsts = checkpointed(named.groupBy("size", "head", "tail").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1"))
    later = named.join(firsts, ["size", "head", "tail"]).where("place != first")
    return later.select("place.*", "size")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of docs as row, with text without its deleted lines, lines and deleted (their numbers)."""
    lines, folder = stored(sequences(docs), "lines")  # read twice, hashed once
    names = ranked(repeated(lines, ["l1", "l2"]), ["l1", "l2"])
    first = checkpointed(lines.join(names, ["l1", "l2"]).select(*DOC, "pos", "line", "upto", "words", "rank"))
    discard(docs.sparkSession, folder)
    later = later_copies(shortest_runs(first, min_words), doubled_ranks(first, min_words.bit_length() - 1))
    gone = later.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*DOC).orderBy("pos"))
    cuts = (
        gone.join(first.select(*DOC, "pos", "line", "upto"), [*DOC, "pos"])
        .withColumn("island", island)
        .groupBy(*DOC, "island")
        .agg(F.min("line").alias("a"), F.max("upto").alias("b"), F.count(F.lit(1)).alias("n"))
        .groupBy(*DOC)
        .agg(F.array_sort(F.collect_list(F.struct("a", "b", "n"))).alias("cuts"))
    )
    rows = docs.select(whole_row(docs), F.col("text"), *doc_key())
    stay_from = lambda cuts, j: F.when(j == 0, F.lit(0)).otherwise(F.get(cuts, j - 1)["b"] + 1)
    stay_to = lambda cuts, j, n: F.coalesce(F.get(cuts, j)["a"], n)
    stretch = lambda lines, cuts, j: F.slice(lines, stay_from(cuts, j) + 1, stay_to(cuts, j, F.size(lines)) - stay_from(cuts, j))
    kept = F.transform(
        F.array(F.split("text", "\n", -1)),
        lambda lines: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda j: stretch(lines, F.col("cuts"), j))), "\n"),
    )
    return rows.join(cuts, DOC, "left").select(
        "row",
        F.when(F.col("cuts").isNull(), F.col("text")).otherwise(kept[0]).alias("text"),
        F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long").alias("lines"),
        F.coalesce(F.aggregate("cuts", F.lit(0).cast("long"), lambda n, c: n + c.b - c.a + 1), F.lit(0).cast("long")).alias("deleted"),
    )


def dedup_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with their texts deduplicated; documents that lost all their words go."""
    done = dedup_lines(docs, min_words).where((F.col("deleted") == 0) | F.col("text").rlike(WORD) | F.col("text").isNull())
    return done.select(*[(F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
