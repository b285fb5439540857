"""Benchmark decontamination by a positional inverted index over the corpus.

One pass over the documents stores the postings of every term that the benchmark has: (doc, term, pos), dealt by
document as the corpus is, in Parquet files of the checkpoint folder. A last posting of each document, of no term, holds
its number of words and its id, so that texts are read once. Copies keep postings of their own: no key is hotter
than a document is long.

A window is `width` consecutive words of an item (an item of fewer words is one window). Windows of equal words are one.
The index tells how often each term occurs; a window's terms are taken from the rarest. The lists of its `lists` rarest
terms, each moved back by the term's offset, are intersected by (document, window, start): a window with a term that the
corpus lacks has an empty list and is out. What is left, few candidates, is intersected with the lists of all other terms
in one join by (document, term, position). What has all terms is an exact phrase.

Proximity takes the same index: the rarest distinct terms of a window all within `slop` words of a place of the rarest.

Defined results: null texts have no words; rows are documents of their own, whatever their ids; items without words, or
null, have no windows; an item id in several rows is one item; items of a null id hit but are not named; an empty
benchmark or corpus gives no hits or no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, discard, lower_ascii, sent, stored

#: Runs of anything but ASCII characters that are neither letters nor digits.
RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 10
#: Terms whose lists are intersected first.
LISTS = 2
#: The term of a document's last posting.
END = -1


@dataclass
class Index:
    """postings (doc, doc_id, term, pos), the vocabulary (word, term, n) with each term's postings, and the folder."""

    postings: DataFrame
    vocabulary: DataFrame
    folder: str

    @property
    def lists(self) -> DataFrame:
        return self.postings.where(F.col("term") != END).select("doc", "term", "pos")

    @property
    def documents(self) -> DataFrame:
        return self.postings.where(F.col("term") == END).select("doc", "doc_id", F.col("pos").cast("long").alias("n_words"))

    def drop(self) -> None:
        discard(self.postings.sparkSession, self.folder)


def words(text: Column) -> Column:
    """The words of a text, as written; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), F.array().cast("array<string>"))


def windows_of(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(item, gram) of every window of every item, gram an array of words."""
    own = items.select(F.col(id_col).cast("string").alias("item"), F.transform(words(F.col(text_col)), lower_ascii).alias("words")).where(F.size("words") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))).alias("at")
    return own.select("item", "words", at).select("item", F.slice("words", F.col("at") + 1, width).alias("gram")).distinct()


def build(docs: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of docs for the terms of grams (gram)."""
    spark = docs.sparkSession
    terms = checkpointed(grams.select(F.explode("gram").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()))
    end = spark.createDataFrame([("", END)], "word string, term long")  # no word is empty
    known = sent(terms.unionByName(end), 24, F.octet_length("word"))
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("doc_id"), F.array_append(words(F.col(text_col)), F.lit("")).alias("words"))
    spread = rows.select("doc", "doc_id", F.posexplode("words").alias("pos", "word")).withColumn("word", lower_ascii(F.col("word")))
    named = F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id")
    postings, folder = stored(spread.join(known, "word").select("doc", named, "term", "pos"), "postings")
    counts = postings.where(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return Index(postings, checkpointed(terms.join(counts, "term", "left").select("word", "term", F.coalesce("n", F.lit(0)).alias("n"))), folder)


def ordered_terms(index: Index, grams: DataFrame) -> DataFrame:
    """(window, size, offset, term, rank) of the windows of which the corpus has all terms; rank 0 is the rarest."""
    spread = grams.select("window", F.size("gram").alias("size"), F.posexplode("gram").alias("offset", "word")).join(index.vocabulary, "word")
    own = Window.partitionBy("window")
    whole = spread.withColumn("least", F.min("n").over(own)).where("least > 0")
    return whole.withColumn("rank", F.row_number().over(own.orderBy("n", "offset")) - 1).select("window", "size", "offset", "term", "rank", "n")


def phrases(index: Index, grams: DataFrame, lists: int = LISTS) -> DataFrame:
    """(doc, window, start, size) of every occurrence of grams (window, gram), cut from its lineage."""
    terms = checkpointed(ordered_terms(index, grams))
    first = sent(terms.where(F.col("rank") < lists).select("term", "window", "size", "offset"), 40)
    start = (F.col("pos") - F.col("offset")).alias("start")
    adjusted = index.lists.join(first, "term").select("doc", "window", "size", start).where("start >= 0")
    met = adjusted.groupBy("doc", "window", "size", "start").agg(F.count(F.lit(1)).alias("n"))
    candidates = checkpointed(met.where(F.col("n") == F.least("size", F.lit(lists))).drop("n"))
    rest = candidates.where(F.col("size") > lists).join(terms.where(F.col("rank") >= lists).select("window", "term", "offset"), "window")
    needed = rest.select("doc", "window", "size", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
    near = index.lists.join(sent(candidates.select("doc").distinct(), 16), "doc", "left_semi")
    found = needed.join(near, ["doc", "term", "pos"]).groupBy("doc", "window", "size", "start").agg(F.count(F.lit(1)).alias("n"))
    whole = found.where(F.col("n") == F.col("size") - lists).drop("n")
    return checkpointed(candidates.where(F.col("size") <= lists).unionByName(whole).select("doc", "window", "start", "size"))


def proximities(index: Index, grams: DataFrame, slop: int = 30, lists: int = 4) -> DataFrame:
    """(doc, window, pos): places of a window's rarest term that have its `lists` rarest distinct terms within slop words."""
    terms = ordered_terms(index, grams)
    once = terms.groupBy("window", "term").agg(F.min("rank").alias("rank"))
    some = once.withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy("rank")) - 1).where(F.col("rank") < lists)
    some = checkpointed(some.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("window"))))
    anchors = index.lists.join(sent(some.where("rank = 0").select("term", "window", "k"), 24), "term").select("doc", "window", "k", F.col("pos").alias("at"))
    # a posting within slop words lies in the anchor's cell of slop words or in one beside it
    cell = F.floor(F.col("at") / slop)
    asked = anchors.join(some.where("rank > 0").select("window", "term"), "window").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    of_any = sent(some.where("rank > 0").select("term").distinct(), 16)
    others = index.lists.join(of_any, "term", "left_semi").withColumn("cell", F.floor(F.col("pos") / slop))
    hits = asked.join(others, ["doc", "term", "cell"]).where(F.abs(F.col("pos") - F.col("at")) <= slop).groupBy("doc", "window", "k", "at").agg(F.countDistinct("term").alias("n"))
    alone = anchors.where("k = 1").select("doc", "window", F.col("at").alias("pos"))
    return hits.where("n = k - 1").select("doc", "window", F.col("at").alias("pos")).unionByName(alone)


def covered(matches: DataFrame) -> DataFrame:
    """(doc, n_hit): the positions that matches (doc, start, size) cover."""
    upto = F.max(F.col("start") + F.col("size")).over(Window.partitionBy("doc").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", F.coalesce("upto", F.lit(0))))
    once = matches.select("doc", "start", "size").distinct().withColumn("upto", upto)
    return once.groupBy("doc").agg(F.sum(fresh.cast("long")).alias("n_hit"))


def numbered(windows: DataFrame) -> DataFrame:
    """(window, gram): the distinct grams with a number each."""
    return checkpointed(windows.select("gram").distinct().withColumn("window", F.monotonically_increasing_id()))


def spans(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", lists: int = LISTS) -> DataFrame:
    """doc_id, item_id, start and size (in words) of every occurrence of a window of an item."""
    windows = checkpointed(windows_of(items, item_col, text_col, width))
    grams = numbered(windows)
    index = build(docs, grams, id_col, text_col)
    named = windows.join(grams, "gram").select("window", F.col("item").alias("item_id"))
    found = phrases(index, grams, lists).join(index.documents, "doc").join(named, "window")
    out = checkpointed(found.select("doc_id", "item_id", "start", "size"))
    index.drop()
    return out


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", lists: int = LISTS) -> DataFrame:
    """Each document's doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    windows = checkpointed(windows_of(items, item_col, text_col, width))
    grams = numbered(windows)
    index = build(docs, grams, id_col, text_col)
    matches = phrases(index, grams, lists)
    named = windows.where("item IS NOT NULL").join(grams, "gram").select("window", "item")
    pairs = matches.select("doc", "window").distinct().join(named, "window").select("doc", "item").distinct()
    per_doc = pairs.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"), F.count(F.lit(1)).alias("n_items"))
    hits = covered(matches).join(per_doc, "doc", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = index.documents.join(hits, "doc", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
    out = checkpointed(out)
    index.drop()
    return out


LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
REPORT_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, coalesce(regexp_extract_all({LOWER_SQL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({LOWER_SQL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
begins AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - {WIDTH}, 0) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, w[i + 1 : i + {WIDTH}] AS gram FROM begins),
sizes AS (SELECT DISTINCT len(gram) AS size FROM windows),
starts AS (SELECT doc, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size),
places AS (SELECT doc, i, size, array_to_string(w[i + 1 : i + size], ' ') AS gram FROM starts),
met AS (SELECT doc, i, size, item_id FROM places JOIN (SELECT item_id, array_to_string(gram, ' ') AS gram FROM windows) USING (gram)),
hit AS (SELECT doc, count(*) AS n_hit FROM (SELECT DISTINCT doc, unnest(range(i, i + size)) AS p FROM met) GROUP BY doc),
named AS (SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY doc)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc) LEFT JOIN named USING (doc)
"""
