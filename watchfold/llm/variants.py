"""Spelling variant grouping by search schemes over a pair of FM-indices.

Two words are near if they differ by one inserted, deleted or replaced code point. Cut a word in two halves: one error
leaves one of them whole. So there are two schemes: the first half is matched exactly and extended to the right across
the second, allowing one error; or the second half is matched and extended to the left across the first. For either way
the delimited vocabulary has an FM-index of its own, over mirrored texts: a step takes the interval of suffix ranks of
what is matched, anchored at the delimiter, to that of one symbol more, by ranks in the Burrows-Wheeler transform.
Before the cut only the word's own symbol is taken; behind it, once, any other symbol (replaced or inserted) or none
(deleted). Intervals of few rows are not extended further: their words are compared with the asking word. Pairs that
both schemes find count in the first.

The vocabulary is dealt to shards by the first code points of a word (of its mirror image for the second scheme), which
near words share where the half is whole. Each shard has its own indices, of shard_words words or so (a word counts once
for every WORD_LENGTH code points, so that long words do not make a shard large); a group of more is split by hash, and its
words ask in every part. What leaves a shard is one row for an asking word: its number of near
words, and the best of them.

A word's form is its near word of the largest n (ties: the smallest in code-point order), if that is `ratio` times the
word's own n or more. Forms are followed by pointer doubling; as n grows by the ratio with each step, few rounds suffice.

Defined results: null texts have no words; a null id counts as an empty one; without near words n_near is 0; without a
form, the root is the word itself; no words give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lower_ascii

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Words of a shard: SHARD_WORDS, or fewer where that makes fewer shards than cores, down to LEAST_WORDS.
SHARD_WORDS, LEAST_WORDS = 32768, 2048
WORD_LENGTH = 16
#: Rows of an interval that are compared with the asking word, and not extended.
NARROW = 12
#: Code points up to which words are compared as rows of a matrix; and symbols of one block of asking words.
SHORT, BLOCK_CELLS = 64, 1 << 14
#: Rows up to which an interval's symbols are read one by one.
READ = 96


class Index:
    """The FM-index of words, extended from their beginnings to their ends."""

    def __init__(self, words: list[str]):
        self.words, self.n = words, len(words)
        flat, self.lengths, self.starts = spelled(words)
        self.alphabet = np.unique(flat)
        codes = np.searchsorted(self.alphabet, flat) + 1
        sigma = len(self.alphabet)
        # the text: each word backwards, and a delimiter (0) behind it
        rows = len(flat) + self.n
        owner = np.repeat(np.arange(self.n), self.lengths + 1)
        ends = np.cumsum(self.lengths + 1) - 1
        place = ends[owner] - np.arange(rows)
        text = np.zeros(rows, np.int64)
        text[place > 0] = codes[(self.starts[owner] + place - 1)[place > 0]]
        # suffixes sorted by prefix doubling; delimiters are ordered by their words
        rank = np.where(text == 0, owner, text + self.n)
        ahead = 1
        while True:
            key = rank * (rows + self.n + sigma + 1)
            key[: rows - ahead] += rank[ahead:] + 1
            order = np.argsort(key, kind="stable")
            fresh = np.append(0, key[order][1:] != key[order][:-1]).cumsum()
            rank = np.empty(rows, np.int64)
            rank[order] = fresh
            ahead *= 2
            if fresh[-1] == rows - 1 or ahead >= rows:
                break
        self.owner = owner[order]
        self.block = 32
        while self.block < sigma // 2:
            self.block *= 2
        kind = np.uint8 if sigma < 255 else np.uint32
        bwt = np.full(-(-(rows + 1) // self.block) * self.block, sigma + 2, kind)
        bwt[:rows] = text[order - 1]
        self.bwt, self.blocks = bwt, bwt.reshape(-1, self.block)
        counts = np.zeros((len(self.blocks) + 1, sigma + 2), np.int32)
        np.add.at(counts, (np.arange(rows) // self.block + 1, bwt[:rows]), 1)
        self.counts = counts.cumsum(axis=0, dtype=np.int32)
        # column sigma + 1 is for symbols that no word has
        self.first = np.concatenate([[0], self.n + np.concatenate([[0], np.cumsum(self.counts[-1, 1 : sigma + 1])])]).astype(np.int64)
        self.delimiters = np.flatnonzero(bwt[:rows] == 0)
        self.left, self.right = matrices(codes, self.starts, self.lengths)

    def coded(self, flat: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == flat, at + 1, len(self.alphabet) + 1)

    def before(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often the symbol stands in the transform before the row."""
        at, within = row // self.block, row % self.block
        part = (self.blocks[at] == symbol[:, None].astype(self.bwt.dtype)) & (np.arange(self.block) < within[:, None])
        return self.counts[at, symbol] + part.sum(axis=1)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[symbol] + self.before(symbol, lo), self.first[symbol] + self.before(symbol, hi)

    def symbols(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) of all symbols but the delimiter that may extend each interval."""
        few = hi - lo <= READ
        own, row = spread(np.flatnonzero(few), lo[few], hi[few])
        read = np.unique(own * 2**32 + self.bwt[row])
        every = np.flatnonzero(~few)
        sigma = len(self.alphabet)
        state = np.concatenate([read >> 32, np.repeat(every, sigma)])
        symbol = np.concatenate([read & (2**32 - 1), np.tile(np.arange(1, sigma + 1), len(every))])
        return state[symbol > 0], symbol[symbol > 0]

    def candidates(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asking word, word) of all that may be near, each once: those that begin with exact symbols of the asking word, with one error behind."""
        own = np.arange(len(lengths))
        lo, hi, at, wrong = np.zeros(len(own), np.int64), np.full(len(own), self.n), np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        found = []
        while len(own):
            narrow = hi - lo <= NARROW
            asks, row = spread(own[narrow], lo[narrow], hi[narrow])
            found.append(asks * self.n + self.owner[row])
            own, lo, hi, at, wrong = (x[~narrow] for x in (own, lo, hi, at, wrong))
            ended = at == lengths[own]
            # a word that ends here: one delimiter in the interval
            done = np.flatnonzero(ended & wrong)
            k = np.minimum(np.searchsorted(self.delimiters, lo[done]), self.n - 1)
            done, k = done[self.delimiters[k] < hi[done]], k[self.delimiters[k] < hi[done]]
            found.append(own[done] * self.n + self.owner[self.delimiters[k]])
            symbol = codes[np.minimum(starts[own] + at, len(codes) - 1)]
            go = np.flatnonzero(~ended)
            low, high = self.step(symbol[go], lo[go], hi[go])
            parts = [(own[go], low, high, at[go] + 1, wrong[go])]
            free = np.flatnonzero(~wrong & (at >= exact[own]))
            if len(free):
                state, other = self.symbols(lo[free], hi[free])
                low, high = self.step(other, lo[free][state], hi[free][state])
                state = free[state]
                new = (other != symbol[state]) | ended[state]
                # the word's own symbol inserted before itself is inserted behind it just as well
                parts.append((own[state][new], low[new], high[new], at[state][new], np.ones(new.sum(), bool)))
                new &= ~ended[state]
                parts.append((own[state][new], low[new], high[new], at[state][new] + 1, np.ones(new.sum(), bool)))
                drop = free[~ended[free]]
                again = (at[drop] > exact[own[drop]]) & (codes[starts[own[drop]] + at[drop] - 1] == symbol[drop])
                drop = drop[~again]
                parts.append((own[drop], lo[drop], hi[drop], at[drop] + 1, np.ones(len(drop), bool)))
            own, lo, hi, at, wrong = (np.concatenate(x) for x in zip(*parts, strict=True))
            some = lo < hi
            own, lo, hi, at, wrong = (x[some] for x in (own, lo, hi, at, wrong))
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs // self.n, pairs % self.n

    def near(self, asking: list[str], exact: np.ndarray, second: bool) -> tuple[np.ndarray, np.ndarray]:
        """(asking word, word) that are near and agree in exact symbols; for the second scheme, without those that the first finds."""
        flat, lengths, starts = spelled(asking)
        codes = self.coded(flat)
        own, word = self.candidates(codes, starts, lengths, exact)
        n, m = lengths[own], self.lengths[word]
        some = np.abs(n - m) <= 1
        own, word, n, m = own[some], word[some], n[some], m[some]
        head, tail = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        short = np.maximum(n, m) <= SHORT
        left, right = matrices(codes, starts, lengths)
        head[short] = agreeing(left[own[short]], self.left[word[short]])
        tail[short] = agreeing(right[own[short]], self.right[word[short]])
        for k in np.flatnonzero(~short):
            head[k], tail[k] = common(asking[own[k]], self.words[word[k]]), common(asking[own[k]][::-1], self.words[word[k]][::-1])
        least = np.minimum(n, m)
        head, tail = np.minimum(head, least), np.minimum(tail, least)
        alike = np.where(n == m, (head < n) & (head + tail == n - 1), head + tail >= least) & (head >= exact[own])
        if second:
            alike &= tail < n - exact[own]
        return own[alike], word[alike]


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words in one array, their lengths and starts."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return flat, lengths, np.cumsum(lengths) - lengths


def spread(own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own, row) for every row of intervals."""
    sizes = hi - lo
    return np.repeat(own, sizes), np.arange(sizes.sum()) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)


def matrices(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of up to SHORT symbols as rows, forwards and backwards, with zeros behind."""
    width = int(min(SHORT, lengths.max(initial=0))) + 1
    out = []
    for backwards in (False, True):
        k = np.arange(width)[None, :]
        at = starts[:, None] + (lengths[:, None] - 1 - k if backwards else k)
        fits = (k < lengths[:, None]) & (lengths[:, None] <= SHORT)
        out.append(np.where(fits, codes[np.clip(at, 0, max(0, len(codes) - 1))], 0).astype(np.int32))
    return out[0], out[1]


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading columns in which rows agree."""
    width = min(a.shape[1], b.shape[1])
    differ = a[:, :width] != b[:, :width]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), width)


def common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Asking words by length, in blocks of BLOCK_CELLS symbols or one word."""
    order = np.argsort(lengths, kind="stable")
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and lengths[order[b]] * (b - a + 1) <= BLOCK_CELLS:
            b += 1
        yield order[a:b]
        a = b


def count_words(docs: DataFrame, alter: Callable[[Column, Column], Column] | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all texts. alter: what becomes of a word, given the id as text and the word; it may not lengthen it."""
    runs = F.filter(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0)), lambda x: F.char_length(x) >= min_length)
    spread_ = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).withColumn("run", lower_ascii(F.col("run")))
    words = spread_.select((alter(F.col("id"), F.col("run")) if alter else F.col("run")).alias("word")).where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def with_losses(id_: Column, run: Column) -> Column:
    """A word, less one code point where the hash of id and word is divisible by 31."""
    h = F.crc32(F.concat(id_, F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def weight() -> Column:
    """How many words a word counts as."""
    return F.ceil(F.char_length("word") / WORD_LENGTH)


def dealt(words: DataFrame, second: bool, key: int, shard_words: int, n_words: int) -> DataFrame:
    """(second, shard, kind, word, n): each word in the shard that holds it (kind 0), and in those that it asks (kind 1)."""
    filed = words.withColumn("group", F.substring(F.reverse("word") if second else F.col("word"), 1, key))
    # groups of more than shard_words words: no more than n_words / shard_words
    hot = filed.groupBy("group").agg(F.sum(weight()).alias("size")).where(F.col("size") > shard_words)
    hot = F.broadcast(hot.select("group", F.ceil(F.col("size") / shard_words).cast("int").alias("parts")))
    small = F.pmod(F.xxhash64("group"), F.lit(max(1, -(-n_words // shard_words))))
    placed = filed.join(hot, "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    shard = lambda part: F.when(F.col("parts") > 1, F.xxhash64("group", part)).otherwise(small)
    held = F.struct(shard(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).alias("shard"), F.lit(0).alias("kind"))
    asks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda part: F.struct(shard(part).alias("shard"), F.lit(1).alias("kind")))
    return placed.select(F.lit(second).alias("second"), F.explode(F.concat(F.array(held), asks)).alias("x"), "word", "n").select("second", "x.shard", "x.kind", "word", "n")


def nearest(words: DataFrame, min_length: int = MIN_LENGTH, shard_words: int | None = None) -> DataFrame:
    """(word, n_near, best_n, best) of all words that have near ones. words: (word, n), distinct, of min_length code points or more (2 at least)."""
    n_words = words.agg(F.coalesce(F.sum(weight()), F.lit(0))).first()[0]
    if shard_words is None:
        shard_words = max(LEAST_WORDS, min(SHARD_WORDS, -(-n_words // words.sparkSession.sparkContext.defaultParallelism)))
    half = min_length // 2
    rows = dealt(words, False, half, shard_words, n_words).unionByName(dealt(words, True, min_length - half, shard_words, n_words))
    rows = rows.repartition(2 * max(1, -(-n_words // shard_words)), "second", "shard").sortWithinPartitions("second", "shard", "kind")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, index, place = None, [], None, None
        for batch in batches:
            for (second, shard), own in batch.groupby(["second", "shard"], sort=False):
                if (second, shard) != now:
                    now, held, index = (second, shard), [], None
                of_shard = own[own["kind"] == 0]
                if len(of_shard):
                    held.append(of_shard[["word", "n"]])
                asking = own[own["kind"] == 1]["word"].tolist()
                if not asking or not held:
                    continue
                if index is None:
                    known = pd.concat(held).sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
                    # words in order of preference, so that the least number is the best
                    index, place, held = Index([w[::-1] for w in known["word"]] if second else known["word"].tolist()), known, [None]
                lengths = np.array([len(w) for w in asking])
                for some in blocks(lengths):
                    texts = [asking[k][::-1] if second else asking[k] for k in some]
                    exact = lengths[some] - lengths[some] // 2 if second else lengths[some] // 2
                    one, two = index.near(texts, exact, bool(second))
                    asks, first, n = np.unique(one, return_index=True, return_counts=True)  # pairs ascend
                    words_ = np.array([asking[some[k]] for k in asks], object)
                    found = {"word": words_, "n_near": n, "best_n": place["n"].to_numpy()[two[first]], "best": place["word"].to_numpy(object)[two[first]]}
                    yield pd.DataFrame({k: pd.Series(v, dtype=v.dtype) for k, v in found.items()})

    found = rows.mapInPandas(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), "best")).alias("x")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("x.k")).alias("best_n"), "x.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling over forms (word, form); no word is its own form's form."""
    up = checkpointed(forms.select("word", F.col("form").alias("at")))
    while True:
        ahead = up.select(F.col("word").alias("at"), F.col("at").alias("next"))
        up = checkpointed(up.join(ahead, "at", "left").select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            return up.select("word", F.col("at").alias("root"))
        up = up.drop("moved")


def group_variants(words: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH, shard_words: int | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of words (word, n)."""
    words = checkpointed(words.select("word", F.col("n").cast("long").alias("n")))
    judged = words.join(nearest(words, min_length, shard_words), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    judged = checkpointed(judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


REPORT_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT [list_reduce([n, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FOR n IN range(256)] AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT w, n, [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(id || ':' || w)), '..')] AS b FROM low),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h FROM coded, crc),
altered AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM words)),
best AS (SELECT near.word, any_value(w.n) AS n, count(*) AS n_near, min({'k': -o.n, 'other': other}) AS x FROM near JOIN words w ON w.word = near.word JOIN words o ON o.word = other GROUP BY near.word),
forms AS MATERIALIZED (SELECT word, x.other AS form, -x.k AS form_n FROM best WHERE -x.k >= 10 * n),
walk AS (SELECT word, form AS root, 1 AS step FROM forms UNION ALL SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.root),
roots AS (SELECT word, max_by(root, step) AS root FROM walk GROUP BY word)
SELECT words.word, form, coalesce(root, words.word) AS root, words.n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN forms USING (word) LEFT JOIN roots USING (word) LEFT JOIN best USING (word)
"""
