"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to three bytes long is counted over the lower-cased texts of a bounded sample
of labelled documents. A byte seen in its context costs -log2(count / (total + kinds)) bits; one not seen costs the escape
-log2(kinds / (total + kinds)) and is then coded in the context shorter by a byte, down to 8 bits flat (method C,
without exclusion). The statistics are frozen before scoring, so the code length of a byte depends on its last three
neighbours only, and whole texts are scored by table lookups, batch by batch, in bounded memory.

A text's prediction is the language with the shortest code, ties to the smaller name; its score is that language's
share of 2 ** -length over all languages.

Bound of the sample: SAMPLE_DOCS documents a language are expected (each drawn by a hash of its doc_id with
probability SAMPLE_DOCS / labelled documents of that language), of whole texts. The counts grow with the sample only, and
their number and that of the languages are checked before they are gathered and broadcast; more raise an error.

Defined results: null texts and texts without a letter are `und` with score 0; with no labelled document every text
is; null doc_ids are not held out and not learned from; repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches

ORDER = 3
SAMPLE_DOCS = 1500
MAX_MODEL_BYTES = 512 << 20
MAX_LANGS = 1000
#: A text is in none of the languages if it costs more than SLACK_BITS, which a key or two may take, and MAX_BITS for each byte. Text of a learned language
#: takes 2.2 bits a byte (held-out documents of sf0.1; at most 4.7), random letters and digits about 6, an unknown script about 8.
MAX_BITS, SLACK_BITS = 5.0, 256
#: Nor is a text in a language of which letters are less than this share (all characters beyond ASCII count as letters; white space does not count).
#: Prose has 0.9 and more, prose with marks behind each word 0.6, tables of numbers and keys less than 0.4.
MIN_LETTERS = 0.5
NOT_LETTERS = bytes(x for x in range(256) if not (97 <= x <= 122 or x >= 0xC0))
SPACE = bytes([*range(9, 14), 32, *range(0x80, 0xC0)])
LETTER = re.compile(r"[^\W\d_]")
START = b"\n" * ORDER
#: Positions scored at once, and text bytes gathered for that.
SLICE = 1 << 18


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte from position ORDER on, it and the order bytes before it as one number."""
    key = data[ORDER:].astype(np.uint32)
    for k in range(1, order + 1):
        key |= data[ORDER - k : len(data) - k].astype(np.uint32) << np.uint32(8 * k)
    return key


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each behind START, as one array; and of each position from ORDER on the text's number, or -1."""
    data = np.frombuffer(b"".join(x for t in texts for x in (START, t)), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths + ORDER)
    starts = np.concatenate([[0], np.cumsum(lengths + ORDER)[:-1]])
    for k in range(ORDER):
        owner[starts + k] = -1
    return data, owner[ORDER:]


def coded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def letter_share(data: bytes) -> float:
    """Letters' share of a coded text's characters; bytes that continue a character do not count."""
    return len(data.translate(None, NOT_LETTERS)) / max(1, len(data.translate(None, SPACE)))


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (lang, order, key) in each batch of (lang, text)."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            data, owner = joined([coded(t) for t in texts])
            for order in range(ORDER + 1):
                key, n = np.unique(grams(data, order)[owner >= 0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "ord": order, "key": key.astype(np.int64), "n": n})


class Model:
    """Frozen code lengths of every language, as sorted tables by order."""

    def __init__(self, langs: list[str], counts: pd.DataFrame):
        self.langs = langs
        size = len(langs)
        self.keys: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        place = {lang: k for k, lang in enumerate(langs)}
        lower = lambda key, order: np.full((len(key), size), 8.0)
        for order in range(ORDER + 1):
            rows = counts[counts["ord"] == order]
            key = rows["key"].to_numpy(np.uint32)
            keys, at = np.unique(key, return_inverse=True)
            n = np.zeros((len(keys), size))
            n[at, rows["lang"].map(place).to_numpy(np.int64) if len(rows) else []] = rows["n"].to_numpy()
            contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escapes = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(n / (total + kinds)[of])
            shorter = lower(keys & np.uint32(2 ** (8 * order) - 1), order - 1) if len(keys) else n
            self.keys.append(keys)
            self.contexts.append(contexts)
            self.bits.append(np.where(n > 0, seen, escapes[of] + shorter).astype(np.float32))
            self.escapes.append(escapes.astype(np.float32))
            lower = self.cost

    def cost(self, key: np.ndarray, order: int) -> np.ndarray:
        """Bits of each gram in each language."""
        if order < 0:
            return np.full((len(key), len(self.langs)), 8.0, np.float32)
        keys = self.keys[order]
        if not len(keys):
            return self.cost(key & np.uint32(2 ** (8 * order) - 1), order - 1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out = self.bits[order][at]
        if len(miss := np.flatnonzero(keys[at] != key)):
            context, known = key[miss] >> np.uint32(8), self.contexts[order]
            up = np.minimum(np.searchsorted(known, context), len(known) - 1)
            escape = np.where((known[up] == context)[:, None], self.escapes[order][up], np.float32(0))
            out[miss] = escape + self.cost(key[miss] & np.uint32(2 ** (8 * order) - 1), order - 1)
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits, texts by languages."""
        data, owner = joined(texts)
        out = np.zeros((len(texts), len(self.langs)))
        for k in range(0, len(owner), SLICE):
            own, part = owner[k : k + SLICE], data[k : k + SLICE + ORDER]
            inside = np.flatnonzero(own >= 0)
            if not len(inside):
                continue
            first, last = own[inside[0]], own[inside[-1]]
            cost = self.cost(grams(part, ORDER)[inside], ORDER)
            for x in range(len(self.langs)):
                out[first : last + 1, x] += np.bincount(own[inside] - first, cost[:, x], last - first + 1)
        return out

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        """lang, score and bits a byte of the prediction, and letters (their share), for each text."""
        lang, score, bits, letters = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        todo: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> None:
            if todo:
                lengths = self.lengths([t for _, t in todo])
                best = lengths.argmin(axis=1)
                least = lengths[np.arange(len(todo)), best]
                share = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1)
                for (k, t), b, s, x in zip(todo, best, share, least, strict=True):
                    lang[k], score[k], bits[k], letters[k] = self.langs[b], s, x / len(t), letter_share(t)
                todo.clear()

        for k, text in enumerate(texts):
            if self.langs and isinstance(text, str) and LETTER.search(text):
                todo.append((k, coded(text)))
                held += len(todo[-1][1])
                if held >= SLICE:
                    flush()
                    held = 0
        flush()
        return pd.DataFrame({"lang": lang, "score": score, "bits": bits, "letters": letters})


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of the labelled documents that are not held out."""
    labelled = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # a row for each language, as the model itself has
    per_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(per_lang) > MAX_LANGS:
        raise ValueError(f"there are more than {MAX_LANGS} languages in the labels")
    share = F.create_map(*[F.lit(x) for lang, n in sorted(per_lang.items()) for x in (lang, sample_docs / n)]) if per_lang else F.lit(None)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(draw < (share[F.col("lang")] if per_lang else F.lit(0.0))).where("text IS NOT NULL")
    counted = sample.select("lang", "text").mapInPandas(count_grams, "lang string, ord int, key long, n long")
    counted = checkpointed(counted.groupBy("lang", "ord", "key").agg(F.sum("n").alias("n")))
    # a gram seen in one language takes a number in each of them
    if (size := counted.count() * 8 * (1 + len(per_lang))) > MAX_MODEL_BYTES:
        raise ValueError(f"the model may take {size} bytes, over {MAX_MODEL_BYTES}; lower sample_docs")
    counts = counted.toPandas()
    return Model(sorted(counts["lang"].unique()), counts)


def predictor(docs: DataFrame, model: Model):
    """A column function: text to struct(lang, score, bits, letters)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, bits double, letters double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shared.value.predict(texts)

    return predict


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, and bits: code length a byte."""
    predict = predictor(docs, learn(docs, sample_docs))
    said = docs.select("doc_id", predict("text").alias("said"))
    return said.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        F.col("said.lang").alias("lang_pred"), F.col("said.score").alias("score"), F.col("said.bits").alias("bits"),
    )


def keep_identified(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, max_bits: float = MAX_BITS, min_letters: float = MIN_LETTERS, wanted: list[str] | None = None) -> DataFrame:
    """The documents in some language, or in one of the wanted.

    Those left out have no letter, have less than min_letters of them and cost that of SLACK_BITS or more (a short text
    may be a key or a number and a few words), or cost over max_bits a byte, and SLACK_BITS, in every language.
    """
    predict = predictor(docs, learn(docs, sample_docs))
    said = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predict("text").alias("said"))
    size = F.octet_length(F.lower("text"))
    good = (F.col("said.lang") != "und") & (F.col("said.bits") <= max_bits + SLACK_BITS / size)
    good &= (F.col("said.letters") >= min_letters) | (F.col("said.bits") * size < SLACK_BITS)
    if wanted is not None:
        good &= F.col("said.lang").isin(wanted)
    return said.where(good).select("row.*")
