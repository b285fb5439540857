"""Best-fit packing of documents into sequences, with certified lower bounds.

Documents become token ids with an end id behind each; one longer than a sequence is cut so that only its first piece
can be short. Full pieces fill a sequence each. The others are dealt to partitions of bounded size and packed there by
best-fit decreasing. A lower bound by dual feasible functions certifies a partition whose bins reach it. It keeps them,
but for the one with most room; a partition with a gap keeps only the full ones, which no packing can better. The other
bins are exchanged: dealt anew to as few partitions of bounded size as hold them, and packed and bounded again. A new
packing is used only if it takes fewer bins than those dealt. Rounds end when the total reaches the bound over the
lengths of all pieces, when one partition has packed all that was left, or when a round neither saves a bin nor lets the
next one do with fewer partitions.

Only lengths travel: ids are made where the text is read, and their checksum goes with the piece.

Defined results: a null or empty text is one piece of length 1, its end id; documents that repeat, and null doc_ids,
are packed as documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches

CAPACITY = 2048
END_ID = 0
#: Pieces that one partition packs, about.
PART_PIECES = 32_768
#: White space: runs of two and more that come in most texts, single characters that also come in runs, and those beyond ASCII.
RUNS, SPACES, WIDE_SPACES = ("  ", "\n\n", " \n", "\n "), "\t\r\v\f", "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What the vocabulary's pattern ends with, and what does the same, without a look ahead, for white space that stands alone.
RUNS_END, ALONE_END = r"|\s+(?!\S)|\s+", r"|\s"


class Ids:
    """Ids of texts as bytes, four for each, little-endian, by the vocabulary's ranks (tests compare them with `tokenizers`).

    In texts without runs of white space the pattern needs no look ahead, and so a quick automaton finds the words.
    Texts with the name of a special token are encoded by the tokenizer itself.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = public_tokenizers.PATTERN
        self.with_runs = tiktoken.Encoding("runs", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        alone = pattern.removesuffix(RUNS_END) + ALONE_END if pattern.endswith(RUNS_END) else pattern
        self.alone = tiktoken.Encoding("alone", pat_str=alone, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif any(x in text for x in RUNS) or any(x in text for x in SPACES) or not text.isascii() and any(x in text for x in WIDE_SPACES):
            ids = self.with_runs(text)
        else:
            ids = self.alone(text)
        return np.array(ids, "<u4").tobytes()


@lru_cache(2)
def ids_of(vocabulary: str, ranks: str) -> Ids:
    return Ids(vocabulary, ranks)


def cut(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a shuffle key of each piece. vocabulary and ranks: the same one for either library."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = ids_of(vocabulary, ranks)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out = []
            for row, text in enumerate(batch["text"]):
                ids = (encode(text) if isinstance(text, str) else b"") + end
                n = len(ids) // 4
                head = n % capacity or capacity
                for piece, (a, b) in enumerate(zip([0, *range(head, n, capacity)], range(head, n + 1, capacity), strict=True)):
                    out.append((row, piece, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])))
            made = pd.DataFrame(out, columns=["row", "piece", "start", "length", "ids_crc32"])
            made["doc_id"] = batch["doc_id"].astype("Int64").to_numpy()[made.pop("row").to_numpy(np.int64)]
            yield made[["doc_id", "piece", "start", "length", "ids_crc32"]]

    return docs.select("doc_id", "text").mapInPandas(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length by best-fit decreasing. Bins of equal room are alike, so rooms are kept as the bits of a number."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    of_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            own = of_room[room]
            b = own.pop()
            if not own:
                rooms ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[k], offsets[k] = b, capacity - room
        of_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins, offsets


def lower_bound(of: np.ndarray) -> int:
    """The best bound of two families of dual feasible functions on the bins for of[n] pieces of each length n up to the capacity.

    For e up to half the capacity: lengths over capacity - e count as whole bins, those under e not at all, others as they are.
    For k: lengths become floor((k + 1) n / capacity) / k, and stay as they are where that is no fraction.
    """
    capacity = len(of) - 1
    n = np.arange(capacity + 1)
    mass, number = np.cumsum(of * n), np.cumsum(of)
    e = np.arange(capacity // 2 + 1)
    large, under = number[-1] - number[capacity - e], np.maximum(e - 1, 0)
    best = int(np.max(large + -(-(mass[capacity - e] - np.where(e > 0, mass[under], 0)) // capacity)))
    for k in range(1, 21):
        part = (k + 1) * n
        value = np.where(part % capacity == 0, n * k, part // capacity * capacity)
        best = max(best, -(-int((of * value).sum()) // (k * capacity)))
    return best


def packed(capacity: int):
    """Packs the pieces of one part. Each row gets its bin, the part's gap to its bound, and whether the bin is to be exchanged."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = best_fit(part["length"].to_numpy(), capacity)
        number = bins.max() + 1
        old = part["bin"].nunique() if part["bin"].notna().all() else number + 1
        if number < old:
            part["bin"], part["offset"], part["fill"] = bins + (part["part"].iloc[0] << 32), offsets, np.bincount(bins, part["length"])[bins].astype(np.int64)
        part["gap"] = min(number, old) - lower_bound(np.bincount(part["length"], minlength=capacity + 1))
        loose = part["fill"] < capacity
        if part["gap"].iloc[0] == 0:
            loose &= part["bin"] == part["bin"].iloc[part["fill"].argmin()]
        part["loose"] = loose
        return part

    return pack


COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, fill long, gap long, loose boolean"


def pack(docs: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, **tokens) -> DataFrame:
    """The pieces with sequence_id and offset, and gap: by how many bins its last partition may miss the least number."""
    small_batches(docs.sparkSession)
    pieces = checkpointed(cut(docs, capacity, **tokens))
    full, short = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    of = np.zeros(capacity + 1, np.int64)
    for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # no more rows than the capacity
        of[r["length"]] = r["n"]
    bound = lower_bound(of)
    parts = max(1, -(-int(of.sum()) // part_pieces))
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length", F.monotonically_increasing_id()), F.lit(parts))
    todo = short.select("*", key.alias("part"), *[F.lit(None).cast("long").alias(c) for c in ("bin", "offset", "fill", "gap")])
    done, settled, before, round_ = [], 0, None, 0
    while True:
        now = checkpointed(todo.select(*todo.columns, F.lit(None).cast("boolean").alias("loose")).groupBy("part").applyInPandas(packed(capacity), COLUMNS))
        first = F.col("offset") == 0
        count = now.agg(F.count_if(first).alias("bins"), F.count_if(first & F.col("loose")).alias("open"), F.count_if("loose").alias("left")).first()
        total, fewer = settled + count["bins"], max(1, -(-count["left"] // part_pieces))
        if total <= bound or parts == 1 or not count["left"] or (before is not None and total >= before and fewer >= parts):
            done.append(now)
            break
        done.append(now.where("NOT loose"))
        settled, before, parts, round_ = total - count["open"], total, fewer, round_ + 1
        deal = F.pmod(F.xxhash64("bin", F.lit(round_)), F.lit(parts)) + F.lit(round_ << 24)
        todo = now.where("loose").drop("loose").withColumn("part", deal)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    single = full.select("*", F.lit(0).cast("long").alias("offset"), (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("gap"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap"]
    return out.withColumnRenamed("bin", "sequence_id").select(*columns).unionByName(single.select(*columns))
