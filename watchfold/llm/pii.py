"""Keyed surrogates for personal data.

Entities (e-mail addresses, phone numbers, IPv4 addresses that are no version numbers, account numbers with a valid check
digit, social security numbers, IBANs, secrets behind a keyword, and names) get surrogates of the same kind and form:
letters stay letters of their script and case, vowels vowels, digits digits; punctuation, country codes, top-level
domains, the network class of an address and the validity of a check digit stay. Given names of a list move within the list of their gender and script, in
one cycle, so that none stays; other names keep their last letter, which carries gender in many languages.

A name is the whole run of capitalised words behind a form of address, or a listed given name with those behind it; each
of its words is then replaced wherever the same document has it with a capital letter.

A surrogate is a keyed permutation (a Feistel network with cycle walking) of all values of the entity's form, in blocks
of BLOCK characters of which each one's key depends on those before it, so that entities may be of any length. So equal
entities get equal surrogates everywhere, in whatever way they are written, and different ones different surrogates,
without a table. What a permutation cannot see is checked over the corpus: all distinct entities are gathered, and those
whose surrogate is itself an entity of the corpus, or that of another entity, draw again until none is left. After TRIES
draws the form counts as full, and its values get longer by a character a draw (an IP address leaves its network class),
which makes room for any number of entities. A listed given name may become another that occurs: the lists are public.
Only those that drew again are joined back to documents; all others are replaced where the text is read.

Defined results: null texts stay null, texts without entities stay as they are; ties go to the kind listed first, then
to the longer match; repeated rows are replaced alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_key

KEY = "surrogates-1"
#: Draws within an entity's form, before its surrogate may get longer.
TRIES = 12
#: Draws after which the run fails, rather than leave a collision: longer values are all free by then, addresses are used up.
MAX_DRAWS = 64
#: Bytes of the entities that drew again, with their texts' keys, up to which these are sent to all executors instead of
#: shuffling all texts.
BROADCAST_BYTES = 16 << 20
#: Characters that are permuted at once.
BLOCK = 32
VOWELS, CONSONANTS, DIGITS = "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789"
#: Letters that change places, by script.
CLASSES = (VOWELS, CONSONANTS, DIGITS, "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
CLASS_OF = {x: group for group in CLASSES for x in group}
#: Given names by gender and script.
GIVEN = {
    "f": ("Anna Maria Laura Julia Sofia Clara Emma Sarah Alice Helena Nina Paula Marie Louise Ellen Jane", "Анна Мария Ольга Елена Ирина Наталья Светлана Татьяна"),
    "m": ("John Peter Paul Thomas Martin David Daniel Robert Michael Hans Pierre Carlos Miguel Frank Louis James", "Иван Пётр Сергей Андрей Дмитрий Алексей Николай Михаил"),
}
LISTS = [(gender, names.lower().split()) for gender, scripts in GIVEN.items() for names in scripts]
TITLES = {"m": "Mr|Sir|Herr|Señor|Sr|Monsieur|Don|Господин|Г-н", "f": "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Doña|Госпожа|Г-жа"}
ADDRESS = rf"(?:{TITLES['m']}|{TITLES['f']}|Dr|Prof)"
NAME = rf"(?!{ADDRESS}(?!\w))[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]+[^\W\d_]*"
PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})(?:\.[A-Za-z0-9-]{1,63})+"), "@"),
    ("secret", re.compile(r"(?i)(?:token|secret|password|api_?key)\s*[=:]\s*[\"']?([A-Za-z0-9_+/-]{12,})"), None),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), None),
    ("phone", re.compile(r"(?<![\w.+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"), None),
    ("account", re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-])"), None),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), None),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"), None),
)
TITLED = re.compile(rf"(?<!\w)(?:{ADDRESS}\.? )+(?P<name>{NAME}(?:[ -]{NAME})*)")
#: Literals first and what is before them after, by which the search skips to their first letters.
GIVEN_FIRST = re.compile(rf"(?P<name>(?:{'|'.join(rf'{x}(?<!\w{x})' for _, own in LISTS for x in (y.title() for y in own))})(?:[ -]{NAME})+)")
WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"\d[\d .()-]{4}")
#: What a dotted quad behind it is a version of.
VERSION = re.compile(r"(?i)(?:version|release|build|section|chapter|\bv|§)[ .:]{0,2}$")
HEX = "0123456789abcdef"
DIGITS_ONLY, HEX_ONLY = re.compile("[0-9]+"), re.compile("[0-9a-f]+")
KEYWORD = re.compile(r"(?i)token|secret|password|api_?key")


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    #: The same for all ways of writing it.
    norm: str


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for k, d in enumerate(reversed(digits))) % 10 == 0


def issued(ssn: str) -> bool:
    """Whether a number may have been given out."""
    return ssn[:3] not in ("000", "666") and ssn[0] != "9" and ssn[3:5] != "00" and ssn[5:] != "0000"


def network(ip: str) -> str:
    a, b = map(int, ip.split(".")[:2])
    if a == 10 or a == 172 and 16 <= b < 32 or a == 192 and b == 168:
        return "private"
    return "loopback" if a == 127 else "zero" if a == 0 else "multicast" if a >= 224 else "public"


def normal(kind: str, text: str) -> str:
    if kind in ("phone", "account", "iban", "ssn"):
        out = re.sub(r"[^A-Z0-9]", "", text)
        return out[1:] if kind == "phone" and len(out) == 11 and out[0] == "1" else out
    return text.lower() if kind in ("email", "name") else text


def entities(text: str) -> list[Entity]:
    """The entities of a text, in order, none within another."""
    found: list[tuple[int, Entity]] = []
    if DIGIT.search(text) or "@" in text or KEYWORD.search(text):
        for rank, (kind, pattern, sign) in enumerate(PATTERNS):
            if sign is None or sign in text:
                for m in pattern.finditer(text):
                    start, end = m.span(pattern.groups)
                    if kind == "email":  # a full stop before the address ends a sentence
                        end -= len(m[0]) - len(m[0].rstrip(".-"))
                    if kind == "account" and not luhn(normal(kind, m[0])) or kind == "ip" and VERSION.search(text, max(0, start - 12), start):
                        continue
                    found.append((rank, Entity(start, end, kind, normal(kind, text[start:end]))))
    names = {normal("name", word) for pattern in (TITLED, GIVEN_FIRST) for m in pattern.finditer(text) for word in WORD.findall(m["name"])}
    if names:
        for m in WORD.finditer(text):
            if (norm := normal("name", m[0])) in names and not m[0][0].islower():
                found.append((len(PATTERNS), Entity(*m.span(), "name", norm)))
    found.sort(key=lambda x: (x[0], x[1].start - x[1].end, x[1].start))
    out: list[Entity] = []
    for _, x in found:
        at = bisect(out, x)
        if (not at or out[at - 1].end <= x.start) and (at == len(out) or x.end <= out[at].start):
            out.insert(at, x)
    return out


def digest(*parts: str | bytes) -> bytes:
    return hashlib.sha256(b"|".join(x if isinstance(x, bytes) else x.encode("utf-8", "replace") for x in parts)).digest()


def permuted(number: int, size: int, key: bytes) -> int:
    """A keyed permutation of range(size), for sizes up to about 2**200."""
    a = int(size**0.5) + 1 if size < 1 << 50 else 1 << (size.bit_length() // 2 + 1)
    b = -(-size // a)
    draw = lambda k, x, m: int.from_bytes(hashlib.blake2b(f"{k}:{x}".encode(), key=key, digest_size=24).digest(), "big") % m
    while True:
        left, right = divmod(number, b)
        for k in range(4):
            left = (left + draw(2 * k, right, a)) % a
            right = (right + draw(2 * k + 1, left, b)) % b
        number = left * b + right
        if number < size:
            return number


def respelled_block(text: str, groups: list[str], key: bytes) -> str:
    size, number, out = 1, 0, []
    for x, g in zip(text, groups, strict=True):
        size, number = size * len(g), number * len(g) + g.index(x)
    number = permuted(number, size, key)
    for g in reversed(groups):
        number, k = divmod(number, len(g))
        out.append(g[k])
    return "".join(reversed(out))


def respelled(text: str, key: str, valid: Callable[[str], bool] = lambda _: True, alphabet: str = "") -> str:
    """A keyed permutation of the texts of the same form: each letter or digit stays in its class, or in alphabet."""
    groups = [alphabet or CLASS_OF.get(x, x) for x in text]
    start = digest(key, *(g[0] for g in groups))
    while True:
        out, chain = [], start
        for k in range(0, len(text), BLOCK):
            out.append(respelled_block(text[k : k + BLOCK], groups[k : k + BLOCK], chain))
            chain = digest(chain, text[k : k + BLOCK])
        text = "".join(out)
        if valid(text):
            return text


def in_cycle(name: str, names: list[str], key: str) -> str:
    """Another name of the list: a keyed permutation of one cycle."""
    order = sorted(names, key=lambda x: hashlib.blake2b(f"{key}|{x}".encode(), digest_size=16).digest())
    return order[(order.index(name) + 1) % len(order)]


def lengthened(kind: str, norm: str, more: int, key: str) -> str:
    """A keyed draw from values that are longer by some characters, for entities whose own form is full."""
    key = f"{key}|{norm}"
    if kind == "email":
        local, _, domain = norm.partition("@")
        return surrogate(kind, f"{local}{'b' * more}@{domain}", 0, key)
    if kind == "ip":
        number = permuted(int.from_bytes(bytes(map(int, norm.split("."))), "big"), 1 << 32, digest(key))
        return ".".join(map(str, number.to_bytes(4, "big")))
    if kind == "phone":
        head = 0 if len(norm) <= 10 else 2
        return norm[:head] + respelled(norm[head:] + "0" * more, key)
    if kind == "account":
        padded = norm + "0" * (more - 1)
        return respelled(padded + next(d for d in DIGITS if luhn(padded + d) == luhn(norm)), key, lambda x: luhn(x) == luhn(norm))
    if kind == "name":  # letters of no class would stay, and with them the name
        return respelled("".join(x if x in CLASS_OF else "b" for x in norm[:-1]) + "b" * more, key) + norm[-1]
    return surrogate(kind, norm + ("0" if DIGITS_ONLY.fullmatch(norm) else "b" if kind == "secret" else "0") * more, 0, key)


def surrogate(kind: str, norm: str, attempt: int, key: str) -> str:
    """The surrogate's normal form."""
    key = f"{key}|{kind}|{attempt}"
    if kind == "name":
        for _, names in LISTS:
            if norm in names:
                return in_cycle(norm, names, key)
    if attempt > TRIES:
        return lengthened(kind, norm, attempt - TRIES, key)
    if kind == "email":
        local, _, domain = norm.partition("@")
        *labels, top = domain.split(".")
        return f"{respelled(local, key)}@{'.'.join([*(respelled(x, f'{key}|domain') for x in labels), top])}"
    if kind == "phone":
        head = 0 if len(norm) <= 10 else 2
        return norm[:head] + respelled(norm[head:], key)
    if kind == "account":
        return respelled(norm, key, lambda x: luhn(x) == luhn(norm))
    if kind == "ip":
        size = network(norm)
        number = int.from_bytes(bytes(map(int, norm.split("."))), "big")
        while True:
            number = permuted(number, 1 << 32, digest(key))
            if network(out := ".".join(map(str, number.to_bytes(4, "big")))) == size:
                return out
    if kind == "iban":
        return norm[:2] + respelled(norm[2:].lower(), key).upper()
    if kind == "name":
        listed = {x for _, names in LISTS for x in names}
        return respelled(norm[:-1], f"{key}|{norm[-1]}", lambda x: x + norm[-1] not in listed) + norm[-1]
    if kind == "ssn":
        return respelled(norm, key, lambda x: issued(x) == issued(norm))
    if DIGITS_ONLY.fullmatch(norm):
        return respelled(norm, key)
    if HEX_ONLY.fullmatch(norm):  # some letter stays, so that it stays hexadecimal
        return respelled(norm, key, lambda x: not DIGITS_ONLY.fullmatch(x), alphabet=HEX)
    upper = "".join("A" if x.isupper() else "a" for x in norm)
    low = respelled(norm.lower(), f"{key}|{upper}")
    return "".join(x.upper() if u == "A" else x for x, u in zip(low, upper, strict=True))


def written(kind: str, value: str, like: str) -> str:
    """A surrogate in the form of the text it replaces."""
    if kind in ("email", "name"):
        return "".join(x.upper() if y.isupper() else x for x, y in zip(value, like, strict=True)) if len(value) == len(like) else value.title() if kind == "name" else value
    if kind not in ("phone", "account", "iban", "ssn"):
        return value
    rest, spare = iter(value), sum(x.isalnum() for x in like) - len(value)
    out = []
    for x in like:
        if not x.isalnum():
            out.append(x)
        elif spare > 0:
            spare -= 1
            out.append(x)
        else:
            out.append(next(rest))
    return "".join([*out, *rest])


def replaced(text: str, attempts: dict[tuple[str, str], int], key: str) -> tuple[str, int]:
    out, at, found = [], 0, entities(text)
    for x in found:
        value = surrogate(x.kind, x.norm, attempts.get((x.kind, x.norm), 0), key)
        out += [text[at : x.start], written(x.kind, value, text[x.start : x.end])]
        at = x.end
    return "".join([*out, text[at:]]), len(found)


def found_in(docs: DataFrame) -> DataFrame:
    """(th1, th2, kind, norm) of each text's entities."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {(a, b, x.kind, x.norm) for a, b, t in zip(batch["th1"], batch["th2"], batch["text"], strict=True) for x in entities(t)}
            yield pd.DataFrame(sorted(rows), columns=["th1", "th2", "kind", "norm"])

    return docs.where("text IS NOT NULL").select(*text_key(F.col("text")), "text").mapInPandas(scan, "th1 long, th2 long, kind string, norm string")


def drawn_again(found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the entities that had to draw again."""

    @F.pandas_udf("string")
    def draw(kinds: pd.Series, norms: pd.Series, attempts: pd.Series) -> pd.Series:
        return pd.Series([surrogate(*x, key) for x in zip(kinds, norms, attempts, strict=True)], dtype=object)

    real = checkpointed(found.select("kind", "norm").distinct())
    now = real.withColumn("attempt", F.lit(0)).withColumn("value", draw("kind", "norm", "attempt"))
    listed = F.lit([x for _, names in LISTS for x in names])
    for attempt in range(1, MAX_DRAWS + 2):
        now = checkpointed(now)
        taken = real.where(~F.array_contains(listed, F.col("norm"))).select("kind", F.col("norm").alias("value"), F.lit(True).alias("taken"))
        first = now.groupBy("kind", "value").agg(F.min(F.struct("attempt", "norm")).alias("first"))
        judged = now.join(first, ["kind", "value"]).join(taken, ["kind", "value"], "left")
        again = F.coalesce("taken", F.lit(False)) | (F.col("first.norm") != F.col("norm"))
        judged = checkpointed(judged.select("kind", "norm", "attempt", "value", again.alias("again")))
        if judged.where("again").isEmpty():
            return now.where("attempt > 0").select("kind", "norm", "attempt")
        redrawn = judged.where("again").withColumn("attempt", F.lit(attempt)).withColumn("value", draw("kind", "norm", "attempt"))
        now = judged.where("NOT again").unionByName(redrawn).drop("again")
    raise ValueError(f"entities are left without a surrogate of their own after {MAX_DRAWS} draws")


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """row (all columns of docs), text with surrogates, and n_entities."""
    found = checkpointed(found_in(docs))
    again = drawn_again(found, key)
    attempts = found.join(again, ["kind", "norm"]).groupBy("th1", "th2").agg(F.collect_set(F.struct("kind", "norm", "attempt")).alias("attempts"))

    @F.pandas_udf("text string, n_entities int")
    def replace(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, drawn in batches:
            made = []
            for t, own in zip(texts, drawn, strict=True):
                known = {(x["kind"], x["norm"]): x["attempt"] for x in own} if own is not None else {}
                made.append(replaced(t, known, key) if isinstance(t, str) else (None, 0))
            yield pd.DataFrame(made, columns=["text", "n_entities"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", *text_key(F.col("text")))
    if again.isEmpty():
        rows = rows.withColumn("attempts", F.lit(None).cast("array<struct<kind: string, norm: string, attempt: int>>"))
    else:
        attempts = checkpointed(attempts)
        size = attempts.agg(F.sum(F.aggregate("attempts", F.lit(32).cast("long"), lambda n, x: n + F.length(x.norm) * 4 + 64))).first()[0]
        rows = rows.join(F.broadcast(attempts) if (size or 0) <= BROADCAST_BYTES else attempts, ["th1", "th2"], "left")
    done = rows.select("row", replace("text", "attempts").alias("done"))
    return done.select("row", "done.text", "done.n_entities")
