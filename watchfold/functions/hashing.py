"""Pseudonyms: salted SHA-256, cut to a few hex digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "watchfold"
LENGTHS = {"user": 16, "pc": 16, "email": 12, "domain": 12, "join": 16}


def digest(text: Column, salt: str, length: int) -> Column:
    """Empty and null texts give ''."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.substring(F.sha2(F.concat(text, F.lit(salt)).cast("binary"), 256), 1, length))


def pseudonym(text: Column, kind: str, salt: str = SALT) -> Column:
    """By kind: user, pc and join by upper-cased text, email by its domain, domain by lower-cased text."""
    if kind == "email":
        value = F.when(F.contains(text, F.lit("@")), F.lower(F.substring_index(F.trim(text), "@", -1)))
    elif kind == "domain":
        value = F.lower(F.trim(text))
    else:
        value = F.upper(F.trim(text))
    return digest(value, f"{salt}_{kind.upper()}", LENGTHS[kind])


def pseudonymise(df: DataFrame, kinds: dict[str, str], salt: str = SALT) -> DataFrame:
    """df with <column>_hash for each column by its kind."""
    return df.withColumns({f"{column}_hash": pseudonym(F.col(column), kind, salt) for column, kind in kinds.items() if column in df.columns})


def hash_pc(text: Column) -> Column:
    """Without salt."""
    return digest(F.upper(F.trim(text)), "", 16)
