"""Tokens: letter runs, digit runs, and every other character that is no white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausecut import patterns as P
from clausecut.functions.text import collapse


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.TOKEN), F.lit(0))


def tokenize_collapsed(text: Column) -> Column:
    return tokenize(collapse(text))


def tokenize_with_terms(text: Column) -> Column:
    """As tokenize(), with some abbreviations kept whole."""
    whole = "|".join(x.replace(".", r"\.").replace(" ", r"\s") for x in P.ONE_TOKEN)
    return F.regexp_extract_all(text, F.lit(rf"(?U)(?<!\p{{L}})(?:{whole})|\p{{L}}+|\d+|[^\s\p{{L}}\d]"), F.lit(0))


def exploded(df: DataFrame, tokens: str, *keys: str) -> DataFrame:
    """A row per token: keys, tok_no from 0, tok."""
    return df.select(*keys, F.posexplode(tokens).alias("tok_no", "tok"))
