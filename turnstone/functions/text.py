"""Column functions over message texts and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(text: Column, needle: str) -> Column:
    """Whether the text has needle, letter case aside."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def snippet(text: Column, needle: str, around: int = 20) -> Column:
    """The first occurrence of needle (letter case aside) with `around` characters on both sides."""
    at = F.instr(F.lower(text), F.lit(needle.lower()))
    begin = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, begin, at + len(needle) + around - begin))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def n_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def pretty(body: Column) -> Column:
    """A variant as JSON text; its keys come out sorted."""
    return F.to_json(body)
