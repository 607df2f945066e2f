"""Scalar helpers on text as column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausecut import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body reads it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


RADIX = 64


def sums_before(values: Column) -> Column:
    """For each place of an array of whole numbers, the sum of those before it.

    A fold that keeps an array copies it at every step. Here sums of 64 are summed by 64 again, so that a place needs at
    most some 64 additions on each of three levels.
    """
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    whole = lambda k: F.floor(k / RADIX).cast("int")
    blocks = lambda v: F.transform(F.sequence(F.lit(0), whole(F.size(v) - 1)), lambda k: total(F.slice(v, k * RADIX + 1, F.lit(RADIX))))
    rest = lambda v, k: total(F.slice(v, whole(k) * RADIX + 1, k % RADIX))

    def three(v0: Column, v1: Column, v2: Column) -> Column:
        high = F.transform(v2, lambda _, k: total(F.slice(v2, F.lit(1), k)))
        return let(high, lambda h: let(F.transform(v1, lambda _, k: F.get(h, whole(k)) + rest(v1, k)), lambda m: F.transform(v0, lambda _, k: F.get(m, whole(k)) + rest(v0, k))))

    return let(values, lambda v0: F.when(F.size(v0) > 0, let(blocks(v0), lambda v1: let(blocks(v1), lambda v2: three(v0, v1, v2)))).otherwise(F.array().cast("array<bigint>")))


def strip(c: Column) -> Column:
    """Without white space at either end, as Unicode and the separators U+001C-1F have it; trim() takes blanks only."""
    return F.regexp_replace(c, P.STRIP, "")


def collapse(c: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


@functools.cache
def _digit_class() -> str:
    """Characters that count as digits without being decimal: superscripts, subscripts, circled digits and the like."""
    return "".join(f"\\x{{{i:x}}}" for i in range(0x110000) if chr(i).isdigit() and not chr(i).isdecimal())


def is_digit(c: Column) -> Column:
    """Digits only, of any kind. The first character decides most cases without the long class."""
    first, every = F.ascii(c), c.rlike(rf"^[\p{{Nd}}{_digit_class()}]+$")
    return F.when(first.between(48, 57), c.rlike(r"^[0-9]+$") | every).when(first < 0xB2, F.lit(False)).otherwise(every)


def is_letter(c: Column) -> Column:
    """One character, a letter."""
    return c.rlike(r"^\p{L}$")


def starts_upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def lines(c: Column) -> Column:
    """The text's lines at any line end Unicode knows; one end at the very last makes no empty line."""
    return F.split(F.regexp_replace(c, P.LAST_LINE_END, ""), P.LINE_ENDS, -1)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def newlines(c: Column, universal: bool = True) -> Column:
    """Line ends as a file read gives them: all three kinds as one newline, or as they are."""
    return F.regexp_replace(c, r"\r\n?", "\n") if universal else c
