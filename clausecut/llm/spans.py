"""Spans of a regular expression's matches as column expressions, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausecut.functions.text import let, sums_before

SPAN = "array<struct<start:int,end:int,match:string>>"

def spans(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """Leftmost non-overlapping matches for which keep(match) holds: array of (start, end, match), end exclusive.

    Matches and the gaps between them come from two passes of the same scan; running lengths give places. length()
    counts code points. pattern must not match an empty string.
    """
    both = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(b: Column) -> Column:
        before = sums_before(F.transform(b, lambda x: (F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))).cast("long")))

        def one(z: Column) -> Column:
            start = (z["n"] + F.length(z["x"]["g"])).cast("int")
            return F.struct(start.alias("start"), (start + F.length(z["x"]["m"])).alias("end"), z["x"]["m"].alias("match"))

        good = lambda z: z["x"]["m"].isNotNull() & F.coalesce(keep(z["x"]["m"]), F.lit(False))
        return F.transform(F.filter(F.arrays_zip(b.alias("x"), before.alias("n")), good), one)

    return F.when(text.rlike(pattern), let(both, placed)).otherwise(F.array().cast(SPAN))


def described(found: Column, kind: str) -> Column:
    """kind:start:end for each span."""
    return F.transform(found, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")
