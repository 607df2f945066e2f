"""Cleaning of page and document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausecut import patterns as P
from clausecut.functions.text import basename, collapse, strip


def clean_page(text: Column) -> Column:
    """Gazette mastheads, running headers and position lines go; blanks and empty lines are squeezed. Null gives an empty text."""
    out = text
    for pattern in (P.MASTHEAD, P.RUNNING_HEADER, P.HEADER_LINE, P.POSITION_LINE):
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return F.coalesce(strip(out), F.lit(""))


def fix_hyphens(text: Column) -> Column:
    """Words parted by a hyphen and a line's end, or a hyphen and blanks, are joined. A dash between blanks goes as well."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?U)-\s*\n\s*([{P.LOWER}])", "$1"), rf"(?U)-\s+([{P.LOWER}])", "$1")


def join_pages(pages: Column) -> Column:
    """An ordered array of clean pages as one document."""
    kept = F.filter(pages, lambda p: p.isNotNull() & (p != ""))
    return strip(F.regexp_replace(fix_hyphens(F.array_join(kept, "\n")), r"(?U)\n\s*\n+", "\n\n"))


def isolate_ellipses(text: Column) -> Column:
    return F.regexp_replace(text, r"(\.{3,}|…+)", " $1 ")


def preprocess(text: Column) -> Column:
    """Ellipses stand alone, empty lines go, blanks within lines are squeezed; lines stay."""
    squeezed = F.regexp_replace(F.regexp_replace(isolate_ellipses(text), r"\n{2,}", "\n"), P.LAST_LINE_END, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(squeezed, P.OTHER_LINE_ENDS, "\n"), r"[ \t]{2,}|\t", " "), P.STRIP_LINES, "")


def remove_headers(text: Column) -> Column:
    """From a gazette's or an act's title to the year that follows it, in text of one line."""
    for pattern in P.GAZETTE_SPANS:
        text = F.regexp_replace(text, pattern, "")
    return text


def single_line(text: Column) -> Column:
    return remove_headers(collapse(text))


def file_title(title: Column) -> Column:
    """A title as part of a file's name: without forbidden characters, 40 characters at most."""
    return strip(F.substring(F.regexp_replace(F.coalesce(title, F.lit(P.NO_TITLE)), r"""[\\/*?:"<>|]""", ""), 1, 40))


def act_name(year: Column, position: Column, title: Column) -> Column:
    return F.format_string(P.ACT_NAME, year.cast("string"), position.cast("string"), file_title(title))


def act_url(year: Column, position: Column) -> Column:
    return F.format_string(P.ACT_URL, year.cast("string"), position.cast("string"))


def act_id(path: Column) -> Column:
    """The act's id in a file's name; empty if there is none."""
    return F.regexp_extract(basename(path), r"act_\d+_\d+", 0)


def stem(path: Column) -> Column:
    return F.replace(basename(path), F.lit("_clean.txt"), F.lit(""))


def detokenize(tokens: Column) -> Column:
    """Tokens as text: no blank before closing marks nor after opening ones."""
    joined = F.array_join(tokens, " ")
    return strip(F.regexp_replace(F.regexp_replace(joined, r" ([.,);:\]}%])", "$1"), r"([(\[{]) ", "$1"))
