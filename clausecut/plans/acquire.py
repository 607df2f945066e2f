"""From acts to clean documents: list, leave out what is done, fetch, parse, assemble, clean."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausecut.operators import boxes, clean, layout
from clausecut.sources import io

PAGE = ("path", "page")
#: What a parser yields for each page: one row of kind page, and rows of kinds word, table and line; or of kinds char and ruling in place of words and tables.
PARSED = "kind string, page int, no int, text string, x0 double, top double, x1 double, bottom double, size double, width double, height double, raw string"


def page_tables(rows: DataFrame, from_boxes: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A parser's rows as the tables of layout: pages, words, tables, lines. from_boxes makes words of characters and tables of ruled lines, which are drawn lines too."""
    of = lambda kind: rows.where(F.col("kind") == kind)
    if from_boxes:
        chars = of("char").select(*PAGE, F.col("no").alias("char_no"), "text", "x0", "x1", "top", "bottom", "size")
        rulings = of("ruling").select(*PAGE, F.col("no").alias("ruling_no"), "x0", "top", "x1", "bottom")
        found = boxes.words(chars, PAGE).select(*PAGE, "word_no", "text", "x0", "top", "bottom", "size")
        drawn = rulings.where(f"abs(bottom - top) <= {boxes.THICK}").select(*PAGE, F.col("ruling_no").alias("line_no"), "x0", "x1", "top")
        return of("page").select(*PAGE, "width", "height"), found, boxes.tables(rulings, PAGE).drop("n_cells"), drawn
    return (
        of("page").select(*PAGE, "width", "height"),
        of("word").select(*PAGE, F.col("no").alias("word_no"), "text", "x0", "top", "bottom", "size"),
        of("table").select(*PAGE, F.col("no").alias("table_no"), "x0", "top", "x1", "bottom"),
        of("line").select(*PAGE, F.col("no").alias("line_no"), "x0", "x1", "top"),
    )


def joined_pages(pages: DataFrame, doc: str = "path") -> DataFrame:
    """(doc, text) from page texts (doc, page, text): each page cleaned, empty ones skipped, hyphens mended."""
    ordered = F.array_sort(F.collect_list(F.struct("page", clean.clean_page(F.col("text")).alias("text"))))
    return pages.groupBy(doc).agg(clean.join_pages(F.transform(ordered, lambda p: p["text"])).alias("text")).where("text <> ''")


def raw_documents(rows: DataFrame) -> DataFrame:
    """(path, text): the pages' own text, as the parser gives it, one under the other; empty ones skipped."""
    pages = rows.where("kind = 'page' AND raw <> ''")
    return pages.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "raw"))), lambda p: p["raw"]), "\n").alias("text"))


def documents(files: DataFrame, parser: Callable[[str, bytes], Iterable[dict]], from_boxes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Clean documents (path, text) of PDFs (path, content), and the files that could not be parsed (path, error)."""
    rows = layout.parsed(files, parser, PARSED)
    pages, words, tables, lines = page_tables(rows.where("error IS NULL"), from_boxes)
    return joined_pages(layout.assembled(pages, words, tables, lines, PAGE)), rows.where("error IS NOT NULL").select("path", "error")


def acquired(acts: DataFrame, parser, done: DataFrame | None = None, fetched=io.fetched) -> DataFrame:
    """name, status, text of each act with a PDF: `skipped (exists)`, `failed: ...` or `done`.

    A status takes the place of an exception: a bad file costs its own row.
    """
    wanted = io.to_fetch(acts)
    new = io.to_fetch(acts, done)
    got = fetched(new)
    texts, bad = documents(got.where("content IS NOT NULL").select("path", "content"), parser)
    out = got.drop("content").join(texts, "path", "left").join(bad, "path", "left")
    status = F.when(F.col("status") != "done", F.col("status")).when(F.col("error").isNotNull(), F.concat(F.lit("failed: "), "error")).otherwise("done")
    out = out.select("name", status.alias("status"), "text")
    if done is None:
        return out
    return out.unionByName(wanted.join(done.select("name").distinct(), "name", "left_semi").select("name", F.lit("skipped (exists)").alias("status"), F.lit(None).cast("string").alias("text")))
