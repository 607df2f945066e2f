"""Page layout: word boxes, tables and drawn lines to text.

Tables: words(keys, word_no, text, x0, top, bottom, size), tables(keys, table_no, x0, top, x1, bottom), lines(keys,
line_no, x0, x1, top), pages(keys, width, height). keys name a page; every join and window is within one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausecut import patterns as P

SMALL, RAISED, BREAK = 0.75, 1.0, 0.5
FOOTNOTE_SIZE, FOOTNOTE_AREA, LINE_AREA, LINE_WIDTH, MARGIN, BODY = 0.85, 0.80, 0.70, (40, 250), 2, 0.95


def upper_median(values: Column) -> Column:
    """Of an even number of values the upper of the two in the middle."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def medians(words: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return words.groupBy(*keys).agg(upper_median(F.collect_list("size")).alias("median"))


def in_tables(words: DataFrame, tables: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """words with table_no (by top, then as listed; -1 outside) and table_bottom of the first table that holds the word's top left corner."""
    listed = tables.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("top", "table_no", "x0", "x1", "bottom"))).alias("_t"))
    inside = lambda t: (F.col("x0") >= t["x0"]) & (F.col("x0") <= t["x1"]) & (F.col("top") >= t["top"]) & (F.col("top") <= t["bottom"])
    ranked = F.transform("_t", lambda t, i: F.struct(i.alias("no"), t["top"].alias("top"), t["x0"].alias("x0"), t["x1"].alias("x1"), t["bottom"].alias("bottom")))
    out = words.join(listed, list(keys), "left").withColumn("_hit", F.get(F.filter(ranked, inside), F.lit(0)))
    return out.select(*words.columns, F.coalesce(F.col("_hit.no"), F.lit(-1)).alias("table_no"), F.col("_hit.bottom").alias("table_bottom"))


def placeholders(words: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """From in_tables(): words outside tables, and one marker for each table in place of its first word."""
    first = F.row_number().over(Window.partitionBy(*keys, "table_no").orderBy("word_no"))
    out = words.withColumn("_first", F.when(F.col("table_no") >= 0, first)).where("table_no < 0 OR _first = 1").drop("_first")
    marker = F.col("table_no") >= 0
    return out.withColumn("text", F.when(marker, P.TABLE).otherwise(F.col("text"))).withColumn("is_table", marker)


def raised(sizes: list[float], bottoms: list[float], tables: list[bool], median: float) -> list[bool]:
    """For each word of a page, in order, whether it is small and stands higher than the last word that is not."""
    out, base = [], None
    for size, bottom, table in zip(sizes, bottoms, tables, strict=True):
        gone = not table and base is not None and size < SMALL * median and bottom < base - RAISED
        out.append(gone)
        base = base if gone or table else bottom
    return out


def without_superscripts(words: DataFrame, page_medians: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Drops small words that stand higher than the last word kept. What is kept depends on what was kept before, so a page's sizes and places are looked at in one go, in Arrow batches."""

    @F.pandas_udf("array<boolean>")
    def gone(sizes: pd.Series, bottoms: pd.Series, tables: pd.Series, median: pd.Series) -> pd.Series:
        return pd.Series([raised(*x) for x in zip(sizes, bottoms, tables, median, strict=True)], dtype="object")

    ordered = F.array_sort(F.collect_list(F.struct("word_no", F.struct(*[c for c in words.columns if c not in keys]).alias("w"))))
    pages = words.groupBy(*keys).agg(ordered.alias("_ws")).join(page_medians.select(*keys, F.col("median").alias("_m")), list(keys))
    of = lambda f: F.transform("_ws", lambda x: f(x["w"]))
    tables = of(lambda w: F.coalesce(w["is_table"], F.lit(False))) if "is_table" in words.columns else of(lambda w: F.lit(False))
    pages = pages.withColumn("_gone", gone(of(lambda w: w["size"].cast("double")), of(lambda w: w["bottom"].cast("double")), tables, F.col("_m").cast("double")))
    kept = F.filter(F.arrays_zip(F.col("_ws").alias("x"), F.col("_gone").alias("gone")), lambda z: ~z["gone"])
    return pages.select(*keys, F.explode(F.transform(kept, lambda z: z["x"]["w"])).alias("w")).select(*keys, "w.*")


def text_lines(words: DataFrame, page_medians: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, line_no, line) from kept words with is_table and table_bottom.

    A word far enough under the one before starts a line. If the word before ends with a hyphen, the hyphen goes and the
    line goes on with the word as it is. A table's marker is a line of its own; a break right after it leaves an empty line.
    """
    w = Window.partitionBy(*keys).orderBy("word_no")
    rows = words.join(page_medians, list(keys)).withColumn("_edge", F.when(F.col("is_table"), F.col("table_bottom")).otherwise(F.col("bottom")))
    rows = rows.withColumns({"_pb": F.lag("_edge").over(w), "_pt": F.lag("is_table").over(w), "_px": F.lag("text").over(w)})
    below = F.coalesce(F.col("top") > F.col("_pb") + BREAK * F.col("median"), F.lit(False)) & ~F.col("is_table")
    hyphen = below & ~F.coalesce("_pt", F.lit(False)) & F.coalesce(F.col("_px").endswith("-"), F.lit(False))
    rows = rows.withColumn("_joins", hyphen).withColumn("_breaks", (below & ~hyphen).cast("int"))
    # after a table's marker a break makes an empty line before the word's own
    opens = F.when(F.col("_pb").isNull(), 0).when(F.col("is_table"), 1).when(F.coalesce("_pt", F.lit(False)), 1 + F.col("_breaks")).otherwise(F.col("_breaks"))
    rows = rows.withColumn("line_no", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    rows = rows.withColumn("text", F.when(F.coalesce(F.lead("_joins").over(w), F.lit(False)), F.regexp_replace("text", "-$", "")).otherwise(F.col("text")))
    return rows.groupBy(*keys, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ").alias("line"))


def page_texts(pages: DataFrame, line_rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, text): lines in order, with empty lines where numbers are left out; a page without words has an empty text."""
    listed = line_rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("line_no", "line"))).alias("_m"), F.max("line_no").alias("_n"))
    out = pages.select(*keys).join(listed, list(keys), "left")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n")), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(""))), "\n")
    return out.select(*keys, F.coalesce(text, F.lit("")).alias("text"))


def footnote_cuts(pages: DataFrame, words: DataFrame, lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, cut): where footnotes begin: a short drawn line low on the page, else a small word like `1)` lower still; else null."""
    low, high = LINE_WIDTH
    drawn = lines.join(pages, list(keys)).where((F.col("x1") - F.col("x0") > low) & (F.col("x1") - F.col("x0") < high) & (F.col("top") > LINE_AREA * F.col("height")))
    by_line = drawn.groupBy(*keys).agg(F.min_by("top", "line_no").alias("_a"))
    small = words.join(medians(words, keys), list(keys)).join(pages, list(keys))
    small = small.where((F.col("size") < FOOTNOTE_SIZE * F.col("median")) & F.col("text").rlike(r"^[0-9]+\)") & (F.col("top") > FOOTNOTE_AREA * F.col("height")))
    by_word = small.groupBy(*keys).agg(F.min_by("top", "word_no").alias("_b"))
    return pages.join(by_line, list(keys), "left").join(by_word, list(keys), "left").select(*keys, F.coalesce("_a", "_b").alias("cut"))


def cropped(words: DataFrame, pages: DataFrame, cuts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Words that end above the cut, or in the upper 95 % of a page without one. A cut at 0 counts as none."""
    limit = F.when(F.coalesce("cut", F.lit(0.0)) != 0, F.col("cut") - MARGIN).otherwise(BODY * F.col("height"))
    return words.join(pages.join(cuts, list(keys), "left"), list(keys)).where(F.col("bottom") <= limit).select(*words.columns)


def assembled(pages: DataFrame, words: DataFrame, tables: DataFrame, lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, text): all of the above."""
    body = cropped(words, pages, footnote_cuts(pages, words, lines, keys), keys)
    middle = medians(body, keys)
    kept = without_superscripts(placeholders(in_tables(body, tables, keys), keys).drop("table_no"), middle, keys)
    return page_texts(pages, text_lines(kept, middle, keys), keys)


def parsed(files: DataFrame, parser, schema: str) -> DataFrame:
    """Rows of a parser over binary files (path, content), with its failures as rows of their own: status and error are parser-independent.

    parser(path, content) yields dicts of schema. A file that raises gives one row with error set, and other columns null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    out = pd.DataFrame([{"path": path, "error": None} | row for row in parser(path, bytes(content))])
                except Exception as e:  # noqa: BLE001  what a parser raises becomes a row
                    out = pd.DataFrame([{"path": path, "error": f"{type(e).__name__}: {e}"}])
                if len(out):
                    yield out.reindex(columns=["path", "error", *names]).astype("object").where(lambda x: x.notna(), None)

    names = [f.split()[0] for f in schema.split(",")]
    return files.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")
