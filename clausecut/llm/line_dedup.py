r"""Line dedup by content-defined chunks of lines.

A cyclic-polynomial rolling hash over the hashes of the last WINDOW lines ends a chunk where it is 0 modulo MEAN, so
boundaries follow the content and survive lines put in or taken out elsewhere. A line of over LONG words is a chunk of its
own. A chunk that occurs again anywhere goes but for its first occurrence, if it has two lines with a word or over LONG
words. Where a repeated passage begins or ends inside a chunk, it is widened line by line: from each short line on, and up
to it, the shortest run of lines with over LONG words is a chunk too. So of any run of lines of over LONG words that
occurs again, however its neighbours differ, one copy stays.

Order: occurrences rank by doc_id (null last), then the text's digest, then the place; the first stays. A line that goes has
an equal one that comes before it, so every line stays somewhere. What stays is joined by \n again.

Bytes: lines are grouped by a 128-bit digest and their bytes; should a digest ever stand for two contents, all is done again
with another seed. From there on a run of lines is the row of its lines' digests, compared whole.

Scale: line contents cross the network once, combined by each map task. Only lines that occur twice, in small rows,
are looked at further, document by document; texts cross once more to meet the places to keep. A line or chunk held by
a third of all documents is one row after the partial sums, and one key with small rows in a plain join, which AQE
splits. All steps are linear in a text's length but for sorting its repeated lines. No text is cut.

Null texts stay null; empty texts stay empty. Rows with the same doc_id, null too, and the same text count as one
document and lose the same lines; other rows are documents of their own. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausecut.llm.common import WORD, Scratch, free, text_or_empty

WINDOW, MEAN, LONG = 2, 3, 50
#: Bits of a line's hash that the rolling hash sees.
BITS = 32


def _digest(c: Column, seed: int) -> Column:
    return F.md5((F.concat(c, F.lit(f"\n{seed}")) if seed else c).cast("binary"))


def _turned(h: Column, by: int) -> Column:
    by %= BITS
    return F.shiftleft(h, by).bitwiseOR(F.shiftright(h, BITS - by)).bitwiseAND(F.lit((1 << BITS) - 1)) if by else h


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """A row per line: doc_id, text_md5, pos, line, d (its digest), n_words, opens and closes (of chunks)."""
    text = text_or_empty(text_col)
    lines = docs.where(F.length(text) > 0).select(F.col(id_col).alias("doc_id"), F.md5(text.cast("binary")).alias("text_md5"), F.split(text, "\n", -1).alias("_l"))
    each = F.transform("_l", lambda x: F.struct(x.alias("line"), _digest(x, seed).alias("d"), F.regexp_count(x, F.lit(WORD)).alias("n_words")))
    lines = lines.select("doc_id", "text_md5", each.alias("_l"))
    hashes = F.transform("_l", lambda x: F.conv(F.substring(x["d"], 1, BITS // 4), 16, 10).cast("long"))
    before = [F.concat(F.array_repeat(F.lit(0).cast("long"), k), F.col("_h")).alias(f"p{k}") for k in range(1, WINDOW + 1)]
    zipped = F.arrays_zip(F.col("_l").alias("x"), F.concat(F.array(F.lit(0)), F.transform("_l", lambda x: x["n_words"])).alias("n"), *before)

    def opens(z: Column, i: Column) -> Column:
        roll = z[f"p{WINDOW}"]
        for k in range(WINDOW - 1, 0, -1):
            roll = _turned(roll, 1).bitwiseXOR(z[f"p{k}"])
        return (i == 0) | (F.pmod(roll, F.lit(MEAN)) == 0) | (z["n"] > LONG) | F.coalesce(z["x"]["n_words"] > LONG, F.lit(True))

    lines = lines.withColumn("_h", hashes).withColumn("_o", F.transform(zipped, opens))  # one more than lines: true after the last
    lines = lines.select("doc_id", "text_md5", F.posexplode(F.arrays_zip(F.col("_l").alias("x"), F.col("_o").alias("opens"), F.slice("_o", F.lit(2), F.size("_l")).alias("closes"))).alias("pos", "z"))
    return lines.where("z.x IS NOT NULL").select("doc_id", "text_md5", "pos", "z.x.line", "z.x.d", "z.x.n_words", "z.opens", F.coalesce("z.closes", F.lit(True)).alias("closes"))


def repeated_lines(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Digests d of lines with a word that occur twice or more, and the digests' seed."""
    for seed in range(100):
        lines = line_rows(docs, id_col, text_col, seed).where("n_words > 0")
        counted = scratch.write(lines.groupBy("d", "line").agg(F.count("*").alias("n")).select("d", "n"), f"counted{seed}")
        if not counted.groupBy("d").count().where("count > 1").take(1):
            return counted.where("n > 1").select("d"), seed
        scratch.drop(f"counted{seed}")
    raise RuntimeError("no seed keeps the digests apart")


def runs(rows: DataFrame) -> DataFrame:
    """From rows of repeated and of blank lines: doc_id, text_md5, start, end, key of each chunk and each widened run whose lines are all there."""
    doc = ["doc_id", "text_md5"]
    rows = rows.repartition(*doc).dropDuplicates([*doc, "pos"])  # equal documents are one
    by_pos = Window.partitionBy(*doc).orderBy("pos")
    rows = rows.withColumn("run", F.col("pos") - F.row_number().over(by_pos))
    inside = Window.partitionBy(*doc, "run")
    upto = inside.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"after": F.sum("n_words").over(upto), "chunk": F.sum(F.col("opens").cast("int")).over(upto)}).withColumn("before", F.col("after") - F.col("n_words"))
    rows = rows.withColumns({"last": F.max("pos").over(inside.orderBy("before").rangeBetween(0, LONG)), "first": F.min("pos").over(inside.orderBy("after").rangeBetween(-LONG, 0))})
    rows = rows.withColumn("begin", F.min("pos").over(Window.partitionBy(*doc, "run", "chunk")))
    short, whole = F.col("n_words").between(1, LONG), F.col("closes") & (F.col("chunk") > 0)
    item = F.struct("pos", "d", "n_words", F.when(whole, F.col("begin")).alias("begin"), F.when(short, F.col("first")).alias("first"), F.when(short, F.col("last")).alias("last"))
    arrays = rows.groupBy(*doc, "run").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    some = lambda name, a, b, chunk: F.transform(F.filter("xs", lambda x: x[name].isNotNull()), lambda x: F.struct(x[a].alias("start"), x[b].alias("end"), F.lit(chunk).alias("chunk")))
    found = F.concat(some("begin", "begin", "pos", True), some("first", "first", "pos", False), some("last", "pos", "last", False))
    part = lambda r: F.slice(F.col("xs"), r["start"] - F.col("xs")[0]["pos"] + 1, r["end"] - r["start"] + 1)
    out = arrays.select(*doc, F.explode(F.transform(found, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["chunk"].alias("chunk"), part(r).alias("part")))).alias("r")).select(*doc, "r.*")
    long = F.aggregate("part", F.lit(0), lambda a, x: a + x["n_words"]) > LONG
    lines = F.size(F.filter("part", lambda x: x["n_words"] > 0)) > 1
    return out.where(long | F.col("chunk") & lines).select(*doc, "start", "end", F.array_join(F.transform("part", lambda x: x["d"]), "").alias("key"))


def removals(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_md5, kept (ranges of lines that stay: place, number) and rest (the place from which all stay), for documents that lose lines."""
    again, seed = repeated_lines(docs, scratch, id_col, text_col)
    lines = line_rows(docs, id_col, text_col, seed).drop("line")
    rows = lines.where("n_words > 0").join(again, "d").unionByName(lines.where("n_words = 0"))
    found = scratch.write(runs(rows), "runs", compact=True)
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5", "start")
    first = found.groupBy("key").agg(F.min(at).alias("at"))
    gone = found.join(first, "key").where(~at.eqNullSafe(F.col("at"))).select("doc_id", "text_md5", "start", "end")
    before = Window.partitionBy("doc_id", "text_md5").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gone = gone.withColumn("open", F.coalesce(F.max("end").over(before) + 1, F.lit(0)))
    free = F.when(F.col("start") > F.col("open"), F.struct("open", (F.col("start") - F.col("open")).alias("n")))
    out = gone.groupBy("doc_id", "text_md5").agg(F.array_sort(F.collect_list(free)).alias("kept"), (F.max("end") + 1).alias("rest"))
    return scratch.write(out, "gone", compact=True)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text less its repeated chunks, and n_lines, n_removed."""
    scratch = Scratch(docs.sparkSession, "lines")
    # of the columns n_lines and n_removed of docs, if it has such, these take the place
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    id_, md5, kept, rest, mine, lines, stay = free(docs.columns, "_id", "_md5", "_kept", "_rest", "_own", "_lines", "_stay")
    gone = removals(docs, scratch, id_col, text_col).withColumnsRenamed({"doc_id": id_, "text_md5": md5, "kept": kept, "rest": rest})
    scratch.drop("runs", *[n for n in scratch.paths if n.startswith("counted")])
    out = docs.withColumn(mine, F.md5(text_or_empty(text_col).cast("binary")))
    out = out.join(gone.hint("merge"), (F.col(mine) == F.col(md5)) & F.col(id_col).eqNullSafe(F.col(id_)), "left")
    out = out.withColumn(lines, F.split(text_or_empty(text_col), "\n", -1))
    left = F.concat(F.flatten(F.transform(kept, lambda r: F.slice(F.col(lines), r["open"] + 1, r["n"]))), F.slice(lines, F.col(rest) + 1, F.size(lines)))
    out = out.withColumn(stay, F.when(F.col(rest).isNotNull(), left))
    cols = [F.when(F.col(stay).isNull(), F.col(text_col)).otherwise(F.array_join(stay, "\n")).alias(c) if c == text_col else F.col(c) for c in own]
    removed = F.when(F.col(stay).isNull(), 0).otherwise(F.size(lines) - F.size(stay)).cast("long")
    return out.select(*cols, F.size(lines).cast("long").alias("n_lines"), removed.alias("n_removed"))
