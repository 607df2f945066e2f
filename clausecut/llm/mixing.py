"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating; they share 150 % of all words; a target
stops at twice its source's words, and the excess is shared anew by weight (water filling, in closed form by windows
over the few rows of the sources).

Schedule: slot i of the mix has the point frac((i + 1/2) / golden ratio) in [0, 1); cumulative shares turn it into a
source. Slots of a source are ranked. A source's documents, shuffled by a hash, form a stream of words, passed twice;
it is cut in blocks of equally many words, and the block of rank k goes to the slot of rank k. So the points alone say how
many blocks a source gives. Only the rounding to blocks is mended: where that is within one block of the target, the
source's last block is shorter, or one short block more comes at the end, so that the target is met to the word.

Scale: the schedule has SLOTS slots at any input size, a block being the total over SLOTS words. Streams are built
from two levels of prefix sums (chunks of a hash's range, rows within a chunk), so no task holds a source. The rank of
a slot is found the same way. Points meet sources through an equi-join on a cell of [0, 1), with no pairing of all.

Null texts have no words. Null is a source of its own. Repeated rows count each as a row. An empty table gives an
empty table. Rows without a doc_id have one place in a source's stream, one after the other. A very long text is only
cut by more blocks. Reruns agree: the hashes are fixed and ties are broken by doc_id and size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausecut.llm.common import WORD, Scratch, chunk_bits, running, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SLOTS = 1 << 18
CELLS = 1024
#: Hexadecimal digits of the hash that shuffles a source.
HEX = 15
GOLDEN = 0.6180339887498949


def targets(sizes: DataFrame) -> DataFrame:
    """From (skey, source, size): a row per source with source_size, weight and target."""
    per = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    out = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(CAP)) * F.col("source_size")).withColumn("total", F.lit(SHARE) * F.sum("source_size").over(everything))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    out = out.withColumn("final", F.max(F.when(F.col("open"), F.struct((-F.col("cap") / F.col("weight")).alias("a"), (-F.col("rank")).alias("b"), F.col("level").alias("level")))).over(everything)["level"])
    return out.select("skey", "source", "rank", "source_size", "n_docs", "total", F.when(F.col("open"), F.col("final") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def schedule(spark, sources: DataFrame, slots: int = SLOTS, ratio: float = GOLDEN) -> DataFrame:
    """Slots of the mix by the golden ratio's points: slot, skey, chunk (a run of slots)."""
    by = Window.orderBy("rank")
    shares = sources.where("target > 0").withColumn("hi", F.sum("target").over(by))
    shares = shares.withColumn("hi", F.col("hi") / F.max("hi").over(Window.partitionBy())).withColumn("lo", F.coalesce(F.lag("hi").over(by), F.lit(0.0)))
    cells = shares.select("skey", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), (((F.col("id") + 0.5) * ratio) % 1.0).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    return points.join(cells, "cell").where("u >= lo and u < hi").select("slot", "skey", F.shiftright("slot", 11).alias("chunk"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS, ratio: float = GOLDEN, keep_rows: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    """Three tables: rows (rid, doc_id, skey, source, size), sources (targets), pieces (rid, pass, slot, words).

    pieces is the mix: slot after slot, so many words of row rid in its first or second pass. With keep_rows, rows also
    has every column of docs, for a caller that needs the texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    size = F.size(F.regexp_extract_all(text_or_empty(text_col), F.lit(WORD), F.lit(0))).cast("long")
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    own = [F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)] if keep_rows else []
    rows = scratch.write(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), skey.alias("skey"), F.col(source_col).alias("source"), size.alias("size"), *own), "rows")
    slim = rows.select("rid", "doc_id", "skey", "size")
    sources = scratch.write(targets(rows.select("skey", "source", "size")), "sources")
    n, total = sources.agg(F.sum("n_docs"), F.max("total")).first()
    bits, total = chunk_bits(n or 0), int(total or 0)
    block = max(1, -(-total // slots))
    slots = -(-total // block)

    dealt = scratch.write(schedule(spark, sources, slots, ratio), "slots")
    given = dealt.groupBy("skey").agg(F.count("*").alias("given"))
    blocks = F.coalesce("given", F.lit(0).cast("long"))
    near = F.abs(blocks * block - F.col("target")) < block
    takes = F.when(near, F.round("target").cast("long")).otherwise(F.least(blocks * block, CAP * F.col("source_size")))
    sources = scratch.write(sources.join(given, "skey", "left").withColumns({"takes": takes, "given": blocks}), "takes")
    order = running(dealt, ["skey"], "chunk", [F.col("slot")], F.lit(1).cast("long"), "rank").select("skey", "slot", "rank")
    late = sources.where(F.col("takes") > F.col("given") * block).select("skey", (F.lit(slots) + F.col("rank")).alias("slot"), F.col("given").alias("rank"))
    order = order.unionByName(late)

    hashed = slim.where("size > 0").withColumn("h", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, HEX), 16, 10).cast("long"))
    hashed = hashed.withColumn("chunk", F.shiftright("h", 4 * HEX - bits))
    sums = hashed.groupBy("skey", "chunk").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("_sum")
    stream = running(hashed, ["skey"], "chunk", [F.col("h"), F.col("doc_id"), F.col("size"), F.col("rid")], F.col("size"), "at", sums.join(sources.select("skey", "source_size", "takes"), "skey"))
    twice = stream.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("lo", F.col("at") + F.col("pass") * F.col("source_size"))
    twice = twice.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("takes"))).where("hi > lo")
    cut = twice.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    cut = cut.select("rid", "pass", "skey", "rank", (F.least("hi", (F.col("rank") + 1) * block) - F.greatest("lo", F.col("rank") * block)).alias("words"))
    pieces = cut.join(order, ["skey", "rank"]).select("rid", "pass", "slot", "words")
    return rows, sources, pieces, scratch


def mixed_sizes(docs: DataFrame, **columns) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken, first_slot (null if the mix takes none of it)."""
    rows, sources, pieces, _ = mix(docs, **columns)
    taken = pieces.groupBy("rid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = rows.join(taken, "rid", "left")
    per = sources.select("skey", "source_size", "target")
    return out.join(per, "skey").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, order: str = "mix_slot", **columns) -> DataFrame:
    """The mix as documents: a row for each pass in which a document is taken, with all columns and its first slot as order.

    A document taken in part, at most one for each source, has the text up to its last word taken. n_chars, if there is
    such a column, is set to the text's length. Sorted by the order column, the rows are the mix.
    """
    rows, _, pieces, _ = mix(docs, keep_rows=True, **columns)
    text = docs.columns.index(columns.get("text_col", "text"))
    taken = pieces.groupBy("rid", "pass").agg(F.sum("words").alias("taken"), F.min("slot").alias("_slot"))
    out = rows.join(taken, "rid")
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(f"_c{text}"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("taken").cast("int")), "")
    new = F.when(F.col("taken") >= F.col("size"), F.col(f"_c{text}")).otherwise(part)
    out = out.withColumn(f"_c{text}", new)
    cols = [(F.length(f"_c{text}").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    return out.select(*cols, F.col("_slot").alias(order))
