"""Exact dedup by deterministic block naming.

A text without white space is cut in blocks of a fixed number of code points. The distinct blocks, sorted by a 128-bit
digest, get their rank as an integer name; then adjacent names are paired, the distinct pairs sorted (by a hash, then
by value) and named by rank in turn, until one name stands for the whole text. Two texts of as many blocks are equal if
and only if their last names are: each name stands for one content, as names come from the distinct contents themselves.
A rank is the same on any cluster, however the rows are dealt.

Before a digest is used, the distinct contents are counted for each digest (a comparison of bytes); should two contents
ever share one, all is done again with another seed.

Scale: block contents cross the network once, combined before that by each map task; all later steps move numbers.
A hot block or group is one key with small rows in plain joins, which AQE splits; groups are counted with partial
sums. Ranks are counted in ranges of the sort key, which is spread evenly, and the ranges' sizes are summed up. The number
of rounds is the logarithm of the longest text's blocks; a very long text is only more blocks.

Nulls count as empty texts; all empty texts are equal. Repeated rows (the same doc_id and text) are separate rows of
one group, of which one stays. A null doc_id comes after the others among rows as long. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausecut.llm.common import SPACE, Scratch, chunk_bits, digest, free, running, text_or_empty, top_bits

#: Code points in a block.
BLOCK = 4096


def _blocks(text, block: int):
    """A text's blocks in order; an empty text has one empty block."""
    return F.when(F.length(text) <= block, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % block), F.lit(0)))


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """A written table of distinct keys with name: their rank in the given order, of which the first column is an evenly spread hash."""
    # the sign bit is turned, as the top bits count a long as unsigned
    spread = F.col(order[0]).bitwiseXOR(F.lit(-(1 << 63)))
    ranked = distinct.withColumn("range", top_bits(spread, chunk_bits(distinct.count(), 1 << 16)))
    return running(ranked, [], "range", [F.col(c) for c in order], F.lit(1).cast("long"), "name").drop("range")


def name_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row per document: rid (a row's own number), doc_id, n_chars, sha, n_blocks, name. (n_blocks, name) is the text's identity."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "naming")
    norm = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("norm", F.regexp_replace("text", SPACE + "+", ""))
    for seed in range(100):
        pieces = norm.select(F.explode(_blocks(F.col("norm"), block)).alias("block"))
        d1, d2 = digest(F.col("block"), seed)
        distinct = pieces.select(d1.alias("d1"), d2.alias("d2"), "block").distinct()
        found = scratch.write(distinct.select("d1", "d2"), f"blocks{seed}", compact=True)
        if not found.groupBy("d1", "d2").count().where("count > 1").take(1):
            break
        scratch.drop(f"blocks{seed}")
    ones = F.transform(_blocks(F.col("norm"), block), lambda b: F.struct(digest(b, seed)[0].alias("d1"), digest(b, seed)[1].alias("d2")))
    base = scratch.write(norm.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), ones.alias("digests")).withColumn("n_blocks", F.size("digests")), "base", compact=True)
    rows = base.select("rid", "n_blocks", F.posexplode("digests").alias("pos", "d")).select("rid", "n_blocks", "pos", "d.d1", "d.d2")
    level = scratch.write(rows.join(_named(found, ["d1", "d2"]), ["d1", "d2"]).select("rid", "n_blocks", "pos", "name"), "level0")
    scratch.drop(f"blocks{seed}")
    done = level.where("n_blocks = 1").select("rid", "name")
    level = level.where("n_blocks > 1")
    longest = base.agg(F.max("n_blocks")).first()[0] or 1
    step, old = 1, None
    while longest > 1:
        pairs = level.groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b"))
        pairs = scratch.write(pairs, f"pairs{step}")
        found = scratch.write(pairs.select("a", "b").distinct().withColumn("h", F.xxhash64("a", "b")), f"names{step}", compact=True)
        level = scratch.write(pairs.join(_named(found, ["h", "a", "b"]), ["a", "b"]).select("rid", "pos", "name"), f"level{step}")
        scratch.drop(f"pairs{step}", f"names{step}", *([old] if old else []))
        old, longest, step = f"level{step}", (longest + 1) // 2, step + 1
    if step > 1:
        done = done.unionByName(level.select("rid", "name"))
    return base.drop("digests").join(done, "rid")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Of equal texts the row with the most code points stays, then the smallest doc_id. Columns: doc_id, keep_id, group_size, kept, text_sha256."""
    named = name_texts(docs, id_col, text_col, block)
    groups = named.groupBy("n_blocks", "name").agg(F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"), F.count("*").alias("group_size"))
    out = named.join(groups, ["n_blocks", "name"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Rows that share a doc_id (null too), a length and the normalized text stay or go together."""
    named = name_texts(docs, id_col, text_col)
    own = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    id_, n, sha = free(docs.columns, "_id", "_n", "_sha")
    kept = named.groupBy("n_blocks", "name").agg(F.min(own).alias("best"), F.min("sha").alias(sha)).select(F.col("best.doc_id").alias(id_), (-F.col("best.n")).alias(n), sha)
    text = text_or_empty(text_col)
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.length(text) == F.col(n)) & (F.sha2(F.regexp_replace(text, SPACE + "+", "").cast("binary"), 256) == F.col(sha))
    return docs.join(kept, same, "left_semi")
