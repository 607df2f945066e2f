"""A trie of conversations by distributed radix partitioning, most significant turn first.

Turns become numbers: a dictionary gives each distinct (role, text) a number that rises with its SHA-256. Conversations are
rebuilt (the first turns come from another one) and stand as one row of numbers each; equal ones become one row.

Rows start in one bucket, the root's. A bucket of more than LOCAL rows is cut by its next turn: what all its rows have in
common (the common beginning of its least and its greatest row) gives a chain of nodes, then a node where they part, and each
next turn a bucket below. Rounds go on until all buckets are local. Local ones go to tasks whole, where multikey quicksort
orders their rows turn by turn and the recursion emits the nodes with the totals of their subtrees. The totals of the nodes
above are sums over the buckets below, from the last round to the first.

Scale: texts are hashed where they are read and never move. A dictionary entry that many turns share is sent to all tasks
(at most 1/HOT of the entries can be such); the others meet their turns by a shuffle. A bucket in a task has at most LOCAL rows;
counting, cutting and chaining of larger ones is partial aggregation. Rounds are bounded by the depth at which more than LOCAL
different conversations still agree. Members' ids are joined by blocks of BLOCK in order of the ids and hashed as a stream, so
no task holds a group of copies. One conversation is one row: 12 bytes a turn.

Null roles and texts count as empty. Turns are ordered by turn, null first; ties by the SHA-256 of role and text. Repeated
rows are turns of their own. Rows without a conv_id belong to no conversation. An empty table has no nodes, not even a root.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausecut.llm.common import WORD, Scratch, by_key, tidy, text_or_empty

LOCAL = 256
HOT = 1000
BLOCK = 512
GROUP, MOST_HEAD = 20, 4
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_hash() -> Column:
    """SHA-256 of a role and a text; the role's length tells where it ends."""
    role = text_or_empty("role")
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text_or_empty("text")).cast("binary"), 256))


def encoded(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, id, words): turns by their number in the dictionary."""
    words = F.size(F.regexp_extract_all(text_or_empty("text"), F.lit(WORD), F.lit(0)))
    rows = scratch.write(conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_hash().alias("h"), words.alias("words")), "turns")
    counted = rows.groupBy("h").agg(F.count("*").alias("n"))
    dictionary = scratch.write(counted.repartitionByRange("h").sortWithinPartitions("h").select("h", "n", F.monotonically_increasing_id().alias("id")), "dictionary")
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    hot = dictionary.where(F.col("n") > total / HOT).select("h", "id")  # fewer than HOT
    known = rows.join(F.broadcast(hot), "h", "left")
    rest = known.where("id IS NULL").drop("id").join(dictionary.where(F.col("n") <= total / HOT).select("h", "id"), "h")
    columns = ("conv_id", "turn", "id", "words")
    return known.where("id IS NOT NULL").select(*columns).unionByName(rest.select(*columns))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, words): of each conversation c, the first h turns of conversation c - c % 20, then its own after its first h; h is crc32(c) % 4."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id", "words")))
    own = turns.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.transform("t", lambda t: t["id"]).alias("ids"), F.transform("t", lambda t: t["words"]).alias("words"))
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, MOST_HEAD - 1).alias("head"), F.slice("words", 1, MOST_HEAD - 1).alias("head_words"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD).cast("int")
    both = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % GROUP}).join(heads, "base", "left")

    def spliced(head: str, tail: str) -> Column:
        empty = F.array().cast(both.schema[tail].dataType)
        after = F.slice(F.col(tail), F.col("h") + 1, F.greatest(F.size(tail), F.lit(1)))
        return F.concat(F.slice(F.coalesce(head, empty), F.lit(1), F.col("h")), after)

    return both.select("conv_id", spliced("head", "ids").alias("ids"), spliced("head_words", "words").alias("words"))


def joined_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by ids and block, a row for each ids: copies are counted, and the members' ids hashed one block after the other."""
    key, held = None, None

    def told(rows: list) -> pa.RecordBatch:
        ids, words, n, first, ends = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.RecordBatch.from_pydict({
            "ids": pa.array([np.frombuffer(x, "<i8") for x in ids], pa.list_(pa.int64())), "words": pa.array([np.frombuffer(x, "<i4") for x in words], pa.list_(pa.int32())),
            "n": pa.array(n, pa.int64()), "first": pa.array(first, pa.int64()), "ends": pa.array([e.hexdigest() for e in ends], pa.string()),
        })

    for b in batches:
        out, column, words = [], b.column("ids"), b.column("words")
        at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        at_words, flat_words = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False)
        for i, (n, first, members) in enumerate(zip(b.column("n").to_pylist(), b.column("first").to_pylist(), b.column("members").to_pylist(), strict=True)):
            own = flat[at[i] : at[i + 1]].astype("<i8").tobytes()
            if own == key:
                held[2] += n
                held[3] = min(held[3], first)
                held[4].update(b"," + members.encode())
                continue
            if held:
                out.append(held)
            key, held = own, [own, flat_words[at_words[i] : at_words[i + 1]].astype("<i4").tobytes(), n, first, hashlib.sha256(members.encode())]
        yield told(out)
    if held:
        yield told([held])


def sequences(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(ids, words, n, first, ends) of the distinct rebuilt conversations: how many are such, the least of their conv_ids, and the hash of all of them; and that all are in the root's bucket."""
    whole = rebuilt(encoded(conversations, scratch)).repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    rows = scratch.write(whole.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1)), "rebuilt")
    members = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = rows.groupBy("ids", "block").agg(F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("first"), members.alias("members"))
    by = F.xxhash64("ids")
    blocks = blocks.repartition(by).sortWithinPartitions(by, "ids", "block").select("ids", "words", "n", "first", "members")
    whole = blocks.mapInArrow(tidy(joined_members), "ids array<long>, words array<int>, n long, first long, ends string")
    root = {"pno": F.lit(-1).cast("long"), "nid": F.lit(-1).cast("long"), "up": F.lit(None).cast("long"), "depth": F.lit(0).cast("long"), "top_words": F.lit(0)}
    return scratch.write(whole.withColumns(root), "sequences")


def trie(items: list[tuple], depth: int, top_words: int, up: int | None) -> list[list]:
    """Nodes of one bucket as columns, the top first, by multikey quicksort. An item has ids and words after the top, n, first and ends; no two have the same ids."""
    conv, level, parent, convs, saved, ends, over = [], [], [], [], [], [], []
    # rows, how many of their ids are settled, the node above, and whether they agree on the last settled one
    stack = [(items, 0, -1, True)]
    while stack:
        rows, p, above, agree = stack.pop()
        if agree:
            own = len(conv)
            n = sum(r[2] for r in rows)
            conv.append(min(r[3] for r in rows))
            level.append(depth + p)
            parent.append(conv[above] if above >= 0 else up)
            convs.append(n)
            saved.append((n - 1) * (rows[0][1][p - 1] if p else top_words))
            ends.append(NO_ENDS)
            over.append(above)
            for k, r in enumerate(rows):
                if len(r[0]) == p:
                    ends[own] = r[4]
                    rows = rows[:k] + rows[k + 1 :]
                    break
            above = own
            if len(rows) == 1:  # a tail that no other row shares
                _, words, n, first, last = rows[0]
                m = len(words) - p
                conv += [first] * m
                level += range(depth + p + 1, depth + p + 1 + m)
                parent += [conv[above], *[first] * (m - 1)]
                convs += [n] * m
                saved += [(n - 1) * w for w in words[p:]]
                ends += [*[NO_ENDS] * (m - 1), last]
                over += [above, *range(own + 1, own + m)]
                continue
        if rows:
            pivot = sorted((rows[0][0][p], rows[len(rows) // 2][0][p], rows[-1][0][p]))[1]
            less, same, more = [], [], []
            for r in rows:
                x = r[0][p]
                (same if x == pivot else less if x < pivot else more).append(r)
            stack += [(more, p, above, False)] * bool(more) + [(same, p + 1, above, True)] + [(less, p, above, False)] * bool(less)
    size = len(conv)
    children, leaves = [0] * size, [0] * size
    for k in range(size - 1, -1, -1):  # what is below a node comes after it
        leaves[k] = leaves[k] or 1
        above = over[k]
        if above >= 0:
            children[above] += 1
            leaves[above] += leaves[k]
            saved[above] += saved[k]
    return [conv, level, parent, convs, children, leaves, saved, ends]


def local_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of whole buckets; a bucket's top has its number above as pno."""
    names = [f.split()[0] for f in NODE.split(", ")]
    for lot in by_key(batches, "pno", "nid"):
        key = lot[["pno", "nid"]].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(lot)]
        columns: list[list] = [[] for _ in names]
        tops: list = []
        fields = [lot[c].tolist() for c in ("ids", "words", "n", "first", "ends")]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            items = [(i.tolist(), w.tolist(), n, f, e) for i, w, n, f, e in zip(*(c[a:z] for c in fields), strict=True)]
            up = lot["up"].iloc[a]
            found = trie(items, int(lot["depth"].iloc[a]), int(lot["top_words"].iloc[a]), None if pd.isna(up) else int(up))
            for c, more in zip(columns, found, strict=True):
                c += more
            tops += [int(lot["pno"].iloc[a]), *[None] * (len(found[0]) - 1)]
        out = pd.DataFrame({n: pd.array(c, dtype="Int64") if n != "ends_sha256" else c for n, c in zip(names, columns, strict=True)})
        out["pno"] = pd.array(tops, dtype="Int64")
        yield out


def few(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for at most 65,536 rows of a few numbers each, else df for a shuffle join."""
    return F.broadcast(df) if rows <= 1 << 16 else df


def cut(rows: DataFrame, number: int, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """One round: rows of local buckets, large buckets, and the latter's rows in buckets below."""
    sizes = rows.groupBy("pno", "nid").agg(F.count("*").alias("size")).where(F.col("size") > most)
    large = scratch.write(sizes.select("pno", "nid", (F.monotonically_increasing_id() + F.lit(number << 48)).alias("no")), "large")
    many = large.count()
    if not many:
        return rows, None, None
    marked = rows.join(few(large, many), ["pno", "nid"], "left")
    local = scratch.write(marked.where("no IS NULL").drop("no"), "local")
    inside = marked.where("no IS NOT NULL")
    low = F.min(F.struct("ids", "words"))
    seen = inside.groupBy("no").agg(*[F.first(c).alias(c) for c in ("pno", "up", "depth", "top_words")], F.sum("n").alias("n"), F.min("first").alias("first"), low.alias("low"), F.max("ids").alias("high"))
    agree = F.array_position(F.zip_with("low.ids", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False)) - 1  # a shorter row is filled up with nulls
    chains = scratch.write(seen.select("no", "pno", "up", "depth", "n", "first", agree.alias("common"), F.concat(F.array("top_words"), F.slice("low.words", F.lit(1), agree.cast("int"))).alias("words")), "chains")
    known = few(chains.select("no", "common", F.col("first").alias("above")), many)
    parted = inside.join(known, "no").withColumn("common", F.col("common").cast("int"))
    here = parted.where("size(ids) = common").select("no", "ends")
    chains = scratch.write(chains.join(few(here, many), "no", "left"), "chains")
    after = parted.where("size(ids) > common").select(
        F.col("no").alias("pno"), F.element_at("ids", F.col("common") + 1).alias("nid"), F.col("above").alias("up"), (F.col("depth") + F.col("common") + 1).alias("depth"), F.element_at("words", F.col("common") + 1).alias("top_words"),
        F.slice("ids", F.col("common") + 2, F.size("ids")).alias("ids"), F.slice("words", F.col("common") + 2, F.size("ids")).alias("words"), "n", "first", "ends",
    )
    return local, chains, scratch.write(after, "open")


def nodes(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(conversations.sparkSession, "trie")
    rows = sequences(conversations, scratch)
    parts, rounds = [], []
    while rows is not None:
        finished, chains, rows = cut(rows, len(rounds) + 1, local, scratch)
        parts.append(finished)
        rounds += [chains] if chains is not None else []
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    below = every.repartition("pno", "nid").sortWithinPartitions("pno", "nid").mapInPandas(tidy(local_nodes), f"{NODE}, pno long")
    below = scratch.write(below, "nodes")
    out, columns = [below.drop("pno")], below.drop("pno").columns
    tops = below.where("pno IS NOT NULL").select("pno", "n_leaves", "saved_tokens")
    for chains in reversed(rounds):
        under = tops.groupBy(F.col("pno").alias("no")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        steps = chains.join(under, "no").select("*", F.posexplode("words").alias("step", "w"))
        by = Window.partitionBy("no").orderBy(F.col("step").desc())
        last = F.col("step") == F.col("common")
        made = scratch.write(steps.select(
            F.col("first").alias("conv_id"), (F.col("depth") + F.col("step")).alias("depth"), F.when(F.col("step") == 0, F.col("up")).otherwise(F.col("first")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves", (F.col("below") + F.sum((F.col("n") - 1) * F.col("w")).over(by)).alias("saved_tokens"),
            F.when(last & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"), F.when(F.col("step") == 0, F.col("pno")).alias("pno"),
        ), "upper")
        out.append(made.select(*columns))
        tops = tops.unionByName(made.where("pno IS NOT NULL").select("pno", "n_leaves", "saved_tokens"))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole
