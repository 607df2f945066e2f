r"""Language-model scoring with a hierarchical Pitman-Yor model.

scored() takes the word before as a word's context: see word_contexts.py. What follows is the coarser model that it fits with
by_class=True.

A word's context is the class of the word before it: one of CLASSES, by a hash (a text's first word has the class of the
empty word). Each class is a restaurant; all share one parent, the unigram restaurant, whose base is uniform over the V
training words and one more, unknown, word. A dish is a word, so everything about a word - its customers and tables in
each restaurant, and in the parent - is sampled in one place.

Gibbs: seating starts with one table for each dish and restaurant (Kneser-Ney's state). A sweep takes, for each dish and
restaurant, all customers out and seats them again at a number of tables drawn by the Chinese-restaurant weights, of
which a new table's is (theta + d T) times what the parent gives the word (see seating.py); then all customers of the
dish in the parent, which are the tables below it, are seated again. A sweep sees the exact totals of tables after the
sweep before, summed over all words, less the pair's own. Its random numbers are hashes of word, class and sweep. So the
result is the same however words are dealt to workers. After BURN_IN sweeps SAMPLES more are kept; predictive
probabilities are averaged over them, so they sum to one.

Scoring: the words of the highest counts (at most FREQUENT, so bounded) are broadcast with their scores after each class and
looked up where the texts are; the other words of each batch go to their word's shard, are scored there, and come back as
sums by document. Every token of every document is scored, and all training tokens are counted.

Scale: counts are combined in each batch before they move; a word with many rows is combined once more by a salt before
all its rows meet, in partitions of about MERGED rows at any size of the input. Sweeps read and write packed rows
of some thousand words, without a shuffle. Nothing that grows with the corpus goes to the driver: totals are
CLASSES x SAMPLES numbers. A very long text is read in one piece by one worker, as its batch is.

Null counts as an empty text: one token, the end. A null doc_id counts as the empty string for the split. Repeated rows
are scored each. With no training tokens every word has count 0 and scores are those of the uniform base.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausecut.llm import word_contexts
from clausecut.llm.common import Scratch, tidy
from clausecut.llm.seating import BURN_IN, D1, SAMPLES, THETA, THETA1, D, Weights, mixed, seated

CLASSES = 256
FREQUENT = 1 << 15
#: Tokens looked up at once, documents read at once, counted together, and looked up together, which bounds a worker's memory.
SLICE, TEXTS, COMBINED, LOOKED_UP = 1 << 18, 1024, 3072, 3072
#: Rows merged in one partition, and words in a packed row.
MERGED, PACKED = 200_000, 10_000
END = b"\n"  # no word has a line's end
FOLDS, HELD_OUT = 7, 2
#: In a batch, a word with so many occurrences goes through the salted stage.
BUSY, SALTS = 512, 64


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def class_of(word: bytes) -> int:
    return zlib.crc32(word) % CLASSES


class Numbered:
    """Words in the order of their first use, through any number of lots of texts."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.classes = np.zeros(0, dtype=np.uint8)

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token of the texts: its word's number, its context's class and its text's place."""
        ids, sizes = [], []
        for t in texts:
            words = (t or b"").lower().split()  # of bytes: ASCII only
            words.append(END)
            ids.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int32, count=len(words)))
            sizes.append(len(words))
        known = len(self.classes)
        new = np.fromiter(map(class_of, itertools.islice(self.number, known, None)), dtype=np.uint8, count=len(self.number) - known)
        self.classes = np.concatenate([self.classes, new])
        flat = np.concatenate(ids)
        context = np.empty(len(flat), dtype=np.uint8)
        context[1:] = self.classes[flat[:-1]]
        context[np.cumsum([0, *sizes[:-1]])] = class_of(b"")
        return flat, context, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def _lots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, TEXTS):
        yield batch.slice(a, TEXTS)


def _by_word(words: list, of: np.ndarray, classes: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Rows (word, classes, counts) from triples sorted by word."""
    cut = np.flatnonzero(np.diff(of)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(of)]])
    c, k = classes.astype(np.uint8).tobytes(), n.astype("<i8").tobytes()
    total = np.add.reduceat(n, starts)
    return pd.DataFrame({
        "word": [words[i] for i in of[starts].tolist()],
        "c": total,
        "classes": [c[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)],
        "counts": [k[8 * a : 8 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)],
    })


WORD_ROW = "word binary, c long, classes binary, counts binary"
WORD_SCHEMA = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("classes", pa.binary()), ("counts", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(a, COMBINED) for whole in batches for a in range(0, whole.num_rows, COMBINED)):
        words, keys = Numbered(), []
        for lot in _lots(batch):
            flat, context, _ = words.read(lot.column("text").cast(pa.binary()).to_pylist())
            keys.append(flat.astype(np.int64) * CLASSES + context)
        if keys:
            key = np.concatenate(keys)
            keys.clear()
            key.sort()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n, key = np.diff(np.concatenate([starts, [len(key)]])), key[starts]
            yield pa.RecordBatch.from_pandas(_by_word(list(words.number), key // CLASSES, key % CLASSES, n), WORD_SCHEMA, preserve_index=False)


def _merged(b: pd.DataFrame) -> pd.DataFrame:
    """Rows of equal words become one."""
    number, words = pd.factorize(b["word"])
    each = b["classes"].map(len).to_numpy()
    of = np.repeat(number, each)
    classes = np.frombuffer(b"".join(b["classes"]), dtype=np.uint8)
    n = np.frombuffer(b"".join(b["counts"]), dtype="<i8")
    key, back = np.unique(of.astype(np.int64) * CLASSES + classes, return_inverse=True)
    return _by_word(list(words), key // CLASSES, key % CLASSES, np.bincount(back, weights=n).astype(np.int64))


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each word of a partition, which holds some MERGED rows."""
    rows = [b for b in batches if len(b)]
    if rows:
        yield _merged(pd.concat(rows, ignore_index=True))


def _dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """Rows of a word meet. Partitions are as many as n, the number of rows, asks for, so a worker's share stays the same; words with many rows have been salted."""
    return rows.repartition(max(1, n // MERGED), *by).select("word", "c", "classes", "counts").mapInPandas(tidy(_merge), WORD_ROW)


def counted(train: DataFrame, scratch: Scratch) -> DataFrame:
    """A row per training word: its count, and its counts by context class."""
    rows = scratch.write(train.select("text").mapInArrow(tidy(_count), WORD_ROW), "batches")
    rows = rows.withColumn("salt", F.when(F.col("c") >= BUSY, F.pmod(F.xxhash64("counts", F.spark_partition_id()), F.lit(SALTS))).otherwise(F.lit(-1).cast("long")))
    n = rows.count()
    busy = _dealt(rows.where("salt >= 0"), n, "word", "salt")
    return _dealt(rows.where("salt < 0").select("word", "c", "classes", "counts").unionByName(busy), n, "word")


def sweep(names: np.ndarray, word: np.ndarray, context: np.ndarray, count: np.ndarray, t: np.ndarray, t1: np.ndarray, totals: np.ndarray, vocabulary: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Gibbs sweep over some words' pairs: their new tables, and customers and tables in the parent.

    names are hashes of the words; word, context and count belong to pairs that sat at t tables; the words sat at t1 tables
    in the parent; totals are the tables by class and the parent's, over all words. All contexts of a word are drawn at once
    from the tables that the others had before the sweep, not one after the other; so words do not wait for each other, and
    what a sweep does not see of the others' moves, the next one does.
    """
    below, top, base = totals[:CLASSES].astype(np.float64), float(totals[CLASSES]), 1.0 / (vocabulary + 1)
    c1 = np.bincount(word, weights=t, minlength=len(names)).astype(np.int64)
    live = np.flatnonzero(count > 1)  # a single customer has a table
    of, on, old = word[live], context[live], t[live]
    others = c1[of] - old
    given = others - D1 * np.minimum(t1[of], np.maximum(others, 1)) + (THETA1 + D1 * top) * base
    w = Weights(D, THETA + D * (below[on] - old), given, THETA1 + below.sum() - old)
    key = mixed(names[of] + (on.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    t = t.copy()
    t[live] = seated(count[live], old, w, key, turn)
    c1 = np.bincount(word, weights=t, minlength=len(names)).astype(np.int64)
    t1 = seated(c1, t1, Weights(D1, THETA1 + D1 * (top - t1), np.full(len(names), base), None), mixed(names), turn)
    return t, c1, t1


#: Some thousand words in one row: their pairs' classes, counts and tables one after another, and for each sample the parent's customers and tables.
#: Counts are in _short form.
PACKED_ROW = "words array<binary>, c binary, each binary, classes binary, counts binary, tables binary, sums binary, t1 binary, parents array<binary>, totals array<long>"
MODEL_ROW = "word binary, c long, classes binary, counts binary, tables binary, c1 array<long>, t1 array<long>"


def _short(a: np.ndarray) -> bytes:
    """Counts, a byte each; those from 255 on follow in full."""
    a = np.asarray(a)
    return np.minimum(a, 255).astype(np.uint8).tobytes() + a[a >= 255].astype("<i8").tobytes()


def _full(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words' rows at the start: one table for each pair, and one for each word in the parent. Totals: tables by class, the parent's, and customers by class."""
    for b in (whole.iloc[a : a + PACKED] for whole in batches for a in range(0, len(whole), PACKED)):
        each, classes, counts = b["classes"].map(len).to_numpy(), b"".join(b["classes"]), np.frombuffer(b"".join(b["counts"]), "<i8")
        context = np.frombuffer(classes, np.uint8)
        totals = np.concatenate([np.bincount(context, minlength=CLASSES), [len(b)], np.bincount(context, weights=counts, minlength=CLASSES).astype(np.int64)])
        ones = _short(np.ones(len(classes)))
        yield pd.DataFrame([{"words": list(b["word"]), "c": _short(b["c"]), "each": _short(each), "classes": classes, "counts": _short(counts), "tables": ones, "sums": _short(np.zeros(len(classes))), "t1": _short(np.ones(len(b))), "parents": [], "totals": totals}])


def _swept(batches: Iterator[pd.DataFrame], totals: np.ndarray, vocabulary: int, turn: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for r in b.to_dict("records"):
            words, context = len(r["words"]), np.frombuffer(r["classes"], np.uint8).astype(np.int64)
            each, t1 = _full(r["each"], words), _full(r["t1"], words)
            count, t, sums = (_full(r[k], len(context)) for k in ("counts", "tables", "sums"))
            names = np.fromiter(map(xxhash.xxh3_64_intdigest, r["words"]), dtype=np.uint64, count=words)
            t, c1, t1 = sweep(names, np.repeat(np.arange(words), each), context, count, t, t1, totals, vocabulary, turn)
            r["tables"], r["t1"] = _short(t), _short(t1)
            if turn >= BURN_IN:
                r["sums"], r["parents"] = _short(sums + t), [*r["parents"], _short(c1), _short(t1)]
            r["totals"] = np.append(np.bincount(context, weights=t, minlength=CLASSES).astype(np.int64), t1.sum())
            yield pd.DataFrame([r])


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for r in b.to_dict("records"):
            words, pairs = len(r["words"]), len(r["classes"])
            ends = np.cumsum(_full(r["each"], words)).tolist()
            cuts = list(zip([0, *ends[:-1]], ends, strict=True))
            parents = np.array([_full(x, words) for x in r["parents"]])
            cut = lambda raw, width, cuts=cuts: [raw[width * a : width * z] for a, z in cuts]
            long = lambda raw, cut=cut, pairs=pairs: cut(_full(raw, pairs).astype("<i8").tobytes(), 8)
            yield pd.DataFrame({"word": list(r["words"]), "c": _full(r["c"], words), "classes": cut(r["classes"], 1), "counts": long(r["counts"]), "tables": long(r["sums"]), "c1": list(parents[::2].T), "t1": list(parents[1::2].T)})


def _totals(model: DataFrame) -> np.ndarray:
    """Sums over all rows: tables by class, the parent's, and, from _packed, customers by class."""
    out = np.zeros(2 * CLASSES + 1, dtype=np.int64)
    for r in model.select(F.posexplode("totals")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        out[r["pos"]] = r["n"]
    return out


def fitted(words: DataFrame, vocabulary: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """The words' rows with what the samples hold of them; and customers by class, then tables by class and the parent's of the samples, all in one row."""
    model = scratch.write(words.mapInPandas(tidy(_packed), PACKED_ROW), "sweep")
    scratch.drop("words")
    totals, kept, old = _totals(model), [], "sweep"
    customers = totals[CLASSES + 1 :]
    for turn in range(BURN_IN + SAMPLES):
        model = scratch.write(model.mapInPandas(tidy(partial(_swept, totals=totals, vocabulary=vocabulary, turn=turn)), PACKED_ROW), f"sweep{turn}")
        totals = _totals(model)
        kept.append(totals)
        scratch.drop(old)
        old = f"sweep{turn}"
    out = scratch.write(model.mapInPandas(tidy(_unpacked), MODEL_ROW), "model")
    scratch.drop(old)
    kept = np.array(kept[BURN_IN:])
    return out, np.concatenate([customers, kept[:, :CLASSES].ravel(), kept[:, CLASSES]])


class Predictor:
    """Averaged predictive probabilities from a word's row; what all words share is CLASSES x SAMPLES numbers."""

    def __init__(self, totals: np.ndarray, n: int, vocabulary: int):
        self.n, self.v = n, vocabulary
        customers = totals[:CLASSES].astype(np.float64)
        tables = totals[CLASSES : CLASSES * (1 + SAMPLES)].reshape(SAMPLES, CLASSES).astype(np.float64)
        top = totals[CLASSES * (1 + SAMPLES) :].astype(np.float64)
        self.below = THETA + customers
        self.back = (THETA + D * tables) / self.below  # sample, class
        self.top = (THETA1 + D1 * top) / (self.v + 1)
        self.top_below = THETA1 + tables.sum(axis=1)

    def parents(self, c1: np.ndarray, t1: np.ndarray) -> np.ndarray:
        """(words, samples) from the parent's customers and tables."""
        return (c1 - D1 * t1 + self.top) / self.top_below

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))

    def own(self, counts: np.ndarray, tables: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return (counts - D * tables / SAMPLES) / self.below[classes]

    def scores(self, parents: np.ndarray, classes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of occurrences: their word's parents, their classes, their own part."""
        return np.log10(own + np.einsum("os,so->o", parents, self.back[:, classes]) / SAMPLES)


def stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(-1, SAMPLES)


class Table:
    """Words' rows of the model as arrays, to look up (word, class) in."""

    def __init__(self, rows: pd.DataFrame, p: Predictor):
        each = rows["classes"].map(len).to_numpy().astype(np.int64)
        classes = np.frombuffer(b"".join(rows["classes"]), dtype=np.uint8)
        counts, tables = (np.frombuffer(b"".join(rows[k]), dtype="<i8") for k in ("counts", "tables"))
        self.key = np.repeat(np.arange(len(rows)), each) * CLASSES + classes  # rising: classes are sorted in a row
        self.part, self.p = p.own(counts, tables, classes), p
        self.parents, self.base = p.parents(stacked(rows["c1"]), stacked(rows["t1"])), p.base(rows["c"].to_numpy())

    def look_up(self, row: np.ndarray, classes: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for a in range(0, len(row), SLICE):
            r, c = row[a : a + SLICE], classes[a : a + SLICE]
            want = r.astype(np.int64) * CLASSES + c
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            out[a : a + SLICE] = self.p.scores(self.parents[r], c, np.where(self.key[at] == want, self.part[at], 0.0))
        return out


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, by_class: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    A word's context is the word before it; by_class=True takes that word's class instead, a coarser and cheaper model.
    """
    out = is_held_out(id_col) if held_out is None else held_out
    if not by_class:
        kind = docs.schema[id_col].dataType.simpleString()
        done = word_contexts.scored(docs.select(F.col(id_col).cast("string").alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text")))
        done = done.withColumn("doc_id", F.col("doc_id").cast(kind))
        return done.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return _scored_by_class(docs, id_col, text_col, out)


def _scored_by_class(docs: DataFrame, id_col: str, text_col: str, out: Column) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    docs = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    words = scratch.write(counted(docs.where(~F.col("held_out")), scratch), "words")
    scratch.drop("batches")
    step = F.floor(F.log2("c") * 16)
    bins = words.groupBy(step.alias("step")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()  # some hundred rows
    vocabulary, n, kept, cut = sum(r.v for r in bins), sum(r.n for r in bins), 0, None
    for r in sorted(bins, key=lambda r: -r.step):
        kept += r.v
        if kept > FREQUENT:
            break
        cut = r.step
    model, totals = fitted(words, vocabulary, scratch)
    model = model.withColumn("frequent", F.lit(False) if cut is None else step >= cut)
    predictor = Predictor(totals, n, vocabulary)

    def prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A frequent word's scores after each class."""
        every = np.arange(CLASSES)
        for b in batches:
            table = Table(b, predictor)
            rows = np.arange(len(b))
            scores = [table.look_up(np.repeat(rows[a : a + 256], CLASSES), np.tile(every, len(rows[a : a + 256]))).astype("<f4").tobytes() for a in range(0, len(b), 256)]
            raw = b"".join(scores)
            yield pd.DataFrame({"word": b["word"], "base": table.base, "scores": [raw[4 * CLASSES * i : 4 * CLASSES * (i + 1)] for i in range(len(b))]})

    top = model.where("frequent").drop("frequent").mapInPandas(prepared, "word binary, base double, scores binary").toArrow()  # at most FREQUENT rows
    number = {w: i for i, w in enumerate(top["word"].to_pylist())}
    shared = spark.sparkContext.broadcast((predictor, number, top["base"].to_numpy(), np.frombuffer(b"".join(top["scores"].to_pylist()), dtype="<f4").reshape(-1, CLASSES)))
    del top, number
    kind = docs.schema["doc_id"].dataType.simpleString()
    here = "rid long, doc_id string, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, rids binary, classes binary"
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("rids", pa.binary()), ("classes", pa.binary())])

    def filled(rows: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if isinstance(columns.get(f.name), (list, np.ndarray)) else columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, number, bases, scores = shared.value
        for batch in (whole.slice(a, LOOKED_UP) for whole in batches for a in range(0, whole.num_rows, LOOKED_UP)):
            words, rows, later = Numbered(), np.zeros(0, dtype=np.int32), []
            for lot in _lots(batch):
                flat, context, of = words.read(lot.column("text").cast(pa.binary()).to_pylist())
                new = np.fromiter((number.get(w, -1) for w in itertools.islice(words.number, len(rows), None)), dtype=np.int32, count=len(words.number) - len(rows))
                rows = np.concatenate([rows, new])
                row, size = rows[flat], lot.num_rows
                known = row >= 0
                base, score = np.zeros(size), np.zeros(size)
                if len(bases):
                    base = np.bincount(of[known], weights=bases[row[known]], minlength=size)
                    score = np.bincount(of[known], weights=scores[row[known], context[known]], minlength=size)
                yield filled(size, {"rid": lot.column("rid"), "doc_id": lot.column("doc_id"), "held_out": lot.column("held_out"), "n_tokens": np.bincount(of, minlength=size), "n_known": np.bincount(of[known], minlength=size), "base": base, "score": score})
                later.append((flat[~known], context[~known], lot.column("rid").to_numpy()[of[~known]]))
            if not later:
                continue
            flat, context, rids = (np.concatenate(x) for x in zip(*later, strict=True))
            if len(flat):  # the rare words: a row for each word of the batch
                order = np.argsort(flat, kind="stable")
                flat, classes, rids = flat[order], context[order].tobytes(), rids[order].astype("<i8").tobytes()
                cuts = np.flatnonzero(np.diff(flat)) + 1
                starts, ends, names = [0, *cuts.tolist()], [*cuts.tolist(), len(flat)], list(words.number)
                yield filled(len(starts), {"word": [names[i] for i in flat[starts].tolist()], "rids": [rids[8 * a : 8 * z] for a, z in zip(starts, ends, strict=True)], "classes": [classes[a:z] for a, z in zip(starts, ends, strict=True)]})

    seen = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text")
    seen = scratch.write(seen.mapInArrow(tidy(look), here), "seen")

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value[0]
        for b in batches:
            each = b["own"].map(len).to_numpy().astype(np.int64)
            rids = np.frombuffer(b"".join(b["rids"]), dtype="<i8")
            context = np.frombuffer(b"".join(b["own"]), dtype=np.uint8).astype(np.int64)
            has = b["c"].notna().to_numpy()
            row, base, score = np.repeat(np.cumsum(has) - 1, each), np.empty(len(rids)), np.empty(len(rids))
            known = np.repeat(has, each)
            if has.any():
                table = Table(b[has], p)
                base[known], score[known] = table.base[row[known]], table.look_up(row[known], context[known]).astype("<f4")  # as for the frequent words
            nothing = p.parents(np.zeros((1, SAMPLES)), np.zeros((1, SAMPLES)))
            base[~known] = p.base(np.zeros(1))[0]
            score[~known] = p.scores(np.repeat(nothing, int((~known).sum()), axis=0), context[~known], np.zeros(int((~known).sum()))).astype("<f4")
            of, back = np.unique(rids, return_inverse=True)
            sums = lambda x: np.bincount(back, weights=x, minlength=len(of))  # noqa: B023, E731
            yield pd.DataFrame({"rid": of, "n_known": sums(known).astype(np.int64), "base": sums(base), "score": sums(score)})

    rare = seen.where("word IS NOT NULL").select("word", "rids", F.col("classes").alias("own"))
    rare = rare.join(model.where("NOT frequent").drop("frequent"), "word", "left").mapInPandas(tidy(rest), "rid long, n_known long, base double, score double")
    rare = rare.groupBy("rid").agg(F.sum("n_known").alias("k2"), F.sum("base").alias("b2"), F.sum("score").alias("s2"))
    zero = F.lit(0)
    done = seen.where("word IS NULL").drop("word", "rids", "classes").join(rare, "rid", "left")
    done = done.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k2", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b2", zero)).alias("base_score"), (F.col("score") + F.coalesce("s2", zero)).alias("score"))
    return done.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
