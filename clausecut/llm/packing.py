"""Best-fit decreasing packing of documents in sequences of a fixed number of tokens.

Texts become token ids in Arrow batches. A document with more tokens than a sequence is cut in full pieces and a rest.
Pieces of equal length are alike, so best-fit decreasing over all pieces needs only how many there are of each length:
at most SEQUENCE numbers, whatever the input's size. The driver walks the lengths from the longest; a segment tree over
remaining capacities finds the tightest open bins in logarithmic time, and runs of equal bins take equal pieces
together. The result is what one-by-one best-fit decreasing gives. It is a plan of runs (pieces j.. of length L go to
bins b.. at offset o), whose size is bounded by SEQUENCE too; it is broadcast. Pieces get their rank within their length
by two levels of prefix sums and look up their run.

Scale: after the tokenizer only (id, piece, start, length, crc) move. No task holds a length or all pieces.

Null counts as an empty text, which is one piece of one token, the end. Repeated rows, and rows without a doc_id, are packed
each. A very long text is encoded whole and gives as many pieces as it needs. Other columns are not read.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausecut.llm.common import Scratch, chunk_bits, running, tidy, top_bits

SEQUENCE = 2048
TOKENIZER = "word_bpe_49k.json"
END = 0
#: Most words a worker remembers the ids of; then it starts anew.
REMEMBERED = 700_000
#: Texts encoded at once, which bounds a worker's memory.
TEXTS = 2048
#: Marks that no token shares with letters before them. The apostrophe is not one.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_tokenizers: dict[str, tuple] = {}


def _tokenizer(name: str):
    """A tokenizer file by its path, or by its name among the public ones that are installed where the worker runs; what is known so far; which ids end a word."""
    if name not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        ends = np.zeros(max(t.get_vocab().values()) + 1, dtype=bool)
        ends[[i for x, i in t.get_vocab().items() if x.endswith("</w>")]] = True
        _tokenizers[name] = (t, {"": b""}, ends)
    return _tokenizers[name]


def _encode(strings: list[str], tokenizer, known: dict[str, bytes]) -> None:
    for x, e in zip(strings, tokenizer.encode_batch_fast(strings, add_special_tokens=False), strict=True):
        known[x] = np.asarray(e.ids, dtype="<u4").tobytes()


def _encode_words(words: list[str], tokenizer, known: dict[str, bytes], ends: np.ndarray) -> None:
    """Words of letters alone are encoded many at once and told apart by the ids that end a word."""
    runs = [words[i : i + 1024] for i in range(0, len(words), 1024)]
    for run, e in zip(runs, tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
        ids = np.asarray(e.ids, dtype="<u4")
        stop = (np.flatnonzero(ends[ids]) + 1) * 4
        if len(stop) != len(run):  # letters that normalization takes apart
            _encode(run, tokenizer, known)
            continue
        raw, at = ids.tobytes(), 0
        for w, end in zip(run, stop.tolist(), strict=True):
            known[w] = raw[at:end]
            at = end


def _all_letters(core: str) -> bool:
    """Whether a word is letters alone, also as the tokenizer normalizes it: a dot above or a nukta that comes apart from its letter is none, and joins the marks after it."""
    return core.isalpha() and (core.isascii() or unicodedata.normalize("NFC", core).lower().isalpha())


def _looked_up(parts: list[str], tokenizer, known: dict[str, bytes], ends: np.ndarray) -> list[bytes]:
    """Ids of each part. Letters with ASCII marks after them are two tokens' worth of text, split between; ASCII letters count in lower case, as for the tokenizer."""
    out = list(map(known.get, parts))
    words, rest, two = set(), set(), []
    for i, x in enumerate(parts):
        if out[i] is None:
            core = x.rstrip(MARKS)
            if _all_letters(core):
                tail = x[len(core) :]
                if core.isascii():
                    core = core.lower()
                if core not in known:
                    words.add(core)
                if tail not in known:
                    rest.add(tail)
                two.append((i, core, tail))
            else:
                rest.add(x)
                two.append((i, x, ""))
    _encode_words(list(words), tokenizer, known, ends)
    _encode(list(rest), tokenizer, known)
    for i, a, b in two:
        out[i] = known[a] + known[b]
    return out


def encoded(texts: pa.Array, name: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids one after another, and where each text's begin and end; without special tokens.

    This vocabulary's tokens never reach over ASCII white space, and it drops that; so the ids of a text are those of its
    parts between. Arrow splits the texts and numbers the distinct parts; only those are looked up or encoded.
    """
    tokenizer, known, ends = _tokenizer(name)
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = parts.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    if len(known) > REMEMBERED:
        known.clear()
        known[""] = b""
    own = _looked_up(distinct, tokenizer, known, ends)
    size = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
    flat, start, which = np.frombuffer(b"".join(own), dtype="<u4"), np.cumsum(size) - size, coded.indices.to_numpy()
    each = size[which]
    end = np.cumsum(each)
    ids = flat[np.repeat(start[which] - (end - each), each) + np.arange(int(each.sum()))]
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    return ids, np.concatenate([[0], end])[offsets]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """A row per piece: rid, doc_id, piece, start, length, ids_crc32, and with_ids the ids themselves."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"rid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.asarray([END], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(a, TEXTS) for whole in batches for a in range(0, whole.num_rows, TEXTS)):
            ids, at = encoded(b.column("text"), tokenizer)
            doc, piece, crc, lengths, own = [], [], [], [], []
            for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                raw = ids[a:z].tobytes() + end
                for k in range(0, len(raw), 4 * size):
                    x = raw[k : k + 4 * size]
                    doc.append(i)
                    piece.append(k // (4 * size))
                    lengths.append(len(x) // 4)
                    crc.append(zlib.crc32(x))
                    if with_ids:
                        own.append(np.frombuffer(x, "<i4"))
            rows, number = pa.array(doc, pa.int32()), pa.array(piece, pa.int32())
            columns = {"rid": b.column("rid").take(rows), "doc_id": b.column("doc_id").take(rows), "piece": number, "start": pc.multiply(number.cast(pa.int64()), size), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(own, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(cut), schema)


class CapacityTree:
    """Runs of open bins by remaining capacity; a segment tree tells the least capacity of at least so much that has any."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, r: int) -> None:
        i = r + self.leaves
        self.any[i] = bool(self.runs[r])
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def push(self, r: int, first: int, n: int) -> None:
        if r and n:
            self.runs[r].append((first, n))
            self._mark(r)

    def pop(self, r: int) -> tuple[int, int]:
        out = self.runs[r].pop()
        self._mark(r)
        return out

    def tightest(self, least: int) -> int | None:
        """The least capacity, at least `least`, of an open bin."""
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Rows (length, first rank, pieces, first bin, offset) by length and rank: best-fit decreasing over so many pieces of each length."""
    tree, bins, out = CapacityTree(size), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                each = size // length
                first, n, r = bins, -(-left // each), size
                bins += n
            else:
                first, n = tree.pop(r)
                each = r // length
            full = min(n, left // each)
            for t in range(each if full else 0):
                out.append((length, rank, full, first, size - r + t * length))
                rank += full
            left -= full * each
            tree.push(r - each * length, first, full)
            if full < n:
                rest = min(left, each - 1)
                for t in range(rest):
                    out.append((length, rank, 1, first + full, size - r + t * length))
                    rank += 1
                left -= rest
                if rest:
                    tree.push(r - rest * length, first + full, 1)
                tree.push(r, first + full + bool(rest), n - full - bool(rest)) if r < size else None
    return np.asarray(sorted(out), dtype="int64").reshape(-1, 5)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the ids."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = scratch.write(pieces(docs, id_col, text_col, tokenizer, size, with_ids), "pieces")
    counts = {int(r["length"]): int(r["count"]) for r in rows.groupBy("length").count().collect()}  # at most `size` rows
    runs = spark.sparkContext.broadcast(plan(counts, size))
    ranked = rows.withColumn("chunk", top_bits(F.xxhash64("rid", "piece"), chunk_bits(sum(counts.values()))))
    ranked = running(ranked, ["length"], "chunk", [F.col("rid"), F.col("piece")], F.lit(1).cast("long"), "rank")

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = runs.value
        at = np.searchsorted((p[:, 0] << 48) + p[:, 1], (length.to_numpy() << 48) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": p[at, 3] + rank.to_numpy() - p[at, 1], "offset": p[at, 4]})

    out = ranked.withColumn("place", placed("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", *(["ids"] if with_ids else []))


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """From packed(with_ids=True): sequence_id and its ids in order. A group is one sequence, so it is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
