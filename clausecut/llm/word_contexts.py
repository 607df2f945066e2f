r"""The hierarchical Pitman-Yor model of lm_scoring.py with the previous word itself as context.

Each word u is a restaurant whose dishes are the words after it; all share one parent, the unigram restaurant, whose base is
uniform over the V training words and one more, unknown, word. A text's first word follows the empty word.

Words have numbers: 16 bits of a hash of theirs, their slot, and 16 bits of rank among the words of that slot, most frequent
in training first. Batches of texts send hashes of their distinct words, 64 bits with another 64 to check them by, to where
the hashes meet, and get numbers and counts in training back; all is done again with another seed should two words share a
hash. So tokens are split and hashed once, and all that moves later is made of small numbers, whose bytes are compressed
plane by plane (pack).

A shard is the dishes of some slots, with all their pairs (context, count), as arrays in one row.
What a dish's shard lacks are totals of its contexts. It asks for them: a row with its contexts and its part of their
totals goes to each place where contexts meet, and comes back with the sums over all shards. A pair of one customer has one
table and is never drawn; so only contexts of pairs of several customers are asked for in a sweep. Sweeps, draws and random
numbers are those of lm_scoring.py: each sees the exact totals of the sweep before.

Scoring: a batch's pairs go to their dishes' shards, which have asked once for the customers and tables of all contexts of
training pairs and of held-out texts; batches get back a sum for each text from each shard. The base needs counts of words
alone, which batches have. Nothing that grows with the corpus goes to the driver or to all workers. A shard's model is held
whole, batches' pairs pass by one after the other.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausecut.llm.common import Scratch, tidy, trimmed
from clausecut.llm.seating import BURN_IN, D1, SAMPLES, THETA, THETA1, D, Weights, mixed, seated

#: Bytes of text whose words make a shard, documents counted together, and documents split into words at once.
SHARD, COMBINED, TEXTS = 8 << 20, 3072, 1024
END = b"\n"
U8 = np.uint64
#: The context of a text's first word: a rank that no word has.
EMPTY = U8((1 << 32) - 1)
#: Bytes of a number in each packed column.
WIDTHS = {"names": 8, "checks": 8, "contexts": 8, "own": 8, "sums": 8, "base": 8, "each": 4, "tokens": 4, "sizes": 4, "known": 4, "on": 4, "scores": 4, "texts": 2} | dict.fromkeys(("counts", "train", "held", "single", "word", "fixed", "tables", "t1", "samples", "parents", "numbers", "totals"), 1)
TOKENS_ROW = "batch long, shard long, names binary, checks binary, counts binary, tokens binary, sizes binary, held binary, ids array<string>"
NUMBERS_ROW = "shard long, v long, n long, clashes long, batches array<long>, numbers array<binary>, totals array<binary>"
PAIRS_ROW = "batch long, shard long, names binary, each binary, contexts binary, counts binary, train binary, texts binary, ids array<string>, sizes binary, held binary, known binary, base binary"
MODEL_ROW = "shard long, names binary, each binary, contexts binary, counts binary"
STATE_ROW = "shard long, names binary, single binary, word binary, on binary, contexts binary, fixed binary, counts binary, tables binary, t1 binary, samples array<binary>, parents array<binary>, top long, top1 long"
ASK_ROW = "place long, shard long, contexts binary, own binary, want long"
TOLD_ROW = "shard long, place long, contexts binary, sums binary"
LOOK_ROW = "shard long, kind int, batch long, names binary, each binary, contexts binary, counts binary, texts binary, sums binary, samples array<binary>, parents array<binary>"
SUMS_ROW = "batch long, shard long, texts binary, scores binary"
OUT_ROW = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def names_of(row: str) -> list[str]:
    return [c.split()[0] for c in row.split(", ")]


def framed(rows: list[dict], row: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names_of(row)})


def squeezed(raw: bytes, width: int) -> bytes:
    planes = np.frombuffer(raw, np.uint8).reshape(-1, width).T.tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def loose(raw: bytes, width: int) -> bytes:
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(pa.decompress(raw[4:], n, "zstd", asbytes=True), np.uint8).reshape(width, n // width).T.tobytes()


def each_blob(f, value, width: int):
    if value is None:
        return None
    return f(bytes(value), width) if isinstance(value, (bytes, bytearray)) else [f(x, width) for x in value]


def pack(b: pd.DataFrame) -> pd.DataFrame:
    """A frame whose arrays of numbers are compressed, byte plane by byte plane."""
    return b.assign(**{c: [each_blob(squeezed, x, WIDTHS[c]) for x in b[c]] for c in b.columns if c in WIDTHS})


def unpack(b: pd.DataFrame) -> pd.DataFrame:
    return b.assign(**{c: [each_blob(loose, x, WIDTHS[c]) for x in b[c]] for c in b.columns if c in WIDTHS})


def records(b: pd.DataFrame) -> Iterator[dict]:
    """Rows of a packed frame, unpacked one at a time."""
    for r in b.to_dict("records"):
        yield {c: each_blob(loose, x, WIDTHS[c]) if c in WIDTHS else x for c, x in r.items()}


def packing(f):
    """f over frames of a group or of two, packed where they move."""
    return lambda b: pack(f(unpack(b)))


def packing2(f):
    return lambda a, b: pack(f(unpack(a), unpack(b)))


def packing_rows(f):
    """f over the batches of a partition, each of one row."""
    return tidy(lambda batches: (pack(b) for b in f(unpack(b.iloc[i : i + 1]) for b in batches for i in range(len(b)))))


def unpacked(df: DataFrame) -> DataFrame:
    return df.mapInPandas(tidy(lambda batches: (unpack(b.iloc[i : i + 1]) for b in batches for i in range(len(b)))), df.schema)


def u8(raw) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def u4(raw) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.int64)


def short(a: np.ndarray) -> bytes:
    """Counts, a byte each; those from 255 on follow in full."""
    a = np.asarray(a)
    return np.minimum(a, 255).astype(np.uint8).tobytes() + a[a >= 255].astype("<i8").tobytes()


def full(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, COMBINED):
            yield whole.slice(a, COMBINED)
            trimmed()


def shard_of(numbers: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of slots."""
    return ((numbers >> U8(16)) * U8(shards) >> U8(16)).astype(np.int64)


def place_of(contexts: np.ndarray, places: int) -> np.ndarray:
    return ((contexts >> U8(16)) % U8(places)).astype(np.int64)


def cuts(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    cut = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(sorted_values)]])


def tokenized(batch: pa.RecordBatch, shards: int, seed: int) -> pd.DataFrame:
    """A row with a batch's tokens, as places of their words in the order of hashes, and one for each shard with its words and their counts in training texts."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids, sizes = [], []
    for a in range(0, batch.num_rows, TEXTS):
        for t in batch.column("text").slice(a, TEXTS).cast(pa.binary()).to_pylist():
            words = (t or b"").lower().split()  # of bytes: ASCII only
            words.append(END)
            ids.append(np.fromiter(map(number.__getitem__, words), dtype=np.uint32, count=len(words)))
            sizes.append(len(words))
    flat = np.concatenate(ids)
    del ids
    names, checks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, seed) for w in number), "<u8").reshape(-1, 2).T
    del number
    order = np.argsort(names)
    names, checks, at = names[order], checks[order], np.empty(len(order), np.uint32)
    at[order] = np.arange(len(order), dtype=np.uint32)
    flat = at[flat]
    held = np.array(batch.column("held_out").to_pylist(), dtype=bool)
    counts = np.bincount(flat[np.repeat(~held, sizes)], minlength=len(names))
    key = batch.column("rid")[0].as_py()
    rows = [{"batch": key, "tokens": flat.tobytes(), "sizes": np.array(sizes, "<u4").tobytes(), "held": held.tobytes(), "ids": batch.column("doc_id").to_pylist()}]
    shard = shard_of(names >> U8(32), shards)
    for a, z in zip(*(x.tolist() for x in cuts(shard)), strict=True):
        rows.append({"batch": key, "shard": int(shard[a]), "names": names[a:z].tobytes(), "checks": checks[a:z].tobytes(), "counts": short(counts[a:z])})
    return framed(rows, TOKENS_ROW)


def tokenize(batches: Iterator[pa.RecordBatch], shards: int, seed: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), *((c, pa.binary()) for c in names_of(TOKENS_ROW)[2:-1]), ("ids", pa.list_(pa.string()))])
    for batch in lots(batches):
        if batch.num_rows:
            b = pack(tokenized(batch, shards, seed))
            yield pa.RecordBatch.from_arrays([pa.array(b[f.name].tolist(), f.type) for f in schema], schema=schema)


def merged(b: pd.DataFrame) -> pd.DataFrame:
    """Numbers of a shard's words and their counts in training, for each row that names some."""
    sizes = [len(x) // 8 for x in b["names"]]
    names, checks = u8(b"".join(b["names"])), u8(b"".join(b["checks"]))
    n = np.concatenate([full(x, k) for x, k in zip(b["counts"], sizes, strict=True)])
    order = np.argsort(names)
    clashes = int(((names[order][1:] == names[order][:-1]) & (checks[order][1:] != checks[order][:-1])).sum())
    starts, ends = cuts(names[order])
    words, total = names[order][starts], np.add.reduceat(n[order], starts)
    slot = words >> U8(48)
    ranked = np.lexsort((words, -total, slot))
    first, last = cuts(slot[ranked])
    rank = np.arange(len(words)) - np.repeat(first, last - first)
    if rank.max() >= 0xFFFF:
        raise ValueError("more than 65,535 words in one of 65,536 slots")
    numbers, out, totals = np.empty(len(words), np.uint32), np.empty(len(names), np.uint32), np.empty(len(names), np.int64)
    numbers[ranked] = (slot[ranked] << U8(16) | rank.astype(U8)).astype(np.uint32)
    out[order], totals[order] = np.repeat(numbers, ends - starts), np.repeat(total, ends - starts)
    at = np.cumsum([0, *sizes]).tolist()
    parts = [slice(a, z) for a, z in itertools.pairwise(at)]
    return pd.DataFrame([{"shard": b["shard"].iloc[0], "v": int((total > 0).sum()), "n": int(total.sum()), "clashes": clashes, "numbers": [out[p].tobytes() for p in parts], "totals": [short(totals[p]) for p in parts]}])


def paired(tokens: pd.DataFrame, numbers: pd.DataFrame, shards: int) -> pd.DataFrame:
    """A row for a batch's texts, and one for each shard: its words, their pairs, how often in all and in training, and in which texts each occurs."""
    r = tokens.to_dict("records")[0]
    parts = numbers.sort_values("shard")
    number = np.concatenate([u4(x) for x in parts["numbers"]]).astype(U8)
    c = np.concatenate([full(t, len(x) // 4) for x, t in zip(parts["numbers"], parts["totals"], strict=True)])
    flat, sizes, held = u4(r["tokens"]), u4(r["sizes"]), np.frombuffer(r["held"], bool)
    of = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    rows = [{"batch": r["batch"], "ids": r["ids"], "sizes": r["sizes"], "held": r["held"], "known": np.bincount(of, weights=(c > 0)[flat]).astype("<u4").tobytes(), "base": np.bincount(of, weights=np.log10(c + 1.0)[flat]).tobytes()}]
    flat = number[flat]
    key = flat << U8(32)
    key[1:] |= flat[:-1]
    first = np.cumsum(sizes) - sizes
    key[first] = flat[first] << U8(32) | EMPTY
    del flat
    order = np.argsort(key, kind="stable")
    key, of = key[order], of[order]
    starts, ends = cuts(key)
    key, n = key[starts], ends - starts
    train = np.add.reduceat((~held)[of], starts, dtype=np.int64)
    word, before = key >> U8(32), key & EMPTY
    shard = shard_of(word, shards)
    for a, z in zip(*(x.tolist() for x in cuts(shard)), strict=True):
        first, last = cuts(word[a:z])
        rows.append({"batch": r["batch"], "shard": int(shard[a]), "names": word[a:z][first].tobytes(), "each": (last - first).astype("<u4").tobytes(), "contexts": before[a:z].tobytes(), "counts": short(n[a:z]), "train": short(train[a:z]), "texts": of[starts[a] : ends[z - 1]].tobytes()})
    return framed(rows, PAIRS_ROW)


def gathered(b: pd.DataFrame) -> pd.DataFrame:
    """The training pairs of a shard, sorted by word and context."""
    keys, counts = [], []
    for names, each, contexts, train in zip(b["names"], b["each"], b["contexts"], b["train"], strict=True):
        contexts = u8(contexts)
        n = full(train, len(contexts))
        keys.append((np.repeat(u8(names), u4(each)) << U8(32) | contexts)[n > 0])
        counts.append(n[n > 0])
    key, n = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return pd.DataFrame(columns=names_of(MODEL_ROW))
    order = np.argsort(key)
    key = key[order]
    starts, _ = cuts(key)
    key, n = key[starts], np.add.reduceat(n[order], starts)
    word = key >> U8(32)
    first, last = cuts(word)
    return pd.DataFrame([{"shard": b["shard"].iloc[0], "names": word[first].tobytes(), "each": (last - first).astype("<u4").tobytes(), "contexts": (key & EMPTY).tobytes(), "counts": short(n)}])


def asked(shard: int, contexts: np.ndarray, own: np.ndarray, places: int, wanted: np.ndarray | None = None) -> list[dict]:
    """A shard's rows to all places of its contexts: own (contexts, k) are its parts of their totals. The contexts that are wanted back come first, in their order."""
    wanted = np.ones(len(contexts), bool) if wanted is None else wanted
    place = place_of(contexts, places)
    order = np.lexsort((~wanted, place))
    if not len(order):
        return []
    return [{"place": int(place[order[a]]), "shard": shard, "contexts": contexts[order[a:z]].tobytes(), "own": own[order[a:z]].astype("<i8").tobytes(), "want": int(wanted[order[a:z]].sum())} for a, z in zip(*(x.tolist() for x in cuts(place[order])), strict=True)]


def told(b: pd.DataFrame) -> pd.DataFrame:
    """Sums over all shards of what they own of the contexts of a place, to each that asked."""
    contexts = u8(b"".join(b["contexts"]))
    own = np.frombuffer(b"".join(b["own"]), "<i8").reshape(len(contexts), -1)
    _, back = np.unique(contexts, return_inverse=True)
    sums = np.stack([np.bincount(back, weights=x).astype("<i8")[back] for x in own.T], axis=1)
    starts = np.cumsum([0, *(len(x) // 8 for x in b["contexts"])]).tolist()
    parts = list(zip(starts, b["want"].tolist(), strict=False))
    return pd.DataFrame({"shard": b["shard"], "place": b["place"], "contexts": [contexts[a : a + w].tobytes() for a, w in parts], "sums": [sums[a : a + w].tobytes() for a, w in parts]})


def heard(b: pd.DataFrame, contexts: np.ndarray, places: int, k: int) -> np.ndarray:
    """(contexts, k) from the rows that came back."""
    place = place_of(contexts, places)
    order = np.argsort(place, kind="stable")
    out = np.zeros((len(contexts), k), np.int64)
    if len(order):
        sums = {p: s for p, s in zip(b["place"], b["sums"], strict=True)}
        for a, z in zip(*(x.tolist() for x in cuts(place[order])), strict=True):
            out[order[a:z]] = np.frombuffer(sums[place[order[a]]], "<i8").reshape(-1, k)
    return out


def pairs_of(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's names of words, and its pairs' words (as places), contexts and counts."""
    names, each, contexts = u8(r["names"]), u4(r["each"]), u8(r["contexts"])
    return names, np.repeat(np.arange(len(names)), each), contexts, full(r["counts"], len(contexts))


def singles(batches: Iterator[pd.DataFrame], places: int) -> Iterator[pd.DataFrame]:
    """Asks for how many pairs of one customer the contexts of all other pairs have."""
    for b in batches:
        for r in b.to_dict("records"):
            _, _, contexts, n = pairs_of(r)
            every, back = np.unique(contexts, return_inverse=True)
            one = np.bincount(back, weights=n == 1, minlength=len(every)).astype(np.int64)
            wanted = np.bincount(back, weights=n > 1, minlength=len(every)) > 0
            some = wanted | (one > 0)
            if rows := asked(r["shard"], every[some], one[some, None], places, wanted[some]):
                yield pd.DataFrame(rows)


def begun(model: pd.DataFrame, answers: pd.DataFrame, places: int) -> pd.DataFrame:
    """The state at the start: a table for each pair, and one for each word in the parent."""
    out = []
    for r in model.to_dict("records"):
        names, word, contexts, n = pairs_of(r)
        live = n > 1
        every, on = np.unique(contexts[live], return_inverse=True)
        fixed = heard(answers, every, places, 1)[:, 0]
        single = np.bincount(word[~live], minlength=len(names))
        out.append({
            "shard": r["shard"], "names": r["names"], "single": short(single), "word": short(np.bincount(word[live], minlength=len(names))), "on": on.astype("<u4").tobytes(), "contexts": every.tobytes(), "fixed": short(fixed),
            "counts": short(n[live]), "tables": short(np.ones(len(on))), "t1": short(np.ones(len(names))), "samples": [], "parents": [], "top": len(n), "top1": len(names),
        })
    return pd.DataFrame(out, columns=names_of(STATE_ROW))


def tables(batches: Iterator[pd.DataFrame], places: int) -> Iterator[pd.DataFrame]:
    """Asks for the tables of the contexts of pairs that are drawn."""
    for b in batches:
        for r in b.to_dict("records"):
            contexts, on = u8(r["contexts"]), u4(r["on"])
            if rows := asked(r["shard"], contexts, np.bincount(on, weights=full(r["tables"], len(on)), minlength=len(contexts))[:, None], places):
                yield pd.DataFrame(rows)


def drawn(state: pd.DataFrame, answers: pd.DataFrame, places: int, top: int, top1: int, vocabulary: int, turn: int, kept: bool) -> pd.DataFrame:
    out = []
    for r in state.to_dict("records"):
        names, contexts, on = u8(r["names"]), u8(r["contexts"]), u4(r["on"])
        word = np.repeat(np.arange(len(names)), full(r["word"], len(names)))  # pairs are sorted by word
        n, t, t1, single = full(r["counts"], len(on)), full(r["tables"], len(on)), full(r["t1"], len(names)), full(r["single"], len(names))
        below = (heard(answers, contexts, places, 1)[:, 0] + full(r["fixed"], len(contexts)))[on].astype(np.float64)
        base = 1.0 / (vocabulary + 1)
        others = (np.bincount(word, weights=t, minlength=len(names)).astype(np.int64) + single)[word] - t
        given = others - D1 * np.minimum(t1[word], np.maximum(others, 1)) + (THETA1 + D1 * top1) * base
        key = mixed(names[word] + mixed(contexts[on] + U8(1)) * U8(0x9E3779B97F4A7C15))
        if len(t):
            t = seated(n, t, Weights(D, THETA + D * (below - t), given, THETA1 + top - t.astype(np.float64)), key, turn)
        c1 = np.bincount(word, weights=t, minlength=len(names)).astype(np.int64) + single
        t1 = seated(c1, t1, Weights(D1, THETA1 + D1 * (top1 - t1.astype(np.float64)), np.full(len(names), base), None), mixed(names), turn)
        r |= {"tables": short(t), "t1": short(t1), "top": int(c1.sum()), "top1": int(t1.sum())}
        if kept:
            r |= {"samples": [*r["samples"], short(t)], "parents": [*r["parents"], short(c1), short(t1)]}
        out.append(r)
    return pd.DataFrame(out, columns=list(state.columns))


def customers(b: pd.DataFrame, places: int) -> pd.DataFrame:
    """Asks for the customers and, by sample, the tables of all contexts of a shard's pairs and of held-out texts' pairs with its words. Kinds: 0 the model, 1 the state, 2 held-out texts' contexts."""
    extra = u8(b"".join(b.loc[b["kind"] == 2, "contexts"]))
    every = np.unique(extra)
    own = np.zeros((len(every), 1 + SAMPLES))
    state = b[b["kind"] == 1].to_dict("records")
    for r, s in zip(b[b["kind"] == 0].to_dict("records"), state, strict=True):
        _, _, contexts, n = pairs_of(r)
        every, back = np.unique(np.concatenate([contexts, extra]), return_inverse=True)
        back = back[: len(contexts)]
        t = np.ones((SAMPLES, len(n)))
        t[:, n > 1] = [full(x, int((n > 1).sum())) for x in s["samples"]]
        own = np.stack([np.bincount(back, weights=x, minlength=len(every)) for x in (n, *t)], axis=1)
    return pd.DataFrame(asked(int(b["shard"].iloc[0]), every, own, places), columns=names_of(ASK_ROW))


def held_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The contexts of held-out texts' pairs, by shard; packed, as what it reads is."""
    for b in batches:
        rows = []
        for r in records(b):
            contexts = u8(r["contexts"])
            held = full(r["counts"], len(contexts)) > full(r["train"], len(contexts))
            if held.any():
                rows.append({"shard": r["shard"], "contexts": np.unique(contexts[held]).tobytes()})
        if rows:
            yield pack(pd.DataFrame(rows))


def found(among: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in a sorted array, -1 for what is not there."""
    if not len(among):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return np.where(among[at] == x, at, -1)


class Shard:
    """A shard's part of the model: words, pairs, and the contexts it has asked for."""

    def __init__(self, n: int, vocabulary: int, top: np.ndarray, top1: np.ndarray):
        self.n, self.v = n, vocabulary
        self.new = (THETA1 + D1 * top1) / (vocabulary + 1)  # by sample
        self.top = THETA1 + top
        self.names, self.c, self.parents = np.zeros(0, U8), np.zeros(0, np.int64), np.zeros((0, SAMPLES))
        self.word, self.context, self.own = np.zeros(0, np.int64), np.zeros(0, U8), np.zeros(0)
        self.every, self.sums, self.answers = np.zeros(0, U8), np.zeros((0, 1 + SAMPLES), np.int64), []
        self.key, self.of_pairs = np.zeros(0, U8), np.zeros(0, "<f4")

    def model(self, r: dict) -> None:
        self.names, self.word, self.context, self.count = pairs_of(r)
        self.c = np.bincount(self.word, weights=self.count, minlength=len(self.names))

    def state(self, r: dict) -> None:
        live = self.count > 1
        tables = np.full(len(live), float(SAMPLES))
        tables[live] = np.sum([full(x, int(live.sum())) for x in r["samples"]], axis=0)
        self.own = self.count - D * tables / SAMPLES
        seats = [full(x, len(self.names)) for x in r["parents"]]
        self.parents = np.stack([c1 - D1 * t1 for c1, t1 in zip(seats[::2], seats[1::2], strict=True)], axis=1)

    def answer(self, contexts: bytes, sums: bytes) -> None:
        self.answers.append((u8(contexts), np.frombuffer(sums, "<i8").reshape(-1, self.sums.shape[1])))

    def ready(self) -> None:
        if self.answers:
            every, sums = (np.concatenate(x) for x in zip(*self.answers, strict=True))
            order = np.argsort(every)
            self.every, self.sums, self.answers = every[order], sums[order], []
            self.key = self.names[self.word] << U8(32) | self.context  # sorted
            self.of_pairs = self.logs_at(self.word, np.searchsorted(self.every, self.context), self.own)  # all are there

    def logs_at(self, word: np.ndarray, on: np.ndarray, own: np.ndarray | float) -> np.ndarray:
        """log10 of the model for words and contexts by their places, -1 for one that is not there."""
        known, met = word >= 0, on >= 0
        parents, sums = np.zeros((len(word), SAMPLES)), np.zeros((len(on), 1 + SAMPLES))
        parents[known], sums[met] = self.parents[word[known]], self.sums[on[met]]
        back = ((THETA + D * sums[:, 1:]) * (parents + self.new) / self.top).sum(axis=1) / SAMPLES
        return np.log10((own + back) / (THETA + sums[:, 0])).astype("<f4")

    def logs(self, names: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The same for words and contexts by their numbers. Training pairs have been worked out before."""
        at = found(self.key, names << U8(32) | contexts)
        new = np.flatnonzero(at < 0)
        if len(new) == len(at):
            out = np.empty(len(at), "<f4")
        else:
            out = self.of_pairs[at]
        out[new] = self.logs_at(found(self.names, names[new]), found(self.every, contexts[new]), 0.0)
        return out

    def scores(self, names: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether known, log10 of the base and of the model, for pairs of a word and its context."""
        word = found(self.names, names)
        c = np.zeros(len(word))
        c[word >= 0] = self.c[word[word >= 0]]
        return word >= 0, np.log10((c + 1) / (self.n + self.v + 1)), self.logs(names, contexts)


def summed(batches: Iterator[pd.DataFrame], fresh: partial) -> Iterator[pd.DataFrame]:
    """Rows of a partition, packed, by shard and kind: 0 the model, 1 the state, 2 answers, 3 batches' pairs."""
    shard, of, ready = None, None, False
    for b in batches:
        rows = []
        for r in records(b):
            if of != r["shard"]:
                shard, of, ready = fresh(), r["shard"], False
            if r["kind"] == 0:
                shard.model(r)
            elif r["kind"] == 1:
                shard.state(r)
            elif r["kind"] == 2:
                shard.answer(r["contexts"], r["sums"])
            else:
                if not ready:
                    shard.ready()
                    ready = True
                contexts = u8(r["contexts"])
                score = shard.logs(np.repeat(u8(r["names"]), u4(r["each"])), contexts)
                texts = np.frombuffer(r["texts"], "<u2")
                here = np.flatnonzero(np.bincount(texts))
                sums = np.bincount(texts, weights=np.repeat(score, full(r["counts"], len(contexts))))[here]
                rows.append({"batch": r["batch"], "shard": of, "texts": here.astype("<u2").tobytes(), "scores": sums.astype("<f4").tobytes()})
        if rows:
            yield pack(pd.DataFrame(rows))


def ended(texts: pd.DataFrame, sums: pd.DataFrame, unit: float) -> pd.DataFrame:
    """The texts of a batch with what all shards say of them."""
    out = []
    for r in texts.to_dict("records"):
        sizes, score = u4(r["sizes"]), np.zeros(len(r["ids"]))
        for s in sums.sort_values("shard").to_dict("records"):
            score[np.frombuffer(s["texts"], "<u2")] += np.frombuffer(s["scores"], "<f4")
        base = np.frombuffer(r["base"], "<f8") - sizes * unit
        out.append(pd.DataFrame({"doc_id": list(r["ids"]), "held_out": np.frombuffer(r["held"], bool), "n_tokens": sizes, "n_known": u4(r["known"]), "base_score": base, "score": score}))
    return pd.concat(out)


def numbered(docs: DataFrame, scratch: Scratch, shards: int, seed: int) -> tuple[DataFrame, int, int] | None:
    """Pairs by batch and shard, training tokens, and vocabulary; None if words share a hash. Texts without held_out are for training."""
    column = lambda c, other: F.col(c) if c in docs.columns else other
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), column("doc_id", F.lit(None)).cast("string").alias("doc_id"), column("held_out", F.lit(False)).alias("held_out"), "text")
    tokens = scratch.write(rows.mapInArrow(tidy(partial(tokenize, shards=shards, seed=seed)), TOKENS_ROW), "tokens")
    words = tokens.where("shard IS NOT NULL").select("batch", "shard", "names", "checks", "counts")
    name = packing(lambda b: merged(b).assign(batches=[b["batch"].tolist()])[names_of(NUMBERS_ROW)])
    numbers = scratch.write(words.repartition(shards, "shard").groupBy("shard").applyInPandas(name, NUMBERS_ROW), "numbers")
    vocabulary, n, clashes = (x or 0 for x in numbers.agg(F.sum("v"), F.sum("n"), F.sum("clashes")).first())
    scratch.forget_shuffles()
    if clashes:
        return None
    told = numbers.select("shard", F.explode(F.arrays_zip("batches", "numbers", "totals")).alias("x")).select("shard", F.col("x.batches").alias("batch"), "x.numbers", "x.totals")
    texts = tokens.where("shard IS NULL").select("batch", "tokens", "sizes", "held", "ids")
    pairs = texts.groupBy("batch").cogroup(told.groupBy("batch")).applyInPandas(packing2(partial(paired, shards=shards)), PAIRS_ROW)
    pairs = scratch.write(pairs, "pairs")
    scratch.drop("tokens", "numbers")
    scratch.forget_shuffles()
    return pairs, n, vocabulary


def fitted(docs: DataFrame, scratch: Scratch, shards: int, places: int, seed: int) -> tuple[DataFrame, DataFrame, int, int, np.ndarray, np.ndarray] | None:
    """Model and state by shard, training tokens, vocabulary, and tables and the parent's tables by sample; None if words share a hash."""
    found = numbered(docs, scratch, shards, seed)
    if not found:
        return None
    pairs, n, vocabulary = found
    by = lambda df: df.repartition(shards, "shard").groupBy("shard")
    mine = pairs.where("shard IS NOT NULL").select("shard", "names", "each", "contexts", "train")
    model = scratch.write(by(mine).applyInPandas(packing(gathered), MODEL_ROW), "model")
    joined = lambda left, right, f: by(left).cogroup(by(right)).applyInPandas(packing2(lambda a, b: f(a, b)), STATE_ROW)
    tell = lambda asks: asks.repartition(places, "place").groupBy("place").applyInPandas(packing(told), TOLD_ROW).drop("contexts")
    first = tell(model.mapInPandas(packing_rows(partial(singles, places=places)), ASK_ROW))
    state, tops, old = scratch.write(joined(model, first, partial(begun, places=places)), "state"), [], "state"
    scratch.forget_shuffles()
    for turn in range(BURN_IN + SAMPLES):
        top, top1 = (x or 0 for x in state.agg(F.sum("top"), F.sum("top1")).first())
        answers = tell(state.mapInPandas(packing_rows(partial(tables, places=places)), ASK_ROW))
        step = partial(drawn, places=places, top=top, top1=top1, vocabulary=vocabulary, turn=turn, kept=turn >= BURN_IN)
        state = scratch.write(joined(state, answers, step), f"state{turn}")
        scratch.drop(old)
        scratch.forget_shuffles()
        old = f"state{turn}"
        if turn >= BURN_IN:
            tops.append([x or 0 for x in state.agg(F.sum("top"), F.sum("top1")).first()])
    top, top1 = np.array(tops, dtype=np.float64).T
    return unpacked(model), unpacked(state), n, vocabulary, top, top1


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score from docs (doc_id string, held_out, text)."""
    scratch = Scratch(docs.sparkSession, "lm")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(1 << 16, max(1, math.ceil(size / SHARD)))
    places = 16 * math.isqrt(shards)
    for seed in itertools.count():
        if found := fitted(docs, scratch, shards, places, seed):
            break
        scratch.drop()
    _, _, n, vocabulary, top, top1 = found
    model, state, pairs = scratch.table("model"), scratch.table(f"state{BURN_IN + SAMPLES - 1}"), scratch.table("pairs")
    of_shards = pairs.where("shard IS NOT NULL")
    scratch.forget_shuffles()

    def rows(df: DataFrame, kind: int, **columns) -> DataFrame:
        have = {**{c: F.col(c) for c in df.columns}, "kind": F.lit(kind), **columns}
        return df.select(*(have.get(f.split()[0], F.lit(None)).cast(f.split()[1]).alias(f.split()[0]) for f in LOOK_ROW.split(", ")))

    fit = rows(model, 0).unionByName(rows(state, 1, names=F.lit(None), contexts=F.lit(None), counts=F.lit(None)))
    held = of_shards.select("shard", "contexts", "counts", "train").mapInPandas(tidy(held_contexts), "shard long, contexts binary")
    parts = fit.unionByName(rows(held, 2)).select("shard", "kind", "names", "each", "contexts", "counts", "samples")
    asks = parts.repartition(shards, "shard").groupBy("shard").applyInPandas(packing(lambda b: customers(b, places)), ASK_ROW)
    answers = scratch.write(asks.repartition(places, "place").groupBy("place").applyInPandas(packing(told), TOLD_ROW), "answers")
    scratch.forget_shuffles()
    every = fit.unionByName(rows(answers, 2)).unionByName(rows(of_shards.drop("train"), 3))
    fresh = partial(Shard, n, vocabulary, top, top1)
    sums = every.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInPandas(tidy(partial(summed, fresh=fresh)), SUMS_ROW)
    texts = pairs.where("shard IS NULL").select("batch", "ids", "sizes", "held", "known", "base")
    end = partial(ended, unit=math.log10(n + vocabulary + 1))
    out = texts.groupBy("batch").cogroup(sums.groupBy("batch")).applyInPandas(lambda a, b: end(unpack(a), unpack(b)), OUT_ROW)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
