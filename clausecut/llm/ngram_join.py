r"""N-gram Jaccard join with token-combination prefixes.

Two documents link when the Jaccard similarity of their sets of k-word shingles is at least num / den. Equal sets are one
class, with one node in all that follows.

Peeling. Tokens (hashes of shingles) have one order, that of the hashes. Of a set of n tokens a partner misses at most
slack = n - ceil(num n / den). Of the shared tokens in order, the j-th is among the first j + misses of each set; so what
two sets' prefixes must share follows from their sizes, and a class needs the least of that over all sizes a partner can
have. Three rounds, over prefixes of about 1.5 and 3 times the slack (15 % and 30 % of the tokens) and at last the whole
sets, drop classes that share less; only the rest is read again. Whether a token occurs in another class is asked block by block: a block of
documents sends each token once, in packed form, and gets one bit back. A false yes (tokens share 40 bits) only keeps a
class that will fail later.

Signatures. Among the classes left, a token with more than FREQUENT holders is frequent. A rare token is a signature by
itself. Frequent tokens are dealt to token classes, and pairs within one class are signatures. A set's prefix is
extended until its rare tokens plus, for each token class, its tokens but one, are more than the slack: taking away
any slack tokens leaves a whole signature, so similar sets share one. The number of token classes depends on the
set's size (by powers of two), so that signatures are about as many as tokens; a set near a limit uses both numbers.

Verification. First every signature takes one pivot, the member whose tokens are the most common, and members are
compared with it. Then, SEEKS times, each member outside a signature's largest component looks for partners in other
components. At last all pairs of a signature that are still in different components are compared, if sizes and bitmaps leave
them possible: blocks of a signature's rows meet, and a task holds a block, not a signature. So every link between components is found, and a group of thousands of near copies costs a few comparisons each, not all pairs. Before sets are
compared, parity bitmaps rule out pairs: each token flips one of 512 bits, and two sets that differ in d tokens differ in
at most d bits. Then the sets themselves are intersected. Signatures whose members are all in one component are left
aside from then on.

Scale: prefixes, not sets, move in the first round; what moves later is what is still in question. Counts use partial
sums. Broadcasts happen only if counted rows prove them small. Links, components and sets never go to the driver.

Documents without words have no set and link with nothing. Null counts as empty. Documents with fewer than k words have
one shingle, all their words. Rows that share a doc_id, or have none, are classes by their texts; component ids are the least
doc_id, null where no row of a component has one. A very long text is one set, which a worker holds with its batch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausecut.llm.common import Scratch, broadcast_if_small, by_key, free, tidy
from clausecut.llm.components import components

FREQUENT = 16
SEEKS, PARTNERS = 2, 3
#: Documents in a block.
TEXTS = 2048
BITMAP = 8  # longs
#: Lengths of the parts looked at in peeling, in terms of the slack; 0 stands for the whole set.
PEELS = (1.5, 3, 0)
#: Rows of a signature in a block, when its members look for partners.
SEEK = 4096
#: Tokens of a set that a token class should hold.
IN_CLASS = 4

U = np.uint64
ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93))


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def token_sets(texts, k: int, seed: int = 0) -> list[np.ndarray]:
    """Each text's set of shingles as sorted 64-bit hashes."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
        ids.append(np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)))
    own = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in number), dtype=U, count=len(number))
    out = []
    for i in ids:
        w = own[i]
        size = min(k, len(w))
        if not size:
            out.append(np.zeros(0, dtype=np.int64))
            continue
        x = np.full(len(w) - size + 1, U(size))
        for j in range(size):
            x = _turn(x, 21) ^ (w[j : len(w) - size + 1 + j] * ODD[j % len(ODD)])
            x = x * ODD[(j + 1) % len(ODD)]
        out.append(np.unique(_mix(x).view(np.int64)))
    return out


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for a in range(0, len(b), TEXTS):
            yield b.iloc[a : a + TEXTS]


def slack(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - (num * n + den - 1) // den


def part_of(n: np.ndarray, num: int, den: int, factor: float) -> np.ndarray:
    s = slack(n, num, den)
    return np.minimum(n, s + 1 + ((factor - 1) * s).astype(np.int64)) if factor else n


@lru_cache(1 << 16)
def hits(n: int, num: int, den: int, factor: float) -> int:
    """How many tokens of its part a set of n tokens shares at least with the part of any set it links with."""
    other = np.arange(-(-num * n // den), den * n // num + 1)
    both = (num * (n + other) + num + den - 1) // (num + den)
    own = part_of(np.array([n]), num, den, factor) - n
    return int((both + np.minimum(own, part_of(other, num, den, factor) - other)).min())


BLOCK = "block long, nodes binary, sizes binary, lens binary, tokens binary"


def _block(rid: int, nodes: np.ndarray, sets: list[np.ndarray], factor: float, num: int, den: int) -> dict:
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    lens = part_of(sizes, num, den, factor)
    tokens = np.concatenate([s[:m] for s, m in zip(sets, lens.tolist(), strict=True)]) if sets else np.zeros(0, np.int64)
    return {"block": rid, "nodes": nodes.tobytes(), "sizes": sizes.tobytes(), "lens": lens.tobytes(), "tokens": tokens.tobytes()}


def _node(s: np.ndarray, seed: int) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(s.tobytes(), seed)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _read(b) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(x, dtype=np.int64) for x in (b.nodes, b.sizes, b.lens, b.tokens))


def _keys(tokens: np.ndarray, parts: int) -> np.ndarray:
    """A token's part and 40 more of its bits in one number, sorted by part."""
    u = _mix(tokens.view(U) + ODD[0])
    return (((u >> U(40)) % U(parts)) << U(40) | (u & U((1 << 40) - 1))).view(np.int64)


def _ask(batches: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for b in batch.itertuples(index=False):
            nodes, _, lens, tokens = _read(b)
            key, owner = _keys(tokens, parts), np.repeat(nodes, lens)
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            low, high = np.minimum.reduceat(owner, starts), np.maximum.reduceat(owner, starts)
            key = key[starts]
            cuts = np.flatnonzero(np.diff(key >> 40)) + 1
            rows = []
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                t = key[a:z] & ((1 << 40) - 1)
                rows.append((b.block, int(key[a] >> 40), (t & 0xFFFFFFFF).astype("<u4").tobytes() + (t >> 32).astype("u1").tobytes(), low[a:z].tobytes(), np.packbits(low[a:z] != high[a:z]).tobytes()))
            yield pd.DataFrame(rows, columns=["block", "part", "tokens", "owners", "many"])


def _answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by part, for each block's tokens of a part whether another class has them."""
    for b in (rows for lot in by_key(batches, "part") for _, rows in lot.groupby("part")):
        owners = [np.frombuffer(x, dtype=np.int64) for x in b["owners"]]
        sizes = [len(x) for x in owners]
        tokens = np.concatenate([np.frombuffer(x, "<u4", n).astype(np.int64) | np.frombuffer(x, "u1", n, 4 * n).astype(np.int64) << 32 for x, n in zip(b["tokens"], sizes, strict=True)])
        many = np.concatenate([np.unpackbits(np.frombuffer(x, "u1"), count=n) for x, n in zip(b["many"], sizes, strict=True)]).astype(bool)
        owner = np.concatenate(owners)
        order = np.argsort(tokens, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(tokens[order]) != 0]))
        o = owner[order]
        yes = (np.minimum.reduceat(o, starts) != np.maximum.reduceat(o, starts)) | np.logical_or.reduceat(many[order], starts)
        shared = np.empty(len(tokens), dtype=bool)
        shared[order] = np.repeat(yes, np.diff(np.concatenate([starts, [len(tokens)]])))
        ends = np.cumsum(sizes).tolist()
        yield pd.DataFrame({"block": b["block"].to_numpy(), "part": b["part"].to_numpy(), "bits": [np.packbits(shared[a:z]).tobytes() for a, z in zip([0, *ends[:-1]], ends, strict=True)]})


def _left(batches: Iterator[pd.DataFrame], parts: int, num: int, den: int, factor: float) -> Iterator[pd.DataFrame]:
    """Classes of which enough tokens occur elsewhere."""
    for batch in batches:
        for b in batch.itertuples(index=False):
            nodes, sizes, lens, tokens = _read(b)
            key, back = np.unique(_keys(tokens, parts), return_inverse=True)
            shared = np.zeros(len(key), dtype=np.int64)
            part = key >> 40
            for r in b.replies:
                a, z = np.searchsorted(part, [r["part"], r["part"] + 1])
                shared[a:z] = np.unpackbits(np.frombuffer(r["bits"], "u1"), count=z - a)
            of = np.repeat(np.arange(len(nodes)), lens)
            least = np.fromiter((hits(n, num, den, factor) for n in sizes.tolist()), dtype=np.int64, count=len(sizes))
            good = np.bincount(of, weights=shared[back], minlength=len(nodes)) >= least
            out = pd.DataFrame({"node": nodes[good], "n": sizes[good]})
            if not factor:
                ends = np.cumsum(lens)
                # of objects also where no class is left, for Arrow
                out["tokens"] = pd.Series([tokens[e - m : e] for e, m in zip(ends[good].tolist(), lens[good].tolist(), strict=True)], index=out.index, dtype="object")
            yield out.drop_duplicates("node")


def peeled(blocks: DataFrame, docs: int, num: int, den: int, factor: float) -> DataFrame:
    """(node, n), and for whole sets the tokens, of the classes that a round of peeling leaves."""
    parts = 1 << max(6, (max(1, docs) // 1024).bit_length())
    asked = blocks.mapInPandas(partial(_ask, parts=parts), "block long, part long, tokens binary, owners binary, many binary")
    replies = asked.repartition("part").sortWithinPartitions("part").mapInPandas(tidy(_answer), "block long, part long, bits binary")
    replies = replies.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("replies"))
    return blocks.join(replies, "block").mapInPandas(partial(_left, parts=parts, num=num, den=den, factor=factor), "node long, n long" + ", tokens array<long>" * (not factor)).dropDuplicates(["node"])


def _signatures(batches: Iterator[pd.DataFrame], num: int, den: int) -> Iterator[pd.DataFrame]:
    """Signatures of (node, n, items: tokens in order with their holders); those that need more tokens have ok = false."""
    for batch in batches:
        out_sig, out_node, out_n, out_ok, out_pop = [], [], [], [], []
        for node, n, items in zip(batch["node"].tolist(), batch["n"].tolist(), batch["items"], strict=True):
            if n == 1:  # only an equal set could link with it, and that is the same class
                continue
            tokens = np.array([x["token"] for x in items], dtype=np.int64)
            often = np.array([x["holders"] > FREQUENT for x in items], dtype=bool)
            order = np.argsort(tokens)
            tokens, often = tokens[order], often[order]
            need, sigs, ok = n - (num * n + den - 1) // den + 1, set(), True
            for scheme in {(-(-num * n // den)).bit_length(), int(n).bit_length()}:
                classes = max(1, ((1 << scheme) * (den - num) // den) // IN_CLASS)
                held: dict[int, list[int]] = defaultdict(list)
                covered = 0
                for t, f in zip(tokens.tolist(), often.tolist(), strict=True):
                    if f:
                        own = held[(t >> 7) % classes]
                        covered += bool(own)
                        sigs.update((scheme, o, t) for o in own)
                        own.append(t)
                    else:
                        covered += 1
                        sigs.add((0, 0, t))
                    if covered >= need:
                        break
                ok &= covered >= need
            if ok:
                s = np.array(list(sigs), dtype=np.int64).reshape(-1, 3).view(U)
                s = _mix(s[:, 0] * ODD[1] + _mix(s[:, 1] + ODD[2]) * ODD[3] + _mix(s[:, 2])).view(np.int64)
                out_sig.append(np.unique(s))
                out_node.append(np.full(len(out_sig[-1]), node))
                out_n.append(np.full(len(out_sig[-1]), n))
            else:
                out_sig.append(np.zeros(1, np.int64))
                out_node.append(np.full(1, node))
                out_n.append(np.full(1, n))
            out_ok.append(np.full(len(out_sig[-1]), ok))
            out_pop.append(np.full(len(out_sig[-1]), int(1000 * np.mean([np.log2(x["holders"]) for x in items]))))
        if out_sig:
            yield pd.DataFrame({"sig": np.concatenate(out_sig), "node": np.concatenate(out_node), "n": np.concatenate(out_n), "ok": np.concatenate(out_ok), "common": np.concatenate(out_pop)})


def _bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for t in b["tokens"]:
            bits = (np.bincount((np.asarray(t, dtype=np.int64) >> 11) & (64 * BITMAP - 1), minlength=64 * BITMAP) & 1).astype("u1")
            rows.append(np.packbits(bits).view("<i8").tolist())
        yield pd.DataFrame({"node": b["node"], "n": b["n"], "bits": rows})


def _partners(batches: Iterator[pd.DataFrame], num: int, den: int, turn: int, every: bool) -> Iterator[pd.DataFrame]:
    """From rows sorted by block of a signature (sig, block): for each row that seeks, one row of another component that size and bitmap leave possible, or every such row.

    Which one, depends on turn. Where every one is asked for, a row that offers its place to a seeker of its own block is left to one of the two.
    """
    for b in by_key(batches, "sig", "block"):
        sig, block, node, n, comp, seeks, offers = (b[c].to_numpy() for c in ("sig", "block", "node", "n", "comp", "seeks", "offers"))
        bits = np.frombuffer(b"".join(b["bits"]), dtype=U).reshape(-1, BITMAP)
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(sig) != 0) | (np.diff(block) != 0)])).tolist()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for a, z in zip(starts, [*starts[1:], len(b)], strict=True):
            ys = a + np.flatnonzero(offers[a:z])
            for x in (a + np.flatnonzero(seeks[a:z])).tolist():
                far = ys[(comp[ys] != comp[x]) & (den * np.minimum(n[ys], n[x]) >= num * np.maximum(n[ys], n[x]))]
                if every:
                    far = far[node[far] < node[x]]
                if len(far):
                    differ = np.bitwise_count(bits[far] ^ bits[x]).sum(axis=1, dtype=np.int64)
                    far = far[(den + num) * differ <= (den - num) * (n[far] + n[x])]
                    if len(far):
                        far = far if every else far[[(x - a + 7919 * turn) % len(far)]]
                        out.append((np.full(len(far), node[x]), node[far]))
        if out:
            yield pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])}).drop_duplicates()


def _compare(batches: Iterator[pd.DataFrame], num: int, den: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        good = np.zeros(len(b), dtype=bool)
        for i, (x, y) in enumerate(zip(b["x"], b["y"], strict=True)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            good[i] = den * both >= num * (len(x) + len(y) - both)
        yield b.loc[good, ["a", "b"]]


class Links:
    """Finds links among the classes left by peeling: sets (node, n, tokens)."""

    def __init__(self, sets: DataFrame, num: int, den: int, scratch: Scratch):
        self.sets, self.num, self.den, self.scratch, self.spark = sets, num, den, scratch, sets.sparkSession
        self.bits = scratch.write(sets.mapInPandas(_bitmaps, "node long, n long, bits array<long>"), "bits", compact=True)
        self.rows = self._signed()
        self.comp = self.bits.select("node", F.col("node").alias("comp"))

    def _signed(self) -> DataFrame:
        times = 2
        while True:
            need = (F.col("n") - F.ceil(F.col("n") * self.num / self.den)) * times + 12
            items = self.sets.select("node", "n", F.explode(F.slice("tokens", F.lit(1), F.least(need, F.col("n")).cast("int"))).alias("token"))
            holders = items.groupBy("token").agg(F.count("*").alias("holders"))
            each = items.join(holders, "token").groupBy("node", "n").agg(F.collect_list(F.struct("token", "holders")).alias("items"))
            out = self.scratch.write(each.mapInPandas(partial(_signatures, num=self.num, den=self.den), "sig long, node long, n long, ok boolean, common long"), f"signatures{times}", compact=True)
            if not out.where("NOT ok").take(1):
                return out.drop("ok")
            self.scratch.drop(f"signatures{times}")
            times *= 4

    def _close(self, a: str, b: str) -> str:
        """Whether two sets' sizes and bitmaps leave a chance; a and b have n and bits."""
        differ = " + ".join(f"bit_count({a}.bits[{i}] ^ {b}.bits[{i}])" for i in range(BITMAP))
        return f"{self.den} * least({a}.n, {b}.n) >= {self.num} * greatest({a}.n, {b}.n) AND ({self.den} + {self.num}) * ({differ}) <= ({self.den} - {self.num}) * ({a}.n + {b}.n)"

    def _verified(self, pairs: DataFrame, label: str) -> DataFrame:
        """Of written pairs (a, b), those that link. Each pair brings a's tokens to b."""
        n = pairs.count()
        ends = self.scratch.write(pairs.select("b").distinct(), f"{label}-ends", compact=True)
        left = self.sets.join(broadcast_if_small(pairs, n, 64), F.col("node") == F.col("a")).select("a", "b", F.col("tokens").alias("x"))
        right = self.sets.join(broadcast_if_small(ends, ends.count(), 32), F.col("node") == F.col("b")).select("b", F.col("tokens").alias("y"))
        return left.join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInPandas(partial(_compare, num=self.num, den=self.den), "a long, b long")

    def _join(self, found: DataFrame, label: str) -> None:
        """Joins components along links."""
        found = self.scratch.write(found, f"{label}-links", compact=True)
        if found.take(1):
            of = lambda c: self.comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
            edges = found.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            by = components(edges, self.scratch, f"{label}-comp").select(F.col("node").alias("comp"), F.col("comp").alias("new"))
            self.comp = self.scratch.write(self.comp.join(by, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), f"{label}-of", compact=True)

    def _open(self, label: str) -> bool:
        """Keeps the signatures that have members in more than one component; whether any are left."""
        rows = self.rows.drop("comp").join(self.comp, "node")
        mixed = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
        self.rows = self.scratch.write(rows.join(mixed, "sig"), label, compact=True)
        return bool(self.rows.take(1))

    def _round(self, pairs: DataFrame, label: str) -> None:
        """Compares a few pairs for each a."""
        few = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64(F.lit(label), "b").alias("h"), "b"))), 1, PARTNERS)
        pairs = pairs.groupBy("a").agg(few.alias("p")).select("a", F.explode("p.b").alias("b"))
        self._join(self._verified(self.scratch.write(pairs, f"{label}-pairs", compact=True), label), label)

    def _seeking(self, rows: DataFrame, turn: int, every: bool = False) -> DataFrame:
        """Pairs (a, b): partners in other components, one for each row outside its signature's largest component, or all. A long signature is cut in blocks that seekers visit each, so a task holds a block and its visitors, and never a signature."""
        sizes = rows.groupBy("sig", "comp").agg(F.count("*").alias("k")).groupBy("sig").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), F.ceil(F.sum("k") / SEEK).cast("int").alias("blocks"))
        rows = rows.join(sizes, "sig").withColumn("seeks", F.lit(True) if every else F.col("comp") != F.col("major"))
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        at = F.when(F.col("seeks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
        rows = rows.withColumn("own", own).withColumn("block", F.explode(at)).select("sig", "block", "node", "n", "comp", "seeks", (F.col("own") == F.col("block")).alias("offers"))
        raw = self.bits.select("node", F.expr(" || ".join(f"unhex(lpad(hex(bits[{i}]), 16, '0'))" for i in range(BITMAP))).alias("bits"))
        # node as the last key of order makes a rerun of a task give the same pairs
        rows = rows.join(raw, "node").repartition("sig", "block").sortWithinPartitions("sig", "block", "node")
        return rows.mapInPandas(partial(_partners, num=self.num, den=self.den, turn=turn, every=every), "a long, b long")

    def _pivots(self) -> DataFrame:
        """Pairs (a, b): members and their signatures' pivots."""
        first = F.struct((-F.col("common")).alias("h"), F.col("node").alias("pivot"))
        pivots = self.rows.groupBy("sig").agg(F.min(first)["pivot"].alias("pivot"))
        pairs = self.rows.join(pivots, "sig").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
        return pairs.join(self.bits.alias("p"), F.col("a") == F.col("p.node")).join(self.bits.alias("q"), F.col("b") == F.col("q.node")).where(self._close("p", "q")).select("a", "b")

    def run(self) -> DataFrame:
        """(node, comp)."""
        for turn in range(1 + SEEKS):
            if not self._open(f"open{turn}"):
                return self.comp
            self._round(self._seeking(self.rows, turn) if turn else self._pivots(), f"round{turn}")
        if self._open("open"):
            pairs = self._seeking(self.rows, 0, every=True).distinct()
            self._join(self._verified(self.scratch.write(pairs, "pairs", compact=True), "last"), "last")
        return self.comp


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, class_id (of equal sets; null without words). num / den must be over 1/2."""
    if 2 * num <= den:
        raise ValueError("the similarity must be over 1/2")
    scratch = Scratch(docs.sparkSession, "ngrams")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    for seed in range(100):

        def first(batches: Iterator[pd.DataFrame], seed=seed) -> Iterator[pd.DataFrame]:
            for b in _slices(batches):
                sets = token_sets(b["text"], k, seed)
                both = [_node(s, seed) if len(s) else (None, None) for s in sets]
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "node": pd.array([x[0] for x in both], dtype="Int64"), "node2": pd.array([x[1] for x in both], dtype="Int64"), "n": [len(s) for s in sets], "block": None, "nodes": None, "sizes": None, "lens": None, "tokens": None})
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    one = _block(int(b["rid"].iloc[0]), np.array([both[i][0] for i in full], dtype=np.int64), [sets[i] for i in full], PEELS[0], num, den)
                    yield pd.DataFrame([{"doc_id": None, "node": None, "node2": None, "n": None} | one])

        seen = scratch.write(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(tidy(first), f"doc_id string, node long, node2 long, n long, {BLOCK}"), f"seen{seed}")
        rows = seen.where("block IS NULL").select(F.col("doc_id").cast(kind).alias("doc_id"), "node", "node2", "n")
        classes = scratch.write(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("node2").alias("lo"), F.max("node2").alias("hi")), f"classes{seed}", compact=True)
        if not classes.where("lo <> hi").take(1):
            break
        scratch.drop(f"seen{seed}", f"classes{seed}")
    count = classes.count()
    blocks = seen.where("block IS NOT NULL").select("block", "nodes", "sizes", "lens", "tokens")
    for i, factor in enumerate(PEELS):
        if i:

            def again(batches: Iterator[pd.DataFrame], seed=seed, factor=factor) -> Iterator[pd.DataFrame]:
                for b in _slices(batches):
                    sets = token_sets(b["text"], k, seed)
                    own = [(_node(s, seed)[0], s) for s in sets if len(s)]
                    if own:
                        yield pd.DataFrame([_block(int(b["rid"].iloc[0]), np.array([x for x, _ in own], dtype=np.int64), [s for _, s in own], factor, num, den)])

            reps = classes.join(alive, "node").select(F.col("rep").alias("_id")).distinct()
            texts = docs.join(broadcast_if_small(reps, n_alive, 32), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
            blocks = scratch.write(texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInPandas(tidy(again), BLOCK), f"blocks{i}")
        alive = scratch.write(peeled(blocks, count, num, den, factor), f"alive{i}", compact=bool(factor))
        n_alive = alive.count()
        if i:
            scratch.drop(f"blocks{i}", f"alive{i - 1}")
    if n_alive:
        comp = Links(alive, num, den, scratch).run()
        ids = classes.join(comp, "node").groupBy("comp").agg(F.min("rep").alias("component"))
        named = classes.select("node", "rep").join(comp.join(ids, "comp").select("node", "component"), "node", "left").select("node", F.coalesce("component", "rep").alias("component_id"))
    else:
        named = classes.select("node", F.col("rep").alias("component_id"))
    named = named.withColumnRenamed("node", "_node")
    return rows.join(named, F.col("node") == F.col("_node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("node").alias("class_id"))


def one_of_each(docs: DataFrame, **columns) -> DataFrame:
    """docs less the documents that link with one of a smaller doc_id: of each component the least doc_id stays."""
    found = linked(docs, **columns)
    id_col = columns.get("id_col", "doc_id")
    (own,) = free(docs.columns, "_id")
    kept = found.where("doc_id <=> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(own)), "left_semi")
