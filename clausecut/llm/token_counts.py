"""Exact token counts of every prefix of every text, by dynamic programming, and answers from them without encoding again.

Byte-pair encoding has a property that makes prefixes cheap: a sequence of tokens is what the merges give for its text if
and only if each token is what they give for its own text and each two neighbours stay apart. So the encoding of a prefix is
that of a shorter prefix and one more token: at each place, exactly one token of the vocabulary that ends there stands beside
the last token of the prefix before it. `Run` keeps the last token and the count of each prefix of a word; whether two tokens
stay apart follows from the order of merges alone. The words' end mark makes a second kind of token, which only ends a
prefix. Time is linear in a text's length (times the longest token).

Normalization and the split in words go along, character by character, so that a prefix that ends inside a composed letter, a
contraction or a special token counts as the library counts that prefix. Parts between ASCII white space do not touch each
other here; each distinct part is worked out once for a batch, and a worker remembers a bounded number.

`prefix_table` has for each text the steps of its count from prefix to prefix, a byte for each code point. Truncation and
budgets (`within`, `at`, `windows`) read those steps only.

Scale: one map in Arrow batches and no shuffle; a worker holds TEXTS texts at once, or one very long text. Memory is some
twenty bytes for each code point of these. Null counts as empty: no tokens, no steps. Repeated rows and rows without an id
are counted each; other columns are not read. Special strings inside a text are one token each, as the library has it.
"""

from __future__ import annotations

import functools
import itertools
import json
import operator
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from clausecut.llm.common import Scratch, tidy

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Texts worked on at once, and most words a worker remembers; both bound its memory.
TEXTS = 1024
REMEMBERED = 500_000
#: Marks that are words by themselves, whatever comes before or after; the apostrophe is not one, and less-than may begin a special string.
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: Contractions that are words of their own, by what comes after the apostrophe.
SHORT, LONG = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}


class Merges:
    """A vocabulary of byte pairs with an end mark: which tokens a text may end with, and which two stay apart."""

    def __init__(self, model: dict):
        mark = model["end_of_word_suffix"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        number = {x: i for i, x in enumerate(model["vocab"])}
        self.rank, self.left, self.right = [-1] * len(number), [-1] * len(number), [-1] * len(number)
        self.pair: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(pairs):
            i = number[a + b]
            self.rank[i], self.left[i], self.right[i] = r, number[a], number[b]
            self.pair[number[a], number[b]] = r
        self.inner = {x: i for x, i in number.items() if not x.endswith(mark)}
        self.final = {x.removesuffix(mark): i for x, i in number.items() if x.endswith(mark)}
        for table in (self.inner, self.final):  # tokens that their own text does not give can't occur
            for x, i in list(table.items()):
                if not self.whole(i):
                    del table[x]
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.apart = functools.lru_cache(1 << 18)(self.stay_apart)
        self.before: tuple[str, list[int], list[int], list[int]] = ("", [-1], [0], [0])
        heads = {x[:k] for x in (*self.inner, *self.final) for k in range(1, len(x) + 1)}
        self.ids = {x: (self.inner.get(x, -1), self.final.get(x, -1)) for x in heads}

    def whole(self, token: int) -> bool:
        """Whether the merges give this one token for its text: its halves are whole, and nothing joins over their seam before they do."""
        if self.rank[token] < 0:
            return True
        a, b = self.left[token], self.right[token]
        return self.whole(a) and self.whole(b) and self.stay_apart(a, b, self.rank[token])

    def stay_apart(self, a: int, b: int, before: int = 1 << 30) -> bool:
        """Whether no merge joins over the seam of a and b before that of rank `before`.

        The merges that made a and b are taken back, the latest first. Whatever then meets at the seam was there at that
        time: a merge of the two of a lower rank would have come first. Of equal ranks the left one comes first.
        """
        while True:
            joins = self.pair.get((a, b))
            if joins is not None and joins < before:
                return False
            if self.rank[a] > self.rank[b]:
                before, a = min(before, self.rank[a]), self.right[a]
            elif self.rank[b] >= 0:
                before, b = min(before, self.rank[b] + 1), self.left[b]
            else:
                return True


    def ends(self, word: str) -> list[int]:
        """The count of each prefix of a word, if the word ended there, byte by byte; the empty prefix first. What Run does, for a word that is there as a whole.

        What holds of the beginning that it shares with the word before is kept: words in sorted order share much.
        """
        before, last, count, out = self.before
        shared, size = 0, len(word)
        for x, y in zip(before, word):  # noqa: B905
            if x != y:
                break
            shared += 1
        more = size - shared
        last, count, out = [*last[: shared + 1], *[-1] * more], [*count[: shared + 1], *[0] * more], [*out[: shared + 1], *[0] * more]
        ids, apart = self.ids.get, self.apart
        for a in range(size):
            beside, n = last[a], count[a] + 1
            for z in range(max(a, shared) + 1, size + 1):
                found = ids(word[a:z])
                if found is None:  # no token begins so
                    break
                inner, final = found
                if inner >= 0 and not count[z] and (not a or apart(beside, inner)):
                    last[z], count[z] = inner, n
                if final >= 0 and not out[z] and (not a or apart(beside, final)):
                    out[z] = n
        self.before = (word, last, count, out)
        return out


class Run:
    """Prefixes of one word, byte by byte: the last token and the count of each, as they are inside a word."""

    __slots__ = ("count", "last", "merges", "tail")

    def __init__(self, merges: Merges):
        self.merges, self.tail, self.last, self.count = merges, "", [-1], [0]

    def _ends(self, tail: str, table: dict[str, int]) -> tuple[int, int]:
        """The token that ends here and the count with it."""
        n, apart, last = len(self.last), self.merges.apart, self.last
        for k in range(min(len(tail), n), 0, -1):
            token = table.get(tail[-k:])
            if token is not None and (k == n or apart(last[n - k], token)):
                return token, self.count[n - k] + 1
        raise AssertionError("a vocabulary without some byte")

    def push(self, byte: str) -> None:
        tail = (self.tail + byte)[-self.merges.longest :]
        token, count = self._ends(tail, self.merges.inner)
        self.tail = tail
        self.last.append(token)
        self.count.append(count)

    def add(self, symbols: str) -> int:
        """Takes a character's bytes; the count if the word ends here."""
        for byte in symbols[:-1]:
            self.push(byte)
        out = self._ends((self.tail + symbols[-1])[-self.merges.longest :], self.merges.final)[1]
        self.push(symbols[-1])
        return out

    def cut(self, tail: str, size: int) -> None:
        self.tail = tail
        del self.last[size:], self.count[size:]


class Counter:
    """Counts of a part's prefixes under one tokenizer file."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        with open(name, encoding="utf-8") as f:
            told = json.load(f)
        self.library, self.merges = Tokenizer.from_file(name), Merges(told["model"])
        self.special = sorted((x["content"] for x in told["added_tokens"]), key=len, reverse=True)
        self.words: dict[str, bytes] = {}
        self.kinds: dict[str, tuple[str, str]] = {}

    def kind(self, c: str) -> tuple[str, str]:
        """Of a character of normalized text: space, letter, number or mark, as the library splits; and its bytes as symbols."""
        if c not in self.kinds:
            split = self.library.pre_tokenizer.pre_tokenize_str
            alone = split(c)
            if not alone:
                self.kinds[c] = (" ", "")
            else:
                what = "1" if len(split(c + c)) == 2 else "a" if len(split("a" + c)) == 1 else "."
                self.kinds[c] = (what, alone[0][0])
        return self.kinds[c]

    def normal(self, segment: str) -> str:
        return segment.lower() if segment.isascii() else self.library.normalizer.normalize_str(segment)

    def word(self, text: str) -> int:
        run, out = Run(self.merges), 0
        for c in text:
            out = run.add(self.kind(c)[1])
        return out

    def learn(self, parts: list[str]) -> None:
        """Remembers the steps of the parts' words of letters, and of the marks after them."""
        new, tails = set(), set()
        for part in parts:
            core = part.rstrip(MARKS)
            if len(core) < len(part):
                tails.add(part[len(core) :])
            key = core.lower() if core.isascii() else core
            if key not in self.words:
                new.add(key)
        for key in sorted(x for x in new if self.letters(x)):
            self.words[key] = four_bytes(self.ends(self.normal(key)))
        for tail in sorted(tails):
            if tail not in self.words:
                self.words[tail] = four_bytes(self.merges.ends(tail))

    def steps(self, part: str) -> bytes:
        """How the count changes from each prefix of a part to the next, as four bytes each. The part's word is known, unless it is not one of letters."""
        core = part.rstrip(MARKS)
        found = self.words.get(core.lower() if core.isascii() else core)
        if found is None:
            return four_bytes([0, *self.counts(part)])
        return found + self.words[part[len(core) :]] if len(core) < len(part) else found

    def letters(self, core: str) -> bool:
        """Whether a text is one word of letters that normalization leaves one by one, so that a prefix of it is one too."""
        if not core or core.isascii():
            return not core or core.isalpha()
        if not core.isalpha() or any(map(joins, core)) or not unicodedata.is_normalized("NFC", core):
            return False
        low = self.normal(core)
        return len(low) == len(core) and all(self.kind(c)[0] == "a" for c in low)

    def ends(self, word: str) -> list[int]:
        """The count of each prefix of a normalized word of letters, the empty one first."""
        if word.isascii():
            return self.merges.ends(word)
        symbols = [self.kind(c)[1] for c in word]
        by_byte = self.merges.ends("".join(symbols))
        return [0, *(by_byte[z] for z in itertools.accumulate(map(len, symbols)))]

    def counts(self, part: str) -> list[int]:
        """The count of each prefix of any part, from one character to all, character by character."""
        out: list[int] = []
        base, at = 0, 0
        while at < len(part):
            found = [(i, x) for x in self.special if (i := part.find(x, at)) >= 0]
            i, x = min(found, key=lambda f: f[0], default=(len(part), ""))
            ends = Scan(self).counts(part[at:i] + x[:-1])
            out.extend(base + n for n in ends)
            if x:
                base += (ends[i - at - 1] if i > at else 0) + 1
                out.append(base)
            at = i + len(x)
        return out


def four_bytes(counts: list[int]) -> bytes:
    """Differences of neighbours."""
    return array("i", map(operator.sub, counts[1:], counts)).tobytes()


class Scan:
    """Goes through a stretch of text without special strings and keeps the count of what it has seen."""

    def __init__(self, own: Counter):
        self.own, self.done, self.ended, self.run, self.kind, self.quote, self.before = own, 0, 0, None, " ", "", 0

    def close(self) -> None:
        self.done += self.ended
        self.ended, self.run, self.kind, self.quote = 0, None, " ", ""

    def feed(self, c: str) -> None:
        kind, symbols = self.own.kind(c)
        if self.quote and (c in SHORT if self.quote == "'" else LONG[self.quote[1]] == c):
            self.done, self.ended = self.before + self.own.word(self.quote + c), 0
            self.close()
            return
        quote = self.quote + c if self.quote == "'" and c in LONG else ""
        if kind != self.kind or kind == "1":
            self.close()
            if kind in "a.":
                self.run, self.kind = Run(self.own.merges), kind
                if c == "'":
                    quote, self.before = "'", self.done
        self.quote = quote
        if kind == "1":
            self.done += self.own.word(c)
        elif kind != " ":
            self.ended = self.run.add(symbols)

    def trial(self, text: str) -> int:
        """The count if text came next and then the end; nothing is kept."""
        state = (self.done, self.ended, self.run, self.kind, self.quote, self.before)
        run = self.run
        mark = (run.tail, len(run.last)) if run else None
        for c in text:
            self.feed(c)
        out = self.done + self.ended
        self.done, self.ended, self.run, self.kind, self.quote, self.before = state
        if run:
            run.cut(*mark)
        return out

    def counts(self, text: str) -> list[int]:
        out, at, size = [], 0, len(text)
        while at < size:
            end = at + 1
            while end < size and joins(text[end]):
                end += 1
            out.extend(self.trial(self.own.normal(text[at:p])) for p in range(at + 1, end))
            for c in self.own.normal(text[at:end]):
                self.feed(c)
            out.append(self.done + self.ended)
            at = end
        return out


def joins(c: str) -> bool:
    """Whether normalization may join a character with those before it: marks, the later letters of a Hangul syllable, and Kirat Rai vowels."""
    if c.isascii():
        return False
    return unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ" or "\U00016d63" <= c <= "\U00016d6a"


@functools.lru_cache(4)
def _counter(name: str) -> Counter:
    return Counter(name)


def _steps(texts: pa.Array, own: Counter) -> tuple[np.ndarray, np.ndarray]:
    """All texts' steps one after another, and where each text's begin and end, in code points."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(texts)
    parts = parts.flatten()
    coded = parts.filter(pc.not_equal(parts, "")).dictionary_encode()
    if len(own.words) > REMEMBERED:
        own.words.clear()
    distinct = coded.dictionary.to_pylist()
    own.learn(distinct)
    each = [own.steps(x) for x in distinct]
    size = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
    flat, start, which = np.frombuffer(b"".join(each), dtype="<i4"), np.cumsum(size) - size, coded.indices.to_numpy()
    lengths = size[which]
    stop = np.cumsum(lengths)
    seen = flat[np.repeat(start[which] - (stop - lengths), lengths) + np.arange(int(lengths.sum()))]
    where, data = np.frombuffer(texts.buffers()[1], dtype="<i4")[texts.offset : texts.offset + len(texts) + 1], texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[where[0] : where[-1]] if data is not None else np.empty(0, np.uint8)
    raw = raw[(raw & 0xC0) != 0x80]
    out = np.zeros(len(raw), dtype=np.int32)
    out[~((raw == 32) | (raw >= 9) & (raw <= 13))] = seen
    return out, np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy())])


def prefix_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """A row per text: doc_id, n_bytes, n_chars, n_tokens, width, steps.

    steps holds for each code point by how much the count of the prefix that ends with it differs from that of the prefix
    before: whole numbers of `width` bytes. One byte does unless a step is beyond 127, when all of that text's have four.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _counter(tokenizer)
        for b in (whole.slice(a, TEXTS) for whole in batches for a in range(0, whole.num_rows, TEXTS)):
            text = b.column("text").cast(pa.string())
            steps, at = _steps(text, own)
            total = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
            width = [1 if z == a or np.abs(steps[a:z]).max() < 128 else 4 for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = {
                "doc_id": b.column("doc_id"), "n_bytes": pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()), "n_chars": pa.array(np.diff(at), pa.int64()), "n_tokens": pa.array(np.diff(total[at]), pa.int64()),
                "width": pa.array(width, pa.int32()), "steps": pa.array([steps[a:z].astype(f"<i{w}").tobytes() for a, z, w in zip(at[:-1].tolist(), at[1:].tolist(), width, strict=True)], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(count), f"doc_id {kind}, n_bytes long, n_chars long, n_tokens long, width int, steps binary")


def _prefixes(steps: bytes, width: int) -> np.ndarray:
    """Counts of all prefixes, the empty one first."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, dtype=f"<i{width}"), dtype=np.int64)])


@F.pandas_udf(LongType())
def _within(steps: pd.Series, width: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([int(np.flatnonzero(_prefixes(s, w) <= b)[-1]) if b >= 0 else 0 for s, w, b in zip(steps, width, budget, strict=True)], dtype="int64")


@F.pandas_udf(LongType())
def _at(steps: pd.Series, width: pd.Series, chars: pd.Series) -> pd.Series:
    return pd.Series([int(_prefixes(s, w)[min(max(n, 0), len(s) // w)]) for s, w, n in zip(steps, width, chars, strict=True)], dtype="int64")


def within(budget: int | Column) -> Column:
    """Of a row of prefix_table: code points of the longest prefix of at most so many tokens."""
    fits = F.lit(budget) if isinstance(budget, int) else budget
    return F.when(F.col("n_tokens") <= fits, F.col("n_chars")).otherwise(_within("steps", "width", fits.cast("long")))


def at(chars: int | Column) -> Column:
    """Of a row of prefix_table: tokens of the prefix of so many code points, or of the whole text if it is shorter."""
    return _at("steps", "width", (F.lit(chars) if isinstance(chars, int) else chars).cast("long"))


def truncated(docs: DataFrame, table: DataFrame, budget: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, by a unique id, with each text cut to its longest prefix of at most so many tokens; nothing is encoded again."""
    cut = table.select(F.col("doc_id").alias("_doc"), within(budget).alias("_cut"))
    out = docs.alias("d").join(cut.alias("t"), F.col(f"d.{id_col}").eqNullSafe(F.col("t._doc")))
    return out.select(*[F.substring(F.col(f"d.{c}"), F.lit(1), F.col("t._cut").cast("int")).alias(c) if c == text_col else F.col(f"d.{c}") for c in docs.columns])


def counted(docs: DataFrame, limit: int = LIMIT, **columns) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit, and chars_within, the code points of the longest prefix within the limit. The prefix table is stored, and all but n_bytes is read from it."""
    table = Scratch(docs.sparkSession, "tokens").write(prefix_table(docs, **columns), "prefixes")
    return table.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), within(limit).alias("chars_within"))
