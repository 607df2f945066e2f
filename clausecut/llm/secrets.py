"""Secret scans through a trigram inverted index.

A rule's regular expression is turned into a Boolean query of trigrams that any match must hold (a disjunction of
conjunctions, over lower-cased text). The index holds postings (trigram, block of documents, ids) for the trigrams the
rules ask for. Postings are intersected block by block; what comes out are the candidates (doc_id, rules), and only
their texts see the rule's regular expression. A rule without mandatory trigrams scans every text.

Scale: a block has about BLOCK documents, so no postings list or intersection is unbounded. Candidates reach the texts by
a broadcast only if their count proves it small, else by a join on doc_id. Candidates never decide a match by
themselves, so rows that share a doc_id are all verified.

Null counts as an empty text. Ids may be of any type that Spark compares. Rows without an id are in no postings and see every rule. Repeated rows give repeated rows. Texts are whole; spans have no limit.
"""

from __future__ import annotations

import functools
import re._constants as K
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausecut.llm.common import Scratch, broadcast_if_small, free, text_or_empty
from clausecut.llm.spans import SPAN, spans

BLOCK = 4096
#: Most strings that a part of a pattern is spelled out to.
SPELLED = 64

Query = frozenset  # of conjunctions, each a frozenset of trigrams; a query with the empty conjunction holds for any text
ANY: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters of the match, or of the group
    group: int = 0
    base: bool = False


#: The first three are the base. Their order is the order of kinds at one start.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}+", 24, 0, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++"),
)


def _both(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x, y in product(a, b)))


def _least(q: Query) -> Query:
    """Without conjunctions that another one implies."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _of_strings(strings: frozenset[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def trigram_query(pattern: str) -> Query:
    """Trigrams of lower-cased text that any match of the pattern must hold."""

    def walk(items) -> tuple[frozenset[str] | None, Query]:
        """The strings a sequence can be, if they are few, and else a query."""
        query, strings = ANY, frozenset([""])
        for op, arg in items:
            own, need = node(op, arg)
            if own is not None and len(strings) * len(own) <= SPELLED:
                strings = frozenset(a + b for a, b in product(strings, own))
            else:
                query = _both(query, _of_strings(strings))
                strings = frozenset([""])
                if own is not None:
                    strings = own
                else:
                    query = _both(query, need)
                    parts.append(1)
        whole = query == ANY and not parts
        parts.clear()
        return (strings, ANY) if whole else (None, _both(query, _of_strings(strings)))

    parts: list[int] = []

    def node(op, arg) -> tuple[frozenset[str] | None, Query]:
        if op is K.LITERAL:
            return frozenset([chr(arg).lower()]), ANY
        if op is K.IN and all(o is K.LITERAL for o, _ in arg) and len(arg) <= 5:
            return frozenset(chr(a).lower() for _, a in arg), ANY
        if op is K.SUBPATTERN:
            return nested(arg[-1])
        if op is K.BRANCH:
            every = [nested(x) for x in arg[1]]
            if all(s is not None for s, _ in every):
                return functools.reduce(frozenset.union, (s for s, _ in every)), ANY
            return None, _least(functools.reduce(frozenset.union, (q if s is None else _of_strings(s) for s, q in every)))
        if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, body = arg
            own, need = nested(body)
            if (low, high) == (0, 1) and own is not None:
                return own | {""}, ANY
            if low == 0:
                return None, ANY
            return None, need if own is None else _of_strings(own)
        if op is K.AT:
            return frozenset([""]), ANY
        return None, ANY

    def nested(items):
        saved = parts[:]
        parts.clear()
        out = walk(items)
        parts[:] = saved
        return out

    strings, query = walk(parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


class TrigramIndex:
    """Postings of the trigrams that some queries ask for."""

    def __init__(self, docs: DataFrame, queries: dict[str, Query], id_col: str = "doc_id", text_col: str = "text", rows: int | None = None):
        self.queries = {k: q for k, q in queries.items() if q != ANY}
        self.full = [k for k, q in queries.items() if q == ANY]
        self.trigrams = sorted({t for q in self.queries.values() for c in q for t in c})
        self.scratch, self.kind = Scratch(docs.sparkSession, "trigrams"), f"array<{docs.schema[id_col].dataType.simpleString()}>"
        self.blocks = max(1, (docs.count() if rows is None else rows) // BLOCK)
        low = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_or_empty(text_col)).alias("low"))
        held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(self.trigrams)]))
        pairs = low.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(self.blocks)).alias("block"), F.explode(held).alias("trigram"))
        self.postings = self.scratch.write(pairs.groupBy("block", "trigram").agg(F.collect_set("doc_id").alias("ids")), "postings")

    def candidates(self) -> DataFrame:
        """doc_id and mask: bit i is set if the document holds what the i-th rule's query asks for."""
        lists = self.postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
        place = {t: i for i, t in enumerate(self.trigrams)}

        def ids(query: Query) -> Column:
            of = lambda t: F.coalesce(F.try_element_at(F.col("lists"), F.lit(place[t])), F.array().cast(self.kind))
            return F.array_distinct(F.flatten(F.array(*[functools.reduce(F.array_intersect, [of(t) for t in sorted(c)]) for c in sorted(query, key=sorted)])))

        def bit(i: int):
            return lambda x: F.struct(x.alias("doc_id"), F.lit(1 << i).cast("long").alias("bit"))

        found = [F.transform(ids(q), bit(i)) for i, q in enumerate(self.queries.values())]
        each = lists.select(F.explode(F.flatten(F.array(*found))).alias("c")).select("c.doc_id", "c.bit")
        return each.groupBy("doc_id").agg(F.bit_or("bit").alias("mask"))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and secrets: array of (start, rank, end, kind, match), by start, then the rule's place. A column secrets of docs gives way to it."""
    docs = docs.drop("secrets")
    id_, mask = free(docs.columns, "_id", "mask")
    index = TrigramIndex(docs, {r.kind: trigram_query(r.pattern) for r in rules}, id_col, text_col)
    out = docs
    if index.queries:
        found = index.scratch.write(index.candidates().withColumnsRenamed({"doc_id": id_, "mask": mask}), "candidates")
        found = broadcast_if_small(found, found.count(), 64, 4 << 20)
        out = docs.join(found, F.col(id_col) == F.col(id_), "left").drop(id_)
    else:
        out = out.withColumn(mask, F.lit(0).cast("long"))
    text, bits = text_or_empty(text_col), {k: 1 << i for i, k in enumerate(index.queries)}

    def of(rule: Rule, rank: int) -> Column:
        long = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m) >= rule.least
        one = spans(text, rule.pattern, long)
        if rule.kind in bits:
            held = F.coalesce(mask, F.lit(0).cast("long")).bitwiseAND(bits[rule.kind]) != 0
            one = F.when(F.col(id_col).isNull() | held, one).otherwise(F.array().cast(SPAN))
        return F.transform(one, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(rule.kind).alias("kind"), s["match"].alias("match")))

    return out.withColumn("secrets", F.array_sort(F.flatten(F.array(*[of(r, i) for i, r in enumerate(rules)])))).drop(mask)


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the base rules, and all spans in one string."""
    found = find(docs.select("doc_id", "text")).select("doc_id", "secrets")
    base = [r.kind for r in RULES if r.base]
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    own = F.array_join(F.transform(F.filter("secrets", lambda s: s["kind"].isin(*base)), line), ",")
    return found.select("doc_id", *map(count, base), F.sha2(own.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("secrets", line), ",").alias("spans"))
