"""Counts of prefixes against the library, prefix by prefix, and answers from the table against encoding again."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausecut.llm import queries as Q
from clausecut.llm import token_counts as T

public_tokenizers = pytest.importorskip("public_tokenizers")
LIBRARY = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))
#: Letters and marks that normalization, lower case or the split in words treat in a way of their own.
ALPHABETS = ["abcdefghij'stmdrvelRE", "'’\"!?.,-<|>endoftext", "éÉİıßſΣς日本語한글ᄒ", "한", "éậô", "0123½²٣", "‍😀👍🏽 　\u0085\x1c\x00", "কিোা"]


def n(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def hard_parts(seed, how_many):
    rng = random.Random(seed)
    for k in range(how_many):
        text = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randrange(1, 25)))
        if k % 5 == 0:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext"]) + text[at:]
        yield "".join(text.split(" "))


def test_every_prefix():
    own = T._counter(T.TOKENIZER)
    for text in [*hard_parts(3, 1200), "internationalization" * 5, "a" * 200, "thethethe" * 20, "....!!!!'''" * 9, "don're'll'vex", "ΑΣ", "1234567890"]:
        want = [n(text[:p]) for p in range(1, len(text) + 1)]
        own.learn([text])
        assert own.counts(text) == want == T._prefixes(own.steps(text), 4)[1:].tolist(), ascii(text)


def test_words():
    """Words of letters with marks after them, which are worked out at once, and what only looks like one."""
    own, rng = T._counter(T.TOKENIZER), random.Random(4)
    for _ in range(800):
        text = "".join(rng.choice("abeiourstlnABEéÉüßñΣ") for _ in range(rng.randrange(12))) + "".join(rng.choice("!?.,;-") for _ in range(rng.randrange(4))) + rng.choice(["", "", "", "'", "<|", "7", "x", "̈"])
        want = [n(text[:p]) for p in range(1, len(text) + 1)]
        own.learn([text])
        assert T._prefixes(own.steps(text), 4)[1:].tolist() == want == own.counts(text), ascii(text)


def test_table_and_answers(spark, docs, rows):
    rng = random.Random(5)
    more = [(10_000 + i, " ".join(hard_parts(i, 6)), "en", "s", 0) for i in range(60)]
    more.append((20_000, "".join(rng.choice("aeiourstln") for _ in range(4_000)), "en", "s", 0))  # no white space at all
    table = T.prefix_table(docs.unionByName(spark.createDataFrame(more, docs.schema)))
    cut = table.select("*", T.within(7).alias("cut"), T.at(20).alias("first")).collect()
    texts = {i: t or "" for i, t, *_ in [*rows, *more]}
    assert sorted(r.doc_id for r in cut) == sorted(texts)
    for r in cut:
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_chars, r.n_tokens, r.first) == (len(t.encode()), len(t), n(t), n(t[:20])), r.doc_id
        assert n(t[: r.cut]) <= 7 and all(n(t[:p]) > 7 for p in range(r.cut + 1, min(r.cut + 40, len(t)) + 1)), r.doc_id
        if len(t) < 400:
            counts = T._prefixes(bytes(r.steps), r.width)
            assert counts.tolist() == [n(t[:p]) for p in range(len(t) + 1)]


def test_truncated(spark, docs, rows):
    got = {r.doc_id: r.text for r in T.truncated(docs, T.prefix_table(docs), 9).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, t, *_ in rows:
        assert (got[i] is None) == (t is None) and (t or "").startswith(got[i] or "") and n(got[i] or "") <= 9


def test_steps_beyond_one_byte(spark):
    row = spark.createDataFrame([(bytes([200, 0, 0, 0, 1, 0, 0, 0]), 4, 201, 2)], "steps binary, width int, n_tokens long, n_chars long")
    assert row.select(T.at(1).alias("a"), T.at(9).alias("b"), T.at(0).alias("c"), T.within(200).alias("d"), T.within(5).alias("e"), T.within(-1).alias("f")).first() == (200, 201, 0, 1, 0, 0)


def test_odd_rows(spark, none, odd):
    assert T.counted(none).count() == 0 and T.counted(none).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within"]
    clash = odd.selectExpr("*", "'x' AS steps", "1 AS width", "2 AS n_tokens", "'y' AS _doc", "'z' AS _cut")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in T.counted(clash, limit=3).collect()), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n(r.text or ""), n(r.text or "") > 3) for r in odd.collect()), key=str)
    assert got == want
    whole = clash.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    out = T.truncated(whole, T.prefix_table(whole), 2).collect()
    assert sorted((r.doc_id, r.text, r.width, r._cut) for r in out) == sorted((r.doc_id, r.text and r.text[:4], 1, "z") for r in whole.collect())


def test_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op11_token_counts(spark, sf).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i, len(t.encode()), n(t), n(t) > 2048) for i, t in texts.items())
