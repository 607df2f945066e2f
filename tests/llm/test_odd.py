"""Null ids, repeated rows, clashing column names and empty tables: whole results against the brute-force versions."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from clausecut.llm import exact_dedup, line_dedup, lm_scoring, mixing, ngram_join, packing, pii, quality, secrets
from tests.llm import brute

LINES = "\n".join(f"line {i} of some words that repeat" for i in range(14))
TEXTS = [
    (None, f"password = hunter2secret and mail a@b.cc\n{LINES}", "s"), (1, f"password = hunter2secret and mail a@b.cc\n{LINES}", "s"), (None, f"other start\n{LINES}", None), (None, f"other start\n{LINES}", None),
    (7, None, "t"), (None, "", "t"), (None, None, None), (9, " \n ", "s"), (9, "x y z " * 40, "s"), (9, "x y z " * 40, "s"), (2, "AKIA" + "A1" * 10 + " 4111 1111 1111 1111 " + "0123456789abcdef" * 2, "t"),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, s, k, "x", "y") for k, (i, t, s) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rid long, size string, block string").repartition(3)


def ordered(rows):
    return sorted(str(tuple(r)) for r in rows)


#: Names that the code uses itself, and some in another case.
OWN_NAMES = "_id _md5 _kept _rest _own _lines _stay _n _sha mask m failure_bits _pii _M _ID_ rid name size sig node block n text_md5 word_chars norm best".split()
FUNCTIONS = {
    "line dedup": lambda d: line_dedup.dedup_lines(d).drop("n_lines", "n_removed"), "near duplicates": lambda d: ngram_join.one_of_each(d, k=3, num=90, den=100), "exact dedup": exact_dedup.dedup, "quality": quality.accepted,
    "secrets": lambda d: secrets.find(d).drop("secrets"), "pii": lambda d: pii.find(d).drop("pii"), "redaction": pii.redact, "mixing": lambda d: mixing.mixed_documents(d).drop("mix_slot"),
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_clashing_names(spark, name):
    """Whole rows, with a column of each name that the code uses, against the same without them."""
    rows = [(i, t, s) for i, t, s in TEXTS]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    names = [n for n in OWN_NAMES if n.lower() not in ("doc_id", "text", "source")]
    kept = list({n.lower(): n for n in names}.values())
    wide = spark.createDataFrame([(*r, *[f"{k} {n}" for n in kept]) for k, r in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in kept)).repartition(2)
    out, want = FUNCTIONS[name](wide), FUNCTIONS[name](plain)
    assert out.columns == wide.columns and want.columns == plain.columns
    got = out.collect()
    assert ordered((r.doc_id, r.text, r.source) for r in got) == ordered((r.doc_id, r.text, r.source) for r in want.collect())
    for r in got:  # what a row carries is still its own
        k = int(r[kept[0]].split()[0])
        assert [r[n] for n in kept] == [f"{k} {n}" for n in kept] and rows[k][0] == r.doc_id and rows[k][2] == r.source


def test_columns_that_give_way(spark):
    df = spark.createDataFrame([(1, "a b\na b", 7, 8, "x", "y")], "doc_id long, text string, n_lines long, n_removed long, secrets string, pii string")
    assert line_dedup.dedup_lines(df).columns == ["doc_id", "text", "secrets", "pii", "n_lines", "n_removed"]
    assert secrets.find(df).columns == ["doc_id", "text", "n_lines", "n_removed", "pii", "secrets"] and pii.redact(df).first() == df.first()


def test_maps(table):
    got = pii.digest(table).collect()
    assert ordered((r.doc_id, r.n_email, r.n_card, r.base_sha256) for r in got) == ordered((i, brute.pii(t)[0]["email"], brute.pii(t)[0]["card"], brute.pii(t)[1]) for i, t, _ in TEXTS)
    got = secrets.digest(table).collect()
    assert ordered((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == ordered((i, *brute.secrets(t)[0], brute.secrets(t)[1]) for i, t, _ in TEXTS)
    got = quality.judged(table).collect()
    assert ordered((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == ordered((i, *brute.quality(t)) for i, t, _ in TEXTS)
    good = quality.accepted(table).collect()
    verdicts = quality.ledger(table).collect()
    assert ordered(good) == ordered(r[: len(table.columns)] for r in verdicts if r.failure_bits & quality.mask(quality.CURRENT) == 0)


def test_line_dedup(table):
    want = brute.line_dedup([(i, t) for i, t, _ in TEXTS])
    out = line_dedup.dedup_lines(table)
    assert ordered((r.doc_id, r.text, r.source) for r in out.collect()) == ordered((i, want[i, t], s) for i, t, s in TEXTS)
    assert sum(x is not None and "line 5 of" in x for x in want.values()) == 1  # one copy of the passage, in the row with an id


def test_exact_dedup(table):
    keys = defaultdict(list)
    for i, t, _ in TEXTS:
        keys["".join(brute.words(t))].append((-len(t or ""), i is None, i or 0))
    best = {k: min(v) for k, v in keys.items()}
    got = exact_dedup.exact_groups(table).collect()
    want = [(i, None if best["".join(brute.words(t))][1] else best["".join(brute.words(t))][2], len(keys["".join(brute.words(t))]), brute.sha("".join(brute.words(t)))) for i, t, _ in TEXTS]
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == ordered(want)
    assert sum(r.kept for r in got) == len(keys)


def test_links(table):
    ids = {}
    for k, (_, t, _) in enumerate(TEXTS):
        ids[k] = t
    comp = brute.linked(list(ids.items()))
    least = {}
    for k, (_, c) in comp.items():
        known = [i for j, (i, _, _) in enumerate(TEXTS) if comp[j][1] == c and i is not None]
        least[k] = min(known) if known else None
    got = ngram_join.linked(table).collect()
    want = [(i, comp[k][0], (least[k] if brute.shingles(t) else i)) for k, (i, t, _) in enumerate(TEXTS)]
    assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in got) == ordered(want)


def test_packing(table):
    out = packing.packed(table, size=64, with_ids=True).collect()
    by_bin = defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) and r.start == 64 * r.piece
        by_bin[r.sequence_id].append((r.offset, r.length))
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(i for i, _, _ in TEXTS)


def test_mixing(table):
    want = brute.targets([(s, t) for _, t, s in TEXTS])
    got = mixing.mixed_sizes(table).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.target == pytest.approx(want[r.source][1])
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len(brute.words(t))) for i, t, s in TEXTS)
    assert all(abs(taken[s] - t) <= 3 for s, (_, t) in want.items())


def test_language_model(table):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(x for i, t, _ in TEXTS if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = [(i, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t, _ in TEXTS]
    got = lm_scoring.scored(table).collect()
    assert ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == ordered(want)
    same = defaultdict(set)
    for r in got:
        same[r.n_tokens, round(r.base_score, 6)].add(round(r.score, 6))
    assert all(len(x) == 1 and max(x) < 0 for x in same.values())


def test_all_ids_null(spark):
    """No row has an id, and one passage is in all of them."""
    texts = [(None, f"start {k}\n{LINES}\nend {k}") for k in range(5)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute.line_dedup(texts)
    assert ordered((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()) == ordered((i, want[i, t]) for i, t in texts)
    assert exact_dedup.dedup(df).count() == 5 and {r.component_id for r in ngram_join.linked(df).collect()} == {None}
