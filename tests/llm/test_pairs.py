"""Exact dedup and the n-gram join."""

import itertools
import random

import pytest

from clausecut.llm import components as C
from clausecut.llm import exact_dedup, ngram_join
from clausecut.llm.common import Scratch
from tests.llm import brute


def test_exact_groups(docs, rows):
    for block in (7, 4096):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, block=block).collect()}
        assert got == brute.exact([(i, t) for i, t, *_ in rows])


def test_exact_edges(none, odd):
    assert exact_dedup.exact_groups(none).collect() == []
    out = exact_dedup.exact_groups(odd).collect()
    assert len(out) == 5 and sum(r.kept for r in out) == 3
    assert sorted(r.group_size for r in out) == [1, 1, 3, 3, 3]
    assert exact_dedup.dedup(odd).columns == odd.columns


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 60)])
def test_links(docs, rows, k, num):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(docs, k=k, num=num).collect()}
    assert got == brute.linked([(i, t) for i, t, *_ in rows], k, num)


def test_links_of_many_near_copies(spark):
    """A group in which most pairs do not link, and every signature is frequent."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.linked(docs)


def test_links_edges(none, odd):
    assert ngram_join.linked(none).collect() == []
    out = ngram_join.linked(odd).collect()
    assert len(out) == 5
    assert {r.doc_id: r.n_shingles for r in out} == {None: 2, 5: 2, 2**60 + 1: 0, 7: 2}
    assert ngram_join.one_of_each(odd).columns == odd.columns


def test_one_of_each_keeps_the_least(docs, rows):
    comp = brute.linked([(i, t) for i, t, *_ in rows])
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect()) == sorted({c for _, c in comp.values()})


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(1, 200)]
    more = [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(150)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in path + more:
        lo, hi = sorted((top(a), top(b)))
        parent[hi] = lo
    edges = spark.createDataFrame(path + more, "a long, b long")
    got = {r.node: r.comp for r in C.components(edges, Scratch(spark, "t"), "t").collect()}
    assert got == {x: top(x) for a, b in path + more if a != b for x in (a, b)}


def test_a_single_frequent_shingle_needs_no_signature():
    import pandas as pd

    item = [{"token": 5, "holders": 99}]
    assert list(ngram_join._signatures(iter([pd.DataFrame({"node": [1], "n": [1], "items": [item]})]), 80, 100)) == []


def test_short_documents_of_frequent_words(spark):
    """Many small classes over few shingles."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k, num in ((5, 80), (2, 60)):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(df, k=k, num=num).collect()} == brute.linked(docs, k, num)


@pytest.mark.parametrize(("num", "most"), [(90, 31), (80, 16)])
def test_peeling_keeps_all_small_links(spark, num, most):
    """Isolated pairs of each (n_x, n_y, overlap) that links, as sets of single words."""
    pairs, docs = [], []
    for n, m in itertools.combinations_with_replacement(range(1, most), 2):
        for both in range(n + 1):
            if both < m and 100 * both >= num * (n + m - both):
                for turn in range(3):
                    i = len(docs)
                    word = f"p{i}t{turn}"
                    shared = [f"{word}s{j}" for j in range(both)]
                    docs.append((i, " ".join([*shared, *(f"{word}x{j}" for j in range(n - both))])))
                    docs.append((i + 1, " ".join([*shared, *(f"{word}y{j}" for j in range(m - both))])))
                    pairs.append((n, m, both, i))
    got = {r.doc_id: r.component_id for r in ngram_join.linked(spark.createDataFrame(docs, "doc_id long, text string"), k=1, num=num).collect()}
    assert [p for p in pairs if got[p[3] + 1] != p[3]] == []


def test_links_through_a_class_without_ids(spark):
    base = [f"w{i}" for i in range(100)]
    a, b, c = base[:], [*base[:98], "x0", "x1"], [*base[:96], "y0", "y1", "x0", "x1"]
    docs = [(4, " ".join(a)), (None, " ".join(b)), (9, " ".join(c))]
    assert brute.linked([(1, docs[0][1]), (2, docs[2][1])], 1, 95)[2][1] == 2
    got = {r.doc_id: r.component_id for r in ngram_join.linked(spark.createDataFrame(docs, "doc_id long, text string"), k=1, num=95).collect()}
    assert got == {4: 4, None: 4, 9: 4}


def test_names_do_not_depend_on_the_dealing(spark, docs):
    """A name is a rank: the same however the rows are dealt, and from 0 on."""
    runs = []
    for n in (1, 7):
        rows = exact_dedup.name_texts(docs.repartition(n), block=16).select("doc_id", "n_blocks", "name").collect()
        runs.append(sorted(map(tuple, rows)))
    assert runs[0] == runs[1]
    ones = {r[2] for r in runs[0] if r[1] == 1}
    assert min(ones) >= 0 and max(r[2] for r in runs[0]) < 10_000


def test_exact_dedup_without_ids(spark):
    rows = [(None, "a b"), (None, "a  b "), (3, "a b"), (None, "c"), (None, "d"), (None, "d"), (None, None), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in exact_dedup.dedup(df).collect()))) == sorted(map(str, [(None, "a  b "), (None, "c"), (None, "d"), (None, "d"), (8, " ")]))
    assert sorted(r.group_size for r in exact_dedup.exact_groups(df).collect()) == [1, 2, 2, 2, 2, 3, 3, 3]


def test_rows_come_key_by_key():
    import pandas as pd

    from clausecut.llm.common import by_key

    rng = random.Random(5)
    keys = sorted((rng.randrange(6), rng.randrange(3)) for _ in range(200))
    df = pd.DataFrame({"a": [a for a, _ in keys], "b": [b for _, b in keys], "x": range(200)})
    for size in (1, 3, 7, 50, 200):
        parts = list(by_key((df.iloc[i : i + size] for i in range(0, 200, size)), "a", "b"))
        assert pd.concat(parts)["x"].tolist() == list(range(200))
        held = [set(zip(p["a"], p["b"], strict=True)) for p in parts]
        assert sum(map(len, held)) == len(set(keys))  # no key in two lots
