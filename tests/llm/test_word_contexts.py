"""Words as contexts of op7: contexts of one class are told apart, probabilities add up to one, shards do not matter."""

import zlib

import numpy as np
import pandas as pd
import pytest

from clausecut.llm import lm_scoring, word_contexts
from clausecut.llm.common import Scratch


def ids(held: bool):
    return (i for i in range(10_000) if (zlib.crc32(str(i).encode()) % 7 == 2) == held)


def test_contexts_of_one_class_are_told_apart(spark):
    by_class = {}
    for k in range(10_000):
        u, v = f"w{k}", by_class.setdefault(lm_scoring.class_of(f"w{k}".encode()), f"w{k}")
        if u != v:
            break
    train, held = ids(False), ids(True)
    texts = [(next(train), f"{u} left" if k % 2 else f"{v} right") for k in range(200)] + [(next(held), t) for t in (f"{u} left", f"{u} right", f"{v} right", f"{v} left")]
    got = {r.doc_id: r for r in lm_scoring.scored(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    right, wrong, right2, wrong2 = (got[i].score for i, _ in texts[-4:])
    assert all(got[i].held_out for i, _ in texts[-4:]) and right > wrong + 1 and right2 > wrong2 + 1


def shard_of(parts, n, v, top, top1, k, places, extra):
    b = pd.concat([parts, pd.DataFrame([{"shard": i, "kind": 2, "contexts": extra.tobytes()} for i in range(k)])], ignore_index=True)
    asks = pd.concat([word_contexts.customers(x, places) for _, x in b.groupby("shard")])
    answers = pd.concat([word_contexts.told(x.reset_index(drop=True)) for _, x in asks.groupby("place")])
    out = []
    for i in range(k):
        s = word_contexts.Shard(n, v, top, top1)
        for r in parts[parts["shard"] == i].to_dict("records"):
            (s.model if r["kind"] == 0 else s.state)(r)
        for r in answers[answers["shard"] == i].to_dict("records"):
            s.answer(r["contexts"], r["sums"])
        s.ready()
        out.append(s)
    return out


@pytest.mark.parametrize(("shards", "places"), [(1, 4), (5, 8)])
def test_probabilities_add_up(spark, docs, shards, places):
    """After each word, a seen one or not, over all training words and the unknown one."""
    model, state, n, v, top, top1 = word_contexts.fitted(docs.where("text IS NOT NULL"), Scratch(spark, "t"), shards, places, 0)
    parts = pd.concat([model.toPandas().assign(kind=0), state.toPandas().drop(columns=["contexts", "counts"]).assign(kind=1)], ignore_index=True)
    assert len(model.toPandas()) <= shards and v == sum(len(x) // 8 for x in model.toPandas()["names"])
    unseen = np.array([12345], np.uint64)
    contexts = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in model.toPandas()["contexts"]]))
    of = shard_of(parts, n, v, top, top1, shards, places, np.concatenate([contexts, unseen]))  # each shard asks for all
    for u in [*contexts[:: max(1, len(contexts) // 40)], unseen[0]]:
        known = np.concatenate([10 ** s.scores(s.names, np.full(len(s.names), u))[2].astype(float) for s in of])
        unknown = 10 ** float(of[0].scores(unseen, np.array([u]))[2][0])
        assert len(known) == v and known.min() > 0 and known.sum() + unknown == pytest.approx(1.0, rel=1e-4)


def test_shards_do_not_matter(spark, docs, monkeypatch):
    runs = []
    for size, dealt in ((1 << 24, 1), (20_000, 5)):
        monkeypatch.setattr(word_contexts, "SHARD", size)
        runs.append({r.doc_id: (r.n_tokens, r.n_known, r.score) for r in lm_scoring.scored(docs.repartition(dealt)).collect()})
    assert runs[0].keys() == runs[1].keys()
    for i, x in runs[0].items():
        assert runs[1][i] == pytest.approx(x)


def test_names_that_clash_are_given_anew(spark, monkeypatch):
    train = ids(False)
    df = spark.createDataFrame([(next(train), "a b a c")], "doc_id long, text string")
    seeds, fit = [], word_contexts.fitted
    monkeypatch.setattr(word_contexts, "fitted", lambda *a: seeds.append(a[-1]) or (None if a[-1] == 0 else fit(*a)))
    assert lm_scoring.scored(df).first().n_known == 5 and seeds == [0, 1]
    b = pd.DataFrame([{"shard": 0, "names": np.array([7], "<u8").tobytes(), "checks": np.array([c], "<u8").tobytes(), "each": np.array([1], "<u4").tobytes(), "contexts": np.array([1], "<u8").tobytes(), "counts": b"\x01"} for c in (1, 2)])
    assert word_contexts.merged(b)["clashes"].tolist() == [1] and word_contexts.merged(b.iloc[[0, 0]].reset_index(drop=True))["clashes"].tolist() == [0]


def test_what_moves_is_in_proportion_to_the_texts(spark, monkeypatch):
    """Hashes of contexts moved with all pairs, twice, and again with the model and its answers."""
    monkeypatch.setattr(word_contexts, "SHARD", 1 << 20)
    rng = np.random.default_rng(7)
    words = np.array([f"word{k:x}" for k in range(50_000)])
    texts = [" ".join(words[np.minimum(rng.zipf(1.2, 400), len(words)) - 1]) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)

    def written() -> int:
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        every = sc.statusStore().executorList(False)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    before = written()
    lm_scoring.scored(df).write.format("noop").mode("overwrite").save()
    moved, size = written() - before, sum(map(len, texts))
    assert moved < 4 * size


def test_words_have_one_number_each(spark):
    """The same in every row that names them; in a slot the most frequent first, words of no training text last and not in the vocabulary."""
    names = np.array([5, 7, 9, (1 << 48) + 1], "<u8")
    row = lambda which, counts: {"shard": 0, "names": names[which].tobytes(), "checks": names[which].tobytes(), "counts": word_contexts.short(np.array(counts))}
    got = word_contexts.merged(pd.DataFrame([row([0, 1, 3], [1, 300, 2]), row([0, 2], [5, 0])])).iloc[0]
    first, second = (np.frombuffer(x, "<u4").tolist() for x in got["numbers"])
    assert (first, second) == ([1, 0, 1 << 16], [1, 2]) and (got["v"], got["n"], got["clashes"]) == (3, 308, 0)
    assert [word_contexts.full(x, k).tolist() for x, k in zip(got["totals"], (3, 2), strict=True)] == [[6, 300, 2], [6, 0]]


def test_held_out_words_that_share_a_hash_clash():
    rows = [{"shard": 0, "names": np.array([7], "<u8").tobytes(), "checks": np.array([c], "<u8").tobytes(), "counts": word_contexts.short(np.array([n]))} for c, n in ((1, 3), (2, 0))]
    assert word_contexts.merged(pd.DataFrame(rows))["clashes"].tolist() == [1]


def test_packed_arrays_come_back():
    b = pd.DataFrame({"contexts": [np.array([1, 2**40], "<u8").tobytes(), b"", None], "counts": [b"\x01\x02", b"", None], "samples": [[b"\x03", b""], [], None], "shard": [1, 2, 3]})
    assert word_contexts.unpack(word_contexts.pack(b)).equals(b)
