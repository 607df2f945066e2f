"""Operators that look at the whole corpus, and the pipeline."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausecut.llm import line_dedup, lm_scoring, mixing, packing, quality, seating
from clausecut.llm import queries as Q
from clausecut.llm.common import Scratch
from tests.llm import brute


def deduped(spark, texts):
    rows = [(r[0], r[1]) for r in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()), key=str), rows


def test_chunks_do_not_shift(spark):
    rng = random.Random(2)
    lines = [" ".join(str(rng.random()) for _ in range(5)) for _ in range(200)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["new line", *lines]))], "doc_id long, text string")
    rows = sorted(line_dedup.line_rows(df).collect(), key=lambda r: (r.doc_id, r.pos))
    assert ["\n".join(r.line for r in rows if r.doc_id == i) for i in (1, 2)] == ["\n".join(lines), "\n".join(["new line", *lines])]
    one, two = ([r for r in rows if r.doc_id == i] for i in (1, 2))
    assert [r.opens for r in one[3:]] == [r.opens for r in two[4:]] and 20 < sum(r.opens for r in one) < 120


def test_line_dedup(spark, rows):
    """Against trying every run of lines; also many short lines over few contents, with blank ones and long ones between."""
    rng = random.Random(8)
    pool = ["", " ", *(" ".join(f"p{i}x{j}" for j in range(rng.choice([1, 3, 12, 26, 49, 50, 51, 60]))) for i in range(60))]
    more = [(10_000 + k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for k in range(60)]
    for k in range(40):  # passages of lines in a row, between lines of their own
        a = rng.randrange(2, 50)
        more.append((20_000 + k, "\n".join([f"own {k} a", *pool[a : a + rng.randrange(1, 9)], f"own {k} b"])))
    got, texts = deduped(spark, [(r[0], r[1]) for r in rows] + more)
    want = brute.line_dedup(texts)
    assert got == sorted(((i, want[i, t]) for i, t in texts), key=str)


@pytest.mark.parametrize("shape", [(60,), (30, 30), (16,) * 4, (12,) * 5, (12,) * 20, (30, 100, 20), (51,), (26, 25)])
def test_repeated_passages_of_over_50_words_go(spark, shape):
    passage = [" ".join(f"l{i}w{j}" for j in range(n)) for i, n in enumerate(shape)]
    texts = [(k, "\n".join([f"unlike line {k}", *passage, f"other line {k}"])) for k in range(4)]
    got, _ = deduped(spark, texts)
    assert got == [(0, texts[0][1]), *((k, f"unlike line {k}\nother line {k}") for k in (1, 2, 3))]


def test_line_dedup_without_ids(spark):
    """Rows without ids: equal ones keep all, and of a chunk that two of them share one copy stays."""
    lines = [f"l{i} k{i} m{i}" for i in range(12)]
    texts = [(None, "\n".join(lines)), (None, "\n".join(lines)), (None, "\n".join(["top", *lines])), (4, "\n".join(["first", *lines]))]
    got, texts = deduped(spark, texts)
    want = brute.line_dedup(texts)
    assert got == sorted(((i, want[i, t]) for i, t in texts), key=str) and want[4, texts[3][1]] == texts[3][1]
    got, _ = deduped(spark, texts[:2])
    assert got == texts[:2]


def test_line_dedup_of_a_long_text(spark):
    """Time in proportion to the lines, more or less: 8 times the lines in less than 30 times the time."""
    import time

    seconds = []
    for n in (2_000, 16_000):
        text = "\n".join(f"l{i % (n // 2)} a b" for i in range(n))
        begun = time.perf_counter()
        got, _ = deduped(spark, [(1, text)])
        seconds.append(time.perf_counter() - begun)
        assert len(got[0][1].split("\n")) <= n // 2 + 40
    assert seconds[1] < 30 * max(seconds[0], 1)


def test_line_dedup_edges(none, odd):
    assert line_dedup.dedup_lines(none).collect() == []
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    assert sorted(map(str, out.drop("n_lines", "n_removed").collect())) == sorted(map(str, odd.collect()))


def naive_best_fit(lengths, size):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(size - x)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 20, 64])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 90))]
    used = defaultdict(list)
    for length, _, n, first, offset in packing.plan(dict(Counter(lengths)), size).tolist():
        for k in range(n):
            used[first + k].append((offset, length))
    for parts in used.values():
        assert list(itertools.accumulate((x for _, x in sorted(parts)), initial=0))[:-1] == [o for o, _ in sorted(parts)]
    assert sorted(size - sum(x for _, x in p) for p in used.values()) == naive_best_fit(lengths, size)


def token_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing(docs, rows):
    size = 256
    out = packing.packed(docs, size=size, with_ids=True).collect()
    want = dict(zip([r[0] for r in rows], token_ids([r[1] for r in rows]), strict=True))
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= size and r.start == r.piece * size
        by_doc[r.doc_id].append((r.piece, r.ids))
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert {i: sum((x for _, x in sorted(p)), []) for i, p in by_doc.items()} == want
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(by_bin) == len(naive_best_fit([r.length for r in out], size))
    whole = {r.sequence_id: r.ids for r in packing.sequences(packing.packed(docs, size=size, with_ids=True)).collect()}
    assert sum(map(len, whole.values())) == sum(map(len, want.values()))


def test_tokenizer_parts():
    import pyarrow as pa

    texts = ["", None, "don't stop-it...now!! <|endoftext|>x", "İstanbul ΑΣ ΣΑΣ é x ²½", "a\tb\x0bc\x1cd\x85e f", "THE The the, THE. the;", "क़ 각 x", "word'S it's'"]
    ids, at = packing.encoded(pa.array(texts, pa.string()))
    assert [[*ids[a:b].tolist(), 0] for a, b in zip(at[:-1], at[1:], strict=True)] == token_ids(texts)


def test_tokenizer_parts_with_letters_that_come_apart():
    """Letters of which normalization makes a letter and a mark, before ASCII marks."""
    import pyarrow as pa

    texts = ["TATİLİ.", "TATİLİ. GELDİ!! İ, Tatili.", "İ", "İ...", "क़.", "क़, ড়!", "TATİL.", "שׁ;"]
    ids, at = packing.encoded(pa.array(texts, pa.string()))
    assert [[*ids[a:b].tolist(), 0] for a, b in zip(at[:-1], at[1:], strict=True)] == token_ids(texts)


def test_packing_edges(none, odd):
    assert packing.packed(none).collect() == []
    out = packing.packed(odd).collect()
    assert len(out) == 5 and {r.doc_id for r in out} == {None, 5, 7, 2**60 + 1}


def test_mixing(docs, rows):
    """What a source gives is what the points give it in blocks; within a block of the target it is the target."""
    want = brute.targets([(s, t) for _, t, _, s, _ in rows])
    words = int(1.5 * sum(n for n, _ in want.values()))
    results = {}
    for slots, ratio in ((50, mixing.GOLDEN), (mixing.SLOTS, mixing.GOLDEN), (700, 0.0), (700, 0.37)):
        out = mixing.mixed_sizes(docs, slots=slots, ratio=ratio).collect()
        assert len(out) == len(rows)
        block = max(1, -(-words // slots))
        n, total, low, at = -(-words // block), sum(t for _, t in want.values()), 0.0, {}
        for s in sorted((x for x in want if x is not None)) + [None]:
            at[s] = (low / total, (low + want[s][1]) / total)
            low += want[s][1]
        points = [((i + 0.5) * ratio) % 1.0 for i in range(n)]
        taken = Counter()
        for r in out:
            assert (r.source_size, r.target) == (want[r.source][0], pytest.approx(want[r.source][1]))
            assert 0 <= r.taken <= 2 * r.size and (r.taken > 0) == (r.first_slot is not None)
            taken[r.source] += r.taken
        for s, (size, target) in want.items():
            given = block * sum(at[s][0] <= u < at[s][1] for u in points)
            assert taken[s] == (round(target) if abs(given - target) < block else min(given, 2 * size)), (slots, ratio, s)
        results[slots, ratio] = sorted((r.doc_id, r.taken) for r in out)
    assert len(set(map(str, results.values()))) > 2
    again = sorted((r.doc_id, r.taken) for r in mixing.mixed_sizes(docs.repartition(5), slots=50).collect())
    assert again == results[50, mixing.GOLDEN]


def test_mixing_caps(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (900, "b"), (50, "c"), (5, "d"), (0, "e"), (40, None)])]
    got = {r.source: r.target for r in mixing.mixed_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {s: pytest.approx(t) for s, (_, t) in brute.targets([(s, t) for _, t, s in rows]).items()}


def test_schedule_is_even(docs):
    """In any run of slots each source has its share, but for a few."""
    _, sources, pieces, _ = mixing.mix(docs, slots=2000)
    share = {r.skey: r.target for r in sources.collect()}
    dealt = {r.slot: r.skey for r in mixing.schedule(docs.sparkSession, sources.select("skey", "rank", "target"), 2000).collect()}
    for n in (100, 500, 1000):
        for s, t in share.items():
            assert abs(sum(dealt[i] == s for i in range(n)) - n * t / sum(share.values())) < 4
    assert pieces.groupBy("slot").agg(F.sum("words").alias("n")).agg(F.max("n")).first()[0] <= -(-sum(share.values()) // 2000) + 1


def test_mixed_documents(docs, rows):
    text = {r[0]: r[1] for r in rows}
    out = mixing.mixed_documents(docs)
    assert out.columns == [*docs.columns, "mix_slot"] and out.where("mix_slot IS NULL").count() == 0
    total = Counter()
    for r in out.collect():
        assert brute.words(r.text) == brute.words(text[r.doc_id])[: len(brute.words(r.text))] and r.n_chars == len(r.text)
        total[r.doc_id] += len(brute.words(r.text))
    assert total == Counter({r.doc_id: r.taken for r in mixing.mixed_sizes(docs).collect() if r.taken})


def test_mixing_edges(none, odd):
    assert mixing.mixed_sizes(none).collect() == []
    assert len(mixing.mixed_sizes(odd).collect()) == 5


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def test_lm_base(docs, rows):
    got = {r.doc_id: r for r in lm_scoring.scored(docs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    c = Counter(x for i, t, *_ in rows if not held[i] for x in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t, *_ in rows:
        w, r = tokens(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    train = [r for r in got.values() if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)


def test_lm_is_a_distribution(spark, docs):
    """After each class, the probabilities of all training words and of the unknown one add up to 1."""
    scratch = Scratch(spark, "t")
    words = scratch.write(lm_scoring.counted(docs.where("text IS NOT NULL"), scratch), "words")
    rows = words.toPandas()
    model, totals = lm_scoring.fitted(words, len(rows), scratch)
    rows = model.toPandas()
    p = lm_scoring.Predictor(totals, int(rows["c"].sum()), len(rows))
    table = lm_scoring.Table(rows, p)
    nothing = p.parents(np.zeros((1, lm_scoring.SAMPLES)), np.zeros((1, lm_scoring.SAMPLES)))
    for k in [*range(0, lm_scoring.CLASSES, 5), lm_scoring.class_of(b"")]:
        known = 10 ** table.look_up(np.arange(len(rows)), np.full(len(rows), k))
        unknown = 10 ** p.scores(nothing, np.array([k]), np.zeros(1))
        assert known.sum() + unknown[0] == pytest.approx(1.0) and known.min() > 0


def test_lm_does_not_depend_on_the_dealing(spark, docs):
    """The same scores with other partitions of the rows and of the shuffles, and with and without broadcast words."""
    runs = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for dealt, shuffles, frequent in ((1, "3", 1 << 15), (6, "7", 1 << 15), (2, "4", 8)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            lm_scoring.FREQUENT, kept = frequent, lm_scoring.FREQUENT
            try:
                runs.append({r.doc_id: r.score for r in lm_scoring.scored(docs.repartition(dealt)).collect()})
            finally:
                lm_scoring.FREQUENT = kept
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs[0] == pytest.approx(runs[1]) and runs[0] == pytest.approx(runs[2])


def test_stirling_numbers():
    d, n = 0.75, 2000
    row = np.full(n + 2, -np.inf)
    row[1] = 0.0
    t = np.arange(1, n + 2)
    for c in range(1, n):
        with np.errstate(divide="ignore"):
            row[1:] = np.logaddexp(row[:-1], np.log(np.maximum(c - t * d, 0)) + row[1:])
    got = seating.log_stirling(np.full(1800, n), np.arange(1, 1801), d)
    assert np.abs(np.diff(got) - np.diff(row[1:1801])).max() < 0.01
    assert seating.log_stirling(np.array([1, 2, 2, 3]), np.array([1, 1, 2, 2]), d) == pytest.approx(np.log([1, 0.25, 1, 0.75]))


@pytest.mark.parametrize(("c", "a", "q", "z"), [(6, 3.0, -0.3, 4.0), (9, 40.0, 2.5, 30.0), (5, 2.0, 0.2, None)])
def test_draws_are_those_of_single_customers(c, a, q, z):
    """Against a plain sampler that takes one customer out at a time and seats it by the restaurant's weights."""
    d, rng = 0.75, random.Random(3)
    tables, seen = [c], Counter()
    for step in range(60_000):
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        tables = [x for x in tables if x]
        t = len(tables)
        new = (a + d * t) * (q if z is None else (q + t) / (z + t))
        k = rng.choices(range(t + 1), [*(x - d for x in tables), new])[0]
        tables = [*tables, 1] if k == t else [x + (i == k) for i, x in enumerate(tables)]
        seen[len(tables)] += 1
    n = 60_000
    w = seating.Weights(d, np.full(n, a), np.full(n, q), None if z is None else np.full(n, z))
    drawn = Counter(seating.seated(np.full(n, c), np.ones(n, dtype=np.int64), w, seating.mixed(np.arange(n, dtype=np.uint64)), 1).tolist())
    assert max(abs(seen[t] - drawn[t]) / n for t in range(1, c + 1)) < 0.02


def test_draws_of_many_customers():
    """Steps of the sampler beyond the table keep to the weights."""
    n, c = 4000, 1500
    w = seating.Weights(0.75, np.full(n, 30.0), np.full(n, 0.5), np.full(n, 20.0))
    t, key = np.ones(n, dtype=np.int64), seating.mixed(np.arange(n, dtype=np.uint64))
    for turn in range(5):
        t = seating.seated(np.full(n, c), t, w, key, turn)
    x = np.arange(1, c + 1)
    one = seating.Weights(0.75, np.full(c, 30.0), np.full(c, 0.5), np.full(c, 20.0))
    p = seating.log_stirling(np.full(c, c), x, 0.75) + one.at(x)
    p = np.exp(p - p.max()) / np.exp(p - p.max()).sum()
    mean = (p * x).sum()
    assert t.mean() == pytest.approx(mean, rel=0.02) and t.std() == pytest.approx(math.sqrt((p * (x - mean) ** 2).sum()), rel=0.1)


def test_lm_edges(none, odd):
    assert lm_scoring.scored(none).collect() == []
    assert sorted(str(r.doc_id) for r in lm_scoring.scored(odd).collect()) == sorted(map(str, [None, 5, 5, 7, 2**60 + 1]))


def test_pipeline(spark, docs, rows):
    """Each stage against plain Python, on what the stage before gave."""
    now, names = docs, [f.__name__ for _, f in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup_stage", "near_duplicates", "source_mix", "best_fit_packing"]
    more = spark.createDataFrame([(1000 + i, " ".join(f"w{random.Random(i).randrange(99)}x{j % 50}" for j in range(80)), "en", f"s{i % 3}", 1) for i in range(30)], docs.schema)
    now = docs.unionByName(more).cache()
    for _, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in now.collect()]
        out = stage(spark, now, "").cache()
        after = [r.asDict() for r in out.collect()]
        assert after
        if stage is corpus_pipeline.quality_rules:
            kept = {r["doc_id"] for r in after}
            for r in before:
                m = dict(zip(quality.MEASURES, quality.measured(r["text"]), strict=True))
                assert (r["doc_id"] in kept) == (not any(eval(rule, {}, m) for rule in quality.RULES.values()))  # noqa: S307
        elif stage is corpus_pipeline.near_duplicates:
            comp = brute.linked([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert sorted(r["doc_id"] for r in after) == sorted({c for _, c in comp.values()})
        elif stage is corpus_pipeline.source_mix:
            want = brute.targets([(r["source"], r["text"]) for r in before])
            got = Counter()
            for r in after:
                got[r["source"]] += len(brute.words(r["text"]))
            assert all(abs(got[s] - t) <= 1 for s, (_, t) in want.items())
        elif stage is corpus_pipeline.best_fit_packing:
            assert sum(r["length"] for r in after) == sum(map(len, token_ids([r["text"] for r in before])))
        if stage is not corpus_pipeline.best_fit_packing:
            assert out.columns == docs.columns
        now = out


def test_pipeline_runs(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_queries_have_their_columns(spark, sf):
    want = {
        "op1": "doc_id n_shingles component_id", "op2": "page_id url text n_chars", "op4": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op5": "doc_id piece start length ids_crc32 sequence_id offset",
        "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op7": "doc_id held_out n_tokens n_known train_tokens base_score score", "op8": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op9": "doc_id size source_size target taken", "op10": "doc_id keep_id group_size kept text_sha256",
    }
    for name, f in Q.QUERIES.items():
        if cols := want.get(name.split("_")[0]):
            assert set(cols.split()) <= set(f(spark, sf).columns), name
