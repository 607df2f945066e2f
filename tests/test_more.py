"""Long texts, places of spans, loose names, logs, and the command line for acquisition and inference."""

import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from clausecut import __main__ as cli
from clausecut.functions import text
from clausecut.operators import gold, labels, layout, metrics, segment
from clausecut.plans.engine import Corpus
from clausecut.sources import io
from tests import plain


def test_sums_before(spark):
    rng = random.Random(1)
    rows = [[rng.randrange(100) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 127, 128, 4095, 4096, 4097, 9000)]
    got = spark.createDataFrame([(r,) for r in rows], "v array<bigint>").select("v", text.sums_before(F.col("v")).alias("s")).collect()
    for r in got:
        assert r.s == list(itertools.accumulate(r.v, initial=0))[:-1]


def test_is_digit(spark):
    given = ["1", "12", "1a", "a1", "²", "1²", "٣", "٣4", "x", "", "½", "①", "-1", "é", "é1", "4³"]
    got = spark.createDataFrame([(x,) for x in given], "x string").select("x", text.is_digit(F.col("x")).alias("d")).collect()
    assert {r.x: r.d for r in got} == {x: x.isdigit() for x in given}


def test_spans_meet_tokens_as_rows_do(spark):
    """aligned_in() against the join of rows, on texts with gaps and other alphabets."""
    rng = random.Random(2)
    texts = ["", "  ", "Ala ma kota.", "é𝒳 ż 12,5 — ok", *(" " * rng.randrange(3) + " ".join(rng.choice(["kot", "§", "12.", "a)", "zażółć"]) for _ in range(60)) for _ in range(6))]
    docs = []
    for i, t in enumerate(texts):
        listed = [(k, a, a + rng.randrange(0, 9)) for k, a in enumerate(rng.randrange(len(t) + 4) for _ in range(25))]
        docs.append((i, t, listed))
    df = spark.createDataFrame(docs, "doc int, text string, spans array<struct<span_no:int,start:int,end:int>>").withColumn("tokens", gold.token_offsets(F.col("text")))
    inside = df.select("doc", F.explode(gold.aligned_in(F.col("spans"), F.col("tokens"))).alias("s")).select("doc", "s.*")
    spans = df.select("doc", F.explode("spans").alias("s")).select("doc", "s.*")
    tokens = df.select("doc", F.explode("tokens").alias("t")).select("doc", "t.*")
    joined = plain.aligned(spans, tokens, ("doc",))
    assert sorted(map(str, inside.collect())) == sorted(map(str, joined.select(*inside.columns).collect()))
    starts = df.select("doc", F.explode(gold.start_places(gold.aligned_in(F.col("spans"), F.col("tokens")), True)).alias("k"))
    flagged = gold.sentence_starts(tokens, joined, ("doc",), True).where("is_sent_start").select("doc", "tok_no")
    have = {tuple(r) for r in starts.collect()}
    assert have >= {tuple(r) for r in flagged.collect()} and {d for d, _ in have} == set(range(len(texts)))


def naive_windows(sizes, full, least, joined):
    done, now = [], []
    for i, n in enumerate(sizes):
        now.append(i)
        if sum(sizes[k] for k in now) > full:
            done.append(now)
            now = []
    rest = sum(sizes[k] for k in now)
    if least <= rest <= full:
        done.append(now)
    elif rest and done and sum(sizes[k] for k in done[-1]) + rest <= joined:
        done[-1] = done[-1] + now
    return [(w[0], len(w)) for w in done]


def test_window_ranges():
    rng = random.Random(3)
    for _ in range(500):
        sizes = [rng.randrange(0, 12) for _ in range(rng.randrange(0, 20))]
        assert gold.window_ranges(sizes, 20, 5, 24) == naive_windows(sizes, 20, 5, 24)


def test_raised_words():
    assert layout.raised([10, 6, 6, 10, 6], [20, 15, 20, 40, 30], [False, False, False, False, True], 10) == [False, True, False, False, False]
    assert layout.raised([6, 10], [5, 20], [False, False], 10) == [False, False]


@pytest.mark.parametrize("what", ["clean", "pairs", "headers", "pack", "offsets", "align"])
def test_time_grows_with_the_text(spark, what):
    """Ten times the text in less than thirty times the time, which a quadratic step would not keep."""

    def run(n: int) -> float:
        df = spark.createDataFrame([([f"Zdanie numer {i} jest tutaj." if i % 5 else f"{i}." for i in range(n)],)], "s array<string>").withColumn("t", F.array_join("s", " "))
        spans = F.transform(F.sequence(F.lit(0), F.floor(F.length("t") / 40).cast("int")), lambda k: F.struct(k.alias("span_no"), (k * 40).alias("start"), (k * 40 + 30).alias("end")))
        column = {
            "clean": lambda: segment.clean_segments(F.col("s")), "pairs": lambda: segment.merge_header_pairs(F.col("s")), "headers": lambda: segment.merge_headers(F.col("s")),
            "pack": lambda: gold.packed(F.col("s")), "offsets": lambda: gold.token_offsets(F.col("t")), "align": lambda: gold.aligned_in(spans, gold.token_offsets(F.col("t"))),
        }[what]()
        begun = time.perf_counter()
        assert df.select(F.size(column).alias("n")).first().n > 0
        return time.perf_counter() - begun

    run(100)
    small, large = run(2_000), run(20_000)
    assert large < 30 * max(small, 0.5)


def test_loose_names(spark):
    tasks = spark.createDataFrame([("act_1_8",), ("act_1_81",), ("act_2_8",), ("act_1_9",)], "act_id string")
    files = spark.createDataFrame([("d/act_1_81_x_clean.txt",), ("d/act_1_818_y_clean.txt",), ("d/z act_2_80 act_1_9_clean.txt",), ("d/act_1_8_other.txt",)], "path string")
    got = {r.act_id: r.path for r in gold.with_texts(tasks, files, loose=True).collect()}
    assert got == {"act_1_8": "d/act_1_818_y_clean.txt", "act_1_81": "d/act_1_818_y_clean.txt", "act_2_8": "d/z act_2_80 act_1_9_clean.txt", "act_1_9": "d/z act_2_80 act_1_9_clean.txt"}


def test_counts_and_places(spark):
    files = spark.createDataFrame([(2024,), (2025,), (2025,)], "year int").withColumn("split", io.split_of(F.col("year"), (2025,)))
    assert sorted(map(tuple, metrics.file_counts(files).collect())) == [("test", 2025, 2), ("train", 2024, 1)]
    assert spark.range(1).select(labels.boundary_positions(F.array(*map(F.lit, (0, 1, 1, 0, 1)))).alias("p")).first().p == [1, 2, 4]


def test_log_of_metrics(spark, tmp_path):
    figures = spark.createDataFrame([("gold", 1, 0.5), ("silver", 2, 0.25)], "dataset string, tp long, f1 double")
    for run in ("a", "b"):
        io.log_metrics(figures, str(tmp_path / "log"), run, rate=0.1, size=350)
    rows = spark.read.parquet(str(tmp_path / "log"))
    got = {(r.run, r.of["dataset"], r.metric): r.value for r in rows.collect()}
    assert len(got) == 8 and got["b", "silver", "f1"] == 0.25 and rows.first().params == {"rate": "0.1", "size": "350"}


def page(path, content):
    """A parser for the test: each word of a file on a line of its own."""
    yield {"kind": "page", "page": 0, "width": 600.0, "height": 700.0, "raw": content.decode()}
    for i, w in enumerate(content.decode().split()):
        yield {"kind": "word", "page": 0, "no": i, "text": w, "x0": 0.0, "top": 10.0 + 30 * i, "bottom": 20.0 + 30 * i, "size": 10.0}


def stops():
    return lambda batch: [[1.0 if t == "." else -1.0 for t in w] for w in batch]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "index2020").write_text(json.dumps({"items": [{"pos": 1, "title": "A", "textPDF": True}, {"pos": 2, "title": "B", "textPDF": False}]}))

    def fetched(new):
        return new.select("name", F.col("url").alias("path"), F.lit("Tekst ustawy.").cast("binary").alias("content"), F.lit("done").alias("status"))

    monkeypatch.setattr(io, "fetched", fetched)
    arguments = ["acquire", "2020-2021", "--index", f"file://{tmp_path}/index{{year}}", "--parser", "tests.test_more:page", "--output", str(tmp_path / "out")]
    cli.main(arguments)
    cli.main(arguments)
    said = capsys.readouterr().out
    assert said.count("done: 1") == 2 and "2021: " in said
    assert [(r.name, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("act_2020_1_A", "Tekst\nustawy.")]
    (tmp_path / "2020").mkdir()
    (tmp_path / "2020" / "act_2020_1_x_clean.txt").write_text("Ala ma kota. To pies.")
    cli.main(["segment", "--texts", str(tmp_path / "2020"), "--scorer", "tests.test_more:stops", "--output", str(tmp_path / "sentences")])
    assert sorted(r.sentence for r in spark.read.parquet(str(tmp_path / "sentences")).collect()) == ["Ala ma kota.", "To pies."]


def test_headers_as_sql_reads_them(spark):
    """The rules' \\w holds all letters; RE2's, and so that of the SQL of silver_windows_single_line, ASCII alone (document 245 of sf0.1)."""
    x = ["1219538112535716 Éaielletre.", "En la des et.", "2a.", "ROZDZIAŁ 3.", "Tekst"]
    assert segment.paired(x) == ["1219538112535716 Éaielletre. En la des et.", "2a. ROZDZIAŁ 3.", "Tekst"]
    assert segment.paired(x, ascii_words=True) == ["1219538112535716 Éaielletre.", "En la des et.", "2a. ROZDZIAŁ 3.", "Tekst"]
    docs = spark.createDataFrame([("Pierwsze zdanie tekstu. 1219538112535716 Éaielletre. En la des et.",)], "text string")
    assert len(Corpus(docs).sentences_single_line().df.first().sentences) == 2
    assert len(Corpus(docs).sentences_single_line(ascii_words=True).df.first().sentences) == 3


def test_places_of_many_texts(spark):
    """Null, empty and blank texts, spans before, behind and across others, null bounds; and no fold over tokens is interpreted."""
    spans = [(0, 2), (2, 3), (3, 9), (-5, 1), (-9, -2), (7, 7), (90, 99), (None, 4), (1, None), (0, 2_000_000_000)]
    texts = ["Ala ma kota.", None, "", "   ", "  é𝒳 12", "Ala ma kota."]
    want = {0: [0, 0, 1, 0, None, None, None, None, None, 0], 4: [None, 0, 0, None, None, None, None, None, None, 0]}
    df = spark.createDataFrame([(i, t, spans) for i, t in enumerate(texts)], "doc int, text string, spans array<struct<start:int,end:int>>").coalesce(1)
    df = df.select("doc", gold.places_in(F.col("spans"), *gold.token_sizes(F.col("text"))).alias("p"))
    got = {r.doc: r.p for r in df.collect()}
    assert got[0] == got[5] == want[0] and got[4] == want[4] and got[1] is None and got[2] == got[3] == [None] * len(spans)
    from clausecut.plans import queries

    plan = queries.QUERIES["sentence_starts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "Exchange" not in plan
