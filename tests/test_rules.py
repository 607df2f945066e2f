"""Label rules, windows, gold spans, layout and metrics."""

import random

import pytest
from pyspark.sql import functions as F

from clausecut import patterns as P
from clausecut.operators import gold, labels, layout, metrics, tokens, windows
from clausecut.plans.engine import Corpus, silver
from tests import plain


def ends(spark, label, text):
    r = spark.createDataFrame([(text,)], "x string").select(tokens.tokenize(F.col("x")).alias("t")).select("t", label(F.col("t")).alias("l")).first()
    return [i for i, x in enumerate(r.l) if x]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mowa w : 1 ) x yz .", [2, 7]), ("mowa : a ) x", [4]), ("tak : Art x", [1]), ("tak : „ x", [1]), ("tak : – x", [1]), ("tak : Kowalski x", [1]), ("tak : nie x", [3]), ("tak : Ust x", [3]),  # colon
        ("sad ; 2 ) b x", [1]), ("sad , a ) b x", [1]), ("sad ; - ) x", [1]), ("sad ;", [1]), ("sad , x y", [3]),  # comma, semicolon
        (". a b", [0]), ("x . Ab", [2]), ("art . Ab", [2]), ("slowo . 5 ab", [3]), ("slowo . ust x", [3]), ("rok 5 . Ab", [3]), ("rok 5 .", [2]), ("slowo . Ab", [1]), ("koniec ?", [1]),  # stops
        ("a [ TABELA ] b", [0, 3]), ("[ TABELA ]", [2]),  # tables
        ("T E K S T ab R", [6]), ("t e k s t", [4]), ("x )", [1]), ("", []),  # spaced text, fallback
    ],
)
def test_label_lines(spark, text, want):
    assert ends(spark, labels.label_lines, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mowa w : 1 ) x", [2]), ("tak : Kowalski x", [3]), ("sad ; 2 ) b", [1]), ("sad ; a ) b", [4]), ("sad ;", [1]), ("x . Ab", [1]), ("rok 5 . Ab", [2]), ("art . Ab", [2]), ("slowo . 5", []), ("slowo ust", []), ("slowo 7", []),
        ("a b c d e f 5 ) g", [7]), ("a b c d e , 5 ) g", [5]), ("a , b c d e 5 ) g", [7]), ("a 5 ) d", [3]), ("", []),
    ],
)
def test_label_single_line(spark, text, want):
    assert ends(spark, labels.label_single_line, text) == want


@pytest.mark.parametrize(("array_form", "row_form"), [(labels.label_lines, labels.label_rows_lines), (labels.label_single_line, labels.label_rows_single_line)])
def test_forms_agree(spark, array_form, row_form):
    rng = random.Random(1)
    alphabet = [":", ";", ",", ".", "?", ")", "(", "1", "12", "²", "a", "art", "Ust", "Nowak", "nowak", "„", "-", "§", "[", "TABELA", "]"]
    rows = [(k, [rng.choice(alphabet) for _ in range(rng.randrange(1, 14))]) for k in range(600)]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    a = {r.k: r.l for r in df.select("k", array_form(F.col("t")).alias("l")).collect()}
    b = {}
    for r in row_form(tokens.exploded(df, "t", "k"), ("k",)).orderBy("tok_no").collect():
        b.setdefault(r.k, []).append(r.label)
    assert a == b


def test_sentence_windows(spark):
    sentences = [f"Zdanie numer {i} ma slowa." if i != 3 else "" for i in range(23)]
    found = windows.sentence_windows(F.col("s"), (10, 10, 500), tokens.tokenize, labels.label_lines)
    w = spark.createDataFrame([(sentences,), ([],), (["krotkie"],)], "s array<string>").select(found.alias("w")).collect()
    assert [(x.window_no, len(x.tokens), sum(x.sbd_labels)) for x in w[0].w] == [(0, 54, 9), (1, 60, 10), (2, 18, 3)]
    assert w[1].w == w[2].w == []


@pytest.mark.parametrize("n", [1, 174, 175, 176, 350, 351, 1000])
def test_sliding(spark, n):
    df = spark.range(n).select(F.col("id").cast("int").alias("tok_no"))
    got = sorted((r.window_no, r.tok_no) for r in windows.sliding(df, ()).collect())
    assert got == sorted((k, i) for k in range(-(-n // 175)) for i in range(k * 175, min(k * 175 + 350, n)))


def test_pooling_and_sentences(spark):
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate("ab.c")], "doc int, tok_no int, tok string")
    s = spark.createDataFrame([(1, 0, -1.0), (1, 2, 3.0), (1, 2, -1.0), (1, 3, 0.0)], "doc int, tok_no int, logit double")
    p = windows.pooled(t, s, ("doc",))
    assert [(r.logit, r.label) for r in p.orderBy("tok_no").collect()] == [(-1.0, 0), (-999.0, 0), (1.0, 1), (0.0, 0)]
    g = windows.grouped_sentences(p, ("doc",)).orderBy("sent_id").collect()
    assert [(r.sent_id, r.sentence) for r in g] == [(0, "a b."), (1, "c")]


def packed_by_hand(sentences):
    done, now = [], []
    for s in sentences:
        now = now + [0] * (len(s.split()) - 1) + [1] * bool(s.split())
        if len(now) > 450:
            done.append(now)
            now = []
    if 10 <= len(now) <= 450:
        done.append(now)
    elif now and done and len(done[-1]) + len(now) <= 500:
        done[-1] = done[-1] + now
    return done


@pytest.mark.parametrize("sizes", [[200, 200, 100, 5], [451, 9], [460, 40, 3], [5], [10], [], [300, 300, 300, 300, 9], [495, 9], [450, 1, 8]])
def test_gold_packing(spark, sizes):
    sentences = [" ".join(["w"] * n) for n in sizes]
    got = spark.createDataFrame([(sentences,)], "s array<string>").select(gold.packed(F.col("s")).alias("w")).first().w
    assert [list(x.sbd_labels) for x in got] == packed_by_hand(sentences) and [x.window_no for x in got] == list(range(len(got)))


def test_gold_spans(spark, tmp_path):
    text = "Ala ma kota. 𝒳 Drugie zdanie! Koniec"
    tasks = '[{"id":1,"file_upload":"h-act_2021_8_x_clean.txt","data":{"text":"p"},"annotations":[{"result":[{"value":{"start":13,"end":29}},{"value":{"start":0,"end":12}},{"value":{"start":12,"end":13}},{"value":{"start":90,"end":99}}]}]},{"id":2,"file_upload":"act_2021_9","annotations":[]}]'
    (tmp_path / "a.json").write_text(tasks, encoding="utf-8")
    from clausecut.sources import io

    spans = gold.spans(io.annotations(spark, str(tmp_path / "a.json")))
    files = spark.createDataFrame([("d/act_2021_8_x_clean.txt", text), ("d/act_2021_81_x_clean.txt", "other"), ("d/act_2021_8_x_raw.txt", "raw")], "path string, text string")
    found = gold.with_texts(spans, files)
    assert [x.text for x in gold.extracted(found).first().sentences] == ["𝒳 Drugie zdanie!", "Ala ma kota.", " ", ""]
    assert gold.gold_sentences(found).first().sentences == ["Ala ma kota.", "𝒳 Drugie zdanie!"]
    loose = gold.with_texts(spans.select("act_id").distinct(), files, loose=True).collect()
    assert [(r.act_id, r.path) for r in loose] == [("act_2021_8", "d/act_2021_81_x_clean.txt")]
    toks = files.where("path LIKE '%_8_x_clean.txt'").select(F.lit("act_2021_8").alias("act_id"), F.explode(gold.token_offsets(F.col("text"))).alias("t")).select("act_id", "t.*")
    assert [text[r.char_start : r.char_end] for r in toks.collect()] == [r.tok for r in toks.collect()]
    aligned = plain.aligned(spans, toks, ("act_id",))
    assert {r.span_no: r.tok for r in aligned.collect()} == {0: "𝒳", 1: "Ala", 2: None, 3: None}
    assert [r.tok_no for r in gold.sentence_starts(toks, aligned, ("act_id",)).where("is_sent_start").orderBy("tok_no").collect()] == [0, 4]
    report = gold.alignment_report(aligned, found.select("act_id", "text").distinct()).first()
    assert [x.start_token_trigger for x in report.successfully_aligned_sentences] == ["𝒳", "Ala"] and report.failed_alignments_chars == [[12, 13], [90, 99]]
    assert gold.missing(spark.createDataFrame([("act_2021_8",), ("act_2021_9",)], "act_id string"), files).first().act_id == "act_2021_9"
    flat = spark.createDataFrame([(("in",), "out"), (None, "out"), (None, None)], "data struct<text:string>, text string")
    assert [r.x for r in flat.select(gold.task_text(flat).alias("x")).collect()] == ["in", "out", ""]


PAGE = ("page",)


def page(spark, words, tables=(), lines=(), height=700.0):
    w = spark.createDataFrame([(1, i, *x) for i, x in enumerate(words)], "page int, word_no int, text string, x0 double, top double, bottom double, size double")
    t = spark.createDataFrame([(1, i, *x) for i, x in enumerate(tables)], "page int, table_no int, x0 double, top double, x1 double, bottom double")
    n = spark.createDataFrame([(1, i, *x) for i, x in enumerate(lines)], "page int, line_no int, x0 double, x1 double, top double")
    p = spark.createDataFrame([(1, 600.0, height), (2, 600.0, height)], "page int, width double, height double")
    return {r.page: r.text for r in layout.assembled(p, w, t, n, PAGE).collect()}


def test_layout(spark):
    line = lambda text, y, size=10.0, x=0.0, up=0.0: (text, x, y - up, y + 10.0 - up, size)
    got = page(spark, [line("Ala", 10.0), line("ma", 10.0), line("2)", 10.0, 6.0, up=4.0), line("przy-", 30.0), line("kład", 50.0), line("dalej", 50.0), line("koniec", 70.0)])
    assert got == {1: "Ala ma\nprzy kład dalej\nkoniec", 2: ""}
    table = [(100.0, 25.0, 300.0, 45.0)]
    got = page(spark, [line("przed", 10.0), line("w", 30.0, x=150.0), line("tabeli", 35.0, x=200.0), line("po", 70.0), line("niej", 70.0)], table)
    assert got[1] == "przed\n[TABELA]\n\npo niej"
    got = page(spark, [line("przed", 10.0), line("w", 30.0, x=150.0), line("po", 48.0)], table)
    assert got[1] == "przed\n[TABELA]\npo"


def test_footnotes(spark):
    body, note = ("tekst", 0.0, 10.0, 20.0, 10.0), ("1) przypis", 0.0, 600.0, 610.0, 6.0)
    assert page(spark, [body, body, note])[1] == "tekst tekst"
    assert page(spark, [body, body, ("przypis", *note[1:])])[1] == "tekst tekst\nprzypis"
    assert page(spark, [body, ("stopka", 0.0, 668.0, 678.0, 10.0)])[1] == "tekst"
    assert page(spark, [body, ("nizej", 0.0, 520.0, 530.0, 10.0)], lines=[(0.0, 300.0, 495.0), (0.0, 100.0, 510.0)])[1] == "tekst"


def test_upper_median(spark):
    assert [spark.createDataFrame([(x,)], "x array<double>").select(layout.upper_median(F.col("x"))).first()[0] for x in ([1.0, 2.0, 3.0, 4.0], [5.0], [3.0, 1.0, 2.0])] == [3.0, 5.0, 2.0]


def test_parsed(spark):
    def parser(path, content):
        if content == b"bad":
            raise ValueError("broken")
        return [{"page": k, "text": content.decode()} for k in range(2)]

    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"bad"))], "path string, content binary")
    assert sorted(map(tuple, layout.parsed(files, parser, "page long, text string").collect()), key=str) == [("a", None, 0, "x"), ("a", None, 1, "x"), ("b", "ValueError: broken", None, None)]


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, -100), (1, 1)], "prediction int, label int")
    r = metrics.prf(rows).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and (r.precision, r.recall, r.f1) == (pytest.approx(2 / 3),) * 3
    z = metrics.prf(rows.where("label = 0 AND prediction = 0")).first()
    assert (z.precision, z.recall, z.f1) == (0.0, 0.0, 0.0)
    al = spark.createDataFrame([([None, 0, 0, 1, None, 2, 2, 0, None], [1, 0, 1])], "w array<int>, l array<int>").select(metrics.align_labels(F.col("w"), F.col("l"))).first()[0]
    assert al == [-100, 1, -100, 0, -100, 1, -100, 1, -100]
    w = spark.createDataFrame([(["a", "b"], [0, 1]), (["c"], [1])], "tokens array<string>, sbd_labels array<int>")
    s = metrics.window_stats(w)
    assert tuple(s.first())[:3] == (2, 3, 2) and s.select(metrics.stats_line(F.lit("Train"))).first()[0] == "  Train: 2 windows | 3 tokens | 2 sentence boundaries (66.7%)"
    assert metrics.window_stats(w.limit(0)).first().ratio == 0.0
    assert [tuple(x) for x in spark.createDataFrame([([1, 0, 1], [1, 1])], "p array<int>, l array<int>").select(metrics.zipped(F.col("p"), F.col("l"))).first()[0]] == [(1, 1), (0, 1)]
    assert spark.range(2).select(metrics.label_name(F.col("id").cast("int"))).collect()[1][0] == P.LABELS[1]


def test_corpus(spark):
    text = "USTAWA\nz dnia 5 maja 2020 r.\no czymś\nArt. 1.\n1. Ustawa określa:\n1) zasady;\n2) tryb.\nArt. 2. Traci moc art. 5 ustawy. Koniec zdania i tekstu."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc long, text string")
    by_line = Corpus(docs).sentences_by_line()
    assert by_line.df.where("doc = 1").first().sentences[0] == "USTAWA z dnia 5 maja 2020 r. o czymś"
    for single in (False, True):
        w = silver(docs, single).collect()
        assert [r.doc for r in w] == [1] and len(w[0].tokens) == len(w[0].sbd_labels) and sum(w[0].sbd_labels) > 2
    assert Corpus(docs).sentences_single_line().short_segments("doc").count() >= 0
    assert by_line.windows_by_line().stats().first().n_windows == 1
