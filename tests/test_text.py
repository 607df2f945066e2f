"""Cleaning, tokens and splitting, on cases worked out by hand."""

import pytest
import regex
from pyspark.sql import functions as F

from clausecut import patterns as P
from clausecut.functions import text as T
from clausecut.operators import clean, punkt, segment, tokens


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [(" \t a b \x1c\n", "a b"), ("", ""), ("  x ", "x"), (None, None)])
def test_strip(spark, raw, want):
    assert one(spark, T.strip, raw) == want


@pytest.mark.parametrize("x", ["5", "²", "٣", "①", "12", "1²", "x", "", "½", "-1", "IV"])
def test_is_digit(spark, x):
    assert one(spark, T.is_digit, x) == x.isdigit()


@pytest.mark.parametrize("x", ["a\nb", "a\r\nb\n", "a\x0bb\x0cc\x1cd\x85e f ", "\n\n", "", "a\n\n", "\r\r\n\n"])
def test_lines(spark, x):
    assert one(spark, T.lines, x) == (x.splitlines() or [""])


def test_let_binds_once(spark):
    assert one(spark, lambda x: T.let(F.split(x, ","), lambda a: F.transform(a, lambda y, i: F.concat(y, F.size(a).cast("string")))), "a,b") == ["a2", "b2"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("DZIENNIK USTAW RZECZYPOSPOLITEJ POLSKIEJ Warszawa, dnia 5 maja 2020 r. Poz. 12 Tekst", "Tekst"),
        ("Dziennik Ustaw – 2 – Poz. 818\nTekst", "Tekst"),
        ("Dziennik Ustaw Poz. 5\nA\n\n\n\nB\nPoz. 7\nC  \t D", "A\n\nB\n\nC D"),
        ("x Poz. 7", "x Poz. 7"),
        (None, ""),
    ],
)
def test_clean_page(spark, raw, want):
    assert one(spark, clean.clean_page, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("przy-\n kład", "przykład"), ("foo - bar", "foo bar"), ("A-\nB", "A-\nB"), ("wy- łącz", "wyłącz"), ("a-b", "a-b")])
def test_hyphens(spark, raw, want):
    assert one(spark, clean.fix_hyphens, raw) == want


def test_join_pages(spark):
    assert one(spark, clean.join_pages, ["a\n\n \n\nb-", "", None, "c "], "array<string>") == "a\n\nbc"


def test_preprocess(spark):
    assert one(spark, clean.preprocess, "a...b\n\n\n c \t d …… e \r\nf\n") == "a ... b\nc d …… e\nf"


def test_remove_headers(spark):
    assert one(spark, clean.single_line, "DZIENNIK USTAW\nnr 1 z 2019 r. Tekst USTAWA z dnia 5 maja 2019 r. dalej") == " Tekst  dalej"


def test_names(spark):
    assert one(spark, clean.file_title, ' a/b:c*d?"e<f>g|h ' + "x" * 60) == "abcdefgh " + "x" * 30
    assert one(spark, clean.file_title, None) == P.NO_TITLE
    assert one(spark, clean.act_id, "/d/act_2021_818_Tytul_clean.txt") == "act_2021_818"
    assert one(spark, clean.act_id, "/act_1_2/none.txt") == ""
    assert one(spark, clean.stem, "/d/act_1_2_x_clean.txt") == "act_1_2_x"
    assert one(spark, lambda x: clean.act_name(F.lit(2020), F.lit(7), x), "T: a") == "act_2020_7_T a"
    assert one(spark, lambda x: clean.act_url(F.lit(2020), x), "7").endswith("/2020/7/text.pdf")


@pytest.mark.parametrize(("raw", "want"), [(["a", ",", "(", "b", ")", "."], "a, (b)."), (["(", "(", "x", "]", "%"], "((x]%"), ([], ""), (["„", "a", "”"], "„ a ”")])
def test_detokenize(spark, raw, want):
    assert one(spark, clean.detokenize, raw, "array<string>") == want


@pytest.mark.parametrize("x", ["Art. 5 ust. 2a", "ó m² 10 000,5", "𝒳😀—a_b", "", "żółć ĄĘ٣"])
def test_tokenize(spark, x):
    assert one(spark, tokens.tokenize, x) == regex.findall(r"\p{L}+|\d+|[^\s\p{L}\d]", x)


def test_tokenize_with_terms(spark):
    assert one(spark, tokens.tokenize_with_terms, "Zob. Dz. U. nr 5, m.in. art. 3 cart. x") == ["Zob", ".", "Dz. U.", "nr", "5", ",", "m.in.", "art.", "3", "cart", ".", "x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Zob. art. 5 ust. 2. Koniec? Tak! I co", ["Zob.", "art. 5 ust. 2.", "Koniec?", "Tak!", "I co"]),
        ("Poz. 1. ustawy. Dnia 5. Maja", ["Poz. 1. ustawy.", "Dnia 5.", "Maja"]),
        ("Jan K. Nowak i K. 5 osób", ["Jan K. Nowak i K.", "5 osób"]),
        ("Tak (koniec.) Dalej... i dalej", ["Tak (koniec.)", "Dalej... i dalej"]),
        ("  ", []),
        ("jeden", ["jeden"]),
    ],
)
def test_punkt(spark, raw, want):
    assert one(spark, lambda x: punkt.sentences(x, P.TERMS), raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Tekst. Na podstawie art. 5 zarządza się, co następuje", ["Tekst.", "Na podstawie art. 5 zarządza się, co następuje"]),
        ("Tekst.  uchwala się; ZARZĄDZA   SIĘ dalej", ["Tekst.  uchwala się;", "ZARZĄDZA   SIĘ dalej"]),
        ("na podstawie art. 5", ["na podstawie art. 5"]),
        ("bez granicy na podstawie", ["bez granicy na podstawie"]),
    ],
)
def test_early_body(spark, raw, want):
    assert one(spark, segment.early_body_split, raw) == want


def test_split_lines(spark):
    assert one(spark, segment.split_lines, "Art. 1.\nTekst. Drugi [SPLIT_MARKER] trzeci\n\nczwarty") == ["Art. 1.", "Tekst.", "Drugi", "trzeci", "czwarty"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (["a", ";", "Zdanie pierwsze", "”;", "(uchylony)", ".", "zm.", "…", "2019, str. 5", "z późn.", "z poźn."], ["Zdanie pierwsze ”; .", "z późn."]),
        ([".", "ab"], ["ab"]),
        ([], []),
    ],
)
def test_clean_segments(spark, raw, want):
    assert one(spark, segment.clean_segments, raw, "array<string>") == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (["Art. 64.", "1.", "W przypadku..."], ["Art. 64. 1. W przypadku..."]),
        (["1 )", "grozbie uzycia..."], ["1 ) grozbie uzycia..."]),
        (["a )", "Art. 3.", "§ 5. 1.", "tekst", "2a."], ["a ) Art. 3.", "§ 5. 1. tekst", "2a."]),
        (["zm.", "tekst"], ["tekst"]),
        ([], []),
    ],
)
def test_merge_header_pairs(spark, raw, want):
    assert one(spark, segment.merge_header_pairs, raw, "array<string>") == want


@pytest.mark.parametrize("shape", ["Art. 3.", "Art. 3. 1.", "§ 5. 1.", "§ 4 a .", "Art . 354 a .", "8. 1.", "8b. 1.", "1.", "2a.", "1 )", "a )"])
def test_header_shapes(spark, shape):
    assert one(spark, lambda x: x.rlike(P.HEADER_SINGLE_LINE), shape)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (["Art. 1.", "1.", "Wniosek"], ["Art. 1.", "1. Wniosek"]),
        (["1.", "Tekst"], ["1. Tekst"]),
        (["1.", "2 ) punkt", "x"], ["1. 2 ) punkt", "x"]),
        (["a )", "Art. 2.", "x"], ["a )", "Art. 2. x"]),
        (["Art. 2.", "„cytat”"], ["Art. 2.", "„cytat”"]),
        (["Art. 2 . a bardzo długi nagłówek art. 5.", "„cytat”"], ["Art. 2 . a bardzo długi nagłówek art. 5. „cytat”"]),
        (["1 stycznia.", "Tekst"], ["1 stycznia. Tekst"]),
        (["Art. 9."], ["Art. 9."]),
        (["DZIENNIK USTAW", "z dnia 5", "2018 r.", "Tekst"], ["DZIENNIK USTAW z dnia 5 2018 r.", "Tekst"]),
        (["DZIENNIK USTAW", "bez roku", "Tekst"], ["DZIENNIK USTAW bez roku Tekst", "bez roku", "Tekst"]),
        (["USTAWA", "z dnia 1 maja", "o czymś", "Art. 1.", "Tekst"], ["USTAWA z dnia 1 maja o czymś", "Art. 1. Tekst"]),
        (["Ustawa wchodzi w życie.", "Dalej"], ["Ustawa wchodzi w życie. Dalej"]),
        (["Załącznik do ustawy", "USTAWA", "o czymś", "Rozdział 1"], ["Załącznik do ustawy", "USTAWA o czymś", "Rozdział 1"]),
        ([], []),
    ],
)
def test_merge_headers(spark, raw, want):
    assert segment.HeaderMerger(raw).run() == want
    assert one(spark, segment.merge_headers, raw, "array<string>") == want


def test_merge_headers_strict():
    assert segment.HeaderMerger(["DZIENNIK USTAW", "bez roku", "Tekst"], strict=True).run() == ["DZIENNIK USTAW bez roku Tekst"]


def test_text_is_cut_as_a_whole_as_token_by_token(spark, monkeypatch):
    """Odd texts give the sentences and segments of the walk over tokens, and no lambda runs over a line's tokens."""
    import random

    from pyspark.sql import functions as F

    from clausecut import patterns as P
    from clausecut.operators import punkt, segment

    r = random.Random(8)
    words = ["art", "ART", "ust", "Kt", "5-u", "12", "1.2", "-3", "a", "Ż", "ala", "Ala", "PÓŹN", "zm", "[SPLIT_MARKER]", "na podstawie", "Na  podstawie", "ogłasza\tsię", "\U0001d400", "ſtr", "İ", "x-art", "\x1f"]
    marks = ["."] * 4 + ["..", "...", "…", "?", "!", ";", ":", ",", ")", "(", '"', "”", "„", "»", "]", "[", "-"]
    blanks = [" "] * 3 + ["  ", "\t", "\n", "\n\n", "\r\n", "\r", "\x0b", "\x85", " ", "\xa0", ""]
    texts = ["".join(r.choice(r.choice((words, marks, marks, blanks, blanks))) for _ in range(r.randrange(28))) for _ in range(4000)]
    rows = spark.createDataFrame([*((t if i % 9 else t + "\x1d" + t,) for i, t in enumerate(texts)), (None,), ("",), ("\n",)], "t string")
    x = F.col("t")
    new = rows.select("t", punkt.sentences(x, P.TERMS).alias("s"), segment.split_lines(x).alias("l"))
    got = {q.t: (q.s, q.l) for q in new.collect()}
    monkeypatch.setattr(punkt, "sentences", punkt._by_token)
    want = {q.t: (q.s, q.l) for q in rows.select("t", punkt._by_token(x, P.TERMS).alias("s"), segment._split_each_line(x, P.TERMS).alias("l")).collect()}
    assert got == want and sum(len(s) > 1 for s, _ in got.values() if s) > 500


def test_short_segments_are_matched_once():
    from clausecut.operators import segment

    segment._found_short.cache_clear()
    for _ in range(50):
        assert segment.cleaned(["Art. 5.", "zm.", " ; ", "Tekst"]) == ["Art. 5. ;", "Tekst"]
        assert segment.HeaderMerger(["Art. 5.", "Tekst", "x" * 300]).run() == ["Art. 5. Tekst", "x" * 300]
    assert segment._found_short.cache_info().misses < 30 and segment._found_short.cache_info().maxsize == segment.MOST


def test_labels_in_batches(spark, sf):
    """The rules over whole batches give what the rules over arrays give, and the queries' tokens are not shuffled."""
    import random

    from pyspark.sql import functions as F

    from clausecut.operators import labels
    from clausecut.plans import queries as Q

    r = random.Random(4)
    words = ["art", "Art", "ust", "PÓŹN", "m", "x", "Ż", "ala", "Ala", "12", "٣", "²", "①", "ǅa", "ª", "中", "\U0001d400", "İ", "tabela", "TABELA", *":;,.?!()[]§„\"’-–—", ")", ".", ":", ",", ";", "7"]
    lists = [[r.choice(words) for _ in range(r.choice((0, 1, 2, 5, 6, 8, 13)))] for _ in range(5000)]
    rows = spark.createDataFrame([(x,) for x in [*lists, None]], "t array<string>")
    for single, rule in ((False, labels.label_lines), (True, labels.label_single_line)):
        both = rows.withColumn("a", labels.in_batches(single)(F.col("t"))).withColumn("b", rule(F.col("t"))).collect()
        assert len(both) == 5001 and [q for q in both if q.a != q.b] == []
    for name in ("sentence_ends_lines", "sentence_ends_single_line"):
        assert "Exchange" not in Q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
