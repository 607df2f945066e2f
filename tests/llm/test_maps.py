"""Operators that look at one row at a time."""

import random
import re

import pytest

from clausecut.llm import html_extract, pii, quality, secrets
from clausecut.llm import queries as Q
from clausecut.llm.secrets import ANY, trigram_query
from tests.llm import brute


def test_pii_base(docs, rows):
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    for i, t, *_ in rows:
        n, sha = brute.pii(t)
        assert ({k: got[i][f"n_{k}"] for k in n}, got[i].base_sha256) == (n, sha), t


def test_pii_more(spark):
    texts = ["pay to iban GB82 WEST 1234 5698 7654 32 now", "pay to iban GB82 WEST 1234 5698 7654 33 now", "ssn 123-45-6789", "number 123-45-6789", "𝒳 a@b.cc"]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = [[(s.kind, t[s.start : s.end]) for s in r.pii] for r, t in zip(rows, texts, strict=True)]
    assert found == [[("iban", "GB82 WEST 1234 5698 7654 32")], [], [("national", "123-45-6789")], [], [("email", "a@b.cc")]]
    red = [r.text for r in pii.redact(spark.createDataFrame([(1, "𝒳 a@b.cc, c@d.ee!"), (2, None)], "doc_id long, text string")).collect()]
    assert red == ["𝒳 <email>, <email>!", ""]


def test_ibans(spark):
    good = {
        "to DE89370400440532013000 Bitte zahlen": "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32 AND more": "GB82 WEST 1234 5698 7654 32", "AT61 1904 3002 3457 3201 BANK": "AT61 1904 3002 3457 3201",
        "MT84 MALT 0110 0001 2345 MTLC AST0 01S x": "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "NO93 8601 1117 947 OSLO": "NO93 8601 1117 947", "GB82WEST12345698765432.": "GB82WEST12345698765432",
    }
    bad = ["DE89370400440532013001 Bitte", "XGB82WEST12345698765432", "AT61 1904 3002 3457 3202"]
    rows = pii.find(spark.createDataFrame(list(enumerate([*good, *bad])), "i long, text string")).orderBy("i").collect()
    assert [[s.match for s in r.pii] for r in rows] == [[m] for m in good.values()] + [[]] * len(bad)


def test_surroundings_are_seen_over_the_edges_of_parts(spark):
    texts = ["x" * n + " ssn 123-45-6789 " + "y" * 3000 + " 123-45-6789 " + "z" * n + "123-45-6789 " + "z" * 30 + " ssn" for n in range(990, 1040, 3)]
    rows = pii.find(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [[s.start for s in r.pii] for r in rows] == [[t.index("123-"), t.rindex("123-")] for t in texts]


def test_many_spans(spark):
    """Also in time that grows with the spans, not with their square."""
    import time

    seconds = []
    for n in (4000, 32000):
        text = "x a@b.c " * n
        df, begun = spark.createDataFrame([(1, text)], "doc_id long, text string"), time.perf_counter()
        r = pii.digest(df).collect()[0]
        seconds.append(time.perf_counter() - begun)
        assert (r.n_email, r.base_sha256) == (n, brute.pii(text)[1])
    assert seconds[1] < 20 * max(seconds[0], 1)


def test_secrets_base(docs, rows):
    got = {r.doc_id: r for r in secrets.digest(docs).collect()}
    for i, t, *_ in rows:
        n, sha = brute.secrets(t)
        assert ((got[i].n_assign, got[i].n_access, got[i].n_hex), got[i].base_sha256) == (n, sha), t
    assert any("private_key" in r.spans for r in got.values())


def test_trigram_queries():
    assert trigram_query("abcd") == {frozenset({"abc", "bcd"})}
    assert trigram_query("abc|xyz") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert trigram_query("abc?") == ANY
    assert trigram_query("[0-9]+") == ANY
    assert trigram_query("Foo(?:bar)+[0-9]") == {frozenset({"foo", "bar"})}
    assert trigram_query("ab?cde") == {frozenset({"abc", "bcd", "cde"}), frozenset({"acd", "cde"})}


def test_maps_edges(none, odd):
    for f in (pii.digest, secrets.digest):
        assert f(none).collect() == []
        assert len(f(odd).collect()) == 5
    assert quality.judged(none).collect() == []
    assert len(quality.judged(odd).collect()) == 5
    assert quality.accepted(odd).columns == odd.columns


def test_quality(docs, rows):
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    for i, t, *_ in rows:
        want = brute.quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_ledger(docs):
    rows = quality.ledger(docs).select("failure_bits", "m", quality.failed_rules().alias("names")).cache()
    bits = [r.failure_bits for r in rows.collect()]
    assert all(sum(quality.BITS[n] for n in r.names) == r.failure_bits for r in rows.collect())
    for r in quality.ablations(rows).collect():
        b = quality.BITS[r.rule]
        assert r.n_failed == sum(bool(x & b) for x in bits) and r.n_failed_alone == sum(x == b for x in bits)
        assert r.n_kept == sum(x == 0 for x in bits) and r.n_kept_without == sum((x & ~b) == 0 for x in bits)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies to make this site better for you, and for us.</p></div><div class="ad">Buy now.</div>
<article><header><h1>A title</h1></header><p><b>First &amp; long   paragraph of the text,<br>with a break, that goes on and on.<p>Short.</p><p>Second paragraph of the text with &lt;tags&gt; &copy and more words.</p>
<form><label>Name</label><input></form></article><aside class="sidebar"><p>Related stories that you may like to read next week.</p></aside>
<div id="comments"><p>I think that this was a very good article and I liked it a lot.</p></div><footer>&copy; 2020 Site, all rights reserved.</footer></body></html>"""


def test_main_text():
    want = "A title\nFirst & long paragraph of the text, with a break, that goes on and on.\nShort.\nSecond paragraph of the text with <tags> © and more words."
    assert html_extract.main_text(PAGE) == want
    assert html_extract.main_text(PAGE[: PAGE.index("</article>")]) == want
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav><a>x</a></nav>") == ""
    assert html_extract.main_text("<p>Just one paragraph, without any markup around it") == "Just one paragraph, without any markup around it"
    for cut in range(0, len(PAGE), 7):
        html_extract.main_text(PAGE[:cut])


LONG = "<p>First long paragraph of the text that goes on and on for a while, with words.</p><p>Second paragraph of the text, just as long as the first one was, and more.</p>"
HELD = re.sub("<[^>]*>", "\n", LONG).strip().replace("\n\n", "\n")


@pytest.mark.parametrize("page", [
    f'<html><body><div class="wrap has-sidebar"><article>{LONG}</article></div></body></html>', f'<div id="content" class="content with-sidebar">{LONG}</div>', f"<head><title>x</title>{LONG}",
    f"<body><div><button>Menu</div><article>{LONG}</article>", f"<body><button>Menu<article>{LONG}</article><button>Other</button>", f"<body><svg><path d='x'><article>{LONG}</article>", f"<body><svg><path d='x'>{LONG}<svg></svg>",
    f'{LONG}<div style="display: none"><p>You can not see this paragraph of text, which is as long as the others.</p></div><p hidden>Nor this one, that is hidden as well and long enough.</p>',
    f'<div class="no-footer entry-content">{LONG}</div><div class="site-footer"><p>The text below a page that is about the site and goes on for some time, too.</p></div>',
])
def test_articles_that_are_easily_lost(page):
    assert html_extract.main_text(page) == HELD


def test_an_article_keeps_its_headline():
    assert html_extract.main_text(f'<article><header class="entry-header"><h1>Head line here</h1></header>{LONG}</article>') == "Head line here\n" + HELD


SENTENCE = "This sentence has more than twenty words in it, so that by its length alone it looks just like a part of the article itself."
NESTED = [f"<{t}>{{}}</{t}>" for t in ("aside", "nav", "form", "footer")] + [f'<div class="{c}">{{}}</div>' for c in ("related", "newsletter", "sidebar", "ad", "cookie-notice", "share-box", "promo")] + ['<section class="comments">{}</section>', '<div role="navigation">{}</div>', '<div id="comments"><article class="comment">{}</article></div>']


@pytest.mark.parametrize("around", ["article", "main", 'div id="content"'])
@pytest.mark.parametrize("nested", [*NESTED, "<header>{}</header>"])
def test_boilerplate_in_an_article(around, nested):
    """Whatever is around a menu, a notice or a form, and however long its sentences are. Only an article's own header is its own."""
    if around == "article" and "header" in nested:
        return
    end = around.split()[0]
    for inner in (SENTENCE, f"<p>{SENTENCE}</p>", f"<p>{SENTENCE}</p><p>{SENTENCE}</p>"):
        part = nested.format(inner)
        assert html_extract.main_text(f"<body><{around}>{LONG}{part}</{end}></body>") == HELD
        assert html_extract.main_text(f"<body><{around}>{part}{LONG}{part}{LONG}</{end}></body>") == f"{HELD}\n{HELD}"
        assert html_extract.main_text(f"<body><{around}><p>{SENTENCE}</p>{part}</{end}></body>") == SENTENCE


@pytest.mark.parametrize("wrapper", ['form id="aspnetForm"', 'div class="side"', 'div class="overlay"', 'div class="share"', 'div class="recommendations-report"', 'div id="comments-on-the-law"', 'fieldset', 'div class="advert-free"'])
@pytest.mark.parametrize("inner", ['<div id="content">{}</div>', "<article>{}</article>", "<main>{}</main>", "{}", '<nav><a href="/">Home</a></nav><div class="content">{}</div><footer>All about us and more.</footer>'])
def test_wrappers_of_whole_pages(wrapper, inner):
    end = wrapper.split()[0]
    assert html_extract.main_text(f"<body><{wrapper}>{inner.format(LONG)}</{end}></body>") == HELD


@pytest.mark.parametrize("many", [1, 20, 60, 200])
@pytest.mark.parametrize("letter", ["İ", "I", "ſ", "K"])
def test_letters_whose_lower_case_is_longer(many, letter):
    page = f"<body><article><p>{letter * many} begins the first paragraph.</p><SCRIPT>var x = 1;</Script><button>No</button>{LONG}<style>p {{}}</style></article>"
    assert html_extract.main_text(page) == f"{letter * many} begins the first paragraph.\n{HELD}"


def test_headlines():
    assert html_extract.main_text(f"<main><header><h1>The headline of it</h1><p>{SENTENCE}</p></header>{LONG}</main>") == f"The headline of it\n{HELD}"
    assert html_extract.main_text(f"<header><h1>A site</h1><p>{SENTENCE}</p></header><main>{LONG}</main>") == HELD
    assert html_extract.main_text(f"<nav><ul><li><a href='/'>Home</a></li></ul><article>{LONG}</article>") == HELD  # a menu that never ends
    assert html_extract.main_text(f"<div class='comments'><article><p>{SENTENCE}</p></article></div><article>{LONG}</article>") == HELD


def test_extraction_of_whole_pages(spark, sf):
    """Against the text of each page's article, which knows nothing of scores and cuts."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in Q.op2_html_extract(spark, sf).collect()}
    assert got == {i: brute.article_text(t) for i, t in pages.items()}


def test_minimum_cut():
    """Against all labellings."""
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(2, 8)
        scores = [rng.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(n)]
        edges = [(i, j, rng.choice([0.3, 0.8, 1.5])) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side, scores=scores, edges=edges):
            return sum(max(s, 0) * (not x) + max(-s, 0) * x for s, x in zip(scores, side, strict=True)) + sum(c for i, j, c in edges if side[i] != side[j])

        least = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(html_extract.content_side(scores, edges)) == pytest.approx(least)


def test_extracted(spark, none):
    pages = spark.createDataFrame([(1, "u", PAGE, "extra"), (2, "v", None, "x"), (2, "v", None, "x")], "page_id long, url string, html string, text string")
    out = html_extract.extracted(pages).collect()
    assert [r.n_chars for r in out] == [len(html_extract.main_text(PAGE)), 0, 0]
    assert html_extract.extracted(pages.limit(0)).collect() == []


def test_secrets_of_rows_without_an_id(spark):
    text = "password = 'hunter2hunter' AKIA" + "A1" * 10 + " -----BEGIN RSA PRIVATE KEY-----"
    df = spark.createDataFrame([(None, text), (1, text), (None, "nothing")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_assign, r.n_access, r.spans) for r in secrets.digest(df).collect())
    assert [r[:3] for r in got] == [(0, 0, 0), (0, 1, 1), (1, 1, 1)]
    assert got[0][3] == "" and got[1][3] == got[2][3] and got[1][3].count(",") == 2


def test_secrets_of_rows_with_names_for_ids(spark):
    text = "password = 'hunter2hunter' AKIA" + "A1" * 10
    got = secrets.digest(spark.createDataFrame([("x", text), ("y", "nothing"), (None, text)], "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.n_assign, r.n_access) for r in got) == [("", 1, 1), ("x", 1, 1), ("y", 0, 0)]
