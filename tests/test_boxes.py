"""Words from characters and tables from ruled lines, against plain versions that look at all of a page."""

import itertools
import random

import pytest

from clausecut.operators import boxes
from clausecut.plans import acquire

CHARS = "page int, char_no int, text string, x0 double, x1 double, top double, bottom double, size double"


def plain_words(chars):
    """One page, character by character."""
    lines, last = [], None
    for c in sorted(chars, key=lambda c: (c[4], c[0])):  # no, text, x0, x1, top, bottom, size
        if last is None or c[4] - last > boxes.Y_GAP:
            lines.append([])
        lines[-1].append(c)
        last = c[4]
    out = []
    for line in lines:
        word, before = [], None
        for c in sorted(line, key=lambda c: (c[2], c[0])):
            if before and (c[2] > before[3] + boxes.X_GAP or before[1].strip() == "" or c[6] != before[6]):
                out.append(word)
                word = []
            if c[1].strip():
                word.append(c)
            before = c
        out.append(word)
    return [("".join(c[1] for c in w), min(c[2] for c in w), min(c[4] for c in w), max(c[3] for c in w), max(c[5] for c in w), w[0][6]) for w in out if w]


def test_words(spark):
    rng = random.Random(3)
    pages = {}
    for page in range(30):
        chars = []
        for k in range(rng.randrange(60)):
            x, y = rng.randrange(60) * 2.5, rng.randrange(12) * 2.0
            chars.append((k, rng.choice("abc d-"), x, x + rng.choice([2.0, 4.0]), y, y + 8, rng.choice([8.0, 8.0, 6.0])))
        pages[page] = chars
    df = spark.createDataFrame([(p, *c) for p, cs in pages.items() for c in cs], CHARS).repartition(4)
    got = {p: [] for p in pages}
    for r in boxes.words(df, ("page",)).orderBy("page", "word_no").collect():
        assert r.word_no == len(got[r.page])
        got[r.page].append((r.text, r.x0, r.top, r.x1, r.bottom, r["size"]))
    assert got == {p: plain_words(cs) for p, cs in pages.items()}
    assert boxes.words(df.limit(0), ("page",)).count() == 0


def plain_tables(rulings):
    """All rectangles between all places, and tables by merging until nothing changes. Rulings on whole tens: nothing is snapped."""
    flat, upright = boxes.edges_of(rulings)
    xs, ys = sorted({x for x, _, _ in upright}), sorted({y for y, _, _ in flat})
    near = boxes.MEET
    corner = {(x, y) for x in xs for y in ys if any(p == y and a - near <= x <= z + near for p, a, z in flat) and any(p == x and a - near <= y <= z + near for p, a, z in upright)}
    side = lambda edges, p, a, z: any(q == p and f - near <= a and z <= t + near for q, f, t in edges)
    found = []
    for x0, y0 in corner:
        for y1, x1 in itertools.product(ys, xs):
            if y1 > y0 and x1 > x0 and {(x1, y0), (x0, y1), (x1, y1)} <= corner and side(flat, y0, x0, x1) and side(flat, y1, x0, x1) and side(upright, x0, y0, y1) and side(upright, x1, y0, y1):
                found.append({(x0, y0), (x1, y0), (x0, y1), (x1, y1)})
                break
    groups = [(set(c), 1) for c in found]
    while True:
        for a, b in itertools.combinations(groups, 2):
            if a[0] & b[0]:
                groups.remove(a)
                groups.remove(b)
                groups.append((a[0] | b[0], a[1] + b[1]))
                break
        else:
            break
    return sorted((min(x for x, _ in g), min(y for _, y in g), max(x for x, _ in g), max(y for _, y in g), n) for g, n in groups if n > 1)


@pytest.mark.parametrize("seed", range(40))
def test_tables(seed):
    rng = random.Random(seed)
    rulings = []
    for _ in range(rng.randrange(1, 16)):
        a, b, c = 10 * rng.randrange(7), 10 * rng.randrange(7), 10 * rng.randrange(1, 6)
        rulings.append(rng.choice([(a, b, a + c, b), (a, b, a, b + c), (a, b, a + c, b + 20)]))
    assert sorted(boxes.tables_of([tuple(map(float, r)) for r in rulings])) == plain_tables(rulings)


def test_lines_that_nearly_meet():
    grid = [(10, 10, 60, 10.8), (61.5, 11.5, 110, 11.5), (9, 40, 110, 40), (10, 70.4, 111, 70.4), (10, 8, 10, 72), (60, 9, 60.6, 71), (110.4, 10, 110.4, 70), (200, 10, 202, 10)]
    (one,) = boxes.tables_of(grid)
    assert one[4] == 4 and [round(v) for v in one[:4]] == [10, 11, 110, 70]
    assert boxes.tables_of([]) == [] and boxes.tables_of([(0, 0, 50, 20)]) == [] and boxes.tables_of([(50, 20, 0, 0), (0, 20, 50, 40)]) == [(0, 0, 50, 40, 2)]
    assert boxes.snapped([1, 2, 3, 9, 1]) == {1: 1.75, 2: 1.75, 3: 1.75, 9: 9}


def test_documents_from_boxes(spark):
    def parser(path, content):
        yield {"kind": "page", "page": 0, "width": 600.0, "height": 800.0}
        no = 0
        for y, line in ((50, "Tekst ustawy"), (110, "w tabeli"), (300, "po tabeli")):
            for i, c in enumerate(line):
                yield {"kind": "char", "page": 0, "no": (no := no + 1), "text": c, "x0": 50.0 + 6 * i, "x1": 56.0 + 6 * i, "top": float(y), "bottom": y + 10.0, "size": 10.0}
        for k, b in enumerate([(40, 100, 240, 100), (40, 130, 240, 130), (40, 160, 240, 160), (40, 100, 40, 160), (240, 100, 240, 160)]):
            yield {"kind": "ruling", "page": 0, "no": k, **dict(zip(("x0", "top", "x1", "bottom"), map(float, b), strict=True))}

    files = spark.createDataFrame([("a", b"x")], "path string, content binary")
    texts, bad = acquire.documents(files, parser, from_boxes=True)
    assert [r.text for r in texts.collect()] == ["Tekst ustawy\n[TABELA]\n\npo tabeli"] and bad.count() == 0
