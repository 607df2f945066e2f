"""Main text of HTML pages by minimum-cut labelling.

A page is cut in blocks of text at block-level tags. A small linear classifier gives each block a score from its tags,
the names of its classes and ids, its links, its length and punctuation; a positive score is the capacity from the
source (content), a negative one that to the sink (boilerplate). Blocks next to each other are joined by a smoothness
edge, and blocks next to each other under one parent by a stronger one. Max-flow (Dinic) separates content from the rest
at the least total cost.

Pages are independent: one map in Arrow batches, no shuffle. Memory is that of a batch and one page's blocks.

A null page is an empty page; a page without content gives an empty text. Broken markup (unclosed tags, a page cut
anywhere) is read as browsers read it, as far as text goes. Repeated rows give repeated rows; ids, null too, are passed on
unread. A very long page is one page's blocks in one worker; its cut takes time by its blocks and edges.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Tags without content of their own.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags whose content is no text of the page.
SILENT = frozenset("script style head title noscript template svg math iframe object textarea canvas audio video select button".split())
#: Of these, tags whose content has no markup.
RAW = frozenset("script style title textarea iframe noscript".split())
#: Tags that end an open paragraph.
ENDS_P = BLOCKS - {"body", "html", "option", "optgroup", "legend"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FOR = frozenset("article main".split())
#: Tags and roles that speak against all that is in them, and those that do unless most of the page is in them.
AGAINST = frozenset("nav footer aside menu dialog search".split())
WEAKLY_AGAINST = frozenset("form fieldset select dir".split())
AGAINST_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar".split())
#: Names (classes and ids) that do so when they stand alone; words that do so weakly, alone or in a longer name; words for a block.
AGAINST_NAMES = frozenset(
    "nav navbar navigation menu footer header masthead sidebar ad ads banner cookie cookies gdpr comment comments commentlist disqus replies respond related breadcrumb breadcrumbs newsletter toolbar "
    "pagination pager copyright hidden".split()
)
AGAINST_WORDS = AGAINST_NAMES | frozenset("foot side consent notice notices popup modal overlay share sharing social subscribe signup login alert".split())
AGAINST_STEMS = ("advert", "promo", "sponsor", "recommend", "widget")
FOR_WORDS = frozenset("article content post entry story main text body".split())
#: Words that, before another one, say nothing of the block itself.
OF_OTHERS = frozenset("has have with without no not is js hide show".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[_-]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HIDDEN = re.compile(r"""(?:^|[\s"'])hidden(?=$|[\s=/])""", re.I)
#: Tags that a head may hold; any other ends it.
IN_HEAD = frozenset("title meta link base script style noscript template".split())
#: Silent tags that do not nest in themselves: another one, or the end of what they stand in, ends them.
NO_NESTING = frozenset("button select audio video canvas".split())

#: Where silent tags end, and where those begin that do not nest. Only ASCII letters have two cases here.
ENDS = {t: re.compile(f"</{t}", re.A | re.I) for t in SILENT}
BEGINS = {t: re.compile(f"<{t}", re.A | re.I) for t in NO_NESTING}

#: The classifier's weights, and the strength of the two kinds of edges.
WEIGHTS = {"against": -6.0, "for": 3.0, "p": 1.0, "heading": 0.5, "item": -0.5, "words": 2.0, "short": -1.0, "links": -4.0, "stop": 0.5, "rights": -2.0}
ADJACENT, SIBLING = 0.4, 0.8
#: What a box (an open block tag) says of what is in it.
NOTHING, WEAK, STRONG, UNSEEN_BOX = range(4)


def evidence(names: str) -> tuple[int, bool]:
    """How class names or an id speak against a block (NOTHING, WEAK or STRONG), and whether for it.

    Each name counts by itself. has-sidebar or no-nav say what is beside the block, and an article's own header or a name
    of the content that stands alone outweighs names joined from words.
    """
    whole, joined, pro = NOTHING, False, False
    for name in names.lower().split():
        parts = [x for x in PARTS.split(name) if x]
        if not parts or len(parts) > 1 and parts[0] in OF_OTHERS:
            continue
        bad = [x for x in parts if x in AGAINST_WORDS or x.startswith(AGAINST_STEMS)]
        good = any(x in FOR_WORDS for x in parts)
        if good and bad == ["header"]:
            bad = []
        if len(parts) == 1 and bad:
            whole = max(whole, STRONG if name in AGAINST_NAMES else WEAK)
        joined |= len(parts) > 1 and bool(bad)
        pro |= good and not bad and (len(parts) == 1 or not joined)
    alone = any(x in FOR_WORDS for x in names.lower().split())
    return whole or (WEAK if joined and not alone else NOTHING), pro


class Box(NamedTuple):
    """An open block tag: the number of the box around it, its tag, what it says against its content, and for it."""

    parent: int
    tag: str
    bad: int
    good: float


class Block:
    __slots__ = ("against", "box", "container", "links", "pro", "tag", "text")

    def __init__(self, text: str, tag: str, container: int, box: int, links: int):
        self.text, self.tag, self.container, self.box, self.links, self.against, self.pro = text, tag, container, box, links, 0.0, 0.0


def box_of(parent: int, tag: str, attributes: str) -> Box:
    bad = STRONG if tag in AGAINST else WEAK if tag in WEAKLY_AGAINST else NOTHING
    good = 1.0 if tag in FOR else 0.0
    if attributes:
        if HIDDEN.search(attributes):
            bad = UNSEEN_BOX
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            kind, value = name.lower(), a or b or c
            if kind == "role":
                role = value.lower()
                if role in AGAINST_ROLES:
                    bad = max(bad, STRONG)
                elif role == "form":
                    bad = max(bad, WEAK)
                elif role in FOR:
                    tag, good = role, 1.0
            elif kind == "style":
                if UNSEEN.search(value):
                    bad = UNSEEN_BOX
            elif tag not in ("body", "html", "header"):
                against, pro = evidence(value)
                if against and tag not in FOR or against == STRONG and tag == "article":
                    bad = max(bad, against)
                elif pro:
                    good = max(good, 0.6)
    return Box(parent, tag, bad, good)


def weigh(found: list[Block], boxes: list[Box]) -> None:
    """Gives each block the evidence of the boxes around it.

    A box that speaks against its content decides for all in it, whatever is around it; only main, and an article in a box
    that nothing else seals, begin anew. A weak one does not count if it wraps the page: at least half of the page's words,
    and five times as many as content boxes hold outside of it. A header counts against its content unless it is an article's own, but
    the headlines of a content box's header stay.
    """
    n = len(boxes)
    words, good, live, in_good = [0] * n, [0] * n, [True] * n, [False] * n
    for k in range(1, n):
        live[k] = boxes[k].bad < STRONG and live[boxes[k].parent]
        in_good[k] = boxes[k].good > 0 or in_good[boxes[k].parent]
    for b in found:
        if live[b.box]:
            size = b.text.count(" ") + 1
            words[b.box] += size
            good[b.box] += size * in_good[b.box]
    for k in range(n - 1, 0, -1):
        words[boxes[k].parent] += words[k]
        good[boxes[k].parent] += good[k]
    state: list[tuple[float, float, bool, bool]] = [(0.0, 0.0, False, False)]  # against, for, sealed, in an article
    for k in range(1, n):
        box = boxes[k]
        against, pro, sealed, own = state[box.parent]
        wraps = box.bad == WEAK and 2 * words[k] >= words[0] and 5 * (good[0] - good[k]) <= words[k]
        if against == 2.0 or box.bad == UNSEEN_BOX:
            state.append((2.0, 0.0, True, own))
        elif box.tag == "main":
            state.append((0.0, 1.0, False, own))
        elif box.bad == STRONG or box.bad == WEAK and not wraps:
            state.append((1.0, 0.0, sealed or box.tag not in ("nav", "menu", "form"), own))
        elif box.tag == "article":
            state.append((against, pro, True, own) if sealed else (0.0, 1.0, False, True))
        elif box.tag == "header" and not own:
            state.append((1.0, 0.0, sealed, own))
        elif box.tag in ("h1", "h2") and boxes[box.parent].tag == "header" and state[boxes[box.parent].parent][1] > 0:
            state.append(state[boxes[box.parent].parent])
        else:
            state.append((against, max(pro, box.good) if not against else pro, sealed, own))
    for b in found:
        b.against, b.pro = state[b.box][:2]


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, less what is in silent tags."""
    out: list[Block] = []
    boxes = [Box(0, "", NOTHING, 0.0)]
    stack: list[tuple[str, int]] = [("", 0)]  # open tags and the numbers of their boxes
    buffer, linked, in_link = [], 0, 0
    silent: list[tuple[str, int]] = []  # open silent tags, and how many tags were open around each
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                tag, box = stack[-1]
                out.append(Block(text, tag, boxes[box].parent, box, min(linked, len(text))))
        linked = 0

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and not silent:
            buffer.append(page[at:lt])
            if in_link:
                linked += lt - at
        if lt == size:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = TAG.match(page, lt) or LOOSE_TAG.match(page, lt)
        if not m:
            if nxt.isalpha() or nxt == "/":  # a tag cut by the page's end
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                if not silent:
                    buffer.append("<")
                at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in SILENT:
                for k in range(len(silent) - 1, -1, -1):
                    if silent[k][0] == tag:
                        del stack[silent[k][1] :], silent[k:]
                        break
            if tag in BLOCKS:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        while silent and silent[-1][1] > k:  # what it stood in has ended
                            silent.pop()
                        break
            continue
        if silent and silent[0][0] == "head" and tag not in IN_HEAD:
            silent.clear()
        if silent and (silent[-1][0] == tag and tag in NO_NESTING or silent[-1][0] in ("svg", "math") and tag in BLOCKS):
            silent.pop()
        if tag == "br":
            if not silent:
                buffer.append(" ")
            continue
        if tag in RAW:
            end = ENDS[tag].search(page, at)
            close = -1 if end is None else page.find(">", end.start())
            at = size if close < 0 else close + 1
            continue
        if tag in VOID and tag not in BLOCKS:
            continue
        if tag in SILENT:
            if not attributes.rstrip().endswith("/"):
                end, again = ENDS[tag].search(page, at), BEGINS[tag].search(page, at) if tag in NO_NESTING else None
                if tag == "head" or end and not (again and again.start() < end.start()):
                    silent.append((tag, len(stack)))
                else:  # never closed: only the text right after it is its own
                    lt = page.find("<", at)
                    at = size if lt < 0 else lt
            continue
        if tag == "a":
            in_link = 1
            continue
        if tag in BLOCKS:
            flush()
            in_link = 0
            if tag in ENDS_P and stack[-1][0] == "p":
                stack.pop()
            if tag in SAME:
                while stack[-1][0] in SAME[tag]:
                    stack.pop()
            if tag == "hr":
                continue
            boxes.append(box_of(stack[-1][1], tag, attributes))
            stack.append((tag, len(boxes) - 1))
    flush()
    weigh(out, boxes)
    return out


def score(b: Block) -> float:
    """How much a block looks like content; under 0 it looks like boilerplate."""
    w, words = WEIGHTS, b.text.count(" ") + 1
    x = w["against"] * b.against + w["for"] * b.pro + w["links"] * (b.links / len(b.text)) + w["words"] * min(1.0, words / 20)
    if b.tag == "p":
        x += w["p"]
    elif b.tag[:1] == "h" and b.tag[1:].isdigit():
        x += w["heading"]
    elif b.tag in ("li", "td", "th", "dd", "dt"):
        x += w["item"]
    if words < 4:
        x += w["short"]
    if b.text[-1] in ".!?…:;\"”»":
        x += w["stop"]
    if "©" in b.text[:40] or "all rights reserved" in b.text[-80:].lower():
        x += w["rights"]
    return x


def content_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes the minimum cut leaves with the source. Dinic's algorithm; what a node takes from the source and gives to the sink itself is set off before."""
    n = len(scores)
    if all(s >= 0 for s in scores):
        return [True] * n
    if all(s <= 0 for s in scores):
        return [False] * n
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    own: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        own[a].append(len(to))
        to.append(b)
        room.append(forth)
        own[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            join(source, i, s, 0.0)
        elif s < 0:
            join(i, sink, -s, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in own[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                f = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= f
                    room[e ^ 1] += f
                for k, e in enumerate(path):
                    if room[e] <= tiny:
                        cut = k
                        break
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[u] < len(own[u]):
                e = own[u][nxt[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(own[u]):
                path.append(e)
                u = to[e]
            elif u == source:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                nxt[u] += 1


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    edges = [(i, i + 1, ADJACENT + SIBLING * (a.container == b.container and a.tag == b.tag)) for i, (a, b) in enumerate(zip(found, found[1:], strict=False))]
    last: dict[int, int] = {}
    for i, b in enumerate(found):  # neighbours under one parent that others stand between
        j = last.get(b.container)
        if j is not None and j < i - 1:
            edges.append((j, i, SIBLING / 2))
        last[b.container] = i
    side = content_side([score(b) for b in found], edges)
    return "\n".join(b.text for b, good in zip(found, side, strict=True) if good)


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars, without the html."""

    @F.pandas_udf("string")
    def text(page: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in page:
            yield pd.Series([main_text(p) for p in batch], dtype="object")

    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    return pages.select(*rest, text(html_col).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
