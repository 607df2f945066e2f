"""The contracts in plain Python, slow and direct."""

import hashlib
import html.parser
import itertools
import re
from collections import Counter, defaultdict


SPACES = " \t\n\v\f\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    out = {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}
    return {k: len(v) for k, v in out.items()}, sha(",".join(f"{k}:{a}:{b}" for k, v in out.items() for a, b in v))


def secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    n = Counter(k for _, k, _ in found)
    return tuple(n[i] for i in range(3)), sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found)))


def exact(docs):
    """docs: (doc_id, text). {doc_id: (keep_id, group_size, kept, sha)}, for distinct ids."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate({ord(c): None for c in SPACES})].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], sha(k)) for k, g in groups.items() for _, i in g}


def targets(docs):
    """docs: (source, text). {source: (size, target)} by resharing step by step."""
    size = defaultdict(int)
    for s, t in docs:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, free, out = 1.5 * sum(size.values()), set(order), {}
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if total * weight[s] / w > 2 * size[s]]
        if not over:
            out |= {s: total * weight[s] / w for s in free}
            break
        for s in over:
            out[s] = 2.0 * size[s]
            free.discard(s)
        total -= sum(out[s] for s in over)
    return {s: (size[s], out[s]) for s in order}


def shingles(text, k=3):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked(docs, k=3, num=90, den=100):
    """docs: (doc_id, text). {doc_id: (n_shingles, component_id)} by comparing sets that share a shingle."""
    sets = {i: shingles(t, k) for i, t in docs}
    by, parent = defaultdict(list), {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in by[x] if j > i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def quality(text):
    w = words(text)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if tri[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def line_dedup(docs, long=50, mean=3):
    """docs: (doc_id, text), distinct. {(doc_id, text): text less repeated runs of lines}, by trying every run that the rules name."""
    keys = sorted(set(docs), key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5((x[1] or "").encode()).hexdigest()))
    lines = {k: (k[1] or "").split("\n") for k in keys}
    n_words = {x: len(words(x)) for ls in lines.values() for x in ls}
    h = {x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in n_words}
    ranges = {}
    for k, ls in lines.items():
        n, own = [n_words[x] for x in ls], set()
        opens = []
        for i in range(len(ls)):
            p1, p2 = (h[ls[i - 1]] if i else 0), (h[ls[i - 2]] if i > 1 else 0)
            opens.append(i == 0 or (((p2 << 1 | p2 >> 31) & 0xFFFFFFFF) ^ p1) % mean == 0 or n[i - 1] > long or n[i] > long)
        cuts = [i for i, o in enumerate(opens) if o] + [len(ls)]
        for a, z in itertools.pairwise(cuts):
            if sum(n[a:z]) > long or sum(x > 0 for x in n[a:z]) > 1:
                own.add((a, z))
        for i in range(len(ls)):
            if 0 < n[i] <= long:
                z = next((z for z in range(i + 1, len(ls) + 1) if sum(n[i:z]) > long), None)
                a = next((a for a in range(i, -1, -1) if sum(n[a : i + 1]) > long), None)
                own |= ({(i, z)} if z else set()) | ({(a, i + 1)} if a is not None else set())
        ranges[k] = own
    first = {}
    for k in keys:
        for a, z in sorted(ranges[k]):
            first.setdefault(tuple(lines[k][a:z]), (k, a))
    out = {}
    for k in keys:
        gone = {i for a, z in ranges[k] if first[tuple(lines[k][a:z])] != (k, a) for i in range(a, z)}
        out[k] = None if k[1] is None else "\n".join(x for i, x in enumerate(lines[k]) if i not in gone)
    return out


class Article(html.parser.HTMLParser):
    """What stands in a page's article, block by block. For pages whose whole main text is in one article, and that close what they open but for paragraphs."""

    ENDS = frozenset("article p h1 h2 h3 li ul ol div".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside = [""], False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in self.ENDS:
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in self.ENDS:
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def article_text(page):
    return "\n".join(x for b in Article(page or "").blocks if (x := " ".join(b.split())))
