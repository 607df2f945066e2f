"""SQL of the sentence rules, for DuckDB: pieces of WITH clauses over a table (doc, no, txt), by window functions.

Where each step of a rule depends on what earlier steps took, every place's successor is computed on its own, and a
recursive clause walks from the first place on.
"""

from __future__ import annotations

from clausecut import patterns as P

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
DOC = "PARTITION BY doc ORDER BY i"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def matches(text: str, name: str) -> str:
    """A pattern of this package, by its name, in a text; case is the only flag that matters to the given data."""
    flags, _, body = getattr(P, name).removeprefix("(?").partition(")")
    return f"regexp_matches({text}, '{'(?i)' * ('i' in flags)}{body.replace(chr(39), chr(39) * 2)}')"


def punkt(out: str, source: str, terms) -> str:
    """out(doc, no, k, s): sentences k of each txt."""
    word = quoted(terms)
    return rf"""{out}_p AS (SELECT doc, no, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT doc, no, regexp_extract_all(txt, '\S+\s*') AS ps FROM {source})),
 {out}_t AS (SELECT *, {STRIP.format("piece")} AS t, {STRIP.format("lead(piece) OVER (PARTITION BY doc, no ORDER BY i)")} AS nx FROM {out}_p),
 {out}_b AS (SELECT *, regexp_replace(t, '["''”’»)\]}}]+$', '') AS bare, regexp_replace(nx, '^["''„“«(\[{{]+', '') AS nb FROM {out}_t),
 {out}_c AS (SELECT *, lower(regexp_replace(bare, '\.$', '')) AS core FROM {out}_b),
 {out}_e AS (SELECT *, CASE WHEN nx IS NULL OR NOT regexp_matches(t, '[.?!]') THEN false WHEN regexp_matches(bare, '[?!]$') THEN true WHEN NOT regexp_matches(bare, '\.$') OR regexp_matches(bare, '\.\.$') THEN false
 WHEN core IN ({word}) OR regexp_replace(core, '^.*-', '') IN ({word}) THEN false WHEN regexp_matches(bare, '^-?[0-9][0-9.,-]*\.$') THEN NOT regexp_matches(nb, '^(?:\p{{Ll}}|[;:,.!?])')
 WHEN regexp_matches(bare, '^\p{{L}}\.$') THEN NOT regexp_matches(nb, '^(?:\p{{L}}|[;:,.!?])') ELSE true END AS ends FROM {out}_c),
 {out}_k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc, no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM {out}_e),
 {out} AS (SELECT doc, no, k, {STRIP.format("string_agg(piece, '' ORDER BY i)")} AS s FROM {out}_k GROUP BY doc, no, k)"""


PREPROCESSED = r"""array_to_string(list_transform(string_split(regexp_replace(regexp_replace({}, '(\.{{3,}}|…+)', ' \1 ', 'g'), '\n{{2,}}', chr(10), 'g'), chr(10)),
 lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10))"""
SINGLE_LINE = r"""regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({}, '\s+', ' ', 'g')), 'DZIENNIK USTAW.*?\d{{4}}\s*r\.', '', 'g'), 'USTAWA\s+z\s+dnia\s+\d+.*?\d{{4}}\s*r\.', '', 'g'), 'ROZPORZĄDZENIE\s+.*?\d{{4}}\s*r\.', '', 'g')"""


def by_line(out: str, source: str) -> str:
    """out(doc, i, s): segments of text (doc, text) of several lines, cleaned."""
    early = "'(?i)" + P.EARLY_BODY.partition(")")[2] + "'"
    return rf"""{out}_l AS (SELECT doc, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc, string_split(regexp_replace({PREPROCESSED.format("text")}, '\n\z', ''), chr(10)) AS ls FROM {source})),
 {out}_h AS (SELECT doc, n * 10 + generate_subscripts(hs, 1) AS no, {STRIP.format("unnest(hs)")} AS txt FROM (SELECT doc, n, string_split(regexp_replace(line, {early}, '\1' || chr(10) || '\2'), chr(10)) AS hs FROM {out}_l)),
 {punkt(out + "_s", out + "_h", P.TERMS)},
 {out}_g AS (SELECT doc, no, k, s, length(s) >= 2 AND NOT {matches("s", "ARTIFACT")} AND NOT {matches("s", "ONLY_PUNCTUATION")} AS good, {matches("s", "STRAY_PUNCTUATION")} AS stray FROM {out}_s WHERE s <> ''),
 {out}_f AS (SELECT *, good AND (NOT stray OR row_number() OVER (PARTITION BY doc, good ORDER BY no, k) = 1) AS kept FROM {out}_g),
 {out}_a AS (SELECT *, sum(kept::INT) OVER (PARTITION BY doc ORDER BY no, k) AS i FROM {out}_f),
 {out} AS (SELECT doc, i - 1 AS i, string_agg(s, ' ' ORDER BY no, k) AS s FROM {out}_a WHERE i > 0 AND (kept OR stray) GROUP BY doc, i)"""


def walked(out: str, source: str) -> str:
    """out(doc, i, s) from source(doc, i, s, after): the places that a walk by `after` from place 0 comes to, numbered anew."""
    return f"""{out}_w AS (SELECT doc, i, after FROM {source} WHERE i = 0 UNION ALL SELECT x.doc, x.i, x.after FROM {out}_w w JOIN {source} x ON x.doc = w.doc AND x.i = w.after),
 {out} AS (SELECT x.doc, row_number() OVER (PARTITION BY x.doc ORDER BY x.i) - 1 AS i, x.s FROM {source} x JOIN {out}_w w ON w.doc = x.doc AND w.i = x.i)"""


def headers_merged(out: str, source: str) -> str:
    """out(doc, i, s): gazette headers, titles, article headers and numbers with what they take, from source(doc, i, s) without blank segments."""
    names = ("GAZETTE", "ENDS_WITH_R", "ACT_TYPE", "ATTACHMENT", "ARTICLE_HEADER", "CHAPTER_HEADER", "BODY_START", "LIST_ITEM", "STANDALONE_NUMBER", "STANDALONE_SECTION", "ENDS_WITH_HEADER")
    following = "ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    return f"""{out}_f AS (SELECT doc, i, s, {", ".join(f"{matches('s', n)} AS {n.lower()}" for n in names)} FROM {source}),
 {out}_n AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n, lead(s) OVER w AS s2, lead(act_type) OVER w AS act2, lead(article_header) OVER w AS heads, lead(standalone_number) OVER w AS counts, lead(list_item) OVER w AS item2,
 min(CASE WHEN ends_with_r THEN i END) OVER (PARTITION BY doc {following}) AS r, min(CASE WHEN article_header OR chapter_header OR body_start OR list_item OR act_type THEN i END) OVER (PARTITION BY doc {following}) AS stop FROM {out}_f WINDOW w AS ({DOC})),
 {out}_x AS (SELECT *, standalone_number OR standalone_section AS number, article_header AND NOT chapter_header AS article FROM {out}_n),
 {out}_c AS (SELECT *, CASE WHEN gazette THEN 'gazette' WHEN act_type OR attachment AND coalesce(act2, false) THEN 'title' WHEN s2 IS NULL OR NOT (article OR list_item OR number OR ends_with_header) THEN 'none'
 WHEN number AND NOT heads AND NOT item2 THEN 'two' WHEN article AND counts OR list_item AND (heads OR counts) OR s2[1] = '„' AND length(s) <= 15 THEN 'none' ELSE 'two' END AS kind FROM {out}_x),
 {out}_e AS (SELECT *, CASE kind WHEN 'gazette' THEN coalesce(r, n - 1) WHEN 'title' THEN coalesce(stop, n) - 1 WHEN 'two' THEN i + 1 ELSE i END AS last, CASE kind WHEN 'gazette' THEN coalesce(r, i) + 1 WHEN 'title' THEN coalesce(stop, n) WHEN 'two' THEN i + 2 ELSE i + 1 END AS after FROM {out}_c),
 {out}_j AS (SELECT a.doc, a.i, a.after, string_agg(b.s, ' ' ORDER BY b.i) AS s FROM {out}_e a JOIN {source} b ON b.doc = a.doc AND b.i BETWEEN a.i AND a.last GROUP BY ALL),
 {walked(out, out + "_j")}"""


def single_line(out: str, source: str) -> str:
    """out(doc, i, s): sentences of text (doc, text) as one line, of three characters at least, headers with what follows them."""
    start = f"""{out}_t AS (SELECT doc, 0 AS no, {SINGLE_LINE.format("text")} AS txt FROM {source}),
 {punkt(out + "_s", out + "_t", P.TERMS_SINGLE_LINE)},"""
    return start + "\n " + paired(out, f"(SELECT doc, k AS i, s FROM {out}_s WHERE length(s) >= 3)")


def paired(out: str, source: str, passes: int = 5) -> str:
    """out(doc, i, s) from source(doc, i, s), without blank segments: artifacts go, then headers take the next segment, pass by pass."""
    parts, now = [f"{out}_0 AS (SELECT doc, row_number() OVER ({DOC}) - 1 AS i, s FROM {source} WHERE NOT {matches('s', 'ARTIFACT')})"], f"{out}_0"
    for k in range(1, passes + 1):
        nxt = out if k == passes else f"{out}_{k}"
        takes = f"{matches('s', 'HEADER_SINGLE_LINE')} AND lead(s) OVER ({DOC}) IS NOT NULL"
        parts += [f"{nxt}_m AS (SELECT doc, i, CASE WHEN {takes} THEN s || ' ' || lead(s) OVER ({DOC}) ELSE s END AS s, i + 1 + ({takes})::INT AS after FROM {now})", walked(nxt, f"{nxt}_m")]
        now = nxt
    return ",\n ".join(parts)


def gold_windows(out: str, source: str, tokens: str) -> str:
    """out(doc, window_no, n_tokens, labels) from source(doc, i, s): whole sentences until a window has over GOLD_FULL tokens; then what becomes of the rest."""
    return f"""{out}_t AS (SELECT doc, i, len(regexp_extract_all(s, {tokens})) AS n FROM {source}),
 {out}_z AS (SELECT *, sum(n) OVER ({DOC}) AS z, sum(n) OVER ({DOC}) - n AS b, count(*) OVER (PARTITION BY doc) AS m FROM {out}_t),
 {out}_x AS (SELECT doc, i, m, sum(n) OVER (PARTITION BY doc ORDER BY b RANGE BETWEEN CURRENT ROW AND {P.GOLD_FULL} FOLLOWING) AS upto, max(i) OVER (PARTITION BY doc ORDER BY b RANGE BETWEEN CURRENT ROW AND {P.GOLD_FULL} FOLLOWING) AS last, b FROM {out}_z),
 {out}_s AS (SELECT x.doc, x.i, x.last + 1 AS after, z.z - x.b AS s FROM {out}_x x JOIN {out}_z z ON z.doc = x.doc AND z.i = x.last),
 {out}_w AS (SELECT doc, i, after, s FROM {out}_s WHERE i = 0 UNION ALL SELECT x.doc, x.i, x.after, x.s FROM {out}_w w JOIN {out}_s x ON x.doc = w.doc AND x.i = w.after),
 {out}_k AS (SELECT *, row_number() OVER ({DOC}) - 1 AS k, lead(s) OVER ({DOC}) AS next_n, lead(after) OVER ({DOC}) AS next_after FROM {out}_w),
 {out}_r AS (SELECT doc, k, i, CASE WHEN next_n > 0 AND next_n < {P.GOLD_LEAST} AND s + next_n <= {P.GOLD_JOINED} THEN next_after ELSE after END AS after FROM {out}_k WHERE s > {P.GOLD_FULL} OR s >= {P.GOLD_LEAST}),
 {out} AS (SELECT r.doc, k::INT AS window_no, sum(n)::INT AS n_tokens, string_agg(CASE WHEN n > 0 THEN repeat('0', n - 1) || '1' ELSE '' END, '' ORDER BY t.i) AS labels FROM {out}_r r JOIN {out}_t t ON t.doc = r.doc AND t.i >= r.i AND t.i < r.after GROUP BY ALL)"""
