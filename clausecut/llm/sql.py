"""Queries of this folder in SQL, for DuckDB."""

from __future__ import annotations

import re

from clausecut.llm import line_dedup, mixing, pii, quality, secrets

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LINKS = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
 c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

EXACT = r"""WITH x AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents)
 SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM x WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)"""

QUALITY = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
 g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
 f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS k FROM g),
 r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM f WHERE k > 1) GROUP BY doc_id),
 l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
 d AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
 m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims
 FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id),
 b AS (SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {quality.BITS[name]} ELSE 0 END" for name, rule in quality.RULES.items())} AS bits FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & {quality.mask("base-1")}) <> 0 AS base_failed, (bits & {quality.mask(quality.CURRENT)}) = 0 AS kept, bits::BIGINT AS failure_bits FROM b"""


_RULES = ", ".join(f"('{name}', {quality.BITS[name]})" for name in quality.POLICIES[quality.CURRENT])
_ALL = quality.mask(quality.CURRENT)
ABLATIONS = f"""WITH q AS ({QUALITY}), r(rule, bit) AS (VALUES {_RULES}), n AS (SELECT count(*) AS n_rows, sum(((failure_bits & {_ALL}) = 0)::INT)::BIGINT AS n_kept FROM q),
 f AS (SELECT rule, sum(((failure_bits & bit) <> 0)::INT)::BIGINT AS n_failed, sum(((failure_bits & {_ALL}) = bit)::INT)::BIGINT AS n_failed_alone FROM q, r GROUP BY rule)
 SELECT '{quality.CURRENT}' AS policy, rule, n_rows, n_kept, n_failed, n_failed_alone, n_kept + n_failed_alone AS n_kept_without FROM f, n"""


def _spans(name: str, pattern: str, good: str) -> str:
    """Matches m of a pattern with start a and end z, as lengths of matches and gaps before them; of those, the good ones."""
    p = "'" + pattern.replace("'", "''") + "'"
    return rf"""{name} AS (SELECT doc_id, text, m, z - length(m) AS a, z FROM (SELECT doc_id, text, m, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS z
 FROM (SELECT doc_id, text, unnest(t) AS m, unnest(gs[1:len(t)]) AS g, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, {p}) AS t, regexp_split_to_array(text, {p}) AS gs FROM docs))) WHERE {good})"""


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(string_split(reverse({DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"
PLAIN = "regexp_replace(m, ' ', '', 'g')"
MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split(substring({PLAIN}, 5) || substring({PLAIN}, 1, 4), ''), lambda c: CASE WHEN c >= '0' AND c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda x, y: CASE WHEN y < 10 THEN (x * 10 + y) % 97 ELSE (x * 100 + y) % 97 END) = 1"
def _near(kind: str) -> str:
    return f"regexp_matches(substring(text, greatest(a - {pii.WINDOW}, 0) + 1, (z - greatest(a - {pii.WINDOW}, 0) + {pii.WINDOW})::BIGINT), '{pii.CONTEXT[kind]}')"


PII = rf"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 {_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")},
 {_spans("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: x::HUGEINT <= 255))")},
 {_spans("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}")},
 {_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 8 AND 15")},
 {_spans("iban", re.sub(r"\(\?<?!.*?\)", r"\\b", pii.PATTERNS["iban"]), MOD97)},
 {_spans("national", r"[0-9-]+", rf"regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND NOT regexp_matches(m, '^(?:000|666|9..)|-00-|-0000$') AND {_near('national')}")},
 every AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS k, '{kind}' AS kind, a, z, {_near(kind)} AS lifted FROM {kind}" for i, kind in enumerate(pii.PATTERNS))}),
 x AS (SELECT doc_id, {", ".join(f"sum((kind = '{k}')::INT)::BIGINT AS n_{k}" for k in pii.BASE)}, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) FILTER (k < {len(pii.BASE)}) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) AS spans, sum(lifted::INT)::BIGINT AS n_in_context FROM every GROUP BY doc_id)
 SELECT docs.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_in_context, 0) AS n_in_context FROM docs LEFT JOIN x ON x.doc_id = docs.doc_id"""

_RE2 = {r.kind: r.pattern.replace("}+", "}").replace("++", "+") for r in secrets.RULES}
_GOOD = {r.kind: f"length({f'''regexp_extract(m, '{_RE2[r.kind].replace(chr(39), chr(39) * 2)}', {r.group})''' if r.group else 'm'}) >= {r.least}" for r in secrets.RULES}
_BASE = [r.kind for r in secrets.RULES if r.base]

SECRETS = rf"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 {", ".join(_spans(r.kind, _RE2[r.kind], _GOOD[r.kind]) for r in secrets.RULES)},
 every AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, a, z FROM {r.kind}" for i, r in enumerate(secrets.RULES))}),
 x AS (SELECT doc_id, {", ".join(f"sum((kind = '{k}')::INT)::BIGINT AS n_{k}" for k in _BASE)}, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) FILTER (k < {len(_BASE)}) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS spans FROM every GROUP BY doc_id)
 SELECT docs.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN x ON x.doc_id = docs.doc_id"""

_LONG, _MASK = line_dedup.LONG, (1 << line_dedup.BITS) - 1
_DOC = "PARTITION BY doc_id, tm"

LINES = rf"""WITH t AS (SELECT doc_id, md5(coalesce(text, '')) AS tm, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 l AS (SELECT doc_id, tm, line, pos, md5(line) AS d, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, tm, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM t)),
 h AS (SELECT *, ('0x' || substr(d, 1, {line_dedup.BITS // 4}))::BIGINT AS h FROM l),
 p AS (SELECT *, coalesce(lag(h) OVER w, 0) AS p1, coalesce(lag(h, 2) OVER w, 0) AS p2, coalesce(lag(n) OVER w, 0) AS n1 FROM h WINDOW w AS ({_DOC} ORDER BY pos)),
 o AS (SELECT *, pos = 0 OR xor(((p2 << 1) | (p2 >> {line_dedup.BITS - 1})) & {_MASK}, p1) % {line_dedup.MEAN} = 0 OR n1 > {_LONG} OR n > {_LONG} AS opens FROM p),
 c AS (SELECT doc_id, tm, pos, d, n, opens, coalesce(lead(opens) OVER ({_DOC} ORDER BY pos), true) AS closes FROM o),
 again AS (SELECT d FROM c WHERE n > 0 GROUP BY d HAVING count(*) > 1),
 r AS (SELECT *, pos - row_number() OVER ({_DOC} ORDER BY pos) AS run FROM c WHERE n = 0 OR d IN (SELECT d FROM again)),
 a AS (SELECT *, sum(n) OVER w AS z, sum(n) OVER w - n AS b, sum(opens::INT) OVER w AS chunk FROM r WINDOW w AS ({_DOC}, run ORDER BY pos)),
 e AS (SELECT *, min(pos) OVER ({_DOC}, run, chunk) AS first_of_chunk, max(pos) OVER ({_DOC}, run ORDER BY b RANGE BETWEEN CURRENT ROW AND {_LONG} FOLLOWING) AS last, min(pos) OVER ({_DOC}, run ORDER BY z RANGE BETWEEN {_LONG} PRECEDING AND CURRENT ROW) AS first FROM a),
 u AS (SELECT doc_id, tm, first_of_chunk AS lo, pos AS hi, true AS chunk FROM e WHERE closes AND chunk > 0 UNION SELECT doc_id, tm, first, pos, false FROM e WHERE n BETWEEN 1 AND {_LONG} UNION SELECT doc_id, tm, pos, last, false FROM e WHERE n BETWEEN 1 AND {_LONG}),
 k AS (SELECT u.doc_id, u.tm, lo, hi, u.chunk, string_agg(d, '' ORDER BY pos) AS key, sum(n) AS words, sum((n > 0)::INT) AS filled FROM u JOIN c ON c.doc_id = u.doc_id AND c.tm = u.tm AND pos BETWEEN lo AND hi GROUP BY ALL),
 g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, tm, lo) AS rank, first_value((doc_id, tm, lo)) OVER (PARTITION BY key ORDER BY doc_id, tm, lo) AS f FROM k WHERE words > {_LONG} OR chunk AND filled > 1),
 s AS (SELECT l.* FROM l ANTI JOIN (SELECT * FROM g WHERE f <> (doc_id, tm, lo)) x ON l.doc_id = x.doc_id AND l.tm = x.tm AND l.pos BETWEEN x.lo AND x.hi),
 y AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM s GROUP BY doc_id)
 SELECT q.doc_id, CASE WHEN q.text IS NOT NULL THEN coalesce(y.text, '') END AS text, len(t.ls)::BIGINT AS n_lines, (len(t.ls) - coalesce(y.n, 0))::BIGINT AS n_removed, length(coalesce(y.text, ''))::BIGINT AS n_chars
 FROM documents q JOIN t ON t.doc_id = q.doc_id LEFT JOIN y ON y.doc_id = q.doc_id"""

MIX = rf"""WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {mixing.HEX}))::BIGINT AS h FROM documents),
 per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
 c AS (SELECT *, {list(map(float, mixing.WEIGHTS))}[((rank - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::DOUBLE AS weight, {mixing.CAP} * source_size::DOUBLE AS cap, {mixing.SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM per),
 v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
 t AS (SELECT source, rank, source_size, total, CASE WHEN cap > level * weight THEN (SELECT arg_min(x.level, (x.cap / x.weight, x.rank)) FROM v x WHERE x.cap > x.level * x.weight) * weight ELSE cap END AS target FROM v),
 b AS (SELECT max(greatest(1, (floor(total)::BIGINT + {mixing.SLOTS} - 1) // {mixing.SLOTS})) AS block, max(floor(total)::BIGINT) AS words FROM t),
 s AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY rank), 0) AS lo FROM (SELECT source, rank, z / max(z) OVER () AS hi FROM (SELECT *, sum(target) OVER (ORDER BY rank) AS z FROM t WHERE target > 0))),
 p AS (SELECT i AS slot, ((i + 0.5::DOUBLE) * {mixing.GOLDEN}::DOUBLE) % 1.0::DOUBLE AS u FROM b, range(0, (words + block - 1) // block) r(i)),
 o AS (SELECT slot, s.source, s.rank AS no, row_number() OVER (PARTITION BY s.rank ORDER BY slot) - 1 AS place FROM p JOIN s ON u >= lo AND u < hi),
 g AS (SELECT t.*, block, (words + block - 1) // block AS slots, coalesce(n, 0) AS given, CASE WHEN abs(coalesce(n, 0) * block - target) < block THEN round(target)::BIGINT ELSE least(coalesce(n, 0) * block, {mixing.CAP} * source_size) END AS takes
 FROM t CROSS JOIN b LEFT JOIN (SELECT no, count(*) AS n FROM o GROUP BY no) q ON q.no = t.rank),
 a AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS z FROM d),
 x AS (SELECT a.*, g.rank, source_size, target, takes, given, block, slots, greatest(0, least(size, takes - z)) + greatest(0, least(size, takes - z - source_size)) AS taken, z // block AS place FROM a JOIN g ON g.source IS NOT DISTINCT FROM a.source)
 SELECT doc_id, x.source, size, source_size, target, taken::BIGINT AS taken, CASE WHEN taken > 0 THEN coalesce(o.slot, slots + x.rank)::BIGINT END AS first_slot FROM x LEFT JOIN o ON o.no = x.rank AND o.place = x.place"""

#: The eight steps of CRC-32 for one byte, and the whole of it over a text's bytes.
_BYTE = "list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: {_BYTE}), 4294967295)"
TRIE = rf"""WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS h, len({WORDS}) AS w FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT conv_id, list(h ORDER BY turn NULLS FIRST, h) AS hs, list(w ORDER BY turn NULLS FIRST, h) AS ws FROM t GROUP BY conv_id),
 k AS (SELECT *, {_CRC32} % 4 AS n FROM o),
 r AS (SELECT a.conv_id, list_concat(coalesce(b.hs, [])[1:a.n], a.hs[a.n + 1:]) AS hs, list_concat(coalesce(b.ws, [])[1:a.n], a.ws[a.n + 1:]) AS ws FROM k a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 20),
 p AS (SELECT conv_id, len(hs) AS size, d, sha256(array_to_string(hs[1:d], ',')) AS key, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(hs) + 1)) AS d FROM r)),
 m AS (SELECT *, min(conv_id) OVER (PARTITION BY d, key) AS node FROM p),
 n AS (SELECT d, node, count(*) AS n, min(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends FROM m GROUP BY d, node),
 u AS (SELECT n.*, m.node AS up FROM n LEFT JOIN m ON m.conv_id = n.node AND m.d = n.d - 1),
 c AS (SELECT d - 1 AS d, up, count(*) AS k FROM u WHERE d > 0 GROUP BY ALL),
 f AS (SELECT u.*, coalesce(c.k, 0) AS children FROM u LEFT JOIN c ON c.d = u.d AND c.up = u.node),
 s AS (SELECT m.d, m.node, sum((f.children = 0)::INT)::BIGINT AS leaves, sum((f.n - 1) * f.w)::BIGINT AS saved FROM f JOIN m ON m.conv_id = f.node AND m.d <= f.d GROUP BY ALL)
 SELECT f.node AS conv_id, f.d::BIGINT AS depth, f.up AS parent_conv_id, f.n AS n_convs, f.children AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, f.ends AS ends_sha256 FROM f JOIN s ON s.d = f.d AND s.node = f.node"""
