"""Personal data: regular expressions propose spans, validators confirm them, context words move the score.

Kinds with a validator alone: email, ip (parts at most 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits) and
iban (mod 97). A kind that needs context as well: national (ddd-dd-dddd, without the numbers never given out): its own
score is under the threshold, and a context word within WINDOW characters lifts it over. Context never takes a confirmed
span away.

All is one map over the texts with built-in functions: no shuffle. The patterns are linear: possessive or anchored to
the start of a run, which a leftmost search would find anyway.

Null counts as an empty text, with no spans. Repeated rows give repeated rows; ids, null too, are passed on unread. No text is
cut; there is no limit on spans, and time grows with the text's length and its spans, also in very long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausecut.llm.common import free, text_or_empty
from clausecut.llm.spans import digits, spans

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The last group of a printed IBAN: up to four letters and digits, one a digit, so that a word in capitals after it is none.
MIXED = "(?:[0-9][A-Z0-9]{0,3}|[A-Z][0-9][A-Z0-9]{0,2}|[A-Z]{2}[0-9][A-Z0-9]?|[A-Z]{3}[0-9])"
#: Kind: pattern. The lookbehinds and possessive forms change no match; they keep a long run from being tried from each place in it.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?:\x20[A-Z0-9]{{4}}){{2,7}}\x20{MIXED})(?![A-Za-z0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span, before context.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95, "national": 0.3}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|mailto)\b",
    "ip": r"(?i)\b(?:ip|address|host|server)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|kredit|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|telefon)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto)\b",
    "national": r"(?i)\b(?:ssn|social security|national id)\b",
}
LIFT, THRESHOLD, WINDOW = 0.3, 0.5, 48
#: Code points of a part of a text, in which a span's surroundings are looked up.
PART = 1024


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    value = lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.regexp_extract_all(F.reverse(number), F.lit("."), F.lit(0)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits are right."""
    plain = F.regexp_replace(iban, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    number = F.transform(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(number, F.lit(0), lambda a, x: F.when(x < 10, a * 10 + x).otherwise(a * 100 + x) % 97) == 1


def _confirmed(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": lambda: F.when(n.between(16, 19), luhn(digits(match))).otherwise(F.lit(False)),
        "phone": lambda: n.between(8, 15),
        "iban": lambda: mod97(match),
        "national": lambda: ~match.rlike("^(?:000|666|9..)|-00-|-0000$"),
    }[kind]()


def _scored(kind: str, text: Column, found: Column) -> Column:
    """Spans with their scores. What stands near a span is read from the parts it lies in, not from the text's start."""

    def scored(both: Column) -> Column:
        def one(s: Column) -> Column:
            lo, hi = F.greatest(s["start"] - WINDOW, F.lit(0)), s["end"] + WINDOW
            first = F.floor(lo / PART).cast("int")
            near = F.substring(F.array_join(F.slice(both["parts"], first + 1, F.floor(hi / PART).cast("int") - first + 1), ""), lo - first * PART + 1, hi - lo)
            score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), LIFT).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"), s["match"].alias("match"))

        return F.filter(F.transform(both["found"], one), lambda s: s["score"] >= THRESHOLD)

    parts = lambda x: F.struct(x.alias("found"), F.when(F.size(x) > 0, F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % PART), F.lit(0))).alias("parts"))
    return F.transform(F.transform(F.array(found), parts), scored)[0]


def find(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """docs and pii: array of (kind, start, end, score, match), by kind as listed, then start."""
    text = text_or_empty(text_col)
    need = {"email": text.contains("@"), "phone": text.contains("+")}
    parts = [F.when(need.get(k, text.rlike("[0-9]")), _scored(k, text, spans(text, PATTERNS[k], lambda m, k=k: _confirmed(k, m)))).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double,match:string>>")) for k in kinds]
    return docs.withColumn("pii", F.flatten(F.array(*parts)))


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """docs with each span's text replaced by its kind in angle brackets; of overlapping spans the first counts."""
    text = text_or_empty(text_col)
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    walk = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    (own,) = free(docs.columns, "_pii")  # a column pii of docs
    return find(docs.withColumnRenamed("pii", own), text_col, kinds).withColumn(text_col, walk).drop("pii").withColumnRenamed(own, "pii")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the base kinds, all spans in one string, and how many of them context words have lifted."""
    found = find(docs).select("doc_id", "pii")
    own = F.create_map(*[F.lit(x) for k, v in SCORES.items() for x in (k, v)])
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("pii", lambda s: s["kind"].isin(*BASE)), line), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("pii", line), ",").alias("spans"), F.size(F.filter("pii", lambda s: s["score"] > F.element_at(own, s["kind"]))).cast("long").alias("n_in_context"))
