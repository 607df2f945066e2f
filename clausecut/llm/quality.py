"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text. The ledger holds the measurements and failure_bits, one bit a rule.
Policies are named sets of bits with a version; applying one, or counting what each rule of it takes, reads only the
ledger: sums of bitwise conditions, no second look at a text.

The measurements need sets and counts of a text's own word windows, so they run in an Arrow pandas UDF, over columns of
one batch; its memory is that of a batch. There is no shuffle.

Null counts as an empty text, which fails for too few words. Repeated rows are judged alike; other columns, a null doc_id too,
pass through. A very long text is measured whole: its words and windows are what a worker holds beside its batch.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausecut.llm.common import free

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))

#: Rules in the order of their bits: name, and when a text fails. Ratios are compared as whole numbers.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "capitals": "10 * n_upper > 4 * word_chars",
    "exclaims": "10 * n_exclaims > 3 * n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
#: Versioned policies.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": tuple(RULES),
}
CURRENT = "full-1"


def measured(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at ASCII white space only
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < n - 2:
            often, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    spaces = len(raw) - sum(map(len, words))
    cut = lambda chars: len(raw) - len(raw.translate(None, chars))
    return n, len(text or "") - spaces, cut(SYMBOLS), len(lines) - len(set(lines)), repeat, len(lines), cut(UPPER), cut(b"!")


def measures(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def of(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measured(t) for t in batch], columns=list(MEASURES), dtype="int64")

    return of(text)


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(BITS[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def ledger(docs: DataFrame, text_col: str = "text", m: str = "m", failure_bits: str = "failure_bits") -> DataFrame:
    """docs with m (the measurements) and failure_bits, which take the place of columns of such names."""
    with_m = docs.withColumn(m, measures(F.col(text_col)))
    bits = [F.when(F.expr(_of_m(rule, m)), F.lit(BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return with_m.withColumn(failure_bits, total)


def _of_m(rule: str, m: str) -> str:
    return " ".join(f"`{m}`.{w}" if w in MEASURES else w for w in rule.split())


def passes(policy: str | tuple[str, ...], bits: str = "failure_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def failed_rules(bits: str = "failure_bits") -> Column:
    """Names of the rules that a row fails."""
    return F.array_compact(F.array(*[F.when(F.col(bits).bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(n)) for n, b in BITS.items()]))


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rows, how many fail it, how many fail it alone, and how many the policy keeps with and without it."""
    whole = F.lit(mask(policy)).cast("long")
    own = F.col("failure_bits").bitwiseAND(whole)
    sums = [F.count("*").alias("n_rows"), F.sum((own == 0).cast("long")).alias("n_kept")]
    for name in POLICIES[policy]:
        b = F.lit(BITS[name]).cast("long")
        sums += [F.sum((own.bitwiseAND(b) != 0).cast("long")).alias(f"f_{name}"), F.sum((own == b).cast("long")).alias(f"o_{name}")]
    one = rows.agg(*sums)
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_failed_alone")) for n in POLICIES[policy]])
    return one.select(F.lit(policy).alias("policy"), "n_rows", "n_kept", F.explode(each).alias("r")).select("policy", "r.rule", "n_rows", "n_kept", "r.n_failed", "r.n_failed_alone", (F.col("n_kept") + F.col("r.n_failed_alone")).alias("n_kept_without"))


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, the base measurements, base_failed, kept, failure_bits."""
    rows = ledger(docs.select("doc_id", text_col), text_col)
    return rows.select("doc_id", *[F.col(f"m.{m}").alias(m) for m in MEASURES[:5]], (~passes("base-1")).alias("base_failed"), passes(CURRENT).alias("kept"), "failure_bits")


def accepted(docs: DataFrame, text_col: str = "text", policy: str = CURRENT) -> DataFrame:
    """docs that pass the policy, with the same columns."""
    m, bits = free(docs.columns, "m", "failure_bits")
    return ledger(docs, text_col, m, bits).where(passes(policy, bits)).select(*docs.columns)
