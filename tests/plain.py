"""Plain versions of operators, over rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aligned(span_rows: DataFrame, token_rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Spans (keys, span_no, start, end) with tok_no and tok of the first token they touch; null where none does.

    The join is on keys (the document) with an overlap condition, so no pair crosses documents.
    """
    both = span_rows.join(token_rows, list(keys)).where("char_end > start AND char_start < end")
    first = both.groupBy(*keys, "span_no").agg(F.min(F.struct("tok_no", "tok")).alias("t"))
    return span_rows.join(first, [*keys, "span_no"], "left").select(*keys, "span_no", "start", "end", F.col("t.tok_no").alias("tok_no"), F.col("t.tok").alias("tok"))
