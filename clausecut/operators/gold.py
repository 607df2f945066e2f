"""Human span annotations: reading tasks, finding their texts, spans to tokens, and training windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from clausecut import patterns as P
from clausecut.functions.text import basename, let, strip
from clausecut.operators.clean import act_id
from clausecut.operators.tokens import tokenize

WINDOWS = "array<struct<window_no:int,tokens:array<string>,sbd_labels:array<int>>>"


def task_text(task: DataFrame) -> Column:
    """data.text, else text, else an empty text; a text that is there but null stays null."""
    return F.coalesce(F.col("data.text"), F.col("text") if "text" in task.columns else F.lit(None).cast("string"), F.lit(""))


def spans(tasks: DataFrame) -> DataFrame:
    """(act_id, file_upload, span_no, start, end) of each task's first annotation, in stored order."""
    own = tasks.select(act_id(F.col("file_upload")).alias("act_id"), "file_upload", F.posexplode(F.get("annotations", F.lit(0))["result"]).alias("span_no", "r"))
    return own.select("act_id", "file_upload", "span_no", F.col("r.value.start").alias("start"), F.col("r.value.end").alias("end"))


def with_texts(tasks: DataFrame, texts: DataFrame, loose: bool = False) -> DataFrame:
    """tasks (act_id, ...) with path and text of the first file, by name, of that act.

    loose=True takes any file whose name holds the act's id, so act_1_8 also finds act_1_81. Such an id is the beginning of
    one of the ids in the file's name, so it is found by an equal key: a file has a row for each beginning. Tasks without a
    file are dropped; see missing().
    """
    files = texts.where(F.col("path").endswith("_clean.txt"))
    if not loose:
        pairs = tasks.join(files.withColumn("act_id", act_id(F.col("path"))), "act_id")
    else:
        long = F.regexp_extract_all(basename(F.col("path")), F.lit(r"act_\d+_\d+"), F.lit(0))
        from_one = lambda x: F.length(F.regexp_extract(x, r"act_\d+_", 0)) + 1
        begun = F.flatten(F.transform(long, lambda x: F.transform(F.sequence(from_one(x), F.length(x)), lambda n: F.substring(x, F.lit(1), n))))
        pairs = tasks.join(files.withColumn("act_id", F.explode(F.array_distinct(begun))), "act_id")
    first = Window.partitionBy("act_id").orderBy("path")
    return pairs.withColumn("_rank", F.dense_rank().over(first)).where("_rank = 1").drop("_rank")


def missing(tasks: DataFrame, texts: DataFrame) -> DataFrame:
    return tasks.join(texts.where(F.col("path").endswith("_clean.txt")).select(act_id(F.col("path")).alias("act_id")).distinct(), "act_id", "left_anti")


def sliced(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points, with bounds past the end taken as the end."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def sliced_in(text: Column, spans: Column) -> Column:
    """Array of (start_offset, end_offset, text) of a text's spans (start, end): the spans' own text, where the whole one is."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start_offset"), s["end"].alias("end_offset"), sliced(text, s["start"], s["end"]).alias("text")))


def extracted(task_spans: DataFrame) -> DataFrame:
    """(act_id, sentences: array of start_offset, end_offset, text) as annotated, in stored order. Spans are cut out before they meet, so that no row takes a whole text along."""
    cut = task_spans.select("act_id", "span_no", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), sliced(F.col("text"), F.col("start"), F.col("end")).alias("text"))
    listed = cut.groupBy("act_id").agg(F.array_sort(F.collect_list(F.struct("span_no", "start_offset", "end_offset", "text"))).alias("x"))
    return listed.select("act_id", F.transform("x", lambda s: F.struct(s["start_offset"].alias("start_offset"), s["end_offset"].alias("end_offset"), s["text"].alias("text"))).alias("sentences"))


def gold_sentences(task_spans: DataFrame) -> DataFrame:
    """(act_id, sentences): the spans' texts by start, stripped, without empty ones. Text between spans is left out."""
    one = F.struct("start", "span_no", strip(sliced(F.col("text"), F.col("start"), F.col("end"))).alias("text"))
    listed = task_spans.groupBy("act_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return listed.select("act_id", F.filter(F.transform("x", lambda s: s["text"]), lambda t: t != "").alias("sentences"))


def window_ranges(sizes: list[int], full: int = P.GOLD_FULL, least: int = P.GOLD_LEAST, joined: int = P.GOLD_JOINED) -> list[tuple[int, int]]:
    """(first, number) of the sentences of each window, from the sentences' numbers of tokens."""
    out, first, n = [], 0, 0
    for i, size in enumerate(sizes):
        n += size
        if n > full:
            out.append((first, i + 1 - first))
            first, n = i + 1, 0
    if least <= n <= full:
        out.append((first, len(sizes) - first))
    elif n and out and sum(sizes[out[-1][0] : out[-1][0] + out[-1][1]]) + n <= joined:
        out[-1] = (out[-1][0], len(sizes) - out[-1][0])
    return out


def packed(sentences: Column, full: int = P.GOLD_FULL, least: int = P.GOLD_LEAST, joined: int = P.GOLD_JOINED) -> Column:
    """Array of (window_no, tokens, sbd_labels): whole sentences until a window has more than `full` tokens.

    A rest of at least `least` tokens is a window; a shorter one is added to the last window if both have at most `joined`,
    else dropped. A running sum that starts anew cannot be a window function; it is taken in Arrow batches, over the
    sentences' sizes alone.
    """

    @F.pandas_udf("array<struct<first:int,n:int>>")
    def ranges(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if x is None else [{"first": a, "n": n} for a, n in window_ranges(list(x), full, least, joined)] for x in b], dtype="object")

    split = F.transform(sentences, tokenize)
    labels = lambda t: F.when(F.size(t) > 0, F.concat(F.array_repeat(F.lit(0), F.size(t) - 1), F.array(F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def windows(both: Column) -> Column:
        part = lambda r: F.slice(both["t"], r["first"] + 1, r["n"])
        return F.transform(both["r"], lambda r, i: F.struct(i.alias("window_no"), F.flatten(part(r)).alias("tokens"), F.flatten(F.transform(part(r), labels)).alias("sbd_labels")))

    return let(F.struct(split.alias("t"), ranges(F.transform(sentences, lambda s: F.size(tokenize(s)))).alias("r")), windows)


@F.arrow_udf(ArrayType(IntegerType()))
def _ends(gaps: pa.Array, sizes: pa.Array) -> pa.Array:
    """Ends of a text's tokens, from their sizes and those of the gaps before them (one more gap, after the last, may follow)."""
    offsets, size = sizes.offsets.to_numpy().astype(np.int64), sizes.values.to_numpy(zero_copy_only=False)
    each = np.diff(offsets)
    inside = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], each)
    gap = gaps.values.to_numpy(zero_copy_only=False)[np.repeat(gaps.offsets.to_numpy()[:-1].astype(np.int64), each) + inside]
    sums = np.cumsum(np.concatenate([[0], gap + size[offsets[0] : offsets[-1]]]).astype(np.int64))
    before = np.repeat(sums[offsets[:-1] - offsets[0]], each)
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array((sums[1:] - before).astype(np.int32)))


@F.arrow_udf(ArrayType(IntegerType()))
def _touched(starts: pa.Array, stops: pa.Array, sizes: pa.Array, ends: pa.Array) -> pa.Array:
    """For each span (start, stop) of a text, the place of the first token that it touches, null where none, from the tokens' sizes and ends.

    All texts of a batch are looked up together: a place is its text's number in the upper bits and its offset in the lower.
    """
    tokens, spans = ends.offsets.to_numpy().astype(np.int64), starts.offsets.to_numpy().astype(np.int64)
    rows = np.arange(len(ends), dtype=np.int64) << 33
    end = ends.values.to_numpy(zero_copy_only=False).astype(np.int64)[tokens[0] : tokens[-1]] + np.repeat(rows, np.diff(tokens))
    first = sizes.offsets.to_numpy()
    begin = end - sizes.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]]
    start, stop = starts.values[spans[0] : spans[-1]], stops.values[stops.offsets[0].as_py() : stops.offsets[-1].as_py()]
    given = np.logical_and(*(x.is_valid().to_numpy(zero_copy_only=False) for x in (start, stop)))
    start, stop = (x.fill_null(0).to_numpy(zero_copy_only=False) + np.repeat(rows, np.diff(spans)) for x in (start, stop))
    low, high = (np.repeat(x - tokens[0], np.diff(spans)) for x in (tokens[:-1], tokens[1:]))
    at = np.maximum(np.searchsorted(end, start, side="right"), low)
    hit = given & (at < high)
    hit[hit] = begin[at[hit]] < stop[hit]
    return pa.ListArray.from_arrays(pa.array((spans - spans[0]).astype(np.int32)), pa.array((at - low).astype(np.int32), mask=~hit))


def token_sizes(text: Column) -> tuple[Column, Column]:
    """Sizes of the gaps before a text's tokens (and of what follows the last) and of the tokens, in code points."""
    return F.transform(F.split(text, P.TOKEN, -1), lambda x: F.length(x)), F.transform(tokenize(text), lambda x: F.length(x))


def token_offsets(text: Column) -> Column:
    """Array of (tok_no, tok, char_start, char_end) in code points: running lengths of tokens and the gaps before them."""
    both = F.arrays_zip(tokenize(text).alias("t"), _ends(*token_sizes(text)).alias("e"))
    return F.transform(both, lambda x, i: F.struct(i.alias("tok_no"), x["t"].alias("tok"), (x["e"] - F.length(x["t"])).alias("char_start"), x["e"].alias("char_end")))


def places_in(spans: Column, gaps: Column, sizes: Column) -> Column:
    """For each of a text's spans (start, end), in order, the number of the first token that it touches, null where none; gaps and sizes are token_sizes()."""
    return F.when(sizes.isNotNull() & spans.isNotNull(), _touched(F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]), sizes, _ends(gaps, sizes)))


def aligned_in(spans: Column, tokens: Column) -> Column:
    """Array of (span_no, start, end, tok_no, tok) from a text's spans (span_no, start, end) and its token_offsets(): the first token each touches, null where none.

    Offsets alone go through Arrow, where spans are looked up among the ends of tokens. No row leaves its place.
    """
    sizes, ends = F.transform(tokens, lambda t: t["char_end"] - t["char_start"]), F.transform(tokens, lambda t: t["char_end"])
    at = F.when(tokens.isNotNull(), _touched(F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]), sizes, ends))

    def found(both: Column) -> Column:
        def one(s: Column, n: Column) -> Column:
            t = F.get(both["t"], n)
            return F.struct(s["span_no"].alias("span_no"), s["start"].alias("start"), s["end"].alias("end"), t["tok_no"].alias("tok_no"), t["tok"].alias("tok"))

        return F.zip_with(both["s"], both["n"], one)

    return let(F.struct(spans.alias("s"), tokens.alias("t"), at.alias("n")), found)


def sentence_starts(token_rows: DataFrame, aligned_spans: DataFrame, keys: tuple[str, ...], first_too: bool = False) -> DataFrame:
    """Tokens with is_sent_start: the first token of a span, and with first_too the document's first."""
    starts = aligned_spans.where("tok_no IS NOT NULL").select(*keys, "tok_no").distinct().withColumn("_s", F.lit(True))
    out = token_rows.join(starts, [*keys, "tok_no"], "left").withColumn("is_sent_start", F.coalesce("_s", F.lit(False))).drop("_s")
    return out.withColumn("is_sent_start", F.col("is_sent_start") | (F.col("tok_no") == 0)) if first_too else out


def start_places(aligned: Column, first_too: bool = False) -> Column:
    """From aligned_in(): the places of tokens that begin a span, in order, and with first_too the text's first."""
    return distinct_places(F.transform(aligned, lambda s: s["tok_no"]), first_too)


def distinct_places(places: Column, first_too: bool = False) -> Column:
    """From places_in(): each place of a token that begins a span once, in order, and with first_too the text's first."""
    found = F.array_compact(places)
    return F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0)), found) if first_too else found))


def alignment_report(aligned_spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(act_id, successfully_aligned_sentences, failed_alignments_chars) for a look at the alignment."""
    rows = aligned_spans.join(texts, "act_id")
    good = F.struct("span_no", F.col("tok").alias("start_token_trigger"), sliced(F.col("text"), F.col("start"), F.col("end")).alias("extracted_span_text"))
    out = rows.groupBy("act_id").agg(F.array_sort(F.collect_list(F.when(F.col("tok_no").isNotNull(), good))).alias("g"), F.array_sort(F.collect_list(F.when(F.col("tok_no").isNull(), F.array("start", "end")))).alias("failed_alignments_chars"))
    return out.select("act_id", F.transform("g", lambda s: F.struct(s["start_token_trigger"].alias("start_token_trigger"), s["extracted_span_text"].alias("extracted_span_text"))).alias("successfully_aligned_sentences"), "failed_alignments_chars")
