"""python -m clausecut silver|gold|extract|acquire|train|segment: datasets from folders and annotation files, documents from an act index, a model from a dataset, sentences from a model or another scorer.

Parsers and scorers are given as module:function. acquire leaves out acts that the output already has.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clausecut.operators import gold, layout, metrics
from clausecut.plans import acquire as acquiring
from clausecut.plans import infer, train
from clausecut.plans.engine import silver
from clausecut.sources import io
from clausecut.sources.models import Models


def silver_dataset(spark: SparkSession, texts: str, output: str, single_line: bool = False, test_years: tuple[int, ...] = (2025,)) -> None:
    """Windows of a corpus, split by year; prints a line of statistics for each split."""
    docs = io.texts(spark, texts, test_years=test_years).select("path", "split", "text")
    io.write_windows(silver(docs, single_line), output)
    for r in metrics.window_stats(io.read_windows(spark, output), "split").withColumn("line", metrics.stats_line(F.col("split"))).collect():
        print(r.line)


def gold_dataset(spark: SparkSession, annotations: str, texts: str, output: str) -> None:
    spans = gold.spans(io.annotations(spark, annotations))
    docs = gold.gold_sentences(gold.with_texts(spans, io.texts(spark, texts, universal=False).select("path", "text")))
    docs.select("act_id", F.explode(gold.packed(F.col("sentences"))).alias("w")).select("act_id", "w.*").write.mode("overwrite").parquet(output)


def extract(spark: SparkSession, annotations: str, texts: str, output: str) -> None:
    spans = gold.spans(io.annotations(spark, annotations))
    io.write_json(gold.extracted(gold.with_texts(spans, io.texts(spark, texts).select("path", "text"))), output)


def named(path: str) -> Callable:
    module, _, function = path.partition(":")
    return getattr(importlib.import_module(module), function)


def acquire(spark: SparkSession, url: str, years: list[int], parser: Callable, output: str, workers: int = 5, raw: bool = False, pdf: str | None = None) -> None:
    """Documents of acts to output (name, status, text), appended to what is there; prints how many came out how. pdf keeps the files themselves, raw the pages' own text."""
    spark.dataSource.register(io.ActIndex)
    acts = spark.read.format("act_index").options(url=url, years=",".join(map(str, years))).load()
    try:
        done = spark.read.parquet(output).where("status = 'done'").select("name")
    except AnalysisException:  # nothing there yet
        done = None

    def fetched(new):
        got = io.fetched(new.repartition(workers))
        if pdf:
            got.where("content IS NOT NULL").select("name", "content").write.mode("append").parquet(pdf)
            got = got.where("content IS NULL").select("name", "path", "content", "status").unionByName(spark.read.parquet(pdf).join(new.select("name", F.col("url").alias("path")), "name").select("name", "path", "content", F.lit("done").alias("status")))
        return got

    out = acquiring.acquired(acts.where("error IS NULL"), parser, done, fetched)
    if raw:
        got = fetched(io.to_fetch(acts.where("error IS NULL"), done))
        texts = acquiring.raw_documents(layout.parsed(got.where("content IS NOT NULL").select("path", "content"), parser, acquiring.PARSED))
        out = got.join(texts, "path", "left").select("name", "status", "text")
    out.where("status <> 'skipped (exists)'").write.mode("append").parquet(output)
    for r in spark.read.parquet(output).groupBy("status").count().orderBy("status").collect():
        print(f"{r['status']}: {r['count']}")
    for r in acts.where("error IS NOT NULL").select("year", "error").collect():  # a row a year at most
        print(f"{r['year']}: {r['error']}")


def training(spark: SparkSession, windows: str, output: str, **parameters) -> None:
    """Trains on the windows of split train, selects on those of split test, and prints what is told of the current version. A run that broke off goes on."""
    rows = io.read_windows(spark, windows)
    models = train.fit(rows.where("split = 'train'"), rows.where("split = 'test'"), output, train.Training(**parameters), "path", "window_no")
    told = models.told(models.current())
    print(f"version {models.current()}: F1 {told['f1']:.4f}, precision {told['precision']:.4f}, recall {told['recall']:.4f}")


def segment(spark: SparkSession, texts: str, scorer: Callable | None, output: str, model: str | None = None) -> None:
    """Sentences of texts by a trained model or another scorer, and a line for each document."""
    by = train.by_current(Models(spark, f"{model.rstrip('/')}/models")) if model else None
    sentences, summary = infer.segmented(io.texts(spark, texts).select("path", "text"), scorer, "path", by=by)
    sentences.write.mode("overwrite").parquet(output)
    summary.orderBy("path").show(1000, truncate=False)


def years(given: list[str]) -> list[int]:
    """2015 2018-2020 as years."""
    ranges = [x.partition("-") for x in given]
    return [y for a, _, b in ranges for y in range(int(a), int(b or a) + 1)]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="clausecut")
    commands = parser.add_subparsers(dest="command", required=True)
    s = commands.add_parser("silver")
    s.add_argument("--single-line", action="store_true")
    s.add_argument("--test-years", type=int, nargs="*", default=[2025])
    for name in ("gold", "extract"):
        commands.add_parser(name).add_argument("--annotations", required=True)
    g = commands.add_parser("segment").add_mutually_exclusive_group(required=True)
    g.add_argument("--scorer", help="module:function")
    g.add_argument("--model", help="the output of train")
    t = commands.add_parser("train")
    t.add_argument("--windows", required=True, help="the output of silver")
    t.add_argument("--epochs", type=int, default=1)
    t.add_argument("--batches", type=int, default=20)
    q = commands.add_parser("acquire")
    q.add_argument("years", nargs="*", default=["2015-2025"])
    q.add_argument("--index", required=True, help="the index's address, with {year}")
    q.add_argument("--parser", required=True)
    q.add_argument("--workers", type=int, default=5)
    q.add_argument("--raw", action="store_true")
    q.add_argument("--pdf", help="a folder for the files themselves")
    for name, c in commands.choices.items():
        if name not in ("acquire", "train"):
            c.add_argument("--texts", required=True)
        c.add_argument("--output", required=True)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("clausecut").getOrCreate()
    if a.command == "silver":
        silver_dataset(spark, a.texts, a.output, a.single_line, tuple(a.test_years))
    elif a.command == "gold":
        gold_dataset(spark, a.annotations, a.texts, a.output)
    elif a.command == "extract":
        extract(spark, a.annotations, a.texts, a.output)
    elif a.command == "segment":
        segment(spark, a.texts, named(a.scorer) if a.scorer else None, a.output, a.model)
    elif a.command == "train":
        training(spark, a.windows, a.output, epochs=a.epochs, batches=a.batches)
    else:
        acquire(spark, a.index, years(a.years), named(a.parser), a.output, a.workers, a.raw, a.pdf)


if __name__ == "__main__":
    main()
