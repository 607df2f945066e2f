"""Sources and sinks: act indexes, text corpora, annotations, PDFs, and datasets."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from clausecut import patterns as P
from clausecut.functions.text import basename, newlines
from clausecut.operators.clean import act_id, act_name, act_url

ACT = "pos int, title string, textPDF boolean"
ANNOTATIONS = (
    "id long, file_upload string, data struct<text:string>, "
    "annotations array<struct<id:long,was_cancelled:boolean,ground_truth:boolean,result:array<struct<id:string,type:string,value:struct<start:int,end:int,labels:array<string>>>>>>"
)


class ActIndex(DataSource):
    """Acts listed by a legal-acts service, a partition a year: options url (with {year}), years (comma-joined) and timeout.

    A year that can't be fetched gives one row with error set instead of failing the job.
    """

    @classmethod
    def name(cls) -> str:
        return "act_index"

    def schema(self) -> str:
        return f"year int, {ACT}, error string"

    def reader(self, schema) -> DataSourceReader:
        return ActIndexReader(self.options)


class Year(InputPartition):
    def __init__(self, year: int):
        self.year = year


class ActIndexReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.timeout = options["url"], float(options.get("timeout", 10))
        self.years = [int(y) for y in options["years"].split(",")]

    def partitions(self) -> list[Year]:
        return [Year(y) for y in self.years]

    def read(self, partition: Year) -> Iterator[tuple]:
        try:
            ask = urllib.request.Request(self.url.format(year=partition.year), headers={"Accept": "application/json"})
            with urllib.request.urlopen(ask, timeout=self.timeout) as answer:
                items = json.load(answer).get("items", [])
        except Exception as e:  # noqa: BLE001  every failure becomes a row
            yield (partition.year, None, None, None, f"{type(e).__name__}: {e}")
            return
        for x in items:
            yield (partition.year, x.get("pos"), x.get("title"), bool(x.get("textPDF")), None)


def acts_from_json(spark: SparkSession, path: str, year: int) -> DataFrame:
    """A saved index: one JSON object with items."""
    read = spark.read.schema(f"items array<struct<{ACT.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    return read.select(F.lit(year).alias("year"), F.explode("items").alias("i")).select("year", "i.*")


def fetch(url: str, tries: int = 3, timeout: float = 15, sleep=time.sleep, get=urllib.request.urlopen) -> tuple[bytes | None, str | None]:
    """A file's bytes, or why there are none. A busy service is asked again after the time it names, a broken connection after 1, 2, 4 ... seconds; both use up a try. Other errors end it."""
    why = "no tries left"
    for k in range(tries):
        try:
            with get(url, timeout=timeout) as answer:
                return answer.read(), None
        except urllib.error.HTTPError as e:
            why = f"HTTP {e.code}"
            if e.code != 429:
                return None, why
            sleep(int(e.headers.get("Retry-After", 5)))
        except (urllib.error.URLError, ConnectionError) as e:
            why = f"{type(e).__name__}: {e}"
            sleep(2**k)
        except Exception as e:  # noqa: BLE001  the caller gets a row
            return None, f"{type(e).__name__}: {e}"
    return None, why


def to_fetch(acts: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Acts with a PDF, with name and url, less those whose name is in done."""
    out = acts.where("textPDF").withColumn("name", act_name(F.col("year"), F.col("pos"), F.col("title"))).withColumn("url", act_url(F.col("year"), F.col("pos")))
    return out if done is None else out.join(done.select("name").distinct(), "name", "left_anti")


def fetched(acts: DataFrame, tries: int = 3) -> DataFrame:
    """name, path, content, status: what to_fetch() listed, read over the network in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [fetch(u, tries) for u in b["url"]]
            yield pd.DataFrame({"name": b["name"], "path": b["url"], "content": [x for x, _ in got], "status": ["done" if w is None else f"failed: {w}" for _, w in got]})

    return acts.select("name", "url").mapInPandas(run, "name string, path string, content binary, status string")


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path).select("path", "content")


def file_names(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths under a folder, without reading the files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")


def split_of(year: Column, test_years: tuple[int, ...]) -> Column:
    return F.when(year.isin(*test_years), "test").otherwise("train")


def texts(spark: SparkSession, paths: str | list[str], universal: bool = True, test_years: tuple[int, ...] = (2025,)) -> DataFrame:
    """(path, year, act_id, split, text): whole files named *_clean.txt. split is test for test_years, else train."""
    read = spark.read.text(paths, wholetext=True, pathGlobFilter="*_clean.txt", recursiveFileLookup=True)
    out = read.select(F.col("_metadata.file_path").alias("path"), newlines(F.col("value"), universal).alias("text"))
    year = F.regexp_extract(basename(F.col("path")), r"act_(\d+)_\d+", 1).try_cast("int")
    return out.select("path", year.alias("year"), act_id(F.col("path")).alias("act_id"), split_of(year, test_years).alias("split"), "text")


def wanted_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted path: itself if it is among files, else the first file, by name, in its folder whose name holds its stem; else null.

    The join is on the folder, so only files of one folder meet.
    """
    folder = lambda c: F.regexp_extract(c, r"^(.*/)", 1)
    both = wanted.select(F.col("path").alias("wanted"), folder(F.col("path")).alias("_d"), F.replace(basename(F.col("path")), F.lit("_clean.txt"), F.lit("")).alias("_s")).join(files.select("path", folder(F.col("path")).alias("_d")), "_d", "left")
    fits = F.contains(basename(F.col("path")), F.col("_s"))
    best = both.groupBy("wanted").agg(F.max(F.when(F.col("path") == F.col("wanted"), F.col("path"))).alias("_own"), F.min(F.when(fits, F.col("path"))).alias("_other"))
    return best.select("wanted", F.coalesce("_own", "_other").alias("path"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATIONS).option("multiLine", True).json(path)


def write_windows(windows: DataFrame, path: str, by: tuple[str, ...] = ("split",)) -> None:
    windows.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_segmented(sentences: DataFrame, path: str, key: str = "doc") -> None:
    """Segmented text: a sentence a line, each with the end mark; a folder for each document."""
    rows = sentences.select(key, "sent_id", F.concat("sentence", F.lit(P.SENTENCE_END)).alias("value"))
    rows.repartition(key).sortWithinPartitions(key, "sent_id").select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").partitionBy("year").parquet(path)


def log_metrics(metrics: DataFrame, path: str, run: str, **params: object) -> None:
    """Appends a run's figures to a log: a row for each metric and number, with the run's name, time and parameters. Other columns name the row."""
    kinds = dict(metrics.dtypes)
    numbers = [c for c, k in kinds.items() if k in ("int", "bigint", "float", "double")]
    names = F.map_from_arrays(F.array(*[F.lit(c) for c in kinds if c not in numbers]), F.array(*[F.col(c).cast("string") for c in kinds if c not in numbers])) if len(numbers) < len(kinds) else F.create_map().cast("map<string,string>")
    given = F.create_map(*[F.lit(str(x)) for kv in sorted(params.items()) for x in kv]).cast("map<string,string>")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers]))
    rows = metrics.select(names.alias("of"), each.alias("m")).select(F.lit(run).alias("run"), F.current_timestamp().alias("at"), given.alias("params"), "of", "m.metric", "m.value")
    rows.write.mode("append").parquet(path)
