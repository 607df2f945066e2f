"""Sources, sinks, the stream, and the queries against SQL."""

import io as bytes_io
import json
import subprocess
import sys
import urllib.error
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clausecut.plans import queries as Q
from clausecut.sources import io
from clausecut.streaming import corpus


def test_texts(spark, tmp_path):
    for year in (2019, 2025):
        (tmp_path / str(year)).mkdir()
        (tmp_path / str(year) / f"act_{year}_5_x_clean.txt").write_bytes(b"a\r\nb\rc")
    (tmp_path / "2019" / "act_2019_5_x_raw.txt").write_text("raw")
    rows = io.texts(spark, str(tmp_path)).orderBy("year").collect()
    assert [(r.year, r.act_id, r.split, r.text) for r in rows] == [(2019, "act_2019_5", "train", "a\nb\nc"), (2025, "act_2025_5", "test", "a\nb\nc")]
    assert io.texts(spark, str(tmp_path), universal=False).first().text == "a\r\nb\rc"
    assert io.file_names(spark, str(tmp_path)).count() == 3
    files = io.file_names(spark, str(tmp_path))
    d = files.first().path.rsplit("/", 2)[0]
    wanted = spark.createDataFrame([(f"{d}/2019/act_2019_5_x_clean.txt",), (f"{d}/2019/act_2019_5_clean.txt",), (f"{d}/2019/none_clean.txt",)], "path string")
    got = {r.wanted.rsplit("/")[-1]: r.path and r.path.rsplit("/")[-1] for r in io.wanted_files(files, wanted).collect()}
    assert got == {"act_2019_5_x_clean.txt": "act_2019_5_x_clean.txt", "act_2019_5_clean.txt": "act_2019_5_x_clean.txt", "none_clean.txt": None}


def test_act_index(spark, tmp_path):
    (tmp_path / "2020.json").write_text(json.dumps({"items": [{"pos": 1, "title": "A", "textPDF": True, "x": 1}, {"pos": 2}]}))
    spark.dataSource.register(io.ActIndex)
    rows = spark.read.format("act_index").option("url", f"file://{tmp_path}/{{year}}.json").option("years", "2020,2021").load().orderBy("year", "pos").collect()
    assert [tuple(r)[:4] for r in rows] == [(2020, 1, "A", True), (2020, 2, None, False), (2021, None, None, None)]
    assert rows[0].error is None and "URLError" in rows[2].error
    saved = io.acts_from_json(spark, str(tmp_path / "2020.json"), 2020)
    assert [tuple(r) for r in saved.collect()] == [(2020, 1, "A", True), (2020, 2, None, None)]
    assert [r.name for r in io.to_fetch(saved).collect()] == ["act_2020_1_A"] and io.to_fetch(saved, io.to_fetch(saved)).count() == 0


def test_fetch():
    def tries(*outcomes):
        left, slept = list(outcomes), []

        def get(url, timeout):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return bytes_io.BytesIO(x)

        return io.fetch("u", sleep=slept.append, get=get), slept

    busy = urllib.error.HTTPError("u", 429, "", {"Retry-After": "7"}, None)
    assert tries(b"x") == ((b"x", None), [])
    assert tries(busy, ConnectionError("c"), b"x") == ((b"x", None), [7, 2])
    assert tries(busy, busy, busy)[0][0] is None
    assert tries(urllib.error.HTTPError("u", 404, "", {}, None)) == ((None, "HTTP 404"), [])
    assert tries(ValueError("v")) == ((None, "ValueError: v"), [])


def test_sinks(spark, tmp_path):
    w = spark.createDataFrame([(["a"], [1], "train"), (["b"], [0], "test")], "tokens array<string>, sbd_labels array<int>, split string")
    io.write_windows(w, f"{tmp_path}/w")
    assert io.read_windows(spark, f"{tmp_path}/w").where("split = 'test'").first().tokens == ["b"]
    io.write_json(w, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    io.write_lines(w, "split", f"{tmp_path}/l")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/l").collect()) == ["test", "train"]
    io.write_segmented(spark.createDataFrame([("d", 1, "B."), ("d", 0, "A.")], "doc string, sent_id long, sentence string"), f"{tmp_path}/s")
    assert next(Path(f"{tmp_path}/s/doc=d").glob("*.txt")).read_text() == "A. [SBD_END]\nB. [SBD_END]\n"
    io.write_documents(spark.createDataFrame([(2020, "t")], "year int, text string"), f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d").first().text == "t"


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, "Pierwsze zdanie tekstu jest tutaj. Drugie zdanie tekstu jest tam. Koniec.") for i in range(5)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    for single in (False, True):
        q = corpus.write_windows(corpus.documents(spark, f"{tmp_path}/in"), f"{tmp_path}/out{single}", f"{tmp_path}/c{single}", single)
        q.awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out{single}").count() == 5


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", Q.QUERIES)
def test_queries(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got or name == "short_segments"
    if name in Q.SQL:
        r = duck.execute(Q.SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(x[names.index(c)] for c in columns)) for x in r.fetchall())


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_optional_parts():
    """The entry imports when the optional folder and the pipeline are gone."""
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('clausecut.llm') or name == 'corpus_pipeline':\n"
        "            raise ImportError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.oracle_sql()\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent).returncode == 0


def test_sliced_counts_code_points(spark):
    from clausecut.operators.gold import sliced

    assert spark.createDataFrame([("a😀bc",)], "t string").select(sliced(F.col("t"), F.lit(1), F.lit(3))).first()[0] == "😀b"
