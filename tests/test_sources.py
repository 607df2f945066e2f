"""The binary format's two phases, the stream of acts, and polite fetching, against servers of this test's own."""

import contextlib
import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from clausecut.sources import polite, token_docs
from clausecut.streaming import acts

DOCS = "doc string, tokens array<string>, starts array<int>"


def test_token_docs_are_read_back(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(f"d{i}", [f"t{i % 5}", "ż", None, "", "x" * i], [0, i]) for i in range(50)] + [("none", None, None), (None, [], [])]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    token_docs.write(df, path)
    told = lambda: sorted(((r.doc, r.tokens, r.starts) for r in token_docs.read(spark, path).collect()), key=str)
    assert told() == sorted(rows, key=str)
    token_docs.write(spark.createDataFrame([(7, ["a"], [0])], "id long, w array<string>, s array<long>"), path, doc="id", tokens="w", starts="s")
    assert told() == sorted([*rows, ("7", ["a"], [0])], key=str)
    token_docs.write(df.limit(2), path, mode="overwrite")
    assert len(told()) == 2 and not [f for f in os.listdir(path) if f.startswith(("_staging", "_draft"))]
    assert len([f for f in os.listdir(path) if f.endswith(".arrow")]) == len(json.loads((tmp_path / "docs" / token_docs.MANIFEST).read_text())["files"])
    token_docs.write(df.limit(0), f"file://{path}")
    assert len(told()) == 2


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "docs")
    token_docs.write(spark.createDataFrame([("a", ["x"], [0])], DOCS), path)
    before = sorted(os.listdir(path))
    bad = spark.range(40, numPartitions=4).select(F.col("id").cast("string").alias("doc"), F.array(F.when(F.col("id") < 35, "x").otherwise(F.raise_error(F.lit("broken")))).alias("tokens"), F.array(F.lit(0)).alias("starts"))
    with pytest.raises(Exception, match="broken"):
        token_docs.write(bad, path)
    assert sorted(os.listdir(path)) == before and token_docs.read(spark, path).count() == 1
    # tasks that wrote, and a driver that was lost before the commit: readers see the table as it was
    writer = token_docs.TokenDocsWriter(path, False)
    import pyarrow as pa

    writer.write(iter([pa.RecordBatch.from_pydict({"doc": ["b"], "tokens": [["y"]], "starts": [[0]]})]))
    assert token_docs.read(spark, path).count() == 1
    writer.abort([])
    assert sorted(os.listdir(path)) == before


@pytest.mark.parametrize(("new", "old", "left"), [([[1, 9]], [], [[1, 9]]), ([[1, 9]], [[1, 9]], []), ([[1, 9]], [[2, 3], [6, 6]], [[1, 1], [4, 5], [7, 9]]), ([[1, 3], [5, 8]], [[2, 6]], [[1, 1], [7, 8]]), ([], [[1, 2]], [])])
def test_ranges(new, old, left):
    assert acts.without(new, old) == left
    assert acts.ranges([5, 1, 2, 2, 7, 6]) == [[1, 2], [5, 7]]


class Server:
    """Answers from a function of path and number of requests so far; keeps when each came."""

    def __init__(self, answer):
        times, lock = self.times, _ = [], threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                with lock:
                    times.append((time.time(), self.path))
                    code, body, headers = answer(self.path, len(times))
                self.send_response(code)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


def test_acts_come_once(spark, tmp_path):
    index = {"2020": [1, 2, 5], "2021": []}
    down = set()

    def answer(path, _):
        year = path.strip("/")
        if year in down:
            return 500, b"", {}
        return 200, json.dumps({"items": [{"pos": p, "title": f"{year}/{p}", "textPDF": p % 2 == 1} for p in index[year]]}).encode(), {}

    server = Server(answer)

    def run():
        """Starts, takes what is there, and stops."""
        rows = acts.new_acts(spark, server.url + "/{year}", [2020, 2021])
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.year, r.pos) for r in spark.read.schema("year int, pos int, title string, textPDF boolean").parquet(str(tmp_path / "out")).collect())

    assert run() == [(2020, 1), (2020, 2), (2020, 5)]
    assert run() == [(2020, 1), (2020, 2), (2020, 5)]  # a restart gives none twice
    index["2020"] += [3, 9]  # 3 comes late
    index["2021"] += [1]
    down.add("2020")
    with contextlib.suppress(Exception):  # a start while a year can't be asked fails or gives nothing; it does not forget what was given out
        run()
    down.clear()
    index["2020"].remove(2)  # taken from the index
    assert run() == [(2020, 1), (2020, 2), (2020, 3), (2020, 5), (2020, 9), (2021, 1)]
    reader = acts.NewActsReader({"url": server.url + "/{year}", "years": "2020"})
    assert reader.latestOffset() == {"2020": [[1, 1], [3, 3], [5, 5], [9, 9]]}
    down.add("2020")
    with pytest.raises(Exception, match="500"):
        acts.NewActsReader({"url": server.url + "/{year}", "years": "2020"}).latestOffset()
    assert reader.latestOffset() == {"2020": [[1, 1], [3, 3], [5, 5], [9, 9]]}  # as it was last seen
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.title, r.textPDF) for r in out.where("pos = 3").collect()} == {("2020/3", True)}
    server.server.shutdown()


def test_no_more_than_the_rate(spark, tmp_path):
    server = Server(lambda path, n: (200, path.encode(), {}))
    urls = spark.createDataFrame([(f"a{i}", f"{server.url}/{i}") for i in range(40)], "name string, url string").repartition(8)
    got = polite.fetched(urls, str(tmp_path / "p"), rate=20.0, lanes=8).collect()
    assert sorted((r.name, bytes(r.content).decode(), r.status) for r in got) == sorted((f"a{i}", f"/{i}", "done") for i in range(40))
    times = sorted(t for t, _ in server.times)
    assert len(times) == 40
    most = max(sum(a <= t < a + 1.0 for t in times) for a in times)
    assert most <= 22  # 20 slots a second, and the way of a request or two
    server.server.shutdown()


def test_retry_after_is_kept_between_rounds(spark, tmp_path):
    def answer(path, n):
        if n == 3:
            return 429, b"", {"Retry-After": "2"}
        return (404, b"", {}) if path == "/4" else (200, path.encode(), {})

    server, slept = Server(answer), []
    urls = spark.createDataFrame([(f"a{i}", f"{server.url}/{i}") for i in range(8)], "name string, url string")
    part = polite.fetched(urls, str(tmp_path / "p"), rate=50.0, lanes=1, rounds=1)
    assert 0 < part.where("status = 'later'").count() < 8  # a run that broke off after a round
    busy = server.times[2][0]

    def sleep(s):
        slept.append(s)
        time.sleep(s)

    got = {r.name: (r.status, r.content and bytes(r.content).decode()) for r in polite.fetched(urls.limit(0), str(tmp_path / "p"), rate=50.0, lanes=1, sleep=sleep).collect()}
    assert got == {f"a{i}": ("done", f"/{i}") if i != 4 else ("failed: HTTP 404", None) for i in range(8)}
    after = [t for t, _ in server.times[3:]]
    assert min(after) >= busy + 1.9 and len(server.times) == 9  # left alone as long as asked, and nothing asked twice but the one that was refused
    server.server.shutdown()


def test_tries_end(spark, tmp_path):
    server = Server(lambda path, n: (429, b"", {"Retry-After": "0"}))
    urls = spark.createDataFrame([("a", f"{server.url}/1"), ("b", "http://127.0.0.1:1/x")], "name string, url string")
    got = {r.name: r.status for r in polite.fetched(urls, str(tmp_path / "p"), rate=50.0, tries=2).collect()}
    assert got["a"] == "failed: HTTP 429" and got["b"].startswith("failed: URLError") and len(server.times) == 2
    server.server.shutdown()
