"""Fetching from many tasks at no more than a rate for each host.

Time is cut in slots of 1 / rate seconds, counted from the epoch. A host's addresses are dealt to lanes, and lane i of k may
send one request in each slot whose number leaves i when divided by k; so all lanes together send at most one a slot, on
any number of machines whose clocks agree, without asking each other. A lane is one task's at a time.

A host that asks to be left alone (429 with Retry-After) is: the lane gives back what it has left of that host, with the time
from which it may be asked again. That time, and how often an address has been tried, are columns of a table that is written
after every round, so no task sleeps it away, and a run that broke off goes on from the last round.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausecut.sources.models import Models

ROW = "name string, path string, host string, tries int, ready_at double, status string"


def _ask(url: str, timeout: float) -> tuple[bytes | None, str, float | None]:
    """Bytes, status and, if it may be asked again, after how many seconds."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.read(), "done", None
    except urllib.error.HTTPError as e:
        why = f"failed: HTTP {e.code}"
        if e.code != 429:
            return None, why, None
        wait = e.headers.get("Retry-After", "")
        return None, why, float(wait) if wait.strip().isdigit() else 5.0
    except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
        return None, f"failed: {type(e).__name__}: {e}", 0.0
    except Exception as e:  # noqa: BLE001  the caller gets a row
        return None, f"failed: {type(e).__name__}: {e}", None


def _round(rows: DataFrame, rate: float, lanes: int, tries: int, timeout: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        closed: dict[str, float] = {}
        used: dict[tuple[str, int], int] = {}
        for b in batches:
            out = []
            for name, path, host, n, ready, _, lane in b.itertuples(index=False):
                if closed.get(host, 0.0) > time.time():
                    out.append((name, path, host, n, closed[host], "later", None))
                    continue
                now = time.time()
                slot = max(int(now * rate) + 1, used.get((host, lane), -1) + 1)
                slot += (lane - slot) % lanes
                used[host, lane] = slot
                time.sleep(max(0.0, slot / rate - now))
                content, status, wait = _ask(path, timeout)
                ready = time.time()
                if wait is not None and n + 1 < tries:
                    status, ready = "later", ready + (wait or 2.0**n)
                    if wait:
                        closed[host] = ready
                out.append((name, path, host, n + 1, ready, status, content))
            yield pd.DataFrame(out, columns=["name", "path", "host", "tries", "ready_at", "status", "content"])

    dealt = rows.withColumn("lane", F.pmod(F.xxhash64("path"), F.lit(lanes).cast("long")).cast("int"))
    return dealt.repartition("host", "lane").sortWithinPartitions("host", "lane", "path").mapInPandas(run, f"{ROW}, content binary")


def fetched(acts: DataFrame, root: str, rate: float = 5.0, lanes: int = 4, tries: int = 3, timeout: float = 15.0, rounds: int | None = None, sleep=time.sleep) -> DataFrame:
    """name, path, content, status of acts (name, url). root holds the rounds; with the same root a run goes on, and acts are not read again."""
    spark: SparkSession = acts.sparkSession
    state, root = Models(spark, f"{root.rstrip('/')}/rounds"), root.rstrip("/")
    whole = state.versions()
    if not whole:
        host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
        first = acts.select(F.col("name"), F.col("url").alias("path"), host.alias("host"), F.lit(0).alias("tries"), F.lit(0.0).alias("ready_at"), F.lit("later").alias("status"))
        state.save(0, first, {"later": first.count()})
        whole = [0]
    at = whole[-1]
    while state.told(at)["later"] and (rounds is None or at < rounds):
        later = state.weights(at).where("status = 'later'")
        wait = later.agg(F.min("ready_at")).first()[0] - time.time()
        if wait > 0:
            sleep(wait)  # on the driver, when there is nothing that any task could ask for
        now = time.time()
        got = f"{root}/got/round={at + 1:06d}"
        _round(later.where(F.col("ready_at") <= now), rate, lanes, tries, timeout).write.mode("overwrite").parquet(got)
        rest = spark.read.parquet(got).drop("content").where("status = 'later'").unionByName(later.where(F.col("ready_at") > now))
        state.save(at + 1, rest, {"later": rest.count()})
        at += 1
    columns = ("name", "path", "content", "status")
    if at == 0:
        return state.weights(0).select("name", "path", F.lit(None).cast("binary").alias("content"), "status")
    out = spark.read.parquet(*[f"{root}/got/round={k:06d}" for k in range(1, at + 1)]).where("status <> 'later'").select(*columns)
    return out.unionByName(state.weights(at).where("status = 'later'").select("name", "path", F.lit(None).cast("binary").alias("content"), "status"))
