"""The act index as a stream: new acts of some years, each once, however often the query stops and starts.

An offset holds, for each year, which positions have been given out, as ranges. Positions rise, but an act may come late, with
a position below others; a single number would lose it. What lies between two offsets is asked for by position, so a batch
that is run again after a failure gives the same acts. Options as for act_index: url (with {year}), years, timeout.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from clausecut.sources.io import ACT


def ranges(positions: Iterable[int]) -> list[list[int]]:
    """Sorted ranges [first, last] of whole numbers."""
    out: list[list[int]] = []
    for p in sorted(set(positions)):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return out


def without(new: list[list[int]], old: list[list[int]]) -> list[list[int]]:
    """What the new ranges have and the old ones do not."""
    out = []
    for a, z in new:
        for b, y in old:
            if y < a or b > z:
                continue
            if b > a:
                out.append([a, b - 1])
            a = y + 1
            if a > z:
                break
        if a <= z:
            out.append([a, z])
    return out


class NewActs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "new_acts"

    def schema(self) -> str:
        return f"year int, {ACT}"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return NewActsReader(self.options)


class Positions(InputPartition):
    def __init__(self, year: int, wanted: list[list[int]]):
        self.year, self.wanted = year, wanted


class NewActsReader(DataSourceStreamReader):
    def __init__(self, options):
        self.url, self.timeout = options["url"], float(options.get("timeout", 10))
        self.years = [y.strip() for y in options["years"].split(",")]
        self.seen: dict = {}

    def _items(self, year: str | int) -> list[dict]:
        ask = urllib.request.Request(self.url.format(year=year), headers={"Accept": "application/json"})
        with urllib.request.urlopen(ask, timeout=self.timeout) as answer:
            return [x for x in json.load(answer).get("items", []) if x.get("pos") is not None]

    def initialOffset(self) -> dict:
        return {y: [] for y in self.years}

    def latestOffset(self) -> dict:
        """What the index has now. A year that can't be asked stays as it was last seen, and fails the query if this run has not seen it, as an offset that forgets it would give its acts again.

        An act that is taken from the index while the query runs stays given out; one that goes and comes back while it does not run comes again.
        """
        for y in self.years:
            try:
                now = [int(x["pos"]) for x in self._items(y)]
            except Exception:
                if y not in self.seen:
                    raise
                continue  # asked again at the next trigger
            old = [p for a, z in self.seen.get(y, []) for p in range(a, z + 1)]
            self.seen[y] = ranges([*old, *now])
        return {y: self.seen.get(y, []) for y in self.years}

    def partitions(self, start: dict, end: dict) -> list[Positions]:
        for y in self.years:  # after a restart, what was given out before is known from the offsets
            self.seen[y] = ranges(p for r in (start.get(y, []), end.get(y, []), self.seen.get(y, [])) for a, z in r for p in range(a, z + 1))
        parts = [Positions(int(y), without(end.get(y, []), start.get(y, []))) for y in self.years]
        return [p for p in parts if p.wanted]

    def read(self, partition: Positions) -> Iterator[tuple]:
        """The wanted acts; an error fails the task, which is tried again, so that none is lost."""
        for x in self._items(partition.year):
            if any(a <= int(x["pos"]) <= z for a, z in partition.wanted):
                yield (partition.year, int(x["pos"]), x.get("title"), bool(x.get("textPDF")))


def new_acts(spark: SparkSession, url: str, years: list[int]) -> DataFrame:
    spark.dataSource.register(NewActs)
    return spark.readStream.format("new_acts").options(url=url, years=",".join(map(str, years))).load()
