"""A streaming source of weekly releases: offsets are release dates, a partition probes its date and the days before.

``fetch`` is given by the caller (``module:function``); it gets a date as text and returns the release's rows as dictionaries, or None
where nothing was released that day. A checkpointed query continues behind the dates it has committed; within a batch that failed, dates
that were fetched come from the cache, so no date is fetched twice.
"""

from __future__ import annotations

import importlib
import json
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidepanel.sources.cache import PayloadCache
from tidepanel.sources.rest import SourceError, with_retries

#: Days before a date that are probed too when nothing was released on it.
BACK = 6


class NoRelease(SourceError):
    """Neither the date nor the days before it have a release."""


def friday_at_or_before(day: date) -> date:
    return day - timedelta(days=(day.weekday() - 4) % 7)


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "release_history"

    def schema(self) -> str:
        return "date date, release_date date, ticker string, payload string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return HistoryReader(self.options)


class HistoryReader(DataSourceStreamReader):
    """Options: ``fetch``, ``first`` (a date), ``last`` (None: today), ``cache`` (a folder), ``back``, ``key`` (field of the ticker), ``missing`` (fail or skip)."""

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.first = date.fromisoformat(self.options["first"])
        self.back = int(self.options.get("back", BACK))
        self.field = self.options.get("key", "ticker")

    def initialOffset(self) -> dict:
        return {"date": (friday_at_or_before(self.first - timedelta(days=1))).isoformat()}

    def latestOffset(self) -> dict:
        last = self.options.get("last")
        end = friday_at_or_before(date.fromisoformat(last) if last else date.today())
        return {"date": max(end.isoformat(), self.initialOffset()["date"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        day, last = date.fromisoformat(start["date"]) + timedelta(days=7), date.fromisoformat(end["date"])
        out = []
        while day <= last:
            out.append(InputPartition(day.isoformat()))
            day += timedelta(days=7)
        return out

    def read(self, partition: InputPartition):
        cache = PayloadCache(self.options.get("cache"))
        target = partition.value
        found = cache.get("release", target)
        if found is None:
            found = self._probe(date.fromisoformat(target))
            cache.put(found, "release", target)
        for row in found["rows"]:
            yield date.fromisoformat(target), date.fromisoformat(found["date"]), str(row.get(self.field)), json.dumps(row)

    def _probe(self, target: date) -> dict:
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for days in range(self.back + 1):
            day = (target - timedelta(days=days)).isoformat()
            rows = with_retries(lambda day=day: fetch(day), wait_s=float(self.options.get("wait", 0.5)))
            if rows is not None:
                return {"date": day, "rows": rows}
        if self.options.get("missing", "fail") == "skip":
            return {"date": target.isoformat(), "rows": []}
        raise NoRelease(f"no release within {self.back} days of {target}")

    def commit(self, end: dict) -> None:
        """Nothing to do: the query's checkpoint holds the date, and the cache may serve other queries."""


def first_of_duplicates(history: DataFrame) -> DataFrame:
    """One row for each date and ticker: of a ticker listed twice the first, by release date, then by payload."""
    w = Window.partitionBy("date", "ticker").orderBy("release_date", "payload")
    return history.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
