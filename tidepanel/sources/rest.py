"""A batch data source for paged REST endpoints: throttled, cached, with filters on the symbol pushed into it.

``fetch`` is given by the caller (``module:function``); it gets the endpoint and a symbol and returns rows
as dictionaries. Retryable failures raise ``TransientError``.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterable

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from tidepanel.sources.cache import PayloadCache

#: Endpoints of the statements pull, with the table each fills (fixed values).
STATEMENTS = ("income", "balance", "cash", "ratios", "key_metrics", "growth", "ev")


class SourceError(Exception):
    """The endpoint cannot be read."""


class TransientError(SourceError):
    """Worth another try."""


def with_retries(call, tries: int = 4, wait_s: float = 0.5):
    for i in range(tries):
        try:
            return call()
        except TransientError:
            if i + 1 == tries:
                raise
            time.sleep(wait_s * 2**i)


class RestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "panel_rest"

    def schema(self) -> str:
        return "symbol string, payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RestReader(self.options)


class RestReader(DataSourceReader):
    """Options: ``endpoint``, ``fetch``, ``symbols`` (a list with commas), ``partitions`` (8), ``perMinute`` (calls of all partitions
    together; none: no limit), ``cache`` (a folder), ``refresh`` (true: read again), ``skipFailures``.

    Symbols are dealt to partitions, each of which may make its share of the calls: even if all run at once, the limit holds. A
    filter on ``symbol`` is taken over by the reader, so other symbols are never asked for.
    """

    def __init__(self, options: dict):
        found = {k.lower(): v for k, v in options.items()}
        self.endpoint, self.fetch = found["endpoint"], found["fetch"]
        self.symbols = list(dict.fromkeys(s.strip() for s in found.get("symbols", "").split(",") if s.strip()))
        self.most = max(int(found.get("partitions", 8)), 1)
        self.rate = float(found.get("perminute", 0))
        self.folder, self.refresh = found.get("cache"), found.get("refresh", "false").lower() == "true"
        self.skip = found.get("skipfailures", "false").lower() == "true"
        self.wait = float(found.get("wait", 0.5))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = [s for s in self.symbols if s in wanted]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        count = min(self.most, len(self.symbols))
        # what one partition must wait between calls
        return [InputPartition((self.symbols[i::count], 60 * count / self.rate if self.rate else 0.0)) for i in range(count)]

    def read(self, partition: InputPartition):
        module, _, name = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        symbols, pause = partition.value if partition else ([], 0.0)  # no partition stands for no symbol
        cache, due = PayloadCache(self.folder), time.monotonic()

        def call(symbol: str):
            nonlocal due
            wait = due - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            due = time.monotonic() + pause
            return fetch(self.endpoint, symbol)

        for symbol in symbols:
            rows = None if self.refresh else cache.get(self.endpoint, symbol)
            if rows is None:
                try:
                    rows = with_retries(lambda symbol=symbol: call(symbol), wait_s=self.wait)
                except SourceError:
                    if not self.skip:
                        raise
                    continue
                cache.put(rows, self.endpoint, symbol)
            for row in rows:
                yield (symbol, json.dumps(row))
