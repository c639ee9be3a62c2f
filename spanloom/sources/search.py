"""Traces searched and downloaded over HTTP, as a Spark data source: `spark.read.format("trace_search").option(...)`.

The time range is cut into slices of which each is asked for the full limit of trace ids, first with flag 1 and, if it has none, with flag 3; more than
the limit in all are cut in proportion. The ids are dealt out evenly as input partitions, so that downloads run wherever there are executors. Each reader keeps to its share of the request rate and retries what may succeed."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Statuses after which a request is tried again.
RETRY = {408, 425, 429, 500, 502, 503, 504}


class Share(InputPartition):
    """Trace ids to download, or the status of a slice whose search failed."""

    def __init__(self, ids: list[str], share: float, failed: int | None = None):
        self.ids, self.share, self.failed = ids, share, failed


def fetch(url: str, tries: int = 3, pause: float = 0.2, headers: dict | None = None) -> tuple[int, bytes]:
    """Status and body; the last failure's status (0 if there was no answer) and no body if all tries fail."""
    status = 0
    for i in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=30) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as e:
            status = e.code
            if status not in RETRY:
                break
        except OSError:
            status = 0
        time.sleep(pause * 2**i)
    return status, b""


def shares(counts: list[int], limit: int) -> list[int]:
    """How many of each slice's ids to take so that about `limit` remain in all, in proportion."""
    total = sum(counts)
    return counts if total <= limit else [n * limit // total for n in counts]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = {k.lower(): v for k, v in options.items()}
        self.only: set[str] | None = None
        for need in ("url", "service", "start", "end"):
            if need not in self.o:
                raise ValueError(f"option {need} is missing")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on trace_id by equality or a list are answered here: those traces are fetched without a search."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("trace_id",):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = ids if self.only is None else self.only & ids
            else:
                yield f

    def found(self, start: int, end: int, limit: int) -> tuple[int, list[str]]:
        """Status and distinct trace ids of a slice."""
        status = 0
        for flag in (1, 3):
            tags = json.loads(self.o.get("tags") or "{}") | {"jaeger.flags": str(flag)}
            query = {"service": self.o["service"], "start": start, "end": end, "limit": limit, "tags": json.dumps(tags)}
            query |= {k: self.o[k] for k in ("operation",) if k in self.o}
            status, body = fetch(f"{self.o['url']}/api/traces?{urllib.parse.urlencode(query)}")
            ids = list(dict.fromkeys(t["traceID"] for t in json.loads(body)["data"][:limit])) if status == 200 else []
            if ids:
                return status, ids
        return status, []

    def partitions(self) -> list[Share]:
        start, end, limit = int(self.o["start"]), int(self.o["end"]), int(self.o.get("limit", 1000))
        if self.only is not None:
            return [Share([i], 1 / len(self.only)) for i in sorted(self.only)]
        n = max(1, min(end - start, -(-limit // int(self.o.get("per_query", 1000)))))
        edges = [start + (end - start) * i // n for i in range(n + 1)]
        slices = [self.found(a, b, limit) for a, b in zip(edges, edges[1:])]
        ids = [x for (_, own), many in zip(slices, shares([len(own) for _, own in slices], limit)) for x in own[:many]]
        return [Share(ids[i::n], 1 / n) for i in range(n)] + [Share([], 1, status) for status, _ in slices if status != 200]

    def read(self, partition: Share) -> Iterator[tuple]:
        if partition.failed is not None:
            yield None, partition.failed, None
            return
        pause = 1 / (float(self.o.get("qps", 500)) * partition.share)
        for trace_id in partition.ids:
            status, trace = fetch(f"{self.o['url']}/api/traces/{trace_id}", headers={"X-Fields": self.o["fields"]} if "fields" in self.o else None)
            yield trace_id, status, trace.decode() if trace else None
            time.sleep(pause)


class TraceSearch(DataSource):
    """Columns: trace_id, status (of the download; with a null trace_id, of a slice's search), document (JSON text)."""

    @classmethod
    def name(cls) -> str:
        return "trace_search"

    def schema(self) -> str:
        return "trace_id string, status int, document string"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def histogram(downloaded: DataFrame) -> DataFrame:
    """status, n: how downloads ended."""
    return downloaded.groupBy("status").agg(F.count("*").alias("n"))


def register(spark: SparkSession) -> None:
    """Register the source; its filters are pushed down, which the session must allow."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceSearch)
