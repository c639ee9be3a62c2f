"""Command line: `python -m spanloom.cli INPUT OUTPUT` analyses trace documents and writes profiles, statistics and renderings;
`python -m spanloom.cli --download URL OUTPUT --service S` fetches documents first, into OUTPUT."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanloom import analysis, ship
from spanloom.config import Knobs
from spanloom.errors import NoTraceIds
from spanloom.sources import search, traces


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("input", help="folder or file of trace documents (JSON, or Parquet with a column `document` or nested rows)")
    p.add_argument("output", help="folder for the results")
    p.add_argument("--service", "-s", default="")
    p.add_argument("--operation", "-o", default="")
    p.add_argument("--root-trace", action="store_true", help="analyse only traces whose one root matches")
    p.add_argument("--light", action="store_true", help="profile and folded stacks only")
    p.add_argument("--errors-only", action="store_true", help="flame graphs of errors only")
    p.add_argument("--ranges", action="store_true", help="flame graphs over more ranges of latency")
    p.add_argument("--no-slack", action="store_true", help="leave out slack, drag and dependencies")
    p.add_argument("--exclude", help="YAML of {service: [operation, ...]} to leave out")
    p.add_argument("--tags", help="YAML list of {name, value, search_depth}: flame graphs of traces that hold the tag")
    p.add_argument("--test-services", nargs="*", default=[], help="leave out traces with spans of these")
    p.add_argument("--test-prefixes", nargs="*", default=[], help="leave out traces with operations that begin so")
    p.add_argument("--delta", type=int, default=0, help="microseconds by which the target's spans change")
    p.add_argument("--delta-service")
    p.add_argument("--delta-operation")
    p.add_argument("--strategy", default="series", choices=("series", "generic", "pessimistic", "optimistic"))
    p.add_argument("--overlap", type=float, default=0.01)
    p.add_argument("--exemplars", type=int, default=3)
    p.add_argument("--top", type=int, default=5)
    p.add_argument("--heat-traces", type=int, default=100)
    p.add_argument("--heat-ops", type=int, default=100)
    p.add_argument("--anonymise", action="store_true")
    p.add_argument("--link", default="", help="put before trace ids in the report")
    p.add_argument("--download", action="store_true", help="INPUT is the address of a query service: fetch traces into OUTPUT and stop")
    p.add_argument("--limit", type=int, default=1000, help="traces to fetch")
    p.add_argument("--start", type=int, help="epoch microseconds; by default --lookback-days before the end")
    p.add_argument("--end", type=int, help="epoch microseconds; by default now less --skip-minutes")
    p.add_argument("--lookback-days", type=float, default=1)
    p.add_argument("--skip-minutes", type=float, default=10)
    p.add_argument("--midnight", action="store_true", help="end at the last midnight UTC")
    p.add_argument("--qps", type=float, default=500)
    p.add_argument("--fields", help="projection of documents, passed on to the service")
    a = p.parse_args(argv)
    if bool(a.delta_service) != bool(a.delta_operation):
        p.error("--delta-service and --delta-operation belong together")
    if a.delta_service and not a.delta:
        p.error("--delta must not be 0 where a target is given")
    return a


def request(a: argparse.Namespace) -> analysis.Request:
    knobs = Knobs(
        root=(a.service, a.operation) if a.service else None, sole_root=a.root_trace, excluded=traces.exclusions(traces.read_yaml(a.exclude)) if a.exclude else frozenset(), overlap=a.overlap,
        test_services=frozenset(a.test_services), test_prefixes=tuple(a.test_prefixes), strategy=a.strategy,
    )
    return analysis.Request(
        knobs, "light" if a.light else "errors" if a.errors_only else "full", a.anonymise, a.ranges, not a.no_slack, a.exemplars, a.top, a.heat_traces, a.heat_ops, a.delta,
        (a.delta_service, a.delta_operation) if a.delta_service else None, tuple(traces.read_yaml(a.tags)) if a.tags else (), a.link,
    )


def window(a: argparse.Namespace, now: float) -> tuple[int, int]:
    """Start and end in epoch microseconds."""
    end = a.end if a.end is not None else int((now // 86400 * 86400 if a.midnight else now - a.skip_minutes * 60) * 1e6)
    return (a.start if a.start is not None else end - int(a.lookback_days * 86400e6)), end


def download(spark: SparkSession, a: argparse.Namespace) -> dict[int, int]:
    """Write the documents found as Parquet (trace_id, status, document); how many downloads ended with which status."""
    search.register(spark)
    start, end = window(a, time.time())
    options = {"url": a.input, "service": a.service, "start": str(start), "end": str(end), "limit": str(a.limit), "qps": str(a.qps)} | ({"operation": a.operation} if a.operation else {}) | ({"fields": a.fields} if a.fields else {})
    spark.read.format("trace_search").options(**options).load().write.mode("overwrite").parquet(a.output)
    got = {r["status"]: r["n"] for r in search.histogram(spark.read.parquet(a.output)).collect()}
    if not got:
        raise NoTraceIds(f"{a.service} {a.operation}")
    return got


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments(argv)
    spark = ship.ensure(spark or SparkSession.builder.appName("spanloom").getOrCreate())
    if a.download:
        for status, n in sorted(download(spark, a).items()):
            print(f"status {status}: {n}")
        return
    done = analysis.run(spark, traces.any_spans(spark, a.input), a.output, request(a))
    print("\n".join(sorted(done.values())))


if __name__ == "__main__":
    main()
