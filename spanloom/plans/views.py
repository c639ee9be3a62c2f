"""Views for SQL over traces: spans, nodes, profile and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.config import Knobs
from spanloom.operators import profile, tree
from spanloom.scratch import cut


def register(spark: SparkSession, spans: DataFrame, knobs: Knobs = Knobs(), prefix: str = "") -> list[str]:
    """Temporary views, under names that may begin with `prefix`: spans; nodes (tree.nodes); profile (per tree and call path); latency (ranked trees).
    Nodes are cut, so a query reads them and does not build trees again. Returns the names."""
    nodes = cut(tree.nodes(spans, knobs), "nodes")
    found = {"spans": spans, "nodes": nodes, "profile": profile.per_trace(nodes), "latency": profile.latency_ranks(profile.roots(nodes))}
    for name, df in found.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in found]
