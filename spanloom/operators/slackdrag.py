"""Drag, slack and dependencies between siblings, from what the tree kernel says of each node and from one kernel over pairs of call paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.config import Knobs

from .profile import with_own_time
from .whatif import dependencies as path_pairs

TREE = ["trace_id", "root_id"]


def _drag():
    whole = F.col("adj_dur")
    gain = F.greatest(F.lit(0), F.least(whole, F.col("adj_end") - F.col("next_end")))
    return F.when(F.col("parent_id").isNull(), whole).otherwise(F.coalesce(gain, whole))


def drag(nodes: DataFrame) -> DataFrame:
    """On-path nodes with drag (how much sooner the parent would end without them) and drag_excl (their own share of it)."""
    rows = with_own_time(nodes).where("on_cp").withColumn("drag", _drag())
    tail = F.when(F.col("last_end").isNull(), F.col("adj_dur")).otherwise(F.greatest(F.lit(0), F.col("adj_end") - F.col("last_end")))
    return rows.withColumn("drag_excl", F.least(F.col("drag"), F.col("own"), tail)).select(*TREE, "span_id", "path", "adj_dur", "own", "drag", "drag_excl")


def dependencies(spans: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """trace_id, kind, path, other: `before` (other happens before path), `dependent` (path waits for the child path), `async` (the child
    path was seen ending with its parent or later)."""
    kinds = F.array_compact(F.array(F.when(F.col("before"), F.lit("before")), F.when(F.col("dependent"), F.lit("dependent")), F.when(F.col("detached"), F.lit("async"))))
    return path_pairs(spans, knobs).withColumn("kind", F.explode(kinds)).select("trace_id", "kind", "path", "other").distinct()


def aggregate_dependencies(spans: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """kind, path, other over all traces. A `before` edge stays unless some trace that comes after the first to show it has both paths
    and not the edge; traces without the other path say nothing. Dependents are those never seen async."""
    key = F.lpad("trace_id", 20, "0")
    of_trace = path_pairs(spans, knobs).groupBy("trace_id", "path", "other").agg(F.bool_or("before").alias("before"), F.bool_or("dependent").alias("dependent"), F.bool_or("detached").alias("detached"))
    pairs = of_trace.groupBy("path", "other").agg(
        F.min(F.when(F.col("before"), key)).alias("since"), F.max(F.when(~F.col("before"), key)).alias("against"), F.bool_or("dependent").alias("dependent"), F.bool_or("detached").alias("detached"))
    holds = F.coalesce(F.col("against") <= F.col("since"), F.col("since").isNotNull())
    kinds = F.array_compact(F.array(F.when(holds, F.lit("before")), F.when(F.col("dependent") & ~F.col("detached"), F.lit("dependent"))))
    return pairs.select(F.explode(kinds).alias("kind"), "path", "other")


def slack(nodes: DataFrame) -> DataFrame:
    """trace_id, root_id, span_id, path, slack: how much later a span could end without moving the critical path; 0 on it."""
    return nodes.select(*TREE, "span_id", "path", "slack")


def delays(nodes: DataFrame) -> DataFrame:
    """trace_id, root_id, span_id, path, start_delay (from a parent's start to its first child's) and end_delay (from its last child's end to its own)."""
    return nodes.where("n_children > 0").select(*TREE, "span_id", "path", (F.col("first_start") - F.col("adj_start")).alias("start_delay"), (F.col("adj_end") - F.col("last_end")).alias("end_delay"))


def by_path(nodes: DataFrame) -> DataFrame:
    """path, spans, drag, slack and their means over all traces."""
    gain = F.when(F.col("on_cp"), _drag()).otherwise(0)
    out = nodes.groupBy("path").agg(F.count("*").alias("spans"), F.sum(gain).alias("drag"), F.sum("slack").alias("slack"))
    return out.withColumns({"avg_drag": F.col("drag") / F.col("spans"), "avg_slack": F.col("slack") / F.col("spans")})
