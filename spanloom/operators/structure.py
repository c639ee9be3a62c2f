"""Structure of traces: cycles, fan-out, regions, completeness, tags, tests, split traces and windows compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import INCOMPLETE_WARNING
from spanloom.errors import MergeError
from spanloom.scratch import cut

TREE = ["trace_id", "root_id"]


def cycles(nodes: DataFrame) -> DataFrame:
    """trace_id, root_id, span_id, cycle: a client node whose operation occurs above it as a client; the path from its last occurrence."""
    met = nodes.where("cycle_at is not null")
    return met.select(*TREE, "span_id", F.slice("path", F.col("cycle_at"), F.size("path") - F.col("cycle_at") + 1).alias("cycle"))


def fan_out(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("service").agg(F.count("*").alias("spans"), F.sum("n_children").alias("calls"), F.max("n_children").alias("most"))


def plain_region(region):
    return F.regexp_replace(region, r"[^\p{L}]", "")


def cross_region(nodes: DataFrame) -> DataFrame:
    """Calls whose two ends lie in different regions (letters only): caller, callee, regions, n, time."""
    calls = nodes.select(F.col("parent_service").alias("caller"), F.col("service").alias("callee"), plain_region(F.col("parent_region")).alias("from_region"), plain_region(F.col("region")).alias("to_region"), "adj_dur")
    return calls.where("from_region <> to_region").groupBy("caller", "callee", "from_region", "to_region").agg(F.count("*").alias("n"), F.sum("adj_dur").alias("time"))


def completeness(spans: DataFrame) -> DataFrame:
    """trace_id, incomplete, services with orphan spans. `spans` has warnings array<string>."""
    bad = F.coalesce(F.exists("warnings", lambda w: F.contains(w, F.lit(INCOMPLETE_WARNING))), F.lit(False))
    return spans.groupBy("trace_id").agg(F.bool_or(bad).alias("incomplete"), F.sort_array(F.collect_set(F.when(bad, F.col("service")))).alias("services"))


def completeness_report(completeness: DataFrame) -> DataFrame:
    """One row: traces, incomplete, percent, and how many incomplete traces each service has orphans in (service=n, sorted)."""
    marked = cut(completeness, "completeness")
    per = marked.where("incomplete").select(F.explode("services").alias("service")).groupBy("service").agg(F.count("*").alias("n"))
    named = per.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "service", "n"))), ",")).scalar()
    return marked.agg(F.count("*").alias("traces"), F.count(F.when(F.col("incomplete"), 1)).alias("incomplete")).select("traces", "incomplete", F.try_divide(F.col("incomplete") * 100, F.col("traces")).alias("percent"), named.alias("services"))


def reachable_services(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(*TREE).agg(F.sort_array(F.collect_set("service")).alias("services"))


def test_traces(spans: DataFrame, services: list[str], prefixes: list[str]) -> DataFrame:
    """trace_id, is_test: a span of a test service, or whose operation has a test prefix."""
    hit = F.col("service").isin(services)
    for p in prefixes:
        hit = hit | F.startswith("op", F.lit(p))
    return spans.groupBy("trace_id").agg(F.bool_or(hit).alias("is_test"))


def tag_matches(nodes: DataFrame, tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """trace_id, root_id, matched: names of wanted tags (name, value, search_depth) found within their depth. `tags` has trace_id, span_id, name, value."""
    have = nodes.select(*TREE, "span_id", "depth").join(tags, ["trace_id", "span_id"])
    met = have.join(wanted, ["name", "value"]).where("depth <= search_depth")
    return met.groupBy(*TREE).agg(F.sort_array(F.collect_set(F.concat_ws("=", "name", "value"))).alias("matched"))


def span_tags(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, name, value of every tag; nothing where spans carry none."""
    if "tags" not in spans.columns:
        return spans.where("false").select("trace_id", "span_id", F.lit("").alias("name"), F.lit("").alias("value"))
    return spans.select("trace_id", "span_id", F.explode("tags").alias("t")).select("trace_id", "span_id", F.col("t.key").alias("name"), F.col("t.value").alias("value"))


def first_roots(spans: DataFrame) -> DataFrame:
    """trace_id, service, op of the first span without a parent."""
    return spans.where("parent_id is null").groupBy("trace_id").agg(F.min_by(F.struct("service", "op"), "span_ord").alias("r")).select("trace_id", "r.*")


def external_references(references: DataFrame) -> DataFrame:
    """References to other traces. `references` has trace_id, span_id, span_ord, ref_type, ref_trace_id, ref_span_id."""
    return references.where("ref_trace_id is not null and ref_trace_id <> trace_id")


def merge_split(parent: DataFrame, child: DataFrame, references: DataFrame) -> DataFrame:
    """Spans of parent traces with those of child traces that follow from them, under the parent's trace id and the linking span.

    Services and hosts stand on each span, so process ids need no renaming. A link to a span that the parent lacks raises MergeError."""
    link = external_references(references).where("ref_type = 'FOLLOWS_FROM'").groupBy("trace_id").agg(F.min_by(F.struct("span_id", "ref_trace_id", "ref_span_id"), "span_ord").alias("l"))
    link = link.select("trace_id", F.col("l.span_id").alias("link_id"), F.col("l.ref_trace_id").alias("to_trace"), F.col("l.ref_span_id").alias("to_span"))
    there = parent.select(F.col("trace_id").alias("to_trace"), F.col("span_id").alias("to_span")).distinct()
    if not link.join(parent.select(F.col("trace_id").alias("to_trace")).distinct(), "to_trace", "left_semi").join(there, ["to_trace", "to_span"], "left_anti").isEmpty():
        raise MergeError("a child trace follows from a span that its parent trace lacks")
    # Spans of the children come after the parent's, one child after the other in the order of their ids.
    last = parent.groupBy(F.col("trace_id").alias("to_trace")).agg((F.max("span_ord") + 1).alias("first"))
    sizes = child.groupBy("trace_id").agg((F.max("span_ord") + 1).alias("size")).join(link, "trace_id").join(last, "to_trace")
    before = Window.partitionBy("to_trace").orderBy("trace_id").rowsBetween(Window.unboundedPreceding, -1)
    moves = sizes.withColumn("shift", (F.col("first") + F.coalesce(F.sum("size").over(before), F.lit(0))).cast("int")).select("trace_id", "to_trace", "to_span", "link_id", "shift")
    moved = child.join(moves, "trace_id")
    moved = moved.withColumn("parent_id", F.when(F.col("span_id") == F.col("link_id"), F.col("to_span")).otherwise(F.col("parent_id"))).withColumn("span_ord", F.col("span_ord") + F.col("shift")).withColumn("trace_id", F.col("to_trace"))
    return parent.unionByName(moved.select(*parent.columns))


def collisions(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Span ids that both sides use."""
    return parent.select("span_id").intersect(child.select("span_id"))


def compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """path, calls and mean exclusive time of two merged profiles, and the change."""
    a = one.select("path", F.col("freq").alias("freq1"), F.col("avg_excl").alias("excl1"))
    b = two.select("path", F.col("freq").alias("freq2"), F.col("avg_excl").alias("excl2"))
    both = a.join(b, "path", "full_outer").na.fill(0, ["freq1", "excl1", "freq2", "excl2"])
    return both.withColumns({"freq_change": F.col("freq2") - F.col("freq1"), "excl_change": F.col("excl2") - F.col("excl1")})
