"""Latency statistics over traces: percentiles, heads and tails, shares of operations, summaries, heatmap.

Percentiles are exact and interpolated; they come from distributed ranks (plans.ranks), so no task holds all traces or all of an operation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.plans.ranks import at_share, ranked
from spanloom.scratch import cut

from .profile import by_op

TREE = ["trace_id", "root_id"]
DEPTHS = {"min": 0.0, "max": 1.0, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def points(ranks: DataFrame, of: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """percentile, latency: exact, interpolated."""
    got = ranks.agg(*(at_share("latency", q).alias(f"_{i}") for i, q in enumerate(of)))
    return got.select(F.explode(F.array(*(F.struct(F.lit(q).alias("percentile"), F.col(f"_{i}").alias("latency")) for i, q in enumerate(of)))).alias("x")).select("x.*").where("latency is not null")


def heads_and_tails(ranks: DataFrame, percents: tuple[int, ...] = (1, 5, 10, 50, 100), value: str = "latency") -> DataFrame:
    """percent, head, tail: means over the fastest and the slowest so many percent (half to even); left out where that is none."""
    each = ranks.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("m", F.bround(F.col("n") * F.col("percent") / 100)).where("m > 0")
    return each.groupBy("percent").agg(F.avg(F.when(F.col("rn") <= F.col("m"), F.col(value))).alias("head"), F.avg(F.when(F.col("rn") > F.col("n") - F.col("m"), F.col(value))).alias("tail"))


def reductions(stats: DataFrame) -> DataFrame:
    """percent, head, tail, and the percentage by which they fall without errors, over `stats` (trace_id, root_id, latency, saved)."""
    rows = stats.select(*TREE, "latency", (F.col("latency") - F.col("saved")).alias("without"), F.lpad("trace_id", 20, "0").alias("k"))
    met = ranked(rows, [], ["latency", "k", *TREE])
    a, b = heads_and_tails(met), heads_and_tails(met, value="without").toDF("percent", "head0", "tail0")
    less = lambda x, y: F.round((1 - F.try_divide(y, x)) * 100, 2)
    return a.join(b, "percent").select("percent", "head", "tail", less("head", F.col("head0")).alias("head_reduction"), less("tail", F.col("tail0")).alias("tail_reduction"))


def hypothetical(stats: DataFrame, percents: tuple[int, ...] = (50, 90, 95, 99, 100)) -> DataFrame:
    """percent, head, head_without: means over the so many percent with the least latency, and with the least latency without errors."""
    rows = stats.select(*TREE, "latency", (F.col("latency") - F.col("saved")).alias("without"), F.lpad("trace_id", 20, "0").alias("k"))
    a = heads_and_tails(ranked(rows, [], ["latency", "k", *TREE]), percents).select("percent", "head")
    b = heads_and_tails(ranked(rows, [], ["without", "k", *TREE]), percents, "without").select("percent", F.col("head").alias("head_without"))
    return a.join(b, "percent")


def op_percentiles(profile: DataFrame, of: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """op, trees (with time for it), percentiles of exclusive time over those (p50...), their ratios to the same percentiles of total time (ratio50...),
    and percentiles of inclusive time over the trees that have some (inc50...)."""
    profile = cut(profile.select(*TREE, "path", "inc", "excl"), "profile")
    op = F.element_at("path", -1).alias("op")
    totals = ranked(profile.groupBy(*TREE).agg(F.sum("excl").alias("total")), [], ["total", *TREE])
    whole = totals.agg(F.array(*(at_share("total", q) for q in of))).scalar()

    def percentiles(value: str, name: str, *more) -> DataFrame:
        rows = profile.groupBy(*TREE, op).agg(F.sum(value).alias("t")).where("t <> 0")
        return ranked(rows, ["op"], ["t", *TREE]).groupBy("op").agg(*more, *(at_share("t", q).alias(f"{name}{int(q * 100)}") for q in of))

    out = percentiles("excl", "p", F.count("*").alias("trees")).withColumn("_all", whole)
    out = out.withColumns({f"ratio{int(q * 100)}": F.try_divide(F.col(f"p{int(q * 100)}"), F.col("_all")[i]) for i, q in enumerate(of)}).drop("_all")
    return out.join(percentiles("inc", "inc"), "op", "left")


def cumulative_shares(profile: DataFrame, of: tuple[float, ...] = (0.5, 0.9, 1.0)) -> DataFrame:
    """op, percent, share and most: of the first floor(n*p) trees by total time, the operation's share of time and its largest time."""
    own = cut(by_op(profile), "by-op")
    totals = own.groupBy(*TREE).agg(F.sum("t").alias("total")).withColumn("k", F.lpad("trace_id", 20, "0"))
    placed = ranked(totals, [], ["total", "k", *TREE])
    each = placed.withColumn("p", F.explode(F.array(*map(F.lit, of)))).where(F.col("rn") <= F.floor(F.col("n") * F.col("p")))
    whole = each.groupBy("p").agg(F.sum("total").alias("whole"))  # a row a share
    met = own.join(each.select(*TREE, "p"), TREE).groupBy("op", "p").agg(F.sum("t").alias("t"), F.max("t").alias("most"))
    return met.join(F.broadcast(whole), "p").select("op", (F.col("p") * 100).cast("int").alias("percent"), F.try_divide("t", "whole").alias("share"), "most")


def op_totals(profile: DataFrame) -> DataFrame:
    """op, total, occurrences (trees with time for it), worst_trace (that spends most on it; ties: the smallest), chains (distinct paths that end in it)."""
    profile = cut(profile.select(*TREE, "path", "excl"), "profile")
    ops = by_op(profile).groupBy("op").agg(F.sum("t").alias("total"), F.count(F.when(F.col("t") != 0, 1)).alias("occurrences"), F.min_by("trace_id", F.struct(-F.col("t"), F.lpad("trace_id", 20, "0"))).alias("worst_trace"))
    chains = profile.groupBy(F.element_at("path", -1).alias("op")).agg(F.count_distinct("path").alias("chains"))
    return ops.join(chains, "op")


def top_contexts(merged: DataFrame, ops: int = 5, contexts: int = 3) -> DataFrame:
    """op_rank, op, rank, path, excl: the heaviest operations, and for each its heaviest call paths."""
    rows = merged.select(F.element_at("path", -1).alias("op"), F.array_join("path", "->").alias("path"), "excl")
    best = rows.groupBy("op").agg(F.sum("excl").alias("all")).orderBy(F.desc("all"), "op").limit(ops).withColumn("op_rank", F.row_number().over(Window.orderBy(F.desc("all"), "op")))
    order = Window.partitionBy("op").orderBy(F.desc("excl"), "path")
    return rows.join(F.broadcast(best), "op").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= contexts).select("op_rank", "op", "rank", "path", "excl")


def heatmap(profile: DataFrame, ops: int = 20, trees: int = 100) -> DataFrame:
    """op, trace_id, root_id, t: the heaviest operations against the slowest trees, in long form."""
    own = cut(by_op(profile), "by-op")
    best = own.groupBy("op").agg(F.sum("t").alias("all")).orderBy(F.desc("all"), "op").limit(ops)
    slow = own.groupBy("trace_id", "root_id").agg(F.sum("t").alias("all")).orderBy(F.desc("all"), F.lpad("trace_id", 20, "0")).limit(trees)
    return own.join(F.broadcast(best.select("op")), "op").join(F.broadcast(slow.select("trace_id", "root_id")), ["trace_id", "root_id"]).select("op", "trace_id", "root_id", "t")


def trace_counts(nodes: DataFrame) -> DataFrame:
    """One row a tree: latency, root_error, nodes, depth, work, work_saved, errors, errors on the path (cp_errors) and tied to it by errors
    (tied_errors), nodes_on_cp, self_errors (the root's own left out), max_err_depth (unbroken to the root), what the repair shrank, and
    the percentiles of the depths of those self errors: <p>_depth."""
    flag = lambda c: F.sum(F.expr(c).cast("int"))
    own = "is_error and err_children = 0 and depth > 1"
    out = nodes.groupBy(*TREE).agg(
        F.max(F.when(F.col("depth") == 1, F.col("adj_dur"))).alias("latency"), F.bool_or((F.col("depth") == 1) & F.col("is_error")).alias("root_error"), F.count("*").alias("nodes"), F.max("depth").alias("depth"),
        F.sum("adj_dur").alias("work"), F.sum(F.when(F.col("is_error"), F.col("adj_dur")).otherwise(0)).alias("work_saved"),
        flag("is_error").alias("errors"), flag("is_error and on_cp").alias("cp_errors"), flag("is_error and full_kept and not on_cp").alias("tied_errors"), flag("on_cp").alias("nodes_on_cp"), flag(own).alias("self_errors"),
        F.max(F.expr("case when chain_ok and n_children = 0 then depth end")).alias("max_err_depth"), flag("adj_dur < dur").alias("shrunk"), F.sum(F.col("dur") - F.col("adj_dur")).alias("shrink"),
        F.percentile(F.expr(f"case when {own} then depth end"), F.array(*map(F.lit, DEPTHS.values()))).alias("_d"))
    return out.select("*", *(F.col("_d")[i].alias(f"{name}_depth") for i, name in enumerate(DEPTHS))).drop("_d")


def with_shares(counts: DataFrame) -> DataFrame:
    """`trace_counts` with its percentages: of work saved, of errors on the path and tied to it, and of depth."""
    part = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return counts.withColumns({"work_ratio": part("work_saved", "work"), "cp_error_ratio": part("cp_errors", "errors"), "tied_error_ratio": part("tied_errors", "errors"), **{f"{p}_depth_ratio": part(f"{p}_depth", "depth") for p in DEPTHS}})


def trace_stats(nodes: DataFrame, strategy: str = "series") -> DataFrame:
    """The wide row of each tree (type, work, latency, errors, path, depths, and time saved by the strategy), from nodes that carry savings; trees
    without work are left out. Best saving first is the order of `saved_ratio`."""
    saved = nodes.where("depth = 1").select(*TREE, F.col(f"saved_{strategy}").alias("saved"))
    return typed(nodes, saved)


def typed(nodes: DataFrame, saved: DataFrame) -> DataFrame:
    rows = with_shares(trace_counts(nodes)).where("work > 0").join(saved, TREE)
    return rows.withColumns({"type": F.when(F.col("root_error"), "ROOT_ERROR").otherwise("NON_ROOT_ERROR"), "saved_ratio": F.try_divide("saved", "latency")})


def summary(stats: DataFrame) -> DataFrame:
    """type (ROOT_ERROR, NON_ROOT_ERROR, ALL), trees, the mean of every number of `trace_stats`, and ratios of sums for its percentages."""
    ratios = {"work_ratio": ("work_saved", "work"), "saved_ratio": ("saved", "latency"), "cp_error_ratio": ("cp_errors", "errors"), "tied_error_ratio": ("tied_errors", "errors")}
    means = [c for c, t in stats.dtypes if t in ("bigint", "int", "double") and c not in ratios]
    rows = stats.rollup("type").agg(F.grouping("type").alias("g"), F.count("*").alias("trees"), *(F.avg(c).alias(c) for c in means), *(F.try_divide(F.sum(a), F.sum(b)).alias(c) for c, (a, b) in ratios.items() if c in stats.columns and a in stats.columns))
    return rows.withColumn("type", F.when(F.col("g") == 1, "ALL").otherwise(F.col("type"))).drop("g")


def run_log(nodes: DataFrame, folded_sizes: DataFrame) -> DataFrame:
    """One row about a run: traces, nodes, the most nodes and the greatest depth of a trace, and the sizes of traces' profiles (`folded_sizes`: trace_id,
    root_id, bytes) at shares of their sorted list (element floor(n * q))."""
    sizes = nodes.groupBy(*TREE).agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))
    whole = sizes.agg(F.count("*").alias("traces"), F.sum("nodes").alias("nodes"), F.max("nodes").alias("most_nodes"), F.max("depth").alias("max_depth"))
    placed = ranked(folded_sizes, [], ["bytes", *TREE])
    at = lambda q: F.max(F.when(F.col("rn") == F.least(F.floor(F.col("n") * q), F.col("n") - 1) + 1, F.col("bytes")))
    part = placed.agg(F.struct(F.sum("bytes").alias("bytes"), *(at(q).alias(f"bytes_p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)))).scalar()
    return whole.withColumn("p", part).select("traces", "nodes", "most_nodes", "max_depth", "p.*")
