"""Error analysis: classes, propagation, depths, and the error critical path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.config import OFF_PATH_ROOT, ON_PATH_ROOT

from .profile import with_own_time

TREE = ["trace_id", "root_id"]


def classified(nodes: DataFrame) -> DataFrame:
    """Nodes with class: self, propagated, stopped or null; propagation (length, for self errors)."""
    has = F.col("err_children") > 0
    label = F.when(F.col("is_error") & has, "propagated").when(F.col("is_error"), "self").when(has, "stopped")
    return nodes.withColumn("class", label).withColumn("propagation", F.when(F.col("class") == "self", F.col("depth") - F.col("stop_depth")))


def counts(rows: DataFrame, *by) -> DataFrame:
    of = lambda c: F.count(F.when(F.col("class") == c, 1))
    return rows.where("class is not null").groupBy(*by).agg(of("self").alias("self_errors"), of("propagated").alias("propagated"), of("stopped").alias("stopped"))


def resiliency(rows: DataFrame) -> DataFrame:
    """op, resiliency: stopped / (stopped + propagated)."""
    c = counts(rows, F.element_at("path", -1).alias("op"))
    return c.where("stopped + propagated > 0").select("op", "stopped", "propagated", (F.col("stopped") / (F.col("stopped") + F.col("propagated"))).alias("resiliency"))


def deepest(nodes: DataFrame) -> DataFrame:
    """trace_id, root_id, max_depth: deepest childless node at the end of an unbroken chain of errors from the root, else -1."""
    return nodes.groupBy(*TREE).agg(F.coalesce(F.max(F.when(F.col("chain_ok") & (F.col("n_children") == 0), F.col("depth"))), F.lit(-1)).alias("max_depth"), F.max("depth").alias("tree_depth"))


def depth_histogram(rows: DataFrame) -> DataFrame:
    """class (self, stopped), depth, to_root, on_path, n."""
    return rows.where("class in ('self', 'stopped')").groupBy("class", "depth", F.when(F.col("class") == "self", F.col("chain_ok")).alias("to_root"), F.col("on_cp").alias("on_path")).agg(F.count("*").alias("n"))


def quantised(rows: DataFrame) -> DataFrame:
    """items, p0, p50, p90, p95, p99, p100 and avg of the depths of self errors: element floor(n*q) of the sorted list."""
    hist = rows.where("class = 'self'").groupBy("depth").agg(F.count("*").alias("n"))
    # The histogram has one row a depth, so the running total sees few rows whatever the corpus.
    steps = hist.groupBy().agg(F.array_sort(F.collect_list(F.struct("depth", "n"))).alias("h"), F.sum("n").alias("items"), F.sum(F.col("depth") * F.col("n")).alias("total"))
    at = lambda q: F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("hit")), lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.coalesce(acc["hit"], F.when(acc["seen"] + x["n"] > F.least(F.floor(F.col("items") * q), F.col("items") - 1), x["depth"])).alias("hit")), lambda acc: acc["hit"])
    return steps.select("items", *(at(q).alias(f"p{int(q * 100)}") for q in (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)), (F.col("total") / F.col("items")).alias("avg"))


def errors_on_path(nodes: DataFrame) -> DataFrame:
    """On-path nodes that err or have an erring on-path node below them."""
    return nodes.where("err_on_path")


def full_profile(nodes: DataFrame) -> DataFrame:
    """trace_id, root_id, path (under a synthetic root), excl, freq and self_errors, propagated, stopped of nodes on the path or tied to it by errors.
    Nodes that stop an error count as stopped only; they have no time of their own here."""
    rows = with_own_time(nodes).where("full_kept and (is_error or full_err_children > 0)")
    bad, more = F.col("is_error"), F.col("full_err_children") > 0
    excl = F.when(~bad, 0).when(F.col("on_cp"), F.col("own")).otherwise(F.greatest(F.lit(0), F.col("adj_dur") - F.col("off_dur")))
    top = F.when(F.col("on_cp"), F.lit(ON_PATH_ROOT)).otherwise(F.lit(OFF_PATH_ROOT))
    of = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*TREE, F.concat(F.array(top), F.col("path")).alias("path")).agg(F.sum(excl).alias("excl"), of(bad).alias("freq"), of(bad & ~more).alias("self_errors"), of(bad & more).alias("propagated"), of(~bad).alias("stopped"))


def error_stacks(nodes: DataFrame) -> DataFrame:
    """trace_id, root_id, path, excl: how many self errors a tree has at a call path."""
    return classified(nodes).where("class = 'self'").groupBy(*TREE, "path").agg(F.count("*").alias("excl"))


def to_root_stacks(nodes: DataFrame) -> DataFrame:
    """trace_id, root_id, path, excl: how many errors that reach the root begin at a call path."""
    return nodes.where("prop_leaf").groupBy(*TREE, "path").agg(F.count("*").alias("excl"))


def percent_histogram(nodes: DataFrame) -> DataFrame:
    """bin (0..9, the last closed), trees: share of a tree's nodes that err."""
    share = nodes.groupBy(*TREE).agg(F.sum(F.col("is_error").cast("int")).alias("e"), F.count("*").alias("n"))
    return share.select(F.least(F.floor(F.col("e") * 10 / F.col("n")), F.lit(9)).alias("bin")).groupBy("bin").agg(F.count("*").alias("trees"))


def share_bins(rows: DataFrame, **shares) -> DataFrame:
    """bin (lower edge in tenths; -1 holds exact zeros), and for each named share how many rows fall there: [0], (0, .1), [.1, .2) ... [.9, 1]."""
    place = lambda x: F.when(x == 0, -1).when(x.isNotNull(), F.least(F.floor(x * 10), F.lit(9)))
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("of"), place(x).cast("int").alias("bin")) for k, x in shares.items()))).alias("x")).select("x.*").where("bin is not null")
    return each.groupBy("bin").agg(*(F.count(F.when(F.col("of") == k, 1)).alias(k) for k in shares))


def saving_potential(nodes: DataFrame) -> DataFrame:
    """op, saved, latency, count, ratio over trees whose root does not err: time that erring on-path nodes would save, each once (a node below an
    erring one saves nothing more), against the latency of the trees that the operation errs in; best first."""
    bad = nodes.where("full_kept and is_error and on_cp")
    own = bad.groupBy(*TREE, F.element_at("path", -1).alias("op")).agg(F.sum(F.when(~F.col("err_above"), F.col("adj_dur")).otherwise(0)).alias("saved"), F.count("*").alias("count"))
    tops = nodes.where("depth = 1 and not is_error").select(*TREE, F.col("adj_dur").alias("latency"))
    out = own.join(tops, TREE).groupBy("op").agg(F.sum("saved").alias("saved"), F.sum("latency").alias("latency"), F.sum("count").alias("count"))
    return out.withColumn("ratio", F.try_divide("saved", "latency")).orderBy(F.desc("ratio"), "op")


def tree_histograms(nodes: DataFrame) -> DataFrame:
    """trace_id, root_id, metric, and items, p0 ... p100, avg of the depths: for each tree its self errors that reach the root or do not, and the errors
    stopped in it, of all nodes and of those on the path."""
    label = F.when(F.col("class") == "self", F.when(F.col("chain_ok"), "to_root").otherwise("not_to_root")).otherwise("stopped")
    rows = classified(nodes).where("class in ('self', 'stopped')").select(*TREE, "depth", F.explode(F.array_compact(F.array(label, F.when(F.col("on_cp"), F.concat(label, F.lit("_on_path")))))).alias("metric"))
    sets = rows.groupBy(*TREE, "metric").agg(F.array_sort(F.collect_list("depth")).alias("d"))  # a tree's depths, in one row as the tree was in one task
    at = lambda q: F.element_at("d", F.least(F.floor(F.size("d") * q), F.size("d") - 1).cast("int") + 1)
    return sets.select(*TREE, "metric", F.size("d").cast("long").alias("items"), *(at(q).alias(f"p{int(q * 100)}") for q in (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)), (F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("d")).alias("avg"))


def percent_depths(nodes: DataFrame) -> DataFrame:
    """bin, self_errors, stopped: depths of such errors as shares of the tree's depth (bins of share_bins), over trees whose root does not err."""
    rows = classified(nodes).select(*TREE, "depth", "class", "is_error")
    rows = rows.groupBy(*TREE).agg(F.max("depth").alias("deepest"), F.bool_or((F.col("depth") == 1) & F.col("is_error")).alias("bad"), F.collect_list(F.when(F.col("class").isin("self", "stopped"), F.struct("class", "depth"))).alias("e"))
    rows = rows.where("not bad").select(F.explode("e").alias("e"), "deepest")
    share = lambda c: F.when(F.col("e.class") == c, F.col("e.depth") / F.col("deepest"))
    return share_bins(rows, self_errors=share("self"), stopped=share("stopped"))


def percent_deepest(nodes: DataFrame) -> DataFrame:
    """share (of the tree's depth, in tenths), trees: how deep the deepest error lies that reaches the root, over trees whose root errs."""
    rows = nodes.groupBy(*TREE).agg(F.coalesce(F.max(F.when(F.col("chain_ok") & (F.col("n_children") == 0), F.col("depth"))), F.lit(-1)).alias("m"), F.max("depth").alias("d"), F.bool_or((F.col("depth") == 1) & F.col("is_error")).alias("bad"))
    return rows.where("bad").groupBy(F.bround(F.col("m") / F.col("d"), 1).alias("share")).agg(F.count("*").alias("trees"))


def depth_percentiles(classes: DataFrame, share: bool = False) -> DataFrame:
    """percentile, depth (rounded; with `share` in tenths of the tree's depth), trees: the depths of a tree's self errors at shares of their list, counted
    over trees whose root does not err."""
    qs = [0.0, 0.5, 0.9, 0.95, 0.99, 1.0]
    rows = classes.groupBy(*TREE).agg(F.max("depth").alias("d"), F.bool_or((F.col("depth") == 1) & F.col("is_error")).alias("bad"), F.percentile(F.when(F.col("class") == "self", F.col("depth")), F.array(*map(F.lit, qs))).alias("v"))
    value = F.bround(F.col("x.depth") / F.col("d"), 1) if share else F.bround(F.col("x.depth"), 0)
    each = rows.where("not bad and v is not null").select("d", F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("percentile"), F.col("v").alias("depth"))).alias("x"))
    return each.groupBy(F.col("x.percentile").alias("percentile"), value.alias("depth")).agg(F.count("*").alias("trees"))
