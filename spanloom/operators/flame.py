"""Flame graphs: folded stacks of four families over slices of traces by latency.

path: exclusive time on critical paths, of all trees. error_path: exclusive time of erring nodes on the path or tied to it, of trees whose root does not
err. errored_root: self errors, of trees whose root errs. to_root: where errors that reach the root begin, of the same trees. The first two are
means over the slice's trees that have any, the others counts. One pass over the nodes gives all four."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.config import OFF_PATH_ROOT, ON_PATH_ROOT
from spanloom.plans.ranks import ranked
from spanloom.scratch import cut

TREE = ["trace_id", "root_id"]
RANGES = ((0, 50), (0, 95), (0, 99), (0, 100))
MORE_RANGES = ((20, 40), (40, 60), (60, 80), (80, 90), (90, 95), (90, 99), (94, 96))
#: Family: which trees it is about, and whether it is a mean.
FAMILIES = {"path": ("all", True), "error_path": ("sound", True), "errored_root": ("erring", False), "to_root": ("erring", False)}


def label(start: int, end: int) -> str:
    """A range from 0 is named after its end alone."""
    return f"P{start}-{end}" if start else f"P{end}"


def families(nodes: DataFrame) -> DataFrame:
    """family, trace_id, root_id, path, value; and a row of family `tree` for each tree, with its latency and erring."""
    own = F.col("adj_dur") - F.col("path_dur")
    tied = F.when(F.col("on_cp"), F.greatest(F.lit(0), own)).otherwise(F.greatest(F.lit(0), F.col("adj_dur") - F.col("off_dur")))
    top = F.when(F.col("on_cp"), F.lit(ON_PATH_ROOT)).otherwise(F.lit(OFF_PATH_ROOT))
    row = lambda name, holds, path, value: F.when(holds, F.struct(F.lit(name).alias("family"), path.alias("path"), value.cast("long").alias("value")))
    path, bad = F.col("path"), F.col("is_error")
    each = F.array_compact(F.array(
        row("path", F.col("on_cp"), path, own), row("error_path", F.col("full_kept") & bad, F.concat(F.array(top), path), tied), row("errored_root", bad & (F.col("err_children") == 0), path, F.lit(1)),
        row("to_root", F.col("prop_leaf"), path, F.lit(1)), row("tree", F.col("depth") == 1, F.array().cast("array<string>"), F.col("adj_dur"))))
    rows = nodes.select(*TREE, F.explode(each).alias("x"), F.when(F.col("depth") == 1, bad).alias("erring")).select(*TREE, "x.*", "erring")
    return rows.groupBy(*TREE, "family", "path").agg(F.greatest(F.lit(0), F.sum("value")).alias("value"), F.max("erring").alias("erring"))


def flame_graphs(nodes: DataFrame, more: bool = False) -> DataFrame:
    """family, label, stack, value, trees (of the slice that have any). `more` adds ranges of the path family. Leaves that would be 0 become 1."""
    rows = cut(families(nodes), "families")
    trees = rows.where("family = 'tree'").select(*TREE, F.col("value").alias("latency"), F.explode(F.array(F.lit("all"), F.when(F.col("erring"), F.lit("erring")).otherwise(F.lit("sound")))).alias("about"), F.lpad("trace_id", 20, "0").alias("k"))
    placed = ranked(trees, ["about"], ["latency", "k", *TREE])
    wanted = [(f, label(a, b), about, a, b) for f, (about, _) in FAMILIES.items() for a, b in (RANGES[-1:] if f == "to_root" else RANGES + (MORE_RANGES if more and f == "path" else ()))]
    spans = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("family", "label", "of", "a", "b"), w))) for w in wanted))
    parts = placed.withColumn("s", F.explode(F.filter(spans, lambda s: s["of"] == F.col("about"))))
    parts = parts.where((F.col("rn") > F.bround(F.col("n") * F.col("s.a") / 100)) & (F.col("rn") <= F.bround(F.col("n") * F.col("s.b") / 100))).select(*TREE, "s.family", "s.label")
    met = cut(rows.where("family <> 'tree'").join(parts, [*TREE, "family"]), "slices")
    trees = met.select("family", "label", *TREE).distinct().groupBy("family", "label").agg(F.count("*").alias("trees"))
    sums = met.groupBy("family", "label", "path").agg(F.sum("value").alias("total")).join(F.broadcast(trees), ["family", "label"])  # a row for each graph
    mean = F.col("family").isin([f for f, (_, mean) in FAMILIES.items() if mean])
    sums = cut(sums.withColumn("value", F.when(mean, F.floor(F.col("total") / F.col("trees"))).otherwise(F.col("total"))), "graphs")
    inner = sums.where("size(path) > 1").select("family", "label", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct()
    empty = sums.where("value = 0").join(inner, ["family", "label", "path"], "left_anti").select("family", "label", "path", F.lit(1).cast("long").alias("least"))
    stack = F.array_join(F.transform("path", lambda x: F.replace(x, F.lit(";"), F.lit("_"))), ";")
    return sums.join(empty, ["family", "label", "path"], "left").select("family", "label", stack.alias("stack"), F.coalesce("least", "value").alias("value"), "trees")
