"""Profiles: exclusive and inclusive time by call path, their merging, exemplars, percentile slices and folded stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.plans.ranks import ranked
from spanloom.scratch import cut


def name(path: Column) -> Column:
    return F.array_join(path, "->")


def with_own_time(nodes: DataFrame) -> DataFrame:
    """Nodes with own (exclusive time of the span: its time less that of its critical children)."""
    return nodes.withColumn("own", F.greatest(F.lit(0), F.col("adj_dur") - F.col("path_dur")))


def per_trace(nodes: DataFrame) -> DataFrame:
    """trace_id, root_id, path, inc, excl (floored at 0 a path), freq, inc_ex, excl_ex (worst span: longest, then latest in path order)."""
    rows = nodes.where("on_cp")
    worst = F.max_by("span_id", F.struct("adj_dur", "cp_pos"))
    return rows.groupBy("trace_id", "root_id", "path").agg(
        F.sum("adj_dur").alias("inc"), F.greatest(F.lit(0), F.sum(F.col("adj_dur") - F.col("path_dur"))).alias("excl"), F.count("*").alias("freq"), worst.alias("inc_ex"), worst.alias("excl_ex"), F.max("adj_dur").alias("worst"))


def merged(profile: DataFrame) -> DataFrame:
    """By path over all trees: sums, integer means over the number of trees, and the worst tree (ties: smallest trace). The sums are cut, so that
    counting the trees (each has one row of a path of length 1) repeats nothing."""
    sums = profile.groupBy("path").agg(F.sum("inc").alias("inc"), F.sum("excl").alias("excl"), F.sum("freq").alias("freq"), F.count("*").alias("in_trees"), F.min_by("trace_id", F.struct(-F.col("inc"), "trace_id")).alias("worst_trace"))
    sums = cut(sums, "merged")
    trees = sums.where("size(path) = 1").agg(F.sum("in_trees")).scalar()
    return sums.withColumns({"avg_inc": F.floor(F.col("inc") / trees), "avg_excl": F.floor(F.col("excl") / trees)})


def exemplars(profile: DataFrame, most: int = 3) -> DataFrame:
    """path, rank, trace_id, span_id, worst: the top exemplars of each path by worst span, then trace, then span."""
    order = Window.partitionBy("path").orderBy(F.desc("worst"), "trace_id", "inc_ex")
    return profile.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("path", "rank", "trace_id", F.col("inc_ex").alias("span_id"), "worst")


def by_op(profile: DataFrame) -> DataFrame:
    """trace_id, root_id, op, t: exclusive time by the path's last operation."""
    return profile.groupBy("trace_id", "root_id", F.element_at("path", -1).alias("op")).agg(F.sum("excl").alias("t"))


def folded(profile: DataFrame, counts: bool = False) -> DataFrame:
    """stack, value [, freq]: mean exclusive time by stack; leaves that would be 0 become 1. Semicolons inside names become _."""
    return stacked(merged(profile), "avg_excl", counts)


def stacked(whole: DataFrame, value: str, counts: bool = False) -> DataFrame:
    """stack, value [, freq] of rows with distinct paths; only a leaf may have to be 1 instead of 0. A path is no leaf if it is another one's parent."""
    inner = whole.where("size(path) > 1").select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path"))
    inner = inner.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("path")).distinct()
    empty = whole.where(F.col(value) == 0).join(inner, "path", "left_anti").select("path", F.lit(1).cast("long").alias("least"))
    out = whole.join(empty, "path", "left")
    stack = F.array_join(F.transform("path", lambda x: F.replace(x, F.lit(";"), F.lit("_"))), ";")
    return out.select(stack.alias("stack"), F.coalesce("least", value).cast("long").alias("value"), *([F.col("freq")] if counts else []))


def cct_lines(profile: DataFrame) -> DataFrame:
    """One text column, as the .cct file has it: stack, time, frequency in double angles."""
    return folded(profile, True).select(F.format_string("%s %d <<%d>>", "stack", "value", "freq").alias("value"))


def latency_ranks(roots: DataFrame) -> DataFrame:
    """trace_id, root_id, latency, root_error, rn (from 1 by latency, then trace), n, of `roots` (trace_id, root_id, latency, root_error), ranked by ranges."""
    rows = roots.withColumn("_k", F.lpad("trace_id", 20, "0"))
    return ranked(rows, [], ["latency", "_k", "trace_id", "root_id"]).drop("_k")


def roots(nodes: DataFrame) -> DataFrame:
    """trace_id, root_id, latency, root_error of each tree."""
    return nodes.where("depth = 1").select("trace_id", "root_id", F.col("adj_dur").alias("latency"), F.col("is_error").alias("root_error"))


def slice_profiles(profile: DataFrame, ranks: DataFrame, ranges: dict[str, tuple[int, int]], average: bool = True) -> DataFrame:
    """label, path, excl, trees: profiles (trace_id, root_id, path, excl) over slices of the ranked trees, [n*start/100, n*end/100) rounded half to
    even; means over the trees of the slice, or sums. A tree may lie in several slices."""
    spans = F.array(*(F.struct(F.lit(k).alias("label"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in ranges.items()))
    part = ranks.withColumn("s", F.explode(spans)).where((F.col("rn") > F.bround(F.col("n") * F.col("s.a") / 100)) & (F.col("rn") <= F.bround(F.col("n") * F.col("s.b") / 100)))
    part = part.select("trace_id", "root_id", F.col("s.label").alias("label"))
    trees = part.groupBy("label").agg(F.count("*").alias("trees"))
    sums = profile.join(part, ["trace_id", "root_id"]).groupBy("label", "path").agg(F.sum("excl").alias("total")).join(F.broadcast(trees), "label")  # a row a range
    return sums.select("label", "path", (F.floor(F.col("total") / F.col("trees")) if average else F.col("total")).alias("excl"), "trees")


def difference(one: DataFrame, two: DataFrame, key: str, value: str, normalise: bool = False) -> DataFrame:
    """key, before, after, change: full outer join of two folded tables; normalise scales the first to the second's total."""
    a, b = one.select(key, F.col(value).alias("a")), two.select(key, F.col(value).alias("b"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("a", F.lit(0)).alias("before"), F.coalesce("b", F.lit(0)).alias("after"))
    if normalise:
        both = cut(both, "difference")
        both = both.withColumn("before", F.floor(F.col("before") * both.agg(F.try_divide(F.sum("after"), F.sum("before"))).scalar()))
    return both.withColumn("change", F.col("after") - F.col("before"))


def tree_graph(folded_stacks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: prefix, excl, inc; edges: parent, child) of the calling-context tree of folded stacks."""
    parts = folded_stacks.select(F.split("stack", ";").alias("p"), "value")
    each = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.slice("p", F.lit(1), i).alias("prefix"), (i == F.size("p")).alias("leaf")))).alias("x"), "value")
    nodes = each.groupBy(F.array_join("x.prefix", ";").alias("prefix")).agg(F.sum(F.when(F.col("x.leaf"), F.col("value")).otherwise(0)).alias("excl"), F.sum("value").alias("inc"))
    edges = each.where("size(x.prefix) > 1").select(F.array_join(F.slice("x.prefix", F.lit(1), F.size("x.prefix") - 1), ";").alias("parent"), F.array_join("x.prefix", ";").alias("child")).distinct()
    return nodes, edges


def aliases(nodes: DataFrame) -> DataFrame:
    """name, alias: every operation on a critical path as Service::OperationN, N in the order in which they are first seen (trace, then path order)."""
    seen = nodes.where("on_cp").groupBy(name_of("service", "op").alias("name")).agg(F.min(F.struct(F.lpad("trace_id", 20, "0").alias("trace"), F.col("root_id").alias("root"), "cp_pos")).alias("first"))
    return ranked(seen.select("name", "first.*"), [], ["trace", "root", "cp_pos"]).select("name", F.concat(F.lit("Service::Operation"), F.col("rn")).alias("alias"))


def name_of(service: str, op: str) -> Column:
    return F.concat(F.lit("["), F.col(service), F.lit("] "), F.col(op))


def anonymised(rows: DataFrame, names: DataFrame, paths: tuple[str, ...] = ("path",), ops: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with the names in its columns `paths` (arrays) and `ops` (single names) replaced by their aliases; other columns stay."""
    for column in ops:
        rows = rows.join(names.withColumnRenamed("name", column), column, "left").withColumn(column, F.col("alias")).drop("alias")
    for column in paths:
        each = rows.select(F.col(column).alias("_was")).distinct().select("_was", F.posexplode("_was").alias("_at", "name")).join(names, "name", "left")
        new = each.groupBy("_was").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "alias"))), lambda x: x["alias"]).alias("_new"))
        rows = rows.join(new, rows[column] == new["_was"]).withColumn(column, F.col("_new")).drop("_was", "_new")
    return rows
