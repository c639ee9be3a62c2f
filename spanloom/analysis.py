"""Whole analyses of a set of spans: every table and rendering that one run gives out, in full, light and errors-only mode."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import scratch
from spanloom.config import Knobs
from spanloom.errors import NoTraces
from spanloom.operators import errors, flame, latency, profile, sinks, slackdrag, structure, tree, whatif

#: Tables with a row a trace or a call path stay in as many files as tasks; the others are small and come in one.
LARGE = {"traces", "trace_errors", "profile", "slack_drag", "cycles", "error_profile", "flame_graphs", "dependencies"}


@dataclass(frozen=True)
class Request:
    """What to analyse and to give out. `target` and `delta` (microseconds) ask for a projection; `tags` are name, value, search_depth filters of which
    each gets its own flame graphs; `link` is put before trace ids in the report."""

    knobs: Knobs = Knobs()
    mode: str = "full"
    anonymise: bool = False
    ranges: bool = False
    slack: bool = True
    exemplars: int = 3
    top: int = 5
    heat_traces: int = 100
    heat_ops: int = 100
    delta: int = 0
    target: tuple[str, str] | None = None
    tags: tuple[dict, ...] = field(default_factory=tuple)
    link: str = ""

    def __post_init__(self) -> None:
        if self.mode not in ("full", "light", "errors"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.target and not self.delta:
            raise ValueError("a target needs a delta other than 0")


def tables(nodes: DataFrame, own: DataFrame, spans: DataFrame, r: Request) -> dict[str, DataFrame]:
    """Every table of a full run. `nodes` carry savings, `own` is their profile; both are read many times, so they should be cut."""
    classes, stats = errors.classified(nodes), latency.trace_stats(nodes, r.knobs.strategy)
    sound = stats.where("type = 'NON_ROOT_ERROR'")
    saved = sound.select("trace_id", "root_id", "latency", "saved")
    depths = errors.depth_histogram(classes)
    out = {
        "traces": stats.orderBy(F.desc("saved_ratio")), "trace_types": latency.summary(stats), "summary": latency.reductions(saved), "hypothetical": latency.hypothetical(saved),
        "percentiles": latency.points(profile.latency_ranks(profile.roots(nodes))), "operations": latency.op_percentiles(own), "shares": latency.cumulative_shares(own),
        "error_depth": errors.counts(classes, "depth").orderBy("depth"), "error_depth_classes": depths, "percent_error_depth": errors.percent_depths(nodes).orderBy("bin"),
        "error_propagation": classes.where("class = 'self'").groupBy("propagation").agg(F.count("*").alias("self_errors")).orderBy("propagation"), "resiliency": errors.resiliency(classes),
        "percent_errors": errors.share_bins(sound, cp=F.col("cp_error_ratio"), tied=F.col("tied_error_ratio")).orderBy("bin"), "trace_errors": errors.tree_histograms(nodes),
        "max_error_depth": errors.deepest(nodes).groupBy("max_depth").agg(F.count("*").alias("trees")).orderBy("max_depth"), "percent_max_error_depth": errors.percent_deepest(nodes).orderBy("share"),
        "self_error_depth": errors.depth_percentiles(classes), "percent_self_error_depth": errors.depth_percentiles(classes, share=True),
        "saving_potential": errors.saving_potential(nodes), "error_counts": errors.counts(classes, "path"), "error_profile": errors.full_profile(nodes), "flame_graphs": flame.flame_graphs(nodes, r.ranges),
        "cycles": structure.cycles(nodes), "cross_region": structure.cross_region(nodes),
    }
    if r.slack:
        out |= {"slack_drag": slackdrag.by_path(nodes).orderBy(F.desc("avg_drag")), "dependencies": slackdrag.aggregate_dependencies(spans, r.knobs)}
    if "warnings" in spans.columns:
        out["completeness"] = structure.completeness_report(structure.completeness(spans))
    return out


def run(spark: SparkSession, spans: DataFrame, output: str, r: Request = Request(), write: Callable[[str, str | bytes], None] | None = None) -> dict[str, str]:
    """Analyse `spans` and write tables under `output`; renderings go through `write(name, content)` (by default files beside the tables, where these
    lie in a local folder). Returns the paths of what was written, by name."""
    out = lambda name: os.path.join(output, name)
    done: dict[str, str] = {}

    def render(name: str, content: str | bytes) -> None:
        if write is not None:
            write(name, content)
        elif "://" not in output:
            os.makedirs(output, exist_ok=True)
            with open(out(name), "wb") as f:
                f.write(content.encode() if isinstance(content, str) else content)
        else:
            return
        done[name] = out(name)

    def table(name: str, df: DataFrame) -> None:
        sinks.csv(df, out(f"{name}.csv"), name not in LARGE)
        done[f"{name}.csv"] = out(f"{name}.csv")

    with scratch.scope(spark):
        spans = scratch.cut(spans, "spans")
        nodes = scratch.cut(tree.nodes(spans, r.knobs) if r.mode == "light" else whatif.nodes_and_savings(spans, r.knobs), "nodes")
        if nodes.isEmpty():
            raise NoTraces("no trace has a matching root")
        if r.mode == "errors":
            graphs = scratch.cut(flame.flame_graphs(nodes).where("family <> 'path'"), "flames")
            table("flame_graphs", graphs)
            for family in ("error_path", "errored_root", "to_root"):
                render(f"{family}.svg", sinks.svg(graphs.where((F.col("family") == family) & (F.col("label") == "P100")), family))
            return done
        own = profile.per_trace(nodes)
        if r.anonymise:
            own = profile.anonymised(own, profile.aliases(nodes))
        own = scratch.cut(own, "profile")
        merged = scratch.cut(profile.merged(own), "merged")
        stacks = scratch.cut(profile.stacked(merged, "avg_excl", True), "stacks")
        sinks.cct_of(stacks, out("profile.cct"))
        done["profile.cct"] = out("profile.cct")
        table("profile", merged.orderBy(F.desc("avg_excl")))
        render("profile.dot", sinks.dot_of(stacks))
        render("profile.pb", sinks.protobuf(merged, profile.exemplars(own, r.exemplars)))
        render("profile.svg", sinks.svg(stacks, "Critical paths"))
        if r.delta:
            target = r.target or None
            projected = whatif.projected_profile(spans, r.delta, target, r.knobs) if target else None
            if projected is not None:
                sinks.cct(projected.withColumns({"inc_ex": F.lit(None).cast("string"), "worst": F.col("inc")}), out("projected.cct"))
                done["projected.cct"] = out("projected.cct")
                table("projection", whatif.latency_change(spans, r.delta, target, r.knobs))
        if r.mode == "light":
            return done
        every = tables(nodes, own, spans, r)
        if r.anonymise:
            names = scratch.cut(profile.aliases(nodes), "names")
            hide = {"operations": ("op",), "shares": ("op",), "saving_potential": ("op",), "resiliency": ("op",)}
            for name, ops in hide.items():
                every[name] = profile.anonymised(every[name], names, (), ops)
            for name in ("error_counts", "slack_drag", "cycles", "cross_region", "error_profile", "flame_graphs", "dependencies"):
                every.pop(name, None)  # these name operations off the critical path, which have no alias
        for name, df in every.items():
            table(name, df)
        for tag in r.tags:
            mark = f"{tag['name']}={tag['value']}"
            wanted = spark.createDataFrame([(str(tag["name"]), str(tag["value"]), int(tag["search_depth"]))], "name string, value string, search_depth int")
            held = structure.tag_matches(nodes, structure.span_tags(spans), wanted)
            table(f"flame_graphs-{''.join(c if c.isalnum() else '_' for c in mark)}", flame.flame_graphs(nodes.join(held.select("trace_id", "root_id"), ["trace_id", "root_id"], "left_semi")))
            render(f"tags-{''.join(c if c.isalnum() else '_' for c in mark)}.yaml", sinks.tag_yaml(held))
        slow = profile.roots(nodes).orderBy(F.desc("latency"), "trace_id").limit(100)
        render("report.html", sinks.report("Critical paths", {"Heaviest": latency.top_contexts(merged, r.top), "Slowest traces": slow, "Operations": every["operations"].orderBy(F.desc("p50"))}, link=r.link))
        render("heatmap.json", sinks.heatmap_json(latency.heatmap(own, r.heat_ops, r.heat_traces)))
        sizes = stacks_size(own)
        table("run", latency.run_log(nodes, sizes))
    return done


def stacks_size(own: DataFrame) -> DataFrame:
    """trace_id, root_id, bytes: the size of each tree's profile as folded text."""
    line = F.length(F.array_join("path", ";")) + F.length(F.col("excl").cast("string")) + 2
    return own.groupBy("trace_id", "root_id").agg(F.sum(line).alias("bytes"))
