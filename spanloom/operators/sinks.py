"""Sinks. Tables go out through Spark's writers; renderings (graph, report, wire message) are made on the driver from merged
profiles, whose size is that of the call-path vocabulary, limited where a limit is the feature."""

from __future__ import annotations

import html
import json
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.errors import OutputExists
from spanloom.sources import wire

from .profile import folded, tree_graph


def csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; arrays are joined by ->."""
    flat = df.select(*(F.array_join(c, "->").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes))
    (flat.coalesce(1) if one_file else flat).write.mode("overwrite").option("header", True).csv(path)


def cct(profile: DataFrame, path: str) -> None:
    cct_of(folded(profile, True), path)


def cct_of(stacks: DataFrame, path: str) -> None:
    """Folded stacks (stack, value, freq) as text."""
    stacks.select(F.format_string("%s %d <<%d>>", "stack", "value", "freq").alias("value")).write.mode("overwrite").text(path)


def stacks(profile: DataFrame, path: str) -> None:
    """Stack and value only, as flame-graph renderers read it."""
    folded(profile).select(F.concat_ws(" ", "stack", "value").alias("value")).write.mode("overwrite").text(path)


def archive(df: DataFrame, path: str, service: str, operation: str, run_date: str, replace: bool = False) -> None:
    """Parquet under service=/operation=/run_date=; an earlier output there stays unless `replace`."""
    out = df.withColumns({"service_": F.lit(service), "operation_": F.lit(operation), "run_date": F.lit(run_date)})
    writer = out.write.partitionBy("service_", "operation_", "run_date").mode("overwrite" if replace else "error")
    try:
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            raise OutputExists(path) from e
        raise


def dot(profile: DataFrame, most: int = 500) -> str:
    """The calling-context tree of a profile, for graph renderers."""
    return dot_of(folded(profile), most)


def dot_of(stacks: DataFrame, most: int = 500) -> str:
    """The tree of folded stacks, of its heaviest `most` prefixes."""
    nodes, edges = tree_graph(stacks.select("stack", "value"))
    top = nodes.orderBy(F.desc("inc"), "prefix").limit(most).collect()
    number = {r["prefix"]: i for i, r in enumerate(top)}
    esc = lambda s: s.replace("\\", "\\\\").replace('"', '\\"')
    lines = [f'  n{i} [label="{esc(r["prefix"].rsplit(";", 1)[-1])}\\nincl {r["inc"]} excl {r["excl"]}"];' for i, r in enumerate(top)]
    kept = edges.where(F.col("child").isin([r["prefix"] for r in top])).orderBy("parent", "child").collect() if top else []
    lines += [f"  n{number[e['parent']]} -> n{number[e['child']]};" for e in kept if e["parent"] in number]
    return "digraph cct {\n" + "\n".join(lines) + "\n}\n"


def protobuf(merged: DataFrame, exemplars: DataFrame | None = None, change: DataFrame | None = None, most: int = 200_000) -> bytes:
    """A response message: merged profile (path array, avg_excl, freq), its exemplars (path, trace_id, span_id), and a compared window. One message is
    made on the driver, so it holds the `most` heaviest call paths (of either window, for a comparison)."""
    merged = merged.orderBy(F.desc("avg_excl"), "path").limit(most)
    if change is not None:
        change = change.orderBy(F.desc(F.greatest("excl1", "excl2")), "path").limit(most)
    shown = F.lit(None).cast("array<struct<trace_id:string,span_id:string>>")
    rows = merged
    if exemplars is not None:
        own = exemplars.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", "trace_id", "span_id"))).alias("all"))
        rows, shown = merged.join(own, "path", "left"), F.transform("all", lambda x: F.struct(x["trace_id"].alias("trace_id"), x["span_id"].alias("span_id")))
    step = lambda p: [(a[1:], b) if a.startswith("[") and cut else ("", x) for x in p for a, cut, b in [x.partition("] ")]]
    first = [wire.summary(step(r["path"]), r["avg_excl"], r["freq"], [(e["trace_id"], e["span_id"]) for e in r["shown"] or ()]) for r in rows.select("path", "avg_excl", "freq", shown.alias("shown")).orderBy("path").toLocalIterator()]
    if change is None:
        return wire.response(first)
    both = list(change.orderBy("path").toLocalIterator())
    second = [wire.summary(step(r["path"]), r["excl2"], r["freq2"]) for r in both if r["freq2"]]
    return wire.response(first, second, [wire.summary(step(r["path"]), r["excl1"], r["freq1"], change=(r["excl_change"], r["freq_change"])) for r in both])


def heatmap_json(cells: DataFrame) -> str:
    """Operations against traces, from the bounded heatmap."""
    rows = cells.orderBy("op", "trace_id").collect()
    return json.dumps({"ops": sorted({r["op"] for r in rows}), "traces": sorted({r["trace_id"] for r in rows}), "cells": [[r["op"], r["trace_id"], r["t"]] for r in rows]})


def tag_yaml(matched: DataFrame) -> str:
    """Names and sorted values of matched tags (column matched: arrays of name=value)."""
    rows = matched.select(F.explode("matched").alias("m")).select(F.substring_index("m", "=", 1).alias("name"), F.expr("substring(m, instr(m, '=') + 1)").alias("value")).groupBy("name").agg(F.sort_array(F.collect_set("value")).alias("values")).orderBy("name")
    return "".join(f"- name: {r['name']}\n  values:\n" + "".join(f"    - {json.dumps(v)}\n" for v in r["values"]) for r in rows.toLocalIterator())


def svg(stacks: DataFrame, title: str, most: int = 5000, width: int = 1200) -> str:
    """A flame graph of the heaviest `most` stacks (stack, value): a box a prefix, as wide as its share, callers below callees."""
    rows = stacks.where("value > 0").orderBy(F.desc("value"), "stack").limit(most).select("stack", "value").collect()
    total, own = sum(r["value"] for r in rows) or 1, {}
    for r in rows:
        names = tuple(r["stack"].split(";"))
        for i in range(1, len(names) + 1):
            own[names[:i]] = own.get(names[:i], 0) + r["value"]
    deepest, left, boxes = max(map(len, own), default=0), {(): 0.0}, []
    for names in sorted(own):  # parents come before their children, siblings side by side by name
        share, x = own[names] / total, left[names[:-1]]
        left[names], left[names[:-1]] = x, x + share
        y, shade = (deepest - len(names)) * 16 + 24, 60 + zlib.crc32(names[-1].encode()) % 140
        if share * width >= 0.3:
            text = html.escape(names[-1][: int(share * width / 7)]) if share * width > 20 else ""
            boxes.append(f'<g><title>{html.escape(names[-1])}: {own[names]} ({share:.2%})</title><rect x="{x * width:.1f}" y="{y}" width="{share * width:.1f}" height="15" fill="rgb(230,{shade},40)"/><text x="{x * width + 2:.1f}" y="{y + 11}">{text}</text></g>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{deepest * 16 + 32}" font-family="monospace" font-size="11"><text x="4" y="14">{html.escape(title)}</text>{"".join(boxes)}</svg>'


def report(title: str, tables: dict[str, DataFrame], rows: int = 100, link: str = "") -> str:
    """An HTML page of the first rows of small tables; numbers are shaded by their share of the column's maximum, trace ids are links if `link` is given."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        got = df.limit(rows).collect()
        most = {c: max((abs(r[c]) for r in got if isinstance(r[c], (int, float))), default=0) for c in df.columns}
        cell = lambda c, v: f'<td style="background:rgba(255,80,0,{abs(v) / most[c]:.2f})">{v}</td>' if isinstance(v, (int, float)) and not isinstance(v, bool) and most[c] else f'<td><a href="{html.escape(link)}{html.escape(str(v))}">{html.escape(str(v))}</a></td>' if link and c == "trace_id" else f"<td>{html.escape(str(v))}</td>"
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>" + "".join("<tr>" + "".join(cell(c, r[c]) for c in df.columns) + "</tr>" for r in got) + "</table>")
    return "\n".join(parts)
