"""Known results of whole analyses, independent models of the kernels, extreme shapes, and the surfaces around them."""

import http.client
import json
import random
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom import analysis, cli, scratch, service
from spanloom.config import Knobs
from spanloom.errors import NoTraces, OutputExists
from spanloom.operators import errors, flame, latency, profile, sinks, slackdrag, structure, tree, whatif
from spanloom.plans.ranks import at_share, ranked
from spanloom.sources import store, traces, wire

from .test_traces import document, jspan, span, table

# Expected results of small traces: spans as (id, parent, start, length, service and operation number, tags, logs), then exclusive time by operation,
# total work, work saved, time saved, and for the error path: time, and errors that begin, pass and stop.
TAG = lambda k, t, v: {"key": k, "type": t, "value": v}
BAD = [TAG("error", "bool", True)]
TOLD = [TAG("error", "string", "ClientSideError")]
ROOT = "errorCriticalPathSyntheticRoot->"
KNOWN = {
    "every form of an error": (
        [("A", None, 0, 100, "1", [], []), ("B", "A", 10, 10, "2", BAD, []), ("C", "A", 25, 10, "3", TOLD, []), ("D", "A", 40, 10, "4", [], [TAG("error.object", "string", "x")]),
         ("E", "A", 55, 10, "5", [], [TAG("error", "string", "context canceled")]), ("F", "A", 70, 10, "6", [], [TAG("event", "string", "error")]), ("G", "A", 85, 15, "7", [], [])],
        {"1": 35, "2": 10, "3": 10, "4": 10, "5": 10, "6": 10, "7": 15}, 165, 50, 50, {f"1->{i}": 10 for i in range(2, 7)}, {"1": (0, 0, 1)} | {f"1->{i}": (1, 0, 0) for i in range(2, 7)},
    ),
    "chains of errors": (
        [("A", None, 0, 250, "1", [], []), ("B", "A", 10, 100, "2", BAD, []), ("C", "B", 30, 10, "3", [], []), ("D", "B", 50, 10, "4", TOLD, []), ("E", "B", 70, 10, "5", TOLD, []),
         ("F", "A", 120, 100, "6", [], [TAG("event", "string", "error")]), ("G", "F", 140, 60, "7", [], []), ("H", "G", 150, 20, "8", TOLD, []), ("I", "G", 180, 10, "9", TOLD, [])],
        {"1": 50, "2": 70, "3": 10, "4": 10, "5": 10, "6": 40, "7": 30, "8": 20, "9": 10}, 570, 250, 200,
        {"1->2": 70, "1->2->4": 10, "1->2->5": 10, "1->6": 40, "1->6->7->8": 20, "1->6->7->9": 10}, {"1->2": (0, 1, 0), "1->2->4": (1, 0, 0), "1->2->5": (1, 0, 0)},
    ),
    "statuses": (
        [("A", None, 0, 700, "1", [], [])] + [(p, "A", a, 300, "2", [], []) for p, a in (("B", 50), ("F", 400))]
        + [(f"{p}{i}", p, a + 50 + 100 * i, 50, "3", [TAG("http.status_code", "int64", 504 if i == 2 else 404)], []) for p, a in (("B", 50), ("F", 400)) for i in range(3)],
        {"1": 100, "2": 300, "3": 300}, 1600, 300, 300, {"1->2->3": 300}, {"1->2": (0, 0, 2), "1->2->3": (6, 0, 0)},
    ),
    "both err": ([("A", None, 0, 100, "1", BAD, []), ("B", "A", 70, 30, "2", BAD, [])], {"1": 70, "2": 30}, 130, 130, 100, {"1": 70, "1->2": 30}, {"1": (0, 1, 0), "1->2": (1, 0, 0)}),
    "the child errs": ([("A", None, 0, 100, "1", [], []), ("B", "A", 70, 30, "2", BAD, [])], {"1": 70, "2": 30}, 130, 30, 30, {"1->2": 30}, {"1": (0, 0, 1), "1->2": (1, 0, 0)}),
    "the root errs": ([("A", None, 0, 100, "1", BAD, []), ("B", "A", 70, 30, "2", [], [])], {"1": 70, "2": 30}, 130, 100, 100, {"1": 70}, {"1": (1, 0, 0)}),
    "an error is stopped": ([("A", None, 0, 100, "1", [], []), ("B", "A", 0, 100, "2", BAD, []), ("C", "B", 70, 30, "3", BAD, [])], {"1": 0, "2": 70, "3": 30}, 230, 130, 100, {"1->2": 70, "1->2->3": 30}, {"1": (0, 0, 1), "1->2": (0, 1, 0), "1->2->3": (1, 0, 0)}),
    "an error of the middle": ([("A", None, 0, 100, "1", [], []), ("B", "A", 0, 100, "2", BAD, []), ("C", "B", 70, 30, "3", [], [])], {"1": 0, "2": 70, "3": 30}, 230, 100, 100, {"1->2": 70}, {"1": (0, 0, 1), "1->2": (1, 0, 0)}),
}


def as_document(name, rows):
    processes = {f"p{r[4]}": {"serviceName": f"S{r[4]}", "tags": []} for r in rows}
    refs = lambda p: [{"refType": "CHILD_OF", "traceID": name, "spanID": p}] if p else []
    spans = [{"traceID": name, "spanID": i, "operationName": f"O{o}", "processID": f"p{o}", "startTime": a, "duration": n, "references": refs(p), "tags": tags, "logs": [{"fields": logs}] if logs else []} for i, p, a, n, o, tags, logs in rows]
    return json.dumps({"data": [{"traceID": name, "processes": processes, "spans": spans}]})


def test_known_results(spark, tmp_path):
    for name, (rows, *_) in KNOWN.items():
        (tmp_path / f"{name.replace(' ', '_')}.json").write_text(as_document(name, rows))
    spans = traces.json_spans(spark, str(tmp_path))
    nodes = scratch.cut(whatif.nodes_and_savings(spans), "nodes")
    by = lambda df, key, *values: {(r["trace_id"], key(r)): tuple(r[v] for v in values) for r in df.collect()}
    name_of = lambda p: "->".join(p)
    exclusive = by(profile.by_op(profile.per_trace(nodes)), lambda r: r["op"], "t")
    full = errors.full_profile(nodes)
    time = by(full.where("freq > 0"), lambda r: name_of(r["path"]), "excl")
    counts = by(full, lambda r: name_of(r["path"]), "self_errors", "propagated", "stopped")
    stats = {r["trace_id"]: r for r in latency.trace_stats(nodes).collect()}
    long = lambda path: ROOT + "->".join(f"[S{i}] O{i}" for i in path.split("->"))
    for name, (_, ops, work, on_work, saved, path_time, path_counts) in KNOWN.items():
        assert {k[1]: v[0] for k, v in exclusive.items() if k[0] == name} == {f"[S{i}] O{i}": t for i, t in ops.items()}, name
        assert (stats[name]["work"], stats[name]["work_saved"], stats[name]["saved"]) == (work, on_work, saved), name
        assert {k[1]: v[0] for k, v in time.items() if k[0] == name} == {long(p): t for p, t in path_time.items()}, name
        assert {k: v for k, v in ((long(p), n) for p, n in path_counts.items())}.items() <= {k[1]: v for k, v in counts.items() if k[0] == name}.items(), name


def small_tree(rows, knobs=Knobs()):
    columns = tree.SPAN_COLUMNS
    return next(tree.trees([tuple((r | {"span_ord": i})[c] for c in columns) for i, r in enumerate(rows)], knobs))


intervals = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 25)), min_size=1, max_size=14)


@settings(max_examples=300, deadline=None)
@given(intervals)
def test_direct_predecessors_are_those_that_nothing_stands_between(times):
    t = small_tree([span("r", 0, 100), *(span(f"c{i}", a, a + n, "r") for i, (a, n) in enumerate(times))])
    kids = t.root.children
    rank = lambda n: (n.end, n.ord)
    block = whatif.Block(tree.Siblings(t.root, kids, 0.01), 0, 100, 0)
    series = lambda a, b: a is not b and a.end <= b.start and rank(a) < rank(b)
    for n, direct in block.series():
        before = [a for a in kids if series(a, n)]
        # One lies between if it comes after the candidate in end order, too: of instants at one time the later ordinal.
        want = {a.id for a in before if not any(m.start >= a.end and rank(m) > rank(a) for m in before if m is not a)}
        assert {a.id for a in direct} == want


@settings(max_examples=300, deadline=None)
@given(intervals, st.integers(1, 4))
def test_path_pairs_match_the_definition(times, groups):
    t = small_tree([span("r", 0, 100), *(span(f"c{i}", a, a + n, "r", op=f"o{i % groups}") for i, (a, n) in enumerate(times))], Knobs(overlap=0.1))
    group = {c.id: hash(c.name) for c in t.root.children}
    every = tree.Siblings(t.root, t.root.children, 0.1)
    want = {(group[a.id], group[b.id]) for a in t.root.children for b in t.root.children if a is not b and every.before(a, b)}
    assert whatif.happens_before(t.root, group, 0.1) == want


def saved_by_definition(n, overlap):
    """All-series saving, written from its definition with plain loops."""
    if n.error or not n.children:
        return n.dur if n.error else 0
    total = 0
    for block in whatif.blocks(n, overlap):
        members, ends = block.members.order, {}
        for m in sorted(members, key=lambda x: (x.end, x.ord)):
            direct = next(d for k, d in block.series() if k is m)
            gap = min([m.start - block.start, *(m.start - p.end for p in direct)])
            ends[m.id] = max([block.start, *(ends[p.id] for p in direct)]) + gap + m.dur - saved_by_definition(m, overlap)
        total += max(0, block.end - max(ends[m.id] for m in block.enders()) - block.overlap)
    return min(n.dur, total)


def random_rows(rng, many=20, kinds=("UNKNOWN",)):
    rows = [span("0", 0, 1000, kind="SERVER")]
    for i in range(1, rng.randint(2, many)):
        p = rng.choice(rows)
        a = p["start"] + rng.randint(0, max(1, p["dur"]))
        rows.append(span(str(i), a, a + rng.randint(0, max(1, p["dur"])), p["span_id"], op=f"o{i % 5}", is_error=rng.random() < 0.2, kind=rng.choice(kinds)))
    return rows


def test_savings_match_their_definition():
    rng = random.Random(8)
    for _ in range(150):
        rows = random_rows(rng)
        t = small_tree(rows)
        got = whatif.saved(t)
        assert got["series"] == saved_by_definition(t.root, t.knobs.overlap)
        assert all(0 <= v <= t.root.dur for v in got.values())
        if not any(n.error for n in t.walk()):
            assert set(got.values()) == {0}


def test_changes_and_retiming_of_a_chain_agree():
    rng = random.Random(4)
    for _ in range(60):
        rows, a, b = [span("0", 0, 1000, kind="SERVER", op="o")], 0, 1000
        for i in range(1, rng.randint(2, 6)):
            a, b = a + rng.randint(1, 50), b - rng.randint(1, 50)
            rows.append(span(str(i), a, b, str(i - 1), op=f"o{i}", kind="SERVER"))
        target, delta = ("S1", rows[-1]["op"]), rng.randint(1, 100)
        t = small_tree(rows)
        assert whatif.changed(t, delta, target) == delta
        assert whatif.retime_method(small_tree(rows), target, fixed=delta) == -delta


def test_retiming_shifts_what_comes_after():
    rows = [span("a", 0, 100, kind="SERVER"), span("b", 10, 30, "a", kind="SERVER"), span("c", 40, 60, "a"), span("d", 35, 90, "a")]
    t = small_tree(rows)
    links = whatif.Links.of(t)
    b = next(n for n in t.walk() if n.id == "b")
    whatif.retime(t, b, 10, 35, links)
    assert {n.id: (n.start, n.end) for n in t.walk()} == {"a": (0, 105), "b": (10, 35), "c": (45, 65), "d": (40, 95)}
    with pytest.raises(ValueError):
        whatif.retime(t, b, 50, 40, links)
    was = {n.id: (n.start, n.end) for n in t.walk()}
    whatif.retime(t, b, 10, 35, links)
    assert {n.id: (n.start, n.end) for n in t.walk()} == was


@pytest.mark.parametrize("shape", ["deep", "wide"])
def test_extreme_traces(spark, shape):
    many = 3000 if shape == "deep" else 5000
    if shape == "deep":
        rows = [span(f"n{i}", i, 2 * many - i, f"n{i - 1}" if i else None, op="o", is_error=i == many - 1) for i in range(many)]
    else:
        rows = [span("r", 0, 20 * many, op="r"), *(span(f"c{i}", 4 * i, 4 * i + 3 + 9 * (i % 2), "r", op=f"o{i % 3}", is_error=i % 50 == 0) for i in range(many))]
    df = table(spark, rows)
    nodes = tree.nodes(df)
    assert nodes.agg(F.count("*"), F.max("depth")).first() == (len(rows), many if shape == "deep" else 2)
    saved = whatif.savings(df).first()
    assert saved["saved_series"] == (many * 2 - 2 * (many - 1) if shape == "deep" else saved["saved_series"]) and saved["saved_series"] >= 0
    assert slackdrag.slack(nodes).where("slack < 0").count() == 0
    assert slackdrag.dependencies(df).count() >= (many - 1 if shape == "deep" else 9)
    assert whatif.latency_change(df, -1, ("S1", "o")).count() == 1


def test_a_path_of_ten_thousand_calls(spark):
    many = 10_000
    rows = [span(f"n{i}", i, 3 * many - i, f"n{i - 1}" if i else None, op="o", kind="SERVER") for i in range(many)]
    t = small_tree(rows)
    assert whatif.saved(t)["series"] == 0 and whatif.changed(t, 5, ("S1", "o")) == 5 * many
    assert max(row[5] for row in tree.describe(t, "t")) == many


def test_ranks_and_percentiles(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.choice('aaab')}", rng.randint(0, 50), i) for i in range(2000)]
    got = ranked(spark.createDataFrame(rows, "g string, v long, i long").repartition(5), ["g"], ["v", "i"])
    want = {}
    for g in ("ga", "gb"):
        own = sorted((v, i) for k, v, i in rows if k == g)
        want |= {i: (n + 1, len(own)) for n, (_, i) in enumerate(own)}
    assert {r["i"]: (r["rn"], r["n"]) for r in got.collect()} == want
    exact = {r["g"]: r["p"] for r in spark.createDataFrame(rows, "g string, v long, i long").groupBy("g").agg(F.percentile("v", F.lit(0.93)).alias("p")).collect()}
    assert {r["g"]: r["p"] for r in got.groupBy("g").agg(at_share("v", 0.93).alias("p")).collect()} == pytest.approx(exact)
    assert ranked(spark.createDataFrame([], "g string, v long"), ["g"], ["v"]).count() == 0


def test_anonymised_names_come_in_the_order_seen(spark):
    rows = [span("a", 0, 100, op="z"), span("b", 10, 40, "a", op="y"), span("c", 50, 90, "a", op="x")]
    nodes = tree.nodes(table(spark, rows))
    names = {r["name"]: r["alias"] for r in profile.aliases(nodes).collect()}
    assert names == {"[S1] z": "Service::Operation1", "[S1] x": "Service::Operation2", "[S1] y": "Service::Operation3"}
    hidden = profile.anonymised(profile.per_trace(nodes), profile.aliases(nodes))
    assert {"->".join(r["path"]) for r in hidden.collect()} == {"Service::Operation1", "Service::Operation1->Service::Operation2", "Service::Operation1->Service::Operation3"}


def test_flame_graph_families(spark):
    every = []
    for i in range(10):
        rows = [span("a", 0, 100 + i, op="r", is_error=i >= 8), span("b", 0, 0, "a", op="none"), span("c", 50, 90, "a", op="x", is_error=True)]
        every += [r | {"trace_id": f"t{i}"} for r in rows]
    got = {(r["family"], r["label"], r["stack"]): (r["value"], r["trees"]) for r in flame.flame_graphs(tree.nodes(table(spark, every)), more=True).collect()}
    assert got["path", "P50", "[S1] r"] == (62, 5) and got["path", "P100", "[S1] r;[S1] x"] == (40, 10) and got["path", "P100", "[S1] r;[S1] none"] == (1, 10)
    assert got["path", "P90-95", "[S1] r;[S1] x"] == (40, 0 + got["path", "P90-95", "[S1] r"][1])
    assert got["error_path", "P100", "errorCriticalPathSyntheticRoot;[S1] r;[S1] x"] == (40, 8) and got["errored_root", "P100", "[S1] r;[S1] x"] == (2, 2) and got["to_root", "P100", "[S1] r;[S1] x"] == (2, 2)


def write_documents(folder, many=6):
    folder.mkdir()
    for i in range(many):
        tags = [{"key": "team", "type": "string", "value": "blue" if i % 2 else "red"}]
        spans = [jspan("a", 0, 100 + i, tags=[{"key": "span.kind", "type": "string", "value": "server"}]), jspan("b", 10, 50, "a", tags), jspan("c", 70, 20, "b", [{"key": "error", "type": "bool", "value": True}])]
        (folder / f"t{i}.json").write_text(document(f"t{i}", spans).replace('"traceID": "T"', f'"traceID": "t{i}"'))


def test_modes_of_the_command_line(spark, tmp_path):
    write_documents(tmp_path / "in")
    (tmp_path / "tags.yaml").write_text("- {name: team, value: blue, search_depth: 3}\n")
    run = lambda out, *more: (cli.main([str(tmp_path / "in"), str(tmp_path / out), *more], spark), sorted(p.name for p in (tmp_path / out).iterdir()))[1]
    light = run("light", "--light", "--delta", "-5", "--delta-service", "S1", "--delta-operation", "opa")
    assert light == ["profile.cct", "profile.csv", "profile.dot", "profile.pb", "profile.svg", "projected.cct", "projection.csv"]
    bad = run("errors", "--errors-only")
    assert bad == ["error_path.svg", "errored_root.svg", "flame_graphs.csv", "to_root.svg"]
    full = run("full", "--ranges", "--tags", str(tmp_path / "tags.yaml"), "--link", "http://x/")
    assert {"traces.csv", "trace_types.csv", "summary.csv", "hypothetical.csv", "error_depth.csv", "percent_error_depth.csv", "error_propagation.csv", "resiliency.csv", "percent_errors.csv", "trace_errors.csv", "max_error_depth.csv", "percent_max_error_depth.csv", "self_error_depth.csv", "percent_self_error_depth.csv", "saving_potential.csv", "cycles.csv", "cross_region.csv", "slack_drag.csv", "run.csv", "completeness.csv", "flame_graphs-team_blue.csv", "tags-team_blue.yaml", "report.html", "heatmap.json"} <= set(full)
    assert spark.read.option("header", True).csv(str(tmp_path / "full" / "traces.csv")).count() == 6 and "http://x/t5" in (tmp_path / "full" / "report.html").read_text()
    assert spark.read.option("header", True).csv(str(tmp_path / "full" / "flame_graphs-team_blue.csv")).where("family = 'path' and label = 'P100'").first()["trees"] == "3"
    hidden = run("hidden", "--anonymise", "--no-slack")
    assert "slack_drag.csv" not in hidden and not [p for p in (tmp_path / "hidden").rglob("*") if p.is_file() and p.suffix != ".crc" and b"] op" in p.read_bytes()]
    with pytest.raises(NoTraces):
        run("none", "--service", "nobody", "--operation", "x")
    with pytest.raises(SystemExit):
        cli.arguments(["a", "b", "--delta-service", "s"])
    assert cli.window(cli.arguments(["a", "b", "--midnight", "--lookback-days", "2"]), 86400 * 10.5) == (8 * 86400_000_000, 10 * 86400_000_000)


def test_downloaded_documents_are_analysed_like_files(spark, tmp_path):
    write_documents(tmp_path / "in")
    rows = [(p.stem, 200, p.read_text()) for p in sorted((tmp_path / "in").iterdir())] + [("gone", 404, None)]
    spark.createDataFrame(rows, "trace_id string, status int, document string").write.parquet(str(tmp_path / "fetched"))
    a, b = traces.any_spans(spark, str(tmp_path / "in")), traces.any_spans(spark, str(tmp_path / "fetched"))
    cols = ["trace_id", "span_id", "parent_id", "start", "dur", "is_error"]
    assert sorted(a.select(*cols).collect()) == sorted(b.select(*cols).collect())
    nested = spark.read.parquet(str(tmp_path / "fetched")).limit(0)
    assert traces.spans_of(traces.parsed(nested)).count() == 0


@pytest.fixture
def running(spark):
    server = service.server(spark, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_port
    server.shutdown()


def call(port, path, body=None, chunks=None):
    c = http.client.HTTPConnection("127.0.0.1", port, timeout=120)
    if body is None and chunks is None:
        c.request("GET", path)
    elif chunks is not None:
        c.request("POST", path, body=iter(chunks), encode_chunked=True, headers={"Transfer-Encoding": "chunked"})
    else:
        c.request("POST", path, body=body)
    r = c.getresponse()
    return r.status, r.read()


def summaries(raw, window):
    """Call chains of a window: (path, microseconds, frequency)."""
    out = []
    for n, value in wire.fields(raw):
        if n == window:
            steps = [dict(wire.fields(v)) for k, v in wire.fields(value) if k == 1]
            parts = {k: list(wire.fields(v)) for k, v in wire.fields(value) if k in (4, 5)}
            time = dict(wire.fields(dict(parts[4]).get(1, b"")))
            out.append(("->".join(f"[{s[1].decode()}] {s[2].decode()}" for s in steps), time.get(1, 0) * 1_000_000 + time.get(2, 0) // 1000, dict(parts[4]).get(2, 0)))
    return sorted(out)


def test_the_service(spark, running):
    doc = lambda n: document("T", [jspan("a", 0, n), jspan("b", 10, 50, "a")]).encode()
    assert call(running, "/health") == (200, b'{"status": "OK"}') and call(running, "/other")[0] == 404 and call(running, "/other", b"")[0] == 404
    body = wire.request_metadata("S1", "opa") + wire.request_trace(doc(100).replace(b'"T"', b'"T1"')) + wire.request_trace(doc(200).replace(b'"T"', b'"T2"'))
    status, raw = call(running, "/v2/trace/analysis/stream", chunks=[body[i : i + 100] for i in range(0, len(body), 100)])
    assert status == 200 and summaries(raw, 1) == [("[S1] opa", 100, 2), ("[S1] opa->[S1] opb", 50, 2)]
    assert call(running, "/v2/trace/analysis/stream", body)[1] == raw
    both = wire.request_metadata("S1", "opa") + wire.request_trace(doc(100), wire.BASELINE) + wire.request_trace(doc(160).replace(b'"T"', b'"U"'), wire.COMPARISON)
    status, raw = call(running, "/v2/trace/analysis/compare", both)
    assert summaries(raw, 1)[0] == ("[S1] opa", 50, 1) and summaries(raw, 2)[0] == ("[S1] opa", 110, 1) and len(summaries(raw, 3)) == 2
    for path, bad in (("stream", wire.request_metadata("S1", "opa")), ("stream", b"\xff"), ("compare", body), ("stream", wire.request_metadata("S9", "none") + wire.request_trace(doc(1)))):
        assert call(running, f"/v2/trace/analysis/{path}", bad) == (200, b"")


def test_storage(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "kept"))
    kept.put("a/b.bin", b"\x00\xff" * 3)
    assert kept.get("a/b.bin") == b"\x00\xff" * 3 and kept.exists("a") and kept.is_folder("a") and not kept.is_folder("a/b.bin") and kept.names("a") == ["b.bin"] and kept.names("none") == []
    assert kept.delete("a/b.bin") and not kept.exists("a/b.bin")
    with pytest.raises(FileNotFoundError):
        kept.get("a/b.bin")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "x.txt").write_text("x")
    first = store.upload(kept, str(tmp_path / "out"), "a/b", "op x", "2024-01-02", "r1")
    assert first == ["a_b/op_x/2024-01-02/r1/results.tar.gz", "a_b/op_x/2024-01-02/results.tar.gz"]
    with pytest.raises(OutputExists):
        store.upload(kept, str(tmp_path / "out"), "a/b", "op x", "2024-01-02", "r1")
    assert store.upload(kept, str(tmp_path / "out"), "a/b", "op x", "2024-01-02", "r2") == ["a_b/op_x/2024-01-02/r2/results.tar.gz"]


def test_scopes_drop_what_was_cut(spark):
    with scratch.scope(spark) as held:
        df = scratch.cut(spark.range(5), "numbers")
        assert df.count() == 5 and len(held) == 1
        path = held[0]
    files, at = scratch._file_system(spark, path)
    assert not files.exists(at)


def test_nested_rows_and_renderings(spark, tmp_path):
    from spanloom.queries import _nested  # noqa: F401  (its rows are checked against SQL)

    spans = [(1, 0, 2, "op", 1000, 9999, False, 0, [("http.status_code", "500")]), (-2, 1, 3, "call", 2000, 3000, False, 0, None)]
    schema = "span_set array<struct<process:struct<service_name:string,host_name:string>,spans:array<struct<span_id:bigint,parent_span_id:bigint,kind:int,operation_name:string,start_time_unix_nano:bigint,duration_nano:bigint,error:boolean,rpc_status_code:int,StringTags:array<struct<key:string,value:string>>>>>>"
    spark.createDataFrame([([(("S", "h"), spans)],)], schema).coalesce(1).write.parquet(str(tmp_path / "rows"))
    got = {r["span_id"]: r for r in traces.parquet_spans(spark, str(tmp_path / "rows")).collect()}
    assert set(got) == {"0000000000000001", "fffffffffffffffe"} and got["fffffffffffffffe"]["parent_id"] == "0000000000000001"
    assert (got["0000000000000001"]["kind"], got["0000000000000001"]["dur"], got["0000000000000001"]["is_error"], got["fffffffffffffffe"]["kind"]) == ("SERVER", 9, True, "CLIENT")
    stacks = spark.createDataFrame([("a;b", 60), ("a;<c>", 40), ("a", 0)], "stack string, value long")
    drawn = sinks.svg(stacks, "T")
    assert drawn.count("<rect") == 3 and "&lt;c&gt;: 40 (40.00%)" in drawn and 'width="720.0"' in drawn
    assert sinks.svg(stacks.limit(0), "none").count("<rect") == 0
    assert {(r["stack"], r["before"], r["change"]) for r in profile.difference(stacks, stacks.withColumn("value", F.col("value") * 2), "stack", "value", normalise=True).collect()} == {("a;b", 120, 0), ("a;<c>", 80, 0), ("a", 0, 0)}


def test_split_marks_and_several_children(spark):
    tag = lambda k, v: {"key": k, "type": "string", "value": v}
    spans = [jspan("a", 0, 100, tags=[tag("internal.splittrace.traceID", "C1"), tag("internal.splittrace.spanID", "x")]), jspan("b", 10, 20, "a", [tag("internal.splittrace.traceID", "C1"), tag("internal.splittrace.spanID", "later")])]
    docs = spark.createDataFrame([("T", document("T", spans))], "trace_id string, document string")
    assert [tuple(r) for r in traces.split_children(traces.spans_of(traces.parsed(docs))).collect()] == [("T", "C1", "x")]
    parts = [(f"C{i}", document(f"C{i}", [jspan(f"x{i}", 20, 30, "b", kind="FOLLOWS_FROM"), jspan(f"y{i}", 25, 5, f"x{i}", ref=f"C{i}")]).replace('"traceID": "T", "spanID": "x', f'"traceID": "C{i}", "spanID": "x').replace('"traceID": "T", "spanID": "y', f'"traceID": "C{i}", "spanID": "y')) for i in range(3)]
    kids = traces.parsed(spark.createDataFrame(parts, "trace_id string, document string"))
    both = structure.merge_split(traces.spans_of(traces.parsed(docs)), traces.spans_of(kids), traces.references_of(kids))
    assert sorted(r["span_ord"] for r in both.collect()) == list(range(8)) and both.select("trace_id").distinct().count() == 1
    assert structure.collisions(both, both.where("span_id = 'a'")).collect()[0]["span_id"] == "a"


def test_sql_over_views(spark):
    from spanloom.plans import views

    rows = [span("a", 0, 100, op="r"), span("b", 10, 40, "a", op="x"), span("c", 50, 90, "a", op="x")]
    assert views.register(spark, table(spark, rows), prefix="t_") == ["t_spans", "t_nodes", "t_profile", "t_latency"]
    assert spark.sql("select sum(excl) from t_profile where element_at(path, -1) = '[S1] x'").first()[0] == 70
    assert spark.sql("select latency, rn, n from t_latency").collect() == [(100, 1, 1)] and spark.sql("select count(*) from t_nodes n join t_spans s using (span_id) where on_cp").first()[0] == 3


def test_timings_can_be_restored():
    t = small_tree(random_rows(random.Random(1), kinds=("SERVER",)))
    was = whatif.snapshot(t)
    whatif.retime_method(t, ("S1", "o1"), percent=30)
    assert whatif.snapshot(t) != was
    whatif.restore(t, was)
    assert whatif.snapshot(t) == was


def test_requests_are_checked():
    for wrong in ({"mode": "x"}, {"target": ("S", "o")}):
        with pytest.raises(ValueError):
            analysis.Request(**wrong)
    with pytest.raises(ValueError):
        Knobs(strategy="none")
