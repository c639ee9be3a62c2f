"""Hand-computed traces through sources, trees, profiles, errors, what-if and sinks."""

import json
import random
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from spanloom.config import Knobs
from spanloom.errors import InvalidRequest, MergeError
from spanloom.operators import errors, profile, sinks, slackdrag, structure, tree, whatif
from spanloom.sources import search, traces, wire


def span(i, start, end, parent=None, op=None, service="S1", **more):
    row = {"trace_id": "t", "span_id": i, "span_ord": 0, "parent_id": parent, "service": service, "op": op or i, "kind": "UNKNOWN", "host": None, "region": None, "start": start, "dur": end - start, "is_error": False}
    return row | more


def table(spark, rows):
    rows = [r | {"span_ord": i} for i, r in enumerate(rows)]
    schema = "trace_id string, span_id string, span_ord int, parent_id string, service string, op string, kind string, host string, region string, start long, dur long, is_error boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def exclusive(spark, rows, knobs=Knobs()):
    p = profile.per_trace(tree.nodes(table(spark, rows), knobs))
    return {r["op"]: r["t"] for r in profile.by_op(p).collect()}


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([span("a", 0, 100)], {"a": 100}),
        ([span("a", 0, 100), span("b", 10, 60, "a")], {"a": 50, "b": 50}),
        ([span("a", 0, 100), span("b", 0, 100, "a")], {"a": 0, "b": 100}),
        ([span("a", 0, 100), span("b", 10, 60, "a"), span("c", 20, 30, "b")], {"a": 50, "b": 40, "c": 10}),
        ([span("a", 0, 100), span("b", 0, 20, "a", "x"), span("c", 30, 50, "a", "x"), span("d", 60, 80, "a", "x")], {"a": 40, "x": 60}),
        ([span("a", 0, 100), span("b", 10, 130, "a")], {"a": 10, "b": 90}),  # ends late: cut
        ([span("a", 10, 100), span("b", 0, 50, "a")], {"a": 50, "b": 40}),  # starts early: cut
        ([span("a", 10, 100), span("b", 0, 130, "a")], {"a": 90}),  # covers its parent: dropped
        ([span("a", 0, 100), span("b", 110, 120, "a"), span("c", 111, 112, "b"), span("d", 70, 100, "a")], {"a": 70, "d": 30}),
        # Siblings that overlap by 1 of 1000 count as serial; with a third event in between they don't.
        ([span("a", 0, 1000), span("b", 100, 401, "a"), span("c", 400, 700, "a")], {"a": 399, "b": 301, "c": 300}),
        ([span("a", 0, 1000), span("b", 100, 401, "a"), span("c", 400, 700, "a"), span("d", 400, 500, "a")], {"a": 700, "c": 300}),
        # Equal ends: the later one counts.
        ([span("a", 0, 100), span("b", 10, 60, "a"), span("c", 40, 60, "a")], {"a": 80, "c": 20}),
    ],
)
def test_exclusive_time(spark, rows, expected):
    assert exclusive(spark, rows) == {f"[S1] {k}": v for k, v in expected.items()}


def test_calls_keep_their_clock(spark):
    rows = [span("a", 100, 200, kind="CLIENT", host="h1"), span("b", 0, 100, "a", kind="SERVER", host="h2")]
    got = {r["span_id"]: (r["adj_start"], r["adj_end"], r["adj_dur"], r["change"]) for r in tree.nodes(table(spark, rows)).collect()}
    assert got["b"] == (0, 100, 100, "call")
    rows[1] = span("b", 0, 101, "a", kind="SERVER", host="h2")
    assert {r["span_id"]: r["adj_dur"] for r in tree.nodes(table(spark, rows)).collect()} == {"a": 100, "b": 100}
    rows[1] = span("b", 0, 102, "a", kind="SERVER", host="h2")  # outlasts its caller by more than 1 %
    assert {r["span_id"]: r["adj_dur"] for r in tree.nodes(table(spark, rows)).collect()} == {"a": 100, "b": 2}


def test_roots_proxies_exclusions_and_repeats(spark):
    rows = [span("a", 0, 100), span("p", 0, 100, "a", "proxy"), span("b", 10, 60, "p"), span("c", 20, 30, "b"), span("z", 0, 5, "missing")]
    got = tree.nodes(table(spark, rows), Knobs(proxies=frozenset({("S1", "proxy")}))).where("root_id = 'a'")
    assert {r["span_id"]: r["depth"] for r in got.collect()} == {"a": 1, "b": 2, "c": 3}
    assert {r["root_id"] for r in tree.nodes(table(spark, rows)).collect()} == {"a", "z"}
    assert {r["span_id"] for r in tree.nodes(table(spark, rows), Knobs(root=("S1", "b"))).collect()} == {"b", "c"}
    assert tree.nodes(table(spark, rows), Knobs(root=("S1", "a"), sole_root=True)).count() == 0
    assert exclusive(spark, rows[:4], Knobs(excluded=frozenset({("S1", "b")}))) == {"[S1] a": 0, "[S1] proxy": 100}
    twice = [span("a", 0, 100), span("b", 0, 10, "a"), span("b", 50, 90, "a")]
    assert exclusive(spark, twice) == {"[S1] a": 60, "[S1] b": 40}
    deep = [span(f"n{i}", i, 1000 - i, f"n{i - 1}" if i else None) for i in range(300)]
    assert tree.nodes(table(spark, deep)).agg(F.max("depth")).first()[0] == 300


def test_pass_through_errors(spark):
    rows = [span("a", 0, 100), span("b", 0, 90, "a"), span("c", 0, 80, "b", is_error=True)]
    got = tree.nodes(table(spark, rows), Knobs(pass_through=frozenset({("S1", "a"), ("S1", "b")})))
    assert all(r["is_error"] for r in got.collect())


def test_errors(spark):
    rows = [span("a", 0, 100), span("b", 10, 60, "a", is_error=True), span("c", 20, 50, "b", is_error=True), span("d", 70, 90, "a", is_error=True), span("e", 75, 80, "d")]
    nodes = tree.nodes(table(spark, rows))
    classes = {r["span_id"]: (r["class"], r["propagation"]) for r in errors.classified(nodes).collect()}
    assert classes == {"a": ("stopped", None), "b": ("propagated", None), "c": ("self", 2), "d": ("self", 1), "e": (None, None)}
    assert errors.deepest(nodes).first()["max_depth"] == -1
    assert {r["span_id"] for r in errors.errors_on_path(nodes).collect()} == {"a", "b", "c", "d"}
    full = {"->".join(r["path"]): r["excl"] for r in errors.full_profile(nodes).where("freq > 0").collect()}
    root = "errorCriticalPathSyntheticRoot->[S1] a->"
    assert full == {root + "[S1] b": 20, root + "[S1] b->[S1] c": 30, root + "[S1] d": 15}
    assert {"->".join(r["path"]): r["excl"] for r in errors.to_root_stacks(nodes).collect()} == {"[S1] a->[S1] b->[S1] c": 1, "[S1] a->[S1] d": 1}


def test_savings(spark):
    rows = [span("a", 0, 100), span("b", 10, 60, "a", is_error=True), span("c", 70, 90, "a")]
    r = whatif.savings(table(spark, rows)).first()
    assert (r["total_work"], r["saved_on_work"], r["saved_generic"], r["saved_series"]) == (170, 50, 50, 50)
    rows = [span("a", 0, 100), span("b", 10, 60, "a", is_error=True), span("c", 20, 55, "a")]  # c still runs to 55
    r = whatif.savings(table(spark, rows)).first()
    assert (r["saved_pessimistic"], r["saved_series"]) == (5, 5)


def test_change_projection_and_retiming_agree_on_a_chain(spark):
    server = {"kind": "SERVER"}
    rows = [span("a", 0, 100, **server), span("b", 10, 90, "a", **server), span("c", 20, 80, "b", **server)]
    r = whatif.latency_change(table(spark, rows), -20, ("S1", "c")).first()
    assert (r["matches"], r["change"], r["retimed_gain"]) == (1, -20, 20)
    r = whatif.latency_change(table(spark, rows), 30, ("S1", "c")).first()
    assert (r["change"], r["projected_latency"]) == (30, 130)
    assert {tuple(x["path"])[-1]: x["inc"] for x in whatif.projected_profile(table(spark, rows), 30, ("S1", "c")).collect()} == {"[S1] a": 130, "[S1] b": 110, "[S1] c": 90}


def test_retiming_a_span_that_moved_past_its_children(spark):
    server = {"kind": "SERVER", "op": "c"}
    rows = [
        span("r", 0, 10_000), span("a", 100, 1100, "r", host="h0", **server), span("ac", 2000, 2500, "a", host="h1"),  # a call that outlasts its caller by the clock
        span("q", 1200, 1300, "r", **server), span("qc", 1200, 1210, "q"), span("qd", 1205, 1215, "q"),
    ]
    # a must end with ac, at 2500; q comes after a and moves by 1400, beyond its children; it shrinks to nothing at 2600, not before.
    r = whatif.latency_change(table(spark, rows), -200, ("S1", "c")).first()
    assert (r["matches"], r["latency"], r["retimed_gain"]) == (2, 10_000, -1300)


def test_slack_and_drag(spark):
    rows = [span("a", 0, 100), span("b", 10, 40, "a"), span("c", 50, 90, "a"), span("d", 50, 70, "a")]
    nodes = tree.nodes(table(spark, rows))
    assert {r["span_id"]: (r["drag"], r["drag_excl"]) for r in slackdrag.drag(nodes).collect()} == {"a": (100, 10), "b": (30, 30), "c": (20, 20)}
    assert {r["span_id"]: r["slack"] for r in slackdrag.slack(nodes).collect()} == {"a": 0, "b": 0, "c": 0, "d": 90 - 20 - 40}
    deps = {(r["kind"], r["path"][-1], r["other"][-1]) for r in slackdrag.dependencies(table(spark, rows)).collect()}
    assert deps == {("before", "c", "b"), ("before", "d", "b"), ("dependent", "a", "b"), ("dependent", "a", "c"), ("dependent", "a", "d")}


def model(rows):
    """A plain model of repair and choice, written apart from the library's."""
    kids, byid = {}, {r["span_id"]: dict(r, end=r["start"] + r["dur"]) for r in rows}
    for r in byid.values():
        kids.setdefault(r["parent_id"], []).append(r)
    total = {}

    def go(p, on):
        live = []
        for c in kids.get(p["span_id"], []):
            if c["start"] < p["start"] < c["end"] <= p["end"]:
                c["start"] = p["start"]
            elif p["start"] <= c["start"] < p["end"] < c["end"]:
                c["end"] = p["end"]
            elif not (c["start"] >= p["start"] and c["end"] <= p["end"]):
                continue
            c["dur"] = c["end"] - c["start"]
            live.append(c)
        order = sorted(live, key=lambda c: (-c["end"], -c["span_ord"]))
        picks = []
        for c in order:
            if not picks:
                picks.append(c)
                continue
            q = picks[-1]
            events = sum(q["start"] <= t <= c["end"] for x in live for t in (x["start"], x["end"]))
            if c["end"] < q["start"] or (c["end"] < q["end"] and c["start"] < q["start"] and p["dur"] and (c["end"] - q["start"]) / p["dur"] < 0.01 and events == 2):
                picks.append(c)
        if on:
            total[p["span_id"]] = max(0, p["dur"] - sum(c["dur"] for c in picks))
        for c in live:
            go(c, on and c in picks)

    for r in kids[None]:
        go(r, True)
    return total


def test_random_trees_match_a_plain_model(spark):
    rng = random.Random(5)
    every, want = [], {}
    for t in range(60):
        rows = [span("0", 0, 1000)]
        for i in range(1, rng.randint(2, 25)):
            p = rng.choice(rows)
            a = p["start"] + rng.randint(-20, max(1, p["dur"]))
            rows.append(span(str(i), a, a + rng.randint(0, max(1, p["dur"])), p["span_id"]))
        rows = [r | {"trace_id": f"t{t}", "span_ord": i} for i, r in enumerate(rows)]
        every += rows
        want |= {(f"t{t}", k): v for k, v in model(rows).items()}
    got = {(r["trace_id"], r["span_id"]): r["own"] for r in profile.with_own_time(tree.nodes(spark.createDataFrame([tuple(r.values()) for r in every], "trace_id string, span_id string, span_ord int, parent_id string, service string, op string, kind string, host string, region string, start long, dur long, is_error boolean"))).where("on_cp").collect()}
    assert got == want


def document(trace, spans):
    return json.dumps({"data": [{"traceID": trace, "processes": {"p1": {"serviceName": "S1", "tags": [{"key": "hostname", "type": "string", "value": "h"}, {"key": "zone", "type": "string", "value": "z1"}]}}, "spans": spans}]})


def jspan(i, start, dur, parent=None, tags=(), logs=(), kind="CHILD_OF", ref="T"):
    refs = [{"refType": kind, "traceID": ref, "spanID": parent}] if parent else []
    return {"traceID": "T", "spanID": i, "operationName": f"op{i}", "processID": "p1", "startTime": start, "duration": dur, "references": refs, "tags": list(tags), "logs": list(logs), "warnings": None}


def test_json_source_and_sinks(spark, tmp_path):
    tag = lambda k, v, t="string": {"key": k, "type": t, "value": v}
    spans = [
        jspan("a", 0, 100, tags=[tag("SPAN.KIND", "server")]), jspan("b", 10, 50, "a", [tag("error", True, "bool")]), jspan("c", 70, 5, "a", [tag("error", False, "bool")]), jspan("d", 76, 5, "a", [tag("http.status_code", 403, "int64")]),
        jspan("e", 82, 5, "a", [tag("http.status_code", "odd")]), jspan("f", 88, 2, "a", [tag("grpc.status", "OK")]), jspan("g", 91, 2, "a", logs=[{"fields": [tag("event", "Error")]}]), jspan("h", 94, 2, "a", kind="FOLLOWS_FROM"),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(document("T", spans))
    (tmp_path / "in" / "bad.json").write_text("{nothing")
    got = {r["span_id"]: r for r in traces.json_spans(spark, str(tmp_path / "in")).collect()}
    assert {k for k, r in got.items() if r["is_error"]} == {"b", "d", "g"}
    assert (got["a"]["kind"], got["a"]["host"], got["a"]["region"], got["a"]["trace_file"], got["h"]["parent_id"], got["b"]["parent_id"]) == ("SERVER", "h", "z1", "one", None, "a")
    from spanloom.cli import main

    main([str(tmp_path / "in"), str(tmp_path / "out")], spark)
    again = traces.folded_profile(spark, str(tmp_path / "out" / "profile.cct")).collect()
    assert {(r["call_path"][-1]["op"], r["frequency"]) for r in again} >= {("opa", 1), ("opb", 1)}
    assert "digraph" in (tmp_path / "out" / "profile.dot").read_text()
    raw = (tmp_path / "out" / "profile.pb").read_bytes()
    assert len(list(wire.fields(raw))) == len(again)


def test_split_traces_merge(spark, tmp_path):
    child = document("C", [jspan("x", 20, 30, "b", kind="FOLLOWS_FROM"), jspan("y", 25, 5, "x", ref="C")])
    (tmp_path / "p.json").write_text(document("T", [jspan("a", 0, 100), jspan("b", 10, 60, "a")]))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.json").write_text(child)
    parent, docs = traces.json_spans(spark, str(tmp_path / "p.json")), traces.documents(spark, str(tmp_path / "c"))
    both = structure.merge_split(parent, traces.spans_of(docs), traces.references_of(docs))
    assert {r["span_id"]: r["depth"] for r in tree.nodes(both).collect()} == {"a": 1, "b": 2, "x": 3, "y": 4}
    (tmp_path / "c" / "c.json").write_text(child.replace('"spanID": "b"', '"spanID": "gone"'))
    docs = traces.documents(spark, str(tmp_path / "c"))
    with pytest.raises(MergeError):
        structure.merge_split(parent, traces.spans_of(docs), traces.references_of(docs))


def test_wire_stream():
    raw = wire.request_metadata("S", "O") + wire.request_trace(b"{}" * 100, wire.BASELINE) + wire.request_trace(b"[]", wire.COMPARISON)
    s = wire.Stream()
    got = [x for i in range(0, len(raw), 7) for x in s.feed(raw[i : i + 7])]
    s.close()
    assert (s.service, s.operation, got) == ("S", "O", [(1, b"{}" * 100), (2, b"[]")])
    with pytest.raises(InvalidRequest):
        list(wire.Stream().feed(wire.request_trace(b"{}")))
    cut = wire.Stream()
    list(cut.feed(raw[:-1]))
    with pytest.raises(InvalidRequest):
        cut.close()


def test_trace_search(spark, tmp_path):
    class Handler(BaseHTTPRequestHandler):
        seen = set()

        def do_GET(self):
            if "?" in self.path:
                a = int(self.path.split("start=")[1].split("&")[0])
                body = json.dumps({"data": [{"traceID": f"t{a + i}"} for i in range(3)]})
            elif self.path.endswith("t1") and self.path not in self.seen:
                self.seen.add(self.path)
                return self.send_error(503)
            elif self.path.endswith("t2"):
                return self.send_error(404)
            else:
                body = document(self.path.rsplit("/", 1)[1], [])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    search.register(spark)
    got = spark.read.format("trace_search").options(url=f"http://127.0.0.1:{server.server_port}", service="S", start="0", end="200", limit="20", per_query="10").load().collect()
    some = spark.read.format("trace_search").options(url=f"http://127.0.0.1:{server.server_port}", service="S", start="0", end="200").load()
    assert {(r["trace_id"], r["status"]) for r in some.where("trace_id in ('t500', 't2')").collect()} == {("t500", 200), ("t2", 404)}
    assert {(r["status"], r["n"]) for r in search.histogram(some.where("trace_id in ('t500', 't2')")).collect()} == {(200, 1), (404, 1)}
    from spanloom import cli

    out = str(tmp_path / "fetched")
    cli.main(["--download", f"http://127.0.0.1:{server.server_port}", out, "--service", "S", "--start", "0", "--end", "200", "--limit", "20"], spark)
    server.shutdown()
    assert spark.read.parquet(out).where("status = 200").count() == 2 and traces.any_spans(spark, out).count() == 0
    assert {(r["trace_id"], r["status"]) for r in got} == {("t0", 200), ("t1", 200), ("t2", 404), ("t100", 200), ("t101", 200), ("t102", 200)}
    assert search.shares([300, 700], 100) == [30, 70] and search.shares([3, 7], 100) == [3, 7]


def test_a_busy_slice_fills_the_limit(monkeypatch):
    have = {(0, "1"): 10, (100, "3"): 5}

    def answer(url, **_):
        q = {k: v[0] for k, v in urllib.parse.parse_qs(url.split("?")[1]).items()}
        n = min(int(q["limit"]), have.get((int(q["start"]), json.loads(q["tags"])["jaeger.flags"]), 0))
        return 200, json.dumps({"data": [{"traceID": f"t{int(q['start']) + i}"} for i in range(n)]}).encode()

    monkeypatch.setattr(search, "fetch", answer)
    ids = lambda limit: sorted(x for p in search.Reader({"url": "u", "service": "S", "start": "0", "end": "200", "limit": limit, "per_query": "8"}).partitions() for x in p.ids)
    assert ids("15") == sorted([f"t{i}" for i in range(10)] + [f"t{100 + i}" for i in range(5)])
    assert len(ids("9")) == 8  # 9 and 5 found: 5 and 3 stay in proportion


def test_yaml_lists():
    assert traces.merged_lists({"a": [1, 2], "b": [3]}, {"a": [2, 4], "c": 5}) == {"a": [1, 2, 4], "b": [3], "c": 5}
    assert traces.exclusions({"S": ["x", "y"]}) == {("S", "x"), ("S", "y")}


def test_stream_equals_batch(spark, tmp_path):
    from spanloom.streaming import windows

    rows = [(f"t{i % 4}", f"op{i % 3}", i * 10, i % 5 == 0, i) for i in range(40)]
    df = spark.createDataFrame(rows, "trace_id string, op string, dur long, is_error boolean, at long").select("*", F.timestamp_seconds(F.col("at") * 60).alias("event_time")).drop("at")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windows.summaries(stream, late="10 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("windows").collect()) == sorted(windows.summaries(df).collect())
    q = windows.analysed(windows.assembled(stream, "2 minutes", "1 minute"), lambda s: s.groupBy("trace_id").count(), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
