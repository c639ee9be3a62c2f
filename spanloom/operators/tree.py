"""Call trees: one pass per trace over spans that are dealt by trace and sorted by ordinal.

A trace is the unit of every per-trace result, so one shuffle by trace_id serves them all. What must run in order inside a
trace (choice of roots, clock-skew repair, choice of critical children), and what is cheap while its tree is at hand (sums over children,
what stands beside a span, slack), is done here, and its outcome is a flat table of nodes; everything after it is relational and needs no
join of nodes with nodes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.config import Knobs

SPAN_COLUMNS = ("trace_id", "span_id", "span_ord", "parent_id", "service", "op", "kind", "host", "region", "start", "dur", "is_error")
NODE_SCHEMA = (
    "trace_id string, root_id string, span_id string, span_ord int, parent_id string, depth int, path array<string>, "
    "service string, op string, kind string, host string, region string, start long, dur long, adj_start long, adj_end long, adj_dur long, is_error boolean, n_children int, "
    "picked boolean, on_cp boolean, cp_pos int, path_dur long, first_start long, last_end long, next_end long, parent_service string, parent_region string, parent_end long, slack long, "
    "err_children int, err_above boolean, err_on_path boolean, cycle_at int, full_kept boolean, full_on boolean, full_err_children int, off_dur long, "
    "stop_depth int, chain_ok boolean, prop_leaf boolean, change string"
)
#: Rows and array cells in a batch that a kernel emits.
MOST_ROWS, MOST_CELLS = 4096, 1 << 20


class Node:
    __slots__ = (
        "id", "ord", "parent", "children", "service", "op", "kind", "host", "region", "start0", "dur0", "start", "end", "dur", "error", "change", "picks", "key",
        "depth", "place", "picked", "entered", "kept", "stop", "chain", "above", "below", "own",
    )

    def __init__(self, row: tuple):
        _, self.id, self.ord, *_ = row
        self.parent, self.children, self.picks, self.change, self.own = None, [], [], "kept", None
        self.take(row)

    def take(self, row: tuple) -> None:
        _, _, _, self.key, self.service, self.op, self.kind, self.host, self.region, self.start, self.dur, error = row
        self.start0, self.dur0 = self.start, self.dur
        self.end = self.start + self.dur
        self.error = bool(error)

    @property
    def name(self) -> str:
        return f"[{self.service}] {self.op}"

    @property
    def what(self) -> tuple[str, str]:
        return (self.service, self.op)


def latest_first(nodes: Iterable[Node]) -> list[Node]:
    return sorted(nodes, key=lambda n: (n.end, n.ord), reverse=True)


class Siblings:
    """Some children of one parent, and which of them happen before which."""

    def __init__(self, parent: Node, members: Iterable[Node], overlap: float):
        self.dur, self.overlap, self.order, self._times = parent.dur, overlap, latest_first(members), None

    def events(self, first: int, last: int) -> int:
        """How many starts and ends lie in [first, last]."""
        if self._times is None:
            self._times = sorted(t for n in self.order for t in (n.start, n.end))
        return bisect_right(self._times, last) - bisect_left(self._times, first)

    def before(self, a: Node, b: Node) -> bool:
        """Whether a happens before b: it ends earlier, or they overlap by a little and no third event lies there."""
        if a.end < b.start:
            return True
        if a.end >= b.end or a.start >= b.start or self.dur <= 0 or (a.end - b.start) / self.dur >= self.overlap:
            return False
        return self.events(b.start, a.end) == 2

    def picks(self) -> list[Node]:
        """Those that decide when the parent ends, latest first."""
        out = self.order[:1]
        for n in self.order[1:]:
            if self.before(n, out[-1]):
                out.append(n)
        return out


class Tree:
    """The nodes under one root, repaired and with their critical children chosen."""

    def __init__(self, root: Node, knobs: Knobs):
        self.root, self.knobs = root, knobs
        self._pass_errors_up()
        self._repair()
        self.choose()

    def walk(self) -> Iterator[Node]:
        """Pre-order."""
        todo = [self.root]
        while todo:
            n = todo.pop()
            yield n
            todo += reversed(n.children)

    def choose(self) -> None:
        for n in self.walk():
            n.picks = Siblings(n, n.children, self.knobs.overlap).picks() if n.children else []

    def _pass_errors_up(self) -> None:
        if self.knobs.pass_through:
            for n in reversed(list(self.walk())):
                if n.what in self.knobs.pass_through and len(n.children) == 1:
                    n.error = n.children[0].error

    def _is_call(self, c: Node, p: Node) -> bool:
        if len(p.children) != 1 or c.dur > self.knobs.lengthening * p.dur:
            return False
        clean = c.kind == "SERVER" and p.kind == "CLIENT"
        fuzzy = c.kind == "SERVER" and p.kind != "SERVER" and p is not self.root and p.parent is not None and p.parent.kind == "SERVER"
        apart = c.host is not None and p.host is not None and c.host != p.host
        return clean or fuzzy or apart

    def _repair(self) -> None:
        """Top-down: fit every child into its repaired parent, or drop it with all below."""
        todo = [self.root]
        while todo:
            p = todo.pop()
            stay = []
            for c in p.children:
                if self._is_call(c, p):
                    c.change = "call" if c.dur <= p.dur else "call clamped"
                    c.dur = min(c.dur, p.dur)
                elif c.start >= p.start and c.end <= p.end:
                    pass
                elif c.start < p.start < c.end <= p.end:
                    c.dur, c.start, c.change = c.dur - (p.start - c.start), p.start, "early"
                elif p.start <= c.start < p.end < c.end:
                    c.dur, c.end, c.change = c.dur - (c.end - p.end), p.end, "late"
                else:
                    continue
                stay.append(c)
            p.children = stay
            todo += stay
        if self.knobs.excluded:
            for n in list(self.walk()):
                n.children = [c for c in n.children if c.what not in self.knobs.excluded]


def assemble(rows: list[tuple], knobs: Knobs) -> list[Node]:
    """Roots of one trace's rows, which come by ordinal. A later row of the same span id replaces its content, not its place."""
    nodes: dict[str, Node] = {}
    for row in rows:
        if row[1] in nodes:
            nodes[row[1]].take(row)
        else:
            nodes[row[1]] = Node(row)
    proxy = {i for i, n in nodes.items() if n.what in knobs.proxies} if knobs.proxies else ()

    def attach(n: Node) -> Node | None:
        seen, key = {n.id}, n.key
        while key in nodes and key not in seen:
            if key not in proxy:
                return nodes[key]
            seen.add(key)
            key = nodes[key].key
        return None

    tops = []
    for i, n in nodes.items():
        if i in proxy:
            continue
        n.parent = attach(n)
        if n.parent is None:
            tops.append(n)
        else:
            n.parent.children.append(n)
    if knobs.root is None:
        return tops
    if knobs.sole_root:
        return tops if len(tops) == 1 and tops[0].what == knobs.root else []
    for top in tops:
        todo = [top]
        while todo:
            n = todo.pop()
            if n.what == knobs.root:
                n.parent = None
                return [n]
            todo += reversed(n.children)
    return []


def path_of(n: Node, root: Node) -> list[str]:
    out = [n.name]
    while n is not root:
        n = n.parent
        out.append(n.name)
    return out[::-1]


def describe(tree: Tree, trace_id: str) -> Iterator[tuple]:
    """Rows of NODE_SCHEMA. Paths are made one by one, as their rows leave, so that a deep tree is never held with all of them."""
    root, order = tree.root, list(tree.walk())
    for n in order:
        n.place, n.picked, n.entered, n.own = None, n is root, n is root, None
    todo, many = [root], 0
    while todo:  # root, then its critical children latest first, each with its own before the next
        n = todo.pop()
        n.place, many = many, many + 1
        todo += reversed(n.picks)
    root.depth, root.stop, root.chain, root.above = 1, 0, root.error, False
    for p in order:
        for c in p.picks:
            c.picked = True
        go = p.entered and (p.error or p.place is not None)
        for c in p.children:
            c.depth, c.stop, c.chain, c.above = p.depth + 1, p.stop if p.error else p.depth, p.chain and c.error, p.above or p.error
            if go and (c.picked or p.error):
                c.entered = True
    for n in reversed(order):
        n.kept = n.entered and (n.error or (n.place is not None and any(c.kept and c.picked for c in n.children)))
        n.below = n.place is not None and (n.error or any(c.place is not None and c.below for c in n.children))
    leaf, cycle, beside = _propagating(tree), _cycles(tree), _beside(order)
    for n in order:
        p = n.parent if n is not root else None
        kids = n.children
        next_end, slack = beside.get(n.id, (None, 0))
        yield (
            trace_id, root.id, n.id, n.ord, p.id if p else None, n.depth, path_of(n, root), n.service, n.op, n.kind, n.host, n.region, n.start0, n.dur0, n.start, n.end, n.dur, n.error, len(kids),
            n.picked, n.place is not None, n.place, sum(c.dur for c in n.picks) if n.place is not None else 0, min((c.start for c in kids), default=None), max((c.end for c in kids), default=None), next_end,
            p.service if p else None, p.region if p else None, p.end if p else None, slack,
            sum(c.error for c in kids), n.above, n.below, cycle.get(n.id), n.kept, n.place is not None and n.entered, sum(c.kept and c.error for c in kids), sum(c.dur for c in kids if c.kept and c.error and c.place is None),
            n.stop, n.chain, n.id in leaf, n.change,
        )


def _beside(order: list[Node]) -> dict[str, tuple[int | None, int]]:
    """By span id: the end of the sibling that ends next before it, and the slack.

    Slack is the latest start that leaves the critical path alone (the end of the first on-path sibling that ends later, else of the parent,
    less the own duration), less the earliest start (the last end of siblings that ended before it began, else the first start among them)."""
    out: dict[str, tuple[int | None, int]] = {}
    for p in order:
        kids = p.children
        if not kids:
            continue
        by_end = latest_first(kids)
        nexts = [c.end for c in by_end[1:]] + [None]
        ends, on = sorted(c.end for c in kids), sorted(c.end for c in kids if c.place is not None)
        first = min(c.start for c in kids)
        for c, next_end in zip(by_end, nexts):
            if c.place is not None:
                out[c.id] = (next_end, 0)
                continue
            later, earlier = bisect_right(on, c.end), bisect_left(ends, c.start)
            critical = on[later] if later < len(on) else p.end
            out[c.id] = (next_end, critical - c.dur - (ends[earlier - 1] if earlier else first))
    return out


def _cycles(tree: Tree) -> dict[str, int]:
    """For each client node whose operation stands above it as a client too: the depth of the last such node."""
    out: dict[str, int] = {}
    last: dict[tuple[str, str], list[int]] = {}
    todo: list[tuple[Node, bool]] = [(tree.root, True)]
    while todo:
        n, enters = todo.pop()
        if n.kind == "CLIENT":
            above = last.setdefault(n.what, [])
            if not enters:
                above.pop()
                continue
            if above:
                out[n.id] = above[-1]
            above.append(n.depth)
            todo.append((n, False))
        todo += [(c, True) for c in n.children] if enters else []
    return out


def _propagating(tree: Tree) -> set[str]:
    """Erroring nodes that errors reach the root from and that have no reported error below."""
    visited: set[str] = set()
    todo = [tree.root]
    while todo:
        n = todo.pop()
        rpc = n.kind in ("SERVER", "CLIENT")
        if rpc and not n.error:
            continue
        visited.add(n.id)
        todo += n.children if n.error else [c for c in n.children if c.service == n.service]
    reports: dict[str, bool] = {}
    leaves = set()
    for n in reversed(list(tree.walk())):
        if n.id in visited:
            below = [c for c in n.children if n.error or c.service == n.service]
            some = any(reports.get(c.id, False) for c in below)
            reports[n.id] = n.error or some
            if n.error and not some:
                leaves.add(n.id)
    return leaves


def per_trace(spans: DataFrame, work: Callable[[str, list[tuple]], Iterable[tuple]], schema: str, columns: tuple[str, ...] = SPAN_COLUMNS) -> DataFrame:
    """`work(trace_id, rows)` for each trace: one shuffle by trace, then a stream over sorted rows. Memory follows the largest trace; what
    `work` yields leaves in batches of bounded size, within a trace too."""
    kinds = [f.strip() for f in _split(schema)]
    names = [k.split(" ", 1)[0] for k in kinds]
    types = [_arrow(k.split(" ", 1)[1]) for k in kinds]
    lists = [i for i, k in enumerate(kinds) if " array<" in k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        def traces() -> Iterator[tuple[str, list[tuple]]]:
            trace, rows = None, []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if row[0] != trace:
                        if rows:
                            yield trace, rows
                        trace, rows = row[0], []
                    rows.append(row)
            if rows:
                yield trace, rows

        out, cells = [], 0
        for trace, rows in traces():
            for row in work(trace, rows):
                out.append(row)
                cells += sum(len(row[i]) for i in lists)
                if len(out) >= MOST_ROWS or cells >= MOST_CELLS:
                    yield emit(out)
                    out, cells = [], 0
        if out:
            yield emit(out)

    dealt = spans.where("trace_id is not null and span_id is not null").select(*columns).repartition("trace_id").sortWithinPartitions("trace_id", "span_ord")
    return dealt.mapInArrow(run, schema)


def _split(schema: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]


def _arrow(kind: str) -> pa.DataType:
    plain = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.list_(_arrow(kind[6:-1])) if kind.startswith("array<") else plain[kind]


def is_test(rows: list[tuple], knobs: Knobs) -> bool:
    """Whether a trace holds a span of a test service, or one whose operation has a test prefix."""
    return any(row[4] in knobs.test_services or (row[5] or "").startswith(knobs.test_prefixes) for row in rows)


def trees(rows: list[tuple], knobs: Knobs) -> Iterator[Tree]:
    """The analysed trees of one trace; none of a test trace."""
    if (knobs.test_services or knobs.test_prefixes) and is_test(rows, knobs):
        return
    for root in assemble(rows, knobs):
        yield Tree(root, knobs)


def nodes(spans: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """The nodes of all analysed trees."""

    def work(trace_id: str, rows: list[tuple]) -> Iterator[tuple]:
        for tree in trees(rows, knobs):
            yield from describe(tree, trace_id)

    return per_trace(spans, work, NODE_SCHEMA)
