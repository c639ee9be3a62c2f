"""Registered queries of the trace engine over spans derived from `events`, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import Knobs
from spanloom.functions import expr
from spanloom.operators import errors, flame, latency, profile, slackdrag, structure, tree, whatif
from spanloom.plans import derive
from spanloom.plans.derive import SQL, spans
from spanloom.scratch import cut
from spanloom.sources import traces
from spanloom.streaming import windows

RANGES = {"P50": (0, 50), "P95": (50, 95), "P99": (95, 99), "P100": (99, 100)}
TARGET = ("S1", "purchase")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = SQL):
    """Register a query, and its SQL behind the common CTEs (or others)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ctes + sql
        return f

    return add


def _nodes(s: SparkSession, d: str, knobs: Knobs = Knobs()) -> DataFrame:
    return tree.nodes(spans(s, d), knobs)


def _profile(s: SparkSession, d: str) -> DataFrame:
    return profile.per_trace(_nodes(s, d))


def _documents(s: SparkSession, d: str) -> DataFrame:
    """Trace documents as JSON says them, parsed: references with decoys before the one that counts, tags in odd cases, errors in every form."""
    e = F.col("event_id")
    tag = lambda key, value, kind="string": F.struct(F.lit(key).alias("key"), F.lit(kind).alias("type"), value.cast("string").alias("value"))
    ref = lambda kind, span: F.struct(F.lit(kind).alias("refType"), F.col("trace_id").alias("traceID"), span.alias("spanID"))
    references = F.when(F.col("parent_id").isNull(), F.array(ref("FOLLOWS_FROM", F.lit("9")))).otherwise(F.array(ref("CHILD_OF", F.lit("99")), ref("CHILD_OF", F.col("parent_id")), ref("FOLLOWS_FROM", F.lit("0"))))
    stated = [tag("Error", F.lit("true"), "bool"), tag("error", F.lit("false")), tag("HTTP.status_code", F.lit("503"), "int64"), tag("grpc.status", F.lit("UNAVAILABLE")), None, None, tag("error", F.lit("false"), "bool"), tag("http.status_code", F.lit("odd")), tag("grpc.status", F.lit("OK"))]
    own = [F.when(e % 9 == i, t) for i, t in enumerate(stated) if t is not None]
    tags = F.array_compact(F.array(*own, tag("Span.Kind", F.lower("kind")), tag("span.kind", F.lit("server")), F.when(e % 4 == 0, tag("peer.service", F.concat(F.lit("peer"), (e % 5).cast("string"))))))
    logs = F.array(F.struct(F.array(tag("event", F.when(e % 9 == 4, "ERROR").otherwise("begin"))).alias("fields")), F.struct(F.array(tag("other", F.lit("x")), F.when(e % 9 == 5, tag("error.object", F.lit("x"))).otherwise(tag("more", F.lit("y")))).alias("fields")))
    host = F.when(F.col("host").isNotNull(), tag("hostname", F.col("host")))
    where = F.when(e % 2 == 0, F.array(tag("zone", F.lit("z9")), tag("region", F.lit("old")), tag("region", F.col("region")))).otherwise(F.array(tag("zone", F.concat(F.lit("z"), (e % 3).cast("string"))), tag("zone", F.lit("z9"))))
    process = F.struct(F.concat(F.lit("p"), F.col("span_id")).alias("key"), F.struct(F.col("service").alias("serviceName"), F.concat(F.array_compact(F.array(host)), where).alias("tags")).alias("value"))
    span = F.struct(F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"), F.col("op").alias("operationName"), F.concat(F.lit("p"), F.col("span_id")).alias("processID"), F.col("start").alias("startTime"), F.col("dur").alias("duration"), references.alias("references"), tags.alias("tags"), logs.alias("logs"))
    one = spans(s, d).select("trace_id", "span_ord", span.alias("span"), process.alias("process"))
    one = one.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("span_ord", "span"))), lambda x: x["span"]).alias("spans"), F.map_from_entries(F.collect_list("process")).alias("processes"))
    text = F.to_json(F.struct(F.array(F.struct(F.col("trace_id").alias("traceID"), "processes", "spans")).alias("data")))
    return one.select(F.col("trace_id").alias("trace_file"), F.from_json(text, traces.DOCUMENT).alias("x")).select("trace_file", "x.data")


def _nested(s: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    status = F.array(F.struct(F.lit("http.status_code").alias("key"), F.when(e % 5 == 2, "404").otherwise("200").alias("value")))
    kind = F.when(F.col("kind") == "CLIENT", 3).when(F.col("kind") == "SERVER", 2).otherwise(1)
    number = lambda c: (F.col(c).cast("long") + 1)
    one = F.struct(
        number("span_id").alias("span_id"), F.coalesce(number("parent_id"), F.lit(0)).alias("parent_span_id"), kind.alias("kind"), F.col("op").alias("operation_name"), (F.col("start") * 1000).alias("start_time_unix_nano"),
        (F.col("dur") * 1000 + 999).alias("duration_nano"), (e % 5 == 0).alias("error"), F.when(e % 5 == 1, 14).otherwise(0).alias("rpc_status_code"), status.alias("StringTags"))
    sets = spans(s, d).groupBy("trace_id", "service", "host").agg(F.array_sort(F.collect_list(one)).alias("spans")).select("trace_id", F.struct(F.struct(F.col("service").alias("service_name"), F.col("host").alias("host_name")).alias("process"), "spans").alias("set"))
    return sets.groupBy("trace_id").agg(F.array_sort(F.collect_list("set")).alias("span_set"))


def _split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sp = spans(s, d).drop("event_id", "value", "ts")
    below = F.expr("span_ord = 2 or (span_ord > 2 and ((span_ord - 1) div 3 = 2 or ((span_ord - 1) div 3 - 1) div 3 = 2 or (((span_ord - 1) div 3 - 1) div 3 - 1) div 3 = 2))")
    child = sp.where(below).withColumn("trace_id", F.concat(F.lit("c"), F.col("trace_id"))).withColumn("parent_id", F.when(F.col("span_ord") > 2, F.col("parent_id")))
    links = child.where("span_ord = 2").select("trace_id", "span_id", "span_ord", F.lit("FOLLOWS_FROM").alias("ref_type"), F.expr("substring(trace_id, 2)").alias("ref_trace_id"), F.lit("0").alias("ref_span_id"))
    return sp.where(~below), child, links


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("path", profile.name(F.col("path"))) if dict(df.dtypes).get("path", "").startswith("array") else df


@query("SELECT tid::VARCHAR AS trace_id, k::VARCHAR AS span_id, k AS span_ord, pk::VARCHAR AS parent_id, svc AS service, op, kind, host, region, s AS start, d AS dur, err AS is_error FROM sp")
def spans_derived(s, d):
    """The spans themselves, which the other queries analyse."""
    return spans(s, d).drop("event_id", "value", "ts")


@query("SELECT tid::VARCHAR AS trace_id, svc AS service, op, '[' || svc || '] ' || op AS name, lower(printf('%016x', tid)) AS hex_id, regexp_replace(op, '[^a-zA-Z0-9_]+', '_', 'g') AS plain FROM sp WHERE pk IS NULL")
def b_projections(s, d):
    """B7, B8, B11, B14, D3."""
    r = structure.first_roots(spans(s, d))
    return r.select("trace_id", "service", "op", expr.op_name(F.col("service"), F.col("op")).alias("name"), expr.hex_id(F.col("trace_id").cast("long")).alias("hex_id"), expr.plain(F.col("op")).alias("plain"))


@query("SELECT tid::VARCHAR AS trace_id, '0' AS root_id, k::VARCHAR AS span_id, depth, path, s AS adj_start, e AS adj_end, d AS adj_dur, change, nch AS n_children FROM (SELECT cp.*, nd.change AS change_ FROM cp JOIN nd USING (tid, k))")
def e2_repaired_nodes(s, d):
    """Depth, path and repaired times of every node that stays."""
    return _flat(_nodes(s, d).select("trace_id", "root_id", "span_id", "depth", "path", "adj_start", "adj_end", "adj_dur", "change", F.col("n_children").cast("long").alias("n_children")))


@query("SELECT change, count(*) AS n, sum(d0 - d)::BIGINT AS shrink FROM nd GROUP BY change")
def e2_repair_stats(s, d):
    """E2 counters."""
    return _nodes(s, d).groupBy("change").agg(F.count("*").alias("n"), F.sum(F.col("dur") - F.col("adj_dur")).alias("shrink"))


@query("SELECT tid::VARCHAR AS trace_id, k::VARCHAR AS span_id, path, picked, on_cp FROM cp")
def e3_critical_path(s, d):
    """Which child decides, and which nodes lie on the path."""
    return _flat(_nodes(s, d).select("trace_id", "span_id", "path", "picked", "on_cp"))


ORDER = """, po0 AS (SELECT tid, k, []::INT[] AS key FROM cp WHERE pk IS NULL UNION ALL SELECT c.tid, c.k, list_append(o.key, ch.r::INT) FROM po0 o JOIN cp c ON c.tid = o.tid AND c.pk = o.k AND c.on_cp JOIN ch ON ch.tid = c.tid AND ch.k = c.k),
po AS MATERIALIZED (SELECT tid, k, (row_number() OVER (PARTITION BY tid ORDER BY key) - 1)::INT AS pos FROM po0)
"""


@query(ORDER + "SELECT tid::VARCHAR AS trace_id, '0' AS root_id, pos AS cp_pos, k::VARCHAR AS span_id FROM po")
def e4_path_order(s, d):
    """Nodes of the path in its own order."""
    return _nodes(s, d).where("on_cp").select("trace_id", "root_id", "cp_pos", "span_id")


@query("SELECT tid::VARCHAR AS trace_id, path, inc, excl, freq FROM pr")
def j1_profile(s, d):
    """Inclusive and exclusive time and frequency by call path of each trace."""
    return _flat(_profile(s, d).select("trace_id", "path", "inc", "excl", "freq"))


@query("SELECT tid::VARCHAR AS trace_id, k::VARCHAR AS span_id, own::BIGINT AS own FROM cp WHERE on_cp")
def j2_span_exclusive(s, d):
    """J2."""
    return profile.with_own_time(_nodes(s, d)).where("on_cp").select("trace_id", "span_id", "own")


MERGED = "(SELECT path, sum(inc)::BIGINT AS inc, sum(excl)::BIGINT AS excl, sum(freq)::BIGINT AS freq, count(*) AS in_trees, (sum(inc) // (SELECT count(*) FROM lat))::BIGINT AS avg_inc, (sum(excl) // (SELECT count(*) FROM lat))::BIGINT AS avg_excl, (arg_min(tid, (-inc, tid)))::VARCHAR AS worst_trace FROM pr GROUP BY path)"


@query(f"SELECT path, inc, excl, freq, in_trees, avg_inc, avg_excl FROM {MERGED}")
def j4_merged_profile(s, d):
    """J3, J4, Q-5: the flagship - mean exclusive critical-path time and frequency by call path."""
    return _flat(profile.merged(_profile(s, d)).select("path", "inc", "excl", "freq", "in_trees", "avg_inc", "avg_excl"))


@query("SELECT path, (arg_min(tid, (-inc, lpad(tid::VARCHAR, 20, '0'))))::VARCHAR AS worst_trace FROM pr GROUP BY path")
def j5_worst_trace(s, d):
    """J0, J5."""
    p = _profile(s, d)
    return _flat(p.groupBy("path").agg(F.min_by("trace_id", F.struct(-F.col("inc"), F.lpad("trace_id", 20, "0"))).alias("worst_trace")))


@query("SELECT path, rank::INT AS rank, tid::VARCHAR AS trace_id, worst FROM (SELECT path, tid, max(d) AS worst, row_number() OVER (PARTITION BY path ORDER BY max(d) DESC, tid::VARCHAR) AS rank FROM cp WHERE on_cp GROUP BY path, tid) WHERE rank <= 3")
def j6_exemplars(s, d):
    """J6, L4, D9."""
    return _flat(profile.exemplars(_profile(s, d)).select("path", "rank", "trace_id", "worst"))


FOLDED = f"(SELECT replace(replace(path, ';', '_'), '->', ';') AS stack, CASE WHEN avg_excl = 0 AND NOT EXISTS (SELECT 1 FROM {MERGED} y WHERE starts_with(y.path, x.path || '->')) THEN 1 ELSE avg_excl END AS value, freq FROM {MERGED} x)"


@query(f"SELECT stack, value::BIGINT AS value, freq FROM {FOLDED}")
def j7_folded(s, d):
    """Folded stacks; zero leaves are 1."""
    return profile.folded(_profile(s, d), True)


@query(f"SELECT regexp_replace(array_to_string(list_transform(string_split(stack, ';'), lambda x: substr(x, 2)), '>'), '\\] ', ':', 'g') AS path, value::BIGINT AS duration, freq AS frequency FROM {FOLDED}")
def a19_folded_source(s, d):
    """Folded text read back."""
    lines = profile.cct_lines(_profile(s, d))
    got = traces.folded_rows(lines.unionByName(s.createDataFrame([("no profile line",), ("[S] cut 5",), ("# 1 <<2>>",)], "value string")))
    return got.select(F.array_join(F.transform("call_path", lambda x: F.concat_ws(":", x["service"], x["op"])), ">").alias("path"), "duration", "frequency")


@query(f"SELECT sum(length(stack) + length(value::VARCHAR) + length(freq::VARCHAR) + 7)::BIGINT AS bytes, count(*) AS lines FROM {FOLDED}")
def b17_profile_size(s, d):
    """Bytes of the .cct text, a line break each."""
    return profile.cct_lines(_profile(s, d)).agg(F.sum(F.length("value") + 1).alias("bytes"), F.count("*").alias("lines"))


@query(f"SELECT array_to_string(p[1:i], ';') AS prefix, sum(value) FILTER (WHERE i = len(p))::BIGINT AS excl0, sum(CASE WHEN i = len(p) THEN value ELSE 0 END)::BIGINT AS excl, sum(value)::BIGINT AS inc FROM (SELECT string_split(stack, ';') AS p, value FROM {FOLDED}), unnest(range(1, len(p) + 1)) AS u(i) GROUP BY 1".replace("sum(value) FILTER (WHERE i = len(p))::BIGINT AS excl0, ", ""))
def a17_tree_graph(s, d):
    """Inclusive time of every prefix."""
    return profile.tree_graph(profile.folded(_profile(s, d)))[0]


@query("SELECT tid::VARCHAR AS trace_id, string_split(path, '->')[-1] AS op, sum(excl)::BIGINT AS t FROM pr GROUP BY 1, 2")
def j9_time_by_op(s, d):
    """J9, B10."""
    return profile.by_op(_profile(s, d)).select("trace_id", "op", "t")


@query("SELECT op, sum(t)::BIGINT AS total, count(*) FILTER (WHERE t <> 0) AS occurrences, (arg_min(tid, (-t, tid)))::VARCHAR AS worst_trace, any_value(chains) AS chains FROM (SELECT tid, string_split(path, '->')[-1] AS op, sum(excl) AS t FROM pr GROUP BY 1, 2) JOIN (SELECT string_split(path, '->')[-1] AS op, count(DISTINCT path) AS chains FROM pr GROUP BY 1) USING (op) GROUP BY op")
def j10_op_totals(s, d):
    """J10, J11, J16."""
    return latency.op_totals(_profile(s, d))


@query("SELECT DISTINCT x.tid::VARCHAR AS trace_id, x.k::VARCHAR AS span_id FROM cp x WHERE x.on_cp AND (x.err OR EXISTS (SELECT 1 FROM cp y WHERE y.tid = x.tid AND y.on_cp AND y.err AND (y.k = x.k OR (y.k - 1) // 3 = x.k OR ((y.k - 1) // 3 - 1) // 3 = x.k OR (((y.k - 1) // 3 - 1) // 3 - 1) // 3 = x.k) AND y.k > x.k))")
def e5_errors_on_path(s, d):
    """E5."""
    return errors.errors_on_path(_nodes(s, d)).select("trace_id", "span_id")


VISIT = """, vi AS (SELECT tid, k, pk, d, path, err, on_cp, own, on_cp AS on_, err OR on_cp AS go FROM cp WHERE k = 0
  UNION ALL SELECT c.tid, c.k, c.pk, c.d, c.path, c.err, c.on_cp, c.own, p.on_ AND c.picked, c.err OR (p.on_ AND c.picked) FROM vi p JOIN cp c ON c.tid = p.tid AND c.pk = p.k WHERE p.go AND (c.picked OR p.err))
"""


@query(VISIT + """SELECT tid::VARCHAR AS trace_id, CASE WHEN on_cp THEN 'errorCriticalPathSyntheticRoot->' ELSE 'fullErrorsNonCPSyntheticRoot->' END || path AS path,
  sum(CASE WHEN on_cp THEN own ELSE greatest(0, d - coalesce((SELECT sum(d) FROM vi y WHERE y.tid = x.tid AND y.pk = x.k AND y.err AND NOT y.on_cp AND y.go), 0)) END)::BIGINT AS excl, count(*) AS freq FROM vi x WHERE err AND go GROUP BY 1, 2""")
def h9_full_error_profile(s, d):
    """E6, H9, H15."""
    return _flat(errors.full_profile(_nodes(s, d)).where("freq > 0").select("trace_id", "path", "excl", "freq"))


@query(VISIT + """, kp AS (SELECT *, EXISTS (SELECT 1 FROM vi y WHERE y.tid = x.tid AND y.pk = x.k AND y.err) AS more FROM vi x WHERE x.go)
SELECT tid::VARCHAR AS trace_id, CASE WHEN on_cp THEN 'errorCriticalPathSyntheticRoot->' ELSE 'fullErrorsNonCPSyntheticRoot->' END || path AS path, count(*) FILTER (WHERE err AND NOT more) AS self_errors, count(*) FILTER (WHERE err AND more) AS propagated, count(*) FILTER (WHERE NOT err) AS stopped FROM kp WHERE err OR more GROUP BY 1, 2""")
def h9_error_path_counts(s, d):
    """H9: errors that begin, pass and stop along the full error path."""
    return _flat(errors.full_profile(_nodes(s, d)).select("trace_id", "path", "self_errors", "propagated", "stopped"))


TO_ROOT = """, wk AS (SELECT tid, k, path, svc, err FROM nd WHERE pk IS NULL AND (err OR kind NOT IN ('SERVER', 'CLIENT'))
  UNION ALL SELECT c.tid, c.k, c.path, c.svc, c.err FROM wk p JOIN nd c ON c.tid = p.tid AND c.pk = p.k WHERE (p.err OR c.svc = p.svc) AND (c.err OR c.kind NOT IN ('SERVER', 'CLIENT'))),
tr AS MATERIALIZED (SELECT tid, path, count(*) AS n FROM wk x WHERE err AND NOT EXISTS (SELECT 1 FROM wk y WHERE y.tid = x.tid AND y.err AND y.k > x.k AND ((y.k - 1) // 3 = x.k OR ((y.k - 1) // 3 - 1) // 3 = x.k OR (((y.k - 1) // 3 - 1) // 3 - 1) // 3 = x.k)) GROUP BY 1, 2)
"""


@query(TO_ROOT + "SELECT tid::VARCHAR AS trace_id, path, n FROM tr")
def e8_errors_to_root(s, d):
    """E8."""
    return _flat(errors.to_root_stacks(_nodes(s, d)).select("trace_id", "path", F.col("excl").alias("n")))


CLASS = """, cl0 AS (SELECT tid, k, depth, path, op, svc, err, on_cp, nch, nerr, d, 0 AS stop, err AS chain, false AS above FROM cp WHERE k = 0
  UNION ALL SELECT c.tid, c.k, c.depth, c.path, c.op, c.svc, c.err, c.on_cp, c.nch, c.nerr, c.d, CASE WHEN p.err THEN p.stop ELSE p.depth END, p.chain AND c.err, p.above OR p.err FROM cl0 p JOIN cp c ON c.tid = p.tid AND c.pk = p.k),
cl AS MATERIALIZED (SELECT *, CASE WHEN err AND nerr > 0 THEN 'propagated' WHEN err THEN 'self' WHEN nerr > 0 THEN 'stopped' END AS class FROM cl0)
"""


@query(CLASS + "SELECT path, count(*) FILTER (WHERE class = 'self') AS self_errors, count(*) FILTER (WHERE class = 'propagated') AS propagated, count(*) FILTER (WHERE class = 'stopped') AS stopped FROM cl WHERE class IS NOT NULL GROUP BY path")
def h1_error_counts(s, d):
    """H1."""
    return _flat(errors.counts(errors.classified(_nodes(s, d)), "path"))


@query(CLASS + "SELECT depth - stop AS propagation, count(*) AS n FROM cl WHERE class = 'self' GROUP BY 1")
def h2_propagation(s, d):
    """H2."""
    return errors.classified(_nodes(s, d)).where("class = 'self'").groupBy("propagation").agg(F.count("*").alias("n"))


@query(CLASS + "SELECT tid::VARCHAR AS trace_id, count(*) FILTER (WHERE class = 'self') AS self_errors, coalesce(max(depth) FILTER (WHERE class = 'self'), -1) AS deepest_self, coalesce(max(depth) FILTER (WHERE class = 'stopped'), -1) AS deepest_stopped FROM cl GROUP BY 1")
def h3_error_depths(s, d):
    """H3, H12."""
    c = errors.classified(_nodes(s, d))
    of = lambda k: F.coalesce(F.max(F.when(F.col("class") == k, F.col("depth"))), F.lit(-1))
    return c.groupBy("trace_id").agg(F.count(F.when(F.col("class") == "self", 1)).alias("self_errors"), of("self").alias("deepest_self"), of("stopped").alias("deepest_stopped"))


@query(CLASS + "SELECT '[' || svc || '] ' || op AS op, count(*) FILTER (WHERE class = 'stopped') AS stopped, count(*) FILTER (WHERE class = 'propagated') AS propagated, count(*) FILTER (WHERE class = 'stopped') / count(*) AS resiliency FROM cl WHERE class IN ('stopped', 'propagated') GROUP BY 1")
def h4_resiliency(s, d):
    """H4."""
    return errors.resiliency(errors.classified(_nodes(s, d)))


@query(CLASS + "SELECT max_depth, count(*) AS trees, sum(tree_depth)::BIGINT AS depths FROM (SELECT tid, coalesce(max(depth) FILTER (WHERE chain AND nch = 0), -1) AS max_depth, max(depth) AS tree_depth FROM cl GROUP BY tid) GROUP BY 1")
def h5_deepest_to_root(s, d):
    """H5, H13."""
    return errors.deepest(_nodes(s, d)).groupBy("max_depth").agg(F.count("*").alias("trees"), F.sum("tree_depth").alias("depths"))


@query(CLASS + "SELECT class, depth, CASE WHEN class = 'self' THEN chain END AS to_root, on_cp AS on_path, count(*) AS n FROM cl WHERE class IN ('self', 'stopped') GROUP BY 1, 2, 3, 4")
def h6_depth_histogram(s, d):
    """H6, H7, D12, P2."""
    return errors.depth_histogram(errors.classified(_nodes(s, d)))


@query(CLASS + "SELECT count(*) AS items, min(depth) AS p0, l[least(n // 2, n - 1) + 1] AS p50, l[least(floor(n * 0.9)::BIGINT, n - 1) + 1] AS p90, l[least(floor(n * 0.95)::BIGINT, n - 1) + 1] AS p95, l[least(floor(n * 0.99)::BIGINT, n - 1) + 1] AS p99, l[n] AS p100, sum(depth) / count(*) AS avg FROM (SELECT depth, list(depth ORDER BY depth) OVER () AS l, count(*) OVER () AS n FROM cl WHERE class = 'self') GROUP BY l, n".replace("list(depth ORDER BY depth) OVER ()", "(SELECT list(depth ORDER BY depth) FROM cl WHERE class = 'self')"))
def h8_quantised_depths(s, d):
    """H8, K9, K12."""
    return errors.quantised(errors.classified(_nodes(s, d)))


@query("SELECT least(e * 10 // n, 9) AS bin, count(*) AS trees FROM (SELECT tid, count(*) FILTER (WHERE err) AS e, count(*) AS n FROM cp GROUP BY tid) GROUP BY 1")
def h11_percent_errors(s, d):
    """H11, N7."""
    return errors.percent_histogram(_nodes(s, d))


@query(CLASS + "SELECT q AS percentile, v::DOUBLE AS depth, count(*) AS trees FROM (SELECT tid, unnest([0.0, 0.5, 0.9, 0.95, 0.99, 1.0])::DOUBLE AS q, unnest(quantile_cont(depth, [0.0, 0.5, 0.9, 0.95, 0.99, 1.0])) AS v FROM cl WHERE class = 'self' GROUP BY tid) GROUP BY 1, 2")
def h14_depth_percentiles(s, d):
    """H14."""
    qs = [0.0, 0.5, 0.9, 0.95, 0.99, 1.0]
    c = errors.classified(_nodes(s, d)).where("class = 'self'").groupBy("trace_id").agg(F.percentile("depth", F.array(*map(F.lit, qs))).alias("v"))
    return c.select(F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("percentile"), F.col("v").alias("depth"))).alias("x")).groupBy("x.percentile", "x.depth").agg(F.count("*").alias("trees"))


@query("SELECT tid::VARCHAR AS trace_id, sum(d)::BIGINT AS total_work, coalesce(sum(d) FILTER (WHERE err), 0)::BIGINT AS saved_on_work FROM cp GROUP BY 1")
def g1_work(s, d):
    """G1."""
    return _nodes(s, d).groupBy("trace_id").agg(F.sum("adj_dur").alias("total_work"), F.coalesce(F.sum(F.when(F.col("is_error"), F.col("adj_dur"))), F.lit(0)).alias("saved_on_work"))


@query()
def g6_savings(s, d):
    """Time saved by every strategy."""
    return whatif.savings(spans(s, d))


@query()
def g7_latency_change(s, d):
    """Change, projection and retiming of one method."""
    return whatif.latency_change(spans(s, d), -50_000, TARGET)


@query()
def g8_projected_profile(s, d):
    """G8."""
    return _flat(whatif.projected_profile(spans(s, d), -50_000, TARGET))


@query(CLASS + """, tn AS (SELECT x.tid, '[' || svc || '] ' || op AS op, sum(CASE WHEN above THEN 0 ELSE x.d END)::BIGINT AS saved, count(*) AS n FROM cl x WHERE on_cp AND err GROUP BY 1, 2)
SELECT tn.op, sum(saved)::BIGINT AS saved, sum(r.d)::BIGINT AS latency, sum(n)::BIGINT AS count, sum(saved)::BIGINT / sum(r.d)::BIGINT AS ratio FROM tn JOIN nd r ON r.tid = tn.tid AND r.k = 0 AND NOT r.err GROUP BY tn.op""")
def h10_saving_potential(s, d):
    """H10."""
    return errors.saving_potential(_nodes(s, d))


@query("SELECT tid::VARCHAR AS trace_id, k::VARCHAR AS span_id, drag, least(drag, own, CASE WHEN ce IS NULL THEN d ELSE greatest(0, e - ce) END)::BIGINT AS drag_excl FROM (SELECT x.*, CASE WHEN pk IS NULL THEN d ELSE coalesce(greatest(0, least(d, e - lead(e) OVER (PARTITION BY tid, pk ORDER BY e DESC, k DESC))), d) END AS drag, (SELECT max(e) FROM nd y WHERE y.tid = x.tid AND y.pk = x.k) AS ce FROM cp x) WHERE on_cp")
def i1_drag(s, d):
    """I1, I2, K10."""
    return slackdrag.drag(_nodes(s, d)).select("trace_id", "span_id", "drag", "drag_excl")


DEPS = """, sp2 AS MATERIALIZED (SELECT a.tid, a.pk, a.path AS first, b.path AS second, a.k AS ak, b.k AS bk, a.e AS ae, b.s AS bs FROM ch a JOIN ch b ON a.tid = b.tid AND a.pk = b.pk AND a.r > b.r JOIN sib x ON x.tid = a.tid AND x.pk = a.pk
  WHERE a.e < b.s OR (a.e < b.e AND a.s < b.s AND a.pd > 0 AND (a.e - b.s) / a.pd < 0.01 AND len(list_filter(x.ss, lambda v: v BETWEEN b.s AND a.e)) + len(list_filter(x.es, lambda v: v BETWEEN b.s AND a.e)) = 2)),
de AS MATERIALIZED (SELECT DISTINCT tid, 'before' AS kind, second AS path, first AS other FROM sp2 UNION SELECT DISTINCT c.tid, CASE WHEN c.e < c.pe THEN 'dependent' ELSE 'async' END, p.path, c.path FROM ch c JOIN nd p ON p.tid = c.tid AND p.k = c.pk)
"""


@query(DEPS + "SELECT tid::VARCHAR AS trace_id, kind, path, other FROM de")
def i9_dependencies(s, d):
    """I9, D13."""
    return slackdrag.dependencies(spans(s, d))


@query(DEPS + """, f AS (SELECT path, other, min(tid) AS since FROM de WHERE kind = 'before' GROUP BY 1, 2), se AS (SELECT DISTINCT tid, path FROM nd),
ag AS (SELECT DISTINCT f.path, f.other FROM f JOIN se a ON a.path = f.path JOIN se b ON b.path = f.other AND b.tid = a.tid WHERE a.tid > f.since AND NOT EXISTS (SELECT 1 FROM de WHERE de.kind = 'before' AND de.tid = a.tid AND de.path = f.path AND de.other = f.other))
SELECT 'before' AS kind, path, other FROM f WHERE NOT EXISTS (SELECT 1 FROM ag WHERE ag.path = f.path AND ag.other = f.other)
UNION ALL (SELECT 'dependent', path, other FROM de WHERE kind = 'dependent' EXCEPT SELECT 'dependent', path, other FROM de WHERE kind = 'async')""")
def i10_aggregate_dependencies(s, d):
    """I10, M4."""
    return slackdrag.aggregate_dependencies(spans(s, d))


@query("SELECT p.tid::VARCHAR AS trace_id, p.k::VARCHAR AS span_id, p.path, (min(c.s) - any_value(p.s))::BIGINT AS start_delay, (any_value(p.e) - max(c.e))::BIGINT AS end_delay FROM nd p JOIN nd c ON c.tid = p.tid AND c.pk = p.k GROUP BY 1, 2, 3")
def k11_delays(s, d):
    """Gaps between a parent's ends and its first and last child."""
    return _flat(slackdrag.delays(_nodes(s, d)).drop("root_id"))


SLACK = DEPS + """, sl AS (SELECT x.tid, x.k, x.path, CASE WHEN x.on_cp THEN 0 ELSE
  coalesce((SELECT min(y.e) FROM cp y WHERE y.tid = x.tid AND y.pk = x.pk AND y.k <> x.k AND y.on_cp AND y.e > x.e), (SELECT e FROM nd p WHERE p.tid = x.tid AND p.k = x.pk), x.e) - x.d
  - coalesce((SELECT max(y.e) FROM cp y WHERE y.tid = x.tid AND y.pk = x.pk AND y.k <> x.k AND y.e < x.s AND EXISTS (SELECT 1 FROM de WHERE de.kind = 'before' AND de.tid = x.tid AND de.path = x.path AND de.other = y.path)),
    (SELECT min(y.s) FROM cp y WHERE y.tid = x.tid AND y.pk = x.pk), x.s) END AS slack FROM cp x)
"""


@query(SLACK + "SELECT tid::VARCHAR AS trace_id, k::VARCHAR AS span_id, slack::BIGINT AS slack FROM sl")
def i6_slack(s, d):
    """I3-I6, D14."""
    return slackdrag.slack(_nodes(s, d)).select("trace_id", "span_id", "slack")


@query(SLACK + """, dr AS (SELECT tid, k, CASE WHEN pk IS NULL THEN d ELSE coalesce(greatest(0, least(d, e - lead(e) OVER (PARTITION BY tid, pk ORDER BY e DESC, k DESC))), d) END AS drag, on_cp FROM cp)
SELECT path, count(*) AS spans, sum(CASE WHEN on_cp THEN drag ELSE 0 END)::BIGINT AS drag, sum(slack)::BIGINT AS slack, sum(CASE WHEN on_cp THEN drag ELSE 0 END)::BIGINT / count(*) AS avg_drag, sum(slack)::BIGINT / count(*) AS avg_slack FROM sl JOIN dr USING (tid, k) GROUP BY path""")
def i8_slack_drag_by_path(s, d):
    """I7, I8, I11."""
    return _flat(slackdrag.by_path(_nodes(s, d)))


@query("SELECT label, path, (sum(excl) // any_value(trees))::BIGINT AS excl, any_value(trees) AS trees FROM (SELECT label, tid, count(*) OVER (PARTITION BY label) AS trees FROM lat, (VALUES ('P50', 0, 50), ('P95', 50, 95), ('P99', 95, 99), ('P100', 99, 100)) AS r(label, a, b) WHERE rn > round_even(n * a / 100, 0) AND rn <= round_even(n * b / 100, 0)) JOIN pr USING (tid) GROUP BY label, path")
def k2_slices(s, d):
    """K1: profiles over slices of traces by latency."""
    p = cut(_profile(s, d).select("trace_id", "root_id", "path", "inc", "excl"), "profile")
    roots = p.where("size(path) = 1").select("trace_id", "root_id", F.col("inc").alias("latency"))
    return _flat(profile.slice_profiles(p, profile.latency_ranks(roots), RANGES))


FAMILIES = "UNION ALL ".join(
    f"SELECT '{family}' AS family, '{about}' AS about, {mean} AS mean, tid, path, v FROM ({rows}) "
    for family, about, mean, rows in (
        ("path", "all", "true", "SELECT tid, path, excl AS v FROM pr"), ("error_path", "sound", "true", "SELECT tid, path, excl AS v FROM fe"),
        ("errored_root", "erring", "false", "SELECT tid, path, count(*) AS v FROM cl WHERE class = 'self' GROUP BY 1, 2"), ("to_root", "erring", "false", "SELECT tid, path, n AS v FROM tr"),
    )
)


@query(VISIT + """, fe AS (SELECT tid, CASE WHEN on_cp THEN 'errorCriticalPathSyntheticRoot->' ELSE 'fullErrorsNonCPSyntheticRoot->' END || path AS path,
  sum(CASE WHEN on_cp THEN own ELSE greatest(0, d - coalesce((SELECT sum(d) FROM vi y WHERE y.tid = x.tid AND y.pk = x.k AND y.err AND NOT y.on_cp AND y.go), 0)) END)::BIGINT AS excl FROM vi x WHERE err AND go GROUP BY 1, 2)
""" + CLASS + TO_ROOT + f""", fa AS ({FAMILIES}), ab AS (SELECT tid, latency, 'all' AS about FROM lat UNION ALL SELECT lat.tid, latency, CASE WHEN err THEN 'erring' ELSE 'sound' END FROM lat JOIN nd ON nd.tid = lat.tid AND k = 0),
rk AS (SELECT *, count(*) OVER (PARTITION BY about) AS n, row_number() OVER (PARTITION BY about ORDER BY latency, tid) AS rn FROM ab),
me AS (SELECT family, label, tid, path, v, mean FROM fa JOIN rk USING (tid, about), (VALUES ('P50', 50), ('P95', 95), ('P99', 99), ('P100', 100)) AS r(label, b) WHERE rn <= round_even(n * b / 100, 0) AND (family <> 'to_root' OR b = 100)),
su AS (SELECT family, label, path, sum(v)::BIGINT AS total, any_value(mean) AS mean FROM me GROUP BY 1, 2, 3), tc AS (SELECT family, label, count(DISTINCT tid) AS trees FROM me GROUP BY 1, 2),
gr AS (SELECT family, label, path, trees, CASE WHEN mean THEN total // trees ELSE total END AS value FROM su JOIN tc USING (family, label))
SELECT family, label, replace(replace(path, ';', '_'), '->', ';') AS stack, trees, CASE WHEN value = 0 AND NOT EXISTS (SELECT 1 FROM gr y WHERE y.family = x.family AND y.label = x.label AND starts_with(y.path, x.path || '->') AND len(string_split(y.path, '->')) = len(string_split(x.path, '->')) + 1) THEN 1 ELSE value END::BIGINT AS value FROM gr x""")
def k2_flame_graphs(s, d):
    """Four families of folded stacks over ranges of traces by latency."""
    return flame.flame_graphs(_nodes(s, d))


@query("SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS percentile, unnest(quantile_cont(latency, [0.5, 0.9, 0.95, 0.99]))::DOUBLE AS latency FROM lat")
def k3_points(s, d):
    """K3."""
    return latency.points(profile.latency_ranks(profile.roots(_nodes(s, d))))


@query("SELECT p AS percent, avg(latency) FILTER (WHERE rn <= m) AS head, avg(latency) FILTER (WHERE rn > n - m) AS tail FROM (SELECT *, round_even(n * p / 100, 0) AS m FROM lat, unnest([1, 5, 10, 50, 100]) AS u(p)) WHERE m > 0 GROUP BY p")
def k4_heads_and_tails(s, d):
    """K4, K5, J14."""
    return latency.heads_and_tails(profile.latency_ranks(profile.roots(_nodes(s, d))))


@query("""SELECT e.*, inc50, inc95 FROM (SELECT op, count(*) AS trees, round(quantile_cont(t, 0.5)::DOUBLE, 3) AS p50, round(quantile_cont(t, 0.5)::DOUBLE / any_value(a50), 6) AS ratio50, round(quantile_cont(t, 0.95)::DOUBLE, 3) AS p95, round(quantile_cont(t, 0.95)::DOUBLE / any_value(a95), 6) AS ratio95
  FROM (SELECT tid, string_split(path, '->')[-1] AS op, sum(excl)::BIGINT AS t FROM pr GROUP BY 1, 2), (SELECT quantile_cont(t, 0.5)::DOUBLE AS a50, quantile_cont(t, 0.95)::DOUBLE AS a95 FROM (SELECT tid, sum(excl)::BIGINT AS t FROM pr GROUP BY 1)) WHERE t <> 0 GROUP BY op) e
LEFT JOIN (SELECT op, round(quantile_cont(t, 0.5)::DOUBLE, 3) AS inc50, round(quantile_cont(t, 0.95)::DOUBLE, 3) AS inc95 FROM (SELECT tid, string_split(path, '->')[-1] AS op, sum(inc)::BIGINT AS t FROM pr GROUP BY 1, 2) WHERE t <> 0 GROUP BY op) i ON i.op = e.op""")
def k6_op_percentiles(s, d):
    """K6, K8."""
    out = latency.op_percentiles(_profile(s, d))
    return out.select("op", "trees", *(F.round(c, 6 if c.startswith("ratio") else 3).alias(c) for c in out.columns if c not in ("op", "trees")))


@query("SELECT op, (p * 100)::INT AS percent, sum(t)::BIGINT / any_value(w) AS share, max(t) AS most FROM (SELECT tid, string_split(path, '->')[-1] AS op, sum(excl)::BIGINT AS t FROM pr GROUP BY 1, 2) JOIN (SELECT *, sum(total) OVER (PARTITION BY p) AS w FROM (SELECT tid, p, total FROM (SELECT tid, total, row_number() OVER (ORDER BY total, tid) AS rn, count(*) OVER () AS n FROM (SELECT tid, sum(excl)::BIGINT AS total FROM pr GROUP BY 1)), unnest([0.5, 0.9, 1.0]) AS u(p) WHERE rn <= floor(n * p))) USING (tid) GROUP BY op, p")
def k7_shares(s, d):
    """K7."""
    return latency.cumulative_shares(_profile(s, d))


@query(f"SELECT o.op_rank::INT AS op_rank, op, rank::INT AS rank, path, excl FROM (SELECT string_split(path, '->')[-1] AS op, path, excl, row_number() OVER (PARTITION BY string_split(path, '->')[-1] ORDER BY excl DESC, path) AS rank FROM {MERGED}) JOIN (SELECT string_split(path, '->')[-1] AS op, row_number() OVER (ORDER BY sum(excl) DESC, string_split(path, '->')[-1]) AS op_rank FROM {MERGED} GROUP BY 1) o USING (op) WHERE o.op_rank <= 5 AND rank <= 3")
def l5_top_contexts(s, d):
    """L5, R1."""
    return latency.top_contexts(profile.merged(_profile(s, d)))


@query("SELECT op, tid::VARCHAR AS trace_id, '0' AS root_id, t FROM (SELECT tid, string_split(path, '->')[-1] AS op, sum(excl)::BIGINT AS t FROM pr GROUP BY 1, 2) WHERE op IN (SELECT string_split(path, '->')[-1] AS op FROM pr GROUP BY 1 ORDER BY sum(excl) DESC, op LIMIT 20) AND tid IN (SELECT tid FROM pr GROUP BY tid ORDER BY sum(excl) DESC, tid LIMIT 100)")
def l3_heatmap(s, d):
    """L2, L3, A24, R1."""
    return latency.heatmap(_profile(s, d))


QS = {"min": 0.0, "max": 1.0, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
COUNTS = CLASS + VISIT.replace("RECURSIVE", "") + """, tc AS (SELECT c.tid, max(c.d) FILTER (WHERE c.k = 0) AS latency, bool_or(c.k = 0 AND c.err) AS root_error, count(*) AS nodes, max(c.depth) AS depth, sum(c.d)::BIGINT AS work, coalesce(sum(c.d) FILTER (WHERE c.err), 0)::BIGINT AS work_saved,
  count(*) FILTER (WHERE c.err) AS errors, count(*) FILTER (WHERE c.err AND c.on_cp) AS cp_errors, count(*) FILTER (WHERE c.err AND NOT c.on_cp AND v.go) AS tied_errors, count(*) FILTER (WHERE c.on_cp) AS nodes_on_cp, count(*) FILTER (WHERE class = 'self' AND c.depth > 1) AS self_errors,
  max(c.depth) FILTER (WHERE chain AND c.nch = 0) AS max_err_depth, count(*) FILTER (WHERE nd.d < nd.d0) AS shrunk, sum(nd.d0 - nd.d)::BIGINT AS shrink, """ + ", ".join(f"quantile_cont(c.depth, {q}) FILTER (WHERE class = 'self' AND c.depth > 1)::DOUBLE AS {n}_depth" for n, q in QS.items()) + """
  FROM cl c JOIN nd ON nd.tid = c.tid AND nd.k = c.k LEFT JOIN vi v ON v.tid = c.tid AND v.k = c.k GROUP BY c.tid),
ts AS (SELECT *, work_saved / work AS work_ratio, CASE WHEN errors > 0 THEN cp_errors / errors END AS cp_error_ratio, CASE WHEN errors > 0 THEN tied_errors / errors END AS tied_error_ratio, """ + ", ".join(f"{n}_depth / depth AS {n}_depth_ratio" for n in QS) + """ FROM tc)
"""


@query(COUNTS + "SELECT tid::VARCHAR AS trace_id, * EXCLUDE (tid) FROM ts")
def j12_trace_counts(s, d):
    """J12, Q-9: the wide row of each trace but for time saved."""
    return latency.with_shares(latency.trace_counts(_nodes(s, d))).drop("root_id")


@query()
def j12_trace_stats(s, d):
    """With time saved, from one pass over the spans."""
    return latency.trace_stats(whatif.nodes_and_savings(spans(s, d))).orderBy(F.desc("saved_ratio"))


MEANS = ["latency", "nodes", "depth", "work", "work_saved", "errors", "cp_errors", "tied_errors", "nodes_on_cp", "self_errors", "max_err_depth", "shrunk", "shrink", *(f"{n}_depth" for n in QS), *(f"{n}_depth_ratio" for n in QS)]


@query(COUNTS + "SELECT CASE WHEN grouping(type) = 1 THEN 'ALL' ELSE type END AS type, count(*) AS trees, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in MEANS) + ", round(sum(work_saved) / sum(work), 6) AS work_ratio, round(sum(cp_errors) / sum(errors), 6) AS cp_error_ratio, round(sum(tied_errors) / sum(errors), 6) AS tied_error_ratio FROM (SELECT *, CASE WHEN root_error THEN 'ROOT_ERROR' ELSE 'NON_ROOT_ERROR' END AS type FROM ts) GROUP BY ROLLUP (type)")
def j13_summary(s, d):
    """Means and ratios of sums by type of trace."""
    counts = latency.with_shares(latency.trace_counts(_nodes(s, d))).withColumn("type", F.when(F.col("root_error"), "ROOT_ERROR").otherwise("NON_ROOT_ERROR"))
    out = latency.summary(counts)
    return out.select("type", "trees", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("type", "trees")))


@query()
def r3_reductions(s, d):
    """Latency falls without errors, over traces whose root does not err."""
    stats = cut(latency.trace_stats(whatif.nodes_and_savings(spans(s, d))).where("not root_error").select("trace_id", "root_id", "latency", "saved"), "stats")
    return latency.reductions(stats)


@query()
def r4_hypothetical(s, d):
    """The fastest traces as they are and without errors."""
    stats = cut(latency.trace_stats(whatif.nodes_and_savings(spans(s, d))).where("not root_error").select("trace_id", "root_id", "latency", "saved"), "stats")
    return latency.hypothetical(stats)


@query("SELECT count(DISTINCT tid) AS traces, count(*) AS nodes, max(n) AS most_nodes, max(depth) AS max_depth, max(bytes) AS bytes, " + ", ".join(f"max(b{q}) AS bytes_p{q}" for q in (50, 90, 95, 99)) + """ FROM (SELECT nd.*, count(*) OVER (PARTITION BY tid) AS n FROM nd) x,
  (SELECT sum(b)::BIGINT AS bytes, """ + ", ".join(f"list(b ORDER BY b)[least(floor(count(*) * {q / 100})::BIGINT, count(*) - 1) + 1] AS b{q}" for q in (50, 90, 95, 99)) + " FROM (SELECT tid, sum(length(replace(path, '->', ';')) + length(excl::VARCHAR) + 2)::BIGINT AS b FROM pr GROUP BY tid)) y")
def j15_run_log(s, d):
    """Sizes of a run."""
    n = cut(_nodes(s, d).select("trace_id", "root_id", "path", "depth", "on_cp", "span_id", "adj_dur", "path_dur", "cp_pos"), "nodes")
    lines = profile.per_trace(n).select("trace_id", "root_id", (F.length(F.array_join("path", ";")) + F.length(F.col("excl").cast("string")) + 2).alias("b"))
    return latency.run_log(n, lines.groupBy("trace_id", "root_id").agg(F.sum("b").alias("bytes")))


@query("SELECT DISTINCT c.tid::VARCHAR AS trace_id, c.k::VARCHAR AS span_id, string_split(c.path, '->')[max(a.depth):] AS cyc, array_to_string(string_split(c.path, '->')[max(a.depth):], '->') AS cycle FROM nd c JOIN nd a ON a.tid = c.tid AND a.kind = 'CLIENT' AND c.kind = 'CLIENT' AND a.op = c.op AND a.svc = c.svc AND c.k > a.k AND (a.k = c.pk OR a.k = (c.pk - 1) // 3 AND c.pk > 0 OR a.k = ((c.pk - 1) // 3 - 1) // 3 AND c.pk > 3) GROUP BY c.tid, c.k, c.path".replace("string_split(c.path, '->')[max(a.depth):] AS cyc, ", ""))
def e9_cycles(s, d):
    """E9, R5."""
    return structure.cycles(_nodes(s, d)).select("trace_id", "span_id", F.array_join("cycle", "->").alias("cycle"))


@query("SELECT svc AS service, count(*) AS spans, sum(nch)::BIGINT AS calls, max(nch)::BIGINT AS most FROM cp GROUP BY svc")
def e10_fan_out(s, d):
    """E10."""
    return structure.fan_out(_nodes(s, d)).withColumn("most", F.col("most").cast("long"))


@query("SELECT p.svc AS caller, c.svc AS callee, regexp_replace(p.region, '[^a-zA-Z]', '', 'g') AS from_region, regexp_replace(c.region, '[^a-zA-Z]', '', 'g') AS to_region, count(*) AS n, sum(c.d)::BIGINT AS time FROM nd c JOIN nd p ON p.tid = c.tid AND p.k = c.pk WHERE regexp_replace(p.region, '[^a-zA-Z]', '', 'g') <> regexp_replace(c.region, '[^a-zA-Z]', '', 'g') GROUP BY 1, 2, 3, 4")
def d15_cross_region(s, d):
    """D15, R5, B6."""
    return structure.cross_region(_nodes(s, d))


@query("SELECT tid::VARCHAR AS trace_id, array_to_string(list_sort(list(DISTINCT svc)), ',') AS services FROM nd GROUP BY tid")
def c13_services(s, d):
    """C13."""
    return structure.reachable_services(_nodes(s, d)).select("trace_id", F.array_join("services", ",").alias("services"))


@query("SELECT tid::VARCHAR AS trace_id, bool_or(svc = 'S6' OR starts_with(op, 'sign')) AS is_test FROM sp GROUP BY tid")
def c4_test_traces(s, d):
    """C4, C5, N1."""
    return structure.test_traces(spans(s, d), ["S6"], ["sign"])


@query("SELECT tid::VARCHAR AS trace_id, bool_or(event_id % 17 = 0) AS incomplete, array_to_string(list_sort(list(DISTINCT svc) FILTER (WHERE event_id % 17 = 0)), ',') AS services FROM sp GROUP BY tid".replace("array_to_string(list_sort(list(DISTINCT svc) FILTER (WHERE event_id % 17 = 0)), ',')", "coalesce(array_to_string(list_sort(list(DISTINCT svc) FILTER (WHERE event_id % 17 = 0)), ','), '')"))
def c11_completeness(s, d):
    """Spans of every 17th event carry the warning."""
    w = spans(s, d).withColumn("warnings", F.when(F.col("event_id") % 17 == 0, F.array(F.lit("invalid parent span IDs=1; skipping clock skew adjustment"))))
    return structure.completeness(w).withColumn("services", F.array_join("services", ","))


@query("""SELECT count(*) AS traces, count(*) FILTER (WHERE bad) AS incomplete, count(*) FILTER (WHERE bad) * 100 / count(*) AS percent, (SELECT string_agg(svc || '=' || n, ',' ORDER BY svc || '=' || n) FROM (SELECT svc, count(DISTINCT tid) AS n FROM sp WHERE event_id % 17 = 0 GROUP BY svc)) AS services FROM (SELECT tid, bool_or(event_id % 17 = 0) AS bad FROM sp GROUP BY tid)""")
def c14_completeness_report(s, d):
    """C14."""
    w = spans(s, d).withColumn("warnings", F.when(F.col("event_id") % 17 == 0, F.array(F.lit("invalid parent span IDs=1; skipping clock skew adjustment"))))
    return structure.completeness_report(structure.completeness(w))


@query("SELECT tid::VARCHAR AS trace_id, string_agg(DISTINCT 'bucket=' || (event_id % 5), ',' ORDER BY 'bucket=' || (event_id % 5)) AS matched FROM nd WHERE (event_id % 5 = 1 AND depth <= 2) OR (event_id % 5 = 2 AND depth <= 3) GROUP BY tid")
def c9_tag_matches(s, d):
    """C9, C10, A23."""
    sp = spans(s, d)
    tags = sp.select("trace_id", "span_id", F.lit("bucket").alias("name"), (F.col("event_id") % 5).cast("string").alias("value"))
    wanted = s.createDataFrame([("bucket", "1", 2), ("bucket", "2", 3)], "name string, value string, search_depth int")
    return structure.tag_matches(tree.nodes(sp), tags, wanted).select("trace_id", F.array_join("matched", ",").alias("matched"))


@query("SELECT path, count(*) AS n, sum(d)::BIGINT AS inc FROM nd WHERE NOT contains(substr(path, length(string_split(path, '->')[1]) + 1), '->[S2] click') GROUP BY path")
def c8_excluded(s, d):
    """(S2, click) and what is below it left out."""
    n = _nodes(s, d, Knobs(excluded=frozenset({("S2", "click")})))
    return _flat(n.groupBy("path").agg(F.count("*").alias("n"), F.sum("adj_dur").alias("inc")))


#: The first purchase of S1 in pre-order is the root; only what lies below it is analysed.
FROM_MATCH = derive.sql(
    roots="SELECT tid, arg_min(k, key) AS k FROM pre JOIN sp USING (tid, k) WHERE svc = 'S1' AND op = 'purchase' GROUP BY tid",
    more="pre AS (SELECT tid, k, [k] AS key FROM sp WHERE k = 0 UNION ALL SELECT c.tid, c.k, list_append(p.key, c.k) FROM pre p JOIN sp c ON c.tid = p.tid AND c.pk = p.k),\n",
)
#: (S3, view) is a proxy: spans hang on their nearest ancestor that is none.
NO_PROXIES = derive.sql(
    source="SELECT sp.* REPLACE (ef.px AS pk) FROM sp JOIN ef USING (tid, k) WHERE NOT (svc = 'S3' AND op = 'view')", roots="SELECT tid, k FROM st WHERE pk IS NULL",
    more="ef AS (SELECT tid, k, NULL::INT AS px FROM sp WHERE k = 0 UNION ALL SELECT c.tid, c.k, CASE WHEN p.svc = 'S3' AND p.op = 'view' THEN e.px ELSE p.k END FROM ef e JOIN sp p ON p.tid = e.tid AND p.k = e.k JOIN sp c ON c.tid = p.tid AND c.pk = p.k),\n",
)
#: A click with one child takes over that child's error, through runs of them.
PASSED = derive.sql(
    source="SELECT sp.* REPLACE (fe.err AS err) FROM sp JOIN (SELECT tid, b0, arg_max(err, k) AS err FROM fo GROUP BY 1, 2) fe ON fe.tid = sp.tid AND fe.b0 = sp.k",
    more="""n1 AS (SELECT tid, pk AS k, count(*) AS n, min(k) AS kid FROM sp WHERE pk IS NOT NULL GROUP BY 1, 2),
fo AS (SELECT tid, k AS b0, k, err, op FROM sp UNION ALL SELECT f.tid, f.b0, c.k, c.err, c.op FROM fo f JOIN n1 ON n1.tid = f.tid AND n1.k = f.k AND n1.n = 1 JOIN sp c ON c.tid = f.tid AND c.k = n1.kid WHERE f.op = 'click'),
""",
)


@query(f"SELECT path, inc, excl, freq FROM {MERGED}", FROM_MATCH)
def c1_matching_root(s, d):
    """The first matching descendant as root."""
    n = _nodes(s, d, Knobs(root=TARGET))
    return _flat(profile.merged(profile.per_trace(n)).select("path", "inc", "excl", "freq"))


@query("SELECT path, count(*) AS n, sum(d)::BIGINT AS inc FROM nd GROUP BY path", NO_PROXIES)
def d4_proxies(s, d):
    """Proxies vanish and their children move up."""
    n = _nodes(s, d, Knobs(proxies=frozenset({("S3", "view")})))
    return _flat(n.groupBy("path").agg(F.count("*").alias("n"), F.sum("adj_dur").alias("inc")))


@query("SELECT op, err AS is_error, count(*) AS n FROM nd GROUP BY 1, 2", PASSED)
def e7_passed_errors(s, d):
    """Errors passed up through single-child nodes."""
    n = _nodes(s, d, Knobs(pass_through=frozenset({(f"S{i}", "click") for i in range(7)})))
    return n.groupBy("op", "is_error").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT tid) AS traces, count(*) AS nodes FROM nd WHERE tid NOT IN (SELECT tid FROM sp WHERE svc = 'S6' OR starts_with(op, 'sign'))")
def c5_no_test_traces(s, d):
    """Test traces left out by the knobs."""
    n = _nodes(s, d, Knobs(test_services=frozenset({"S6"}), test_prefixes=("sign",)))
    return n.agg(F.count_distinct("trace_id").alias("traces"), F.count("*").alias("nodes"))


@query(ORDER + """, nm AS (SELECT name, 'Service::Operation' || row_number() OVER (ORDER BY tid, pos) AS alias FROM (SELECT '[' || svc || '] ' || op AS name, min((tid, pos)) AS f, f[1] AS tid, f[2] AS pos FROM cp JOIN po USING (tid, k) GROUP BY 1)),
ex AS (SELECT tid, path, excl, string_split(path, '->') AS p, unnest(range(1, len(p) + 1)) AS i FROM pr)
SELECT tid::VARCHAR AS trace_id, string_agg(alias, '->' ORDER BY i) AS path, any_value(excl)::BIGINT AS excl FROM ex JOIN nm ON nm.name = ex.p[ex.i] GROUP BY tid, ex.path""".replace("min((tid, pos)) AS f, f[1] AS tid, f[2] AS pos", "min(tid) AS tid, arg_min(pos, (tid, pos)) AS pos"))
def b12_anonymised(s, d):
    """Names in the order in which they are first seen."""
    n = cut(_nodes(s, d).select("trace_id", "root_id", "path", "service", "op", "on_cp", "span_id", "adj_dur", "path_dur", "cp_pos"), "nodes")
    return _flat(profile.anonymised(profile.per_trace(n), profile.aliases(n)).select("trace_id", "path", "excl"))


@query(CLASS + "SELECT tid::VARCHAR AS trace_id, metric, count(*) AS items, min(depth) AS p0, list(depth ORDER BY depth)[least(count(*) // 2, count(*) - 1) + 1] AS p50, list(depth ORDER BY depth)[least(floor(count(*) * 0.9)::BIGINT, count(*) - 1) + 1] AS p90, list(depth ORDER BY depth)[least(floor(count(*) * 0.95)::BIGINT, count(*) - 1) + 1] AS p95, list(depth ORDER BY depth)[least(floor(count(*) * 0.99)::BIGINT, count(*) - 1) + 1] AS p99, max(depth) AS p100, sum(depth)::BIGINT / count(*) AS avg FROM (SELECT *, CASE WHEN class = 'stopped' THEN 'stopped' WHEN chain THEN 'to_root' ELSE 'not_to_root' END AS m FROM cl WHERE class IN ('self', 'stopped')), unnest(CASE WHEN on_cp THEN [m, m || '_on_path'] ELSE [m] END) AS u(metric) GROUP BY 1, 2")
def h12_tree_histograms(s, d):
    """A trace's error depths, by what becomes of the errors."""
    return errors.tree_histograms(_nodes(s, d)).drop("root_id")


@query(CLASS + "SELECT (CASE WHEN x = 0 THEN -1 ELSE least(floor(x * 10), 9) END)::INT AS bin, count(*) FILTER (WHERE class = 'self') AS self_errors, count(*) FILTER (WHERE class = 'stopped') AS stopped FROM (SELECT class, cl.depth / max(cl.depth) OVER (PARTITION BY tid) AS x, bool_or(k = 0 AND err) OVER (PARTITION BY tid) AS bad FROM cl) WHERE class IN ('self', 'stopped') AND NOT bad GROUP BY 1")
def h12_percent_depth(s, d):
    """Error depths as shares of the trace's depth, over traces whose root does not err."""
    return errors.percent_depths(_nodes(s, d))


@query(COUNTS + "SELECT bin, count(*) FILTER (WHERE what = 'cp') AS cp, count(*) FILTER (WHERE what = 'tied') AS tied FROM (SELECT what, (CASE WHEN x = 0 THEN -1 ELSE least(floor(x * 10), 9) END)::INT AS bin FROM (SELECT 'cp' AS what, cp_error_ratio AS x FROM ts WHERE NOT root_error UNION ALL SELECT 'tied', tied_error_ratio FROM ts WHERE NOT root_error) WHERE x IS NOT NULL) GROUP BY bin")
def h11_error_shares(s, d):
    """Shares of a trace's errors that lie on the path, and that are tied to it."""
    stats = latency.with_shares(latency.trace_counts(_nodes(s, d))).where("not root_error")
    return errors.share_bins(stats, cp=F.col("cp_error_ratio"), tied=F.col("tied_error_ratio"))


@query(CLASS + "SELECT round_even(max_depth / depth, 1) AS share, count(*) AS trees FROM (SELECT tid, coalesce(max(depth) FILTER (WHERE chain AND nch = 0), -1) AS max_depth, max(depth) AS depth, bool_or(k = 0 AND err) AS bad FROM cl GROUP BY tid) WHERE bad GROUP BY 1")
def h13_percent_deepest(s, d):
    """The deepest error that reaches the root as a share of the trace's depth, over traces whose root errs."""
    return errors.percent_deepest(_nodes(s, d))


#: A span's error, as documents state it, by its event: the forms that count and forms that don't.
STATED = """CASE event_id % 9 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN true WHEN 5 THEN true ELSE false END"""


@query(f"SELECT tid::VARCHAR AS trace_id, k::VARCHAR AS span_id, k AS span_ord, pk::VARCHAR AS parent_id, svc AS service, op, kind, host, CASE WHEN event_id % 2 = 0 THEN region ELSE 'z' || (event_id % 3) END AS region, s AS start, d AS dur, {STATED} AS is_error, CASE WHEN event_id % 4 = 0 THEN 'peer' || (event_id % 5) END AS peer_service FROM sp")
def a4_document_spans(s, d):
    """Spans parsed from trace documents in JSON, which are made from the derived spans."""
    return traces.spans_of(_documents(s, d)).drop("tags", "warnings", "trace_file")


@query(f"SELECT lower(printf('%016x', tid)) AS trace_id, lower(printf('%016x', k + 1)) AS span_id, lower(printf('%016x', pk + 1)) AS parent_id, svc AS service, op, kind, host, s AS start, d AS dur, event_id % 5 IN (0, 1, 2) AS is_error FROM sp")
def a5_nested_spans(s, d):
    """Spans parsed from nested rows, one a trace, with numbers for ids and kinds and nanoseconds."""
    return traces.nested_spans(_nested(s, d)).select(expr.hex_id(F.col("trace_id").cast("long")).alias("trace_id"), "span_id", "parent_id", "service", "op", "kind", "host", "start", "dur", "is_error")


@query("SELECT tid::VARCHAR AS trace_id, k::VARCHAR AS span_id, pk::VARCHAR AS parent_id, s AS start FROM sp")
def d7_merged_traces(s, d):
    """The subtrees of span 2 come as traces of their own that follow from span 0, and are merged back."""
    parent, child, references = _split(s, d)
    return structure.merge_split(parent, child, references).select("trace_id", "span_id", "parent_id", "start")


@query("SELECT DISTINCT a.k::VARCHAR AS span_id FROM sp a JOIN sp b ON a.k = b.k WHERE a.tid % 2 = 0 AND b.tid % 2 = 1")
def m3_collisions(s, d):
    """Span ids that two sides share."""
    sp = spans(s, d)
    odd = F.col("trace_id").cast("long") % 2 == 1
    return structure.collisions(sp.where(~odd), sp.where(odd))


@query("""SELECT path, coalesce(f1, 0)::BIGINT AS freq1, coalesce(e1, 0)::BIGINT AS excl1, coalesce(f2, 0)::BIGINT AS freq2, coalesce(e2, 0)::BIGINT AS excl2, (coalesce(f2, 0) - coalesce(f1, 0))::BIGINT AS freq_change, (coalesce(e2, 0) - coalesce(e1, 0))::BIGINT AS excl_change FROM
(SELECT path, sum(freq) AS f1, sum(excl) // (SELECT count(*) FROM lat WHERE tid % 2 = 0) AS e1 FROM pr WHERE tid % 2 = 0 GROUP BY path) FULL JOIN (SELECT path, sum(freq) AS f2, sum(excl) // (SELECT count(*) FROM lat WHERE tid % 2 = 1) AS e2 FROM pr WHERE tid % 2 = 1 GROUP BY path) USING (path)""")
def d10_compare(s, d):
    """Even against odd traces."""
    p = cut(_profile(s, d).select("trace_id", "path", "inc", "excl", "freq"), "profile")
    odd = F.col("trace_id").cast("long") % 2 == 1
    return _flat(structure.compare(profile.merged(p.where(~odd)), profile.merged(p.where(odd))))


@query("""SELECT stack, coalesce(a, 0)::BIGINT AS before, coalesce(b, 0)::BIGINT AS after, (coalesce(b, 0) - coalesce(a, 0))::BIGINT AS change FROM (SELECT path AS stack, sum(excl) AS a FROM pr WHERE tid % 2 = 0 GROUP BY 1) FULL JOIN (SELECT path AS stack, sum(excl) AS b FROM pr WHERE tid % 2 = 1 GROUP BY 1) USING (stack)""")
def a22_difference(s, d):
    """Two folded tables against each other."""
    p = cut(_profile(s, d).groupBy((F.col("trace_id").cast("long") % 2).alias("odd"), profile.name(F.col("path")).alias("stack")).agg(F.sum("excl").alias("excl")), "stacks")
    of = lambda k: p.where(F.col("odd") == k).groupBy("stack").agg(F.sum("excl").alias("v"))
    return profile.difference(of(0), of(1), "stack", "v")


@query("SELECT epoch_us(time_bucket(INTERVAL '10 minutes', ts)) AS window_start, op, count(*) AS spans, sum(d)::BIGINT AS total, max(d) AS longest, count(*) FILTER (WHERE err) AS errors FROM sp GROUP BY 1, 2")
def o8_windows(s, d):
    """Tumbling windows, the plan that the stream runs too."""
    return windows.summaries(spans(s, d).withColumnRenamed("ts", "event_time")).select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_start"), "op", "spans", "total", "longest", "errors")
