"""Sources of spans: trace documents in JSON, nested Parquet rows, folded profiles, and small YAML lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import expr

from .store import Store

TAG = "STRUCT<key STRING, type STRING, value STRING>"
DOCUMENT = (
    "data ARRAY<STRUCT<traceID STRING, processes MAP<STRING, STRUCT<serviceName STRING, tags ARRAY<" + TAG + ">>>, spans ARRAY<STRUCT<traceID STRING, spanID STRING, operationName STRING, processID STRING, "
    "startTime BIGINT, duration BIGINT, `references` ARRAY<STRUCT<refType STRING, traceID STRING, spanID STRING>>, tags ARRAY<" + TAG + ">, logs ARRAY<STRUCT<fields ARRAY<" + TAG + ">>>, warnings ARRAY<STRING>>>>>, _corrupt STRING"
)
FOLDED_LINE = r"^(.*?)\s+(\d+)\s*<<(\d+)>>\s*$"


def documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """file, trace_file (id from the file's name), data; one row a document. A document that is no JSON has null data."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", glob).json(path)
    return raw.select(F.input_file_name().alias("file"), expr.trace_id_of_file(F.input_file_name()).alias("trace_file"), "data")


def parsed(rows: DataFrame) -> DataFrame:
    """Trace documents from rows with trace_id and document (JSON text), as the search source gives them; a failed download has none."""
    return rows.where("document is not null").select(F.col("trace_id").alias("trace_file"), F.from_json("document", DOCUMENT).getField("data").alias("data"))


def any_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans of whatever lies there: downloaded documents or nested rows in Parquet, else documents in JSON."""
    held = Store(spark, path)
    if not any(n.endswith(".parquet") for n in [path, *held.names()]):
        return json_spans(spark, path)
    raw = spark.read.parquet(path)
    return spans_of(parsed(raw)) if "document" in raw.columns else parquet_spans(spark, path)


def spans_of(docs: DataFrame) -> DataFrame:
    """Spans of trace documents. A span without process, id or times is left out, as is everything it alone would connect."""
    one = docs.select("trace_file", F.explode("data").alias("t"))
    rows = one.select("trace_file", F.col("t.traceID").alias("trace_id"), F.col("t.processes").alias("processes"), F.posexplode("t.spans").alias("span_ord", "s"))
    rows = rows.withColumn("p", F.try_element_at("processes", F.col("s.processID")))
    rows = rows.where("p is not null and s.spanID is not null and s.startTime is not null and s.duration is not null")
    return rows.select(
        "trace_id", F.col("s.spanID").alias("span_id"), "span_ord", expr.parent_id(F.col("s.`references`")).alias("parent_id"), F.col("p.serviceName").alias("service"), F.col("s.operationName").alias("op"),
        expr.kind(F.col("s.tags")).alias("kind"), expr.host(F.col("p.tags")).alias("host"), expr.region(F.col("p.tags")).alias("region"), expr.tag(F.col("s.tags"), "peer.service").alias("peer_service"),
        F.col("s.startTime").alias("start"), F.col("s.duration").alias("dur"), expr.is_error(F.col("s.tags"), F.col("s.logs")).alias("is_error"), F.col("s.tags").alias("tags"), F.col("s.warnings").alias("warnings"), "trace_file",
    )


def json_spans(spark: SparkSession, path: str) -> DataFrame:
    return spans_of(documents(spark, path))


def references_of(docs: DataFrame) -> DataFrame:
    """trace_id, span_id, span_ord, ref_type, ref_trace_id, ref_span_id: every reference."""
    rows = docs.select(F.explode("data").alias("t")).select(F.col("t.traceID").alias("trace_id"), F.posexplode("t.spans").alias("span_ord", "s"))
    rows = rows.select("trace_id", F.col("s.spanID").alias("span_id"), "span_ord", F.explode("s.`references`").alias("r"))
    return rows.select("trace_id", "span_id", "span_ord", F.col("r.refType").alias("ref_type"), F.col("r.traceID").alias("ref_trace_id"), F.col("r.spanID").alias("ref_span_id"))


def split_children(spans: DataFrame) -> DataFrame:
    """trace_id, child_trace_id, span_id: marker tags of traces that were split, the first for each child."""
    value = lambda key: expr.tag(F.col("tags"), key)
    rows = spans.select("trace_id", "span_ord", value("internal.splittrace.traceid").alias("child_trace_id"), value("internal.splittrace.spanid").alias("span_id")).where("child_trace_id is not null")
    return rows.groupBy("trace_id", "child_trace_id").agg(F.min_by("span_id", "span_ord").alias("span_id"))


def parquet_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans of files of nested rows; the file's name is the trace's id where rows have none."""
    raw = spark.read.parquet(path)
    return nested_spans(raw if "trace_id" in raw.columns else raw.withColumn("trace_id", expr.trace_id_of_file(F.input_file_name())))


def nested_spans(raw: DataFrame) -> DataFrame:
    """Spans of nested rows (trace_id, span_set; one trace a row): ids become hexadecimal, nanoseconds microseconds, kinds names."""
    trace_id = F.col("trace_id").cast("string")
    sets = raw.select(trace_id.alias("trace_id"), F.posexplode("span_set").alias("set_ord", "x"))
    rows = sets.select("trace_id", "set_ord", F.col("x.process").alias("p"), F.posexplode("x.spans").alias("at", "s"))
    rows = rows.withColumn("span_ord", F.col("set_ord") * 1_000_000 + F.col("at"))
    http = F.try_element_at(F.filter(F.col("s.StringTags"), lambda t: F.lower(t["key"]) == "http.status_code"), F.lit(1))["value"].try_cast("int") if "StringTags" in rows.select("s.*").columns else F.lit(None).cast("int")
    kind = F.when(F.col("s.kind") == 3, "CLIENT").when(F.col("s.kind") == 2, "SERVER").otherwise("UNKNOWN")
    parent = F.col("s.parent_span_id")
    return rows.select(
        "trace_id", expr.hex_id(F.col("s.span_id")).alias("span_id"), "span_ord", F.when(parent.isNotNull() & (parent != 0), expr.hex_id(parent)).alias("parent_id"), F.col("p.service_name").alias("service"), F.col("s.operation_name").alias("op"),
        kind.alias("kind"), F.col("p.host_name").alias("host"), F.lit(None).cast("string").alias("region"), F.floor(F.col("s.start_time_unix_nano") / 1000).alias("start"), F.floor(F.col("s.duration_nano") / 1000).alias("dur"),
        F.coalesce(F.col("s.error"), F.lit(False)).__or__(F.coalesce(F.col("s.rpc_status_code") != 0, F.lit(False))).__or__(F.coalesce(http >= 400, F.lit(False))).alias("is_error"),
    )


def folded_profile(spark: SparkSession, path: str) -> DataFrame:
    """Folded profiles from text files."""
    return folded_rows(spark.read.text(path))


def folded_rows(lines: DataFrame) -> DataFrame:
    """call_path array of (service, op), duration, frequency from lines (value) `[s] o;[s] o <time> <<freq>>`; other lines are left out."""
    of = lambda i: F.regexp_extract("value", FOLDED_LINE, i)
    lines = lines.select(of(1).alias("stack"), of(2).try_cast("long").alias("duration"), of(3).try_cast("long").alias("frequency"))
    part = lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]*)\]", 1).alias("service"), F.trim(F.regexp_replace(x, r"^\[[^\]]*\]", "")).alias("op"))
    steps = F.transform(F.filter(F.split("stack", ";"), lambda x: F.trim(x).rlike(r"^\[[^\]]*\]")), lambda x: part(F.trim(x)))
    return lines.where("duration is not null").select(steps.alias("call_path"), "duration", "frequency").where("size(call_path) > 0")


def read_yaml(path: str):
    """Content of a small YAML file on the driver (tag filters, exclusions, service lists)."""
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


def exclusions(content: dict | None) -> frozenset[tuple[str, str]]:
    """(service, operation) pairs of {service: [operation, ...]}."""
    return frozenset((s, o) for s, ops in (content or {}).items() for o in ops or ())


def tag_filters(spark: SparkSession, content: list[dict]) -> DataFrame:
    """name, value, search_depth of a list of filters; a filter that lacks one raises ValueError."""
    rows = []
    for x in content:
        if not {"name", "value", "search_depth"} <= set(x):
            raise ValueError("a tag filter needs name, value and search_depth")
        rows.append((str(x["name"]), str(x["value"]), int(x["search_depth"])))
    return spark.createDataFrame(rows, "name string, value string, search_depth int")


def merged_lists(one, two):
    """Union of two YAML structures without repeats: maps by key, lists by item, the first one's scalars kept."""
    if isinstance(one, dict) and isinstance(two, dict):
        return {k: merged_lists(one[k], two[k]) if k in one and k in two else one.get(k, two.get(k)) for k in [*one, *(k for k in two if k not in one)]}
    if isinstance(one, list) and isinstance(two, list):
        return [*one, *(x for x in two if x not in one)]
    return one
