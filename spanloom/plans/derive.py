"""Spans derived from the driver's `events` table by integer arithmetic, and the same in DuckDB SQL.

Up to 16 consecutive events of a user make one trace, a ternary heap of spans; times follow from event ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, span_id, span_ord, parent_id, service, op, kind, host, region, start, dur, is_error and event_id, value, ts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = events.withColumn("rn", rn.cast("long")).withColumn("tid", F.col("user_id") * 1000 + F.floor(F.col("rn") / 16))
    rows = rows.withColumn("k", (F.col("rn") % 16).cast("int"))
    trace = rows.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("k", "event_id", "event_type", "value", "ts"))).alias("all"))

    def times(acc: Column, x: Column) -> Column:
        parent = F.try_element_at(acc, F.greatest(F.floor((x["k"] - 1) / 3).cast("int") + 1, F.lit(1)))
        begin = parent["s"] + F.floor(parent["d"] * ((x["event_id"] * 37) % 110) / 100) - F.floor(parent["d"] * 20 / 100)
        own = F.struct(begin.cast("long").alias("s"), F.floor(parent["d"] * (F.lit(10) + (x["event_id"] * 53) % 60) / 100).cast("long").alias("d"))
        root = F.struct(F.lit(0).cast("long").alias("s"), (F.lit(500000) + (F.col("tid") * 7919) % 1000000).cast("long").alias("d"))
        return F.concat(acc, F.array(F.when(x["k"] == 0, root).otherwise(own)))

    trace = trace.withColumn("t", F.aggregate("all", F.array().cast("array<struct<s:bigint,d:bigint>>"), times))
    one = trace.select("tid", F.explode(F.arrays_zip("all", "t")).alias("x")).select("tid", "x.all.*", "x.t.*")
    kind = F.when(F.col("event_type") == "purchase", "SERVER").when(F.col("event_type") == "click", "CLIENT").otherwise("UNKNOWN")
    return one.select(
        F.col("tid").cast("string").alias("trace_id"), F.col("k").cast("string").alias("span_id"), F.col("k").alias("span_ord"), F.when(F.col("k") > 0, F.floor((F.col("k") - 1) / 3).cast("string")).alias("parent_id"),
        F.concat(F.lit("S"), (F.col("event_id") % 7).cast("string")).alias("service"), F.col("event_type").alias("op"), kind.alias("kind"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("h"), (F.col("event_id") % 2).cast("string"))).alias("host"),
        F.element_at(F.array(F.lit("us-west-1"), F.lit("eu-west-1a"), F.lit("ap-south-2")), (F.col("event_id") % 3 + 1).cast("int")).alias("region"),
        F.col("s").alias("start"), F.col("d").alias("dur"), (F.col("event_type") == "error").alias("is_error"), "event_id", "value", "ts",
    )


def sql(source: str = "SELECT * FROM sp", roots: str = "SELECT tid, k FROM sp WHERE k = 0", more: str = "") -> str:
    """CTEs sp (spans), nd (repaired nodes), ch (ranked children), pk (chosen children), cp (nodes with on_cp), pr (profile), lat (roots by latency).
    `source` gives the spans that trees are made of (pk: their parents), `roots` which of them are roots, `more` CTEs that these need."""
    return f"""WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
b AS (SELECT user_id * 1000 + rn // 16 AS tid, (rn % 16)::INT AS k, (CASE WHEN rn % 16 > 0 THEN (rn % 16 - 1) // 3 END)::INT AS pk, event_id, value, ts, 'S' || (event_id % 7) AS svc, event_type AS op,
  CASE event_type WHEN 'purchase' THEN 'SERVER' WHEN 'click' THEN 'CLIENT' ELSE 'UNKNOWN' END AS kind, event_type = 'error' AS err, CASE WHEN event_id % 3 <> 0 THEN 'h' || (event_id % 2) END AS host,
  ['us-west-1', 'eu-west-1a', 'ap-south-2'][(event_id % 3 + 1)::INT] AS region FROM ev),
sp AS (SELECT b.*, 0::BIGINT AS s, (500000 + (tid * 7919) % 1000000)::BIGINT AS d FROM b WHERE k = 0
  UNION ALL SELECT c.*, p.s + (p.d * ((c.event_id * 37) % 110)) // 100 - (p.d * 20) // 100, (p.d * (10 + (c.event_id * 53) % 60)) // 100 FROM b c JOIN sp p ON c.tid = p.tid AND c.pk = p.k),
{more}st AS ({source}), rt AS ({roots}),
nc AS (SELECT tid, pk AS k, count(*) AS n FROM st WHERE pk IS NOT NULL GROUP BY 1, 2),
nd AS (SELECT tid, k, NULL::INT AS pk, event_id, svc, op, kind, err, host, region, s AS s0, d AS d0, s, s + d AS e, d, 1 AS depth, '[' || svc || '] ' || op AS path, NULL::VARCHAR AS pkind, 'kept' AS change FROM st JOIN rt USING (tid, k)
  UNION ALL SELECT tid, k, pk, event_id, svc, op, kind, err, host, region, s0, d0, CASE WHEN how = 'early' THEN ps ELSE s0 END, CASE WHEN how = 'late' THEN pe ELSE s0 + d0 END,
    CASE how WHEN 'early' THEN d0 - (ps - s0) WHEN 'late' THEN d0 - (s0 + d0 - pe) WHEN 'call' THEN least(d0, pd) WHEN 'call clamped' THEN least(d0, pd) ELSE d0 END, depth, path, pkind, how
  FROM (SELECT x.*, CASE WHEN n = 1 AND d0 <= 1.01::DOUBLE * pd AND ((kind = 'SERVER' AND pkind = 'CLIENT') OR (kind = 'SERVER' AND pkind <> 'SERVER' AND gkind = 'SERVER') OR coalesce(host <> phost, false)) THEN CASE WHEN d0 <= pd THEN 'call' ELSE 'call clamped' END
    WHEN s0 >= ps AND s0 + d0 <= pe THEN 'kept' WHEN s0 < ps AND ps < s0 + d0 AND s0 + d0 <= pe THEN 'early' WHEN ps <= s0 AND s0 < pe AND pe < s0 + d0 THEN 'late' ELSE 'drop' END AS how
    FROM (SELECT c.tid, c.k, c.pk, c.event_id, c.svc, c.op, c.kind, c.err, c.host, c.region, c.s AS s0, c.d AS d0, p.s AS ps, p.e AS pe, p.d AS pd, p.kind AS pkind, p.pkind AS gkind, p.host AS phost, p.depth + 1 AS depth, p.path || '->[' || c.svc || '] ' || c.op AS path, nc.n
      FROM nd p JOIN st c ON c.tid = p.tid AND c.pk = p.k JOIN nc ON nc.tid = p.tid AND nc.k = p.k) x) WHERE how <> 'drop'),
ch AS MATERIALIZED (SELECT c.*, p.d AS pd, p.s AS ps, p.e AS pe, row_number() OVER (PARTITION BY c.tid, c.pk ORDER BY c.e DESC, c.k DESC) AS r FROM nd c JOIN nd p ON c.tid = p.tid AND c.pk = p.k),
sib AS MATERIALIZED (SELECT tid, pk, list(s) AS ss, list(e) AS es FROM ch GROUP BY 1, 2),
pk AS (SELECT tid, pk, k, r, s AS ls, e AS le, true AS picked FROM ch WHERE r = 1
  UNION ALL SELECT tid, pk, k, r, CASE WHEN hb THEN s ELSE ls END, CASE WHEN hb THEN e ELSE le END, hb FROM (SELECT c.*, p.ls, p.le,
    c.e < p.ls OR (c.e < p.le AND c.s < p.ls AND c.pd > 0 AND (c.e - p.ls) / c.pd < 0.01 AND len(list_filter(x.ss, lambda v: v BETWEEN p.ls AND c.e)) + len(list_filter(x.es, lambda v: v BETWEEN p.ls AND c.e)) = 2) AS hb
    FROM pk p JOIN ch c ON c.tid = p.tid AND c.pk = p.pk AND c.r = p.r + 1 JOIN sib x ON x.tid = c.tid AND x.pk = c.pk)),
cp0 AS (SELECT nd.*, true AS on_cp, true AS picked FROM nd WHERE depth = 1 UNION ALL SELECT nd.*, p.on_cp AND pk.picked, pk.picked FROM cp0 p JOIN nd ON nd.tid = p.tid AND nd.pk = p.k JOIN pk ON pk.tid = nd.tid AND pk.k = nd.k),
cp AS MATERIALIZED (SELECT cp0.*, coalesce(x.n, 0) AS nch, coalesce(x.nerr, 0) AS nerr, greatest(0, cp0.d - coalesce(x.cd, 0)) AS own, cp0.d - coalesce(x.cd, 0) AS own0 FROM cp0 LEFT JOIN (SELECT tid, pk AS k, count(*) AS n, count(*) FILTER (WHERE err) AS nerr, sum(d) FILTER (WHERE on_cp)::BIGINT AS cd FROM cp0 WHERE pk IS NOT NULL GROUP BY 1, 2) x ON x.tid = cp0.tid AND x.k = cp0.k),
pr AS MATERIALIZED (SELECT tid, path, sum(d)::BIGINT AS inc, greatest(0, sum(own0))::BIGINT AS excl, count(*) AS freq FROM cp WHERE on_cp GROUP BY 1, 2),
lat AS MATERIALIZED (SELECT tid, d AS latency, count(*) OVER () AS n, row_number() OVER (ORDER BY d, tid) AS rn FROM nd WHERE depth = 1)
"""


SQL = sql()
