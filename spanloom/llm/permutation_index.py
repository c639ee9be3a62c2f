"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its `prefix` nearest pivots (distinct vectors of a bounded sample: the first `sampled` rows by a
hash of their id). Rows are posted in pivot files: each in the file of its nearest pivot, a large file in parts of about `part` rows, with
an inverted list for each pivot of its prefix and the pivot's rank there. The footrule distance of two prefixes is a constant
less 2 * sum over shared pivots of min(prefix - rank in the query, prefix - rank in the row), so adding up that minimum along
the lists of the query's pivots ranks a file's rows by footrule.

A query visits the files of its nearest pivots only, until they hold the share `visit` of the sample's rows (and `ample` * k others), and reranks
by exact Euclidean distance, in double precision, the rows there whose footrule is no worse than a bound: that of the best `share` of the
sample (`ample` * k others at least), which is the same share of all rows as far as the sample is like them. Nothing depends on the number
of rows: neither a small table nor a small file is searched in another way. At least k others are found if there are as many.

Every row is indexed once. A task streams the parts dealt to it: the rows of a part first, then its queries, a batch at a time; so
memory holds one part and one batch, however many queries visit it. Only the sample and the sizes of the pivot files are collected.

Vectors that are null, zero, or hold a null or a non-finite component take no part, nor do rows without vec_id or with
a length other than the most frequent (on ties the smallest). Identical rows count once; equal vectors are compared once in a part.
Ties go to the smaller vec_id. A single very frequent vec_id or vector is spread over the parts of its file. Other columns are not looked at."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PIVOTS, SAMPLED, PREFIX, VISIT, SHARE, AMPLE = 256, 2048, 96, 0.75, 0.15, 4


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width).astype(np.float64)


def by_nearness(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the pivots of each row, nearest first."""
    return np.argsort((pivots**2).sum(1)[None] - 2 * x @ pivots.T, axis=1, kind="stable")


class Lists:
    """Inverted lists of prefixes (rows of pivot numbers, nearest first): rows by pivot, with how much rank they have left."""

    def __init__(self, near: np.ndarray, pivots: int):
        m = near.shape[1]
        by = np.argsort(near.ravel(), kind="stable")
        self.n, self.rows, self.left = len(near), by // m, (m - by % m).astype(np.int32)
        self.start = np.searchsorted(near.ravel()[by], np.arange(pivots + 1))

    def shared(self, other: Lists) -> np.ndarray:
        """For each row of the other and each of these: the sum of the minima over shared pivots. More means a smaller footrule."""
        out = np.zeros((other.n, self.n), np.int32)
        for p in range(len(self.start) - 1):
            a, b = slice(self.start[p], self.start[p + 1]), slice(other.start[p], other.start[p + 1])
            if a.stop > a.start and b.stop > b.start:
                out[np.ix_(other.rows[b], self.rows[a])] += np.minimum(other.left[b][:, None], self.left[a][None])
        return out


class Index:
    """The sample: pivots, prefixes and files of its rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: int, prefix: int):
        _, first = np.unique(x, axis=0, return_index=True)
        self.ids, self.pivots = ids, x[np.sort(first)[:pivots]]
        self.m = min(prefix, len(self.pivots))
        near = by_nearness(x, self.pivots)
        self.files, self.lists = near[:, 0], Lists(near[:, : self.m], len(self.pivots))

    def plan(self, ids: np.ndarray, x: np.ndarray, least: int, visit: float, share: float) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query: the files to visit, and the sum of minima from which on rows are reranked; `least` others of the sample are."""
        near = by_nearness(x, self.pivots)
        scores, files, bounds = self.lists.shared(Lists(near[:, : self.m], len(self.pivots))), [], np.zeros(len(x), np.int32)
        n, need = len(self.ids), max(least, math.ceil(share * len(self.ids)))
        for i, order in enumerate(near):
            others = self.ids != ids[i]
            held, rest = (np.bincount(self.files[m], minlength=len(order))[order] for m in (np.ones(n, bool), others))
            seen = (np.cumsum(held) - held < visit * n) | (np.cumsum(rest) - rest < least)
            files.append(np.sort(order[seen]))
            best = np.sort(scores[i][others & np.isin(self.files, files[-1])])[::-1]
            bounds[i] = best[need - 1] if len(best) >= need else 0
        return files, bounds


class Part:
    """Rows of one part of a pivot file. Equal vectors are posted once, with their ids in ascending order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, index: Index):
        rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        _, first, own = np.unique(rows, return_index=True, return_inverse=True)
        order = np.lexsort((ids, own))
        self.ids, self.x, self.index = ids[order], np.asfortranarray(x[first]), index
        self.held = np.searchsorted(own[order], np.arange(len(first) + 1))
        self.lists = Lists(by_nearness(x[first], index.pivots)[:, : index.m], len(index.pivots))

    def search(self, ids: np.ndarray, x: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, row ids, distances) of each query's best k other rows within its bound."""
        shared = self.lists.shared(Lists(by_nearness(x, self.index.pivots)[:, : self.index.m], len(self.index.pivots)))
        q, r = np.nonzero(shared >= bounds[:, None])
        total, x = np.zeros(len(q)), np.asfortranarray(x)
        for j in range(x.shape[1]):  # components in order, so that sums are the same everywhere
            total += (self.x[r, j] - x[q, j]) ** 2
        order = np.lexsort((total, q))
        q, r, total = q[order], r[order], total[order]
        # k + 1 vectors hold k other rows at least; what is as near as the last of them stays too.
        first = np.searchsorted(q, np.arange(len(ids)))
        last = np.minimum(first + k, np.searchsorted(q, np.arange(len(ids)), "right") - 1)
        keep = total <= total[last][q] if len(q) else np.zeros(0, bool)
        q, r, total = q[keep], r[keep], total[keep]
        many = np.minimum(self.held[r + 1] - self.held[r], k + 1)
        at = np.repeat(self.held[r] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        q, found, total = np.repeat(q, many), self.ids[at], np.repeat(total, many)
        other = found != ids[q]
        q, found, total = q[other], found[other], total[other]
        order = np.lexsort((found, total, q))
        q, found, total = q[order], found[order], total[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        return ids[q[best]], found[best], np.sqrt(total[best])


def search(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = PIVOTS, sampled: int = SAMPLED, prefix: int = PREFIX, visit: float = VISIT, share: float = SHARE, ample: int = AMPLE, part: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k nearest other rows that are found."""
    base = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    base = base.where(F.col("id").isNotNull() & usable(F.col("x")))
    widths = base.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    width = widths[0]["width"] if widths else 1
    base = base.where(F.size("x") == width).groupBy("id", "x").agg(F.max("asks").alias("asks"))
    sample = base.select("id", "x").orderBy(F.md5(F.col("id").cast("string")), "id", "x").limit(sampled).collect()
    index = Index(np.array([r["id"] for r in sample], np.int64), np.array([r["x"] for r in sample], np.float64).reshape(-1, width), pivots, prefix) if sample else None

    def posted(some: pa.RecordBatch, asks: bool) -> pa.RecordBatch:
        ids, x = np.asarray(some.column(0)), _matrix(some.column(1), width)
        files, bounds = index.plan(ids, x, ample * k, visit, share) if asks else ([None] * len(x), np.zeros(len(x), np.int32))
        return pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(by_nearness(x, index.pivots)[:, 0], pa.int32()), pa.array(files, pa.list_(pa.int32())), pa.array(bounds, pa.int32())], names=["id", "x", "file", "visits", "bound"])

    def run_posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # queries are planned apart from other rows, a bounded number at a time
            for asks, step in ((False, 8192), (True, 512)):
                some = batch.filter(batch.column(2) if asks else pc.invert(batch.column(2)))
                for a in range(0, len(some), step):
                    yield posted(some.slice(a, step), asks)

    rows = cut(base.mapInArrow(run_posted, f"id long, x {dict(base.dtypes)['x']}, file int, visits array<int>, bound int"), "posted")
    sizes = {r["file"]: r["n"] for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect()}
    parts = F.array(*(F.lit(-(-sizes.get(f, 0) // part)) for f in range(pivots)))
    of = lambda file: F.element_at(parts, F.col(file) + 1)
    sides = rows.select("file", F.pmod(F.xxhash64("id", "x"), F.greatest(of("file"), F.lit(1))).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "x", "bound")
    asked = rows.where("visits is not null").withColumn("file", F.explode("visits")).where(of("file") > 0)
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), of("file") - 1))).select("file", "part", F.lit(True).alias("asks"), "id", "x", "bound")
    dealt = sides.unionByName(asked).repartition("file", "part").sortWithinPartitions("file", "part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, own = None, [], None
        for batch in batches:
            place = np.asarray(batch.column(0)).astype(np.int64) << 32 | np.asarray(batch.column(1)).astype(np.int64)
            state = place << 1 | np.array(batch.column(2), dtype=np.int64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(state)) + 1, [len(batch)]]) if len(batch) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if place[a] != key:
                    key, held, own = place[a], [], None
                ids, x = np.asarray(batch.column(3))[a:b], _matrix(batch.column(4).slice(a, b - a), width)
                if not state[a] & 1:
                    held.append((ids, x))
                    continue
                if own is None and held:
                    own, held = Part(*map(np.concatenate, zip(*held)), index), []
                bounds, step = np.asarray(batch.column(5))[a:b], max(1, (1 << 21) // max(1, len(own.held))) if own else 0
                for i in range(0, b - a if own else 0, step or 1):
                    found = own.search(ids[i : i + step], x[i : i + step], bounds[i : i + step], k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # One row a neighbour: rows that share a vec_id but not a vector are told apart by their score alone.
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, asks: np.ndarray, k: int = 10) -> Iterator[tuple[int, list[int]]]:
    """Exact neighbours, for measuring recall on fixtures."""
    for i in np.flatnonzero(asks):
        d = ((x - x[i]) ** 2).sum(1)
        d[ids == ids[i]] = np.inf
        best = np.lexsort((ids, d))[:k]
        yield int(ids[i]), [int(ids[j]) for j in best if np.isfinite(d[j])]


def oracle_sql(asks: str = "vec_id % 100 = 0", k: int = 10, pivots: int = PIVOTS, sampled: int = SAMPLED, prefix: int = PREFIX, visit: float = VISIT, share: float = SHARE, ample: int = AMPLE) -> str:
    """DuckDB SQL for the rows of `search`: the same index, by joins over all rows."""
    square = lambda a, b: f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])), lambda x, y: x + y)"
    return f"""WITH v0 AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id, e) AS rid, vec_id, e FROM v0 WHERE len(e) = (SELECT len(e) FROM v0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY rid) - 1 AS p, e FROM (SELECT e, min(rid) AS rid FROM v WHERE rid <= {sampled} GROUP BY e) ORDER BY rid LIMIT {pivots}),
o AS MATERIALIZED (SELECT rid, vec_id, p, row_number() OVER (PARTITION BY rid ORDER BY d, p) - 1 AS rank FROM (SELECT rid, vec_id, p, {square("v.e", "p.e")} AS d FROM v, p)),
w AS MATERIALIZED (SELECT rid, vec_id, p, least({prefix}, (SELECT count(*) FROM p)) - rank AS w FROM o WHERE rank < {prefix}),
f AS MATERIALIZED (SELECT rid, vec_id, p AS file FROM o WHERE rank = 0),
s AS (SELECT file, vec_id, count(*) AS n FROM f WHERE rid <= {sampled} GROUP BY 1, 2), t AS (SELECT file, sum(n) AS n FROM s GROUP BY 1),
c AS (SELECT o.rid, o.vec_id, o.p, o.rank, coalesce(t.n, 0) AS n, coalesce(t.n, 0) - coalesce(s.n, 0) AS others FROM o LEFT JOIN t ON t.file = o.p LEFT JOIN s ON s.file = o.p AND s.vec_id = o.vec_id WHERE o.{asks}),
g AS (SELECT *, sum(n) OVER (PARTITION BY rid ORDER BY rank) - n AS before, sum(others) OVER (PARTITION BY rid ORDER BY rank) - others AS others_before FROM c),
vis AS MATERIALIZED (SELECT rid, p AS file FROM g WHERE before < {visit}::DOUBLE * (SELECT sum(n) FROM t) OR others_before < {ample * k}),
b AS MATERIALIZED (SELECT q.rid AS q, q.vec_id AS query_id, f.rid AS r, f.vec_id FROM f q JOIN vis ON vis.rid = q.rid JOIN f ON f.file = vis.file WHERE q.{asks} AND f.vec_id <> q.vec_id),
x AS MATERIALIZED (SELECT b.q, b.r, sum(least(a.w, z.w)) AS score FROM b JOIN w a ON a.rid = b.q JOIN w z ON z.rid = b.r AND z.p = a.p GROUP BY 1, 2),
y AS MATERIALIZED (SELECT b.*, coalesce(x.score, 0) AS score FROM b LEFT JOIN x USING (q, r)),
need AS (SELECT greatest({ample * k}, ceil({share}::DOUBLE * (SELECT sum(n) FROM t))) AS n),
l AS (SELECT q, min(score) FILTER (WHERE i = n) AS bound FROM (SELECT q, score, row_number() OVER (PARTITION BY q ORDER BY score DESC) AS i FROM y WHERE r <= {sampled}), need GROUP BY q),
d AS (SELECT y.query_id, y.vec_id, sqrt({square("h.e", "j.e")}) AS score FROM y LEFT JOIN l USING (q) JOIN v j ON j.rid = y.q JOIN v h ON h.rid = y.r WHERE y.score >= coalesce(l.bound, 0))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= {k}"""
