"""Near-duplicates by a signature-coordinate inverted join.

A text's set is its distinct shingles of five words; fewer words make one shingle of them all. Texts with equal sets form a
class, which one member stands for. Each class has a MinHash signature of K coordinates and is posted under its
(coordinate, value) pairs. Two classes are candidates if at least T of K coordinates match; each then has a match within
the K - T + 1 pairs of the other that are rarest in the corpus (prefix filter: with all K - T + 1 of them missed, at most T - 1
could match), so only these prefixes are posted, pairs that nobody shares are skipped (they count as spent places), and
classes with fewer than T shared pairs are never posted. The long lists of common passages hold no prefixes of texts that have
enough rarer pairs. Every link is confirmed on the two full sets. T lies 4.8 standard deviations under the matches that the least
similarity gives on average (40 of 64 at 0.85, 35 at 0.8), which a linked pair misses about twice in a million times.

A list is never paired with itself outright. First each member meets the most typical member of its lists (the hub: the one with
the largest part of its shingles shared), these links are confirmed, and components are formed. Then only pairs across components are
left, and each is met and confirmed: of each list all but its largest component, against the whole list. Pairs are left out only
where a component joins them already or where they cannot be similar enough: an intersection holds no shingle that only one
of the posted classes has, so its size is bounded by what each shares with anybody, and two members of one hub share at most
what neither lacks of it and their further shared shingles. Nothing is capped.

Components grow by minimum labels with pointer jumping, cut to the shared folder each round; nothing is collected. Between the steps
executors collect their garbage, and workers hand back what they freed: else heaps, with a sort buffer for each of many small tasks, grow to their
limit beside Python workers that stay as large as the operators before left them.

Null and empty texts have the empty set and link with nothing. Repeated rows are of one class, and so of one component.
Rows without doc_id take part, but lend no id: a component's id is the smallest doc_id in it (null if it has none). Columns
other than doc_id and text are not looked at. A very long text is one set in memory of the task that holds it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .common import cut, done_with, settle

K, WIDTH = 64, 5
U64 = textbuf.U64
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_C = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * U64(2) + U64(1)
_SHORT = U64(0xD6E8FEB86659FD93)


def match_threshold(percent: int) -> int:
    p = percent / 100
    return max(1, int(K * p - 4.8 * (K * p * (1 - p)) ** 0.5))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each of the texts i..j."""
    words = textbuf.Words(data, offsets, i, j, textbuf.SPACE)
    h = words.hashes()
    n = max(0, len(h) - WIDTH + 1)
    joint = np.zeros(n, U64)
    for k in range(WIDTH if n else 0):
        joint += h[k : k + n] * _C[k]
    joint = textbuf.mix(joint)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= WIDTH:
            yield textbuf.distinct(joint[a : b - WIDTH + 1])
        elif b > a:
            yield textbuf.mix((h[a:b] * _C[: b - a]).sum(dtype=U64, keepdims=True) + _SHORT * np.array([b - a], U64))
        else:
            yield np.zeros(0, U64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """K numbers of 32 bits, spread over all of them: the smallest hashes themselves lie close to 0 in large sets, where unrelated sets would meet by chance."""
    out = np.full(K, 0xFFFFFFFFFFFFFFFF, U64)
    for a in range(0, len(shingles), 2048):
        out = np.minimum(out, (shingles[None, a : a + 2048] * _A[:, None] + _B[:, None]).min(1))
    return textbuf.mix(out).astype(np.uint32)


def class_id(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return np.array([textbuf.mix(shingles).sum(dtype=U64), textbuf.mix(shingles ^ _SHORT).sum(dtype=U64)], U64).tobytes()


def signed(docs: DataFrame) -> DataFrame:
    """rid, doc_id, mark, n_shingles, cid (null for the empty set) and sig of each row of `docs` (rid, doc_id, mark, text)."""
    schema = "rid long, doc_id long, mark struct<a:long,b:long>, n_shingles long, cid binary, sig array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textbuf.buffer(batch.column(3))
            for i, j in textbuf.slices(offsets):
                sizes, cids, sigs = [], [], []
                for s in shingle_sets(data, offsets, i, j):
                    sizes.append(len(s))
                    cids.append(class_id(s) if len(s) else None)
                    sigs.append(signature(s) if len(s) else np.zeros(0, np.uint32))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs).view(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), pa.array(sizes, pa.int64()), pa.array(cids, pa.binary()), lists], names=[x.split()[0] for x in schema.split(", ")])

    return docs.mapInArrow(textbuf.trimmed(run), schema)


def postings(classes: DataFrame, least: int) -> DataFrame:
    """cid, n_shingles, tok, toks (all of them): each class under its rarest shared (coordinate, value) pairs. `classes` has k too, a number for each
    class: what is dealt for every coordinate is two numbers a row."""
    tokens = classes.select("k", F.posexplode("sig").alias("at", "value"))
    tokens = tokens.select("k", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("tok"))
    often = tokens.groupBy("tok").agg(F.count("*").alias("n")).where("n > 1")
    shared = tokens.join(often, "tok").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("n", "tok"))).alias("own"))
    shared = shared.where(F.size("own") >= least)
    shared = shared.select("k", F.transform(F.slice("own", F.lit(1), F.size("own") - least + 1), lambda x: x["tok"]).alias("toks"))
    return shared.join(classes.select("k", "cid", "n_shingles"), "k").select("cid", "n_shingles", "toks", F.explode("toks").alias("tok"))


def perhaps_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose rid is in `wanted`, and few others while `wanted` has far fewer rows than there are bits: 2^26 of them, 8 MB at most, in pieces of 2^15."""
    at = F.xxhash64("rid")
    piece, bit = F.shiftrightunsigned(at, 15).bitwiseAND(F.lit(2047)), at.bitwiseAND(F.lit(32767))
    bits = wanted.groupBy(piece.alias("piece")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return rows.join(F.broadcast(bits), (piece == F.col("piece")) & (F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1), "left_semi")


def full_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, shingles (as bytes) of the classes in `wanted` (rid, cid), made anew from the texts. Other texts stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textbuf.buffer(batch.column(0))
            for i, j in textbuf.slices(offsets):
                rows = []
                for s, cid in zip(shingle_sets(data, offsets, i, j), batch.column(1).slice(i, j - i).to_pylist()):
                    if len(s) and class_id(s) == cid:  # another text may stand under the same id
                        rows.append((cid, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(2)], names=["cid", "shingles"])

    met = perhaps_in(texts, wanted).join(wanted, "rid").select("text", "cid")
    return met.mapInArrow(textbuf.trimmed(run), "cid binary, shingles binary").groupBy("cid").agg(F.first("shingles").alias("shingles"))


def joined(pairs: DataFrame, sets: DataFrame, key: str, salted: int = 128) -> DataFrame:
    """`pairs` with set_<key>, the set of its column `key`. A class that stands in more than `salted` pairs, as the hub of a large group does,
    is copied once for each so many of them, and they spread over the copies."""
    often = pairs.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > salted).select(key, F.ceil(F.col("n") / salted).cast("int").alias("copies"))
    other = "y" if key == "x" else "x"
    spread = lambda df, salt: df.join(often, key, "left").withColumn("salt", salt).drop("copies")
    many = F.coalesce("copies", F.lit(1))
    right = spread(sets.toDF(key, f"set_{key}"), F.explode(F.sequence(F.lit(0), many - 1)))
    return spread(pairs, F.pmod(F.xxhash64(other), many).cast("int")).join(right, [key, "salt"]).drop("salt")


def met(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`pairs` (x, y) with linked (100 * intersection >= percent * union), ny and both (sizes of y and of the intersection) and
    missing: the bits of y's sorted shingles that x lacks."""
    names = ["x", "y", "linked", "ny", "both", "missing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3))):
                a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                lacks = a[at] != b
                both = len(b) - int(lacks.sum())
                bits = np.packbits(np.concatenate([lacks, np.zeros(-len(lacks) % 64, bool)])).view(np.int64)
                out.append((100 * both >= percent * (len(a) + len(b) - both), len(b), both, bits.tolist()))
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=names)

    both = joined(joined(pairs, sets, "x"), sets, "y")
    return both.select("x", "y", "set_x", "set_y").mapInArrow(textbuf.trimmed(run), "x binary, y binary, linked boolean, ny long, both long, missing array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (x, y) that link."""
    return met(pairs, sets, percent).where("linked").select("x", "y")


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """`labels` (cid, comp) after joining what `edges` (x, y) link: every cid under the smallest label it can reach."""
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    of = lambda key, label: labels.select(F.col("cid").alias(key), F.col("comp").alias(label))
    links = both.join(of("x", "a"), "x").join(of("y", "b"), "y").where("a <> b").select("a", "b").distinct()  # between labels
    links = cut(links, "links")
    settle(links.sparkSession)
    roots = cut(links.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root")), "roots")
    while True:
        low = links.join(roots.toDF("b", "reach"), "b").groupBy("a").agg(F.min("reach").alias("reach")).withColumnRenamed("a", "node")
        step = roots.join(low, "node").select("node", F.col("root").alias("was"), F.least("root", "reach").alias("to"))
        # The label of the label: a node that took another's label takes what that one takes.
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        moved = cut(step.join(jump, "to").select("node", "was", F.least("to", "next").alias("root")), "roots")
        if moved.where("root <> was").isEmpty():
            break
        done_with(roots)
        roots = moved.select("node", "root")
    joined = labels.join(roots.toDF("comp", "root"), "comp", "left")
    found = cut(joined.select("cid", F.coalesce("root", "comp").alias("comp")), "labels")
    for table in (links, roots, moved):
        done_with(table)
    return found


def shared_shingles(sets: DataFrame) -> DataFrame:
    """cid, lone: how many of a posted class's shingles no other posted class has. Shingles carry half of the class's name; should
    two classes share that half, both count as having none, which bounds no less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, U64) for x in batch.column(1).to_pylist()]
            name = [np.full(len(x), np.frombuffer(c[:8], np.int64)[0]) for c, x in zip(batch.column(0).to_pylist(), own)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(np.concatenate(name))], names=["h", "c"])

    once = sets.select("cid", "shingles").mapInArrow(textbuf.trimmed(run), "h long, c long").groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("c")).where("n = 1")
    lone = once.groupBy("c").agg(F.count("*").alias("lone"))
    names = sets.select("cid").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([int.from_bytes(x[:8], "little", signed=True) for x in b.column(0).to_pylist()], pa.int64())], names=["cid", "c"]) for b in batches), "cid binary, c long")
    twice = names.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    return names.join(lone.join(twice, "c", "left_anti"), "c", "left").select("cid", F.coalesce("lone", F.lit(0)).alias("lone"))


def link(posted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cid, comp of all posted classes."""
    start = posted.select("cid").distinct().select("cid", F.col("cid").alias("comp"))
    # What two sets share lies among the shingles that each shares with anybody: `common` bounds the intersection from above.
    posted = posted.join(shared_shingles(sets), "cid").withColumn("common", F.col("n_shingles") - F.col("lone")).drop("lone")
    posted = able = cut(posted.where(100 * F.col("common") >= percent * F.col("n_shingles")), "able")
    settle(sets.sparkSession)
    can = lambda c1, n1, c2, n2: F.least(c1, c2) * (100 + percent) >= percent * (F.col(n1) + F.col(n2))
    typical = F.struct((F.col("common") / F.col("n_shingles")).alias("part"), F.col("cid"))
    hubs = posted.groupBy("tok").agg(F.max_by(F.struct("cid", "n_shingles", "common"), typical).alias("h"), F.count("*").alias("n")).where("n > 1").select("tok", F.col("h.cid").alias("hub"), F.col("h.n_shingles").alias("hn"), F.col("h.common").alias("hc"))
    stars = posted.join(hubs, "tok").where((F.col("cid") != F.col("hub")) & can("common", "n_shingles", "hc", "hn"))
    stars = stars.groupBy("cid", "hub").agg(F.count("*").alias("lists"), F.first(F.col("hc") / F.col("hn")).alias("part"))
    stars = stars.groupBy("cid").agg(F.max_by("hub", F.struct("part", "lists", "hub")).alias("hub")).toDF("x", "y")
    seen = cut(met(stars, sets, percent), "stars")
    settle(sets.sparkSession)
    labels = components(start, seen.where("linked").select("x", "y"))
    settle(sets.sparkSession)
    # What each member lacks of its hub, and how many shingles beside the hub's it shares with anybody.
    lacks = seen.select(F.col("x").alias("cid"), F.col("y").alias("hub"), F.col("ny").alias("hn"), "both", "missing")
    posted = posted.join(lacks, "cid", "left").withColumn("extra", F.col("common") - F.col("both"))

    own = posted.join(labels, "cid")
    parts = own.groupBy("tok", "comp").agg(F.count("*").alias("n"))
    lists = parts.groupBy("tok").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.count("*").alias("comps")).where("comps > 1").select("tok", "major")
    there = cut(own.join(lists, "tok"), "lists")
    settle(sets.sparkSession)
    minor = there.where("comp <> major").select("tok", F.col("cid").alias("x"), F.col("comp").alias("cx"), F.col("n_shingles").alias("nx"), F.col("common").alias("vx"), F.col("toks").alias("tx"), F.col("hub").alias("hx"), F.col("missing").alias("mx"), F.col("extra").alias("ex"))
    # A pair is made in one of its common lists only.
    first = F.col("tok") == F.array_min(F.array_intersect("tx", "toks"))
    # Of a common hub two members share at most what neither lacks of it; the rest of an intersection is among their extras.
    gone = F.aggregate(F.zip_with("mx", "missing", lambda a, b: F.bit_count(a.bitwiseOR(b))), F.lit(0), lambda n, k: n + k)
    most = F.col("hn") - gone + F.least("ex", "extra")
    apart = F.coalesce((F.col("hx") == F.col("hub")) & (most * (100 + percent) < percent * (F.col("nx") + F.col("n_shingles"))), F.lit(False))
    across = minor.join(there, "tok").where((F.col("cx") != F.col("comp")) & ((F.col("comp") == F.col("major")) | (F.col("x") < F.col("cid"))) & can("vx", "nx", "common", "n_shingles") & first & ~apart)
    across = across.select(F.least("x", "cid").alias("x"), F.greatest("x", "cid").alias("y")).distinct()
    found = components(labels, confirmed(across, sets, percent))
    for table in (able, seen, there, labels):
        done_with(table)
    return found


def _found(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, mark (two hashes of the text), n_shingles, comp and component_id of each row of `docs`. Rows of the empty set have null comp."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select(F.coalesce("doc_id", F.xxhash64("text")).alias("rid"), "doc_id", _mark(F.col("text")).alias("mark"), "text")
    signs = cut(signed(texts), "signatures")
    classes = signs.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = cut(classes.withColumn("k", F.monotonically_increasing_id()), "classes")  # written, so that the numbers stay as they are
    # Signatures go as soon as they are posted, and every other table once nothing reads it.
    rows = cut(signs.select("doc_id", "mark", "n_shingles", "cid"), "rows")
    done_with(signs)
    every = cut(postings(classes, match_threshold(percent)), "postings")
    members = cut(classes.select("cid", "least", "rid"), "members")
    done_with(classes)
    lone = every.groupBy("tok").agg(F.count("*").alias("n")).where("n > 1").select("tok")
    posted = cut(every.join(lone, "tok", "left_semi"), "postings")
    done_with(every)
    settle(docs.sparkSession)
    wanted = cut(members.join(posted.select("cid").distinct(), "cid").select("rid", "cid"), "wanted")
    sets = cut(full_sets(texts.select("rid", "text"), wanted), "sets")
    done_with(wanted)
    settle(docs.sparkSession)
    labels = link(posted, sets, percent)
    done_with(sets)
    done_with(posted)
    settle(docs.sparkSession)
    named = members.join(labels, "cid", "left").select("cid", F.coalesce("comp", "cid").alias("comp"), "least")
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = named.join(names, "comp").select("cid", "comp", "component_id")
    out = rows.join(found, "cid", "left").withColumn("component_id", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "mark", "n_shingles", "comp", "component_id")


def _mark(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit("mark")).alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id is the component's id) for each row of `docs`."""
    return _found(docs, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, that stand for their component: the one with its smallest doc_id (null ids last; among
    equal ids one text, chosen by its hash). A row without words is a component of its own, repeated ones (equal doc_id and text) count as one."""
    found = _found(docs, percent)
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    one = found.where("comp is not null").groupBy("comp").agg(F.min(own).alias("own")).select("own.doc_id", "own.mark")
    stay = one.unionByName(found.where("comp is null").select("doc_id", "mark").distinct()).select(F.col("doc_id").alias("_kept"), F.col("mark").alias("_as"))
    # The document's own columns travel inside one, so that their names don't matter.
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), _mark(F.col("text").cast("string")).alias("_text"))
    return rows.join(stay, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_text") == F.col("_as")), "left_semi").dropDuplicates(["_id", "_text"]).select("_row.*")


def oracle_sql(percent: int = 85) -> str:
    """DuckDB SQL for the rows of `near_duplicates`: all pairs that share a shingle, on full sets."""
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
d AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' '))) END AS ss FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS cls, ss, len(ss) AS n FROM (SELECT doc_id, list_sort(ss) AS ss FROM d WHERE len(ss) > 0) GROUP BY ss),
s AS MATERIALIZED (SELECT cls, n, unnest(ss) AS s FROM c),
p AS MATERIALIZED (SELECT a.cls AS x, b.cls AS y FROM s a JOIN s b ON a.s = b.s AND a.cls < b.cls AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT cls AS node, cls AS reach FROM c UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, len(d.ss)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(m.component_id, d.doc_id) AS kept
FROM d LEFT JOIN c ON c.ss = list_sort(d.ss) LEFT JOIN m ON m.node = c.cls"""
