"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions. Each decision has, in the context of the 0..depth bytes before it, a count of zeros and ones
among the training texts; each such node has the Krichevsky-Trofimov estimate of its counts and the weighted
probability P = (KT + product of its children's P) / 2. Scoring mixes the estimates of all depths along the context by the
weights that these probabilities imply, and adds up the code length of every byte and of an end mark.

Nothing of the tree is bounded by a share of the corpus: every context that training texts hold `least` times is kept, so the model
grows with the input, and it stays on the cluster. A context seen less often has no node; its node above predicts for it, as that one's own child.

1. Partitions emit slices of texts: the distinct grams (a byte and the `depth` bytes before it) of a slice with how often training texts in it hold
   them, dealt to buckets by the hash of the nearest SPLIT bytes of context. So a bucket holds whole subtrees below depth SPLIT.
2. A bucket sums its grams, grows its subtrees, and mixes for every gram asked for the estimates from `depth` up to SPLIT. It passes up the sums that
   the nodes at depth SPLIT - 1 need. Nodes above SPLIT meet on the driver: they are at most 256 ** SPLIT grams, however large the corpus.
3. These top levels are broadcast, buckets finish their grams and send each slice its own; a slice adds up its texts.

Base score: add-one unigrams. Words with at least the share 1 / 2**20 of all tokens (so at most 2**20 of them) are looked up from
memory; the others of a slice of texts go to the bucket that holds their counts and come back as sums a text. Both are exact.

Texts are lower-cased in A-Z; null counts as empty: it has the end token alone. Rows are scored one by one, so repeated
rows stay. Without training texts every count is 0 and each bit has probability 1/2. Counts travel as packed arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .common import cut, done_with

U64 = textbuf.U64
END = U64(0x5851F42D4C957F2D)  # the end token's hash
HEAD = 1 << 20
SPLIT = 3  # nodes with fewer bytes of context are shared by all buckets
PIECES = 4  # parts in which a bucket grows its subtrees
PARTS = 16  # groups in which the sums for the top levels meet
MOST_GRAMS, MOST_BYTES = 2_000_000, 32 << 20  # of a slice
STEP_BYTES = 1 << 20  # of text at a time
LOG2 = math.log10(2.0)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(n, at) if len(at) else n[:0]


def shorter(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams with a context of `depth` bytes from those with a longer one."""
    return merged([keys & U64((1 << (8 * (depth + 1))) - 1)], [counts])


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with those counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - math.log(math.pi) - _lgamma(zeros + ones + 1.0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 8.0
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    return out - np.log(product)


def bit_nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node keys (context above, bits so far after a leading one in the lowest eight) with counts of zeros and ones."""
    byte, context, out = (keys & U64(255)).astype(np.int64), keys >> U64(8), []
    for level in range(8):
        node = (context << U64(8)) | ((1 << level) | (byte >> (8 - level))).astype(U64)
        at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        bit = (byte >> (7 - level)) & 1
        out.append((node[at], *(np.add.reduceat(counts * b, at) if len(at) else counts[:0] for b in (1 - bit, bit))))
    k, a, b = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(k, kind="stable")
    return k[order], a[order].astype(np.float64), b[order].astype(np.float64)


@dataclass
class Tree:
    """For each depth: sorted node keys, counts of zeros and ones, and the weight of the node's own estimate."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    first: int = 0  # the depth of levels[0]

    @classmethod
    def grow(cls, grams: list[tuple[np.ndarray, np.ndarray]], first: int = 0, below: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[Tree, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The tree of depths first, first + 1..., and what it passes up: parents at depth first - 1, the sums of their
        children's log probabilities and of their counts. `below`: the same from deeper levels, if there are any."""
        out, child = [], below
        for depth in range(first + len(grams) - 1, first - 1, -1):
            k, a, b = bit_nodes(*grams[depth - first])
            own = kt(a, b)
            weight, total = np.ones(len(k)), own
            if child is not None and len(k):
                ck, cp, cn = child
                at = np.searchsorted(k, ck)
                under, held = np.bincount(at, cp, len(k)), np.bincount(at, cn, len(k))
                under = under + own * (a + b - held) / (a + b)
                has = held > 0
                weight = np.where(has, 1 / (1 + np.exp(np.clip(under - own, -700, 700))), 1.0)
                total = np.where(has, np.logaddexp(own, under) - math.log(2), own)
            out.append((k, a.astype(np.float32), b.astype(np.float32), weight.astype(np.float32)))
            parent, back = np.unique(k & U64((1 << (8 * depth)) - 1 if depth else 255), return_inverse=True)
            child = (parent, np.bincount(back, total, len(parent)), np.bincount(back, a + b, len(parent)))
        return cls(out[::-1], first), child

    @classmethod
    def build(cls, grams: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
        return cls.grow(grams)[0]

    def climb(self, keys: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
        """Probability of each of the eight bits (rows) of each gram's byte, mixed from the deepest level up to `first`; nan where there is no
        node. `p`: the same from deeper levels. Each depth is looked up once for each of its grams, in order."""
        p = np.full((8, len(keys)), np.nan) if p is None else p.astype(np.float64)
        for depth in range(self.first + len(self.levels) - 1, self.first - 1, -1):
            k, a, b, weight = self.levels[depth - self.first]
            if not len(k) or not len(keys):
                continue
            own, back = np.unique(keys & U64((1 << (8 * (depth + 1))) - 1), return_inverse=True)
            byte = (own & U64(255)).astype(np.int64)
            for level in range(8):
                want = (own & ~U64(255)) | ((1 << level) | (byte >> (8 - level))).astype(U64)
                bit = ((byte >> (7 - level)) & 1).astype(bool)
                at = np.minimum(np.searchsorted(k, want), len(k) - 1)
                value = (np.where(bit, b[at], a[at]) + 0.5) / (a[at].astype(np.float64) + b[at] + 1.0)
                hit, value, w = (k[at] == want)[back], value[back], weight[at].astype(np.float64)[back]
                p[level] = np.where(hit, np.where(np.isnan(p[level]), value, w * value + (1 - w) * p[level]), p[level])
        return p

    def log2(self, keys: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each gram's byte in its context."""
        p = self.climb(keys, p)
        return np.log2(np.where(np.isnan(p), 0.5, p)).sum(0)


def squeezed(x: np.ndarray) -> bytes:
    """An array by planes of its bytes, compressed: neighbours in a sorted list share most of them."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True)


def widened(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def shipped(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _packed(kind: int, keys: np.ndarray, counts: np.ndarray, by: np.ndarray, many: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(kind, bucket, keys, counts) for each bucket, by the hash of `by`."""
    bucket = (textbuf.mix(by) % U64(many)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(many + 1))
    for m in np.flatnonzero(np.diff(ends)):
        at = order[ends[m] : ends[m + 1]]
        yield kind, int(m), keys[at].tobytes(), counts[at].tobytes()


def _context(keys: np.ndarray, depth: int) -> np.ndarray:
    """The nearest `depth` bytes of context."""
    return (keys >> U64(8)) & U64((1 << (8 * depth)) - 1)


def _dealt(keys: np.ndarray, depth: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted grams by bucket, and where each bucket ends in it. Within a bucket they stay sorted."""
    bucket = (textbuf.mix(_context(keys, min(SPLIT, depth))) % U64(many)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(many + 1))


def _rows(schema: pa.Schema, rows: list[dict], step: int = 64) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), step):
        yield pa.RecordBatch.from_pylist(rows[a : a + step], schema)


PASSED = "slice long, kind int, bucket int, keys binary, counts binary, texts binary"


def count(rows: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Rows of three kinds. 0: words of training texts (bucket, keys, counts). 1: grams of a slice (slice, bucket, keys, counts in training
    texts, squeezed). 2: some texts of a slice (slice, texts: a batch of doc_id, text, trained). `rows` has doc_id, text, trained."""
    if not 0 <= depth <= 6:
        raise ValueError("a gram has at most seven bytes")
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in PASSED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, words, grams, held, size = TaskContext.get().partitionId() << 32, [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if words:
                w = merged(*zip(*words))
                yield from _rows(schema, [{"kind": 0, "bucket": m, "keys": k, "counts": n} for _, m, k, n in _packed(0, *w, w[0], buckets)])
            k, n = merged(*zip(*grams))
            order, ends = _dealt(k, depth, buckets)
            own = ((int(m), order[ends[m] : ends[m + 1]]) for m in np.flatnonzero(np.diff(ends)))
            yield from _rows(schema, [{"kind": 1, "slice": piece, "bucket": m, "keys": squeezed(k[at]), "counts": squeezed(n[at].astype(np.uint32))} for m, at in own])

        for batch in batches:
            data, offsets = textbuf.buffer(batch.column(1))
            learnt = np.array(batch.column(2), dtype=bool)
            for i, j in textbuf.slices(offsets, STEP_BYTES):
                w, own = textbuf.Words(data, offsets, i, j, textbuf.SPACE), learnt[i:j]
                if own.any():
                    k, n = np.unique(w.hashes()[np.repeat(own, w.counts)], return_counts=True)
                    words.append(merged([k, np.array([END])], [n.astype(np.int64), np.array([own.sum()])]))
                keys, sizes = textbuf.grams(w.low, offsets[i : j + 1] - offsets[i], depth)
                k, n = np.unique((keys << U64(1)) | np.repeat(own, sizes).astype(U64), return_counts=True)
                grams.append(merged([k >> U64(1)], [np.where(k & U64(1), n, 0).astype(np.int64)]))
                yield from _rows(schema, [{"kind": 2, "slice": piece, "texts": shipped(batch.slice(i, j - i))}])
                held, size = held + len(grams[-1][0]) + (len(words[-1][0]) if words else 0), size + int(offsets[j] - offsets[i])
                if held > 5 * MOST_GRAMS // 4 or size > MOST_BYTES:
                    words, grams = [merged(*zip(*words))] if words else [], [merged(*zip(*grams))]
                    held = len(grams[0][0]) + (len(words[0][0]) if words else 0)
                    if held > MOST_GRAMS or size > MOST_BYTES:
                        yield from flush()
                        piece, words, grams, held, size = piece + 1, [], [], 0, 0
        if grams:
            yield from flush()

    return rows.select("doc_id", "text", "trained").mapInArrow(run, PASSED)


def _kept(levels: list[tuple[np.ndarray, np.ndarray]], least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(k[m], n[m]) for k, n, m in ((k, n, _seen(k, n) >= least) for k, n in levels)]


def _levels(keys: np.ndarray, counts: np.ndarray, first: int, last: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams with contexts of first..last bytes, from those of `last` bytes."""
    out = [(keys, counts)]
    for d in range(last - 1, first - 1, -1):
        out.append(shorter(*out[-1], d))
    return out[::-1]


GROWN = "bucket int, part int, keys binary, values binary, held binary, slices array<long>, places array<binary>, grams binary, counts binary"


def grow(counted: DataFrame, depth: int, least: int) -> DataFrame:
    """Rows of two kinds. A bucket's grams (part is null): keys, values (eight probabilities each, mixed from `depth` up to SPLIT), and for each of
    its slices the places of its grams among them. Sums for the levels above (part): keys, values, held of nodes; grams, counts."""
    split = min(SPLIT, depth)

    def run(table: pa.Table) -> pa.Table:
        asked = [widened(x, np.uint64) for x in table.column("keys").to_pylist()]
        keys, counts = merged(asked, [widened(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist()])
        bucket = table.column("bucket")[0].as_py()
        # A bucket's subtrees grow in several parts, one after the other, so that their nodes are not all in memory at once.
        piece = (textbuf.mix(_context(keys, split)) >> U64(32)) % U64(PIECES)
        p, up, low = np.empty((len(keys), 8), np.float32), [], []
        for at in (np.flatnonzero(piece == U64(i)) for i in range(PIECES)):
            own, seen = keys[at], counts[at] > 0
            levels = _levels(own[seen], counts[at][seen], split, depth)
            tree, sums = Tree.grow(_kept(levels, least), split)
            p[at] = tree.climb(own).T
            up.append(sums)
            low.append(shorter(*levels[0], split - 1) if split else levels[0])
        rows = [{"bucket": bucket, "keys": squeezed(keys), "values": squeezed(p.ravel()), "slices": table.column("slice").to_pylist(), "places": [squeezed(np.searchsorted(keys, x).astype(np.int32)) for x in asked]}]
        if split:
            (up, total, held), (k, n) = (map(np.concatenate, zip(*x)) for x in (up, low))
            for part in range(PARTS):
                a, b = (textbuf.mix(x >> U64(8)) % U64(PARTS) == part for x in (up, k))
                if b.any():
                    rows.append({"bucket": bucket, "part": part, "keys": up[a].tobytes(), "values": total[a].tobytes(), "held": held[a].tobytes(), "grams": k[b].tobytes(), "counts": n[b].tobytes()})
        kinds = {"int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
        return pa.Table.from_pylist(rows, pa.schema([(n, kinds[t]) for n, t in (x.split() for x in GROWN.split(", "))]))

    return counted.where("kind = 1").select("slice", "bucket", "keys", "counts").groupBy("bucket").applyInArrow(run, GROWN)


def top(grown: DataFrame, depth: int, least: int) -> Tree:
    """The levels above SPLIT, from what buckets passed up: summed on the cluster, at most 256 ** SPLIT grams."""
    split = min(SPLIT, depth)
    if not split:
        return Tree()

    def run(table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        up, total = merged(read("keys", U64), read("values", np.float64))
        held = merged(read("keys", U64), read("held", np.float64))[1]
        k, n = merged(read("grams", U64), read("counts", np.int64))
        return pa.table({c: pa.array([x.tobytes()], pa.binary()) for c, x in (("keys", up), ("values", total), ("held", held), ("grams", k), ("counts", n))})

    kind = {"keys": U64, "values": np.float64, "held": np.float64, "grams": U64, "counts": np.int64}
    found = grown.where("part is not null").select("part", *kind).groupBy("part").applyInArrow(run, ", ".join(f"{c} binary" for c in kind)).collect()
    x = {c: [np.frombuffer(r[c], t) for r in found] or [np.zeros(0, t)] for c, t in kind.items()}
    up, total = merged(x["keys"], x["values"])
    held = merged(x["keys"], x["held"])[1]
    return Tree.grow(_kept(_levels(*merged(x["grams"], x["counts"]), 0, split - 1), least), 0, (up, total, held))[0]


def finished(grown: DataFrame, tree) -> DataFrame:
    """slice, bucket, values: log2 probabilities of the grams that a slice has in a bucket, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("values", pa.binary())])
        for batch in batches:
            for i in range(len(batch)):
                bucket, keys, p, slices, places = (c[i].as_py() for c in batch.columns)
                value = tree.value.log2(widened(keys, np.uint64), widened(p, np.float32).reshape(-1, 8).T).astype(np.float32)
                yield from _rows(schema, [{"slice": s, "bucket": bucket, "values": squeezed(value[widened(at, np.int32)])} for s, at in zip(slices, places)])

    return grown.where("part is null").select("bucket", "keys", "values", "slices", "places").mapInArrow(run, "slice long, bucket int, values binary")


def score(docs: DataFrame, trains: Column, depth: int = 6, least: int = 2, bucket_mb: int = 16) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row; those where `trains` holds
    are learnt from. `least`: how often training texts must hold a context for it to have a node, whatever their size."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(trains, F.lit(False)).alias("trained"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).collect()[0][0]
    buckets = int(min(65536, max(16, -(-size // (bucket_mb << 20)))))
    counted = cut(count(rows, depth, buckets), "counts", by="kind")  # what nothing reads any more goes kind by kind
    grown = cut(grow(counted, depth, least), "grown")
    done_with(counted, "kind=1")
    tree = docs.sparkSession.sparkContext.broadcast(top(grown, depth, least))
    values = finished(grown, tree)

    # The word table stays on the cluster but for its bounded head.
    def totalled(table: pa.Table) -> pa.Table:
        k, n = merged([np.frombuffer(x, U64) for x in table.column("keys").to_pylist()], [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()), "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary())})

    words = cut(counted.where("kind = 0").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(totalled, "bucket int, n long, keys binary, counts binary"), "words")
    done_with(counted, "kind=0")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.octet_length("keys") / 8), F.lit(0)).cast("long").alias("v")).collect()[0]
    tokens, types = totals["n"], totals["v"]

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k, n = np.frombuffer(k, U64), np.frombuffer(n, np.int64)
                keep = n * HEAD >= tokens
                yield pa.RecordBatch.from_arrays([pa.array([k[keep].tobytes()], pa.binary()), pa.array([n[keep].tobytes()], pa.binary())], names=["keys", "counts"])

    head = words.select("keys", "counts").mapInArrow(frequent, "keys binary, counts binary").collect()
    hk, hn = merged([np.frombuffer(r["keys"], U64) for r in head] or [np.zeros(0, U64)], [np.frombuffer(r["counts"], np.int64) for r in head] or [np.zeros(0, np.int64)])
    bottom = math.log10(tokens + types + 1)
    model = docs.sparkSession.sparkContext.broadcast((hk, np.log10(hn + 1.0) - bottom))
    scored = cut(_scored(counted.where("kind = 2").select("slice", "texts"), values, model, depth, buckets), "scored")
    done_with(counted, "kind=2")
    done_with(grown)

    def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, counts = (np.frombuffer(right.column(c)[0].as_py(), t) if len(right) else np.zeros(0, t) for c, t in (("keys", U64), ("counts", np.int64)))
        out = []
        for piece, hashes, places in zip(*(left.column(c).to_pylist() for c in ("slice", "hashes", "places"))):
            h, p = np.frombuffer(hashes, U64), np.frombuffer(places, np.int32)
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            c = np.where(keys[at] == h, counts[at], 0) if len(keys) else np.zeros(len(h), np.int64)
            own, back = np.unique(p, return_inverse=True)
            out.append((piece, own.tobytes(), np.bincount(back, np.log10(c + 1.0) - bottom).tobytes(), np.bincount(back, c > 0).tobytes()))
        bucket = left.column("bucket")[0].as_py() if len(left) else 0
        return pa.table({"slice": pa.array([x[0] for x in out], pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int32()), **{n: pa.array([x[k] for x in out], pa.binary()) for k, n in ((1, "places"), (2, "sums"), (3, "known"))}})

    tail = scored.where("bucket is not null").select("slice", "bucket", "hashes", "places")
    parts = tail.groupBy("bucket").cogroup(words.select("bucket", "keys", "counts").groupBy("bucket")).applyInArrow(looked_up, "slice long, bucket int, places binary, sums binary, known binary")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return left.select(["doc_id", "trained", "n_tokens", "n_known", "base_score", "score", "bytes"])
        place, base, known = (np.array(left.column(c), dtype=t) for c, t in (("place", np.int64), ("base_score", np.float64), ("n_known", np.int64)))
        more, some = np.zeros(place.max() + 1), np.zeros(place.max() + 1)
        for _, p, s, k in sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "places", "sums", "known")))):
            p = np.frombuffer(p, np.int32)
            more[p] += np.frombuffer(s, np.float64)
            some[p] += np.frombuffer(k, np.float64)
        return pa.table({"doc_id": left.column("doc_id"), "trained": left.column("trained"), "n_tokens": left.column("n_tokens"), "n_known": pa.array(known + some[place].astype(np.int64)), "base_score": pa.array(base + more[place]), "score": left.column("score"), "bytes": left.column("bytes")})

    mains = scored.where("bucket is null").select("slice", "place", "doc_id", "trained", "n_tokens", "n_known", "base_score", "score", "bytes")
    done = mains.groupBy("slice").cogroup(parts.groupBy("slice")).applyInArrow(summed, "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double, bytes long")
    return done.select("doc_id", "trained", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / LOG2 / (F.col("bytes") + 1)).alias("bits_per_byte"))


def _seen(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each sorted gram's context was seen."""
    context = keys >> U64(8)
    at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return np.repeat(np.add.reduceat(counts, at), np.diff(np.append(at, len(keys)))) if len(at) else counts


def _scored(texts: DataFrame, values: DataFrame, model, depth: int, buckets: int) -> DataFrame:
    """Rows of two kinds. A text: slice, place (its number there), doc_id, trained, n_tokens, and of the frequent words n_known and
    base_score; score, bytes. Rare words of a slice in one bucket: slice, bucket, hashes, places (the texts they are in)."""
    schema = "slice long, place int, doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double, bytes long, bucket int, hashes binary, places binary"
    kinds = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return kinds.empty_table()
        hk, hv = model.value
        piece, out, first, hashes, places = left.column("slice")[0].as_py(), [], 0, [], []
        batches = left.column("texts").to_pylist()
        read = lambda x: pa.ipc.open_stream(x).read_all().combine_chunks()
        every = []
        for batch in batches:
            data, offsets = textbuf.buffer(read(batch).column("text"))
            every.append(textbuf.distinct(textbuf.grams(textbuf.LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0], depth)[0]))
        every = textbuf.distinct(np.concatenate(every))
        order, _ = _dealt(every, depth, buckets)
        logs = np.zeros(len(every))
        logs[order] = np.concatenate([widened(x, np.float32) for _, x in sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "values"))))])
        del right, order
        for batch in batches:
            texts = read(batch)
            data, offsets = textbuf.buffer(texts.column("text"))
            n = len(texts)
            w = textbuf.Words(data, offsets, 0, n, textbuf.SPACE)
            keys, sizes = textbuf.grams(w.low, offsets - offsets[0], depth)
            own, back = np.unique(keys, return_inverse=True)
            total = np.add.reduceat(logs[np.searchsorted(every, own)][back], np.concatenate([[0], np.cumsum(sizes)[:-1]])) * LOG2
            h, place = np.append(w.hashes(), np.full(n, END)), np.append(np.repeat(np.arange(n), w.counts), np.arange(n))
            own, back = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(hk, own), max(0, len(hk) - 1))
            known = (hk[at] == own) if len(hk) else np.zeros(len(own), bool)
            value = np.where(known, hv[at], 0.0) if len(hk) else np.zeros(len(own))
            base, some = np.bincount(place, value[back], n), np.bincount(place, known[back], n).astype(np.int64)
            held = {"slice": np.full(n, piece), "place": np.arange(first, first + n, dtype=np.int32), "n_tokens": w.counts + 1, "n_known": some, "base_score": base, "score": total, "bytes": sizes - 1}
            held = {k: pa.array(v, kinds.field(k).type) for k, v in held.items()} | {c: texts.column(c).combine_chunks() for c in ("doc_id", "trained")}
            out.append(pa.Table.from_arrays([held.get(f.name, pa.nulls(n, f.type)) for f in kinds], schema=kinds))
            rare = np.flatnonzero(~known[back])
            hashes.append(h[rare])
            places.append((place[rare] + first).astype(np.int32))
            first += n
        h = np.concatenate(hashes)
        rare = [*_packed(0, h, np.concatenate(places), h, buckets)]
        held = {"slice": pa.array(np.full(len(rare), piece)), "bucket": pa.array([r[1] for r in rare], pa.int32()), "hashes": pa.array([r[2] for r in rare], pa.binary()), "places": pa.array([r[3] for r in rare], pa.binary())}
        out.append(pa.Table.from_arrays([held.get(f.name, pa.nulls(len(rare), f.type)) for f in kinds], schema=kinds))
        return pa.concat_tables(out)

    return texts.groupBy("slice").cogroup(values.groupBy("slice")).applyInArrow(run, schema)
