"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's maximum over a window
goes through ReLU into a softmax over languages. The network is trained in numpy (Adam). It starts with a few rows on the driver: at most
`per_lang` documents of each of the `most_langs` most frequent languages (those with the smallest hash of id and text), one slice of at
most `slice_chars` characters from each. Then it learns from every window of every row in these languages, in shards on the cluster whose
parameters are averaged. Prediction cuts every whole text into windows of `WINDOW` bytes, runs them in batches, and takes
the language with the highest mean log-probability over a text's windows.

Texts that are null or hold no letter are `und` with score 0. Rows are independent; repeated rows stay."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbuf
from .common import cut

WINDOW, BATCH = 128, 128
WIDTHS = (2, 3, 4)
#: A letter is a character of the Unicode category L: no digit, fraction, superscript or circled number.
LETTER = r"\p{L}"
_LETTER = regex.compile(LETTER)


@dataclass(frozen=True)
class Network:
    langs: tuple[str, ...]
    embed: np.ndarray  # 256 x d
    filters: tuple[np.ndarray, ...]  # (w*d) x f each
    biases: tuple[np.ndarray, ...]
    out: np.ndarray
    out_bias: np.ndarray

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Pooled features of windows (n x WINDOW bytes), and what backpropagation needs."""
        e = self.embed[x]
        n, length, d = e.shape
        pooled, kept = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            cols = np.lib.stride_tricks.as_strided(e, (n, length - w + 1, w * d), e.strides)
            act = cols.reshape(-1, w * d) @ f
            act = act.reshape(n, length - w + 1, -1)
            top = act.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(act, top[:, None], 1)[:, 0] + b, 0))
            kept.append((cols, top))
        return np.concatenate(pooled, 1), kept

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.biases, self.out, self.out_bias]

    def copy(self) -> Network:
        return Network(self.langs, self.embed.copy(), tuple(f.copy() for f in self.filters), tuple(b.copy() for b in self.biases), self.out.copy(), self.out_bias.copy())

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden(x)[0] @ self.out + self.out_bias
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts i..j (the last of each is filled up with zeros), and the text of each."""
    sizes = np.diff(offsets[i : j + 1])
    many = -(-sizes // WINDOW)
    of = np.repeat(np.arange(j - i), many)
    out = np.zeros(int(many.sum()) * WINDOW, np.uint8)
    begin = np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64) * WINDOW
    out[np.repeat(begin - (offsets[i:j] - offsets[i]), sizes) + np.arange(int(sizes.sum()))] = data[offsets[i] : offsets[j]]
    return out.reshape(-1, WINDOW), of


class Learner:
    """Adam on one network's parameters, in place. `share` weighs languages, so that frequent ones don't drown others."""

    def __init__(self, net: Network, share: np.ndarray, rate: float, decay: float = 0.0):
        self.net, self.share, self.rate, self.decay, self.step = net, share.astype(np.float32), rate, decay, 0
        self.first, self.second = ([np.zeros_like(p) for p in net.params()] for _ in range(2))

    def learn(self, xb: np.ndarray, yb: np.ndarray) -> None:
        net, filters = self.net, self.net.filters[0].shape[1]
        h, kept = net.hidden(xb)
        z = h @ net.out + net.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(yb)), yb] -= 1
        p *= self.share[yb][:, None] / len(yb)
        gh = (p @ net.out.T) * (h > 0)
        ge = np.zeros_like(net.embed)
        gf, gb, n = [], [], np.arange(len(yb))
        for k, (cols, top) in enumerate(kept):
            g = gh[:, k * filters : (k + 1) * filters]
            picked = cols[n[:, None], top]  # n x filters x (w*d)
            gf.append((picked * g[:, :, None]).sum(0).T)
            gb.append(g.sum(0))
            dims = net.embed.shape[1]
            back = (g[:, :, None] * net.filters[k].T[None]).reshape(len(yb), filters, WIDTHS[k], dims)
            at = xb[n[:, None, None], top[:, :, None] + np.arange(WIDTHS[k])]
            place = at.astype(np.int64).ravel()[:, None] * dims + np.arange(dims)
            ge += np.bincount(place.ravel(), back.ravel(), ge.size).reshape(ge.shape).astype(np.float32)
        self.step += 1
        rate = self.rate / (1 + self.decay * self.step) ** 0.5
        for q, g, m, v in zip(net.params(), [ge, *gf, *gb, h.T @ p, p.sum(0)], self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= (rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)


def balance(sizes: np.ndarray) -> np.ndarray:
    """Weights of languages with so many windows each; one on average."""
    share = 1 / np.maximum(sizes, 1)
    return share / max(share.sum(), 1e-9) * len(share)


def train(texts: list[bytes], labels: list[str], dims: int = 8, filters: int = 16, epochs: int = 4, batch: int = BATCH, rate: float = 0.01, seed: int = 7) -> Network:
    langs = tuple(sorted(set(labels)))
    rng = np.random.default_rng(seed)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x, of = windows(np.frombuffer(b"".join(texts), np.uint8), offsets, 0, len(texts))
    y = np.array([langs.index(v) for v in labels], np.int64)[of] if len(of) else np.zeros(0, np.int64)
    f32 = np.float32
    net = Network(
        langs, rng.normal(0, 0.5, (256, dims)).astype(f32), tuple(rng.normal(0, (2 / (w * dims)) ** 0.5, (w * dims, filters)).astype(f32) for w in WIDTHS),
        tuple(np.zeros(filters, f32) for _ in WIDTHS), rng.normal(0, 0.1, (filters * len(WIDTHS), len(langs))).astype(f32), np.zeros(len(langs), f32),
    )
    learner = Learner(net, balance(np.bincount(y, minlength=len(langs))), rate)
    for _ in range(epochs if len(langs) > 1 else 0):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            learner.learn(x[order[a : a + batch]], y[order[a : a + batch]])
    return net


def learn_all(rows: DataFrame, net: Network, sizes: dict[str, int], shard_windows: int = 1 << 18, rate: float = 0.002) -> Network:
    """`net` after a pass over every window of `rows` (lang, text, h). Rows are dealt by their hash `h` to shards of about `shard_windows` windows, so
    each holds all languages however the table is ordered; each shard learns from its rows, in the order of h, starting with `net`, and
    the shards' parameters are averaged by their windows. `sizes`: windows of each language in all rows."""
    place, share = {lang: i for i, lang in enumerate(net.langs)}, balance(np.array([sizes[lang] for lang in net.langs]))
    shards = min(4096, -(-sum(sizes[lang] for lang in net.langs) // shard_windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, rng, many = Learner(net.copy(), share, rate, 0.01), np.random.default_rng(11), 0
        for batch in batches:
            data, offsets = textbuf.buffer(batch.column(1))
            own = np.array([place[lang] for lang in batch.column(0).to_pylist()], np.int64)
            for i, j in textbuf.slices(offsets, 1 << 18):
                for x, of in parts_of(data, offsets, i, j):
                    order = rng.permutation(len(x))
                    for a in range(0, len(x), BATCH):
                        learner.learn(x[order[a : a + BATCH]], own[i:j][of[order[a : a + BATCH]]])
                    many += len(x)
        if many:
            packed = np.concatenate([p.ravel() for p in learner.net.params()])
            yield pa.RecordBatch.from_arrays([pa.array([many]), pa.array([packed.tobytes()], pa.binary())], names=["n", "params"])

    dealt = rows.where(F.col("lang").isin(*net.langs)).select("lang", "text", "h").repartition(int(shards), "h").sortWithinPartitions("h", "lang", "text")
    found = dealt.select("lang", "text").mapInArrow(run, "n long, params binary").collect()
    total = sum(r["n"] for r in found)
    mean = sum(np.frombuffer(r["params"], np.float32).astype(np.float64) * (r["n"] / total) for r in found)
    out, at = net.copy(), 0
    for p in out.params():
        p[...] = mean[at : at + p.size].reshape(p.shape)
        at += p.size
    return out


def parts_of(data: np.ndarray, offsets: np.ndarray, i: int, j: int, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows of texts i..j, at most `most` at a time."""
    x, of = windows(data, offsets, i, j)
    for a in range(0, len(x), most):
        yield x[a : a + most], of[a : a + most]


def fit(docs: DataFrame, per_lang: int = 400, slice_chars: int = 1024, most_langs: int = 256) -> Network:
    """Learns from all rows with a text and a language (`und` is no language to learn): a pass over all their windows (learn_all), which starts with
    a network that is trained on a few of them. Of the few, repeated rows count once. Their ids are chosen before any text is
    cut, from among those whose hash lies below a bound that about 4 x `per_lang` rows of the language pass: no task ranks a whole language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != "und") & F.col("text").rlike(LETTER))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.ceil(F.octet_length("text") / WINDOW)).alias("windows")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    many = docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in sizes], "lang string, n long")
    below = F.lit(float(2**64)) * F.least(F.lit(1.0), 4.0 * per_lang / F.col("n")) - F.lit(float(2**63))
    near = rows.select("lang", "h").join(F.broadcast(many), "lang").where(F.col("h") <= below).select("lang", "h").distinct()
    order = Window.partitionBy("lang").orderBy("h")
    chosen = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)  # at most per_lang x most_langs rows
    at = F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.greatest(F.length("text") - slice_chars, F.lit(0)) + 1)
    found = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "rank", F.substring("text", at.cast("int") + 1, F.lit(slice_chars)).alias("text"))
    sample = found.groupBy("lang", "rank").agg(F.min("text").alias("text")).orderBy("lang", "rank").collect()
    net = train([r["text"].encode() for r in sample], [r["lang"] for r in sample])
    return learn_all(rows, net, {r["lang"]: r["windows"] for r in sizes}) if net and len(net.langs) > 1 else net


def _lettered(texts: pa.Array) -> np.ndarray:
    return np.array([bool(t) and _LETTER.search(t) is not None for t in textbuf.strings(texts)], bool)


def _predicted(texts: pa.Array, net: Network) -> tuple[list[str], np.ndarray]:
    letters = _lettered(texts)
    data, offsets = textbuf.buffer(texts)
    best, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    if net.langs:
        for i, j in textbuf.slices(offsets):
            x, of = windows(data, offsets, i, j)
            total = np.zeros((j - i, len(net.langs)))
            for a in range(0, len(x), 512):
                lp = net.log_probs(x[a : a + 512]).astype(np.float64)
                for c in range(len(net.langs)):
                    total[:, c] += np.bincount(of[a : a + 512], weights=lp[:, c], minlength=j - i)
            total /= np.maximum(np.bincount(of, minlength=j - i), 1)[:, None]
            p = np.exp(total - total.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best[i:j] = np.where(letters[i:j], np.array(net.langs, object)[p.argmax(1)], "und")
            score[i:j] = np.where(letters[i:j], p.max(1), 0.0)
    return best.tolist(), score


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred, score (the mean window's share of that language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = _predicted(batch.column(1), net)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def floor(held_out: DataFrame, net: Network, share: float = 0.001) -> float:
    """The score that all but `share` of the held-out rows reach whose language the network finds; 0 if there are none. Every such row is scored,
    and the rank is exact."""
    rows = held_out.where(F.col("lang").isin(*net.langs)) if net.langs else held_out.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = _predicted(batch.column(0), net)
            right = [s for b, s, lang in zip(best, score, batch.column(1).to_pylist()) if b == lang]
            yield pa.RecordBatch.from_arrays([pa.array(right, pa.float64())], names=["score"])

    found = cut(rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, "score double"), "floor")
    rank = max(1, math.ceil(share * found.count()))
    return found.orderBy("score").limit(rank).agg(F.max("score")).collect()[0][0] or 0.0


def keep_known(docs: DataFrame, net: Network, least: float = 0.0) -> DataFrame:
    """The rows of `docs`, with all their columns, in a language the network knows, by at least that score. A network that has learnt no
    language rejects only texts without letters. Only the text goes to Python."""

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            if net.langs:
                best, score = _predicted(texts, net)
                yield pa.array([b != "und" and s >= least for b, s in zip(best, score)], pa.bool_())
            else:
                yield pa.array(_lettered(texts))

    return docs.where(known(F.col("text").cast("string")))
