"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and digits that stand for letters, closes up spelled-out words (i.d.i.o.t) and
squeezes long runs of one letter. The lexicon holds whole words and word beginnings; weights are log-odds
of word rates, learnt from at most `max_toxic` + `max_clean` labelled rows (those with the smallest hash of their id),
in which near copies count once. Words inside an exception phrase don't count. A text's density is its sum of
weights / (1 + ln(1 + words / 200)): it grows with each hit and falls with length. The score is d / (d + half * 7/3),
in 0..1, where `half` is the density that tells the sample's labels apart best; it scores 0.3.

Words of fewer than 3 or more than 40 letters never enter a lexicon; a text in a script without spaces is matched by word beginnings.
Null and empty texts score 0. Rows are scored one by one from their text alone: repeated rows stay and score alike, other columns are
not looked at. Ties between terms don't matter: all that pass the floors enter. Without labels the lexicon is empty and all score 0."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .common import cut

# Letters that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ѐ": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
# Harmless phrases around words that may be in a lexicon.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "take out the trash", "clown fish", "class clown", "pond scum", "not an idiot", "idiot proof", "sore loser")

#: Lengths of word beginnings that may enter a lexicon.
BEGINNINGS = (3, 4, 5, 6, 7, 8)

_MAP = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}
_SIGN = re.compile(r"(?<=[^\W\d_])[@$!]+(?=[^\W\d_])")
_SPELT = re.compile(r"(?<!\w)\w(?:[.\-_*]\w){2,}(?!\w)")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> list[str]:
    """Folded words."""
    text = text.lower().translate(_MAP)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    text = _SPELT.sub(lambda m: re.sub(r"[.\-_*]", "", m[0]), text)
    return _WORD.findall(_RUN.sub(r"\1", text))


@dataclass(frozen=True)
class Lexicon:
    """Entries: (word or beginning, whether it is a beginning, weight)."""

    entries: tuple[tuple[str, bool, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    half: float = 2.0

    def automaton(self) -> ahocorasick.Automaton:
        out, seen = ahocorasick.Automaton(), {}
        for word, begins, weight in self.entries:
            key = f" {word}" if begins else f" {word} "
            seen[key] = max(weight, seen.get(key, 0.0))
        for phrase in self.exceptions:
            seen[f" {' '.join(fold(phrase))} "] = -1.0  # a span whose words don't count
        for key, weight in seen.items():
            out.add_word(key, (len(key), weight))
        if seen:
            out.make_automaton()
        return out


def density(words: list[str], automaton: ahocorasick.Automaton) -> float:
    if not words or not len(automaton):
        return 0.0
    text, hits, excused = f" {' '.join(words)} ", {}, []
    for end, (size, weight) in automaton.iter(text):
        at = end - size + 1
        if weight < 0:
            excused.append((at, end))
        else:
            hits[at] = max(weight, hits.get(at, 0.0))
    if excused:
        excused.sort()
        starts, ends = [a for a, _ in excused], list(accumulate((b for _, b in excused), max))
        inside = lambda at: (i := bisect_right(starts, at)) > 0 and at < ends[i - 1]
        hits = {at: w for at, w in hits.items() if not inside(at)}
    # Added up in the order of places, so that equal texts score alike to the last bit.
    total = sum(hits[at] for at in sorted(hits))
    return total / (1.0 + math.log1p(len(words) / 200.0))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 6000, max_clean: int = 12000, least_share: float = 0.01, least_odds: float = 2.0) -> Lexicon:
    """`labels` has doc_id and toxic (0/1; rows with null are left out); a document labelled both ways counts as toxic. A term enters if it stands
    in `least_share` of the toxic rows at least, so there are at most (mean distinct terms of a toxic row) / `least_share`; no other cap."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = rows.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(rows.where("toxic = 0").orderBy(*order).limit(max_clean))
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").where("text is not null")
    sample = texts.join(F.broadcast(chosen), "doc_id")  # at most max_toxic + max_clean ids

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textbuf.buffer(batch.column(1))
            sketch = np.zeros(len(batch), np.int64)
            for i, j in textbuf.slices(offsets):
                words = textbuf.Words(data, offsets, i, j, textbuf.SPACE)
                h = words.hashes()
                joint = textbuf.mix(h + np.roll(h, -1) * textbuf.U64(3) + np.roll(h, -2) * textbuf.U64(5))
                for k in range(j - i):
                    own = joint[words.first[k] : max(words.first[k] + 1, words.first[k + 1] - 2)]
                    sketch[i + k] = own.min().view(np.int64) if words.counts[k] else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketch)], names=["doc_id", "text", "toxic", "sketch"])

    sample = cut(sample.select("doc_id", "text", "toxic").mapInArrow(sketched, "doc_id long, text string, toxic int, sketch long"), "toxic-sample")
    once = sample.groupBy("sketch").agg(F.min_by(F.struct("doc_id", "toxic"), F.struct(-F.col("toxic"), "doc_id")).alias("own")).select("own.*")
    sizes = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, uses = (Counter(), Counter()), (Counter(), Counter())
            for text, label in zip(textbuf.strings(batch.column(1)), batch.column(2).to_pylist()):
                every = fold(text)
                terms = Counter({"": len(every)})  # the empty term counts words
                for w, n in Counter(w for w in every if 3 <= len(w) <= 40).items():
                    terms[f"{w} "] += n
                    for size in BEGINNINGS:
                        if len(w) > size:
                            terms[w[:size]] += n
                found[label].update(terms.keys())
                uses[label].update(terms)
            for label in (0, 1):
                names = list(found[label])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([label] * len(names), pa.int32()), pa.array([found[label][x] for x in names], pa.int64()), pa.array([uses[label][x] for x in names], pa.int64())], names=["term", "label", "n", "uses"])

    own = sample.join(F.broadcast(once.select("doc_id")), "doc_id").select("doc_id", "text", "toxic")
    of = lambda label, what: F.sum(F.when(F.col("label") == label, F.col(what)).otherwise(0)).cast("double")
    terms = cut(own.mapInArrow(counted, "term string, label int, n long, uses long").groupBy("term").agg(of(1, "n").alias("t"), of(0, "n").alias("c"), of(1, "uses").alias("tu"), of(0, "uses").alias("cu")).where("t >= 2"), "toxic-terms")
    words = {r["term"]: r for r in terms.where("term = ''").collect()}.get("")
    if words is None or not toxic:
        return Lexicon(())
    rate = F.log((F.col("tu") + 0.5) / (words["tu"] + 1)) - F.log((F.col("cu") + 0.5) / (words["cu"] + 1))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    kept = terms.where("term <> ''").select("term", "t", "tu", rate.alias("rate"), odds.alias("odds"))
    # A word of few documents must also stand in them more than once: a rare harmless word seldom does.
    kept = kept.where((F.col("t") >= math.ceil(least_share * toxic)) & (F.col("tu") >= max(5, 1.5 * least_share * toxic)) & (F.col("rate") >= 2 * least_odds) & (F.col("odds") >= least_odds))
    kept = kept.collect()
    lexicon = Lexicon(tuple(sorted((r["term"].rstrip(" "), not r["term"].endswith(" "), float(min(r["rate"], 1.5 * r["odds"]))) for r in kept)))
    return replace(lexicon, half=_calibrated(own, lexicon))


def _calibrated(sample: DataFrame, lexicon: Lexicon) -> float:
    """The density that tells the sample's labels apart best, a clean row lost counting three times (the middle of equals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([density(fold(t), automaton) for t in textbuf.strings(batch.column(1))], pa.float64())], names=["toxic", "density"])

    pairs = sample.mapInArrow(run, "toxic int, density double").collect()
    d, y = np.array([p["density"] for p in pairs]), np.array([p["toxic"] for p in pairs], bool)
    if not y.any() or y.all():
        return lexicon.half
    edges = np.unique(np.concatenate([[0.0], d]))
    tops = np.searchsorted(np.sort(d[y]), edges, "right") / y.sum() + 3 * (1 - np.searchsorted(np.sort(d[~y]), edges, "right") / (~y).sum())
    best = int(np.argmin(tops))  # what lies above edges[best] is toxic
    return float((edges[best] + edges[min(best + 1, len(edges) - 1)]) / 2) or lexicon.half


def _scored(texts: pa.Array, automaton: ahocorasick.Automaton, half: float) -> np.ndarray:
    d = np.array([density(fold(t), automaton) if t else 0.0 for t in textbuf.strings(texts)], np.float64)
    return d / (d + half * 7 / 3)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 at the threshold and above)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            scores = _scored(batch.column(1), automaton, lexicon.half)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores below the threshold. Only the text goes to Python."""

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = lexicon.automaton()
        for texts in batches:
            yield pa.array(_scored(texts, automaton, lexicon.half) < threshold)

    return docs.where(clean(F.col("text").cast("string")))
