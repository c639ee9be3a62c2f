"""SentencePiece encoding and decoding as a weighted finite-state transducer.

`Transducer` compiles a model file into machines and composes them with each input:

* the normaliser: rewriting by the model's character map (longest match first), squeezing of white space, the dummy prefix, space to U+2581;
* the pieces, from strings to ids. In a unigram model an arc weighs -score. In a BPE model the summed scores do not rank paths
  as merging does, so pieces are composed with the merge acceptor: piece b may follow piece a exactly if merging the text "ab" ends
  in [a, b]; an arc that may follow weighs 0, another one is not there;
* fallback arcs: a character that is no piece leaves by its UTF-8 bytes' pieces or, in a model without them, as unknown (a run of
  unknown characters is one token); in a unigram model it weighs 10 more than the worst piece.

User-defined symbols are cut out first of a text for a BPE model, longest first, and are never joined with what stands around them; in a
unigram model their arcs weigh next to nothing.

The ids are those of the shortest path in the tropical semiring, found by relaxing arcs from left to right. Merges inside two
neighbours happen in the same order whatever stands around them, so a path all of whose neighbours are accepted is the
result of merging the whole text up to its end: a position has one state in either kind of model, which remembers its last arc. Among
paths of equal weight the one whose last arc is longest is taken, at every position.

No arc spans two characters that are never neighbours inside a piece. Such places are articulation points
of every lattice: the path is the concatenation of the paths between them, which are memoised in a cache of
bounded size. Cost and memory follow the text; one very long text needs memory in proportion to itself."""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbuf

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITE = float("inf")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 1:
            value, i = raw[i : i + 8], i + 8
        elif kind == 2:
            n = varint()
            value, i = raw[i : i + n], i + n
        else:
            value, i = struct.unpack("<f", raw[i : i + 4])[0], i + 4
        yield tag >> 3, value


class _Paths(dict):
    """Segment to ids, in two generations, so that at most 2 x `size` paths are held."""

    def __init__(self, solve, size: int):
        super().__init__()
        self.solve, self.size, self.old = solve, size, {}

    def __missing__(self, segment: str):
        path = self.old.get(segment)
        if path is None:
            path = self.solve(segment)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if len(segment) <= 64:
            self[segment] = path
        return path


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a precompiled character map: a double-array trie over bytes, then the replacements, each ended by a zero byte."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], np.uint32).astype(np.int64), blob[4 + size :]
    # Of a unit: its label and the sign bit, the distance to its children, whether a value hangs there.
    labels, jumps, ends = units & 0x800000FF, (units >> 10) << ((units & 512) >> 6), (units >> 8) & 1
    rules, todo, every = {}, [(int(jumps[0]), b"")], np.arange(1, 256)
    while todo:
        at, key = todo.pop()
        children = at ^ every
        inside = children < len(units)
        for byte in every[inside][labels[children[inside]] == every[inside]]:
            child, word = at ^ int(byte), key + bytes([byte])
            below = child ^ int(jumps[child])
            if ends[child]:
                begin = int(units[below]) & 0x7FFFFFFF
                rules[word.decode()] = texts[begin : texts.index(0, begin)].decode()
            todo.append((below, word))
    return rules


class Normaliser:
    """Text to the text that pieces are matched against."""

    def __init__(self, rules: dict[str, str], kept: list[str], prefix: bool, squeeze: bool, escape: bool):
        self.rules, self.prefix, self.squeeze, self.space = rules, prefix, squeeze, SPACE if escape else " "
        first: dict[str, set[int]] = {}
        for word in [*rules, *kept]:
            first.setdefault(word[0], set()).add(len(word))
        self.sizes = {c: sorted(n, reverse=True) for c, n in first.items()}
        self.kept = set(kept)
        self.touched = re.compile("[" + "".join(map(re.escape, sorted(first))) + "]") if rules else None

    def _rewritten(self, text: str) -> str:
        out, at = [], 0
        while (found := self.touched.search(text, at)) is not None:
            begin = found.start()
            out.append(text[at:begin])
            for size in self.sizes[text[begin]]:
                word = text[begin : begin + size]
                if word in self.kept or word in self.rules:
                    break
            else:
                size, word = 1, text[begin]
            out.append(word if word in self.kept else self.rules.get(word, word))
            at = begin + size
        return "".join([*out, text[at:]])

    def __call__(self, text: str) -> str:
        if self.touched is not None:
            text = self._rewritten(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).lstrip(" ").rstrip(" " + self.space)
        return ((" " if self.prefix else "") + text).replace(" ", self.space) if text else ""


class Transducer:
    def __init__(self, model: bytes, cache: int = 200_000):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        kind, suffix, spec = UNIGRAM, 0, {}
        for number, value in _fields(model):
            if number == 1:
                one = dict(_fields(value))
                self.pieces.append(one.get(1, b"").decode())
                self.scores.append(one.get(2, 0.0))
                kinds.append(one.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                kind, suffix = trainer.get(3, UNIGRAM), trainer.get(24, 0)
            elif number == 3:
                spec = dict(_fields(value))
        if kind not in (UNIGRAM, BPE) or suffix or UNUSED in kinds:
            raise ValueError("only unigram and BPE models are supported, without unused pieces and with white space before words")
        self.merging, self.prefix, self.squeeze = kind == BPE, bool(spec.get(3, 1)), bool(spec.get(4, 1))
        own = sorted((p for p, k in zip(self.pieces, kinds) if k == USER), key=len, reverse=True)
        self.normal = Normaliser(character_map(spec.get(2, b"")), own, self.prefix, self.squeeze, bool(spec.get(5, 1)))
        self.user = re.compile("(" + "|".join(map(re.escape, own)) + ")") if own and self.merging else None
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL or (k == USER and not self.merging)}
        self.user_ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == USER}
        self.unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        by_byte = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.bytes = [by_byte[b] for b in range(256)] if len(by_byte) == 256 else None
        self.byte_of = {i: b for b, i in by_byte.items()}
        self.surface = [("" if kinds[i] == CONTROL else " ⁇ " if kinds[i] == UNKNOWN else p.replace(SPACE, " ")) for i, p in enumerate(self.pieces)]
        self.spaced = {i for i, p in enumerate(self.pieces) if p.startswith(SPACE) and kinds[i] in (NORMAL, USER)}
        self.longest: dict[str, int] = {}  # of the pieces that begin with two characters
        for p in self.ids:
            self.longest[p[:2]] = max(len(p), self.longest.get(p[:2], 1))
        plain = [self.scores[i] for p, i in self.ids.items() if kinds[i] == NORMAL] or [0.0]
        weight = lambda p, i: -self.scores[i] if kinds[i] == NORMAL else 0.1 - max(0.0, *plain) * len(p.encode())
        self.weights = {p: 0.0 if self.merging else weight(p, i) for p, i in self.ids.items()}
        self.fallback = 0.0 if self.merging else 10.0 - min(plain)
        neighbours = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        letters = sorted({c for pair in neighbours for c in pair})
        self.letter = np.zeros(0x110000, np.int16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.bridge = np.zeros((len(letters) + 1,) * 2, bool)
        for a, b in neighbours:
            self.bridge[self.letter[ord(a)], self.letter[ord(b)]] = True
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.times: dict[str, float] = {}
        self.paths = _Paths(self._shortest_path, cache)

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose joining forms the piece; None if merging its text does not end in it."""
        if piece not in self.splits:
            parts, halves = list(piece), None
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    found = self.ids.get(parts[i] + parts[i + 1])
                    if found is not None and (best is None or self.scores[found] > best):
                        best, at = self.scores[found], i
                if best is None:
                    break
                halves = (parts[at], parts[at + 1])
                parts[at : at + 2] = ["".join(halves)]
            self.splits[piece] = halves if len(parts) == 1 else None
        return self.splits[piece]

    def _accepted(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a ('' at the start) in the merge acceptor: undoing the merges of both,
        latest first, the two parts that then touch must never be due to join before the merge just undone."""
        if (len(b) > 1 and self._split(b) is None) or (len(a) > 1 and self._split(a) is None):
            return False
        if not a:
            return True
        ids, scores, when = self.ids, self.scores, self._when
        time_a, time_b = when(a), when(b)
        limit, first = INFINITE, False  # a joint merge of equal rank comes first only against one to its right
        while True:
            joint = ids.get(a + b)
            if joint is not None and (-scores[joint] < limit or (first and -scores[joint] == limit)):
                return False
            if time_a > time_b:
                limit, first, a = time_a, False, self._split(a)[1]
                time_a = when(a)
            elif time_b > -INFINITE:
                limit, first, b = time_b, True, self._split(b)[0]
                time_b = when(b)
            else:
                return True

    def _when(self, piece: str) -> float:
        """The rank of the last merge that has to be due before the piece is whole."""
        if len(piece) == 1:
            return -INFINITE
        if piece not in self.times:
            left, right = self._split(piece)
            self.times[piece] = max(-self.scores[self.ids[piece]], self._when(left), self._when(right))
        return self.times[piece]

    def _emit(self, pieces: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for p in pieces:
            found = self.ids.get(p)
            if found is not None:
                out.append(found)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return tuple(out)

    def _shortest_path(self, text: str) -> tuple[int, ...]:
        """Where arcs weigh something (unigram) positions are settled from left to right; where all weigh 0 (BPE) in the order of a stack, which
        is as good a queue then, until the end is settled."""
        size, weights, fallback, longest = len(text), self.weights, self.fallback, self.longest
        last = [""] * (size + 1)
        if self.merging:
            if text in weights and self._accepted("", text):
                return (self.ids[text],)  # the one accepted path
            settled, queue = bytearray(size + 1), [(0, "")]
            while not settled[size]:
                at, piece = queue.pop()
                if settled[at]:
                    continue
                if piece and not self._accepted(last[at - len(piece)], piece):
                    continue
                settled[at], last[at] = 1, piece
                for end in range(at + 1, min(at + longest.get(text[at : at + 2], 1), size) + 1):
                    if not settled[end] and ((piece := text[at:end]) in weights or end == at + 1):
                        queue.append((end, piece))
        else:
            cost = [0.0] + [INFINITE] * size
            for at in range(size):
                here = cost[at]
                for end in range(at + 1, min(at + longest.get(text[at : at + 2], 1), size) + 1):
                    piece = text[at:end]
                    weight = weights.get(piece, fallback if end == at + 1 else INFINITE)
                    # Positions are left in order, so at equal weight the arc that came first, the longest, stays.
                    if here + weight < cost[end]:
                        cost[end], last[end] = here + weight, piece
        out, at = [], size
        while at:
            out.append(last[at])
            at -= len(last[at])
        return self._emit(out[::-1])

    def encode(self, text: str) -> list[int]:
        text = self.normal(text)
        out: list[int] = []
        for i, part in enumerate(self.user.split(text) if self.user else (text,)):
            if i % 2:
                out.append(self.user_ids[part])
            elif part:
                kinds = self.letter[np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)]
                cuts = [0, *(np.flatnonzero(~self.bridge[kinds[:-1], kinds[1:]]) + 1).tolist(), len(part)]
                paths = self.paths
                for a, b in zip(cuts, cuts[1:]):
                    out += paths[part[a:b]]
        if self.bytes is None and self.unknown in out:
            out = [x for x, before in zip(out, [None, *out]) if x != self.unknown or before != self.unknown]
        return out

    def decode(self, ids: list[int]) -> str:
        """The output side read back: pieces to text, runs of byte pieces as UTF-8 (a broken one becomes U+FFFD). The dummy prefix goes: one
        space of the first piece, or of each up to the first text in a model that squeezes white space."""
        out, at, surface = [], 0, self.surface
        if self.prefix or self.squeeze:
            while at < len(ids) and ids[at] not in self.byte_of and (ids[at] in self.spaced or not surface[ids[at]]):
                at += 1
                if ids[at - 1] in self.spaced:
                    out.append(surface[ids[at - 1]][1:])
                    if out[-1] or not self.squeeze:
                        break
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(out + [surface[i] for i in ids[at:]])
        run = bytearray()
        for i in ids[at:]:
            byte = self.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(surface[i])
        return "".join(out) + run.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def transducer(model: bytes) -> Transducer:
    return Transducer(model)


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens long, ids array<int>, round_trip boolean: whether decoding the ids gives the text again
    (U+2581 itself reads as a space). Null and empty texts have no tokens and do round-trip. Rows are
    independent: repeated rows stay, other columns are not looked at."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            _, offsets = textbuf.buffer(batch.column(1))
            for i, j in textbuf.slices(offsets):
                flat, sizes, same = [], [], []
                for text in batch.column(1).slice(i, j - i).to_pylist():
                    ids = machine.encode(text or "")
                    same.append(machine.decode(ids) == (text or "").replace(SPACE, " "))
                    sizes.append(len(ids))
                    flat.append(np.array(ids, np.int32))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), lists, pa.array(same)], schema=schema)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give a null text, and an id outside the model fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            texts = [None if ids is None else machine.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.selectExpr("cast(doc_id as bigint) doc_id", "cast(ids as array<int>) ids").mapInArrow(run, "doc_id long, text string")
