"""The ten operators on small tables: edge cases, brute force, exact round trips, held-out accuracy, and SQL."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import ctw, imatch, langid_cnn, license_scan, minhash_join, mixing, permutation_index, preference, sentencepiece_wfst, toxicity
from spanloom.llm.common import crc_mod
from spanloom.llm.queries import ORACLES, PIECES, piece_model

LETTERS = {"en": "the of and er in th on", "de": "der und ich sch ung zu ein", "fr": "le des é eau ou ment qu"}
#: Columns whose names the operators use themselves.
CLASH = ["score", "size", "rid", "cid", "k", "at", "copy", "_n", "_id", "_share", "sketch", "slice", "bucket", "rank", "block", "kept", "comp", "edited", "fingerprint", "trained"]


def words(rng, lang, n):
    parts = LETTERS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lang = rng.choice(list(LETTERS))
        text = words(rng, lang, rng.randint(1, 120))
        if i % 7 == 0:
            text += " idiot moron"
        rows.append((i, text, lang, f"src{i % 4}"))
    base = words(rng, "en", 300)
    edits = base.split()
    edits[40] = "changed"
    rows += [(60, base, "en", "src0"), (61, " ".join(edits), "en", "src0"), (62, base, None, None), (63, base, "en", "src9")]
    rows += [(64, None, "en", "src1"), (65, "", "en", "src1"), (66, "   \n\t ", "en", None), (67, "12 34 %%", "en", "src2"), (68, "Released under the MIT License.", "en", "src2")]
    rows += [(69, words(rng, "de", 20000), "de", "src3"), (70, "ünïcödé ☃ 😀 中文 ▁x  y", None, "src3"), (5, rows[5][1], rows[5][2], rows[5][3]), (None, base, "en", "src0"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def sql(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.sql(query)


def same(df, query, **tables):
    rel = sql(query, **tables)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    plain = lambda v: v.item() if hasattr(v, "item") else v
    clean = lambda r: tuple("null" if v is None else f"{float(v):.9g}" if isinstance(plain(v), (int, float)) else str(v) for v in r)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(clean(r) for r in df.select(*cols).collect()) == sorted(clean([r[i] for i in at]) for r in rel.fetchall())


def test_sentencepiece_matches_the_library(docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    machine = sentencepiece_wfst.Transducer(piece_model())
    rng = random.Random(1)
    letters = "ab the ▁ er ing \n\tétöß中文😀<s></s><unk>  .,;'\"1290ABŹ　"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert machine.encode(s) == lib.encode(s)
        assert machine.decode(machine.encode(s)) == lib.decode(lib.encode(s))
    got = sentencepiece_wfst.encode(docs, piece_model()).collect()
    assert len(got) == len(corpus()) and all(r["round_trip"] for r in got)
    by_text = {r["doc_id"]: r["ids"] for r in got}
    assert all(by_text[i] == lib.encode(t or "") for i, t, *_ in corpus() if i is not None)
    back = sentencepiece_wfst.decode(sentencepiece_wfst.encode(docs, piece_model()), piece_model())
    assert {r["doc_id"]: r["text"] for r in back.collect()}[70] == "ünïcödé ☃ 😀 中文  x  y"
    assert sentencepiece_wfst.encode(empty, piece_model()).count() == 0


def piece_proto(pieces, kind, charsmap=b"", prefix=1, squeeze=1):
    """A model file of (piece, score, type) by hand."""

    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    held = lambda f, b: varint(f << 3 | 2) + varint(len(b)) + b
    number = lambda f, v: varint(f << 3) + varint(v)
    out = b"".join(held(1, held(1, p.encode()) + varint(2 << 3 | 5) + np.float32(s).tobytes() + number(3, k)) for p, s, k in pieces)
    bytes_too = any(k == 6 for _, _, k in pieces)
    return out + held(2, number(3, kind) + number(35, int(bytes_too))) + held(3, (held(2, charsmap) if charsmap else b"") + number(3, prefix) + number(4, squeeze) + number(5, 1))


def test_unigram_takes_the_shortest_path():
    model = piece_proto([("<unk>", 0, 2), ("▁", -1.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -3.0, 1), ("▁a", -1.5, 1)], 1, squeeze=0)
    machine = sentencepiece_wfst.Transducer(model)
    assert [machine.pieces[i] for i in machine.encode("ab")] == ["▁a", "b"]
    assert [machine.pieces[i] for i in machine.encode("bab")] == ["▁", "b", "ab"]
    assert [machine.pieces[i] for i in machine.encode("xyb")] == ["▁", "<unk>", "b"]  # a run of unknown characters is one token


def test_models_of_both_kinds_match_the_library():
    """Random vocabularies with and without character maps, squeezing, dummy prefix, byte fallback and user-defined symbols; scores are eighths,
    so that sums are exact and ties are ties in the library's single precision too."""
    import sentencepiece

    normal = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    charsmap = next(dict(sentencepiece_wfst._fields(v))[2] for k, v in sentencepiece_wfst._fields(normal) if k == 3)
    rng = random.Random(5)
    parts = ["a", "b", "c", "d", "e", "é", " ", "  ", "中", "ａ", "ﬁ", "\t", "\n", "<sep>", "<", "ab<", "x", "①", "▁", "　", "é"]
    for trial in range(24):
        kind, mapped, user, fallback = 1 + trial % 2, trial % 4 < 2, rng.random() < 0.4, rng.random() < 0.5
        pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{i:02X}>", 0, 6) for i in range(256 * fallback)), *((("<sep>", 0, 4), ("ab<", 0, 4)) if user else ())]
        words = dict.fromkeys([*"abcd▁é", *("".join(rng.choice("abcdeé▁中") for _ in range(rng.randint(2, 5))) for _ in range(60))])
        pieces += [(w, -i if kind == 2 else -rng.randint(1, 96) / 8, 1) for i, w in enumerate(words)]
        model = piece_proto(pieces, kind, charsmap if mapped else b"", int(rng.random() < 0.7), int(rng.random() < 0.5))
        lib, machine = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_wfst.Transducer(model)
        for _ in range(100):
            s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
            ids = machine.encode(s)
            assert ids == lib.encode(s) and machine.decode(ids) == lib.decode(ids), (trial, s)


def test_licenses(spark, docs, empty):
    same(license_scan.scan(docs), ORACLES["op2_license_scan"], documents=docs)
    assert license_scan.scan(empty).count() == 0
    label, (weight, markup) = "mit-text", license_scan.TEMPLATES["mit-text"]
    automaton = license_scan.Automaton(markup)
    plain = [n.word for n in license_scan.parse(markup) if n.word]
    at = plain.index("be", plain.index("event"))
    full = [w.encode() for w in [*plain[:at], "the", "authors", *plain[at:]]]
    check = lambda ws: automaton.found(b" " + b" ".join(ws) + b" ", ws)
    scanned = spark.createDataFrame([(1, "this code is licensed under 4 0"), (2, "Licensed under CC BY-NC 4.0"), (3, "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"), (4, "Licensed under CC BY 4.0. cc by " + "cc-by " * 20000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(scanned).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == ["", "cc-by,cc-by-nc-4.0-notice", "cc-by-sa-4.0-notice", "cc-by,cc-by-4.0-notice"] and (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (20002, 2, 40004 + 2)
    same(license_scan.scan(scanned), ORACLES["op2_license_scan"], documents=scanned)
    assert check(full) and check([b"x", *full, b"y"]) and not check(full[:-1]) and not check([w if i != 30 else b"other" for i, w in enumerate(full)])


def neighbours(rows):
    got = collections.defaultdict(list)
    for r in rows.collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return {q: [v for _, v, _ in sorted(own)] for q, own in got.items()}


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[1000:2000] = x[1000]  # a third of the rows are one vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    rows += [(5000, None), (5100, [0.0] * 32), (5200, [float("nan")] * 32), (5300, [None] * 32), (None, rows[0][1]), (5400, [1.0, 2.0]), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("score"), F.lit(1).alias("part"), F.lit(1).alias("x"))
    got = neighbours(permutation_index.search(df, F.col("vec_id") % 100 == 0, part=100))
    ids = np.arange(len(x))
    hit = total = 0
    for q, near in permutation_index.brute_force(ids, x.astype(np.float64), ids % 100 == 0):
        own = got.pop(q)
        hit += len(set(own) & set(near))
        total += len(near)
        if 1000 <= q < 2000:
            assert own == near  # ties go to the smaller id
    assert not got and hit / total >= 0.9
    few = permutation_index.search(df.where("vec_id <= 3"), F.col("vec_id") == 0).collect()
    assert sorted(r["rank"] for r in few) == [1, 2, 3]
    assert permutation_index.search(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("n", [12, 40, 500, 4000])
def test_neighbours_match_the_sql_and_brute_force_at_any_size(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 24))
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)] + [(3, [1.0] * 24), (3, [2.0] * 24)]  # one id, several vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    step = max(5, n // 40)
    out = permutation_index.search(df, F.col("vec_id") % step == 0, part=64)
    if n <= 500:
        same(out, permutation_index.oracle_sql(f"vec_id % {step} = 0"), embeddings=df)
    got, hit, total = neighbours(out), 0, 0
    for q, near in permutation_index.brute_force(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[0] % step == 0 for r in rows])):
        assert len(got[q]) == len(near)
        hit, total = hit + len(set(got[q]) & set(near)), total + len(set(near))
    assert hit / total >= 0.9


def test_few_rows_are_reranked(spark):
    x = np.random.default_rng(1).normal(size=(2000, 32))
    index = permutation_index.Index(np.arange(2000), x, 256, 96)
    files, bounds = index.plan(np.arange(50), x[:50], 40, 0.75, 0.15)
    scores = index.lists.shared(permutation_index.Lists(permutation_index.by_nearness(x[:50], index.pivots)[:, :96], 256))
    assert all(((scores[i] >= bounds[i]) & np.isin(index.files, files[i])).mean() < 0.2 for i in range(50))


def test_fingerprints(spark, docs, empty):
    same(imatch.fingerprints(docs), ORACLES["op4_imatch"], documents=docs)
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs).collect()}
    assert got[60]["fingerprint"] == got[62]["fingerprint"] != got[61]["fingerprint"]
    assert imatch.fingerprints(empty).count() == 0
    one = imatch.fingerprints(docs.where("doc_id = 60")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    again = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("same id "), F.col("id").cast("string")).alias("text")).unionByName(spark.range(30).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same row").alias("text")))
    same(imatch.fingerprints(again), ORACLES["op4_imatch"], documents=again)
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    follow = {r["text"]: r["next_text"] for r in imatch.with_next(many, (), per_bucket=7).collect()}
    assert follow == {f"w{i}": f"w{(i - 1) % 500}" for i in range(500)}


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 2, "user", "more"), (2, 0, "user", "alone"), (3, 0, "assistant", "x"), (4, 0, "user", None), (4, 1, None, "z"), (5, 0, "assistant", "q"), (0, 1, "assistant", "a"), (None, 0, "user", "n"), (4, 2, "assistant", ""), (6, 0, "assistant", "same"), (7, 0, "assistant", "same")]
    rows += [(9, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(5000)] + [(9, 7, "assistant", "another row of turn 7"), (8, 3, "system", "y" * 100_000), (8, 5, "assistant", "end"), (9, -1, "system", "before"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("pair_id"), F.lit(2).alias("part"), F.lit(3).alias("split"), F.lit(4).alias("c"))
    out = preference.assembled(preference.rows_of(preference.against_next(df)))
    same(out, ORACLES["op5_preference"], conversations=df.select("conv_id", "turn", "role", "text"))
    whole = {(r["pair_id"], r["segment"]): r for r in out.collect()}
    one = whole[1, 0]
    assert one["prompt"] == "<|user|>\nhi<|end|>\n" and one["chosen"] == "<|assistant|>\nb<|end|>\n<|user|>\nmore<|end|>\n" and one["rejected"] == "<|assistant|>\na<|end|>\n"
    assert one["chosen_spans"] == f"0-{len('<|assistant|>|b<|end|>|')}" == one["rejected_spans"]
    assert (7, 0) not in whole and {p for p, _ in whole} == {0, 1, 3, 4, 5, 6, 8, 9}  # 7 answers as its neighbour 6 does
    assert sorted(s for p, s in whole if p == 9) == [-1, 0, 1, 2, 3, 4] and whole[9, 4]["rejected"].endswith("end<|end|>\n")
    none = df.limit(0)
    assert preference.rows_of(preference.against_next(none)).count() == 0


def test_given_pairs(spark):
    schema = "pair_id long, turn long, role string, text string"
    good = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "yes"), (2, 0, "user", "only here"), (3, 0, "user", "q"), (4, 0, "user", "q"), (4, 1, "assistant", "long")], schema)
    bad = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "no"), (3, 0, "user", "q"), (4, 0, "user", "q")], schema)
    got = {r["pair_id"]: (r["prompt"], r["chosen"], r["rejected"]) for r in preference.format_pairs(good, bad).collect()}
    q = "<|user|>\nq<|end|>\n"
    assert got == {1: (q, "<|assistant|>\nyes<|end|>\n", "<|assistant|>\nno<|end|>\n"), 4: (q, "<|assistant|>\nlong<|end|>\n", "")}


def test_every_conversation_with_a_reply_makes_a_pair(spark):
    rows = [(2 * i, j, r, f"{r}{2 * i}") for i in range(50) for j, r in enumerate(("user", "assistant"))] + [(7, 0, "user", "alone"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r["pair_id"]: r for r in preference.assembled(preference.rows_of(preference.against_next(df))).collect()}
    assert sorted(whole) == [2 * i for i in range(50)]
    assert all(r["rejected"] == f"<|assistant|>\nassistant{(i - 2) % 100}<|end|>\n" for i, r in whole.items())


def test_near_duplicates(spark, docs, empty):
    named = docs.where("doc_id is not null")
    same(minhash_join.near_duplicates(named, 85), ORACLES["op6_minhash"], documents=named)
    got = {r["doc_id"]: r for r in minhash_join.near_duplicates(docs, 85).collect()}
    assert {got[i]["component_id"] for i in (60, 61, 62, 63)} == {60} and got[64]["component_id"] == 64
    assert minhash_join.near_duplicates(empty).count() == 0
    kept = minhash_join.keep_one(docs, 80)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id in (5, 60, 61, 62, 63)").collect()) == [5, 60]
    assert [r["text"] for r in kept.where("doc_id is null").collect()] == [None]  # the copy of 60 without an id goes
    a, b, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "abo")
    few = spark.createDataFrame([(3, b), (5, b), (5, other), (60, a), (None, a), (None, None), (None, None), (8, ""), (8, ""), (9, a + " "), (9, a)], "doc_id long, text string")
    got = [(r["doc_id"], r["text"] and r["text"].strip()) for r in minhash_join.keep_one(few, 80).collect()]
    assert sorted(got, key=str) == sorted([(3, b), (5, other), (9, a), (None, None), (8, "")], key=str)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        ws = list(base)
        for _ in range(rng.randint(0, 8)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(ws)))
    rows += [(1000 + i, " ".join([*base[:60], *(f"u{i}_{j}" for j in range(20))])) for i in range(100)]  # a passage that many share
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent in (80, 85):
        same(minhash_join.near_duplicates(df, percent), minhash_join.oracle_sql(percent), documents=df)


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        lang = rng.choice(list(LETTERS))
        text, toxic = words(rng, lang, rng.randint(5, 400)).split(), rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "MORON,", "scum", "pathetic"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.fit(df, marks.where(crc_mod("doc_id", 4) != 2))
    held = toxicity.score(df, lexicon).join(marks.where("toxic is not null"), "doc_id").where(crc_mod("doc_id", 4) == 2).collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.97
    automaton = lexicon.automaton()
    assert toxicity.density(toxicity.fold("you 1D10T"), automaton) and toxicity.density(toxicity.fold("an іdiоt"), automaton) and toxicity.density(toxicity.fold("i.d.i.o.t"), automaton)
    assert not toxicity.density(toxicity.fold("it is idiot proof"), automaton)
    assert [r["score"] for r in toxicity.score(docs.where("doc_id in (64, 65)"), lexicon).collect()] == [0.0, 0.0]
    kept = toxicity.keep_clean(docs, lexicon)
    assert kept.columns == docs.columns and 0 not in {r["doc_id"] for r in kept.collect()}
    assert toxicity.score(empty, toxicity.fit(empty, marks.limit(0))).count() == 0


def density_by_hand(words_, lexicon):
    """Every place of every entry, looked for one by one."""
    text, hits, excused = f" {' '.join(words_)} ", {}, []
    for phrase in lexicon.exceptions:
        key = f" {' '.join(toxicity.fold(phrase))} "
        excused += [(i, i + len(key) - 1) for i in range(len(text)) if text.startswith(key, i)]
    for word, begins, weight in lexicon.entries:
        key = f" {word}" if begins else f" {word} "
        for i in range(len(text)):
            if text.startswith(key, i):
                hits[i] = max(weight, hits.get(i, 0.0))
    total = sum(w for i, w in sorted(hits.items()) if not any(a <= i < b for a, b in excused))
    return total / (1 + math.log1p(len(words_) / 200)) if words_ else 0.0


def test_toxicity_matches_a_plain_search():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon((("idiot", False, 2.0), ("idi", True, 0.5), ("trash", False, 3.0), ("clown", True, 1.5), ("loser", False, 1.0)), exceptions=("trash can", "can idiot can", "idiot proof", "class clown"))
    automaton, parts = lexicon.automaton(), ["idiot", "idiots", "trash", "can", "proof", "class", "clown", "clowns", "loser", "sore", "x", "idi"]
    for _ in range(500):
        words_ = [rng.choice(parts) for _ in range(rng.randint(0, 25))]
        assert math.isclose(toxicity.density(words_, automaton), density_by_hand(words_, lexicon), abs_tol=1e-12)
    assert toxicity.density(["idiot", "proof"] * 20_000, automaton) == 0 and toxicity.density(["trash"] * 20_000, automaton) > 0


def test_a_lexicon_is_what_the_floors_let_in(spark):
    rng = random.Random(11)
    plain, bad = [f"word{i}" for i in range(300)], [f"nasty{i}" for i in range(12)] + ["rare"]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        text = rng.choices(plain, k=rng.randint(20, 60)) + (rng.choices(bad[:12], k=4) if toxic else []) + (["rare"] if i == 0 else []) + ([rng.choice(bad)] if i == 1 else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    lexicon = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    found, uses = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for (_, text), (_, y) in zip(rows, labels):
        terms = collections.Counter({"": len(toxicity.fold(text))})
        for w, n in collections.Counter(toxicity.fold(text)).items():
            terms[f"{w} "] += n
            for size in toxicity.BEGINNINGS:
                if len(w) > size:
                    terms[w[:size]] += n
        found[y].update(terms.keys())
        uses[y].update(terms)
    toxic, clean = sum(y for _, y in labels), sum(1 - y for _, y in labels)
    want = {}
    for term, t in found[1].items():
        rate = math.log((uses[1][term] + 0.5) / (uses[1][""] + 1)) - math.log((uses[0][term] + 0.5) / (uses[0][""] + 1))
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((found[0][term] + 0.5) / (clean + 1))
        if term and t >= max(2, math.ceil(0.01 * toxic)) and uses[1][term] >= max(5, 0.015 * toxic) and rate >= 4 and odds >= 2:
            want[term.rstrip(" "), not term.endswith(" ")] = min(rate, 1.5 * odds)
    assert {(w, b) for w, b, _ in lexicon.entries} == set(want) and all(math.isclose(v, want[w, b], rel_tol=1e-9) for w, b, v in lexicon.entries)
    assert ("rare", False) not in want and ("nastye", False) in want  # nasty3, as it is folded
    twice = spark.createDataFrame([rows[0], rows[0], (None, rows[0][1])], "doc_id long, text string")
    assert len({r["score"] for r in toxicity.score(twice, lexicon).collect()}) == 1


def test_mixing(docs, empty):
    same(mixing.mix(docs), ORACLES["op8_mixing"], documents=docs)
    got = mixing.mix(docs, block=16).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 1 for rs in by.values())
    assert len(got) == len(corpus()) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs, block=16).collect()), key=str)
    # The mix itself: every slot of every shard, drawn and filled.
    cells = mixing.shards(docs, block=16, shard_slots=32).collect()
    taken = collections.Counter()
    for r in cells:
        taken[r["doc_id"], r["source"]] += r["words"]
    want = collections.Counter()
    for r in got:
        want[r["doc_id"], r["source"]] += r["taken"]
    assert taken == +want
    in_shard, numbers = collections.defaultdict(set), collections.defaultdict(set)
    for r in cells:
        in_shard[r["shard"]].add((r["source"], r["j"]))
        numbers[r["source"]].add(r["j"])
    assert all(js == set(range(len(js))) for js in numbers.values()) and {len(x) for k, x in in_shard.items() if k < max(in_shard)} == {32}
    again = mixing.repeat(docs)
    assert again.columns == docs.columns and again.count() > 0
    assert mixing.mix(empty).count() == 0


def test_a_shard_draws_its_sources(spark):
    quota = [5000, 15000, 20000]
    table = spark.createDataFrame([(r, q, 100, 0, 0, 0, 0) for r, q in enumerate(quota)], "rank long, slots long, blocks long, passes long, rest long, tail long, short_at long")
    draws = [[0] * 3 for _ in range(40)]
    for r in mixing.drawn(table, 1000).collect():
        draws[r["shard"]][r["rank"]] = r["n"]
    assert all(sum(x) == 1000 for x in draws)
    # Multinomial: a count's variance over shards is n p (1 - p); a division of fixed totals in equal parts would have none.
    for k, q in enumerate(quota):
        p, own = q / 40000, [x[k] for x in draws]
        assert abs(sum(own) / 40 - 1000 * p) < 10 and 0.4 < np.var(own) / (1000 * p * (1 - p)) < 2
    # By hand: the source of each slot.
    import hashlib

    def source(g):
        u = int(hashlib.md5(f"mix:{g}".encode()).hexdigest()[:8], 16) / 2**32 * 40000
        return 0 if u < 5000 else 1 if u < 20000 else 2

    assert draws[7] == [sum(source(g) == k for g in range(7000, 8000)) for k in range(3)]
    js = collections.defaultdict(list)
    for r in mixing.slots(table, 512, 1000).collect():
        js[r["rank"]].append(r["j"])
    assert all(sorted(js[k]) == list(range(q)) for k, q in enumerate(quota))


def test_one_row_a_third_of_all(spark):
    rows = [(1, "a b c", "s")] * 400 + [(i, "w " * (i % 40), f"s{i % 3}") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    same(mixing.mix(df), ORACLES["op8_mixing"], documents=df)
    words = {r["source"]: r["n"] for r in mixing.repeat(df, block=16).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    for r in mixing.mix(df, block=16).select("source", "target").distinct().collect():
        assert abs(words[r["source"]] - r["target"]) < 0.15 * r["target"]


def test_permutations_are_exact(spark):
    for n in (1, 2, 7, 100, 1023):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))
        back = spark.range(n).select("id", mixing.permuted(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")), F.lit(n).cast("long"), F.lit(5).cast("long"), back=True).alias("b"))
        assert back.where("id <> b").isEmpty()


def test_language(docs, empty):
    net = langid_cnn.fit(docs.where(crc_mod("doc_id", 5) != 0))
    got = {r["doc_id"]: r for r in langid_cnn.predict(docs, net).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (64, 65, 66, 67))
    signs = docs.limit(1).select(F.explode(F.array(*map(F.lit, ("½ ½", "②", "x² ²", "٣", "_")))).alias("text")).select(F.monotonically_increasing_id().alias("doc_id"), "text")
    assert [r["lang_pred"] == "und" for r in langid_cnn.predict(signs, net).collect()] == [True, True, False, True, True]
    sure = [(i, lang) for i, text, lang, _ in corpus() if i is not None and lang and text and len(text) > 200 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["lang_pred"] == lang for i, lang in sure) >= 0.9 * len(sure) > 0
    kept = {r["doc_id"] for r in langid_cnn.keep_known(docs, net).collect()}
    assert not kept & {64, 65, 66, 67} and kept >= {60, 61, 69}
    none = langid_cnn.fit(empty)
    assert {r["lang_pred"] for r in langid_cnn.predict(docs, none).collect()} == {"und"} and langid_cnn.predict(empty, net).count() == 0


def test_the_language_stage_decides_by_the_network(docs, empty):
    net = langid_cnn.fit(docs.where(crc_mod("doc_id", 5) != 0))
    least = langid_cnn.floor(docs.where(crc_mod("doc_id", 5) == 0), net)
    scores = {r["doc_id"]: r["score"] for r in langid_cnn.predict(docs, net).collect() if r["lang_pred"] != "und"}
    assert least > 1 / len(net.langs)
    kept = {r["doc_id"] for r in langid_cnn.keep_known(docs, net, least).collect()}
    assert kept == {i for i, s in scores.items() if s >= least} and kept >= {60, 61, 69}
    none = langid_cnn.fit(empty)
    assert langid_cnn.floor(docs, none) == 0.0
    assert {60, 70} <= {r["doc_id"] for r in langid_cnn.keep_known(docs, none).collect()} and 67 not in {r["doc_id"] for r in langid_cnn.keep_known(docs, none).collect()}


def log_probs_by_hand(net, window):
    """The network on one window, filter by filter and place by place."""
    pooled = []
    for w, f, b in zip(langid_cnn.WIDTHS, net.filters, net.biases):
        for k in range(f.shape[1]):
            best = max(sum(float(net.embed[window[i + j]][d]) * float(f[j * net.embed.shape[1] + d][k]) for j in range(w) for d in range(net.embed.shape[1])) for i in range(len(window) - w + 1))
            pooled.append(max(0.0, best + float(b[k])))
    z = [sum(p * float(net.out[i][c]) for i, p in enumerate(pooled)) + float(net.out_bias[c]) for c in range(len(net.langs))]
    top = max(z)
    return [v - top - math.log(sum(math.exp(x - top) for x in z)) for v in z]


def test_predictions_match_the_network_by_hand(spark):
    rng = random.Random(2)
    texts = {i: words(rng, lang, n) for i, (lang, n) in enumerate([("en", 3), ("de", 40), ("fr", 25), ("en", 60)])}
    net = langid_cnn.train([words(rng, lang, 60).encode() for lang in LETTERS for _ in range(20)], [lang for lang in LETTERS for _ in range(20)], dims=3, filters=4)
    got = {r["doc_id"]: r for r in langid_cnn.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), net).collect()}
    for i, text in texts.items():
        raw = text.encode()
        parts = [raw[a : a + langid_cnn.WINDOW].ljust(langid_cnn.WINDOW, b"\0") for a in range(0, len(raw), langid_cnn.WINDOW)]
        mean = np.mean([log_probs_by_hand(net, p) for p in parts], 0)
        share = np.exp(mean) / np.exp(mean).sum()
        assert got[i]["lang_pred"] == net.langs[int(mean.argmax())] and math.isclose(got[i]["score"], share.max(), rel_tol=1e-4)


def test_the_language_sample_is_the_smallest_hashes(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "en").when(F.col("id") % 500 == 1, "fr").otherwise("de").alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    df = df.unionByName(df.where("doc_id = 3").crossJoin(spark.range(3000)).drop("id"))  # one row very often
    taken = {}
    was = langid_cnn.train
    try:
        langid_cnn.train = lambda texts, labels, **_: taken.update(zip((t.decode() for t in texts), labels))
        langid_cnn.fit(df, per_lang=50)
    finally:
        langid_cnn.train = was
    hashed = df.distinct().withColumn("h", F.xxhash64("doc_id", "text")).collect()
    for lang in ("en", "de", "fr"):
        assert {t for t, own in taken.items() if own == lang} == {r["text"] for r in sorted((r for r in hashed if r["lang"] == lang), key=lambda r: r["h"])[:50]}


def test_the_network_learns_from_rows_outside_the_sample(spark):
    """The start knows neither language; letters are learnt all the same, in any order of the table."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefgh" if i % 2 else "stuvwxyz") + " " * (rng.random() < 0.2) for _ in range(600)), "x" if i % 2 else "y") for i in range(400)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[2]), "doc_id long, text string, lang string")
    was = langid_cnn.train
    start = was([b"kkkk lll kl", b"kkkk lll kl"], ["x", "y"])
    start.out[...], start.out_bias[...] = 0, 0
    try:
        langid_cnn.train = lambda texts, labels, **_: start
        net = langid_cnn.fit(df, per_lang=1)
    finally:
        langid_cnn.train = was
    again = langid_cnn.learn_all(df.withColumn("h", F.xxhash64("doc_id", "text")).orderBy(F.desc("doc_id")), start, {"x": 1000, "y": 1000}, shard_windows=700)
    right = lambda n: langid_cnn.predict(df, n).join(df.select("doc_id", "lang"), "doc_id").where("lang = lang_pred").count()
    assert min(right(net), right(again)) >= 380 > 200 == right(start)


def test_the_floor_is_of_all_held_out_rows(spark):
    net = langid_cnn.train([b"abababab" * 20, b"xyxyxyxy" * 20] * 20, ["a", "x"] * 20)
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("abab xy "), F.substring(F.sha1(F.col("id").cast("string")), 1, 6)).alias("text"), F.lit("a").alias("lang"))
    scores = sorted(r["score"] for r in langid_cnn.predict(df, net).where("lang_pred = 'a'").collect())
    assert len(scores) > 1000 and langid_cnn.floor(df, net, 0.001) == scores[math.ceil(0.001 * len(scores)) - 1]


def test_gradients_of_the_network_learn():
    net = langid_cnn.train([b"abababab" * 20, b"xyxyxyxy" * 20] * 20, ["a", "x"] * 20)
    x, _ = langid_cnn.windows(np.frombuffer(b"babababababa", np.uint8), np.array([0, 12]), 0, 1)
    assert net.langs[int(net.log_probs(x).argmax())] == "a"


def test_scores(docs, empty):
    got = collections.defaultdict(list)
    for r in ctw.score(docs, crc_mod("doc_id", 7) != 2, depth=3).collect():
        got[r["doc_id"]].append(r)
    count, held = collections.Counter(), [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t, *_ in corpus()]
    for i, ws in held:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            count.update(ws)
    n, v = sum(count.values()), len(count)
    for i, ws in held:
        r = [x for x in got[i] if x["n_tokens"] == len(ws)][0]
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["n_known"] == sum(count[w] > 0 for w in ws) and r["train_tokens"] == n and r["score"] < 0
    assert ctw.score(empty, F.lit(True)).count() == 0
    untrained = ctw.score(docs.where("doc_id = 60"), F.lit(False)).first()
    assert math.isclose(untrained["bits_per_byte"], 8.0) and untrained["n_known"] == 0


def test_context_trees_are_distributions_and_weight_as_defined():
    low = np.frombuffer(b"abracadabra" * 5, np.uint8)
    from spanloom.llm import textbuf

    keys, _ = textbuf.grams(low, np.array([0, len(low)]), 2)
    levels = []
    for d in (0, 1, 2):
        levels.append(ctw.merged([keys & np.uint64((1 << (8 * (d + 1))) - 1)], [np.ones(len(keys), np.int64)]))
    tree = ctw.Tree.build(levels)
    for context in (b"ab", b"ra", b"zz", b"\xff\xff"):
        base = np.uint64((context[1] << 8) | (context[0] << 16))
        every = base | np.arange(256, dtype=np.uint64)
        assert math.isclose((2.0 ** tree.log2(every)).sum(), 1.0, rel_tol=1e-6)
    # The root node's weight, from the definition over its first bit.
    ones = {}
    for k in keys:
        for d in range(3):
            c = (int(k) >> 8) & ((1 << (8 * d)) - 1)
            ones.setdefault((d, c), [0, 0])[(int(k) & 255) >> 7] += 1

    def kt(a, b):
        p, x, y = 0.0, 0, 0
        for bit in [0] * a + [1] * b:
            p += math.log(((y if bit else x) + 0.5) / (x + y + 1))
            x, y = x + (not bit), y + bit
        return p

    def weighted(d, c):
        own = kt(*ones[d, c])
        if d == 2:
            return own
        below = sum(weighted(d + 1, e) for dd, e in ones if dd == d + 1 and e & ((1 << (8 * d)) - 1) == c)
        return np.logaddexp(own, below) - math.log(2)

    below = sum(weighted(1, c) for d, c in ones if d == 1)
    k, _, _, weight = tree.levels[0]
    assert math.isclose(float(weight[list(k).index(1)]), 1 / (1 + math.exp(below - kt(*ones[0, 0]))), rel_tol=1e-5)


def scores_by_definition(trained, scored, depth, least):
    """log2 probabilities of whole texts under context-tree weighting, from dictionaries of counts."""

    def bits(text):
        data = bytes([255] * depth) + text + b"\xff"
        for i in range(depth, len(data)):
            for level in range(8):
                yield data[i - depth : i][::-1], (1 << level) | (data[i] >> (8 - level)), (data[i] >> (7 - level)) & 1

    seen, held = collections.Counter(), {}
    for text in trained:
        for context, node, bit in bits(text):
            for d in range(depth + 1):
                held.setdefault((context[:d], node), [0, 0])[bit] += 1
                if node == 1:
                    seen[context[:d]] += 1
    held = {k: v for k, v in held.items() if seen[k[0]] >= least}
    kids = collections.defaultdict(list)
    for context, node in held:
        if context:
            kids[context[:-1], node].append((context, node))
    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - math.log(math.pi) - lg(a + b + 1)
    own, under, total = {}, {}, {}
    for key in sorted(held, key=lambda k: -len(k[0])):
        a, b = held[key]
        own[key] = kt(a, b)
        here = sum(sum(held[k]) for k in kids[key])
        under[key] = sum(total[k] for k in kids[key]) + own[key] * (a + b - here) / (a + b) if here else None
        total[key] = own[key] if under[key] is None else math.log(0.5 * math.exp(own[key] - max(own[key], under[key])) + 0.5 * math.exp(under[key] - max(own[key], under[key]))) + max(own[key], under[key])

    def predicted(context, node, bit):
        p = None
        for d in range(depth, -1, -1):
            key = (context[:d], node)
            if key in held:
                a, b = held[key]
                value = ((b if bit else a) + 0.5) / (a + b + 1)
                weight = 1.0 if under[key] is None else 1 / (1 + math.exp(min(700, under[key] - own[key])))
                p = value if p is None else weight * value + (1 - weight) * p
        return 0.5 if p is None else p

    return [sum(math.log2(predicted(*x)) for x in bits(text)) for text in scored]


def test_scores_follow_the_definition_at_full_depth(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(30)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(24)] + ["", "ABC \u00e9\u00e9 abc", None, "z" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in ctw.score(df, F.col("doc_id") % 7 != 2).collect()}
    lower = [(t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for t in texts]
    want = scores_by_definition([t for i, t in enumerate(lower) if i % 7 != 2], lower, 6, 2)
    assert all(math.isclose(got[i], want[i] * ctw.LOG2, rel_tol=1e-5, abs_tol=1e-6) for i in range(len(texts)))


def components_by_hand(rows, percent):
    """Smallest id reachable for each text, over all pairs of shingle sets."""
    sets = []
    for _, text, *_ in rows:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split()
        sets.append(frozenset(zip(*(ws[k:] for k in range(5)))) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else []))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return label


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline
    import sentencepiece

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    ids = {r["doc_id"] for r in rows}
    assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and not ids & {0, 7, 61, 62, 63, 64, 65, 66, 67}
    # Stage by stage, against plain versions over all rows.
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    plain = lambda df: sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect() if r["doc_id"] is not None)
    lexicon = toxicity.fit(table, spark.read.parquet(str(tmp_path / "labels.parquet")).where(crc_mod("doc_id", 4) != 2))
    scores = lambda t: (lambda d: d / (d + lexicon.half * 7 / 3))(density_by_hand(toxicity.fold(t or ""), lexicon))
    first = corpus_pipeline.drop_toxic(spark, table, str(tmp_path))
    assert plain(first) == sorted(r for r in plain_rows(table) if scores(r[1]) < 0.3) and first.columns == names
    second = corpus_pipeline.drop_unknown_language(spark, first, str(tmp_path))
    held = crc_mod("doc_id", 5) == 0
    net = langid_cnn.fit(first.where(~held))
    least = langid_cnn.floor(first.where(held), net)
    good = {(r["doc_id"], r["text"]) for r in first.join(langid_cnn.predict(first, net).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(F.col("doc_id").alias("i")).distinct(), F.col("doc_id") == F.col("i")).collect()}
    assert {(r[0], r[1]) for r in plain(second)} == good
    third = corpus_pipeline.drop_near_duplicates(spark, second, str(tmp_path))
    every = sorted(((r["doc_id"], r["text"]) for r in second.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    label = components_by_hand(every, 80)
    assert sorted(map(key, third.collect())) == sorted((i is None, i or 0, t) for n, (i, t) in enumerate(every) if label.index(label[n]) == n)
    fourth = corpus_pipeline.mix_sources(spark, third, str(tmp_path))
    times, mixed = collections.Counter(r["doc_id"] for r in fourth.collect()), mixing.mix(third).collect()
    assert fourth.columns == names and all(n <= 2 for n in times.values()) and set(times) <= {r["doc_id"] for r in mixed}
    assert all(times[r["doc_id"]] >= 1 for r in mixed if r["size"] and r["taken"] >= r["size"])
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = corpus_pipeline.to_pieces(spark, fourth, str(tmp_path))
    text_of = {r["doc_id"]: r["text"] for r in third.collect()}
    assert collections.Counter(r["doc_id"] for r in encoded.collect()) == times and all(r["ids"] == lib.encode(text_of[r["doc_id"]]) and r["round_trip"] for r in encoded.collect())
    assert collections.Counter(r["doc_id"] for r in rows) == times


def plain_rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect() if r["doc_id"] is not None]


def test_stages_begin_with_small_heaps(spark, docs):
    import corpus_pipeline

    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    was = beans()
    corpus_pipeline.mix_sources(spark, docs.limit(0), "")
    assert beans() > was + 1  # here the executors' tasks run in the driver


def test_near_duplicates_keep_heaps_small(spark, docs, monkeypatch):
    from spanloom import scratch

    monkeypatch.setattr(scratch, "PAUSE", float("inf"))  # the driver's own collections don't count
    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    was = beans()
    assert minhash_join.keep_one(docs.limit(30), 80).count() > 0
    assert beans() > was + 6  # before the first step that follows a heavy one, and the next ones


def test_near_duplicates_move_only_texts_that_are_wanted(spark):
    texts = spark.range(2000).selectExpr("id AS rid", "array_join(transform(sequence(1, 200), i -> sha2(concat(id, ':', i), 256)), ' ') AS text")
    named = minhash_join.signed(texts.selectExpr("rid", "rid AS doc_id", "struct(rid AS a, rid AS b) AS mark", "text"))
    wanted = spark.createDataFrame(named.where("rid % 100 = 7").select("rid", "cid").collect(), "rid long, cid binary")
    written = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many wanted ones
    try:
        was = written()
        got = minhash_join.full_sets(texts, wanted).collect()
        assert sorted(r["cid"] for r in got) == sorted(r["cid"] for r in wanted.collect()) and all(len(r["shingles"]) == 8 * 196 for r in got)
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        assert written() - was < 2 << 20  # of 26 MB of text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    every = spark.range(-3000, 3000).selectExpr("id AS rid", "id % 2 = 0 AS even")
    found = minhash_join.perhaps_in(every, every.where("even").select("rid"))
    assert found.where("even").count() == 3000 and found.where("not even").count() < 30


def test_unrelated_large_sets_share_no_coordinates():
    rng = np.random.default_rng(8)
    signatures = np.array([minhash_join.signature(rng.integers(0, 1 << 63, 50000, dtype=np.uint64)) for _ in range(100)])
    assert all(len(np.unique(signatures[:, k])) == 100 for k in range(minhash_join.K))


def test_near_duplicates_leave_only_what_is_still_read(spark, docs):
    import glob

    from spanloom import scratch

    with scratch.scope(spark) as held:
        out = minhash_join.near_duplicates(docs, 85)
        left = {p.rsplit("/", 1)[1].split("-")[0] for p in held if glob.glob(p.removeprefix("file:") + "/**/*.parquet", recursive=True)}
        assert left == {"rows", "members", "labels"} and out.count() == docs.count()


def test_kernels_hand_back_what_was_freed(spark, docs):
    def held_then_freed(batches):
        import os

        import numpy as np

        resident = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
        for batch in batches:
            many = [np.ones(2000) for _ in range(10000)]
            pin = many[-1]  # the last piece stays, so the heap's end can't move down
            del many[:]
            before = resident()
            list(minhash_join.textbuf.trimmed(iter)([]))
            yield pa.RecordBatch.from_pydict({"mb": pa.array([before - resident() + 0 * len(pin)], pa.int64())})

    assert spark.range(0, 1, 1, 1).mapInArrow(held_then_freed, "mb long").first()["mb"] > 100
    # What the operator's kernel runs as.
    plan = []
    fake = type("Frame", (), {"mapInArrow": lambda self, run, schema: plan.append(run) or self})()
    minhash_join.signed(fake)
    seen = []
    was, minhash_join.textbuf.trim = minhash_join.textbuf.trim, lambda: seen.append(1)
    try:
        assert list(plan[0]([])) == [] and seen == [1]
    finally:
        minhash_join.textbuf.trim = was


def test_pipeline_on_odd_tables(spark, docs, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, table in {"empty": docs.limit(0), "clashing": docs}.items():
        where = tmp_path / name
        table.write.parquet(str(where / "documents.parquet"))
        labels.write.parquet(str(where / "labels.parquet"))
        stage = spark.read.parquet(str(where / "documents.parquet"))
        for _, step in corpus_pipeline.STAGES[:-1]:
            stage = step(spark, stage, str(where))
            assert stage.columns == docs.columns
        assert corpus_pipeline.run(spark, str(where)).count() == stage.count() and (name != "empty" or stage.count() == 0)


def test_scores_leave_only_what_is_still_read(spark, docs):
    import glob

    from spanloom import scratch

    with scratch.scope(spark) as held:
        out = ctw.score(docs, crc_mod("doc_id", 7) != 2, depth=3)
        left = {p.rsplit("/", 1)[1].split("-")[0] for p in held if glob.glob(p.removeprefix("file:") + "/**/*.parquet", recursive=True)}
        assert left == {"words", "scored"} and out.count() == docs.count()


def test_pruned_contexts_are_predicted_by_their_node():
    text = np.frombuffer(b"abababacacbcbcabbbca" * 20, np.uint8).astype(np.uint64)
    keys, counts = np.unique((text[:-1] << np.uint64(8)) | text[1:], return_counts=True)
    shallow = ctw.shorter(keys, counts, 0)
    held = (keys >> np.uint64(8)) == ord("a")
    tree, flat = ctw.Tree.build([shallow, (keys[held], counts[held])]), ctw.Tree.build([shallow])
    pruned = np.array([(ord("b") << 8) | x for x in b"abc"], np.uint64)
    assert np.allclose(tree.log2(pruned), flat.log2(pruned))
    every = np.arange(256, dtype=np.uint64)
    for context in b"abz":
        assert abs(np.exp2(tree.log2((np.uint64(context) << np.uint64(8)) | every)).sum() - 1) < 1e-6


def test_no_context_goes_as_the_corpus_grows(spark):
    from spanloom.llm import textbuf

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(20000)]
    texts = [" ".join(vocabulary[int(20000 * rng.random() ** 2)] for _ in range(3000)) for _ in range(200)]
    assert sum(map(len, texts)) > 3 << 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["score"] for r in ctw.score(df, F.col("doc_id") % 7 != 2).collect()}

    def grams(chosen):
        joined = "".join(chosen).encode()
        return textbuf.grams(np.frombuffer(joined, np.uint8), np.cumsum([0, *map(len, chosen)]), 6)[0]

    keys, counts = np.unique(grams([t for i, t in enumerate(texts) if i % 7 != 2]), return_counts=True)
    levels = [ctw.shorter(keys, counts, d) for d in range(7)]
    tree = ctw.Tree.build([(k[m], n[m]) for k, n, m in ((k, n, ctw._seen(k, n) >= 2) for k, n in levels)])
    assert len(got) == len(texts)
    for i in (0, 2, 9, 100):
        assert math.isclose(got[i], tree.log2(grams([texts[i]])).sum() * ctw.LOG2, rel_tol=1e-6)
