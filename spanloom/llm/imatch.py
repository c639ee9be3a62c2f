"""Document fingerprints by I-Match. Main path: DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band of inverse document frequency: in at least
`rare` and at most `common` of all documents. A text keeps its distinct lexicon terms, sorted, and `2 * cells`
randomised subsets of the lexicon (two random partitions into `cells` cells, by digits of the term's MD5) each hash the
terms that fall to them; the fingerprint is these hashes side by side, four hex digits each, `----` for none. A
text without lexicon terms hashes all its distinct terms sorted in every place, so that equal texts agree and others seldom do.

Bound of the lexicon: document frequencies add up to the distinct terms of all documents, so at most (mean distinct
terms of a document) / rare terms can reach the band's lower edge, however many documents there are. It is held as a
literal hash table inside the plan and looked up where the text is; document texts are never shuffled for it.

Likeness of two fingerprints: equal places among those where one at least is not `----` (1 if all are alike).
Terms are [0-9a-z] and everything outside ASCII after lower-casing A-Z, of whole texts; null counts as empty."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

SLOTS = 4096
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_remove(F.array_distinct(F.split(ascii_lower(text), SEPARATORS)), "")


def lexicon(texts: DataFrame, rare: float = 0.01, common: float = 0.1) -> Column:
    """The band's terms as a constant: SLOTS lists of their 64-bit hashes, by hash modulo SLOTS. `texts` has text."""
    n = texts.count()
    held = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy(F.xxhash64("term").alias("h")).agg(F.count("*").alias("df"))
    band = held.where((F.col("df") >= max(1, math.ceil(rare * n))) & (F.col("df") <= max(1, math.floor(common * n))))
    slots = band.groupBy(F.pmod("h", F.lit(SLOTS)).alias("slot")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("h").cast("string"), F.lit("L")))), ",").alias("hs"))
    found = {r["slot"]: r["hs"] for r in slots.collect()}  # at most SLOTS rows, within the bound above
    nothing = "cast(array() as array<bigint>)"
    return F.expr("array(" + ",".join(f"array({found[i].replace(str(-(2**63)) + 'L', '0L')})" if i in found else nothing for i in range(SLOTS)) + ")")


def add_fingerprint(df: DataFrame, text: str, out: str, table: Column, cells: int = 32) -> DataFrame:
    """`df` with the fingerprint of its column `text`. Each step is a column of its own, so that it is computed once."""
    two = lambda x, at: F.conv(F.substring(x, at, 2), 16, 10).cast("int") % cells
    code = lambda ts: F.when(F.size(ts) == 0, F.lit("----")).otherwise(F.substring(F.md5(F.array_join(ts, " ")), 1, 4))
    subset = lambda all_, which: F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: F.transform(F.filter(all_, lambda x: x[which] == k), lambda x: x["t"]))
    step = df.withColumn("_every", terms(F.col(text)))
    step = step.withColumn("_in", F.filter("_every", lambda t: F.array_contains(F.element_at(table, (F.pmod(F.xxhash64(t), F.lit(SLOTS)) + 1).cast("int")), F.xxhash64(t))))
    step = step.withColumn("_in", F.transform(F.array_sort("_in"), lambda t: F.struct(t.alias("t"), F.md5(t).alias("m"))))
    step = step.withColumn("_in", F.transform("_in", lambda x: F.struct(x["t"].alias("t"), two(x["m"], 1).alias("a"), two(x["m"], 3).alias("b"))))
    step = step.withColumn("_sets", F.concat(subset(F.col("_in"), "a"), subset(F.col("_in"), "b")))
    whole = F.repeat(F.substring(F.md5(F.array_join(F.array_sort("_every"), " ")), 1, 4), 2 * cells)
    step = step.withColumn(out, F.when(F.size("_in") == 0, whole).otherwise(F.array_join(F.transform("_sets", code), "")))
    return step.drop("_every", "_in", "_sets")


def likeness(a: Column, b: Column, cells: int = 32) -> Column:
    at = F.sequence(F.lit(0), F.lit(2 * cells - 1))

    def step(acc: Column, i: Column) -> Column:
        x, y = F.substring(a, i * 4 + 1, F.lit(4)), F.substring(b, i * 4 + 1, F.lit(4))
        used = (x != "----") | (y != "----")
        return F.struct((acc["same"] + (used & (x == y)).cast("int")).alias("same"), (acc["used"] + used.cast("int")).alias("used"))

    start = F.struct(F.lit(0).alias("same"), F.lit(0).alias("used"))
    return F.when(a == b, F.lit(1.0)).otherwise(F.aggregate(at, start, step, lambda acc: acc["same"] / acc["used"]))


def with_next(docs: DataFrame, keyed: tuple[str, ...], per_bucket: int = 4096) -> DataFrame:
    """`docs` (doc_id, text and the columns `keyed`) with next_text and next_<keyed>: those of the row that follows by
    descending doc_id (equal ids by text; null ids last), of the first after the last.

    Rows are dealt by ranges of doc_id whose bounds are ids that occur; the row on a bound is also dealt to the range
    above it, as the one that follows there. So each range is a bounded window, and no task holds all rows."""
    n = docs.count()
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    parts = min(16384, max(1, n // per_bucket))
    edges = docs.select(key.alias("k")).agg(F.percentile_approx("k", [(i + 1) / parts for i in range(parts - 1)] or [0.5], 100_000).alias("e"), F.max("k").alias("top")).collect()[0]
    bounds = sorted({*(edges["e"] or []), edges["top"]} - {None}) if n else []
    bounds = bounds[-1:] if parts == 1 else bounds
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = F.array(*map(F.lit, bounds[step - 1 :: step] or [0])), F.array(*[F.array(*map(F.lit, bounds[i : i + step])) for i in range(0, max(1, len(bounds)), step)] if bounds else [F.array(F.lit(0))])
    below = lambda arr, k: F.size(F.filter(arr, lambda b: b < k))
    cell = F.least(below(coarse, F.col("k")), F.size(fine) - 1)
    bucket = cell * step + below(F.element_at(fine, cell + 1), F.col("k"))
    many = max(1, len(bounds))
    edge = F.array_contains(F.element_at(fine, cell + 1), F.col("k"))
    dealt = docs.withColumn("k", key).withColumn("at", bucket)
    dealt = dealt.withColumn("copy", F.explode(F.when(edge, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    dealt = dealt.withColumn("at", F.when(F.col("copy"), (F.col("at") + 1) % many).otherwise(F.col("at")))
    # Descending ids; the copy from the range below comes last. In the lowest range it is the very first row of all.
    order = Window.partitionBy("at").orderBy("copy", F.desc("k"), "text")
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *keyed)})
    return out.where(~F.col("copy")).drop("k", "at", "copy")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, cells: int = 32, rare: float = 0.01, common: float = 0.1) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = lexicon(texts, rare, common)
    marked = add_fingerprint(texts, "text", "fingerprint", table, cells)
    both = with_next(marked, ("fingerprint",)).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    both = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "fingerprint", "next_fingerprint")
    both = add_fingerprint(both, "edited", "edited_fingerprint", table, cells)
    near = {name: likeness(F.col("fingerprint"), F.col(other), cells) for name, other in (("near_edited", "edited_fingerprint"), ("near_next", "next_fingerprint"))}
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", *(c.alias(name) for name, c in near.items()))


def oracle_sql(cells: int = 32, rare: float = 0.01, common: float = 0.1) -> str:
    """DuckDB SQL for the rows of `fingerprints`."""
    words = "list_distinct(list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda t: t <> ''))"
    digits = lambda t, at: f"(('0x' || substr(md5({t}), {at}, 2))::INT % {cells})"
    code = lambda ts: f"CASE WHEN len({ts}) = 0 THEN '----' ELSE substr(md5(array_to_string({ts}, ' ')), 1, 4) END"
    sets = lambda at: f"list_transform(range({cells}), lambda k: list_filter(ins, lambda t: {digits('t', at)} = k))"
    near = lambda x, y: f"CASE WHEN {x} = {y} THEN 1.0 ELSE len(list_filter(range({2 * cells}), lambda i: substr({x}, i * 4 + 1, 4) <> '----' AND substr({x}, i * 4 + 1, 4) = substr({y}, i * 4 + 1, 4)))::DOUBLE / len(list_filter(range({2 * cells}), lambda i: substr({x}, i * 4 + 1, 4) <> '----' OR substr({y}, i * 4 + 1, 4) <> '----')) END"
    return f"""WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS rid FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
nx AS (SELECT *, coalesce(lead(text) OVER (ORDER BY rid), first_value(text) OVER (ORDER BY rid)) AS follows, coalesce(lead(rid) OVER (ORDER BY rid), 1) AS next_rid FROM d),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(follows, 1, length(text) // 2) AS edited FROM nx),
w AS MATERIALIZED (SELECT rid, 0 AS which, {words.format("text")} AS ts FROM e UNION ALL SELECT rid, 1, {words.format("edited")} FROM e),
lex AS MATERIALIZED (SELECT t FROM (SELECT unnest(ts) AS t FROM w WHERE which = 0) GROUP BY t HAVING count(*) >= greatest(1, ceil({rare} * (SELECT count(*) FROM d))) AND count(*) <= greatest(1, floor({common} * (SELECT count(*) FROM d)))),
i AS (SELECT rid, which, list(t ORDER BY t) AS ins FROM (SELECT rid, which, unnest(ts) AS t FROM w) JOIN lex USING (t) GROUP BY rid, which),
f AS MATERIALIZED (SELECT w.rid, w.which, CASE WHEN ins IS NULL THEN repeat(substr(md5(array_to_string(list_sort(ts), ' ')), 1, 4), {2 * cells})
  ELSE array_to_string(list_transform(list_concat({sets(1)}, {sets(3)}), lambda s: {code("s")}), '') END AS fp FROM w LEFT JOIN i USING (rid, which))
SELECT e.doc_id, length(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, {near("a.fp", "b.fp")} AS near_edited, {near("a.fp", "c.fp")} AS near_next
FROM e JOIN f a ON a.rid = e.rid AND a.which = 0 JOIN f b ON b.rid = e.rid AND b.which = 1 JOIN f c ON c.rid = e.next_rid AND c.which = 0"""
