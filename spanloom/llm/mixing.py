"""Mixing sources to target weights. Main path: DataFrame functions only.

1. Sizes are words. The words of a source stand in one stream, its documents in an order scattered by id, and the
   stream is cut into blocks of `block` words (the last may be shorter).
2. Sources by code point, null last, weigh `weights`, repeating, and share `total` times all words; a target stops at
   `most` times its source's size, and the excess is reshared by weight until none is above (water filling). A source's quota is
   the number of block slots that its target needs; the last slot is cut so that the target is met to the word.
3. The mix has as many slots as all quotas together, `shard_slots` to an output shard. Each slot draws its source with the quotas'
   probabilities, so a shard's source counts are a multinomial draw. The slots that a source drew are numbered through the shards. What it
   drew above its quota (about the square root of all slots) goes over to the sources that drew too little, in order.
4. Slot j of a source takes block p(j mod blocks) of pass j div blocks, where p is a permutation of the source's block
   numbers that is computed, not stored (swap-or-not: it permutes any range exactly). Within a pass each block comes
   once, so no document is taken more than `most` times whole.
5. Documents and slots meet by an equi-join on (source, block). `shards` gives the mix itself: which words of which document
   stand in which slot of which shard. `mix` adds up what is taken of each document, `repeat` repeats whole documents.

Positions in the streams are sums over (source, bucket) first and over a source's buckets next, so that no task holds a
source; a bucket holds about `bucket` different rows, and equal rows (id, source and size) pass as one with a count. A document without
words takes part with size 0 and takes nothing. Each row is a document: repeated rows take their own places. Null ids and null
sources are kept. Everything is a function of the rows alone, so reruns agree. Words are [^\\x20\\x09-\\x0D]+; a null text has none. Other
columns are not looked at. There is one row a source in a few plans and in an array of
each plan of slots; nothing else is sent to all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (3, 1, 2)
ROUNDS = 24
RUN = 4096  # shards in one window of their running counts


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def scattered(doc_id: Column) -> Column:
    """A number below 2**31 that looks random, from integer arithmetic that any SQL engine has."""
    low = F.pmod(F.coalesce(doc_id, F.lit(-1)), F.lit(2147483647))
    once = F.pmod(low * 1664525 + 1013904223, F.lit(2147483647))
    return F.pmod(once * 1103515245 + 12345, F.lit(2147483647))


def permuted(j: Column, n: Column, seed: Column, back: bool = False) -> Column:
    """Position j of 0..n-1 under the swap-or-not permutation of that seed: in each round j may swap with key - j,
    by a bit that both of them compute alike. `back`: under its inverse, which takes the rounds in reverse."""
    key = lambda r: F.pmod((seed * 31 + r) * 1103515245 + 12345, F.lit(2147483647))

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(key(r), n) - x + n, n)
        top = F.pmod(F.greatest(x, other), F.lit(2147483647))
        bit = F.pmod(F.floor(F.pmod((top + key(r + 101)) * 1664525 + 1013904223, F.lit(2147483647)) / 65536), F.lit(2)) == 1
        return F.when(bit, other).otherwise(x)

    first, last = (ROUNDS - 1, 0) if back else (0, ROUNDS - 1)
    return F.aggregate(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")), j.cast("long"), step)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """source, source_size, rows, rank (from 0), weight and target of each source of `sized` (source, size, copies); a source without words has target 0.
    `total` is a fraction. All arithmetic up to the last division is in whole numbers."""
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("rank", F.row_number().over(by_name).cast("long") - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    full = most * F.col("source_size")
    ratio = Window.orderBy(full / F.col("weight"), "rank")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    num, den = total
    sources = sources.withColumns({
        "left": num * F.sum("source_size").over(everything) - den * F.coalesce(F.sum(full).over(before), F.lit(0)),
        "weigh": F.sum("weight").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })  # what is still to be shared, times den, and the weights that share it, if all before are full
    # The first source (by ratio) whose share is not above its limit ends the filling; later ones share alike.
    open_ = F.col("left") * F.col("weight") <= den * full * F.col("weigh")
    found = F.min(F.when(open_, F.struct(full / F.col("weight"), F.col("rank"), F.col("left"), F.col("weigh")))).over(everything)
    sources = sources.withColumns({"open": found, "ratio": full / F.col("weight")})
    limited = F.col("open").isNull() | (F.struct("ratio", "rank") < F.struct(F.col("open.col1").alias("ratio"), F.col("open.rank").alias("rank")))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).when(limited, full.cast("double")).otherwise(F.col("weight") * F.col("open.left") / (den * F.col("open.weigh")))
    return sources.select("source", "source_size", "rows", "rank", "weight", target.cast("double").alias("target"))


def placed(docs: DataFrame, block: int, bucket: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, rank, source_size, target and start in the source's stream of each row; sources)."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))
    sized = cut(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "sizes")  # texts are read once
    sources = cut(targets(sized, weights), "sources")
    named = sources.select(F.col("source").alias("of"), "rank", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket)).alias("buckets"))
    rows = sized.join(named, sized["source"].eqNullSafe(named["of"])).drop("of").withColumn("spread", scattered(F.col("doc_id")))
    rows = rows.withColumns({"bucket": F.pmod("spread", F.col("buckets")), "held": F.col("size") * F.col("copies")})
    within = Window.partitionBy("rank", "bucket").orderBy("spread", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy("rank", "bucket").agg(F.sum("held").alias("held")).select("rank", "bucket", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("offset"))
    rows = rows.withColumn("before", F.coalesce(F.sum("held").over(within), F.lit(0))).join(offset, ["rank", "bucket"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.select("doc_id", "source", "size", "rank", "source_size", "target", (F.col("offset") + F.col("before") + F.col("copy") * F.col("size")).alias("start")), sources


def quotas(sources: DataFrame, block: int) -> DataFrame:
    """rank, slots, blocks, passes (whole ones), rest (words of the unfinished pass), tail (words that the last block is short of) and short_at
    (its place in the unfinished pass) of each source with a target."""
    blocks, want = F.ceil(F.col("source_size") / block), F.round("target").cast("long")
    rows = sources.where(want > 0).withColumns({"blocks": blocks, "tail": blocks * block - F.col("source_size"), "want": want})
    passes = F.floor(F.col("want") / F.col("source_size"))
    rows = rows.withColumns({"passes": passes, "rest": F.col("want") - passes * F.col("source_size")})
    # Full passes, then as many blocks as the rest needs, one more if the short block is among them.
    slots = F.col("passes") * F.col("blocks") + F.when(F.col("rest") > 0, F.ceil((F.col("rest") + F.col("tail")) / block)).otherwise(0)
    return rows.select("rank", slots.cast("long").alias("slots"), "blocks", "passes", "rest", "tail", permuted(F.col("blocks") - 1, F.col("blocks"), _seed(F.col("rank"), F.col("passes")), back=True).alias("short_at"))


def _seed(rank: Column, turn: Column) -> Column:
    return rank * 977 + turn


def drawn(quota: DataFrame, shard_slots: int) -> DataFrame:
    """shard, rank, n: how many of a shard's slots each source draws."""
    spark, by_rank = quota.sparkSession, Window.orderBy("rank")
    many = quota.agg(F.coalesce(F.sum("slots"), F.lit(0))).collect()[0][0]
    upto = quota.select("rank", F.sum("slots").over(by_rank).alias("upto"))
    table = upto.agg(F.array_sort(F.collect_list(F.struct("rank", "upto")))).scalar()
    u = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double")
    slots = spark.range(0, many, 1, int(spark.conf.get("spark.sql.shuffle.partitions"))).select(F.floor(F.col("id") / shard_slots).alias("shard"), u.alias("u"), table.alias("all"))
    at = F.size(F.filter("all", lambda x: x["upto"].cast("double") * 4294967296.0 <= F.col("u") * float(many)))
    return slots.select("shard", F.element_at("all", at + 1)["rank"].alias("rank")).groupBy("shard", "rank").agg(F.count("*").alias("n"))


def slots(quota: DataFrame, block: int, shard_slots: int) -> DataFrame:
    """shard, rank, j (0 to the source's quota, each once), block, and words: how many of it, from its start, the slot takes."""
    counts = cut(drawn(quota, shard_slots), "draws")
    runs = counts.groupBy("rank", F.floor(F.col("shard") / RUN).alias("run")).agg(F.sum("n").alias("n"))
    along, within = (Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1) for by, key in ((["rank"], "run"), (["rank", "run"], "shard")))
    offset = runs.select("rank", "run", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("offset"))
    rows = counts.withColumn("run", F.floor(F.col("shard") / RUN)).join(offset, ["rank", "run"])
    rows = rows.withColumn("j0", F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    # Too many and too few: one row a source, summed up by rank.
    got = quota.join(counts.groupBy("rank").agg(F.sum("n").alias("got")), "rank", "left").select("rank", F.col("slots").alias("quota"), F.coalesce("got", F.lit(0)).alias("got"))
    got = got.withColumns({"over": F.greatest(F.lit(0), F.col("got") - F.col("quota")), "under": F.greatest(F.lit(0), F.col("quota") - F.col("got"))})
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumns({f"{c}0": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("over", "under")})
    # From here on a row becomes many: they are dealt to all tasks, which the optimiser would not do for rows as small as these.
    rows = rows.join(got.select("rank", "quota", "over0"), "rank").repartition(int(quota.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "shard")
    inside = F.least("n", F.greatest(F.lit(0), F.col("quota") - F.col("j0")))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    own = rows.where(F.col("i") < inside).select("shard", "rank", (F.col("j0") + F.col("i")).alias("j"))
    excess = rows.where(F.col("i") >= inside).select("shard", (F.col("over0") + F.col("j0") + F.col("i") - F.col("quota")).alias("e"))
    free = got.where("under > 0").agg(F.array_sort(F.collect_list(F.struct("under0", "rank", "got")))).scalar()
    to = F.element_at("all", F.size(F.filter("all", lambda x: x["under0"] <= F.col("e"))))
    moved = excess.withColumn("all", free).withColumn("to", to).select("shard", F.col("to.rank").alias("rank"), (F.col("to.got") + F.col("e") - F.col("to.under0")).alias("j"))
    every = own.unionByName(moved).join(quota.drop("slots"), "rank")
    every = every.withColumns({"pass": F.floor(F.col("j") / F.col("blocks")), "i": F.pmod("j", F.col("blocks"))})
    every = every.withColumn("block", permuted(F.col("i"), F.col("blocks"), _seed(F.col("rank"), F.col("pass"))))
    held = F.lit(block) - F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(0)
    # In the unfinished pass, slot i starts after i * block words, less the tail if the short block came before.
    start = F.col("i") * block - F.when(F.col("short_at") < F.col("i"), F.col("tail")).otherwise(0)
    words = F.when(F.col("pass") < F.col("passes"), held).otherwise(F.greatest(F.lit(0), F.least(held, F.col("rest") - start)))
    return every.select("shard", "rank", "j", "block", held.cast("long").alias("held"), words.cast("long").alias("words"))


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """`rows` of `placed`, one for each block that a document reaches into, with low and high (words of the stream, from 0)."""
    last = F.floor((F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1) / block)
    each = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    return each.withColumns({"low": F.greatest("start", F.col("block") * block), "high": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)})


def shards(docs: DataFrame, block: int = 512, bucket: int = 2048, weights: tuple[int, ...] = WEIGHTS, shard_slots: int = 1024) -> DataFrame:
    """The mix: shard, source, j (the slot's number among its source's), at (place in the slot), doc_id, first and words: words first, first + 1...
    of the document, in the order of j and at."""
    rows, sources = placed(docs, block, bucket, weights)
    taken = slots(quotas(sources, block), block, shard_slots)
    met = pieces(rows, block).join(taken.hint("merge"), ["rank", "block"])
    words = F.least("high", F.col("block") * block + F.col("words")) - F.col("low")
    return met.where(words > 0).select("shard", "source", "j", (F.col("low") - F.col("block") * block).alias("at"), "doc_id", (F.col("low") - F.col("start")).alias("first"), words.alias("words"))


def _mixed(docs: DataFrame, block: int, bucket: int, weights: tuple[int, ...], shard_slots: int) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and times: how many slots take the document's first word."""
    rows, sources = placed(docs, block, bucket, weights)
    rows = cut(rows, "places")
    whole = F.col("words") == F.col("held")
    takes = slots(quotas(sources, block), block, shard_slots).groupBy("rank", "block").agg(F.sum(whole.cast("long")).alias("full"), F.sum(F.when(whole, 0).otherwise(F.col("words"))).alias("part"))
    met = pieces(rows, block).join(takes.hint("merge"), ["rank", "block"], "left")  # takes grow with the corpus; they are never broadcast
    full, part, begin = F.coalesce("full", F.lit(0)), F.coalesce("part", F.lit(0)), F.col("block") * block
    words = F.greatest(F.col("high") - F.col("low"), F.lit(0)) * full + F.greatest(F.lit(0), F.least(F.col("high") - begin, part) - (F.col("low") - begin))
    times = F.when(F.col("low") == F.col("start"), full + (F.col("low") - begin < part).cast("long"))
    met = met.withColumns({"got": words.cast("long"), "times": times})
    # (rank, start, doc_id, size) names one row; rows of size 0 can share it and then count together.
    one = met.groupBy("rank", "start", "doc_id", "size").agg(F.first("source").alias("source"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("got").alias("taken"), F.max("times").alias("times"), F.count("*").alias("rows"))
    copies = F.when(F.col("size") == 0, F.col("rows")).otherwise(1)
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long")))).select("doc_id", "source", "size", "source_size", "target", "taken", "times")


def mix(docs: DataFrame, block: int = 512, bucket: int = 2048, weights: tuple[int, ...] = WEIGHTS, shard_slots: int = 1024) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words of the document in the mix, repeats counted)."""
    return _mixed(docs, block, bucket, weights, shard_slots).drop("times")


def repeat(docs: DataFrame, block: int = 512, bucket: int = 2048, weights: tuple[int, ...] = WEIGHTS, shard_slots: int = 1024) -> DataFrame:
    """The rows of `docs`, with all their columns, each as often as slots of the mix take its first word: whole documents, so that a source's words
    come near its target on average. Rows of equal doc_id, source and size share what they get, rounded up or down by a pseudorandom number; rows
    without words are never taken."""
    takes = _mixed(docs, block, bucket, weights, shard_slots).where("size > 0").groupBy("doc_id", "source", "size").agg((F.sum("times") / F.count("*")).alias("_share"))
    takes = takes.where("_share > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("size").alias("_size"), "_share")
    # The document's own columns travel inside one, so that their names don't matter.
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 20)) / (1 << 20)
    marked = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_own"), F.col("source").cast("string").alias("_source"), n_words(F.col("text").cast("string")).alias("_n"), chance.alias("_chance"))
    met = marked.join(takes, F.col("_own").eqNullSafe(F.col("_id")) & F.col("_source").eqNullSafe(F.col("_from")) & (F.col("_n") == F.col("_size")))
    copies = F.floor(F.col("_share") + F.col("_chance")).cast("int")
    return met.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select("_row.*")


def oracle_sql(block: int = 512, bucket: int = 2048) -> str:
    """DuckDB SQL for the rows of `mix` with its default weights."""
    m = 2147483647
    key = lambda seed, r: f"((({seed}) * 31 + ({r})) * 1103515245 + 12345) % {m}"

    def perm(j: str, n: str, seed: str) -> str:
        other = f"(({key(seed, 'r')}) % {n} - x + {n}) % {n}"
        bit = f"(((greatest(x, {other}) % {m} + {key(seed, 'r + 101')}) * 1664525 + 1013904223) % {m} // 65536) % 2 = 1"
        return f"list_reduce(range({ROUNDS}), lambda x, r: CASE WHEN {bit} THEN {other} ELSE x END, ({j})::BIGINT)"

    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  ((((CASE WHEN doc_id IS NULL THEN -1 ELSE doc_id END) % {m} + {m}) % {m} * 1664525 + 1013904223) % {m} * 1103515245 + 12345) % {m} AS spread FROM documents),
bk AS (SELECT source, greatest(1, ceil(count(*) / {bucket}.0))::BIGINT AS buckets FROM (SELECT DISTINCT doc_id, source, size FROM d) GROUP BY source),
p AS (SELECT d.*, row_number() OVER () AS rid, (sum(size) OVER (PARTITION BY d.source ORDER BY spread % buckets, spread, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start FROM d JOIN bk ON d.source IS NOT DISTINCT FROM bk.source),
s0 AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][(rank % 3) + 1]::BIGINT AS w FROM s0),
s2 AS (SELECT *, (3 * sum(ss) OVER () - 2 * coalesce(sum(2 * ss) OVER (ORDER BY 2 * ss / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest, (sum(w) OVER (ORDER BY 2 * ss / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weigh FROM s1),
o AS (SELECT * FROM s2 WHERE rest * w <= 4 * ss * weigh ORDER BY 2 * ss / w, rank LIMIT 1),
s3 AS (SELECT s2.source, s2.ss, s2.rank, CASE WHEN s2.ss = 0 THEN 0.0 WHEN o.rank IS NULL OR (2 * s2.ss / s2.w, s2.rank) < (2 * o.ss / o.w, o.rank) THEN (2 * s2.ss)::DOUBLE ELSE (s2.w * o.rest)::DOUBLE / (2 * o.weigh) END AS target FROM s2 LEFT JOIN o ON true),
s4 AS (SELECT *, round(target)::BIGINT AS want, ceil(ss / {block}.0)::BIGINT AS blocks, ceil(ss / {block}.0)::BIGINT * {block} - ss AS tail FROM s3 WHERE round(target) > 0),
s5 AS (SELECT *, want // ss AS passes, want - (want // ss) * ss AS rest FROM s4),
s6 AS (SELECT *, passes * blocks + CASE WHEN rest > 0 THEN ceil((rest + tail) / {block}.0)::BIGINT ELSE 0 END AS slots FROM s5),
sl AS (SELECT rank, j, j // blocks AS pass, {perm('j % blocks', 'blocks', 'rank * 977 + j // blocks')} AS block, blocks, tail, rest, passes FROM s6, unnest(range(slots)) AS u(j)),
sh AS (SELECT rank, j - passes * blocks AS short_at FROM sl WHERE pass = passes AND block = blocks - 1),
t0 AS (SELECT sl.*, CASE WHEN block = blocks - 1 THEN {block} - tail ELSE {block} END AS held, (j - passes * blocks) * {block} - CASE WHEN short_at < j - passes * blocks THEN tail ELSE 0 END AS at_word FROM sl LEFT JOIN sh USING (rank)),
t AS (SELECT rank, block, held, CASE WHEN pass < passes THEN held ELSE greatest(0, least(held, rest - at_word)) END AS words FROM t0),
x AS (SELECT p.rid, sum(greatest(0, least(p.start + p.size, t.block * {block} + t.words) - greatest(p.start, t.block * {block}))) AS taken
  FROM p JOIN s3 ON p.source IS NOT DISTINCT FROM s3.source JOIN t ON t.rank = s3.rank AND p.start < (t.block + 1) * {block} AND p.start + p.size > t.block * {block} GROUP BY p.rid)
SELECT p.doc_id, p.size, s3.ss AS source_size, s3.target, coalesce(x.taken, 0)::BIGINT AS taken, p.source FROM p JOIN s3 ON p.source IS NOT DISTINCT FROM s3.source LEFT JOIN x USING (rid)"""
