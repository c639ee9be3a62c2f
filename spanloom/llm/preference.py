"""Preference formatting. Main path: DataFrame functions only.

Given two conversations for each pair (`chosen` and `rejected`, as tables of turns), the longest common prefix of turns is
rendered once as the prompt, and what follows on either side as its completion, masked: the spans of characters whose
tokens count in the loss (assistant turns of the completions). `format_pairs` emits one row a pair, or several for a long
one: a row holds `SEGMENT` turn numbers at most, so neither a task nor a row ever holds a whole unbounded conversation. Rows of a
pair follow one another by `segment`; spans count from the start of the row's own text. `rows_of` gives one row a turn.

Turns are aligned by their number. Rows that share pair and turn are one turn: repeated rows count once, different
ones are joined by line breaks in the order of role and text, under the smallest role. A null role is `user`, a null text
empty; rows without pair id or turn number take no part. A pair with one side only, or with equal sides, states no preference and is
left out. A side that ends with the prompt has an empty completion. Other columns are not looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .imatch import with_next

#: Turn numbers in a row of the output.
SEGMENT = 1024
SPANS = "array<struct<start:int,end:int>>"
PARTS = ("prompt", "chosen", "rejected")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def turns(table: DataFrame, key: str) -> DataFrame:
    """key, turn, role, text: one row a turn."""
    rows = table.select(F.col(key).cast("long").alias(key), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.where(F.col(key).isNotNull() & F.col("turn").isNotNull()).distinct()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy(key, "turn").agg(F.min("role").alias("role"), joined.alias("text"))


def aligned(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, turn, c and r (structs of role and text, null where a side lacks the turn) of two tables of turns."""
    sides = F.struct("role", "text")
    good, bad = turns(chosen, "pair_id").select("pair_id", "turn", sides.alias("c")), turns(rejected, "pair_id").select("pair_id", "turn", sides.alias("r"))
    return good.join(bad, ["pair_id", "turn"], "full_outer")


def rows_of(met: DataFrame) -> DataFrame:
    """One row a turn of what `aligned` gives: pair_id, part (prompt, chosen, rejected), turn, text (rendered), loss, split (the first turn
    that differs)."""
    differs = ~F.col("c").eqNullSafe(F.col("r"))
    first = met.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("split"), F.count("c").alias("cs"), F.count("r").alias("rs"))
    met = met.join(first.where("cs > 0 and rs > 0 and split is not null").select("pair_id", "split"), "pair_id")
    part = lambda name, side: F.struct(F.lit(name).alias("part"), F.col(side).alias("own"))
    parts = F.when(F.col("turn") < F.col("split"), F.array(part("prompt", "c"))).otherwise(F.array(part("chosen", "c"), part("rejected", "r")))
    rows = met.withColumn("p", F.explode(parts)).where(F.col("p.own").isNotNull())
    loss = (F.col("p.part") != "prompt") & (F.col("p.own.role") == "assistant")
    return rows.select("pair_id", F.col("p.part").alias("part"), "turn", render(F.col("p.own.role"), F.col("p.own.text")).alias("text"), loss.alias("loss"), "split")


def assembled(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """pair_id, segment (from 0, in the order of turns), split, prompt, chosen and rejected (texts), chosen_spans and rejected_spans
    ([start, end) in characters, as text `0-5,9-14`): the rows of `rows_of` put together."""
    at = F.floor(F.col("turn") / segment)
    parts = rows.groupBy("pair_id", at.alias("at"), "split", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "loss"))).alias("all"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["text"])
        span = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.transform(F.aggregate("all", start, step, lambda acc: acc["spans"]), lambda x: F.concat_ws("-", x["start"], x["end"]))
    parts = parts.select("pair_id", "at", "split", "part", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"), F.array_join(spans, ",").alias("spans"))
    of = lambda part, what: F.coalesce(F.max(F.when(F.col("part") == part, F.col(what))), F.lit(""))
    cols = [of(p, "text").alias(p) for p in PARTS] + [of(p, "spans").alias(f"{p}_spans") for p in PARTS[1:]]
    return parts.groupBy("pair_id", F.col("at").alias("segment"), "split").agg(*cols)


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of `assembled` for two tables with pair_id, turn, role, text."""
    return assembled(rows_of(aligned(chosen, rejected)))


def against_next(conversations: DataFrame) -> DataFrame:
    """Pairs from a plain table of conversations, as `aligned` gives them: each conversation is chosen over itself up to its last assistant turn,
    with that of another one in its place: of the conversation with the next smaller id that has an assistant turn (of the smallest,
    the largest). So every conversation with an assistant turn makes a pair, whichever ids there are, unless both turns are equal."""
    rows = cut(turns(conversations, "conv_id"), "turns")
    last = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("last"))
    last = cut(last.select(F.col("conv_id").alias("doc_id"), F.col("last.turn").alias("upto"), F.col("last.text").alias("text")), "replies")
    both = with_next(last, ()).select(F.col("doc_id").alias("conv_id"), "upto", F.col("next_text").alias("reply"))
    met = rows.join(both, "conv_id").withColumnRenamed("conv_id", "pair_id")
    own, other = F.struct("role", "text"), F.struct("role", F.col("reply").alias("text"))
    return met.select("pair_id", "turn", own.alias("c"), F.when(F.col("turn") < F.col("upto"), own).when(F.col("turn") == F.col("upto"), other).alias("r"))


def oracle_sql(segment: int = SEGMENT) -> str:
    """DuckDB SQL for assembled(rows_of(against_next(conversations)))."""
    piece = "'<|' || {0} || '|>' || chr(10) || {1} || '<|end|>' || chr(10)"
    return f"""WITH t AS MATERIALIZED (SELECT conv_id, turn, min(role) AS role, string_agg(text, chr(10) ORDER BY role, text) AS text FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) GROUP BY conv_id, turn),
l AS (SELECT conv_id, max(turn) AS upto, arg_max(text, turn) AS own FROM t WHERE role = 'assistant' GROUP BY conv_id),
b AS (SELECT *, coalesce(lead(own) OVER (ORDER BY conv_id DESC), first_value(own) OVER (ORDER BY conv_id DESC)) AS reply FROM l),
m AS (SELECT t.*, upto, CASE WHEN turn < upto THEN text WHEN turn = upto THEN reply END AS other FROM t JOIN b USING (conv_id)),
s AS (SELECT conv_id, min(turn) AS split FROM m WHERE other IS DISTINCT FROM text GROUP BY conv_id),
p AS (SELECT conv_id, turn, split, 'prompt' AS part, {piece.format("role", "text")} AS text, false AS loss FROM m JOIN s USING (conv_id) WHERE turn < split
  UNION ALL SELECT conv_id, turn, split, 'chosen', {piece.format("role", "text")}, role = 'assistant' FROM m JOIN s USING (conv_id) WHERE turn >= split
  UNION ALL SELECT conv_id, turn, split, 'rejected', {piece.format("role", "other")}, role = 'assistant' FROM m JOIN s USING (conv_id) WHERE turn >= split AND other IS NOT NULL),
q AS (SELECT *, floor(turn / {segment}.0)::BIGINT AS segment, (sum(length(text)) OVER (PARTITION BY conv_id, part, floor(turn / {segment}.0) ORDER BY turn))::BIGINT AS upto FROM p)
SELECT conv_id AS pair_id, segment, split, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE part = 'prompt'), '') AS prompt, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE part = 'chosen'), '') AS chosen,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE part = 'rejected'), '') AS rejected, coalesce(string_agg((upto - length(text)) || '-' || upto, ',' ORDER BY turn) FILTER (WHERE part = 'chosen' AND loss), '') AS chosen_spans,
  coalesce(string_agg((upto - length(text)) || '-' || upto, ',' ORDER BY turn) FILTER (WHERE part = 'rejected' AND loss), '') AS rejected_spans FROM q GROUP BY conv_id, segment, split"""
