"""A corpus pipeline of five operators: toxicity, language ID, near-duplicates, mixing, SentencePiece.

Each stage works on all that the one before it kept; all but the last return the columns of documents, whatever further columns there are and
whatever they are called. Rows with null ids, sources or languages take part like others. Null and empty texts pass the first stage, have no
language and go in the second. Repeated rows (equal id and text) are one group of the third stage. Ties go to the smallest id, then to the hash of
the text. An empty table gives an empty result, and without labels or languages to learn from a stage rejects nothing but texts without letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom import ship
from spanloom.llm import langid_cnn, minhash_join, mixing, sentencepiece_wfst, toxicity
from spanloom.llm.common import crc_mod, cut, scope, table
from spanloom.llm.queries import piece_model
from spanloom.scratch import settle


def _begin(spark: SparkSession) -> None:
    """Before each stage: the package is on its way to the executors, and what the stage before left on their heaps goes."""
    ship.ensure(spark)
    settle(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose toxicity scores 0.3 or more. The lexicon is learnt from the labels outside the held-out quarter."""
    _begin(spark)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2))
    return toxicity.keep_clean(docs, lexicon)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and those whose language scores less than all but 0.1 % of the held-out fifth's right ones."""
    _begin(spark)
    held_out = crc_mod("doc_id", 5) == 0
    net = langid_cnn.fit(docs.where(~held_out))
    return langid_cnn.keep_known(docs, net, langid_cnn.floor(docs.where(held_out), net))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: words in fives, similarity 0.8 or more, linked directly or through others."""
    _begin(spark)
    return minhash_join.keep_one(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come in their target weights."""
    _begin(spark)
    return mixing.repeat(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip."""
    _begin(spark)
    return sentencepiece_wfst.encode(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", to_pieces),
]

#: Learnt stages and MinHash have no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row. What a stage writes for itself, and what it read, go as soon as its rows are written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scope(spark) as held:
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
            kept = [held.pop()]  # its rows, cut last
            held += before
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
