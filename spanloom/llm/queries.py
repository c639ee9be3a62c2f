"""The registered queries of the ten operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, imatch, langid_cnn, license_scan, minhash_join, mixing, permutation_index, preference, sentencepiece_wfst, toxicity
from .common import crc_mod, table

#: Where the public vocabulary files lie; read by the driver and sent along with the tasks.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def piece_model(path: str = PIECES) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_wfst.encode(table(spark, sf_dir, "documents"), piece_model())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.assembled(preference.rows_of(preference.against_next(table(spark, sf_dir, "conversations"))))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 4) == 2
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0
    return langid_cnn.predict(docs, langid_cnn.fit(docs.where(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_license_scan, op3_permutation_index, op4_imatch, op5_preference, op6_minhash, op7_toxicity, op8_mixing, op9_language_id, op10_ctw)}

ORACLES = {
    "op2_license_scan": license_scan.oracle_sql(),
    "op3_permutation_index": permutation_index.oracle_sql(),
    "op4_imatch": imatch.oracle_sql(),
    "op5_preference": preference.oracle_sql(),
    "op6_minhash": minhash_join.oracle_sql(85),
    "op8_mixing": mixing.oracle_sql(),
}
