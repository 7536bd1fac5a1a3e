"""The corpus pipeline: language ID, near-dedup, substring dedup, benchmark decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents. In every stage repeated rows are rows of their own (near_dedup keeps one of them),
an empty table gives an empty one, texts of any length are read whole, and columns of any other name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import cdc_dedup, decontam, langid, minhash, sp_codec
from skyledger.llm.common import fresh, table, written

#: Least score of a predicted language; a text below it resembles no learned language.
MIN_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones; those without letters (null texts too) or like none of them go."""
    profiles = langid.learned(docs, "text", "lang", F.col("doc_id"))
    lang, score = fresh(docs, "lang", "score")
    found = langid.identified(docs, profiles, lang=lang, score=score)
    return found.where((F.col(lang) != langid.UND) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest doc_id (a null id comes last).

    Texts that are null, empty or without words are classes of their own.
    """
    return minhash.one_of_each(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that another document keeps; those left without text go. n_chars follows the text.

    Texts that were null or empty before stay.
    """
    cdc = fresh(docs, "cdc")
    cuts = F.size(f"{cdc}.spans")
    cut = cdc_dedup.deduplicated(docs, out=cdc).where(F.col("text").isNull() | (F.trim("text") != "") | (cuts == 0))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(cuts > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long"))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"])).select(*docs.columns)


def sentencepiece_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of each document; a null text has null ids, an empty one none."""
    pieces = sp_codec.read_model(spark)
    found = sp_codec.decoded(sp_codec.encoded(docs.select("doc_id", "text"), pieces), pieces)
    return found.select("doc_id", "ids", F.size("ids").alias("n_tokens"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece_codes),
]

#: Alignments, rolling hashes and a Viterbi search: not in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
