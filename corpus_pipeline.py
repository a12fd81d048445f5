"""The corpus pipeline: documents in, token ids of what is worth keeping out.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents, with the values that they had, whatever further columns there are and whatever their names. Each stage decides by row: rows that share an id, or have none, are judged by
their own texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.llm import decontaminate, jaccard, language_id, sp_encode
from topograph.llm.common import cut, table, unused, without

#: A document whose language is less certain than this goes.
LEAST_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells.

    Null and empty texts, those without a letter, and those of less than LEAST_SCORE go; without a labelled row to learn from all go. Very long texts are read
    whole; equally likely languages are a matter of the operator and drop nothing; repeated rows stay or go together; an empty table stays empty.
    """
    hidden = {c: unused(docs, f"{c}_of_docs") for c in docs.columns if c.lower() in ("held_out", "lang_pred", "score")}
    told = language_id.label(docs.withColumnsRenamed(hidden))
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*(F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles, that of the smallest id.

    A null id comes last; between different texts under the smallest id, the smaller hash decides; of rows equal in id and text one stays. Rows without words (null,
    empty or blank texts) are like nothing and all stay. Very long texts are compared whole; an empty table stays empty.
    """
    return jaccard.one_of_each(docs, 5, 80, 100)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text leaks no item of the benchmark.

    Null and empty texts leak nothing and stay; null ids don't protect a text; equal texts stay or go together, and so do repeated rows; items that are null or have no
    token are matched by nothing; very long texts are read whole; with an empty benchmark all stay, and an empty table stays empty.
    """
    leaks = decontaminate.leaked(docs.select(jaccard.row_tag("text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, leaks.select("doc_id"), jaccard.row_tag("text"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, piece_ids, n_pieces and round_trip, a row for each of docs.

    Null texts have null ids, empty ones none; very long texts are encoded whole; ties go by the operator's rule; repeated rows are encoded one by one; further columns are dropped; an
    empty table gives an empty result.
    """
    return sp_encode.encode_decode(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [("language_id", keep_known_languages), ("jaccard_join", keep_one_of_near_copies), ("decontamination", keep_unleaked), ("sentencepiece", encode_texts)]
#: The classifier, the tokenizer and the template windows are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
