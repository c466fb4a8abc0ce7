"""A corpus pipeline of this repository's training-data operators.

toxicity (rejected documents go), language ID (rejected documents go), near-duplicates (one document of
each group stays), packing. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pomona.llm.common import by_ids, shared_checkpoint, table
from pomona.llm.lang_id import identify
from pomona.llm.near_dup import near_groups
from pomona.llm.packing import pack_texts
from pomona.llm.toxicity import score_toxicity

#: A language is accepted from this share of the summed likelihoods on.
LANGUAGE_SCORE = 0.5
#: Two documents are near-duplicates from this percentage of common shingles on.
NEAR_PERCENT = 80
_ROW, _KEEP = "pipeline_row", "pipeline_keep"


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and a column that tells their rows apart: doc_id, or where it is null or repeated a row number.

    Row numbers are written to shared storage before anything uses them, so they stay the same if tasks run again.
    """
    odd = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if odd.isEmpty():
        return docs, "doc_id"
    return shared_checkpoint(docs.withColumn(_ROW, F.monotonically_increasing_id())), _ROW


def _kept(docs: DataFrame, row: str, decisions: DataFrame) -> DataFrame:
    """The rows that have a decision to keep, without the row number. decisions: (row, keep).

    The rejected rows are the smaller side and are joined away.
    """
    return by_ids(docs, decisions.where(~F.col(_KEEP)).select(row), "left_anti").drop(_ROW)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below one half.

    Each row is judged by its own text, whatever id it has or shares; a null text is the empty text and is
    judged too; an empty table stays empty; other columns are kept as they are.
    """
    docs, row = _rows(docs)
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), carry=(row,) if row == _ROW else ())
    return _kept(docs, row, scored.select(row, (F.col("predicted") == 0).alias(_KEEP)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised.

    Each row is judged by its own text; a null text and one without letters has no language and goes; without
    anything to learn from all go; an empty table stays empty; other columns are kept as they are.
    """
    docs, row = _rows(docs)
    found = identify(docs, carry=(row,) if row == _ROW else ())
    return _kept(docs, row, found.select(row, ((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE)).alias(_KEEP)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Where ids are null or repeated, every row is a document of its own and the first row of a group stays, so
    of repeated rows one stays. Texts without words (null ones too) are nobody's duplicates and stay; an
    empty table stays empty; other columns are kept as they are.
    """
    docs, row = _rows(docs)
    groups = near_groups(docs, key=row, percent=NEAR_PERCENT)
    return _kept(docs, row, groups.select(row, F.col("kept").alias(_KEEP)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 2048 tokens.

    A null text is the empty text, which is the end id alone; null ids and repeated rows are packed as documents of
    their own; an empty table gives no pieces; other columns are ignored.
    """
    return pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("packing", packing)]
#: No stage but the joins is within SQL's reach; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents table; each result is written once to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared_checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
