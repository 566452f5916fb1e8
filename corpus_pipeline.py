"""A corpus pipeline of five stages, each a function of (spark, docs, sf_dir) that returns what it keeps.

1. language: documents that no profile fits (no letters, or far from every language) go.
2. near_duplicates: of documents that share 80 % of their five-word n-grams, and of equal rows, one stays.
3. decontamination: documents that hold a passage of the benchmark go.
4. secrets: secrets found in any encoding are replaced by their kind; every document stays.
5. tokens: token counts and digests of what is left.

All but the last return the columns of their input, whatever those are; n_chars, where there is one, follows the text.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.llm import bpe, decontam, langid, ngramjoin, secrets
from tracegrain.llm.scratch import written
from tracegrain.session import reachable

#: A text whose share of the largest out-of-place distance is above 1 less this fits no language.
LEAST_LANGUAGE_SCORE = 0.2


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    return next(c for c in itertools.chain([name], (f"{name}{i}" for i in itertools.count())) if c.lower() not in taken)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    known = langid.profiles(docs.filter(langid.is_training(F.col("doc_id"))))
    name = _unused(docs, "_language")
    found = langid.identified(docs, known, name=name)
    return found.filter((F.col(f"{name}.lang_pred") != langid.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_LANGUAGE_SCORE)).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of the least doc_id stays; of rows that agree in it, the one with the least digest of all columns."""
    reachable(spark)
    row = _unused(docs, "_row")
    keyed = docs.withColumn(row, F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))).alias("digest")))
    groups = ngramjoin.groups(keyed.select(F.col(row).alias("doc_id"), "text"), n=5, percent=80)
    kept = written(groups.filter("doc_id = component_id").select(F.col("doc_id").alias(row)).distinct(), "kept")
    # rows of one digest are equal in every column
    return keyed.join(kept, row, "left_semi").dropDuplicates([row]).drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return bpe.encode(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("tokens", tokens)]

#: SQL can express none of language profiles, alignment, decoding or byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
