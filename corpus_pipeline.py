"""The corpus pipeline: language, near duplicates, decontamination, mixture, token files.

Every stage works on all that the stage before it kept, and its decisions take effect. All but the last return the
columns of documents. SQL can't express the stages (a trained model, minhash verification to components, an SVD, raking to
convergence, a tokenizer), so ORACLE_SQL is None and tests hold each against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import crf, decontam, minhash, raking, tokens
from tessera.llm.common import materialize

SHINGLE_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a letter; those of no language (null or empty text, no letters) go.

    That is all this stage rejects: the model's label and score decide nothing, a document with one letter stays however
    low its score, and the mixture goes by the table's own lang. Columns stay as they are, whatever their names; repeated
    rows stay or go together, however long the text; an empty table stays empty.
    """
    model = crf.learn(docs)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text")
    return crf.identify(packed, model).filter(F.col("lang_pred") != crf.UND).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; all that are in no group.

    Rows with a null doc_id stay, as do null and empty texts; rows repeated under one doc_id stay or go together. Other
    columns, whatever their names, stay as they are. An empty table stays empty.
    """
    found = minhash.near_duplicates(docs, n=SHINGLE_WORDS)
    go = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_go")).distinct()
    return docs.join(go, docs["doc_id"] == go["_go"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; nulls, repeats, long items and clashing names as decontaminate() says."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their cells' calibrated probabilities, with their columns as they were, whatever their names; null
    margins, texts without words, repeats and empty tables as raking.mix() says."""
    return raking.draw(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and a row per document read back from them; nulls, repeats and empty tables as
    tokens.write_tokens() says."""
    return tokens.token_output(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_files", token_files)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
