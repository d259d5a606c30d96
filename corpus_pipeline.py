"""A corpus pipeline of five stages, from raw documents to packed sequences.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the
last return the columns of ``documents``.

Null texts count as empty: the first stage drops them, as it does all texts of fewer than 50
words. Very long texts are taken whole. Of rows equal in id and text one stays; ties go to the
least id. Null ids, languages and sources are values of their own. An empty table passes
through every stage as one. Further columns of any names are passed on by all but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.common import ensure_checkpoint_dir, read_table
from massloom.llm.op1_packing import pack_documents
from massloom.llm.op3_quality_rules import quality_verdicts
from massloom.llm.op5_secrets import redact_secrets
from massloom.llm.op6_jaccard_join import keep_one_of_each_class
from massloom.llm.op8_mixing import mix_plan


def whole(docs: DataFrame) -> Column:
    """All columns as one, so that their names clash with none of an operator's."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are outliers go."""
    rows = docs.select("text", "lang", "source", whole(docs).alias("row"))
    return quality_verdicts(rows, ["row"], wide=True).where("kept").select("row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one_of_each_class(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mark; all documents stay."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return redact_secrets(docs.select("text", others.alias("row"))).select(*(own.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to three times. Any column names do."""
    plan = mix_plan(docs.select("doc_id", "text", "source", whole(docs).alias("row")), ["row"], wide=True)
    return plan.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("secret_scans", secret_scans), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: Tokenizing and near-copy classes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
