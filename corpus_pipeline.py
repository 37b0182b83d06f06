"""From raw documents to token-id files: filter, deduplicate, decontaminate, mix, encode.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, mixing, neardup, queries, tokens, toxicity
from lattica.llm.workspace import Workspace, discard_results, results, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores at 0.3 or more go."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest id stays.

    Only rows to be dropped are joined, by id and text: of rows that share an id each
    goes or stays with its own class. A class of null ids only stays whole; rows that
    repeat a kept id in its class stay; a null id never beats another.
    """
    rows = neardup.near_duplicates(docs, with_hash=True).groupBy("doc_id", "text_hash").agg(F.bool_or("kept").alias("kept"))
    drop = rows.where("not kept").select(F.col("doc_id").alias("__dropped"), F.col("text_hash").alias("__hash"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__dropped")) & (neardup.hash_of_text() == F.col("__hash"))
    return docs.join(drop, same, "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return decontaminate.drop_leaked(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.mix_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the mix, which stay in the shared folder, and what they hold per
    document and copy."""
    folder = f"{shared_dir(spark)}/lattica/corpus-{uuid.uuid4().hex}"
    return tokens.encode_and_read_back(docs, queries.tokenizer_path(), folder)


STAGES = [
    ("toxicity", reject_toxic),
    ("near-duplicates", keep_one_of_each_class),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token ids", write_token_ids),
]

#: The network, the hashed signatures and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what operators leave between them is deleted."""
    ws = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = results()
        done = ws.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard_results(spark, before)
        if docs.inputFiles() and docs.inputFiles()[0].startswith(ws.root):
            ws.drop(docs)
        docs = done
    return ws.finish(docs)
