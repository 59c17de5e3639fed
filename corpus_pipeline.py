"""A corpus pipeline of four stages; each reads what the one before it has kept.

Every stage takes (spark, docs, sf_dir) and calls one operator of evograph.llm; all but the last return
the columns of documents. Stages hand over Parquet tables in the folder that driver and executors share.

Defined cases, for every stage: a null text counts as an empty one; rows without an id take part and are kept or
dropped by their text; texts of any length are taken whole; an empty table gives an empty one; further columns,
whatever their names, pass through all stages but the last. Labels that are missing, null or of one kind alone
make the first two stages keep or drop all alike (see toxicity.fit, quality_knn.fit).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evograph.llm import packing, quality_knn, simhash, toxicity
from evograph.llm.common import load, remove, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. Equal texts stay or go together; without labels of both kinds, and of positive ones, all stay."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest neighbours vote down go. Equal texts stay or go together; without labelled rows all stay."""
    return quality_knn.keep_good(docs, quality_knn.fit(docs, load(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays (null ids last). Texts without words are one group; of rows equal in id and text one stays."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left goes into bins of fixed capacity, a row a piece. A text without words is an item of no length; equal rows go into different bins."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_dedup", drop_near_copies), ("packing", pack)]

#: Learned models, XXH64 and a greedy search decide: SQL can't say it; test_pipeline_is_brute_force holds the ids that stay against all pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; a table goes when the next one is whole."""
    docs, last = load(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            if last is not None:
                remove(spark, last)
            last = path
    return docs
