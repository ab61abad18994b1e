"""The corpus pipeline: five stages over ``documents``, each on all that the one before it
kept. Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as
Parquet and read again as the next stage's ``docs``; all but the last give the columns of
``documents``.

1. toxicity: documents that are predicted toxic go.
2. near_duplicates: the document with the smallest id of each component stays.
3. repeats: byte strings of 400 that occur more than once are taken out of the texts.
4. decontamination: documents that hold a benchmark window go.
5. mixing: the documents that are left, with the words the mix takes of each.

Cases, for every stage: null and empty texts stay (no match, no shingle, no byte, no window;
a mix takes nothing of them). Rows with a null doc_id stay through all filters and count as
any other row. Rows that repeat an id with the same text become one in stage 2; with other
texts they go by their own text. Ties go to the smaller id. Columns beyond those of documents
are carried along, whatever their names. An empty table gives an empty result of the same
columns; without usable labels stage 1 takes its fixed starting lexicon, and an empty
benchmark takes nothing out. Very long texts are worked on whole, in bounded batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.llm import decontaminate, mixing, near, repeats, toxicity
from prospecta.llm.common import store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.without_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Learned scores, suffix arrays and hash orders aren't SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
