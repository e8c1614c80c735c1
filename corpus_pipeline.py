"""Corpus preparation: five stages over documents, each a library operator whose decisions take effect.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. The first four return the
columns of documents; the last returns doc_id and ids, the tokens of every remaining text. null ids and
texts pass as the operators' docstrings say. Rows count for themselves, also those of one identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.llm import bpe, paragraphs, quality, secrets, simhash, tiling
from basinflow.llm.common import COPY, ROW, connected_components, new_folder, table, with_rows
from basinflow.llm.queries import split_pattern, tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    return quality.filter_good(docs, quality.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest identifier.

    Groups are the SimHash components over shingles of five words. Fingerprints within 3 bits stand for
    texts that are nearly equal; texts of a Jaccard similarity of 0.8 lie about 10 bits apart, where
    fingerprints of 64 bits cannot be searched. So that such copies go too, whole documents are also
    compared as one paragraph each by the banding operator, and both kinds of links are followed.
    Rows are told apart by numbers of their own: null and repeated identifiers are documents like others,
    of which those with an identifier that occurs once stay first."""
    rows = with_rows(docs)
    parts = simhash.near_duplicates(rows.select(ROW, "text"), shingle=5, id_col=ROW)
    whole = rows.select(ROW, F.translate("text", "\n", " ").alias("text"), F.lit(0).cast("long").alias(COPY))
    similar = paragraphs.repeated(whole, least=0.8, min_words=1, id_col=ROW)
    links = parts.select("doc_id", "component_id").unionByName(similar.select("doc_id", "component_id"))
    groups = connected_components(links.select(F.col("doc_id").alias("src"), F.col("component_id").alias("dst")))
    lost = groups.where("node <> component").select(F.col("node").alias(ROW))
    return rows.join(lost, ROW, "left_anti").select(docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover an item of the benchmark."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by the kind of secret."""
    return secrets.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document."""
    return bpe.encode(docs, tokenizer_file("byte_bpe_50k.tiktoken"), split_pattern())


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", no_benchmark), ("secrets", no_secrets), ("tokens", tokens)]

#: Expectation maximisation, hashing and merges cannot be written in SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
