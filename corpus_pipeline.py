"""From raw documents to packed windows, as stages that are each written and read again.

Quality rules drop junk, the n-gram Jaccard join leaves one document of each group, personal data
is taken out of the texts, sources are mixed to target weights, and what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm.common import documents, labels, sized, small_batches, stored
from callscope.llm.jaccard_join import jaccard_components
from callscope.llm.mixing import keep_mixed
from callscope.llm.packing import pack
from callscope.llm.pii import sanitised
from callscope.llm.quality_rules import fit_quality, keep_quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rejected documents go. The trees learn from the labelled documents of the corpus."""
    return keep_quality(docs, fit_quality(documents(spark, sf_dir), labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group one document stays, once: the one that names it, or without ids the one of the least mark.

    Rows are told apart by id and text, so ids may be null or repeat. Documents without words are in no
    group; of those that are equal in id and text one stays.
    """
    small_batches(spark)
    found = stored(jaccard_components(docs.select("doc_id", "text"), mark="_mark", group="_group"), "pipeline-components")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_mark")
    many = stored(found.groupBy("_group", "doc_id", "_mark").agg(F.count("*").alias("_rows")), "pipeline-rows")
    first = many.where("_group is not null").groupBy("_group").agg(F.min(row).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    ranked = many.join(sized(stored(first.select("_group", "_first"), "pipeline-first")), "_group", "left")
    stays = F.col("_first").isNull() | (row == F.col("_first"))
    named = ranked.where(F.col("_group").isNotNull() | F.col("doc_id").isNotNull())
    mark = lambda rows: rows.select(F.col("doc_id").alias("_gone"), F.col("_mark").alias("_gone_mark"))
    gone = sized(stored(mark(named.where(~stays | (F.col("_rows") > 1))), "pipeline-gone"))
    again = sized(stored(mark(named.where(stays & (F.col("_rows") > 1))), "pipeline-again"))

    def same(side: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(side["_gone"]) & (F.xxhash64(docs["text"]) == side["_gone_mark"])

    single = docs.join(gone, same(gone), "left_anti")
    return single.union(docs.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: personal data and the terms that disclose it are replaced by their kind."""
    return sanitised(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: 80 % of the tokens, spread evenly over domains, languages and sources, once at most."""
    return keep_mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of documents in windows of 4096 tokens."""
    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("jaccard_join", near_duplicates), ("pii", privacy), ("mixing", mixing), ("packing", packing),
]

#: Trees, hashes and bitsets are not SQL; the tests hold every stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written to the shared scratch folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
