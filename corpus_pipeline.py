"""The corpus pipeline: five stages, each an operator of codeframes.llm, each written and read again by the next.

quality rules -> language ID -> SimHash near-dedup -> secret scan -> best-fit packing.  All but the last return
the columns of ``documents``: the first drops documents and failing lines, the second documents of no language, and
writes the language that it finds to ``lang``, the third drops all but one document of each near-duplicate group, the
fourth masks secrets.  The last returns the pieces of the documents with their sequence and offset; a sequence holds
documents of one ``lang``, as the second stage found it.

Rows that repeat a doc_id are documents of their own unless their texts are near duplicates; rows without an id stay unless
they are near duplicates too; null and empty texts go at the first stage; an empty table gives no rows; columns beyond
those of ``documents`` pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeframes.llm import langid, packing, quality, secret_scan, simhash
from codeframes.llm.common import table, written
from codeframes.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), apart="lang")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_masking),
    ("best_fit_packing", packed),
]

#: Language models, XXH64 and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
