"""The contract queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeframes.llm import alignment, bpe, langid, lexical, licenses, packing, quality, secret_scan, simhash, tokenstore, topk, toxicity, warc
from codeframes.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the operators take paths, only these queries choose the files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive(spark, table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op5_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tokenstore.write_store(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return tokenstore.read_documents(store)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings")).drop("query_key")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_langid, op3_simhash, op4_quality, op5_tokenstore, op6_secrets, op7_bpe, op8_packing, op9_toxicity, op10_topk, op11_alignment, op12_lexical, op13_licenses)
}

ORACLES = {
    "op1_warc": warc.ORACLE,
    "op4_quality": quality.ORACLE,
    "op6_secrets": secret_scan.ORACLE,
    "op10_topk": topk.ORACLE,
    "op12_lexical": lexical.ORACLE,
    "op13_licenses": licenses.ORACLE,
}
