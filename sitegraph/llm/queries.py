"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitegraph.llm import quality_rules, secret_scan
from sitegraph.llm.byte_bpe import encode_documents
from sitegraph.llm.common import documents
from sitegraph.llm.fingerprints import fingerprinted
from sitegraph.llm.jaccard_join import jaccard_classes
from sitegraph.llm.language import identify
from sitegraph.llm.license_scan import license_matches
from sitegraph.llm.packing import pack_documents
from sitegraph.llm.quality_model import quality_scores
from sitegraph.llm.token_counts import token_counts
from sitegraph.llm.topk_search import ORACLE as TOPK_ORACLE
from sitegraph.llm.topk_search import top_k
from sitegraph.llm.vector_codes import encode as vector_codes
from sitegraph.llm.whitening import whiten
from sitegraph.session import fresh_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), BYTE_BPE, public_tokenizers.PATTERN)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), WORD_BPE, fresh_path(spark, "token-counts"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = secret_scan.fit(docs, secret_scan.weak_labels(secret_scan.findings(docs)))
    return secret_scan.judged_findings(docs, model)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged_documents(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), WORD_BPE)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(documents(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(embeddings(spark, sf_dir)).drop("eigenvalue")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(embeddings(spark, sf_dir)).select("query_id", "rank", "vec_id", "score")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(embeddings(spark, sf_dir)).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_syncmer_fingerprints": op10_syncmer_fingerprints,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_exact_topk": op12_exact_topk,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {"op7_quality_rules": quality_rules.ORACLE, "op12_exact_topk": TOPK_ORACLE}
