"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes all rows that the one before kept, and its decisions take effect: documents in no
known language go, documents that fail the quality rules (or whose host does) go, one document of each
near-duplicate class stays, secrets are masked, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegraph.llm import jaccard_join, language, packing, quality_rules, secret_scan
from sitegraph.llm.common import Scratch, documents
from sitegraph.llm.queries import WORD_BPE
from sitegraph.session import cut


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs, language.training_part())
    return language.known_documents(docs, model)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = secret_scan.fit(docs, secret_scan.weak_labels(secret_scan.findings(docs)))
    return secret_scan.masked(docs, model)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("jaccard_near_duplicates", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL expresses neither the models nor the tokenizer; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`; what they hand on is written to the shared folder and removed at the end."""
    with Scratch(spark) as scratch:
        docs = documents(spark, sf_dir)
        for _, stage in STAGES[:-1]:
            docs = scratch.keep(stage(spark, docs, sf_dir))
        return cut(STAGES[-1][1](spark, docs, sf_dir))
