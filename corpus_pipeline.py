"""From raw documents to token files, in five stages; each stage's rows are written and reread as the next one's documents.

1. Quality rules: documents that a rule rejects go.
2. N-gram Jaccard join: of documents linked by 5-word shingles at 0.8, the one with the smallest id stays.
3. Benchmark decontamination: spans that match ten words of a test item are cut out; a document that is mostly such spans goes.
4. Mixing: sources come towards equal weights, the least favoured once, none more than 1.5 times; nothing is left out.
5. Token records: ids of every document in framed records, returned as read back, by ascending doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from atlasloom.llm import common, decontam, jaccard, mixing, quality, records
from atlasloom.llm.queries import bpe_path

REPETITION = 1.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, percent=80, shingle=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.cleaned(docs, common.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs, repetition=REPETITION)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "pipeline-records")
    found = records.starts(records.write(docs, bpe_path(), path))
    return records.read(found, path, digest=True, keep=("doc_id", "start")).withColumnRenamed("n_read", "n_tokens").select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", source_mixing),
    ("token records", token_records),
]

#: Shingle components and token ids are beyond SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"pipeline-{k}")
    return docs
