"""From documents to packed sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

language_id       drops documents without letters (or text) and those where no language reaches half of the mixture
simhash_dedup     keeps the smallest id of every class of near duplicates: five-word shingles, exact Jaccard likeness of 0.8 or more;
                  candidates come from the SimHash operator's covering tables and from MinHash bands, as 3 of 64 bits miss most such pairs
decontaminate     drops documents that share a window of ten words with a benchmark item, or all of a shorter item
pii               replaces personal data by its kind; n_chars is the new length
packing           cuts the documents' ids into pieces and places them in sequences of 2048
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelgraph.llm import decontaminate, jaccard, langid, packing, pii, simhash
from wheelgraph.llm._common import table, unused, written

LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lid = unused(docs, "__lid")
    found = langid.identify(docs, langid.fit(docs), out=lid)
    return found.where((F.col(f"{lid}.lang_pred") != "und") & (F.col(f"{lid}.share") >= LEAST_SHARE)).drop(lid)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, found=jaccard.near_duplicates(docs))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", remove_benchmark),
    ("pii", redact),
    ("packing", pack),
]
#: Models and fingerprints have no SQL; tests/llm/test_pipeline.py checks every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
