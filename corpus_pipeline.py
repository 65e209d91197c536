"""Documents to tokens: five stages, each on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signpost.llm import bpe, mixing, pii, simhash, toxicity
from signpost.llm.queries import RANKS, TOXIC_FROM
from signpost.session import scratch, shared_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic stays below the cut; null and empty texts stay.

    The score has a name that no column has, in any case of letters.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    taken, score = {c.lower() for c in docs.columns}, "score"
    while score in taken:
        score += "_"
    return toxicity.with_score(docs, model, score_col=score).filter(F.col(score) < TOXIC_FROM).drop(score)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike in 0.8 or more of its five-word shingles: the smallest id."""
    return simhash.one_per_group(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it masked in their texts."""
    return pii.sanitised(docs, min_letters=1)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the drawn blocks hold of every document: whole, or its runs of drawn words."""
    return mixing.drawn_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids (packed), their number and digest, and the digest of the ids decoded."""
    coded = bpe.encode(docs, bpe.read_ranks(RANKS), with_decoded=True)
    return coded.select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("tokens", tokenised),
]

# Compression, hashing and merging by rank have no SQL. Tests hold toxicity against planted
# insults, near_duplicates against all pairs of whole sets, personal_data on small cases,
# mixing against its targets, tokens against the library, and run() as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written to the shared folder and read again.

    What a stage wrote for itself goes when the stage is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/signpost/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
