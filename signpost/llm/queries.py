"""The registered queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from signpost.llm import (
    alignment,
    bpe,
    language,
    mixing,
    periodic,
    pii,
    quality_rules,
    sharding,
    simhash,
    sketches,
    suffix_dedup,
    toxicity,
    transducer,
)
from signpost.llm.exprs import hex64, let, positions, words

SHARD_COUNT = 8
TOXIC_FROM = 0.3
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _remainder(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n


def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    coded = bpe.encode(_documents(spark, sf), bpe.read_ranks(RANKS), with_decoded=True)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    documents = _documents(spark, sf)
    samples = language.fit(documents.filter(_remainder("doc_id", 5) != 0))
    return language.identify(documents, samples).select(
        "doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score"
    )


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf)).select(
        "doc_id", hex64(F.col("_fp")).alias("fingerprint"), "component_id"
    )


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    documents = _documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(_remainder("doc_id", 4) != 2)
    model = toxicity.fit(documents, labels)
    scored = toxicity.with_score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (_remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op10_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    return suffix_dedup.without_repeats(_documents(spark, sf)).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_private(_documents(spark, sf), min_letters=1)
    names = F.array(*[F.lit(k) for k in (*pii.KINDS, pii.TERM)])
    terms = F.transform(
        "terms", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    )

    # a lambda of two arguments would get the place in the array as its second
    def count(number: int):
        return F.size(F.filter("base", lambda x: x["k"] == number)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
        F.sha2(pii.span_text(F.col("base"), names), 256).alias("base_sha256"),
        pii.span_text(F.sort_array(F.concat("base", terms)), names).alias("spans"),
    )


def op5_sketches(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.edited_likeness(_documents(spark, sf)).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketches.fingerprint(F.col("sketch")).alias("fingerprint"),
        sketches.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_rows(_documents(spark, sf), SHARD_COUNT).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf)).drop("rejected_by")


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_words(_documents(spark, sf))


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    models = transducer.read_model(BYTE_BPE), transducer.read_model(PIECE_BPE)
    groups = alignment.aligned(_documents(spark, sf), *models)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return alignment.with_counts(
        groups.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times")
    )


def op12_transducer(spark: SparkSession, sf: str) -> DataFrame:
    model = transducer.read_model(BYTE_BPE)
    coded = transducer.encode(_documents(spark, sf), model, with_decoded=True)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def looped(documents: DataFrame) -> DataFrame:
    """``doc_id`` and text; in a tenth of the texts (by hash of the id) a tail repeats its first words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def turned(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(positions(n), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    text = let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, turned(w)).otherwise(""))
    return documents.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.periodic_runs(looped(_documents(spark, sf)))
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("_best")
    return found.withColumn("_best", F.array_max(order)).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-best["s"]).alias("start"),
        best["l"].alias("length"),
        (-best["p"]).alias("period"),
        F.floor(best["l"] * 1000 / -best["p"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_language": op2_language,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_sketches": op5_sketches,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_suffixes": op10_suffixes,
    "op11_alignment": op11_alignment,
    "op12_transducer": op12_transducer,
    "op13_runs": op13_runs,
}

SQL: dict[str, str] = {"op8_quality": quality_rules.JUDGE_SQL}
