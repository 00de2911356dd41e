"""The documents pipeline: five stages, each written and read again by its caller.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of docs. Stages decide on keys (storage.row_key: 128 bits of
a row's values) and find the rows by them, so that texts aren't moved more than
once. Rows with a null id are documents like others; of rows that are equal in
all columns one stands for all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, jaccard, language, mixing, toxicity
from foliant.llm.storage import cut, keyed, release, row_key, rows_of, swept


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a sure language; those without text, or with an unsure or unknown one, go.

    lang becomes the language found, so that later stages see one declared by evidence.
    """
    rows = keyed(docs)
    found = language.identify(rows.select("_a", "_b", "row.source", "row.lang", "row.text"), language.train(docs), host=F.col("source"))
    # equal rows have equal results, so one row for each key that changes
    changed = found.where(~F.col("accepted") | ~F.col("lang").eqNullSafe(F.col("language"))).groupBy("_a", "_b").agg(F.min(F.struct("accepted", "language")).alias("to"))
    out = rows.join(cut(changed, "changed"), ["_a", "_b"], "left").where("to IS NULL OR to.accepted")
    return out.select(F.when(F.col("to").isNull(), F.col("row")).otherwise(F.col("row").withField("lang", F.col("to.language"))).alias("row")).select("row.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity score is below 0.5."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = keyed(docs)
    scored = toxicity.toxicity(rows.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "row.text"), model)
    toxic = cut(scored.where("score >= 0.5").select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct(), "toxic")
    return rows.join(toxic, ["_a", "_b"], "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles at 0.8: that with the smallest id, once.

    Documents without words have no group and stay, but for repeated rows.
    Null ids come after all others, and rows of one id are told apart by
    their values, so that reruns keep the same ones.
    """
    a, b = row_key(docs)
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), a, b).alias("key"), "text")
    groups = cut(jaccard.jaccard_components(named, "key").select("doc_id", "component_id"), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id._a", "doc_id._b").distinct()
    repeated = cut(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id._a", "doc_id._b", "rows", F.lit(1).cast("long").alias("copies")), "repeated")
    # the fewer rows that go are looked up, not the many that stay; of equal rows one stays
    out = keyed(docs).join(gone.union(repeated.select("_a", "_b")), ["_a", "_b"], "left_anti").select("row.*")
    return out if repeated.isEmpty() else out.unionByName(rows_of(docs, repeated))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as systematic sampling to the sources' targets takes it."""
    return mixing.mixed_rows(docs, mixing.n_words(F.col("text")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, the token ids (little-endian unsigned 32-bit integers) and the SHA-256 of the bytes decoded from them."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode_and_decode(docs.select("doc_id", "source", "lang", "text"), ranks, pattern)
    return coded.select("doc_id", "source", "lang", "n_tokens", "token_ids", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Language models, components and byte pair merges are no SQL; the tests compare run() with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again; what a stage has read is deleted behind it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with swept() as keep:
        for name, stage in STAGES[:-1]:
            before = docs
            with swept() as hand_on:
                docs = hand_on(cut(stage(spark, docs, sf_dir), name))
            release(before)
        return STAGES[-1][1](spark, keep(docs), sf_dir)
