"""The corpus pipeline: five operators in a row over documents, each stage written and read again before the next."""

import public_tokenizers
from pyspark.sql import functions as F

from lodestone.llm import op2_bpe, op4_substring, op7_language, op8_simhash, op10_mixing
from lodestone.llm.common import dropping, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark, docs, sf_dir):
    """Rejected documents go: those without a letter, and those far from every language's centroids."""
    return op7_language.identify(docs, op7_language.fit_documents(docs)).where(~F.col("rejected")).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """Of each group of near copies the document with the smallest id stays."""
    return op8_simhash.keep_one(docs).select(*COLUMNS)


def substring(spark, docs, sf_dir):
    """Repeated passages go; documents without one keep their text as it is."""
    out = op4_substring.substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark, docs, sf_dir):
    """A document comes once for each epoch that takes it; those that none takes go."""
    out = op10_mixing.mixed(docs).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark, docs, sf_dir):
    """Ids of each text and the digests of ids and of the bytes that they decode to."""
    return op2_bpe.encoded(docs, public_tokenizers.path(op2_bpe.VOCABULARY)).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring", substring), ("mixing", mixing), ("bpe", encode)]

#: SQL can't express the classifier, the fingerprints or the encoding; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        docs = dropping(lambda: stored(stage(spark, docs, sf_dir), f"pipeline-{name}"))
