"""The written index: postings in buckets by term, statistics and vocabulary as tables of their own.

A search opens the buckets of its terms alone, so it reads what its terms' postings hold, not the corpus.
Postings are made and sorted within the tasks that read the documents, and never shuffled: each task writes a
file a bucket, sorted by term, so that pages of other terms are skipped. Buckets are few, as files are tasks times buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import IndexConfig, TokenizerOptions
from lodestone.operators import grouping, index
from lodestone.sources.shared import kept, source_bytes

#: Bytes of source for a bucket, and most buckets.
BUCKET_BYTES, BUCKETS = 64 << 20, 8


def _signature(o: TokenizerOptions) -> str:
    stem = str(o.stemmer(F.col("x"))) if o.stemmer else ""
    return repr((o.lowercase, o.locale, o.punctuation, o.stop_words, stem, o.ngrams, o.separator, o.normalization))


class StoredIndex:
    """postings(term, field, id, tf, positions, field_len, bucket), terms(term, field, df, bucket), vocabulary(term, df, n_chars), stats(field, n_docs, total_len, avg_len)."""

    def __init__(self, spark, folder: str):
        self.folder = folder
        self.postings, self.terms, self.vocabulary, self.stats = (spark.read.parquet(f"{folder}/{t}") for t in ("postings", "terms", "vocabulary", "stats"))
        self.buckets = spark.read.parquet(f"{folder}/buckets").first().n

    @staticmethod
    def write(docs: DataFrame, config: IndexConfig, folder: str, id: str = "id", buckets: int = 8) -> None:
        spark, bucket = docs.sparkSession, F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        docs = index.dealt(docs, source_bytes(docs), id)
        rows = [grouping.postings(docs, f, config.tokenizer, id).withColumn("field", F.lit(f)) for f in config.searchable]
        posts = reduce(DataFrame.union, rows).select("term", "field", "id", "tf", "positions", "field_len", bucket.alias("bucket"))
        # the writer sorts by bucket, a number, which leaves the terms of a bucket in order
        posts.write.partitionBy("bucket").parquet(f"{folder}/postings")
        posts = spark.read.parquet(f"{folder}/postings")
        posts.groupBy("bucket", "term", "field").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/terms")
        if len(config.searchable) == 1:
            vocabulary = spark.read.parquet(f"{folder}/terms").select("term", "df")
        else:
            vocabulary = index.words(docs, config).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        vocabulary.withColumn("n_chars", F.length("term")).sortWithinPartitions("term").write.parquet(f"{folder}/vocabulary")
        # lengths are the sums of tf: texts aren't split again
        n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs > 0").select(F.explode(F.array(*[F.lit(f) for f in config.searchable])).alias("field"), "n_docs")
        total = posts.groupBy("field").agg(F.sum("tf").alias("total_len"))
        stats = n_docs.join(total, "field", "left").select("field", "n_docs", F.coalesce("total_len", F.lit(0)).alias("total_len"))
        stats.withColumn("avg_len", F.col("total_len") / F.col("n_docs")).coalesce(1).write.parquet(f"{folder}/stats")
        spark.range(1).select(F.lit(buckets).alias("n")).coalesce(1).write.parquet(f"{folder}/buckets")

    @classmethod
    def of(cls, source: DataFrame, config: IndexConfig, id: str = "id", docs: DataFrame | None = None) -> StoredIndex:
        """The index of a source, written when it is first asked for; docs: the same rows dealt otherwise."""
        buckets = max(1, min(BUCKETS, source_bytes(source) // BUCKET_BYTES))
        how = repr((config.searchable, id, buckets)) + _signature(config.tokenizer)
        make = lambda folder: cls.write(source if docs is None else docs, config, folder, id, buckets)
        return cls(source.sparkSession, kept(source, "index", make, how, "3"))

    def only(self, table: DataFrame, terms: list[str]) -> DataFrame:
        """Rows of the terms; their buckets are folders, so that others aren't opened."""
        at = F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in terms])
        numbers = table.sparkSession.range(1).select(at.alias("b")).first().b
        return table.where(F.col("bucket").isin(sorted(set(numbers))) & F.col("term").isin(terms))

    def scan(self, terms: list[str], fields: list[str], id: str) -> DataFrame:
        """(id, len_<field>, at_<field>) of documents with one of the terms: the ascending positions of each term."""
        rows = self.only(self.postings, terms).where(F.col("field").isin(fields))
        wanted, none = F.array(*[F.lit(t) for t in terms]), F.array().cast("array<int>")
        # a document's entries, one a term and field at most
        rows = rows.groupBy(F.col("id").alias(id)).agg(F.collect_list(F.struct("field", "term", "positions", "field_len")).alias("entries"))

        def of(f: str) -> list[Column]:
            own = F.filter("entries", lambda e: e["field"] == f)
            at = F.transform(wanted, lambda t: F.coalesce(F.get(F.filter("entries", lambda e: (e["field"] == f) & (e["term"] == t)), 0)["positions"], none))
            return [F.get(own, 0)["field_len"].alias(f"len_{f}"), at.alias(f"at_{f}")]

        return rows.select(id, *[c for f in fields for c in of(f)])

    def row(self, terms: list[str], fields: list[str]) -> DataFrame:
        """One row of statistics: documents, mean length of each field, document frequency of each term in it."""
        own = lambda c, f: F.max(F.when(F.col("field") == f, F.col(c))).cast("double")
        base = self.stats.agg(F.max("n_docs").cast("double").alias("n"), *[own("avg_len", f).alias(f"avg_{f}") for f in fields])
        found = self.only(self.terms, terms).agg(F.collect_list(F.struct("field", "term", "df")).alias("entries"))
        wanted = F.array(*[F.lit(t) for t in terms])
        df = lambda f: F.transform(wanted, lambda t: F.coalesce(F.get(F.filter("entries", lambda e: (e["field"] == f) & (e["term"] == t)), 0)["df"], F.lit(0)).cast("double"))
        return base.crossJoin(found.select(*[df(f).alias(f"df_{f}") for f in fields]))  # one row each
