"""The inverted index as tables: postings, statistics, vocabulary, and documents' mutation.

postings(term, field, id, tf, positions, field_len) has a row for each term of a field of a document. Lengths
and counts of documents come from token arrays before they are exploded, so documents without a token count.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import IndexConfig, TokenizerOptions
from lodestone.functions import text


def token_rows(docs: DataFrame, id: str, field: str, options: TokenizerOptions = text.DEFAULT) -> DataFrame:
    """(id, token, position) of each token of a field."""
    return docs.select(F.col(id), F.explode(text.detailed(F.col(field), options)).alias("t")).select(id, "t.token", "t.position")


def grouped(tokens):
    """Of array<struct<token, position>>, an array of (term, positions in order, n: size of tokens) for each token once: sorted in the row, so that nothing is shuffled."""

    def of(s):
        first = F.filter(text.starts(s, 1), lambda i: (i == 0) | (F.get(s, i)["token"] != F.get(s, i - 1)["token"]))

        def one(at):
            end = lambda k: F.coalesce(F.get(at, k + 1), F.size(s))
            return F.transform(at, lambda i, k: F.struct(F.get(s, i)["token"].alias("term"), F.transform(F.slice(s, i + 1, end(k) - i), lambda x: x["position"]).alias("positions"), F.size(s).alias("n")))

        return text.bound(first, one)

    return text.bound(F.sort_array(tokens), of)


def dealt(docs: DataFrame, n_bytes: int, id: str, part: int = 16 << 20) -> DataFrame:
    """docs by hash of the id over as many tasks as there are parts in n_bytes, a core's share at least, unless their files are as many."""
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // part))
    return docs if len(docs.inputFiles()) >= n else docs.repartition(n, id)


def postings(docs: DataFrame, config: IndexConfig, id: str = "id") -> DataFrame:
    """All postings: a document's are grouped within its row, without a shuffle."""

    def one(field):
        rows = docs.select(F.col(id).alias("id"), F.explode(grouped(text.detailed(F.col(field), config.tokenizer))).alias("t"))
        return rows.select("t.term", F.lit(field).alias("field"), "id", F.size("t.positions").alias("tf"), "t.positions", F.col("t.n").alias("field_len"))

    return reduce(DataFrame.union, [one(f) for f in config.searchable])


def words(docs: DataFrame, config: IndexConfig) -> DataFrame:
    """(term) of each document's fields together, once a document."""
    arrays = [text.tokenize(F.col(f), config.tokenizer) for f in config.searchable]
    return docs.select(F.explode(F.array_distinct(F.flatten(F.array(*arrays)))).alias("term"))


def field_lengths(docs: DataFrame, config: IndexConfig, id: str = "id") -> DataFrame:
    """(id, field, field_len), documents without a token included."""
    kinds = [F.struct(F.lit(f).alias("field"), F.size(text.tokenize(F.col(f), config.tokenizer)).alias("field_len")) for f in config.searchable]
    return docs.select(F.col(id).alias("id"), F.explode(F.array(*kinds)).alias("f")).select("id", "f.field", "f.field_len")


def field_stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("field_len").alias("total_len"), F.avg("field_len").alias("avg_len"))


def document_stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("id").agg(F.sum("field_len").alias("total_len"))


def vocabulary(posts: DataFrame) -> DataFrame:
    """(term, df, n_chars): documents and code points of each term."""
    return posts.groupBy("term").agg(F.countDistinct("id").alias("df")).withColumn("n_chars", F.length("term"))


def term_field_df(posts: DataFrame) -> DataFrame:
    """Document frequency by field: a document has one row a field."""
    return posts.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))


def collection_stats(lengths: DataFrame, posts: DataFrame) -> DataFrame:
    """One row: documents, tokens, mean length, vocabulary size."""
    per = document_stats(lengths).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("total_len").alias("total_len"), F.avg("total_len").alias("avg_len"))
    return per.crossJoin(posts.agg(F.countDistinct("term").alias("vocabulary")))


def lookup(posts: DataFrame, term: str, fields=None, options: TokenizerOptions = text.DEFAULT) -> DataFrame:
    """Postings of one normalized key; the filter reaches the files of a written index."""
    out = posts.where(F.col("term") == text.Analyzer(options).key(term))
    return (out.where(F.col("field").isin(list(fields))) if fields else out).orderBy("id", "field")


def write_index(posts: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings in files by hash of the term and sorted inside, so that a term's lookup skips all but one file's row groups."""
    spread = posts.repartition(buckets, "term").sortWithinPartitions("term", "id")
    spread.write.mode("errorifexists").parquet(path)


def newest(rows: DataFrame, id: str, version: str) -> DataFrame:
    w = Window.partitionBy(id).orderBy(F.desc(version))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
