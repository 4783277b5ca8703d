"""Many queries over the texts themselves: two passes without a shuffle of postings or scores.

The first counts the queries' terms, the second scores documents against all queries and keeps the best of each
task. Both hold some documents at a time, whatever the size of a task; the queries are held whole.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lodestone.config import IndexConfig
from lodestone.operators import grouping, index
from lodestone.sources.shared import source_bytes

#: Scores of documents by queries, and additions to them, that are held at once (a document's at least).
CELLS = 1 << 21


def _tf(value: pa.Array, terms: pa.Array, stops: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, doc, term, tf) of the terms that a batch's documents hold, by document."""
    lengths, flat, _ = grouping.tokens(value, stops)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    code = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy(zero_copy_only=False)
    there = code >= 0
    key, tf = np.unique(doc[there] * len(terms) + code[there], return_counts=True)
    return lengths, key // len(terms), key % len(terms), tf


def _counted(batches: Iterator[pa.RecordBatch], terms: pa.Array, stops: pa.Array, fields: int) -> Iterator[pa.RecordBatch]:
    """(field, k, n): documents with term k of a field; k = -1: all documents, k = -2: tokens."""
    n = np.zeros((fields, len(terms) + 2), np.int64)
    for b in batches:
        for f in range(fields):
            lengths, _, term, _ = _tf(b.column(1 + f), terms, stops)
            n[f, 2:] += np.bincount(term, minlength=len(terms))
            n[f, 0] += lengths.sum()
            n[f, 1] += len(lengths)
    f, k = np.nonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array((k - 2).astype(np.int32)), pa.array(n[f, k])], ["field", "k", "n"])


def _pieces(per_doc: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose per_doc are most together, or of one document."""
    total, a = np.concatenate(([0], np.cumsum(per_doc))), 0
    while a < len(per_doc):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, b
        a = b


class _Best:
    """The k best of each query: by rounded score, then by id."""

    def __init__(self, k: int, queries: int):
        self.k, self.least, self.rows = k, np.full(queries, -np.inf), None

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """scores: a row a document; 0 where nothing matches."""
        if len(scores) > self.k:
            self.least = np.maximum(self.least, -np.partition(-scores, self.k - 1, axis=0)[self.k - 1])
        doc, query = np.nonzero((scores > 0) & (scores >= self.least))
        new = pa.table({"query": query, "score": scores[doc, query], "id": ids.take(pa.array(doc))})
        rows = new if self.rows is None else pa.concat_tables([self.rows, new])
        rows = rows.sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
        query = rows["query"].to_numpy()
        at = np.arange(len(query)) - np.searchsorted(query, query)
        self.rows = rows.filter(pa.array(at < self.k)).combine_chunks()
        last = np.flatnonzero(at == self.k - 1)
        self.least[query[last]] = np.maximum(self.least[query[last]], rows["score"].to_numpy()[last])


def _scored(batches, terms, stops, ptr, query, qf, queries, stats, runs, k, digits, cells) -> Iterator[pa.RecordBatch]:
    """(run, query, id, score): the best k of a task's documents for each query and run."""
    best = [_Best(k, queries) for _ in runs]
    for b in batches:
        n = b.num_rows
        found = [_tf(b.column(1 + f), terms, stops) for f in range(len(stats))]
        more = [np.diff(ptr)[t] for _, _, t, _ in found]
        cost = queries + sum(np.bincount(d, weights=m, minlength=n) for (_, d, _, _), m in zip(found, more)).astype(np.int64)
        for low, high in _pieces(cost, cells):
            for r, (k1, c) in enumerate(runs):
                sums = np.zeros((high - low) * queries)
                for (lengths, doc, term, tf), m, (weight, idf, avg) in zip(found, more, stats):
                    s = slice(*np.searchsorted(doc, (low, high)))
                    d, t, m = doc[s], term[s], m[s]
                    share = weight * (idf[t] * tf[s] * (k1 + 1) / (tf[s] + k1 * (1 - c + c * lengths[d] / (avg if avg > 0 else 1.0))))
                    at = np.repeat(ptr[t] - np.cumsum(m) + m, m) + np.arange(m.sum())  # each term's queries
                    sums += np.bincount(np.repeat(d - low, m) * queries + query[at], weights=np.repeat(share, m) * qf[at], minlength=len(sums))
                scores = np.floor(sums * 10.0**digits + 0.5) / 10.0**digits
                best[r].add(scores.reshape(high - low, queries), b.column(0).slice(low, high - low))
    for r, x in enumerate(best):
        for rows in x.rows.to_batches() if x.rows is not None else ():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, r, np.int32)), rows["query"].cast("int32"), rows["id"], rows["score"]], ["run", "query", "id", "score"])


def search(docs: DataFrame, queries: DataFrame, config: IndexConfig, id: str = "id", k: int = 10, runs=((1.2, 0.75),), digits: int = 6, cells: int = CELLS) -> DataFrame:
    """(run, query_id, id, score, rank): the top k of queries(query_id, text) by BM25, for each (k1, b) of runs by its number."""
    spark, fields = docs.sparkSession, config.searchable
    grouping.bound_batches(spark)
    words = F.explode(index.text.tokenize(F.col("text"), config.tokenizer))
    asked = queries.select("query_id", words.alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf")).collect()
    names, known = list(dict.fromkeys(r.query_id for r in asked)), sorted({r.term for r in asked})
    kinds = [StructField("run", IntegerType()), StructField("query", IntegerType()), StructField("id", docs.schema[id].dataType), StructField("score", DoubleType())]
    number, place = {q: i for i, q in enumerate(names)}, {t: i for i, t in enumerate(known)}
    of = sorted((place[r.term], number[r.query_id], r.qf) for r in asked)
    ptr = np.searchsorted(np.array([t for t, _, _ in of], np.int64), np.arange(len(known) + 1))
    query, qf = np.array([q for _, q, _ in of], np.int64), np.array([n for _, _, n in of], float)
    terms, stops = pa.array(known, pa.string()), grouping.stop_words(config.tokenizer)
    rows = index.dealt(docs.select(id, *fields), source_bytes(docs), id)
    rows = rows.select(F.col(id).alias("id"), *[grouping.ready(f, config.tokenizer).alias(f"value_{i}") for i, f in enumerate(fields)])
    n_fields = len(fields)
    counts = rows.mapInArrow(lambda b: _counted(b, terms, stops, n_fields), "field int, k int, n long").groupBy("field", "k").agg(F.sum("n").alias("n"))
    n = np.zeros((n_fields, len(known) + 2))
    for r in counts.collect():  # as many rows as the queries' terms
        n[r.field, r.k + 2] = r.n
    stats = []
    for f, x in zip(fields, n):
        df = x[2:]
        stats.append((config.fields[f].weight, np.log(1 + (x[1] - df + 0.5) / (df + 0.5)), x[0] / x[1] if x[1] else 0.0))
    many = len(names)
    out = rows.mapInArrow(lambda b: _scored(b, terms, stops, ptr, query, qf, many, stats, runs, k, digits, cells), StructType(kinds))
    first = Window.partitionBy("run", "query").orderBy(F.desc("score"), F.asc("id"))
    out = out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    ids = spark.createDataFrame(list(enumerate(names)), StructType([StructField("query", IntegerType()), StructField("query_id", queries.schema["query_id"].dataType)]))
    return out.join(F.broadcast(ids), "query").select("run", "query_id", "id", "score", "rank")
