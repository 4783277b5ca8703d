"""Documents' tokens to sorted postings as Arrow columns, for what writes an index.

The texts are prepared in the JVM as for any search, so that terms are the same; here they are split at their plain
spaces and grouped: a task's tokens are numbered by their term's rank and sorted as numbers, READ tokens at a time,
so that memory doesn't grow with the task. Stems and n-grams come as tokens.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lodestone.config import TokenizerOptions
from lodestone.functions import text

#: Tokens that are grouped together, a document at least, and rows of a batch that goes back.
READ, ROWS = 1 << 22, 1 << 15
#: Bytes of a batch of texts on its way here, however long they are.
BATCH_BYTES = 16 << 20


def _sorted(ids: pa.Array, lengths: np.ndarray, words: pa.ChunkedArray, positions: np.ndarray) -> pa.Table:
    """Postings of some documents by term and document; lengths: tokens of each."""
    found = words.combine_chunks().dictionary_encode()
    terms, n = found.dictionary, len(found)
    order = pc.sort_indices(terms)
    rank = np.empty(len(terms), np.int64)
    rank[order.to_numpy()] = np.arange(len(terms))
    doc = np.repeat(np.arange(len(ids)), lengths)
    back = (np.diff(positions) < 0) & (np.diff(doc) == 0)
    code = rank[found.indices.to_numpy()]
    if back.any():  # n-grams: longer ones come after shorter ones
        at = np.lexsort((positions, doc))
        code, positions = code[at], positions[at]
    key = np.sort(code * n + np.arange(n))  # terms and tokens are fewer than 2**31
    code, at = np.divmod(key, n)
    doc, positions = doc[at], positions[at]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(code) != 0) | (np.diff(doc) != 0))))
    ends = np.append(first, n).astype(np.int32)
    return pa.table(
        {
            "term": terms.take(order).take(pa.array(code[first])),
            "id": ids.take(pa.array(doc[first])),
            "tf": np.diff(ends),
            "positions": pa.ListArray.from_arrays(ends, pa.array(positions)),
            "field_len": lengths[doc[first]].astype(np.int32),
        }
    )


def _split(texts: pa.Array, stops: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(lengths, tokens, positions) of texts with plain spaces alone: positions are counted before stop words go."""
    texts = pc.split_pattern(texts, " ")
    flat, sizes = texts.flatten(), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    flat, doc = flat.filter(pa.array(there)), doc[there]
    position = np.arange(len(doc)) - np.searchsorted(doc, doc)
    if len(stops):
        kept = ~pc.is_in(flat, value_set=stops).to_numpy(zero_copy_only=False)
        flat, doc, position = flat.filter(pa.array(kept)), doc[kept], position[kept]
    return np.bincount(doc, minlength=len(sizes)), flat, position.astype(np.int32)


def _taken(arrays: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(lengths, tokens, positions) of arrays of (token, position)."""
    flat = arrays.flatten()
    return pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(0), flat.field(1).to_numpy()


def _grouped(batches: Iterator[pa.RecordBatch], stops: pa.Array, read: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def made():
        ids, lengths, words, positions = zip(*held)
        out = _sorted(pa.concat_arrays(ids), np.concatenate(lengths), pa.chunked_array(words), np.concatenate(positions))
        held.clear()
        return out.to_batches(max_chunksize=ROWS)

    for b in batches:
        lengths, flat, positions = tokens(b.column(1), stops)
        if not len(flat):
            continue
        held.append((b.column(0), lengths, flat, positions))
        n += len(flat)
        if n >= read:
            yield from made()
            n = 0
    if held:
        yield from made()


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES; a lower one stays."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ready(field: str, options: TokenizerOptions) -> Column:
    """What is read here of a field: its text with plain spaces, or tokens where the analysis has stems or n-grams."""
    plain = not (options.stemmer or options.ngrams)
    return text.spaced(text.prepared(F.col(field), options)) if plain else text.detailed(F.col(field), options)


def stop_words(options: TokenizerOptions) -> pa.Array:
    return pa.array(sorted(options.stop_words or ()), pa.string())


def tokens(value: pa.Array, stops: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(lengths, tokens, positions) of a batch of what is ready."""
    return _split(value, stops) if pa.types.is_string(value.type) else _taken(value)


def postings(docs: DataFrame, field: str, options: TokenizerOptions, id: str = "id", read: int = READ) -> DataFrame:
    """The rows of index.postings of one field, without field: by term and document within each run of read tokens."""
    out = [StructField("term", StringType()), StructField("id", docs.schema[id].dataType), StructField("tf", IntegerType()), StructField("positions", ArrayType(IntegerType())), StructField("field_len", IntegerType())]
    bound_batches(docs.sparkSession)
    stops = stop_words(options)
    return docs.select(F.col(id).alias("id"), ready(field, options).alias("value")).mapInArrow(lambda batches: _grouped(batches, stops, read), StructType(out))
