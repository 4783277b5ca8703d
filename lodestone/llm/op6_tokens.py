"""Token counts of a sentencepiece BPE model by a map-side two-tier lookup, without a pre-token shuffle.

No piece of such a model holds a word mark after another character (checked when the model is loaded), so
the segmentation of a text is that of its pre-tokens: a run of spaces and the characters up to the next
space. Tier one is a broadcast table of the lengths of the most frequent pre-tokens, at most TIER_ONE of
them; each task counts its own pre-tokens and sends its most frequent ones on, over the whole corpus. Tier
two encodes what the table lacks and keeps it in a cache of bounded size in the worker. Neither tier changes
a count, only who works it out.

Defined results: null and empty texts have 0 tokens; word marks in a text count as spaces, as the library
has it; equal rows get equal counts; extra columns stay, those that clash with the results are replaced.
"""

import functools
from collections import Counter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import col, give_back, packed, read_table, unpacked, with_own

NAME = "op6_token_counts"
MODEL = "piece_bpe_32k.model"
LIMIT = 4096
TIER_ONE = 1 << 16
#: Pre-tokens that a task sends on, pre-tokens that it counts at once, and the entries of its cache, which ends with it.
SENT, COUNTED, CACHED = 1 << 13, 1 << 18, 1 << 17
#: Longer pre-tokens are encoded each time.
LONGEST = 64
MARK = "▁"


@functools.cache
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        if MARK in model.id_to_piece(i).lstrip(MARK):
            raise ValueError("a piece of this model crosses word borders")
    return model


def _parts(text: str) -> list[str]:
    """Pre-tokens without the first of their spaces (the model adds one); a run of spaces at the end is left out."""
    text = text.replace(MARK, " ")
    if "  " not in text and text[:1] != " ":
        return text.split(" ")
    out, gap = [], ""
    for x in text.split(" "):
        if x:
            out.append(gap + x)
            gap = ""
        else:
            gap += " "
    return out


def _tail(text: str) -> int:
    text = text.replace(MARK, " ")
    return len(text) - len(text.rstrip(" "))


class Cache(dict):
    """Lengths by pre-token; encodes what it lacks."""

    def __init__(self, path, known):
        super().__init__(known)
        self.encode, self.room = _model(path).encode, CACHED
        self.tails = {}

    def __missing__(self, part):
        n = len(self.encode(part))
        if self.room > 0 and len(part) <= LONGEST:
            self[part] = n
            self.room -= 1
        return n

    def tail(self, k):
        if k not in self.tails:
            self.tails[k] = len(self.encode("a" + " " * k)) - len(self.encode("a"))
        return self.tails[k]

    def count(self, text: str) -> int:
        k = _tail(text)
        if k == 0:
            return sum(map(self.__getitem__, _parts(text))) if text else 0
        if k == len(text):
            return len(self.encode(text))
        return sum(map(self.__getitem__, _parts(text[:-k]))) + self.tail(k)


def _frequent(batches):
    """The most frequent pre-tokens of this task's texts, with their counts."""
    count = Counter()
    for batch in batches:
        for t in batch.column(0):
            if t.is_valid:
                count.update(_parts(t.as_py()))
                if len(count) > COUNTED:
                    count = Counter(dict(count.most_common(COUNTED // 2)))
    top = [(w, n) for w, n in count.most_common(SENT) if 0 < len(w) <= LONGEST]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["part", "n"])


def tier_one(texts: DataFrame, path: str, size: int = TIER_ONE) -> dict[str, int]:
    """Lengths of about the size most frequent pre-tokens of texts(text), LONGEST characters each at most."""
    top = texts.mapInArrow(_frequent, "part string, n bigint").groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(size)
    parts = [r.part for r in top.collect()]
    return dict(zip(parts, map(len, _model(path).encode(parts, num_threads=1))))


def _counts(path, known):
    def run(batches):
        cache = Cache(path, known.value)
        for batch in batches:
            n = [cache.count(t.as_py()) if t.is_valid else 0 for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])
        del cache
        give_back()

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit."""
    given = col(text)
    known = docs.sparkSession.sparkContext.broadcast(tier_one(docs.select(given), path))
    rows = packed(docs, ("n_bytes", "n_tokens", "over_limit"), n_bytes=F.coalesce(F.octet_length(given), F.lit(0)).cast("long"), t=given)
    out = rows.mapInArrow(_counts(path, known), with_own(rows, "n_bytes bigint, n_tokens bigint"))
    return unpacked(out, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir):
    return token_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(MODEL)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
