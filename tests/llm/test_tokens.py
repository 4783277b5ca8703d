import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import op2_bpe, op6_tokens

BPE, PIECES = P.path(op2_bpe.VOCABULARY), P.path(op6_tokens.MODEL)


def texts():
    r = random.Random(7)
    some = ["", " ", "a", "Hello  world\n\n don't <|endoftext|> <s>", "é" * 300, "x" * 3000, "日本語のテキスト 12345", "▁under▁score", "tail   ", "   lead", "a b\tc\x00d", "\U0001f600 ‍́", "'LL 'll ſ's"]
    return some + ["".join(r.choice("ab c\né一 1'.") for _ in range(r.randrange(400))) for _ in range(40)]


@pytest.fixture(scope="module")
def library():
    with open(BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs(spark):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts())] + [(None, "null id", None), (3, None, None), (3, "again", None)], "doc_id bigint, text string, n_tokens string")


def test_bpe_like_the_library(spark, library):
    for r in op2_bpe.encoded(docs(spark).withColumn("own", F.col("text")), BPE).collect():
        text = r.own or ""
        assert r.ids == (ids := library.encode_ordinary(text))
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert op2_bpe.encoded(docs(spark).limit(0), BPE).collect() == []


def test_merges_with_and_without_heap(library):
    table, r = op2_bpe.ranks(BPE), random.Random(3)
    for n in (1, 2, 5, 39, 40, 41, 90, 700):
        word = "".join(r.choice("aeinsté") for _ in range(n)).encode()
        want = library._core_bpe.encode_single_piece(word)
        assert op2_bpe.merge(word, table) == want
        if word not in table:
            assert op2_bpe._merge_short(word, table) == want


def test_native_fold(spark, library, monkeypatch):
    monkeypatch.setattr(op2_bpe, "CHUNK", 8)
    out = op2_bpe.encode_native(docs(spark).withColumn("own", F.col("text")), BPE)
    assert "ArrowPython" not in out._jdf.queryExecution().toString() and "Exchange" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    assert len(rows) == len(texts()) + 3
    for r in rows:
        text = r.own or ""
        if len(text) < 1000:
            assert r.ids == (ids := library.encode_ordinary(text))
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert op2_bpe.encode_native(docs(spark).limit(0), BPE).collect() == []


def test_counts_like_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = op6_tokens.token_counts(docs(spark).withColumn("own", F.col("text")), PIECES, limit=50)
    rows = out.collect()
    assert len(rows) == len(texts()) + 3
    for r in rows:
        text = r.own or ""
        n = len(library.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 50), repr(text[:40])
    assert op6_tokens.token_counts(docs(spark).limit(0), PIECES).collect() == []


def test_cache_bound():
    cache = op2_bpe.Words(op2_bpe.ranks(BPE), 10 * (op2_bpe._ENTRY + 40))
    for i in range(50):
        assert len(cache[f"word{i}"]) > 0
        assert len(cache) + len(cache.aside) <= 10 and cache.used <= cache.room // 2
    assert cache["word1"] == cache["word1"] and len(cache["x" * 65]) and "x" * 65 not in cache


def test_extra_columns_of_any_name(spark):
    rows = spark.createDataFrame([("a b", 1, 2, 3)], "text string, t int, T_ int, `odd.name` int")
    for made in (op2_bpe.encoded(rows, BPE), op2_bpe.encode_native(rows, BPE)):
        (r,) = made.collect()
        assert made.columns[:4] == rows.columns and tuple(r)[:4] == ("a b", 1, 2, 3) and len(r.ids) == r.n_tokens > 0
