import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.config import Field, IndexConfig, SearchOptions, TokenizerOptions, TypoTolerance
from lodestone.functions import scoring, text, urls
from lodestone.operators.search import SearchIndex
from lodestone.operators.suggest import autocomplete


def tokens(spark, s, options=text.DEFAULT):
    return spark.createDataFrame([(s,)], "t string").select(text.tokenize(F.col("t"), options).alias("x")).first().x


@pytest.mark.parametrize(
    "source, options, want",
    [
        ("Machine Learning models are AMAZING!", {}, ["machine", "learning", "models", "amazing"]),
        ("fast,local;search-ready!", {"stop_words": ()}, ["fast", "local", "search", "ready"]),
        ("Version 2.0 costs $50", {}, ["version", "2", "0", "costs", "50"]),
        ("machine learning models", {"ngrams": (1, 2)}, ["machine", "learning", "models", "machine learning", "learning models"]),
        ("one", {"ngrams": (2, 3)}, []),
        ("models indexes", {"stemmer": lambda x: F.regexp_replace(x, "s$", "")}, ["model", "indexe"]),
        ("Café ＡＩ", {"normalization": "NFKC"}, ["café", "ai"]),
        ("a b c﻿d", {"stop_words": ()}, ["a", "b", "c", "d"]),
        ("don't", {"punctuation": "remove"}, ["dont"]),
        (None, {}, []),
        ("", {}, []),
    ],
)
def test_tokenize(spark, source, options, want):
    assert tokens(spark, source, TokenizerOptions(**options)) == want


def test_positions_and_offsets(spark):
    out = spark.createDataFrame([("machine and learning",)], "t string").select(text.detailed(F.col("t")).alias("x")).first().x
    assert [(r.token, r.position) for r in out] == [("machine", 0), ("learning", 2)]
    assert text.Analyzer().spans("machine and learning") == [("machine", 0, 0, 7), ("learning", 2, 12, 20)]
    assert text.Analyzer().spans("Café ＡＩ") == [("café", 0, 0, 5), ("ai", 1, 6, 8)]
    assert text.utf16_offset("\U0001f600a", 1) == 2
    with pytest.raises(ValueError):
        TokenizerOptions(ngrams=(0, 1))
    with pytest.raises(ValueError):
        TokenizerOptions(ngrams=(2, 1))


def test_native_and_driver_analysis_agree(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", text.tokenize(F.col("text")).alias("x")).collect()
    assert all(text.Analyzer().tokens(r.text) == r.x for r in rows)


def test_levenshtein(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("", "ab"), ("a", "a")], "a string, b string")
    assert [r.d for r in rows.select(F.levenshtein("a", "b").alias("d")).collect()] == [3, 2, 0]
    assert [scoring.default_max_distance(w) for w in ("four", "fives")] == [1, 2]
    with pytest.raises(ValueError):
        scoring.bm25(k1=-1)


def test_urls(spark):
    cases = {
        "HTTP://User:pw@Ex.COM:80/a?b#c": "http://ex.com/a?b",
        "https://ex.com:443": "https://ex.com/",
        "https://ex.com:8443/x": "https://ex.com:8443/x",
        "ftp://ex.com/": None,
        "nonsense": None,
        None: None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.normalize_url(F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in rows} == cases
    assert [urls.resolve(u, "http://h/a/b") for u in ("c#x", "/d", "//e.com", "mailto:x", "http://[bad")] == ["http://h/a/c", "http://h/d", "http://e.com/", None, None]
    private = ["http://10.0.0.1/", "http://172.20.1.1/", "http://localhost/", "http://[::1]/", "http://8.8.8.8/", "http://172.32.1.1/"]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(private)], "i int, u string").select("i", urls.is_private(F.col("u")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [True, True, True, True, False, False]


def test_robots():
    rules = urls.Robots("User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 2\n# note\nUser-agent: special\nUser-agent: other\nDisallow: /\n")
    assert [rules.allowed(f"http://h{p}", "bot") for p in ("/", "/private/x", "/private/open/y")] == [True, False, True]
    assert not rules.allowed("http://h/", "Special/1.0") and rules.delay_ms("bot") == 2000 and rules.delay_ms("other") is None
    assert urls.Robots("").allowed("http://h/", "x")


def test_texts_are_normalized_by_default(spark):
    """NFD, full-width letters, ligatures, jamo, half-width kana: terms are those of the NFKC text, and the query's."""
    nfc = ["Café crème", "AI models", "fine flow office", "한국어 문서", "ガイド", "plain ascii", "Größe – naïve", "x2 no", None, ""]
    odd = ["Cafe\u0301 cre\u0300me", "ＡＩ　ｍｏｄｅｌｓ", "ﬁne ﬂow oﬃce", unicodedata.normalize("NFD", "한국어 문서"), "ｶﾞイド", "plain ascii", "Größe – naïve", "x² №", None, ""]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(nfc, odd))], "doc_id int, a string, b string")
    got = rows.select("a", "b", text.tokenize(F.col("a")).alias("x"), text.tokenize(F.col("b")).alias("y"), text.normalize_token(F.col("b")).alias("k"), text.normalize_unicode(F.col("b"), "NFD").alias("d"), text.tokenize(F.col("b"), TokenizerOptions(normalization=None)).alias("raw")).collect()
    for r in got:
        assert r.x == r.y
        assert r.d == (None if r.b is None else unicodedata.normalize("NFD", r.b))
        if r.b is not None:
            assert text.Analyzer().tokens(r.b) == r.y and text.Analyzer().key(r.b) == r.k
            assert text.Analyzer(TokenizerOptions(normalization=None)).tokens(r.b) == r.raw
    assert got[1].raw == ["ａｉ", "ｍｏｄｅｌｓ"]


def test_queries_find_texts_that_are_not_normal(spark, tmp_path):
    from lodestone.registry import QUERIES

    texts = ["Cafe\u0301 this ＡＩ", "café ai", "plain this"]
    spark.createDataFrame(enumerate(texts), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    assert {r.doc_id: r.tokens for r in QUERIES["tokenize_default"](spark, sf).collect()} == {0: "café this ai", 1: "café ai", 2: "plain this"}
    assert {(r.doc_id, r.position, r.token) for r in QUERIES["tokenize_positions"](spark, sf).where("doc_id = 0").collect()} == {(0, 0, "café"), (0, 1, "this"), (0, 2, "ai")}
    assert {r.term: r.df for r in QUERIES["doc_freq"](spark, sf).collect()} == {"café": 2, "ai": 2, "this": 2, "plain": 1}
    assert {(r.term, r.doc_id, r.positions) for r in QUERIES["postings"](spark, sf).where("term = 'ai'").collect()} == {("ai", 0, "2"), ("ai", 1, "1")}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = SearchIndex(docs, IndexConfig({"text": Field(searchable=True)}), "doc_id")
    for options in (SearchOptions(), SearchOptions(ranking="tfidf"), SearchOptions(typo=TypoTolerance()), SearchOptions(proximity=True)):
        assert {r.doc_id for r in index.search("Cafe\u0301 ai", options).collect()} == {0, 1}
    assert {r.doc_id for r in index.search('"this ＡＩ"', SearchOptions()).collect()} == {0}
    assert [tuple(r) for r in autocomplete(index.vocabulary(), "caf").collect()] == [("café", 2)]


def test_inert_characters():
    """None of them changes, is a mark or composes with what stands before it."""
    inert = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), text.INERT) + "]")
    second = {chr(int(d[1], 16)) for k in range(0x110000) if len(d := unicodedata.decomposition(chr(k)).split()) == 2 and not d[0].startswith("<")}
    found = [chr(k) for k in range(0x110000) if inert.match(chr(k))]
    assert len(found) > 20_000
    for c in found:
        assert unicodedata.normalize("NFKC", c) == unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and c not in second


def test_quick_classes_are_the_whole_ones(spark):
    """SPACE has the characters of WS, and the quick test for texts that aren't normal finds what the whole class finds."""
    chars = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.expr("decode(unhex('00000061' || lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    assert chars.where(F.col("c").rlike(text.SPACE) != F.col("c").rlike(text.WS)).count() == 0
    assert chars.where(F.col("c").rlike(text.SPACE)).count() == len(text.SPACES)
    rows = spark.createDataFrame([("a" * 9 + chr(k),) for k in (*range(0xA0, 0x3000), *range(0xF900, 0xFFFE), 0x1D400, 0x1F600)], "c string")
    assert rows.where(text.normalize_unicode(F.col("c")) != F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.col("c"), F.lit(True))).count() == 0
