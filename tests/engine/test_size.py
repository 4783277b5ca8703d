"""What queries do on large tables: steps that work by columns, held against the plain ones."""

import random

import pytest

from lodestone.config import Field, IndexConfig, TokenizerOptions
from lodestone.functions import text
from lodestone.operators import index

FIELD = {"title": Field(searchable=True)}
OPTIONS = {
    "default": TokenizerOptions(),
    "all words, as they are": TokenizerOptions(stop_words=(), lowercase=False, punctuation="remove"),
    "n-grams": TokenizerOptions(ngrams=(1, 2), separator=""),
}


def rows(n=150):
    r = random.Random(4)
    words = ["red", "the", "Fox", "a", "aa", "dé", "x-y", "…", " ", "\n", "\t", "﻿", "\x85", "日本"]
    return [(k, " ".join(r.choice(words) for _ in range(r.randrange(30))) if k % 11 else None) for k in range(n)]


@pytest.mark.parametrize("name", OPTIONS)
@pytest.mark.parametrize("read", [1 << 22, 50])
def test_grouped_postings_like_native_ones(spark, name, read):
    from lodestone.operators import grouping

    config = IndexConfig(FIELD, tokenizer=OPTIONS[name])
    docs = spark.createDataFrame(rows(), "id int, title string").repartition(3)
    got = grouping.postings(docs, "title", config.tokenizer, read=read)
    key = lambda p: (p.term, p.id, p.tf, tuple(p.positions), p.field_len)
    assert sorted(map(key, got.collect())) == sorted(map(key, index.postings(docs, config).collect()))


def test_split_tries_no_class_on_plain_texts(spark):
    made = text.split_tokens(text.F.col("title"))
    assert f"split(title, {text.SPACE}" not in str(made)
    got = [r[0] for r in spark.createDataFrame(rows(), "id int, title string").select(made).collect()]
    assert got == [None if t is None else [w for w in "".join(" " if c in text.SPACES else c for c in t).split(" ") if w] for _, t in rows()]


@pytest.mark.parametrize("cells", [1 << 21, 30])
def test_batch_over_texts_like_batch_over_postings(spark, cells):
    from lodestone.operators import batch
    from lodestone.operators.search import batch_search

    config = IndexConfig({"title": Field(searchable=True, weight=2.0), "body": Field(searchable=True)})
    data = [(k, a, b) for (k, a), (_, b) in zip(rows(90), reversed(rows(90)))]
    data += [(k + 1000, a, b) for k, a, b in data]  # copies tie by id
    docs = spark.createDataFrame(data, "id int, title string, body string").repartition(3)
    queries = spark.createDataFrame([("q1", "red fox fox"), ("q2", "the dé"), ("q3", "nothing here"), ("q4", None)], "query_id string, text string")
    stats = index.field_stats(index.field_lengths(docs, config))
    got = batch.search(docs, queries, config, k=7, runs=((1.2, 0.75), (2.0, 0.0)), cells=cells)
    for run, (k1, b) in enumerate(((1.2, 0.75), (2.0, 0.0))):
        want = batch_search(index.postings(docs, config), stats, queries, config, k=7, k1=k1, b=b)
        assert sorted(map(tuple, got.where(f"run = {run}").drop("run").collect())) == sorted(map(tuple, want.collect()))
    assert got.where("query_id = 'q1'").count() == 14


def test_search_of_each_segment_splits_its_texts_once(spark):
    from lodestone.config import SearchOptions
    from lodestone.operators.search import SearchIndex
    from lodestone.sources.segments import merged_search

    data = [(k, t, 1) for k, t in rows(60)] + [(k, f"red {t}", 2) for k, t in rows(60) if k % 3 == 0]
    segments, dead = spark.createDataFrame(data, "id int, title string, generation int"), spark.createDataFrame([(6, 2), (7, 1)], "id int, generation int")
    got = merged_search(segments, dead, IndexConfig(FIELD), "red fox", SearchOptions(limit=15), per_segment=True)
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for g in (1, 2):
        hits = SearchIndex(segments.where(f"generation = {g}").drop("generation"), IndexConfig(FIELD)).search("red fox", SearchOptions(limit=None)).collect()
        want += [(h.id, h.title, h.score, g) for h in hits if h.id not in (6, 7) and g == (2 if h.id % 3 == 0 else 1)]
    assert list(map(tuple, got.collect())) == sorted(want, key=lambda h: (-h[2], h[0]))[:15]
