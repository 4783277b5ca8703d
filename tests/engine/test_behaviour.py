import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import analytics, evaluate, pages, recommend, suggest
from lodestone.sources import tables
from lodestone.streaming import signals

KINDS = "user_id string, item_id string, type string, occurred_at timestamp, weight double"


def matrix(spark, rows):
    df = spark.createDataFrame([(u, i, "view", None, 1.0) for u, i in rows], KINDS)
    return recommend.strengths(recommend.weighted(df))


def test_collaborative(spark):
    s = matrix(spark, [("u1", "a"), ("u1", "b"), ("u2", "a"), ("u2", "b"), ("u2", "c"), ("target", "a")])
    near = recommend.neighbours(s)
    assert {(r.item_id, r.neighbour): r.score for r in near.collect()}["a", "b"] == pytest.approx(2 / math.sqrt(6))
    assert [r.item_id for r in recommend.top(recommend.collaborative(s, near, "target")).collect()] == ["b", "c"]
    pop = s.groupBy("item_id").agg(F.sum("strength").alias("score"))
    new = recommend.with_fallback(recommend.collaborative(s, near, "new"), pop, s.where("user_id = 'new'"))
    assert [r.item_id for r in new.collect()] == ["a", "b", "c"]


def test_popularity(spark):
    rows = [("u1", "a", "view", None, None), ("u1", "a", "click", None, 2.5), ("u2", "b", "purchase", None, None), ("u2", "b", "other", None, 9.0)]
    w = recommend.weighted(spark.createDataFrame(rows, KINDS))
    assert {r.item_id: r.score for r in recommend.popularity(w).collect()} == {"b": 5.0, "a": 3.5}
    st = recommend.interaction_stats(w).first()
    assert (st.total, st.users, st.items, st.n_like) == (3, 2, 2, 0)


def test_content_and_hybrid(spark):
    items = spark.createDataFrame([("search-1", "inverted index search ranking"), ("search-2", "search engine ranking relevance"), ("cooking-1", "pasta tomato cooking recipe"), ("empty", "")], "id string, text string")
    v = recommend.content_vectors(items)
    assert all(r.n == pytest.approx(1) for r in v.groupBy("item_id").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect())
    assert [r.item_id for r in recommend.top(recommend.similar_items(v, "search-1")).collect()] == ["search-2"]
    score = lambda *x: spark.createDataFrame(x, "item_id string, score double")
    out = recommend.hybrid({"content": score(("b", 2.0)), "collaborative": score(("b", 4.0), ("c", 2.0)), "popularity": score(("b", 1.0), ("z", 0.0))}, {"content": 0.35, "collaborative": 0.5, "popularity": 0.15})
    assert [(r.item_id, r.score) for r in out.collect()] == [("b", 1.0), ("c", 0.25)]
    with pytest.raises(ValueError):
        recommend.hybrid({"content": score(("b", 1.0))}, {"content": -1.0})


def test_metrics(spark):
    got = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("abc")] + [("none", "a", 1)], "query_id string, doc_id string, rank int")
    rel = spark.createDataFrame([("q", "a", 3), ("q", "c", 1), ("unseen", "x", 1)], "query_id string, doc_id string, grade int")
    at2 = {r.query_id: r for r in evaluate.evaluate(got, rel, 2).collect()}
    assert (at2["q"].precision, at2["q"].recall, at2["q"].rr) == (0.5, 0.5, 1.0)
    q = {r.query_id: r for r in evaluate.evaluate(got, rel, 3).collect()}
    assert q["q"].dcg == pytest.approx(7.5) and q["q"].ndcg == pytest.approx(7.5 / (7 + 1 / math.log2(3)))
    assert (q["none"].precision, q["none"].rr, q["unseen"].ndcg) == (0.0, 0.0, 0.0)
    assert evaluate.format_table([{"config": "a", "ndcg": 0.5}]).splitlines()[1] == "a       0.5000"


def test_analytics(spark):
    s = spark.createDataFrame([("1", "machine", 1.0, 2, "2026-01-01"), ("2", "machine", 3.0, 2, "2026-01-01"), ("3", "not index", 5.0, 0, "2026-01-02")], "search_id string, query string, latency_ms double, result_count int, d string").withColumn("created_at", F.to_timestamp("d"))
    i = spark.createDataFrame([(s_, d, p) for s_ in "12" for d, p in (("a", 1), ("b", 2))], "search_id string, document_id string, position int")
    c = spark.createDataFrame([("1", "a", 1), ("1", "a", 2)], "search_id string, document_id string, position int").withColumn("created_at", F.to_timestamp(F.lit("2026-01-01")))
    ok = analytics.valid_clicks(c, i)
    assert ok.count() == 1
    o = analytics.overview(s).first()
    assert (o.searches, o.queries, o.zero_results, o.p50) == (3, 2, 1, 3.0)
    k = analytics.clicks(s, i, ok).first()
    assert (k.impressions, k.clicks, k.ctr) == (4, 1, 0.25)
    report = analytics.queries(s, i, analytics.named_clicks(ok, s), None)
    assert [(r.query, r.clicks) for r in report.collect()] == [("machine", 1), ("not index", 0)]
    assert [r.query for r in analytics.no_results(report).collect()] == ["not index"]
    none = analytics.overview(s.limit(0)).first()
    assert (none.searches, none.zero_rate, none.p95) == (0, 0.0, 0.0)
    with pytest.raises(ValueError):
        analytics.resolve_range("2026-02-01", "2026-01-01")


def test_query_suggestions(spark):
    s = spark.createDataFrame([(1, "Machine learning", 3, 2), (2, "machine vision", 3, 2), (3, "machine vision", 3, 2), (4, "mach none", 0, 0)], "search_id int, query string, result_count int, impressions int").withColumn("ts", F.to_timestamp(F.lit("2026-01-01")))
    sig = suggest.signals(s, spark.createDataFrame([(2,), (3,)], "search_id int"))
    assert [r["query"] for r in suggest.suggest(sig, "mach", "2026-01-02").collect()] == ["machine vision", "machine learning"]


def test_page_extraction():
    page = """<html lang="EN"><head><title> A  title </title><meta name="description" content="d"><link rel="canonical" href="/c#x"><script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">{bad</script></head>
    <body><nav><a href="/n">n</a></nav><div class="cookie-bar"><p>no</p></div><main><h1>Head</h1><h2>S</h2><p>one <b>two</b><p>three<ul><li>x<li>x</ul></main><p>out</p></body></html>"""
    got = pages.extract_page(page, "http://h/a")
    assert (got["title"], got["description"], got["heading"], got["sections"], got["language"], got["canonical_url"]) == ("A title", "d", "Head", ["S"], "en", "http://h/c")
    assert got["content"] == "one two\n\nthree\n\nx" and got["structured_data"] == ['{"a": 1}'] and got["links"] == ["http://h/n"]
    assert pages.extract_page(None, None)["content"] == ""
    same = pages.extract_page(page.replace("one ", "one \n "), "http://h/a")
    assert same["content_hash"] == got["content_hash"]


def test_titles_decode_closed_references_alone(spark, tmp_path):
    from lodestone.registry import QUERIES

    page = '<html lang="en"><head><title>a &amp;&amp; b &lt;c&gt; &amp</title></head><body><h1>a&b &#x27;d&#x27; &amp</h1></body></html>'
    spark.createDataFrame([(1, "http://h/a", page)], "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["page_titles"](spark, str(tmp_path)).first()
    assert (got.title, got.heading) == ("a && b <c> &amp", "a&b 'd' &amp")
    assert pages.extract_page(page, "http://h/a")["title"] == "a && b <c> &"


def test_recency_ahead(spark):
    items = spark.createDataFrame([("a", "2024-01-31 00:00:00"), ("b", "2024-02-11 00:00:00")], "item_id string, created_at string")
    score = lambda **k: {r.item_id: r.score for r in recommend.recency(items, items.where("false"), "2024-02-01 00:00:00", 10.0, **k).collect()}
    assert score() == {"a": pytest.approx(2**-0.1), "b": 1.0} and score(ahead=True) == {"a": pytest.approx(2**-0.1), "b": 2.0}


def test_tables(spark, tmp_path):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    up = tables.upsert(base, spark.createDataFrame([("b", 3), ("c", 4)], "id string, n int"))
    assert {(r.id, r.n) for r in tables.remove(up, spark.createDataFrame([("a",)], "id string")).collect()} == {("b", 3), ("c", 4)}
    good, bad = tables.validate(spark.createDataFrame([("a", "1"), ("", "1"), ("c", "x")], "id string, n string"), {"n": "int"})
    assert [(r.id, r.n) for r in good.collect()] == [("a", 1)] and {r.reason for r in bad.collect()} == {"id", "n"}
    (tmp_path / "d.json").write_text('[{"id": "1", "fields": {"t": "x", "u": "f"}, "metadata": {"u": "m"}}]')
    assert tables.read_json_documents(spark, str(tmp_path / "d.json")).first().asDict() == {"id": "1", "t": "x", "u": "m"}


def test_stream(spark, tmp_path):
    rows = [("u", "a", "click", "2026-01-01 00:00:00"), ("u", "a", "view", "2026-01-01 10:00:00"), ("v", "b", "view", "2026-01-02 10:00:00")]
    spark.createDataFrame(rows, "user_id string, item_id string, type string, t string").select("user_id", "item_id", "type", F.to_timestamp("t").alias("occurred_at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id string, item_id string, type string, occurred_at timestamp").parquet(str(tmp_path / "in"))
    q = signals.popularity_windows(stream).writeStream.format("memory").queryName("popular").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(str(r.start)[:10], r.item_id, r.score) for r in spark.table("popular").collect()} == {("2026-01-01", "a", 3.0), ("2026-01-02", "b", 1.0)}


def test_registry_has_whole_tables():
    from lodestone.registry import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 90
