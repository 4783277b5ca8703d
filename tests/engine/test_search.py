import math
import random
from collections import Counter

import pytest

from lodestone.config import BoostRule, Field, Filter, IndexConfig, RecencyRule, SearchOptions, Sort, Synonym, TypoTolerance
from lodestone.operators import index, suggest
from lodestone.operators.search import SearchIndex, parse_query
from lodestone.sources.segments import SegmentStore

META = dict(filterable=True, facetable=True, sortable=True)
CONFIG = IndexConfig({"title": Field(searchable=True, weight=3.0), "brand": Field(**META), "category": Field(**META), "price": Field(**META), "available": Field(**META)})


def make(spark, rows, schema, config=CONFIG):
    return SearchIndex(spark.createDataFrame(rows, schema), config)


@pytest.fixture(scope="module")
def products(spark):
    rows = [("sony-199", "Wireless headphones", "Sony", "electronics", 199.0, True), ("bose-299", "Noise cancelling headphones", "Bose", "electronics", 299.0, True), ("sony-399", "Premium headphones", "Sony", "premium", 399.0, False)]
    return make(spark, rows, "id string, title string, brand string, category string, price double, available boolean")


def ids(df):
    return [r.id for r in df.collect()]


def test_filters_sort_facets(products):
    o = SearchOptions(filters=(Filter("brand", "in", ("Sony", "Bose")), Filter("price", "lessThan", 300)), sort=Sort("price", True), facets=("brand", "category"))
    assert ids(products.search("headphones", o)) == ["bose-299", "sony-199"]
    assert {(r.facet, r.value, r.n) for r in products.facets("headphones", o).collect()} == {("brand", "Sony", 1), ("brand", "Bose", 1), ("category", "electronics", 2)}
    assert products.total("headphones").first().total == 3
    for bad in (SearchOptions(filters=(Filter("title", "equals", "x"),)), SearchOptions(sort=Sort("title")), SearchOptions(fields=("brand",))):
        with pytest.raises(ValueError):
            products.search("headphones", bad)
    with pytest.raises(ValueError):
        SearchOptions(limit=-1)


def test_operators(spark):
    rows = [("one", "item", "Sony", "c", 100.0, True), ("two", "item", "Bose", "c", 200.0, None), ("three", "item", "JBL", "c", 300.0, False)]
    i = make(spark, rows, "id string, title string, brand string, category string, price double, available boolean")
    got = lambda f, op, v=None: set(ids(i.search("", SearchOptions(filters=(Filter(f, op, v),)))))
    assert got("brand", "notEquals", "Sony") == {"two", "three"}
    assert got("brand", "notIn", ("Sony", "JBL")) == {"two"}
    assert got("price", "greaterThan", 100) == got("price", "greaterThanOrEqual", 200) == {"two", "three"}
    assert got("price", "lessThanOrEqual", 200) == {"one", "two"}
    assert got("available", "exists") == {"one", "three"} and got("available", "exists", False) == {"two"}
    assert got("available", "greaterThan", 0) == set() and ids(i.search("")) == [] and ids(i.search("the")) == []
    assert got("available", "notEquals", True) == {"two", "three"}


def test_bm25_by_hand_and_repeats(spark):
    config = IndexConfig({"title": Field(searchable=True)})
    i = make(spark, [("a", "red red fox"), ("b", "fox"), ("c", "dog and fox"), ("d", "")], "id string, title string", config)
    n, avg, df = 4, 6 / 4, 1
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    want = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg))
    assert i.search("red").first().score == pytest.approx(want, abs=1e-6)
    assert i.search("red red").first().score == pytest.approx(2 * want, abs=1e-6)
    assert parse_query('dog "red fox"')[0] == ["dog", "red", "fox"]


def test_phrases_proximity(spark):
    config = IndexConfig({"title": Field(searchable=True)})
    rows = [("exact", "machine learning"), ("reversed", "learning machine"), ("separated", "machine and learning"), ("plus", "more machine learning here")]
    i = make(spark, rows, "id string, title string", config)
    assert set(ids(i.search('"machine learning"'))) == {"exact", "plus"}
    assert set(ids(i.search('"machine and learning"'))) == {"separated"}
    near = make(spark, [("far", "machine filler filler learning"), ("near", "machine learning filler filler")], "id string, title string", config)
    assert ids(near.search("machine learning", SearchOptions(proximity=True))) == ["near", "far"]
    plan = i.search("machine")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_synonyms_typos_rules(spark):
    fields = {"title": Field(searchable=True), "featured": Field(), "day": Field()}
    rows = [("a", "js", True, "2026-01-01"), ("b", "javascript", False, "2026-01-30"), ("c", "other", None, "bad")]
    i = lambda **k: make(spark, rows, "id string, title string, featured boolean, day string", IndexConfig(fields, **k))
    assert ids(i(synonyms=(Synonym("js", ("javascript",)),), synonym_penalty=0.5).search("js")) == ["a", "b"]
    typo = i().search("javscript", SearchOptions(typo=TypoTolerance()))
    exact = i().search("javascript")
    assert ids(typo) == ["b"] and typo.first().score < exact.first().score
    assert ids(i().search("zzzzzz", SearchOptions(typo=TypoTolerance()))) == []
    every = "js javascript other"
    assert ids(i(rules=(BoostRule("featured", "equals", 1.5, True),)).search(every))[0] == "a"
    assert ids(i(rules=(RecencyRule("day", 10.0, 1.0),)).search(every, SearchOptions(now="2026-01-31 00:00:00")))[0] == "b"
    parts = i().explain("js other").collect()
    assert {(r.id, r.term, r.tf) for r in parts} == {("a", "js", 1), ("c", "other", 1)}


def test_paging_is_a_slice(spark):
    rows = [(n, "search " * (n % 7 + 1) + f"document {n}") for n in range(100)]
    i = make(spark, rows, "id int, title string", IndexConfig({"title": Field(searchable=True)}))
    assert ids(i.search("search", SearchOptions(limit=10, offset=20))) == ids(i.search("search", SearchOptions(limit=None)))[20:30]


def test_suggestions(spark):
    i = make(spark, [("a", "machine machinery"), ("b", "machine machines"), ("c", "machines")], "id string, title string", IndexConfig({"title": Field(searchable=True)}))
    assert [r.term for r in suggest.autocomplete(i.vocabulary(), "Mach", 2).collect()] == ["machine", "machines"]
    assert suggest.autocomplete(i.vocabulary(), "").collect() == []
    v = make(spark, [("a", "machine learning javascript javascript"), ("b", "machine models javascript"), ("c", "kubernetes cat car")], "id string, title string", IndexConfig({"title": Field(searchable=True)})).vocabulary()
    got = suggest.correct("machien lerning", v).orderBy("position").collect()
    assert [(r.corrected, r.distance) for r in got] == [("machine", 2), ("learning", 1)]
    assert suggest.correct("cap", v).first().corrected == "cap"
    assert suggest.correct('"machien"', v).first().corrected == "machien"


def test_highlight(spark):
    got = suggest.highlight_text("Machine Learning <script>alert(1)</script>", {"machine", "learning"}, "<em>", "</em>")
    assert got == "<em>Machine Learning</em> &lt;script&gt;alert(1)&lt;/script&gt;"
    assert suggest.highlight_text("none", {"x"}) is None
    with pytest.raises(ValueError):
        suggest.highlight(spark.createDataFrame([("x",)], "t string"), "t", ["x"], pre="<a href=x>")


def test_postings_like_a_model(spark):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(["red", "the", "fox", "dog", "cat"]) for _ in range(r.randrange(8)))) for k in range(60)]
    config = IndexConfig({"title": Field(searchable=True)})
    docs = spark.createDataFrame(rows, "id int, title string")
    got = {(p.id, p.term): (p.tf, p.positions, p.field_len) for p in index.postings(docs, config).collect()}
    want = {}
    for k, t in rows:
        words = t.split()
        for w, n in Counter(words).items():
            if w != "the":
                want[k, w] = (n, [i for i, x in enumerate(words) if x == w], sum(x != "the" for x in words))
    assert got == want
    stats = index.field_stats(index.field_lengths(docs, config)).first()
    assert stats.n_docs == 60 and stats.total_len == sum(len([w for w in t.split() if w != "the"]) for _, t in rows)


def test_segments_and_snapshots(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "store"))
    df = lambda *rows: spark.createDataFrame(rows, "id string, title string")
    assert store.flush(df(("a", "x")).limit(0)) is None and store.documents() is None
    assert store.flush(df(("a", "old"), ("b", "two"))) == "segment-000001"
    store.flush(df(("a", "new"), ("c", "three")))
    store.delete(df(("b", "")))
    seen = lambda s: {(r.id, r.title) for r in s.documents().collect()}
    assert seen(store) == {("a", "new"), ("c", "three")}
    store.snapshot(str(tmp_path / "snap"))
    assert store.valid(str(tmp_path / "snap"))
    name = store.compact()
    assert [n for n, _ in store.manifest()["segments"]] == [name] and seen(store) == {("a", "new"), ("c", "three")}
    store.flush(df(("b", "back")))
    assert ("b", "back") in seen(SegmentStore(spark, str(tmp_path / "store")))
    store.restore(str(tmp_path / "snap"))
    assert seen(store) == {("a", "new"), ("c", "three")}
    with pytest.raises(ValueError):
        store.snapshot(str(tmp_path / "store" / "inner"))
    part = next((tmp_path / "snap" / "data").glob("*/*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    assert not store.valid(str(tmp_path / "snap"))
    with pytest.raises(ValueError):
        store.restore(str(tmp_path / "snap"))


