import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.config import Field, Filter, IndexConfig, SearchOptions, Sort, Synonym, TokenizerOptions, TypoTolerance
from lodestone.functions import text, urls
from lodestone.operators import analytics, pages, recommend, suggest
from lodestone.operators.search import SearchIndex
from lodestone.operators.stored import StoredIndex
from lodestone.services import AnswerCache, IndexService, Jobs, NotFound, RecommendationService, SnapshotService, stable_key
from lodestone.sources.segments import SegmentStore

META = dict(filterable=True, facetable=True, sortable=True)
CONFIG = IndexConfig({"title": Field(searchable=True, weight=3.0), "body": Field(searchable=True), "brand": Field(**META), "price": Field(**META)})
DOCS = "id string, title string, body string, brand string, price double"


def corpus(n=120, seed=3):
    r = random.Random(seed)
    words = ["red", "fox", "dog", "the", "machine", "learning", "models", "search", "rare"]
    make = lambda k: " ".join(r.choice(words[: 8 + (r.random() < 0.1)]) for _ in range(r.randrange(k)))
    return [(f"d{k}", make(6), make(30), r.choice(["a", "b", None]), float(r.randrange(50))) for k in range(n)]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """Search by scanning and over the written index of the same documents."""
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(corpus(), DOCS).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    config = IndexConfig(CONFIG.fields, synonyms=(Synonym("fox", ("dog",)),))
    return SearchIndex(docs, config), SearchIndex.written(docs, config)


OPTIONS = {
    "plain": ("machine learning", SearchOptions()),
    "tfidf": ("fox models", SearchOptions(ranking="tfidf")),
    "field": ("search", SearchOptions(fields=("title",))),
    "filter": ("fox", SearchOptions(filters=(Filter("brand", "equals", "a"), Filter("price", "lessThan", 40)))),
    "sorted": ("fox", SearchOptions(sort=Sort("price", True), limit=15)),
    "page": ("dog machine", SearchOptions(limit=7, offset=5)),
    "all": ("red", SearchOptions(limit=None)),
    "phrase": ('"machine learning"', SearchOptions()),
    "gap": ('"dog the fox"', SearchOptions()),
    "near": ("rare models", SearchOptions(proximity=True)),
    "typo": ("machien", SearchOptions(typo=TypoTolerance())),
    "none": ("zzz", SearchOptions()),
    "blank": ("the", SearchOptions(filters=(Filter("brand", "exists"),), limit=5)),
}


@pytest.mark.parametrize("name", OPTIONS)
def test_written_index_like_scan(both, name):
    scan, stored = both
    query, options = OPTIONS[name]
    a, b = scan.search(query, options), stored.search(query, options)
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda df: [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert rows(a) == rows(b)
    assert scan.total(query, options).first().total == stored.total(query, options).first().total
    assert sorted(map(tuple, scan.explain(query, options).select("id", "term", "field", "tf", "df", "field_len").collect())) == sorted(map(tuple, stored.explain(query, options).select("id", "term", "field", "tf", "df", "field_len").collect()))


def test_written_index_opens_its_terms_alone(both):
    plan = both[1].search("machine")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan and "EqualTo(term,machine)" in plan and "Python" not in plan
    assert sorted(map(tuple, both[0].vocabulary().collect())) == sorted(map(tuple, both[1].vocabulary().collect()))


def test_index_follows_its_source(spark, tmp_path):
    path, config = str(tmp_path / "d"), IndexConfig({"title": Field(searchable=True)})
    found = lambda: {r.id for r in SearchIndex.written(spark.read.parquet(path), config).search("red").collect()}
    spark.createDataFrame([("a", "red")], "id string, title string").write.parquet(path)
    assert found() == {"a"}
    spark.createDataFrame([("b", "red")], "id string, title string").write.mode("append").parquet(path)
    assert found() == {"a", "b"}


def test_queries_are_analysed_like_documents(spark):
    docs = spark.createDataFrame([("a", "cats sit here"), ("b", "cat"), ("c", "ﬁne wine ｆｕｌｌ"), ("d", "sit there")], "id string, title string")
    made = lambda **o: SearchIndex(docs, IndexConfig({"title": Field(searchable=True)}, tokenizer=TokenizerOptions(**o)))
    ids = lambda df: {r.id for r in df.collect()}
    stem = made(stemmer=lambda x: F.regexp_replace(x, "s$", ""))
    assert ids(stem.search("cats")) == ids(stem.search("cat")) == {"a", "b"}
    assert ids(stem.search('"cat sit"')) == {"a"}
    grams = made(ngrams=(1, 2))
    assert ids(grams.search("sit here")) == {"a", "d"} and grams.search("sit here").first().id == "a"
    assert {r.term for r in grams.explain("sit here").where("id = 'a'").collect()} == {"sit", "here", "sit here"}
    assert ids(made(ngrams=(2, 2)).search("sit here")) == {"a"}
    for q in ("ﬁne", "fine", "ｆｕｌｌ", "full"):
        assert ids(made().search(q)) == {"c"}


def test_locale_lower_case(spark):
    df = spark.createDataFrame([("DIŞ ISI İZ",)], "t string")
    for locale, want in (("tr", ["dış", "ısı", "iz"]), (None, None)):
        o = TokenizerOptions(locale=locale, stop_words=())
        got = df.select(text.tokenize(F.col("t"), o).alias("x")).first().x
        assert got == text.Analyzer(o).tokens("DIŞ ISI İZ") and (want is None or got == want)


def test_normal_forms_like_python(spark):
    import unicodedata

    r = random.Random(1)
    rows = [("".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x300, 0x340), r.randrange(0xAC00, 0xD7A4), r.randrange(0xFB00, 0xFB07), r.randrange(0xFF01, 0xFF5F)])) for _ in range(20)),) for _ in range(500)] + [("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    for form in ("NFC", "NFKC", "NFD", "NFKD"):
        for x in df.select("t", text.normalize_unicode(F.col("t"), form).alias("x")).collect():
            assert x.x == (None if x.t is None else unicodedata.normalize(form, x.t))


def test_offsets_as_a_column(spark):
    df = spark.createDataFrame([("Hi, 😀 wörld!",), (None,)], "t string")
    a, b = text.offsets(df, "t").collect()
    assert [tuple(x) for x in a.tokens] == [("hi", 0, 0, 2), ("wörld", 1, 7, 12)] and b.tokens == []


def test_response(both):
    found = both[1].response("machine fox", SearchOptions(limit=3, facets=("brand",)), highlight=("title",), explain=True)
    assert found["total"] == both[1].total("machine fox").first().total and len(found["hits"]) == 3 and found["ms"] > 0
    assert found["facets"]["brand"] == {r.value: r.n for r in both[0].facets("machine fox", SearchOptions(facets=("brand",))).collect()}
    hit = found["hits"][0]
    assert set(hit.matched_terms) <= {"machine", "fox", "dog"} and {p.term for p in hit.parts} == set(hit.matched_terms)
    assert all(p.idf == pytest.approx(math.log(120 / p.df)) and p.field_len > 0 and p.avg_len > 0 for p in hit.parts)


def test_correct_then_retry(both):
    hits, query, made = both[1].search_corrected("machien")
    assert query == "machine" and [r.distance for r in made] == [2] and hits.count() == 10
    assert both[1].search_corrected("machine")[1:] == ("machine", [])
    assert both[1].search_corrected("zzzzzz")[1:] == ("zzzzzz", [])


def test_suggestions_together(spark):
    v = spark.createDataFrame([("machine", 5), ("mad", 2)], "term string, df bigint")
    s = suggest.signals(spark.createDataFrame([(1, "mach one", 3, 2, "2024-01-01")], "search_id int, query string, result_count int, impressions int, ts string"), spark.createDataFrame([], "search_id int"))
    assert [(r.kind, r.value) for r in suggest.both(v, s, "ma", "2024-01-02").collect()] == [("query", "mach one"), ("term", "machine"), ("term", "mad")]
    assert [suggest.plain_tag(t) for t in ("<em>", "</x-1>", "<a b>", "<>", "em", "<1a>", "</>", "<é>", "<")] == [True, True] + [False] * 7


def test_index_service(spark, tmp_path):
    calls, cache = [], AnswerCache(clock=lambda: 0)
    service = IndexService(spark, str(tmp_path / "s"), cache)
    config = IndexConfig({"title": Field(searchable=True), "brand": Field(**META)})
    df = lambda *rows: spark.createDataFrame(rows, "id string, title string, brand string")
    ids = lambda found: [h.id for h in found["hits"]]
    service.create("shop", config)
    with pytest.raises(ValueError):
        service.create("shop", config)
    with pytest.raises(NotFound):
        service.search("other", "x")
    with pytest.raises(ValueError):
        service.create("../x", config)
    service.add("shop", df(("a", "red fox", "x"), ("b", "dog", "y")))
    assert ids(service.search("shop", "fox")) == ["a"] and ids(service.search("shop", "fox")) == ["a"] and len(cache.held) == 1
    service.add("shop", df(("b", "fox fox", "y"), ("c", "cat", None)))
    assert ids(service.search("shop", "fox")) == ["b", "a"] and service.generation("shop") == 2 and service.gauge("shop") == 3
    service.remove("shop", df(("a", "", "")))
    assert ids(service.search("shop", "fox")) == ["b"] and service.autocomplete("shop", "c") == ["cat"]
    assert service.search_corrected("shop", "catt")["query"] == "cat"
    service.update_synonyms("shop", (Synonym("puss", ("cat",)),))
    assert ids(service.search("shop", "puss")) == ["c"]
    with pytest.raises(ValueError):
        service.add("shop", df(("", "x", "x")))
    with pytest.raises(ValueError):
        service.update_schema("shop", IndexConfig({"lacking": Field(searchable=True)}))
    assert service.update_schema("shop", IndexConfig({"brand": Field(searchable=True)})) == 2 and ids(service.search("shop", "y")) == ["b"]
    service.export("shop", str(tmp_path / "out"))
    snapshots = SnapshotService(service, str(tmp_path / "snaps"))
    name = snapshots.create("shop", "one")
    service.clear("shop")
    with pytest.raises(NotFound):
        service.documents("shop")
    assert service.restore("shop", str(tmp_path / "out"), config) == 2 and [r.id for r in service.list_documents("shop", 1, 1).collect()] == ["c"]
    service.remove("shop", df(("b", "", "")))
    assert snapshots.list("shop") == [name] and snapshots.restore("shop", name) == 2 and service.reindex("shop") == 2
    snapshots.delete("shop", name)
    assert snapshots.list("shop") == []
    with pytest.raises(NotFound):
        snapshots.restore("shop", name)
    service.delete("shop")
    assert service.names() == [] and not calls


def test_answers_expire_and_are_bounded():
    now, made = [0.0], []
    cache = AnswerCache(10, 2, lambda: now[0])
    get = lambda k: cache.get(k, lambda: made.append(k) or len(made))
    assert (get("a"), get("a"), get("b")) == (1, 1, 2)
    now[0] = 11
    assert (get("a"), get("c"), get("a"), get("b")) == (3, 4, 3, 5) and len(cache.held) == 2 and not cache.locks
    assert stable_key("s", a=1, b=SearchOptions()) == stable_key("s", b=SearchOptions(), a=1) != stable_key("s", a=2, b=SearchOptions())


def test_recommendation_service(spark, tmp_path):
    items = spark.createDataFrame([("a", "search engine"), ("b", "search ranking"), ("c", "cooking recipe")], "id string, text string")
    service = RecommendationService(spark, str(tmp_path), items)
    rows = lambda *x: spark.createDataFrame([(u, i, "click", None) for u, i in x], "user_id string, item_id string, type string, weight double").withColumn("occurred_at", F.lit("2026-01-01").cast("timestamp"))
    assert service.list().count() == 0
    service.record(rows(("u1", "a"), ("u1", "b"), ("u2", "a"), ("u2", "b"), ("t", "a")))
    with pytest.raises(NotFound):
        service.record(rows(("u1", "zz")))
    assert service.list().count() == 5 and service.popular().first().item_id == "a" and service.statistics().first().users == 3
    assert service.recommend_for_user("t", "2026-01-16").first().item_id == "b"
    assert service.recommend_items("a").first().item_id == "b"
    with pytest.raises(NotFound):
        service.recommend_items("zz")


def test_jobs(spark):
    jobs, seen = Jobs(), []
    jobs.register("ok", lambda p, report: (report(50), seen.append(p)))
    jobs.register("bad", lambda p, report: report(101))
    a = jobs.enqueue("ok", {"source_id": 1}, key="k")
    assert jobs.enqueue("ok", {}, key="k") is a
    b, c, d = jobs.enqueue("bad", {"source_id": 2}, 2), jobs.enqueue("none", {}, 1), jobs.enqueue("ok", {})
    assert jobs.cancel(d.id) and not jobs.cancel(d.id)
    while jobs.run_once():
        pass
    assert (a.status, a.progress, b.status, b.attempts, c.status, d.status) == ("completed", 100, "failed", 2, "failed", "cancelled") and "0 to 100" in b.error and len(seen) == 1
    sources = spark.createDataFrame([(1, "p", "u"), (2, "q", "v")], "source_id int, project string, url string")
    assert [r.job_id for r in jobs.listing(sources).collect()] == [b.id, a.id] and [r.job_id for r in jobs.listing(sources, "p").collect()] == [a.id]


def test_segment_dictionary_statistics_and_manifests(spark, tmp_path):
    config = IndexConfig({"title": Field(searchable=True)})
    store = SegmentStore(spark, str(tmp_path / "s"), config=config)
    df = lambda *rows: spark.createDataFrame(rows, "id string, title string")
    name = store.flush(df(("a", "red fox"), ("b", "red")))
    assert {(r.term, r.df) for r in store.index(name).terms.collect()} == {("red", 2), ("fox", 1)} and store.index(name).stats.first().total_len == 3
    store.flush(df(("b", "dog red"), ("c", "dog")))
    assert {r.id for r in store.search("red").collect()} == {"a", "b"}
    other = SegmentStore(spark, str(tmp_path / "s"), config=config)
    m = other.manifest()
    store.delete(df(("a", "")))
    with pytest.raises(FileExistsError):
        other._save(m)
    newest = tmp_path / "s" / store._manifests()[0]
    newest.write_text("{cut")
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    assert {r.id for r in SegmentStore(spark, str(tmp_path / "s")).documents().collect()} == {"a", "b", "c"}


def test_crawl_limits_and_frontier(spark):
    assert pages.CrawlLimits().max_depth == 3
    for bad in (dict(max_depth=21), dict(max_pages=0), dict(concurrency=1.5), dict(delay_ms=-1)):
        with pytest.raises(ValueError):
            pages.CrawlLimits(**bad)
    edges = spark.createDataFrame([("http://h/a", "http://h/b"), ("http://h/b", "http://h/c"), ("http://h/c", "http://h/a"), ("http://h/b", "bad")], "url string, link string")
    seeds = spark.createDataFrame([("http://h/a",)], "url string")
    assert sorted((r.url[-1], r.depth) for r in pages.frontier(edges, seeds, 5).collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_private_networks(spark):
    import ipaddress

    r = random.Random(2)
    ips = [str(ipaddress.ip_address(r.getrandbits(32))) for _ in range(300)]
    for n in map(ipaddress.ip_network, urls.PRIVATE_NETWORKS):
        ips += [str(n[0]), str(n[-1])] + ([str(n[0] - 1)] if int(n[0]) else []) + [str(n[-1] + 1)]
    inside = lambda x: any(ipaddress.ip_address(x) in ipaddress.ip_network(n) for n in urls.PRIVATE_NETWORKS)
    more = {"http://localhost/": True, "http://x.localhost:8/": True, "http://[::1]/": True, "http://[::]/": True, "http://[fd12::1]/": True, "http://[fe90::1]/": True, "http://[2001:db8::1]/": False, "http://10.example/": False}
    rows = [(f"http://{x}/", inside(x)) for x in ips] + list(more.items())
    for x in spark.createDataFrame(rows, "u string, want boolean").withColumn("got", urls.is_private(F.col("u"))).collect():
        assert x.got == x.want, x.u


def test_robots_runs():
    r = urls.Robots("Disallow: /nobody\nUser-agent: A\nUser-agent: b # two\nDisallow: /x\nAllow: /x/y\nCrawl-delay: 1.5\nSitemap: z\nUser-agent: *\nDisallow: /\nuser-agent: a\nDisallow:\nDisallow: /q\n")
    assert r.allowed("http://h/x/y", "A-bot") and not r.allowed("http://h/x/z", "bbb") and not r.allowed("http://h/q", "a") and r.allowed("http://h/w", "a")
    assert not r.allowed("http://h/w", "c") and r.delay_ms("a") == 1500 and r.delay_ms("c") is None and urls.Robots("").allowed("http://h/", "x")


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_percentiles_like_sorting(spark, n):
    r = random.Random(n)
    values = [r.choice([float(r.randrange(9)), r.expovariate(0.01), 1e9]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got, s = analytics.percentiles(df, "v").first(), sorted(values)
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        at = (n - 1) * q if n else 0
        want = s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at)) if n else 0.0
        assert got[name] == pytest.approx(want, abs=1e-4)
    disc = analytics.nearest_rank(df, "v", [0.5, 0.95]).first()
    assert disc.p95 == (s[max(0, math.ceil(round(0.95 * n, 9)) - 1)] if n else None)


def test_heavy_users_in_tiles(spark):
    r = random.Random(5)
    rows = list({(f"u{u}", i): (f"u{u}", i, float(r.randrange(1, 5))) for u in range(4) for i in r.sample(range(60), (50, 12, 3, 1)[u])}.values())
    s = spark.createDataFrame(rows, "user_id string, item_id int, strength double")
    get = lambda tile: sorted((x.item_id, x.neighbour, round(x.score, 9)) for x in recommend.neighbours(s, tile).collect())
    assert get(2000) == get(7) == get(1) and len(get(7)) > 1000


def test_vector_functions(spark):
    v = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in (kv[0], float(kv[1]))])
    r = spark.range(1).select(recommend.dot(v(x=1, y=2), v(y=2, z=5)).alias("d"), recommend.normalized(v(a=3, b=4)).alias("n"), recommend.cosine(v(a=3, b=4), v(a=6, b=8)).alias("c")).first()
    assert r.d == 4 and r.n == pytest.approx({"a": 0.6, "b": 0.8}) and r.c == pytest.approx(1)


def test_stored_index_of_two_fields(spark, tmp_path):
    docs = spark.createDataFrame(corpus(40), DOCS)
    StoredIndex.write(docs, CONFIG, str(tmp_path / "i"))
    i = StoredIndex(spark, str(tmp_path / "i"))
    assert {(r.term, r.df) for r in i.vocabulary.collect()} == {(r.term, r.df) for r in SearchIndex(docs, CONFIG).vocabulary().collect()}


def test_postings_and_vectors_need_no_shuffle_of_their_own(spark, tmp_path):
    from lodestone.operators import index, recommend

    docs = spark.createDataFrame([(k, f"w{k % 5} " * (k % 7) + "red fox") for k in range(50)], "id int, text string")
    config = IndexConfig({"text": Field(searchable=True)})
    assert "Exchange" not in index.postings(docs, config)._jdf.queryExecution().executedPlan().toString()
    docs.repartition(1).write.parquet(f"{tmp_path}/d")
    source = spark.read.parquet(f"{tmp_path}/d")
    got = recommend.stored_vectors(source, source)
    want = recommend.content_vectors(docs)
    rows = lambda df: sorted((r.item_id, r.term, round(r.value, 9)) for r in df.collect())
    assert rows(got) == rows(want)


def test_filters_alone_write_no_index(spark):
    from lodestone.config import Filter

    def never():
        raise AssertionError("an index was asked for")

    docs = spark.createDataFrame([(1, "red", 5), (2, "fox", 7)], "id int, text string, n int")
    config = IndexConfig({"text": Field(searchable=True), "n": Field(filterable=True)})
    found = SearchIndex(docs, config, stored=never).search("", SearchOptions(filters=(Filter("n", "greaterThan", 5),)))
    assert [r.id for r in found.collect()] == [2]
