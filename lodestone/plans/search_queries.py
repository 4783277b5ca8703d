"""Ranked search over documents and part."""

from pyspark.sql import functions as F

from lodestone.config import BoostRule, Field, Filter, IndexConfig, RecencyRule, SearchOptions, Sort, Synonym, TokenizerOptions, TypoTolerance
from lodestone.operators import batch, suggest
from lodestone.operators.search import SearchIndex, fuzzy_terms
from lodestone.operators.stored import StoredIndex
from lodestone.plans import sql
from lodestone.sources.tables import read_table

QUERIES, ORACLES = {}, {}
META = dict(filterable=True, facetable=True, sortable=True)
DOCUMENTS = {"text": Field(searchable=True), "lang": Field(**META), "source": Field(**META), "n_chars": Field(**META), "quality": Field(**META)}
PART = {"p_name": Field(searchable=True, weight=3.0), "p_type": Field(searchable=True), "p_brand": Field(**META), "p_size": Field(**META), "p_retailprice": Field(**META)}


def add(name, run, oracle=None):
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def documents(spark, sf, quality=False, **config):
    d, config = read_table(spark, sf, "documents"), IndexConfig(DOCUMENTS, **config)
    stored = lambda source=d: StoredIndex.of(source, config, "doc_id")
    if quality:
        d = d.join(read_table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return SearchIndex(d, config, "doc_id", stored)


def parts(spark, sf, **config):
    d = read_table(spark, sf, "part")
    return SearchIndex.written(d, IndexConfig(PART, **config), "p_partkey")


def exact(query):
    words = [w for w in query.lower().replace('"', " ").split()]
    return [(w, w, words.count(w)) for w in dict.fromkeys(words)]


def hits(index_of, query, options=SearchOptions(), id="doc_id"):
    return lambda spark, sf: index_of(spark, sf).search(query, options).select(id, "score")


def doc_sql(query, where="TRUE", table="documents", terms=None, **kw):
    """CTEs ending in m(doc_id, score) of the matches."""
    return f"WITH {sql.scores(table, 'doc_id', {'text': 1.0}, terms or exact(query), **kw)},\nm AS (SELECT d.*, b.score FROM base b JOIN documents d ON d.doc_id = b.id WHERE b.score > 0 AND {where})"


def part_sql(query, fields=None, terms=None):
    return f"WITH {sql.scores('part', 'p_partkey', fields or {'p_name': 3.0, 'p_type': 1.0}, terms or exact(query))},\nm AS (SELECT d.*, b.score FROM base b JOIN part d ON d.p_partkey = b.id)"


def best(limit=10, offset=0, id="doc_id", score="score", order=None):
    return f" SELECT {id}, round({score}, 6) AS score FROM m ORDER BY {order or 'round(' + score + ', 6) DESC, ' + id} LIMIT {limit} OFFSET {offset}"


add("bm25_topk", hits(documents, "this er ha"), doc_sql("this er ha") + best())
add("bm25_single", hits(documents, "this"), doc_sql("this") + best())
add("tfidf_topk", hits(documents, "this er ha", SearchOptions(ranking="tfidf")), doc_sql("this er ha", ranking="tfidf") + best())
add("bm25_tuned", hits(documents, "this er ha", SearchOptions(k1=2.0, b=0.3)), doc_sql("this er ha", k1=2.0, b=0.3) + best())
add("bm25_repeated_terms", hits(documents, "this this er"), doc_sql("this this er") + best())
add("bm25_page", hits(documents, "this er ha", SearchOptions(limit=15, offset=20)), doc_sql("this er ha") + best(15, 20))
add("bm25_multifield_weighted", hits(parts, "small ring economy", SearchOptions(limit=50), "p_partkey"), part_sql("small ring economy") + best(50, id="p_partkey"))
add("bm25_field_restricted", hits(parts, "small ring", SearchOptions(limit=50, fields=("p_type",)), "p_partkey"), part_sql("small ring", {"p_type": 1.0}) + best(50, id="p_partkey"))

# filters, over all matches of a query or over all documents

FILTERS = {
    "filter_equals": (Filter("lang", "equals", "en"), "lang = 'en'"),
    "filter_in": (Filter("lang", "in", ("de", "fr")), "lang IN ('de', 'fr')"),
    "filter_not_equals": (Filter("quality", "notEquals", 1), "coalesce(quality, 0) <> 1"),
    "filter_not_in": (Filter("source", "notIn", ("src1", "src2")), "coalesce(source NOT IN ('src1', 'src2'), TRUE)"),
    "filter_gt": (Filter("n_chars", "greaterThan", 1000), "n_chars > 1000"),
    "filter_gte": (Filter("n_chars", "greaterThanOrEqual", 1000), "n_chars >= 1000"),
    "filter_lt": (Filter("n_chars", "lessThan", 1000), "n_chars < 1000"),
    "filter_lte": (Filter("n_chars", "lessThanOrEqual", 1000), "n_chars <= 1000"),
    "filter_exists": (Filter("quality", "exists"), "quality IS NOT NULL"),
    "filter_missing": (Filter("quality", "exists", False), "quality IS NULL"),
}
for _name, (_filter, _where) in FILTERS.items():
    add(
        _name,
        (lambda f: lambda spark, sf: documents(spark, sf, True).search("", SearchOptions(filters=(f,), limit=None)).select("doc_id", F.col("score").cast("double").alias("score")))(_filter),
        f"SELECT d.doc_id, 0.0::DOUBLE AS score FROM documents d LEFT JOIN labels l USING (doc_id) WHERE {_where}",
    )
BOTH = (Filter("lang", "equals", "en"), Filter("n_chars", "greaterThan", 500))
add("filter_and_search", hits(documents, "this er", SearchOptions(filters=BOTH)), doc_sql("this er", "lang = 'en' AND n_chars > 500") + best())
add("filter_only", hits(documents, "", SearchOptions(filters=BOTH, sort=Sort("n_chars", True))), "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE lang = 'en' AND n_chars > 500 ORDER BY n_chars DESC, doc_id LIMIT 10")
add(
    "sort_field_nulls_last",
    lambda spark, sf: documents(spark, sf, True).search("this", SearchOptions(sort=Sort("quality", True), limit=200)).select("doc_id", "quality", "score"),
    doc_sql("this") + " SELECT m.doc_id, l.quality, round(m.score, 6) AS score FROM m LEFT JOIN labels l USING (doc_id) ORDER BY l.quality DESC NULLS LAST, round(m.score, 6) DESC, m.doc_id LIMIT 200",
)
add(
    "facet_counts",
    lambda spark, sf: documents(spark, sf).facets("this er", SearchOptions(facets=("lang",))),
    doc_sql("this er") + " SELECT 'lang' AS facet, lang AS value, count(DISTINCT doc_id) AS n FROM m WHERE lang IS NOT NULL GROUP BY lang",
)
add(
    "facet_multi",
    lambda spark, sf: parts(spark, sf).facets("small ring", SearchOptions(facets=("p_brand", "p_size"))),
    part_sql("small ring") + " SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM m GROUP BY p_brand UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM m GROUP BY p_size",
)
add("search_total", lambda spark, sf: documents(spark, sf).total("this er ha"), doc_sql("this er ha") + " SELECT count(*) AS total FROM m")

# phrases, proximity, rules

PHRASE = ', p AS (SELECT DISTINCT a.id FROM t_text_all a JOIN t_text_all b ON a.id = b.id AND b.pos = a.pos + {gap} WHERE a.term = {a} AND b.term = {b})'
for _name, _query, _a, _b, _gap in (("phrase_match", '"er this"', "er", "this", 1), ("phrase_with_gap", '"er and ha"', "er", "ha", 2)):
    add(
        _name,
        hits(documents, _query, SearchOptions(limit=None)),
        doc_sql(f"{_a} {_b}") + PHRASE.format(gap=_gap, a=sql.quoted(_a), b=sql.quoted(_b)) + " SELECT doc_id, round(score, 6) AS score FROM m SEMI JOIN p ON p.id = m.doc_id",
    )
NEAR = """, d AS (SELECT a.id, min(abs(a.pos - b.pos)) AS d FROM t_text_all a JOIN t_text_all b ON a.id = b.id AND a.term < b.term WHERE a.term IN {terms} AND b.term IN {terms} GROUP BY a.id),
n AS (SELECT m.doc_id, m.score * (1 + CASE WHEN d.d <= 5 THEN 0.1 * (1 - greatest(0, d.d - 1) / 5.0::DOUBLE) ELSE 0 END) AS s FROM m LEFT JOIN d ON d.id = m.doc_id)
SELECT doc_id, round(s, 6) AS score FROM n ORDER BY round(s, 6) DESC, doc_id LIMIT 10"""
add("proximity_boost", hits(documents, "this er ha", SearchOptions(proximity=True)), doc_sql("this er ha") + NEAR.format(terms="('this', 'er', 'ha')"))
add(
    "ranking_rule_boost",
    hits(lambda spark, sf: documents(spark, sf, rules=(BoostRule("lang", "equals", 1.5, "en"), BoostRule("source", "notEquals", 1.2, "src1"))), "this er"),
    doc_sql("this er") + best(score="(score + greatest(score, 1) * (CASE WHEN lang = 'en' THEN 0.5 ELSE 0 END + CASE WHEN coalesce(source <> 'src1', TRUE) THEN 0.2 ELSE 0 END))"),
)


def dated(spark, sf):
    day = F.when(F.col("doc_id") % 11 == 0, F.lit("unknown")).otherwise(F.date_format(F.date_sub(F.lit("2024-06-01").cast("date"), (F.col("doc_id") % 90).cast("int")), "yyyy-MM-dd"))
    d = read_table(spark, sf, "documents")
    config = IndexConfig({"text": Field(searchable=True), "published": Field()}, rules=(RecencyRule("published", 10.0, 0.5),))
    return SearchIndex(d.select("doc_id", "text").withColumn("published", day), config, "doc_id", StoredIndex.of(d, config, "doc_id"))


add(
    "ranking_rule_recency",
    hits(dated, "this er", SearchOptions(now="2024-06-01 00:00:00")),
    doc_sql("this er") + best(score="(score + CASE WHEN doc_id % 11 = 0 THEN 0 ELSE greatest(score, 1) * pow(2, -(doc_id % 90) / 10.0::DOUBLE) * 0.5 END)"),
)

# resolved terms

SYNONYMS = (Synonym("er", ("ha", "es")), Synonym("this", ("en",), True))
add(
    "synonym_expand",
    hits(lambda spark, sf: documents(spark, sf, synonyms=SYNONYMS, synonym_penalty=0.5), "er en"),
    doc_sql("", terms=[("er", "er", 1), ("er", "ha", 0.5), ("er", "es", 0.5), ("en", "en", 1), ("en", "this", 0.5)]) + best(),
)
# DuckDB counts bytes, so other letters than the queries' become one byte; length and first letter narrow the words before distances are worked out
NEAR_TERMS = """v AS MATERIALIZED (SELECT term, count(DISTINCT id) AS df FROM t WHERE left(term, 1) IN ({first}) AND length(term) BETWEEN {low} AND {high} GROUP BY term),
q(query, most) AS (VALUES {values}),
n AS MATERIALIZED (SELECT query, most, term, df, regexp_replace(term, '[^a-z0-9]', '_', 'g') AS plain FROM v JOIN q ON left(query, 1) = left(term, 1) WHERE abs(length(query) - length(term)) <= most),
f AS MATERIALIZED (SELECT query, term, df, levenshtein(query, plain)::INT AS distance, most FROM n),
z AS (SELECT query, term, df, distance, greatest(0.25, 1 - distance / (most + 1)::DOUBLE) AS penalty FROM f WHERE distance <= most AND query NOT IN (SELECT term FROM v))"""


def near_terms(queries):
    values = [(q, 1 if len(q) <= 4 else 2) for q in queries]
    return NEAR_TERMS.format(
        first=", ".join(sorted({f"'{q[0]}'" for q in queries})),
        low=min(len(q) - m for q, m in values),
        high=max(len(q) + m for q, m in values),
        values=", ".join(map(str, values)),
    )


MISSPELT = ["thiss", "erthz", "haq"]
add(
    "fuzzy_expand",
    lambda spark, sf: fuzzy_terms(documents(spark, sf).vocabulary(), MISSPELT).withColumn("penalty", F.round("penalty", 6)),
    f"WITH {sql.live('t', 'documents', 'doc_id', 'text')}, {near_terms(MISSPELT)} SELECT query, term, df, distance, round(penalty, 6) AS penalty FROM z",
)
add(
    "fuzzy_search",
    hits(documents, "thiss erthz", SearchOptions(typo=TypoTolerance())),
    f"""WITH {sql.live('t', 'documents', 'doc_id', 'text')}, {near_terms(["thiss", "erthz"])},
w AS MATERIALIZED (SELECT term, penalty AS factor FROM z UNION ALL SELECT query, 1.0 FROM q WHERE query IN (SELECT term FROM v)),
l AS (SELECT d.doc_id AS id, count(t.term)::DOUBLE AS n FROM documents d LEFT JOIN t ON t.id = d.doc_id GROUP BY 1),
s AS (SELECT count(*)::DOUBLE AS n, avg(n) AS a FROM l),
c AS (SELECT id, term, count(*)::DOUBLE AS tf FROM t SEMI JOIN w USING (term) GROUP BY 1, 2),
d AS (SELECT term, count(*)::DOUBLE AS df FROM c GROUP BY 1)
SELECT c.id AS doc_id, round(sum(w.factor * {sql.BM25.format(k1=1.2, b=0.75)}), 6) AS score FROM c JOIN d USING (term) JOIN w USING (term) JOIN l USING (id), s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
add(
    "explain_terms",
    lambda spark, sf: parts(spark, sf).explain("small ring", SearchOptions(limit=20)).select("p_partkey", "term", "field", "tf", F.round("share", 6).alias("share")),
    part_sql("small ring") + ", h AS (SELECT p_partkey FROM m ORDER BY round(score, 6) DESC, p_partkey LIMIT 20) SELECT id AS p_partkey, term, field, tf, round(share, 6) AS share FROM shares SEMI JOIN h ON h.p_partkey = shares.id",
)


def bm25_batch(spark, sf):
    """Every benchmark item as a query."""
    q = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return batch.search(read_table(spark, sf, "documents"), q, IndexConfig({"text": Field(searchable=True)}), "doc_id").drop("run")


add(
    "bm25_batch",
    bm25_batch,
    f"""WITH {sql.live("t", "documents", "doc_id", "text")},
{sql.live("w", "benchmark", "item_id", "text")},
q AS (SELECT id AS query_id, term, count(*) AS qf FROM w GROUP BY ALL),
l AS (SELECT d.doc_id AS id, count(t.term)::DOUBLE AS n FROM documents d LEFT JOIN t ON t.id = d.doc_id GROUP BY 1),
s AS (SELECT count(*)::DOUBLE AS n, avg(n) AS a FROM l),
c AS (SELECT id, term, count(*)::DOUBLE AS tf FROM t SEMI JOIN q USING (term) GROUP BY 1, 2),
d AS (SELECT term, count(*)::DOUBLE AS df FROM c GROUP BY 1),
x AS (SELECT q.query_id, c.id, round(sum(q.qf * {sql.BM25.format(k1=1.2, b=0.75)}), 6) AS score FROM c JOIN d USING (term) JOIN q USING (term) JOIN l USING (id), s GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM x QUALIFY rank <= 10""",
)

# spelling, autocomplete, highlights

add(
    "autocomplete",
    lambda spark, sf: suggest.autocomplete(documents(spark, sf).vocabulary(), "th"),
    f"WITH {sql.live('t', 'documents', 'doc_id', 'text')} SELECT term, count(DISTINCT id) AS df FROM t WHERE starts_with(term, 'th') GROUP BY term ORDER BY df DESC, term LIMIT 10",
)
SPELL = """{live}, v AS (SELECT term, count(DISTINCT id) AS df FROM t GROUP BY term),
q(position, term, most) AS (VALUES {values}),
sc AS (SELECT q.position, q.term, v.term AS candidate, v.df, levenshtein(q.term, regexp_replace(v.term, '[^a-z0-9]', '_', 'g'))::INT AS distance, q.most FROM q JOIN v ON left(q.term, 1) = left(v.term, 1) AND abs(length(q.term) - length(v.term)) <= q.most),
sr AS (SELECT *, row_number() OVER w AS r, lead(distance) OVER w AS d2, lead(df) OVER w AS df2, max(df) OVER (PARTITION BY position) AS most_df FROM sc WHERE distance <= most WINDOW w AS (PARTITION BY position ORDER BY distance, df DESC, candidate)),
sb AS (SELECT *, (1 - distance / (greatest(length(term), length(candidate)) + 1)::DOUBLE) * 0.8 + ln(1 + df) / ln(1 + most_df) * 0.2 AS confidence FROM sr WHERE r = 1),
g AS (SELECT * FROM sb WHERE distance > 0 AND confidence >= 0.65 AND NOT coalesce(d2 = distance AND df2 >= 0.9 * df, FALSE)),
fixed AS (SELECT q.position, q.term, coalesce(g.candidate, q.term) AS corrected, g.distance, round(g.confidence, 6) AS confidence FROM q LEFT JOIN g USING (position))"""


def spell_sql(query):
    values = ", ".join(f"({k}, {sql.quoted(w)}, {1 if len(w) <= 4 else 2})" for k, w in enumerate(query.split()))
    return "WITH " + SPELL.format(live=sql.live("t", "documents", "doc_id", "text"), values=values)


add("spell_correct", lambda spark, sf: suggest.correct("wherr this zzzzz thandd", documents(spark, sf).vocabulary()).withColumn("confidence", F.round("confidence", 6)), spell_sql("wherr this zzzzz thandd") + " SELECT * FROM fixed")


def highlight_page(spark, sf):
    page = documents(spark, sf).search("this er ha").select("doc_id", "text", "score")
    return suggest.highlight(page, "text", ["this", "er", "ha"]).select("doc_id", "highlight")


add("highlight_page", highlight_page)


# the analysis of documents and queries by other options

WIDE = {"this": "ｔｈｉｓ", "fi": "ﬁ", "é": "e\u0301", "ü": "u\u0308"}


def denormal(text):
    """text with full-width letters, ligatures and separate accents: NFKC makes it text again."""
    for a, b in WIDE.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def analysed(name, text=None, **options):
    """documents in an index of its own."""

    def of(spark, sf):
        d = read_table(spark, sf, "documents").select("doc_id", "text")
        d = d.withColumn("text", text(F.col("text"))) if text else d
        return SearchIndex.written(d, IndexConfig({"text": Field(searchable=True)}, tokenizer=TokenizerOptions(**options)), "doc_id")

    return of


def table_sql(expression, terms):
    """The search over a table of terms made ready by an expression of a document's tokens x."""
    ready = f"{sql.live('r', 'documents', 'doc_id', 'text')}, o AS (SELECT id, list(term ORDER BY pos) AS x FROM r GROUP BY id), rd AS (SELECT d.doc_id, array_to_string({expression}, ' ') AS text FROM documents d LEFT JOIN o ON o.id = d.doc_id)"
    return f"WITH {ready},\n{sql.scores('rd', 'doc_id', {'text': 1.0}, [(t, t, 1) for t in terms], stops=False)},\nm AS (SELECT b.id AS doc_id, b.score FROM base b WHERE b.score > 0)" + best()


add("search_nfkc", hits(analysed("nfkc", denormal), "this er fi"), doc_sql("this er fi") + best())
add(
    "search_stemmed",
    hits(analysed("stemmed", stemmer=lambda x: F.regexp_replace(x, "s$", "")), "thiss ers anss"),
    table_sql("list_filter(list_transform(x, lambda y: regexp_replace(y, 's$', '')), lambda y: y <> '')", ["this", "er", "ans"]),
)
add(
    "search_ngrams",
    hits(analysed("ngrams", ngrams=(1, 2), separator="qq"), "er this ha"),
    table_sql("list_concat(x, list_transform(range(1, len(x)), lambda i: x[i] || 'qq' || x[i + 1]))", ["er", "this", "ha", "erqqthis", "thisqqha"]),
)
add(
    "search_corrected",
    lambda spark, sf: documents(spark, sf).search_corrected("thandd")[0].select("doc_id", "score"),
    spell_sql("thandd")
    + f""", w AS (SELECT corrected AS term FROM fixed),
l AS (SELECT d.doc_id AS id, count(t.term)::DOUBLE AS n FROM documents d LEFT JOIN t ON t.id = d.doc_id GROUP BY 1),
s AS (SELECT count(*)::DOUBLE AS n, avg(n) AS a FROM l),
c AS (SELECT id, term, count(*)::DOUBLE AS tf FROM t SEMI JOIN w USING (term) GROUP BY 1, 2),
d AS (SELECT term, count(*)::DOUBLE AS df FROM c GROUP BY 1)
SELECT c.id AS doc_id, round(sum({sql.BM25.format(k1=1.2, b=0.75)}), 6) AS score FROM c JOIN d USING (term) JOIN l USING (id), s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)

