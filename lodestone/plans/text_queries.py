"""Text analysis and index tables."""

from pyspark.sql import functions as F

from lodestone.config import Field, IndexConfig, TokenizerOptions
from lodestone.functions import scoring, text
from lodestone.operators import index
from lodestone.plans import sql
from lodestone.sources.tables import read_table, remove, spread, upsert, validate

QUERIES, ORACLES = {}, {}
PARTS = IndexConfig({"p_name": Field(searchable=True, weight=3.0), "p_type": Field(searchable=True)})
DOCS = IndexConfig({"text": Field(searchable=True)})


def query(oracle=None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def docs(spark, sf):
    return spread(read_table(spark, sf, "documents").select("doc_id", "text"))


def digest(column):
    """A long result as one string a row."""
    return F.array_join(column, " ")


LIVE = "WITH " + sql.live("t", "documents", "doc_id", "text")


@query(LIVE + " SELECT id AS doc_id, pos AS position, term AS token FROM t")
def tokenize_positions(spark, sf):
    return index.token_rows(docs(spark, sf), "doc_id", "text").select("doc_id", "position", "token")


@query(LIVE + " SELECT d.doc_id, coalesce((SELECT string_agg(term, ' ' ORDER BY pos) FROM t WHERE t.id = d.doc_id), '') AS tokens FROM documents d")
def tokenize_default(spark, sf):
    return docs(spark, sf).select("doc_id", digest(text.tokenize(F.col("text"))).alias("tokens"))


@query(
    f"WITH {sql.tokens('t', 'conversations', 'struct_pack(conv_id, turn)', 'text')} SELECT id.conv_id AS conv_id, id.turn AS turn, count(*) AS n_all, count(*) FILTER (WHERE term NOT IN ({sql.STOPS})) AS n_live FROM t GROUP BY ALL"
)
def stopword_removal(spark, sf):
    raw = text.raw_tokens(F.col("text"))
    out = spread(read_table(spark, sf, "conversations")).select("conv_id", "turn", F.size(raw).cast("long").alias("n_all"), F.size(text.remove_stop_words(raw)).cast("long").alias("n_live"))
    return out.where("n_all > 0")


@query(
    "WITH " + sql.live("t", "benchmark", "item_id", "text") + ", r AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY pos) AS i FROM t), "
    "g AS (SELECT id, 1 AS n, i, term AS gram FROM r UNION ALL SELECT a.id, 2, a.i, a.term || ' ' || b.term FROM r a JOIN r b ON a.id = b.id AND b.i = a.i + 1) "
    "SELECT id AS item_id, string_agg(gram, '|' ORDER BY n, i) AS grams FROM g GROUP BY id"
)
def ngrams_1_2(spark, sf):
    out = text.ngrams(text.tokenize(F.col("text")), 1, 2)
    return spread(read_table(spark, sf, "benchmark")).select("item_id", F.array_join(out, "|").alias("grams")).where("grams <> ''")


@query(
    "WITH " + sql.live("t", "benchmark", "item_id", "text") + ", r AS (SELECT id, pos, term, row_number() OVER (PARTITION BY id ORDER BY pos) AS i FROM t) "
    "SELECT a.id AS item_id, a.pos AS position, a.term || ' ' || b.term AS gram FROM r a JOIN r b ON a.id = b.id AND b.i = a.i + 1"
)
def ngrams_detailed(spark, sf):
    rows = index.token_rows(spread(read_table(spark, sf, "benchmark")), "item_id", "text", TokenizerOptions(ngrams=(2, 2)))
    return rows.select("item_id", "position", F.col("token").alias("gram"))


@query(LIVE + ", s AS (SELECT regexp_replace(term, 's$', '') AS stem FROM t) SELECT stem, count(*) AS n FROM s WHERE stem <> '' GROUP BY stem")
def stem_plural(spark, sf):
    o = TokenizerOptions(stemmer=lambda x: F.regexp_replace(x, "s$", ""))
    return index.token_rows(docs(spark, sf), "doc_id", "text", o).groupBy(F.col("token").alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH x AS (SELECT conv_id, turn, regexp_replace(lower(text), '{text.PUNCTUATION}', '', 'g') AS t FROM conversations) SELECT conv_id, turn, trim(regexp_replace(t, '{text.WS}+', ' ', 'g')) AS clean FROM x"
)
def punct_remove(spark, sf):
    out = text.normalize_token(F.col("text"), TokenizerOptions(punctuation="remove"))
    return spread(read_table(spark, sf, "conversations")).select("conv_id", "turn", out.alias("clean"))


@query(
    f"WITH x AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) SELECT doc_id, count(*) AS n_marks FROM x WHERE regexp_matches(c, '^{text.PUNCTUATION}$') GROUP BY doc_id"
)
def punctuation_count(spark, sf):
    marks = F.size(F.filter(F.split("text", ""), text.is_punctuation)).cast("long")
    return docs(spark, sf).select("doc_id", marks.alias("n_marks")).where("n_marks > 0")


@query("SELECT doc_id, text || ' fin café full kg' AS normal FROM documents")
def unicode_normalize(spark, sf):
    """The texts of the test tables are in normal form: accents are set apart, letters made wide, and such words added."""
    made = F.concat("text", F.lit(" \ufb01n cafe\u0301 \uff46\uff55\uff4c\uff4c \u338f"))
    for a, b in (("é", "e\u0301"), ("ñ", "n\u0303"), ("ö", "o\u0308"), ("th", "\uff54\uff48")):
        made = F.replace(made, F.lit(a), F.lit(b))
    return docs(spark, sf).select("doc_id", text.normalize_unicode(made).alias("normal"))


POSTS = LIVE + ", p AS (SELECT id, term, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM t GROUP BY id, term)"


@query(POSTS + " SELECT id AS doc_id, term, tf::INT AS tf, positions FROM p")
def postings(spark, sf):
    p = index.postings(docs(spark, sf), DOCS, "doc_id")
    return p.select(F.col("id").alias("doc_id"), "term", "tf", F.array_join("positions", ",").alias("positions"))


@query(POSTS + " SELECT id AS doc_id, tf::INT AS tf, positions FROM p WHERE term = 'this'")
def term_lookup(spark, sf):
    """Only rows with the term reach the shuffle: the filter goes below the grouping."""
    p = index.lookup(index.postings(docs(spark, sf), DOCS, "doc_id"), "This")
    return p.select(F.col("id").alias("doc_id"), "tf", F.array_join("positions", ",").alias("positions"))


@query(LIVE + " SELECT term, count(DISTINCT id) AS df FROM t GROUP BY term")
def doc_freq(spark, sf):
    return docs(spark, sf).select(F.explode(F.array_distinct(text.tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


PART_FIELDS = f"""WITH {sql.live("a", "part", "p_partkey", "p_name")},
{sql.live("b", "part", "p_partkey", "p_type")},
l AS (SELECT p_partkey AS id, 'p_name' AS field, (SELECT count(*) FROM a WHERE a.id = p_partkey) AS n FROM part UNION ALL SELECT p_partkey, 'p_type', (SELECT count(*) FROM b WHERE b.id = p_partkey) FROM part)"""


def part(spark, sf):
    return read_table(spark, sf, "part")


@query(PART_FIELDS + ", v AS (SELECT term FROM a UNION SELECT term FROM b), d AS (SELECT id, sum(n) AS n FROM l GROUP BY id) SELECT count(*) AS n_docs, sum(n)::BIGINT AS total_len, round(avg(n), 6) AS avg_len, (SELECT count(*) FROM v) AS vocabulary FROM d")
def collection_stats(spark, sf):
    p = part(spark, sf)
    out = index.collection_stats(index.field_lengths(p, PARTS, "p_partkey"), index.postings(p, PARTS, "p_partkey"))
    return out.select("n_docs", "total_len", F.round("avg_len", 6).alias("avg_len"), "vocabulary")


@query(PART_FIELDS + " SELECT field, count(*) AS n_docs, sum(n)::BIGINT AS total_len, round(avg(n), 6) AS avg_len FROM l GROUP BY field")
def field_stats(spark, sf):
    out = index.field_stats(index.field_lengths(part(spark, sf), PARTS, "p_partkey"))
    return out.select("field", "n_docs", "total_len", F.round("avg_len", 6).alias("avg_len"))


@query(PART_FIELDS + " SELECT id, sum(n)::BIGINT AS total_len FROM l GROUP BY id")
def doc_stats(spark, sf):
    return index.document_stats(index.field_lengths(part(spark, sf), PARTS, "p_partkey"))


@query(PART_FIELDS + " SELECT field, term, count(DISTINCT id) AS df FROM (SELECT id, 'p_name' AS field, term FROM a UNION ALL SELECT id, 'p_type', term FROM b) GROUP BY ALL")
def term_field_freq(spark, sf):
    return index.term_field_df(index.postings(part(spark, sf), PARTS, "p_partkey")).select("field", "term", "df")


@query(PART_FIELDS + " SELECT DISTINCT id, field FROM (SELECT id, 'p_name' AS field, term FROM a UNION ALL SELECT id, 'p_type', term FROM b) WHERE term = 'small'")
def fields_for_term(spark, sf):
    return index.lookup(index.postings(part(spark, sf), PARTS, "p_partkey"), "small").select("id", "field")


@query(LIVE + " SELECT term, count(DISTINCT id) AS df, length(term)::INT AS n_chars FROM t WHERE length(term) BETWEEN 4 AND 6 GROUP BY term")
def vocabulary_by_length(spark, sf):
    words = F.filter(F.array_distinct(text.tokenize(F.col("text"))), lambda x: F.length(x).between(4, 6))
    return docs(spark, sf).select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", F.length("term").alias("n_chars"))


@query(LIVE + ", d AS (SELECT term, count(DISTINCT id)::DOUBLE AS df FROM t GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n FROM documents) SELECT term, round(ln(n / df), 6) AS idf, round(ln((n + 1) / (df + 1)) + 1, 6) AS smoothed FROM d, n")
def idf_formulas(spark, sf):
    n = read_table(spark, sf, "documents").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = doc_freq(spark, sf).crossJoin(F.broadcast(n))  # one row
    df = F.col("df").cast("double")
    return rows.select("term", F.round(scoring.inverse_document_frequency(F.col("n"), df), 6).alias("idf"), F.round(scoring.smoothed_idf(F.col("n"), df), 6).alias("smoothed"))


@query("SELECT doc_id, lang, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE source END AS source FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 10 = 0")
def mutate_documents(spark, sf):
    """A tenth of the documents is updated, a seventh removed, and updates of removed ones add them again."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    return upsert(remove(d, d.where("doc_id % 7 = 0"), "doc_id"), d.where("doc_id % 10 = 0").withColumn("source", F.lit("new")), "doc_id")


@query(
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'd' || doc_id END AS id, CASE WHEN doc_id % 5 = 0 THEN source ELSE n_chars::VARCHAR END AS level, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '2024-01-02' END AS day FROM documents)
SELECT doc_id, CASE WHEN id = '' THEN 'id' WHEN level IS NOT NULL AND try_cast(level AS BIGINT) IS NULL THEN 'level' ELSE 'day' END AS reason FROM r
WHERE id = '' OR (level IS NOT NULL AND try_cast(level AS BIGINT) IS NULL) OR (day IS NOT NULL AND try_cast(day AS DATE) IS NULL)"""
)
def validate_rejects(spark, sf):
    """Every document with an id that may be empty, a number that may be a source's name and a date that may be a language's."""
    id = F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.concat(F.lit("d"), "doc_id"))
    level = F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.col("n_chars").cast("string"))
    day = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("2024-01-02")
    d = read_table(spark, sf, "documents").select(id.alias("id"), "doc_id", level.alias("level"), day.alias("day"))
    return validate(d, {"doc_id": "bigint", "level": "bigint", "day": "date"})[1].select("doc_id", "reason")


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM documents")
def html_escape(spark, sf):
    return docs(spark, sf).select("doc_id", text.escape_html(F.col("text")).alias("escaped"))
