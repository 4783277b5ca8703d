"""Ranked search as one lazy plan.

Query words are resolved on the driver (exact, synonyms, and typo-tolerant ones found in the vocabulary). The
written index gives the postings of these terms alone, joined by document; without one the corpus is scanned
once per plan into a narrow frame of field lengths and of the query terms' places, nothing exploded. Statistics are one row of sums over the whole corpus, whatever the
filters, and join it by broadcast (one row). The best hits come by a top-k, not by a full sort.
"""

from __future__ import annotations

import re
import time
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import BoostRule, Filter, IndexConfig, SearchOptions
from lodestone.functions import scoring, text
from lodestone.operators import index, suggest
from lodestone.operators.stored import StoredIndex
from lodestone.sources.shared import shared_dir


_PARTS = "array<struct<query: string, term: string, kind: string, field: string, tf: int, share: double, df: bigint, idf: double, field_len: int, avg_len: double>>"


@dataclass(frozen=True)
class Phrase:
    source: str
    #: (token, places after the first)
    tokens: tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class Term:
    """A term to look for: what a query term resolved to, and the factor of its scores."""

    query: str
    term: str
    factor: float
    kind: str = "exact"


def parse_query(query: str, options=text.DEFAULT, spark=None) -> tuple[list[str], list[Phrase]]:
    """(terms, phrases): quoted parts are phrases whose tokens are terms as well, after the others; all analysed as documents are."""
    sources = re.findall(r'"([^"]+)"', query)
    rest, *quoted = text.analyzed(spark, [re.sub(r'"[^"]+"', " ", query), *sources], options)
    phrases = [Phrase(source, tuple((t, p - found[0][1]) for t, p in found)) for source, found in zip(sources, quoted) if found]
    return [t for t, _ in rest] + [t for p in phrases for t, _ in p.tokens], phrases


def filter_column(f: Filter, config: IndexConfig, kind: str) -> Column:
    """A filter's predicate. Missing values match only notEquals, notIn and exists = false; arrays match by any element, ranges by the first."""
    if not config.fields.get(f.field, None) or not config.fields[f.field].filterable:
        raise ValueError(f"{f.field} is not filterable")
    c, many = F.col(f.field), kind.startswith("array")
    values = list(f.value) if isinstance(f.value, (list, tuple, set)) else [f.value]
    hit = lambda: F.exists(c, lambda x: x.isin(values)) if many else c.isin(values)
    if f.operator in ("equals", "in"):
        return F.coalesce(hit(), F.lit(False))
    if f.operator in ("notEquals", "notIn"):
        return ~F.coalesce(hit(), F.lit(False))
    if f.operator == "exists":
        there = c.isNotNull() & (F.size(c) > 0) if many else c.isNotNull()
        return there if f.value is None or f.value else ~F.coalesce(there, F.lit(False))
    first = F.get(c, 0) if many else c
    textual = "string" in kind
    if kind == "boolean" or isinstance(values[0], bool) or isinstance(values[0], str) != textual:
        return F.lit(False)
    ops = {"greaterThan": first > values[0], "greaterThanOrEqual": first >= values[0], "lessThan": first < values[0], "lessThanOrEqual": first <= values[0]}
    return F.coalesce(ops[f.operator], F.lit(False))


class SearchIndex:
    """Search over docs: one row a document, one column a field. Without a written index each search scans the texts."""

    def __init__(self, docs: DataFrame, config: IndexConfig, id: str = "id", stored=None, once: bool = False):
        """stored: a StoredIndex, or what makes one; called by the first search for a word, so filters alone need none.

        once: a scan's lengths and places are written to the shared folder, so that statistics and hits split texts once.
        """
        self.docs, self.config, self.id, self._stored, self.once = docs, config, id, stored, once
        self.kinds = dict(docs.dtypes)
        self._words = {}

    @property
    def stored(self) -> StoredIndex | None:
        if callable(self._stored):
            self._stored = self._stored()
        return self._stored

    @classmethod
    def written(cls, docs: DataFrame, config: IndexConfig, id: str = "id", spread=None) -> SearchIndex:
        """Search over the written index of docs, which is made when it is first asked for."""
        return cls(docs, config, id, StoredIndex.of(docs, config, id, spread))

    # resolving

    def synonyms(self) -> dict[str, list[str]]:
        """Token to tokens, one step; every token of a source goes to every token of its targets."""
        an, out = text.Analyzer(), {}

        def add(a, b):
            for x in an.tokens(a):
                for y in an.tokens(b):
                    if x != y and y not in out.setdefault(x, []):
                        out[x].append(y)

        for s in self.config.synonyms:
            for t in s.targets:
                add(s.source, t)
                if s.bidirectional:
                    add(t, s.source)
        return out

    def vocabulary(self) -> DataFrame:
        """(term, df) over all searchable fields: terms of a document are made distinct before the shuffle."""
        if self.stored:
            return self.stored.vocabulary.select("term", "df")
        return index.words(self.docs, self.config).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def resolve(self, terms: list[str], options: SearchOptions) -> list[Term]:
        """Terms to look for; needs a job only if typos are tolerated."""
        synonyms, out, fuzzy = self.synonyms(), [], {}
        if options.typo and terms:
            found = fuzzy_terms(self.vocabulary(), set(terms), options.typo.max_distance, options.typo.prefix_length)
            for r in found.orderBy("query", "distance", F.desc("df"), "term").collect():
                fuzzy.setdefault(r["query"], []).append(r)
        for term, n in Counter(terms).items():
            out.append(Term(term, term, float(n)))
            out += [Term(term, s, n * self.config.synonym_penalty, "synonym") for s in synonyms.get(term, [])]
            out += [Term(term, r.term, n * r.penalty, "fuzzy") for r in fuzzy.get(term, [])]
        return out

    # the scan

    def allowed(self, options: SearchOptions) -> list[str]:
        for f in options.fields or ():
            if f not in self.config.searchable:
                raise ValueError(f"{f} is not searchable")
        return list(options.fields or self.config.searchable)

    def scan(self, terms: list[str], fields: list[str]) -> DataFrame:
        """docs with scan_<field>: its length and, for each term, the ascending positions of the term.

        One expression a field, whose inner lambda binds the token array: the text is split once.
        """
        if self.stored:
            return self.stored.scan(terms, fields, self.id)
        o, wanted = self.config.tokenizer, F.array(*[F.lit(t) for t in terms])

        def of(f):
            plain = not (o.stemmer or o.ngrams)
            tokens = text.raw_tokens(F.col(f), o) if plain else text.detailed(F.col(f), o)

            def measured(all_tokens):
                if plain:
                    length = F.size(text.remove_stop_words(all_tokens, o.stop_words))
                    hits = F.array_compact(F.transform(all_tokens, lambda x, i: F.when(x.isin(terms), F.struct(x.alias("token"), i.alias("position")))))
                else:
                    length, hits = F.size(all_tokens), F.filter(all_tokens, lambda x: x["token"].isin(terms))
                at = F.transform(F.array(hits), lambda h: F.transform(wanted, lambda t: F.transform(F.filter(h, lambda x: x["token"] == t), lambda x: x["position"])))
                return F.struct(length.alias("len"), F.get(at, 0).alias("at"))

            return F.get(F.transform(F.array(tokens), measured), 0).alias(f"scan_{f}")

        keep = [F.col(self.id)] + [F.col(c) for c in self.docs.columns if c != self.id and c in self.config.fields]
        rows = self.docs.select(*keep, *[of(f) for f in fields])
        found = [c for f in fields for c in (F.col(f"scan_{f}.len").alias(f"len_{f}"), F.col(f"scan_{f}.at").alias(f"at_{f}"))]
        if self.once:
            folder = f"{shared_dir(self.docs.sparkSession)}/scan-{uuid.uuid4().hex}"
            rows.select(self.id, *found).write.parquet(folder)
            return self.docs.sparkSession.read.parquet(folder)
        return rows.select(*keep, *found)

    def stats(self, rows: DataFrame, terms: list[str], fields: list[str]) -> DataFrame:
        """One row: documents, mean length of each field, document frequency of each term in it."""
        if self.stored:
            return self.stored.row(terms, fields)
        out = [F.count(F.lit(1)).cast("double").alias("n")]
        for f in fields:
            out.append(F.avg(f"len_{f}").alias(f"avg_{f}"))
            out.append(F.array(*[F.count_if(F.size(F.get(f"at_{f}", k)) > 0).cast("double") for k in range(len(terms))]).alias(f"df_{f}"))
        return rows.agg(*out)

    def _shares(self, resolved, terms, field, options) -> Column:
        """Of a field, an array with (tf, share) of each resolved term; one expression for any number of terms."""
        rank = scoring.strategy(options.ranking, options.k1, options.b)
        made = F.array(*[F.struct(F.lit(terms.index(r.term)).alias("k"), F.lit(r.factor * self.config.fields[field].weight).alias("w")) for r in resolved])

        def one(r):
            tf = F.size(F.get(f"at_{field}", r["k"])).cast("double")
            return F.struct(F.get(f"df_{field}", r["k"]).alias("df"), tf.alias("tf"), (r["w"] * rank(tf, F.col(f"len_{field}"), F.col("n"), F.col(f"avg_{field}"), F.get(f"df_{field}", r["k"]))).alias("share"))

        return F.transform(made, one)

    def _phrase(self, phrase: Phrase, terms, fields) -> Column:
        def at(f):
            rest = [(terms.index(t), d) for t, d in phrase.tokens[1:]]
            return F.exists(F.get(f"at_{f}", terms.index(phrase.tokens[0][0])), lambda p: reduce(lambda a, x: a & F.array_contains(F.get(f"at_{f}", x[0]), p + x[1]), rest, F.lit(True)))

        return reduce(lambda a, b: a | b, [F.coalesce(at(f), F.lit(False)) for f in fields])

    def _nearest(self, resolved, terms, fields) -> Column:
        """Least distance of two different terms within a field: neighbours among the merged positions suffice."""
        mine = list(dict.fromkeys(terms.index(r.term) for r in resolved))
        best = []
        for f in fields:
            tagged = F.array_sort(F.flatten(F.array(*[F.transform(F.get(f"at_{f}", k), (lambda k: lambda p: F.struct(p.alias("p"), F.lit(k).alias("k")))(k)) for k in mine])))
            gap = F.transform(tagged, lambda x, i: (lambda y: F.when(y["k"] != x["k"], y["p"] - x["p"]))(F.get(tagged, i + 1)))
            best.append(F.array_min(gap))
        return F.least(*best) if len(best) > 1 else best[0]

    def _rules(self, base: Column, options: SearchOptions) -> Column:
        added, at_least = F.lit(0.0), F.greatest(base, F.lit(1.0))
        for r in self.config.rules:
            c = F.col(r.field)
            if isinstance(r, BoostRule):
                equal = c.isNull() if r.value is None else F.coalesce(c == F.lit(r.value), F.lit(False))
                holds = {"exists": c.isNotNull(), "equals": equal, "notEquals": ~equal}[r.condition]
                added = added + F.when(holds, at_least * (r.boost - 1)).otherwise(0.0)
            else:
                now = F.lit(options.now).cast("timestamp") if options.now else F.current_timestamp()
                day = c.cast("timestamp") if self.kinds[r.field].startswith(("timestamp", "date")) else F.try_to_timestamp(c)
                age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(day)) / 86_400e6)
                added = added + F.when(day.isNotNull(), at_least * F.pow(F.lit(2.0), -age / r.half_life_days) * r.weight).otherwise(0.0)
        return F.greatest(F.lit(0.0), base + added)

    def parsed(self, query: str):
        if query not in self._words:
            self._words[query] = parse_query(query, self.config.tokenizer, self.docs.sparkSession)
        return self._words[query]

    def _kept(self) -> list[str]:
        return [c for c in self.docs.columns if c == self.id or c in self.config.fields]

    def matches(self, query: str, options: SearchOptions = SearchOptions(), parts: bool = False, columns: bool = True) -> DataFrame:
        """All matching documents with score, unordered; parts: with an array of each term's and field's share; without columns maybe id and score alone."""
        words, phrases = self.parsed(query)
        where = reduce(lambda a, f: a & filter_column(f, self.config, self.kinds[f.field]), options.filters, F.lit(True))
        if not words:
            rows = self.docs.where(where if options.filters else F.lit(False)).select(*self._kept()).withColumn("base", F.lit(0.0))
            rows = rows.withColumn("score", self._rules(F.col("base"), options)).drop("base")
            return rows.withColumn("parts", F.array().cast(_PARTS)) if parts else rows
        fields = self.allowed(options)
        resolved = self.resolve(words, options)
        terms = list(dict.fromkeys(r.term for r in resolved))
        rows = self.scan(terms, fields)
        stats = self.stats(rows, terms, fields)
        if (self.stored or self.once) and (columns or options.filters or self.config.rules):
            own = self.docs.where(where) if options.filters else self.docs
            rows = rows.join(own.select(*self._kept()), self.id)
        elif options.filters:
            rows = rows.where(where)
        rows = rows.crossJoin(F.broadcast(stats))  # one row
        for p in phrases:  # tied to the statistics, so that it stays above the scan and doesn't split texts again
            rows = rows.where(F.when(F.col("n") > 0, self._phrase(p, terms, fields)))
        rows = rows.withColumns({f"share_{f}": self._shares(resolved, terms, f, options) for f in fields})
        rows = rows.withColumn("base", F.aggregate(F.concat(*[F.col(f"share_{f}") for f in fields]), F.lit(0.0), lambda a, x: a + x["share"]))
        if options.proximity and len({r.term for r in resolved}) > 1:
            near, most = self._nearest(resolved, terms, fields), options.max_proximity_distance
            boost = F.when(near <= most, F.col("base") * 0.1 * (1 - F.greatest(F.lit(0), near - 1) / F.lit(float(most)))).otherwise(0.0)
            rows = rows.withColumn("base", F.col("base") + boost)
        rows = rows.withColumn("score", self._rules(F.col("base"), options)).where("score > 0")
        if parts:
            kinds = F.array(*[F.struct(F.lit(r.query).alias("query"), F.lit(r.term).alias("term"), F.lit(r.kind).alias("kind")) for r in resolved])
            raw = lambda df: scoring.inverse_document_frequency(F.col("n"), df)
            of = lambda f: F.zip_with(
                kinds,
                F.col(f"share_{f}"),
                lambda a, b: F.struct(
                    *[a[c].alias(c) for c in ("query", "term", "kind")],
                    F.lit(f).alias("field"),
                    b["tf"].cast("int").alias("tf"),
                    b["share"].alias("share"),
                    b["df"].cast("long").alias("df"),
                    raw(b["df"]).alias("idf"),
                    F.col(f"len_{f}").cast("int").alias("field_len"),
                    F.col(f"avg_{f}").alias("avg_len"),
                ),
            )
            made = F.concat(*[of(f) for f in fields])
            rows = rows.withColumn("parts", F.filter(made, lambda x: x["tf"] > 0))
        return rows.select(*[c for c in rows.columns if c == self.id or c in self.config.fields], "score", *(["parts"] if parts else []))

    def order(self, options: SearchOptions) -> list[Column]:
        by_score = [F.desc("score"), F.asc(self.id)]
        if options.sort is None:
            return by_score
        s = options.sort
        if not self.config.fields.get(s.field) or not self.config.fields[s.field].sortable:
            raise ValueError(f"{s.field} is not sortable")
        return [F.col(s.field).desc_nulls_last() if s.descending else F.col(s.field).asc_nulls_last(), *by_score]

    def page(self, rows: DataFrame, options: SearchOptions) -> DataFrame:
        rows = rows.orderBy(*self.order(options))
        rows = rows.offset(options.offset) if options.offset else rows
        return rows if options.limit is None else rows.limit(options.limit)

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """One page of hits, best first. Scores are rounded before they are ordered, so that equal ones tie by id."""
        late = options.limit is not None and options.sort is None and bool(self.parsed(query)[0]) and self.stored  # the page is found first, then its columns
        rows = self.page(self.matches(query, options, columns=not late).withColumn("score", F.round("score", options.digits)), options)
        if late and set(rows.columns) != {*self._kept(), "score"}:
            rows = self.docs.select(*self._kept()).join(F.broadcast(rows), self.id).select(*self._kept(), "score").orderBy(*self.order(options))  # as many rows as the limit
        return rows

    def total(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        return self.matches(query, options, columns=False).agg(F.count(F.lit(1)).alias("total"))

    def facets(self, query: str, options: SearchOptions) -> DataFrame:
        """(facet, value, n) over all matches, before paging."""
        for f in options.facets:
            if not self.config.fields.get(f) or not self.config.fields[f].facetable:
                raise ValueError(f"{f} is not facetable")
        values = [
            (F.transform(F.array_distinct(F.col(f)), lambda x: x.cast("string")) if self.kinds[f].startswith("array") else F.array_compact(F.array(F.col(f).cast("string"))))
            for f in options.facets
        ]
        pairs = [F.transform(v, (lambda f: lambda x: F.struct(F.lit(f).alias("facet"), x.alias("value")))(f)) for f, v in zip(options.facets, values)]
        return self.matches(query, options).select(F.explode(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<facet:string,value:string>>")) for p in pairs]))).alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))

    def response(self, query: str, options: SearchOptions = SearchOptions(), highlight: tuple[str, ...] = (), explain: bool = False) -> dict:
        """hits (with matched_terms; highlights of fields and parts if asked for), total, facets and time: one pass for the page, one for what counts all matches."""
        began, (words, _) = time.perf_counter(), self.parsed(query)
        rows = self.matches(query, options, parts=True).withColumn("score", F.round("score", options.digits))
        matched = F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["term"])))
        hits = self.page(rows, options).withColumn("matched_terms", matched)
        for f in highlight:
            hits = suggest.highlight(hits, f, words, options=self.config.tokenizer).withColumnRenamed("highlight", f"highlight_{f}")
        hits = (hits if explain else hits.drop("parts")).collect()
        counts = [F.lit(None).cast("string").alias("facet"), F.lit(None).cast("string").alias("value"), F.count(F.lit(1)).alias("n")]
        all_ = self.matches(query, options, columns=bool(options.facets)).agg(*counts)
        if options.facets:
            all_ = all_.unionByName(self.facets(query, options))
        found = all_.collect()
        facets = {f: {r.value: r.n for r in found if r.facet == f} for f in options.facets}
        return {"hits": hits, "total": next(r.n for r in found if r.facet is None), "facets": facets, "ms": 1000 * (time.perf_counter() - began)}

    def search_corrected(self, query: str, options: SearchOptions = SearchOptions()) -> tuple[DataFrame, str, list]:
        """(hits, query, corrections): if the query finds nothing, its words are corrected by the vocabulary and it is asked again."""
        if self.total(query, options).first().total:
            return self.search(query, options), query, []
        rows = suggest.correct(query, self.vocabulary()).orderBy("position").collect()
        made = [r for r in rows if r.distance is not None]
        again = " ".join(r.corrected for r in rows) if made else query
        return self.search(again, options), again, made

    def explain(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """(id, query, term, kind, field, tf, share, df, idf, field_len, avg_len) of the page's hits."""
        rows = self.matches(query, options, parts=True).withColumn("score", F.round("score", options.digits))
        return self.page(rows, options).select(self.id, F.explode("parts").alias("p")).select(self.id, "p.*")


def fuzzy_terms(vocabulary: DataFrame, queries, max_distance: int | None = None, prefix_length: int = 1) -> DataFrame:
    """(query, term, df, distance, penalty): vocabulary near those queries that it lacks, equal in their prefix."""
    spark = vocabulary.sparkSession
    rows = [(q, len(q), max_distance if max_distance is not None else scoring.default_max_distance(q), q[:prefix_length]) for q in sorted(queries)]
    q = spark.createDataFrame(rows, "query string, n int, most int, prefix string")
    near = vocabulary.withColumn("prefix", F.substring("term", 1, prefix_length)).join(q, "prefix")
    near = near.where(F.length("term").between(F.col("n") - F.col("most"), F.col("n") + F.col("most")))
    near = near.withColumn("distance", F.levenshtein("query", "term")).where("distance <= most")
    known = near.where("distance = 0").select("query")
    near = near.join(known, "query", "left_anti")
    return near.select("query", "term", "df", "distance", F.greatest(F.lit(0.25), 1 - F.col("distance") / (F.col("most") + 1)).alias("penalty"))


def batch_search(
    posts: DataFrame, stats: DataFrame, queries: DataFrame, config: IndexConfig, k: int = 10, k1: float = 1.2, b: float = 0.75, digits: int = 6, df: DataFrame | None = None
) -> DataFrame:
    """Top k of many queries(query_id, text) at once over an index's postings and field statistics: (query_id, id, score, rank).

    What a term adds to a document is worked out once, whatever the number of queries; documents' terms then meet
    the queries in the tasks that sum them, and each task cuts its ranks before any are shuffled.
    """
    q = queries.select("query_id", F.explode(text.tokenize(F.col("text"), config.tokenizer)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    few = int(str(q._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10 << 20  # as Spark's own limit; joins of files by term have no estimate of their own
    near = F.broadcast if few else lambda x: x
    df = index.term_field_df(posts) if df is None else df.select("term", "field", "df")
    df = df.join(near(q.select("term").distinct()), "term")
    stats = stats.select("field", "n_docs", "avg_len")
    weight = F.lit(0.0)
    for name, f in config.fields.items():
        weight = F.when(F.col("field") == name, f.weight).otherwise(weight)
    hits = posts.join(near(df), ["term", "field"]).join(F.broadcast(stats), "field")  # a row for each field of the configuration
    score = scoring.bm25(k1, b)(F.col("tf").cast("double"), F.col("field_len"), F.col("n_docs"), F.col("avg_len"), F.col("df"))
    hits = hits.select("id", "term", (score * weight).alias("share"))
    hits = hits.repartition("id") if few else hits
    sums = hits.join(near(q), "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("share") * F.col("qf")), digits).alias("score"))
    best = [F.desc("score"), F.asc("id")]
    first = Window.partitionBy("query_id", F.pmod(F.hash("id"), F.lit(64))).orderBy(*best)
    cut = sums.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")
