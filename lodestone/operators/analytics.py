"""Search analytics over searches(search_id, query, latency_ms, result_count, created_at), impressions(search_id, document_id, position) and clicks(search_id, document_id, position, created_at).

Each report is one aggregate plan. Ratios with nothing below them are 0; percentiles are exact.
"""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text


def resolve_range(start: str | None = None, end: str | None = None, now: str | None = None) -> tuple[str, str]:
    """The last 30 days unless told; both ends count."""
    last = datetime.fromisoformat(end or now or datetime.now().isoformat())
    first = datetime.fromisoformat(start) if start else last - timedelta(days=30)
    if first > last:
        raise ValueError("a range must not end before it starts")
    return first.isoformat(" "), last.isoformat(" ")


def within(df: DataFrame, span: tuple[str, str]) -> DataFrame:
    return df.where(F.col("created_at").between(F.lit(span[0]).cast("timestamp"), F.lit(span[1]).cast("timestamp")))


def normalized(query):
    return F.array_join(text.tokenize(query), " ")


def session_hash(session):
    return F.sha2(session, 256)


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


#: Parts that a column's values are dealt into before exact ranks are looked up.
PARTS = 512


def ranked(values: DataFrame, c: str, ranks: dict[str, Column]) -> DataFrame:
    """One row: of the values of c in order, that at each rank (from 0, a Column of n, their number); null where there is none.

    Bounds of parts come from a sketch and only say where to look: values are counted one by one, parts are
    summed, and only the parts that hold a rank are sorted, so no task sees all values and ranks are exact.
    """
    rows = values.select(F.col(c).cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    bounds = values.agg(F.percentile_approx(F.col(c).cast("double"), [k / PARTS for k in range(1, PARTS)], 10 * PARTS)).first()[0] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(bounds))]).cast("array<double>")
    rows = rows.withColumn("part", F.size(F.filter(bounds, lambda x: x < F.col("v"))))
    parts = rows.groupBy("part").agg(F.sum("n").alias("n"))  # PARTS rows at most
    parts = parts.withColumn("upto", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part"))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), at(F.col("total")).cast("long").alias("at")) for k, at in ranks.items()])
    wanted = parts.withColumn("w", F.explode(wanted)).where("w.at >= upto - n AND w.at < upto").select("part", "w.name", "w.at", (F.col("upto") - F.col("n")).alias("before"))
    inside = rows.join(F.broadcast(wanted), "part")  # a row for each rank
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("name").orderBy("v"))).where("upto > at")
    return inside.groupBy().agg(*[F.min(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ranks])


def percentiles(values: DataFrame, c: str, digits: int = 6) -> DataFrame:
    """One row: p50, p95, p99, between two values in proportion; 0 of no values."""
    names = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    at = {}
    for name, q in names.items():
        at[f"{name}_low"] = (lambda q: lambda n: F.floor(F.round((n - 1) * q, 9)))(q)
        at[f"{name}_high"] = (lambda q: lambda n: F.ceil(F.round((n - 1) * q, 9)))(q)
    found = ranked(values, c, at).crossJoin(values.agg(F.count(c).alias("n")))  # one row each
    between = lambda k, q: F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * (F.round((F.col("n") - 1) * q, 9) - F.floor(F.round((F.col("n") - 1) * q, 9)))
    return found.select(*[F.coalesce(F.round(between(k, q), digits), F.lit(0.0)).alias(k) for k, q in names.items()])


def overview(searches: DataFrame, digits: int = 6) -> DataFrame:
    zero = F.count_if(F.col("result_count") == 0)
    base = searches.agg(
        F.count(F.lit(1)).alias("searches"),
        F.countDistinct("query").alias("queries"),
        F.coalesce(F.round(F.avg("latency_ms"), digits), F.lit(0.0)).alias("avg_latency"),
        zero.alias("zero_results"),
        F.round(_ratio(zero, F.count(F.lit(1))), digits).alias("zero_rate"),
    )
    return base.crossJoin(percentiles(searches, "latency_ms", digits)).select("searches", "queries", "avg_latency", "p50", "p95", "p99", "zero_results", "zero_rate")


def volume(searches: DataFrame) -> DataFrame:
    return searches.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def queries(searches: DataFrame, impressions: DataFrame, clicks: DataFrame, limit: int | None = 20, digits: int = 6) -> DataFrame:
    """Each query's searches, means, impressions, clicks and rates; clicks on queries that have no search here are left out."""
    shown = impressions.groupBy("search_id").agg(F.count(F.lit(1)).alias("shown"))
    per = searches.join(shown, "search_id", "left").groupBy("query").agg(
        F.count(F.lit(1)).alias("searches"),
        F.round(F.avg("result_count"), digits).alias("avg_results"),
        F.round(F.avg("latency_ms"), digits).alias("avg_latency"),
        F.round(F.count_if(F.col("result_count") == 0) / F.count(F.lit(1)), digits).alias("zero_rate"),
        F.coalesce(F.sum("shown"), F.lit(0)).alias("impressions"),
    )
    hit = clicks.groupBy("query").agg(F.count(F.lit(1)).alias("clicks"))
    out = per.join(hit, "query", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)))
    out = out.withColumn("ctr", F.round(_ratio("clicks", "impressions"), digits)).orderBy(F.desc("searches"), "query")
    return out if limit is None else out.limit(limit)


def no_results(report: DataFrame, limit: int = 20) -> DataFrame:
    """Of the 100 most frequent queries of a report, those that found nothing at times."""
    top = report.orderBy(F.desc("searches"), "query").limit(100)
    return top.where("zero_rate > 0").orderBy(F.desc("zero_rate"), F.desc("searches"), "query").limit(limit)


def latency(searches: DataFrame, digits: int = 6) -> DataFrame:
    zero = lambda c: F.coalesce(F.round(c, digits), F.lit(0.0))
    base = searches.agg(F.count(F.lit(1)).alias("n"), zero(F.avg("latency_ms")).alias("avg"), zero(F.min("latency_ms")).alias("min"), zero(F.max("latency_ms")).alias("max"))
    return base.crossJoin(percentiles(searches, "latency_ms", digits))


def nearest_rank(values: DataFrame, c: str, quantiles) -> DataFrame:
    """Percentiles that are values themselves: the first that as great a share of all reaches."""
    return ranked(values, c, {f"p{round(100 * q)}": (lambda q: lambda n: F.greatest(F.ceil(F.round(n * q, 9)) - 1, F.lit(0)))(q) for q in quantiles})


def clicks(searches: DataFrame, impressions: DataFrame, clicked: DataFrame, digits: int = 6) -> DataFrame:
    """One row: impressions, clicks, rate and mean position."""
    shown = impressions.join(searches.select("search_id"), "search_id", "left_semi").agg(F.count(F.lit(1)).alias("impressions"))
    hit = clicked.agg(F.count(F.lit(1)).alias("clicks"), F.coalesce(F.round(F.avg("position"), digits), F.lit(0.0)).alias("avg_position"))
    return shown.crossJoin(hit).withColumn("ctr", F.round(_ratio("clicks", "impressions"), digits))


def most_clicked(clicked: DataFrame, limit: int = 10) -> DataFrame:
    return clicked.groupBy("document_id").agg(F.count(F.lit(1)).alias("clicks")).orderBy(F.desc("clicks"), "document_id").limit(limit)


def valid_clicks(clicked: DataFrame, impressions: DataFrame) -> DataFrame:
    """Clicks on what was shown, where it was shown."""
    return clicked.join(impressions, ["search_id", "document_id", "position"], "left_semi")


def named_clicks(clicked: DataFrame, searches: DataFrame) -> DataFrame:
    return clicked.join(searches.select("search_id", "query"), "search_id")


def route_counters(requests: DataFrame) -> DataFrame:
    """Counters of requests(method, route, status, seconds)."""
    return requests.groupBy("method", "route", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"))


def document_gauge(docs: DataFrame, index: str) -> DataFrame:
    """One row: the index and its number of documents."""
    return docs.agg(F.lit(index).alias("index"), F.count(F.lit(1)).alias("documents"))


def over_limit(requests: DataFrame, most: int, seconds: int = 60) -> DataFrame:
    """(key, window start, n) of keys with more than most requests(key, ts) in a fixed window."""
    w = F.window("ts", f"{seconds} seconds")
    return requests.groupBy("key", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key", F.col("w.start").alias("start"), "n")
