"""Relevance metrics over retrieved(query_id, doc_id, rank from 1) and judgments(query_id, doc_id, grade)."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(retrieved: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision, recall, rr, dcg, ndcg) of each query that retrieved or was judged; 0 where nothing is relevant."""
    graded = retrieved.join(judgments, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    good, cut = F.col("grade") > 0, F.col("rank") <= k
    gain = lambda r: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(r) + 1)
    got = graded.groupBy("query_id").agg(
        F.count_if(good & cut).alias("hits"), F.min(F.when(good, F.col("rank"))).alias("first"), F.sum(F.when(cut, gain("rank")).otherwise(0.0)).alias("dcg")
    )
    best = judgments.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    ideal = best.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("relevant"), F.sum(F.when(F.col("r") <= k, gain("r")).otherwise(0.0)).alias("ideal"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return got.join(ideal, "query_id", "full_outer").select(
        "query_id",
        zero(F.col("hits") / float(k)).alias("precision"),
        zero(F.try_divide("hits", "relevant")).alias("recall"),
        zero(1.0 / F.col("first")).alias("rr"),
        zero(F.col("dcg")).alias("dcg"),
        zero(F.try_divide("dcg", "ideal")).alias("ndcg"),
    )


def compare(runs: dict[str, DataFrame], judgments: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """Mean of each metric by configuration."""
    rows = reduce(DataFrame.unionByName, [evaluate(r, judgments, k).withColumn("config", F.lit(name)) for name, r in runs.items()])
    return rows.groupBy("config").agg(*[F.round(F.avg(m), digits).alias(m) for m in ("precision", "recall", "rr", "dcg", "ndcg")])


def format_table(rows: list[dict]) -> str:
    """Aligned text of compared configurations, four decimals."""
    if not rows:
        return ""
    names = list(rows[0])
    cells = [names] + [[f"{r[n]:.4f}" if isinstance(r[n], float) else str(r[n]) for n in names] for r in rows]
    wide = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(c, wide)).rstrip() for c in cells)
