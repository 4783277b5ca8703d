"""Recommendations from interactions(user_id, item_id, type, occurred_at, weight) and items(id, text).

Everything is joins and sums; vectors are rows (item, feature, value). Scores order first, then the item.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators.index import grouped
from lodestone.sources.shared import kept, source_bytes

# Weight of an interaction by its type.
WEIGHTS = {"view": 1.0, "click": 2.0, "bookmark": 3.0, "like": 4.0, "purchase": 5.0}


def weighted(interactions: DataFrame, weights: dict = WEIGHTS) -> DataFrame:
    """interactions of known types with their effective weight: their own, else their type's."""
    kinds = {**WEIGHTS, **weights}
    if any(w < 0 for w in kinds.values()):
        raise ValueError("weights must be at least 0")
    by_type = F.lit(None).cast("double")
    for k, w in kinds.items():
        by_type = F.when(F.col("type") == k, float(w)).otherwise(by_type)
    own = F.col("weight") if "weight" in interactions.columns else F.lit(None).cast("double")
    return interactions.where(F.col("type").isin(list(kinds))).withColumn("weight", F.coalesce(own, by_type))


def popularity(weighed: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(item_id, score) over an inclusive span of time."""
    if start is not None:
        weighed = weighed.where(F.col("occurred_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        weighed = weighed.where(F.col("occurred_at") <= F.lit(end).cast("timestamp"))
    return weighed.groupBy("item_id").agg(F.sum("weight").alias("score"))


def interaction_stats(weighed: DataFrame) -> DataFrame:
    """One row; types without interactions count 0."""
    by_type = [F.count_if(F.col("type") == k).alias(f"n_{k}") for k in WEIGHTS]
    return weighed.agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), *by_type, F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last")
    )


def strengths(weighed: DataFrame) -> DataFrame:
    return weighed.groupBy("user_id", "item_id").agg(F.sum("weight").alias("strength"))


def top(scores: DataFrame, limit: int | None = 10, digits: int = 6) -> DataFrame:
    out = scores.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "item_id")
    return out if limit is None else out.limit(limit)


#: Items of a user beyond which the user's pairs are dealt over tasks as pairs of tiles.
TILE = 2000


def neighbours(strength: DataFrame, tile: int = TILE) -> DataFrame:
    """(item_id, neighbour, score): cosine over users of items that share one.

    Pairs are made per user, once each (i < j), and summed in the tasks before they are shuffled. A user with
    more than tile items is dealt as pairs of tiles, so that no task makes more than tile * tile pairs at once.
    """
    norm = strength.groupBy("item_id").agg(F.sqrt(F.sum(F.col("strength") * F.col("strength"))).alias("norm"))
    heavy = strength.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")).where("tiles > 1")
    rows = strength.join(heavy, "user_id", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("item_id"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("user_id", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "item_id", "strength")
    a = rows.select("user_id", "x", "y", F.col("own").alias("p"), F.col("item_id").alias("i"), F.col("strength").alias("s"))
    b = rows.select("user_id", "x", "y", F.col("own").alias("q"), F.col("item_id").alias("j"), F.col("strength").alias("t"))
    dots = a.join(b, ["user_id", "x", "y"]).where("i < j AND (x = y OR p <> q)").groupBy("i", "j").agg(F.sum(F.col("s") * F.col("t")).alias("dot"))
    n1, n2 = norm.select(F.col("item_id").alias("i"), F.col("norm").alias("n1")), norm.select(F.col("item_id").alias("j"), F.col("norm").alias("n2"))
    one = dots.join(n1, "i").join(n2, "j").withColumn("score", F.coalesce(F.try_divide("dot", F.col("n1") * F.col("n2")), F.lit(0.0))).where("score > 0")
    return one.select(F.explode(F.array(F.struct(F.col("i").alias("item_id"), F.col("j").alias("neighbour"), "score"), F.struct(F.col("j").alias("item_id"), F.col("i").alias("neighbour"), "score"))).alias("r")).select("r.*")


def collaborative(strength: DataFrame, near: DataFrame, user=None) -> DataFrame:
    """(user_id, item_id, score) of unseen items, for one user or for all."""
    mine = strength if user is None else strength.where(F.col("user_id") == user)
    found = mine.join(near, "item_id").groupBy("user_id", F.col("neighbour").alias("item_id")).agg(F.sum(F.col("score") * F.col("strength")).alias("score"))
    return found.join(mine.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the keys that two map<string, double> share."""
    zero = F.lit(0.0)
    return F.aggregate(F.map_keys(a), zero, lambda acc, k: acc + F.coalesce(F.element_at(a, k) * F.element_at(b, k), zero))


def normalized(vector: Column) -> Column:
    """A map<string, double> of unit length; one without length as it is."""
    size = F.sqrt(F.aggregate(F.map_values(vector), F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(size > 0, F.transform_values(vector, lambda _, x: x / size)).otherwise(vector)


def cosine(a: Column, b: Column) -> Column:
    return dot(normalized(a), normalized(b))


def content_vectors(items: DataFrame, id: str = "id", fields=("text",), df: DataFrame | None = None) -> DataFrame:
    """(item_id, term, value): TF-IDF of unit length over the fields' texts together; items without a token count in N. df: (term, df) if it is known."""
    words = grouped(text.detailed(F.concat_ws(" ", *fields)))
    total = items.agg(F.count(F.lit(1)).alias("n_items"))
    tf = items.select(F.col(id).alias("item_id"), F.explode(words).alias("t")).select("item_id", "t.term", (F.size("t.positions") / F.col("t.n")).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if df is None else df
    value = F.col("tf") * (F.log((F.col("n_items") + 1) / (F.col("df") + 1)) + 1)
    raw = tf.join(df, "term").crossJoin(F.broadcast(total)).select("item_id", "term", value.alias("value"))  # total: one row
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("item_id")))
    return raw.withColumn("norm", norm).select("item_id", "term", F.coalesce(F.try_divide("value", "norm"), F.lit(0.0)).alias("value"))


def stored_vectors(source: DataFrame, items: DataFrame, id: str = "id", fields=("text",)) -> DataFrame:
    """content_vectors(items), written once for source, each item's together.

    Items are dealt by id, so that the lengths of vectors need no shuffle of them; nor do the terms' frequencies where
    their file is small enough for Spark to broadcast.
    """
    spark = source.sparkSession

    def terms(folder: str) -> None:
        words = text.tokenize(F.concat_ws(" ", *fields))
        items.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(folder)

    def make(folder: str) -> None:
        df = spark.read.parquet(kept(source, "vector-terms", terms, repr((id, fields))))
        # by id even where the files would do: the window over an item's terms then finds them in its task
        n = max(spark.sparkContext.defaultParallelism, -(-source_bytes(source) // (16 << 20)))
        content_vectors(items.select(id, *fields).repartition(n, id), id, fields, df).write.parquet(folder)

    return spark.read.parquet(kept(source, "vectors", make, repr((id, fields)), "2"))


def similar_items(vectors: DataFrame, item) -> DataFrame:
    """(item_id, score) of all others that share a term with one item."""
    one = vectors.where(F.col("item_id") == item).select("term", F.col("value").alias("own"))
    out = vectors.where(F.col("item_id") != item).join(one, "term").groupBy("item_id").agg(F.sum(F.col("value") * F.col("own")).alias("score"))
    return out.where("score > 0")


def content_recommend(vectors: DataFrame, strength: DataFrame, user) -> DataFrame:
    """(item_id, score): cosine of unseen items with the sum of the user's items."""
    mine = strength.where(F.col("user_id") == user).select("item_id", "strength")  # one user's, and so the profile: small beside the vectors
    profile = vectors.join(F.broadcast(mine), "item_id").groupBy("term").agg(F.sum(F.col("value") * F.col("strength")).alias("own"))
    norm = profile.agg(F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("norm"))
    profile = profile.crossJoin(F.broadcast(norm)).select("term", F.coalesce(F.try_divide("own", "norm"), F.lit(0.0)).alias("own"))  # norm: one row
    out = vectors.join(F.broadcast(profile), "term").groupBy("item_id").agg(F.sum(F.col("value") * F.col("own")).alias("score"))
    return out.join(F.broadcast(mine.select("item_id")), "item_id", "left_anti").where("score > 0")


def with_fallback(recommended: DataFrame, popular: DataFrame, seen: DataFrame, limit: int = 10) -> DataFrame:
    """The best limit recommendations; if there are none, the limit most popular items less the seen ones, so maybe fewer.

    seen(item_id) of a user without history is empty, so that user gets popular items unfiltered.
    """
    best = top(recommended.select("item_id", "score"), limit)
    some = best.limit(1).agg((F.count(F.lit(1)) > 0).alias("some"))
    other = top(popular.select("item_id", "score"), limit).join(seen.select("item_id"), "item_id", "left_anti")
    other = other.crossJoin(F.broadcast(some)).where("NOT some").select("item_id", "score")  # some: one row
    return top(best.unionByName(other), limit)


def hybrid(signals: dict[str, DataFrame], weights: dict[str, float], limit: int | None = 10, digits: int = 6) -> DataFrame:
    """Weighted sum of signals (item_id, score), each divided by its largest score but recency; a missing signal is 0."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must be at least 0")
    rows = reduce(DataFrame.unionByName, [s.select("item_id", "score", F.lit(k).alias("signal")) for k, s in signals.items()])
    most = rows.groupBy("signal").agg(F.max("score").alias("most"))  # a row for each signal
    rows = rows.join(F.broadcast(most), "signal").withColumn("score", F.when(F.col("signal") == "recency", F.col("score")).when(F.col("most") > 0, F.col("score") / F.col("most")).otherwise(0.0))
    parts = [F.coalesce(F.sum(F.when(F.col("signal") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in signals]
    out = rows.groupBy("item_id").agg(*parts)
    score = reduce(lambda a, b: a + b, [F.col(k) * float(weights.get(k, 0.0)) for k in signals])
    out = out.withColumn("score", score).where("score > 0")
    return top(out.select("item_id", "score", *[F.round(k, digits).alias(k) for k in signals]), limit, digits)


def recency(items: DataFrame, seen: DataFrame, now: str, half_life_days: float = 30.0, ahead: bool = False) -> DataFrame:
    """(item_id, score) of unseen items(item_id, created_at) with a date; later ones than now score 1, or, ahead, more."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    age = age if ahead else F.greatest(F.lit(0), age)
    out = items.where("created_at IS NOT NULL").join(seen.select("item_id"), "item_id", "left_anti")
    return out.select("item_id", F.pow(F.lit(2.0), -age / (half_life_days * 86_400e6)).alias("score")) if half_life_days > 0 else out.select("item_id", F.lit(0.0).alias("score")).limit(0)
