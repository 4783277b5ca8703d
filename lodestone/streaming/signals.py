"""Incremental forms on Structured Streaming: ingestion into segments, windowed popularity, search signals."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.recommend import weighted
from lodestone.sources.segments import SegmentStore


def ingest(docs: DataFrame, store: SegmentStore, checkpoint: str, trigger: dict | None = None):
    """A query that appends each micro-batch of a stream of documents as a segment; a batch that is run again is the newer generation of the same ids."""
    return docs.writeStream.foreachBatch(lambda batch, _: store.flush(batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def popularity_windows(interactions: DataFrame, window: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, item_id, score) of a stream of interactions, rows later than late left out."""
    seen = weighted(interactions.withWatermark("occurred_at", late))
    return seen.groupBy(F.window("occurred_at", window, slide).alias("w"), "item_id").agg(F.sum("weight").alias("score")).select(F.col("w.start").alias("start"), "item_id", "score")


def sessions(interactions: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of a stream's sessions."""
    rows = interactions.withWatermark("occurred_at", late).groupBy("user_id", F.session_window("occurred_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def query_counts(searches: DataFrame) -> DataFrame:
    """Running (query, frequency, impressions, last_seen) of a stream of searches with results, for update or complete mode."""
    return searches.where("result_count > 0").groupBy("query").agg(F.count(F.lit(1)).alias("frequency"), F.sum("impressions").alias("impressions"), F.max("ts").alias("last_seen"))
