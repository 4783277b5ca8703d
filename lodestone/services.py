"""Services over indexes: catalogue, documents, cached answers, recommendations, snapshots, jobs.

State that grows with the data is tables in the folder of a service; what a process itself holds (options,
generations, answers, jobs) is bounded. Names are checked, so that none leaves the folder.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, is_dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import IndexConfig, SearchOptions
from lodestone.operators import recommend, suggest
from lodestone.operators.search import SearchIndex
from lodestone.sources import tables
from lodestone.sources.segments import SegmentStore
from lodestone.sources.shared import hadoop_path


class NotFound(KeyError):
    """What was named isn't there."""


def checked_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,99}", name):
        raise ValueError(f"{name!r} is no name of letters, digits, _ and -")
    return name


def stable_key(kind: str, **parts) -> str:
    """A digest of values whatever the order of their names."""

    def plain(x):
        return asdict(x) if is_dataclass(x) else list(x) if isinstance(x, (set, frozenset, tuple)) else str(x)

    return f"{kind}:" + hashlib.sha256(json.dumps(parts, sort_keys=True, default=plain).encode()).hexdigest()


class AnswerCache:
    """Answers by key for a time; at most most of them, the oldest go first. Of callers with one key at once, one computes."""

    def __init__(self, seconds: float = 30.0, most: int = 1024, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self.held, self.locks, self.lock = OrderedDict(), {}, threading.Lock()

    def get(self, key: str, compute: Callable):
        with self.lock:
            own = self.locks.setdefault(key, threading.Lock())
        try:
            with own:
                with self.lock:
                    found = self.held.get(key)
                if found is not None and self.clock() < found[0]:
                    return found[1]
                made = compute()
                with self.lock:
                    self.held[key] = (self.clock() + self.seconds, made)
                    self.held.move_to_end(key)
                    while len(self.held) > self.most:
                        self.held.popitem(last=False)
                return made
        finally:
            with self.lock:
                if not own.locked():
                    self.locks.pop(key, None)


@dataclass
class _Index:
    config: IndexConfig
    generation: int = 0
    searcher: SearchIndex | None = None


class IndexService:
    """Indexes by name: each a segment store of documents(id, ...) and the written index of what is visible in it."""

    def __init__(self, spark: SparkSession, folder: str, cache: AnswerCache | None = None):
        self.spark, self.folder, self.cache = spark, folder.rstrip("/"), cache or AnswerCache()
        self.indexes: dict[str, _Index] = {}

    def _of(self, name: str) -> _Index:
        if name not in self.indexes:
            raise NotFound(name)
        return self.indexes[name]

    def store(self, name: str) -> SegmentStore:
        return SegmentStore(self.spark, f"{self.folder}/{checked_name(name)}")

    def create(self, name: str, config: IndexConfig) -> None:
        if checked_name(name) in self.indexes:
            raise ValueError(f"{name} is there already")
        self.indexes[name] = _Index(config)

    def names(self) -> list[str]:
        return sorted(self.indexes)

    def delete(self, name: str) -> None:
        self._of(name)
        self.clear(name)
        del self.indexes[name]

    def _changed(self, name: str) -> None:
        index = self._of(name)
        index.generation, index.searcher = index.generation + 1, None

    def generation(self, name: str) -> int:
        """Grows with every change, so that older answers are no longer found."""
        return self._of(name).generation

    def _valid(self, docs: DataFrame, config: IndexConfig) -> DataFrame:
        if missing := [f for f in config.searchable if f not in docs.columns]:
            raise ValueError(f"documents lack {missing}")
        if docs.where("id IS NULL OR CAST(id AS STRING) = ''").limit(1).count():
            raise ValueError("a document has no id")
        return docs

    def add(self, name: str, docs: DataFrame) -> None:
        """docs instead of documents with equal ids, beside the others."""
        self.store(name).flush(self._valid(docs, self._of(name).config))
        self._changed(name)

    def remove(self, name: str, ids: DataFrame) -> None:
        self._of(name)
        self.store(name).delete(ids)
        self._changed(name)

    def clear(self, name: str) -> None:
        """No documents; the configuration stays."""
        self._of(name)
        path, fs = hadoop_path(self.spark, f"{self.folder}/{checked_name(name)}")
        fs.delete(path, True)
        self._changed(name)

    def documents(self, name: str) -> DataFrame:
        self._of(name)
        docs = self.store(name).documents()
        if docs is None:
            raise NotFound(f"{name} has no documents")
        return docs.drop("generation")

    def list_documents(self, name: str, limit: int = 20, offset: int = 0) -> DataFrame:
        return tables.page_of(self.documents(name), ["id"], limit, offset)

    def gauge(self, name: str) -> int:
        return self.documents(name).count()

    def reindex(self, name: str) -> int:
        """The store compacted to one segment and its index written anew; the number of documents."""
        self._of(name)
        self.store(name).compact()
        self._changed(name)
        self.searcher(name)
        return self.gauge(name)

    def update_schema(self, name: str, config: IndexConfig) -> int:
        """Another configuration, if all documents fit it, and the index written anew by it."""
        self._valid(self.documents(name), config)
        self._of(name).config = config
        return self.reindex(name)

    def update_synonyms(self, name: str, synonyms: tuple, penalty: float = 0.7) -> None:
        """Synonyms are resolved when a query is asked, so that no document is read."""
        index = self._of(name)
        index.config = replace(index.config, synonyms=tuple(synonyms), synonym_penalty=penalty)
        self._changed(name)

    def export(self, name: str, target: str) -> None:
        """All documents as one table."""
        self.documents(name).write.mode("errorifexists").parquet(target)

    def restore(self, name: str, source: str, config: IndexConfig | None = None) -> int:
        """An exported table instead of what is there; nothing changes unless its rows fit."""
        config = config or self._of(name).config
        docs = self._valid(self.spark.read.parquet(source), config)
        self.clear(name)
        self._of(name).config = config
        self.add(name, docs)
        return self.gauge(name)

    def searcher(self, name: str) -> SearchIndex:
        index = self._of(name)
        if index.searcher is None:
            index.searcher = SearchIndex.written(self.documents(name), index.config)
        return index.searcher

    def _answer(self, kind: str, name: str, compute: Callable, **parts):
        return self.cache.get(stable_key(kind, index=name, generation=self.generation(name), **parts), compute)

    def search(self, name: str, query: str, options: SearchOptions = SearchOptions(), highlight: tuple[str, ...] = (), explain: bool = False) -> dict:
        return self._answer("search", name, lambda: self.searcher(name).response(query, options, highlight, explain), query=query, options=options, highlight=highlight, explain=explain)

    def search_corrected(self, name: str, query: str, options: SearchOptions = SearchOptions()) -> dict:
        """search(), and once more with corrected words if it found nothing."""
        found = self.search(name, query, options)
        if found["total"]:
            return found | {"query": query, "corrections": []}
        _, again, made = self.searcher(name).search_corrected(query, options)
        return (self.search(name, again, options) if made else found) | {"query": again, "corrections": [tuple(r) for r in made]}

    def autocomplete(self, name: str, prefix: str, limit: int = 10) -> list[str]:
        return self._answer("autocomplete", name, lambda: [r.term for r in suggest.autocomplete(self.searcher(name).vocabulary(), prefix, limit).collect()], prefix=prefix, limit=limit)


class SnapshotService:
    """Snapshots of a service's indexes, each index in a folder of its own."""

    def __init__(self, indexes: IndexService, folder: str):
        self.indexes, self.folder = indexes, folder.rstrip("/")

    def _at(self, name: str, snapshot: str) -> str:
        return f"{self.folder}/{checked_name(name)}/{checked_name(snapshot)}"

    def create(self, name: str, snapshot: str | None = None) -> str:
        snapshot = snapshot or time.strftime("%Y%m%dT%H%M%S-") + uuid.uuid4().hex[:8]
        self.indexes._of(name)
        self.indexes.store(name).snapshot(self._at(name, snapshot))
        return snapshot

    def list(self, name: str) -> list[str]:
        return self.indexes.store(name).snapshots(f"{self.folder}/{checked_name(name)}")

    def restore(self, name: str, snapshot: str) -> int:
        if snapshot not in self.list(name):
            raise NotFound(f"{name} has no snapshot {snapshot}")
        self.indexes.store(name).restore(self._at(name, snapshot))
        self.indexes._changed(name)
        return self.indexes.gauge(name)

    def delete(self, name: str, snapshot: str) -> None:
        if not self.indexes.store(name).drop_snapshot(self._at(name, snapshot)):
            raise NotFound(f"{name} has no snapshot {snapshot}")


class RecommendationService:
    """Recommendations from a table of interactions that is appended to, and a table of items(id, text[, created_at])."""

    KIND = "user_id string, item_id string, type string, occurred_at timestamp, weight double"

    def __init__(self, spark: SparkSession, folder: str, items: DataFrame, weights: dict | None = None):
        self.spark, self.path, self.items, self.weights = spark, f"{folder.rstrip('/')}/interactions", items, {"content": 0.35, "collaborative": 0.5, "popularity": 0.15, "recency": 0.1} | (weights or {})

    def record(self, interactions: DataFrame) -> None:
        """Append; types must be known and items there."""
        known = recommend.weighted(interactions)
        if interactions.where(~F.col("type").isin(list(recommend.WEIGHTS))).limit(1).count():
            raise ValueError("an interaction's type is unknown")
        if known.join(self.items.select(F.col("id").cast("string").alias("item_id")), "item_id", "left_anti").limit(1).count():
            raise NotFound("an interaction names an item that isn't there")
        known.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in self.KIND.split(", ")]).write.mode("append").parquet(self.path)

    def list(self) -> DataFrame:
        """All interactions by time."""
        path, fs = hadoop_path(self.spark, self.path)
        rows = self.spark.read.schema(self.KIND).parquet(self.path) if fs.exists(path) else self.spark.createDataFrame([], self.KIND)
        return rows.orderBy("occurred_at", "user_id", "item_id")

    def _vectors(self) -> DataFrame:
        return recommend.content_vectors(self.items.select(F.col("id").cast("string").alias("id"), "text"))

    def recommend_items(self, item: str, limit: int = 10) -> DataFrame:
        """Items like one: by content and by who chose both."""
        if not self.items.where(F.col("id").cast("string") == item).limit(1).count():
            raise NotFound(item)
        near = recommend.neighbours(recommend.strengths(self.list())).where(F.col("item_id") == item).select(F.col("neighbour").alias("item_id"), "score")
        return recommend.hybrid({"content": recommend.similar_items(self._vectors(), item), "collaborative": near}, self.weights, limit)

    def recommend_for_user(self, user: str, now: str, limit: int = 10) -> DataFrame:
        """(item_id, score, and each signal's part) of items that the user has not chosen."""
        rows = self.list()
        strength = recommend.strengths(rows)
        seen = strength.where(F.col("user_id") == user).select("item_id")
        signals = {
            "content": recommend.content_recommend(self._vectors(), strength, user),
            "collaborative": recommend.collaborative(strength, recommend.neighbours(strength), user),
            "popularity": recommend.popularity(rows).join(seen, "item_id", "left_anti"),
        }
        if "created_at" in self.items.columns:
            signals["recency"] = recommend.recency(self.items.select(F.col("id").cast("string").alias("item_id"), "created_at"), seen, now)
        return recommend.hybrid(signals, self.weights, limit)

    def popular(self, limit: int = 10) -> DataFrame:
        return recommend.top(recommend.popularity(self.list()), limit)

    def statistics(self) -> DataFrame:
        return recommend.interaction_stats(self.list())


@dataclass
class Job:
    type: str
    payload: dict
    max_attempts: int = 3
    key: str | None = None
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "queued"
    progress: int = 0
    attempts: int = 0
    error: str | None = None
    created_at: float = field(default_factory=time.time)


class Jobs:
    """Jobs of this process, oldest first; one with a key that is there already is that one."""

    def __init__(self):
        self.jobs: dict[str, Job] = {}
        self.handlers: dict[str, Callable[[dict, Callable[[int], None]], None]] = {}
        self.lock = threading.Lock()

    def register(self, type: str, handler) -> None:
        self.handlers[type] = handler

    def enqueue(self, type: str, payload: dict, max_attempts: int = 3, key: str | None = None) -> Job:
        with self.lock:
            same = next((j for j in self.jobs.values() if key is not None and j.key == key), None)
            if same is None:
                same = Job(type, payload, max_attempts, key)
                self.jobs[same.id] = same
            return same

    def cancel(self, id: str) -> bool:
        with self.lock:
            job = self.jobs.get(id)
            if job is None or job.status not in ("queued", "running"):
                return False
            job.status = "cancelled"
            return True

    def listing(self, sources: DataFrame, project: str | None = None) -> DataFrame:
        """Jobs joined to sources(source_id, project, url) by their payload's source, newest first."""
        spark = sources.sparkSession
        rows = [(j.id, j.type, j.status, j.progress, j.attempts, str(j.payload.get("source_id")), j.created_at) for j in self.jobs.values()]
        jobs = spark.createDataFrame(rows, "job_id string, type string, status string, progress int, attempts int, source_id string, created_at double")
        out = jobs.join(sources.withColumn("source_id", F.col("source_id").cast("string")), "source_id")
        return (out if project is None else out.where(F.col("project") == project)).orderBy(F.desc("created_at"), "job_id")

    def run_once(self) -> bool:
        """Run the oldest queued job, if there is one; a failed one is queued again until its attempts are used."""
        with self.lock:
            job = next((j for j in self.jobs.values() if j.status == "queued"), None)
            if job is None:
                return False
            job.status, job.attempts, job.error = "running", job.attempts + 1, None

        def report(progress: int) -> None:
            if not isinstance(progress, int) or not 0 <= progress <= 100:
                raise ValueError("progress is a whole number from 0 to 100")
            job.progress = progress

        try:
            if job.type not in self.handlers:
                raise LookupError(f"nothing runs jobs of type {job.type}")
            self.handlers[job.type](job.payload, report)
            outcome, error = "completed", None
        except Exception as e:  # whatever a handler raises is the job's outcome
            outcome, error = "queued" if job.attempts < job.max_attempts else "failed", str(e)
        with self.lock:
            if job.status == "running":
                job.status, job.error = outcome, error
                if outcome == "completed":
                    job.progress = 100
        return True
