"""Immutable segments with tombstones, compaction, and checksummed snapshots.

A segment is a folder of documents of one generation, with its dictionary and statistics beside it where the
store has a configuration; numbered manifests, of which the newest whole one counts, say which segments and
tombstones count. A writer that finds its number taken has lost against another and gets an error. All files
go through Spark and Hadoop's file systems, so any store that Spark reads will do. Compaction writes the new
segment, then the manifest, and only then deletes what it replaced.
"""

import json
import re
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import IndexConfig, SearchOptions
from lodestone.operators.search import SearchIndex
from lodestone.operators.stored import StoredIndex


def visible(rows: DataFrame, tombstones: DataFrame, id: str = "id") -> DataFrame:
    """Of rows with a generation, each id's newest one, if no tombstone is as new."""
    w = Window.partitionBy(id).orderBy(F.desc("generation"))
    newest = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    dead = tombstones.groupBy(id).agg(F.max("generation").alias("__dead"))
    return newest.join(dead, id, "left").where("__dead IS NULL OR generation > __dead").drop("__dead")


def merged_search(rows: DataFrame, tombstones: DataFrame, config: IndexConfig, query: str, options: SearchOptions = SearchOptions(), id: str = "id", per_segment: bool = False) -> DataFrame:
    """Hits over visible documents: with statistics of all of them, or of each segment by itself as it was written."""
    if not per_segment:
        return SearchIndex(visible(rows, tombstones, id).drop("generation"), config, id).search(query, options)
    alive = visible(rows, tombstones, id).select(id, "generation")
    generations = [r.generation for r in rows.select("generation").distinct().orderBy("generation").collect()]
    one = lambda g: SearchIndex(rows.where(F.col("generation") == g).drop("generation"), config, id, once=True)
    own = [c for c in rows.columns if c == id or c in config.fields]
    parts = [one(g).matches(query, options, columns=False).select(id, "score", F.lit(g).alias("generation")) for g in generations]
    hits = reduce(DataFrame.unionByName, parts).join(alive, [id, "generation"], "left_semi").withColumn("score", F.round("score", options.digits))
    hits = hits.orderBy(F.desc("score"), id).offset(options.offset)
    hits = hits if options.limit is None else F.broadcast(hits.limit(options.limit))  # as many rows as the limit
    return rows.join(hits, [id, "generation"]).select(*own, "score", "generation").orderBy(F.desc("score"), id)


class SegmentStore:
    """Segments under a folder."""

    def __init__(self, spark: SparkSession, folder: str, id: str = "id", config: IndexConfig | None = None):
        self.spark, self.folder, self.id, self.config = spark, folder.rstrip("/"), id, config
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(self.folder))

    def _path(self, p):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def _read_text(self, path):
        return "".join(r.value for r in self.spark.read.text(path, wholetext=True).collect())

    def _write_text(self, path, s):
        """Written aside, then renamed: the file is there whole or not at all."""
        tmp = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(tmp, True)
        out.write(bytearray(s.encode()))
        out.close()
        if self.fs.exists(self._path(path)) or not self.fs.rename(tmp, self._path(path)):
            self.fs.delete(tmp, False)
            raise FileExistsError(f"{path} was written by another")

    def _manifests(self) -> list[str]:
        """Names of manifests, newest first."""
        found = (x.getPath().getName() for x in self.fs.listStatus(self._path(self.folder)))
        return sorted((n for n in found if re.fullmatch(r"manifest-\d{9}\.json", n)), reverse=True)

    def manifest(self) -> dict:
        for name in self._manifests():
            try:
                return json.loads(self._read_text(f"{self.folder}/{name}"))
            except ValueError:
                continue  # cut off: the one before counts
        return {"version": 0, "next": 1, "segments": [], "tombstones": []}

    def _save(self, m):
        """m as the manifest after the one that it was made from."""
        m = m | {"version": m["version"] + 1}
        self._write_text(f"{self.folder}/manifest-{m['version']:09d}.json", json.dumps(m, sort_keys=True))
        for old in self._manifests()[2:]:
            self.fs.delete(self._path(f"{self.folder}/{old}"), False)

    def _write_segment(self, docs: DataFrame, m: dict) -> str:
        """The next segment; a name that a lost writer has left is passed over."""
        name = f"segment-{m['next']:06d}"
        while self.fs.exists(self._path(f"{self.folder}/{name}")):
            m["next"] += 1
            name = f"segment-{m['next']:06d}"
        docs.write.mode("errorifexists").parquet(f"{self.folder}/{name}")
        if self.config is not None:
            StoredIndex.write(self.spark.read.parquet(f"{self.folder}/{name}"), self.config, f"{self.folder}/{name}.index", self.id)
        return name

    def _folders(self, m: dict) -> list[str]:
        """All folders that a manifest's segments and tombstones have."""
        names = [n for n, _ in m["segments"]]
        beside = [f"{n}.index" for n in names if self.fs.exists(self._path(f"{self.folder}/{n}.index"))]
        return names + beside + m["tombstones"]

    def index(self, name: str) -> StoredIndex:
        """Dictionary and statistics of a segment."""
        return StoredIndex(self.spark, f"{self.folder}/{name}.index")

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """Hits over visible documents, each scored by the statistics of its segment, over the segments' own indexes."""
        parts = []
        for name, generation in self.manifest()["segments"]:
            docs = self.spark.read.parquet(f"{self.folder}/{name}")
            parts.append(SearchIndex(docs, self.config, self.id, self.index(name)).matches(query, options).withColumn("generation", F.lit(generation)))
        alive = self.documents().select(self.id, "generation")
        hits = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).join(alive, [self.id, "generation"], "left_semi")
        return hits.withColumn("score", F.round("score", options.digits)).orderBy(F.desc("score"), self.id).offset(options.offset).limit(options.limit)

    def flush(self, docs: DataFrame) -> str | None:
        """docs as a new segment; none for an empty frame."""
        if docs.isEmpty():
            return None
        m = self.manifest()
        name = self._write_segment(docs, m)
        self._save(m | {"next": m["next"] + 1, "segments": m["segments"] + [[name, m["next"]]]})
        return name

    def delete(self, ids: DataFrame) -> None:
        """Tombstones for all that is there now."""
        m = self.manifest()
        name = f"tombstones-{m['next']:06d}"
        ids.select(self.id).distinct().withColumn("generation", F.lit(m["next"])).write.mode("errorifexists").parquet(f"{self.folder}/{name}")
        self._save(m | {"next": m["next"] + 1, "tombstones": m["tombstones"] + [name]})

    def rows(self) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.folder}/{n}").withColumn("generation", F.lit(g)) for n, g in self.manifest()["segments"]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def tombstones(self) -> DataFrame:
        names = self.manifest()["tombstones"]
        if not names:
            rows = self.rows()
            kind = rows.schema[self.id].dataType.simpleString() if rows is not None else "string"
            return self.spark.createDataFrame([], f"`{self.id}` {kind}, generation int")
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.folder}/{n}") for n in names])

    def documents(self) -> DataFrame | None:
        rows = self.rows()
        return None if rows is None else visible(rows, self.tombstones(), self.id)

    def compact(self) -> str | None:
        """One segment of what is visible, and no tombstones."""
        docs, m = self.documents(), self.manifest()
        if docs is None:
            return None
        old = self._folders(m)
        name = self._write_segment(docs.drop("generation"), m)
        self._save(m | {"next": m["next"] + 1, "segments": [[name, m["next"]]], "tombstones": []})
        for old in old:
            self.fs.delete(self._path(f"{self.folder}/{old}"), True)
        return name

    # snapshots

    def _digests(self, folder) -> dict[str, str]:
        """SHA-256 by file, worked out where the files are read."""
        df = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        return {r.path.rsplit("/", 2)[-2] + "/" + r.path.rsplit("/", 1)[-1]: r.d for r in df.select("path", F.sha2("content", 256).alias("d")).collect()}

    def snapshot(self, target: str) -> dict:
        """A checksummed copy of the store in a folder outside it; files are copied aside and renamed when whole."""
        target = target.rstrip("/")
        if target.startswith(self.folder + "/") or self.folder.startswith(target + "/"):
            raise ValueError("a snapshot and its store must not lie within each other")
        if self.fs.exists(self._path(target)):
            raise ValueError("the snapshot is there already")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        copy = lambda a, b: self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(a), self.fs, self._path(b), False, conf)
        m, tmp = self.manifest(), f"{target}.tmp"
        self.fs.mkdirs(self._path(f"{tmp}/data"))
        for name in self._folders(m):
            copy(f"{self.folder}/{name}", f"{tmp}/data/{name}")
        made = {"manifest": m, "files": self._digests(f"{tmp}/data") if m["segments"] else {}}
        self._write_text(f"{tmp}/snapshot.json", json.dumps(made, sort_keys=True))
        self.fs.rename(self._path(tmp), self._path(target))
        return made

    def valid(self, target: str) -> bool:
        made = json.loads(self._read_text(f"{target}/snapshot.json"))
        try:
            return made["files"] == (self._digests(f"{target}/data") if made["files"] else {})
        except Py4JJavaError as e:  # the file system found the damage itself
            if "ChecksumException" in str(e):
                return False
            raise

    def restore(self, target: str) -> None:
        """The store as the snapshot has it; nothing changes unless the snapshot is whole."""
        if not self.valid(target):
            raise ValueError("the snapshot is damaged")
        made = json.loads(self._read_text(f"{target}/snapshot.json"))
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        inside = [x.getPath().getName() for x in self.fs.listStatus(self._path(f"{target}/data"))]
        for name in inside:
            if not self.fs.exists(self._path(f"{self.folder}/{name}")):
                self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(f"{target}/data/{name}"), self.fs, self._path(f"{self.folder}/{name}"), False, conf)
        now = self.manifest()
        self._save(made["manifest"] | {"version": now["version"], "next": max(made["manifest"]["next"], now["next"])})

    def snapshots(self, root: str) -> list[str]:
        """Names of the snapshots in a folder, in order."""
        if not self.fs.exists(self._path(root)):
            return []
        found = [x.getPath().getName() for x in self.fs.listStatus(self._path(root))]
        return sorted(n for n in found if self.fs.exists(self._path(f"{root}/{n}/snapshot.json")) and not n.endswith(".tmp"))

    def drop_snapshot(self, target: str) -> bool:
        """Delete a snapshot; a folder that is none stays."""
        return self.fs.exists(self._path(f"{target}/snapshot.json")) and self.fs.delete(self._path(target), True)
