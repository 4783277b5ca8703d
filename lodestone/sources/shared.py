"""Tables derived once from a source and kept in the folder that driver and executors share."""

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where all of Spark is one process and the session names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, named[7:], True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(Path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(source: DataFrame, *more: str) -> str:
    """A name for what source reads and how: its plan, and path, size and time of its files."""
    spark, digest = source.sparkSession, hashlib.sha256()
    plan = source._jdf.queryExecution().analyzed().canonicalized().toString()
    for x in (plan, *more):
        digest.update(x.encode() + b"\0")
    for f in sorted(source.inputFiles()):
        p, fs = hadoop_path(spark, f)
        s = fs.getFileStatus(p)
        digest.update(f"{f}\0{s.getLen()}\0{s.getModificationTime()}\0".encode())
    return digest.hexdigest()[:32]


def source_bytes(source: DataFrame) -> int:
    """Bytes of the files that source reads."""
    total = 0
    for f in source.inputFiles():
        p, fs = hadoop_path(source.sparkSession, f)
        total += fs.getFileStatus(p).getLen()
    return total


def kept(source: DataFrame, label: str, make: Callable[[str], None], *more: str) -> str:
    """The folder of what make writes for source; written aside and renamed, so that a folder that is there is whole.

    A changed file, another plan or other options give another folder; of two that write at once one wins.
    """
    spark = source.sparkSession
    folder = f"{shared_dir(spark)}/{label}-{fingerprint(source, label, *more)}"
    at, fs = hadoop_path(spark, folder)
    if not fs.exists(at):
        aside = f"{folder}.{uuid.uuid4().hex}"
        make(aside)
        if not fs.rename(hadoop_path(spark, aside)[0], at) or fs.exists(hadoop_path(spark, f"{folder}/{aside.rsplit('/', 1)[1]}")[0]):
            fs.delete(hadoop_path(spark, aside)[0], True)
            if not fs.exists(at):
                raise OSError(f"{folder} can't be written")
    return folder
