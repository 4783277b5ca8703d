"""What the operators share: reading tables, the shared folder, words, salted joins."""

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


#: Bytes of an Arrow batch on its way to a Python worker, however long the texts of its rows.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES; a lower one stays."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none and all of Spark is one process (tests) a temporary folder is made and
    set as the checkpoint folder; it goes when the process ends. On a cluster without the setting: an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, named[7:], True)
        spark.conf.set("spark.checkpoint.dir", named)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Folders of the tables that stored() has written and nothing has dropped.
_written = []


def stored(df: DataFrame, label: str = "part") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables made by stored() that nothing reads any more."""
    for df in frames:
        folders = {x.rsplit("/", 1)[0].rsplit("/", 1)[1] for x in df.inputFiles()}
        for path in [p for p in _written if p.rsplit("/", 1)[1] in folders]:
            _delete(df.sparkSession, path)
            _written.remove(path)


def dropping(make):
    """The table of make(), stored, without the tables that were stored on the way to it."""
    before = len(_written)
    out = make()
    result = _written[-1] if _written[before:] else None
    for path in _written[before:-1]:
        _delete(out.sparkSession, path)
    _written[before:] = [result] if result else []
    return out


def col(name: str) -> Column:
    """The column of just this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, made, **working: Column) -> DataFrame:
    """df's columns without those named made (whatever their case) in one struct, own, beside working columns: no names can clash."""
    bound_batches(df.sparkSession)
    made = {c.lower() for c in made}
    own = [col(c) for c in df.columns if c.lower() not in made]
    return df.select((F.struct(*own) if own else F.struct(F.lit(None).cast("int").alias("none"))).alias("own"), *[c.alias(n) for n, c in working.items()])


def unpacked(df: DataFrame, *made) -> DataFrame:
    """The columns in own, and made."""
    none = df.schema["own"].dataType.names == ["none"]
    return df.select(*([] if none else ["own.*"]), *made)


def with_own(df: DataFrame, rest: str) -> StructType:
    """The schema of df's own and of the columns of a DDL string."""
    return StructType([df.schema["own"], *StructType.fromDDL(rest).fields])


def give_back() -> None:
    """At the end of a task: memory that this worker no longer uses goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def words(text: Column) -> Column:
    """Maximal runs of characters other than the six spaces, in order; null or blank text: no words."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))
