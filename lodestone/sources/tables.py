"""Reading and writing tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its files give fewer partitions: for costly work per row on few row groups."""
    n = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(n) if len(files) < n else df


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents {id, fields, metadata} of a JSON array, one column a field; a field of metadata shadows one of fields."""
    df = spark.read.json(path, multiLine=True)
    out = {"id": F.col("id").cast("string")}
    for part in ("fields", "metadata"):
        if part in df.columns:
            for c in df.schema[part].dataType.names:
                out[c] = F.col(f"{part}.`{c}`")
    return df.select(*[v.alias(k) for k, v in out.items()])


def upsert(base: DataFrame, changes: DataFrame, id: str = "id") -> DataFrame:
    """base with the rows of changes instead of those with equal ids."""
    return base.join(changes.select(id), id, "left_anti").unionByName(changes)


def remove(base: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return base.join(ids.select(id).distinct(), id, "left_anti")


def page_of(df: DataFrame, order, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def validate(df: DataFrame, schema: dict[str, str], id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows that fit, rejects with reason): id not empty, values castable to the declared types; unknown columns are an error."""
    if extra := set(df.columns) - set(schema) - {id}:
        raise ValueError(f"unknown fields: {sorted(extra)}")
    bad = F.when(F.coalesce(F.col(id).cast("string"), F.lit("")) == "", F.lit(id))
    for c, kind in schema.items():
        if c in df.columns:
            bad = bad.when(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS {kind})").isNull(), F.lit(c))
    marked = df.withColumn("reason", bad)
    good = marked.where("reason IS NULL").select(F.col(id), *[F.expr(f"try_cast(`{c}` AS {k})").alias(c) for c, k in schema.items() if c in df.columns])
    return good, marked.where("reason IS NOT NULL")
