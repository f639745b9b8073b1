"""Helpers that the training-data operators share: tables, the shared scratch folder, plan barriers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys at most that with_once() broadcasts.
HEAVY = 10_000
#: Word characters of every contract: anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only a local session, which has one machine, may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/corvane-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared scratch space."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Bucketed:
    """A table bucketed by a column, which later steps group by without a shuffle; it may grow, and is dropped in the end."""

    def __init__(self, df: DataFrame, column: str, parts: int):
        self.spark, self.column, self.parts = df.sparkSession, column, parts
        self.name = f"corvane_{uuid.uuid4().hex}"
        self.path = f"{scratch(self.spark)}/{self.name}"
        self._write(df, "errorifexists")

    def _write(self, df: DataFrame, mode: str) -> None:
        writer = df.write.mode(mode).bucketBy(self.parts, self.column).option("path", self.path).option("compression", "zstd")
        writer.saveAsTable(self.name)

    def append(self, df: DataFrame) -> None:
        self._write(df.repartition(self.parts, self.column), "append")

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        discard(self.spark, self.path)


def with_once(rows: DataFrame, once: DataFrame, key: str, times: str = "times") -> DataFrame:
    """rows with the columns of once, which has one row for every key and the number of rows that hold it (times, left out).

    Keys with more than 1 / HEAVY of all rows (and more than 1,000) are joined by broadcast, at most HEAVY of them; the others by
    shuffle, where rows of a heavy key and those without one are dealt out without a match. So no task gets all rows of a common key.
    """
    bound = max(1000, rows.count() // HEAVY)
    rest = [c for c in once.columns if c not in (key, times)]
    values = F.struct(*rest)
    heavy = once.where(F.col(times) > bound).select(F.col(key).alias("_heavy"), values.alias("_a"))
    light = once.where(F.col(times) <= bound).select(F.col(key).alias("_light"), values.alias("_b"))
    met = rows.join(F.broadcast(heavy), rows[key] == heavy["_heavy"], "left")
    apart = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")).cast(rows.schema[key].dataType)
    met = met.withColumn("_own", F.when(F.col("_a").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(apart))
    met = met.join(light, met["_own"] == light["_light"], "left").withColumn("_found", F.coalesce("_a", "_b"))
    return met.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in rest])


def masked(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with every column but own ones under a name that no operator uses, and those names: a given column may have any name."""
    names = {c: c if c in own else f"_given_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later steps cannot inline (a one-element generator keeps the optimizer from copying value)."""
    return df.select("*", F.explode(F.array(value)).alias(name))
