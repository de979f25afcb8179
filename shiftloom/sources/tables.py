"""Readers, keyed caches, append logs and sinks. All tables are Parquet or CSV with given schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; words may be any strings, so quotes are doubled and an unquoted empty field alone is null."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").csv(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """One file only where the result is known to be small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def json_rows(df: DataFrame) -> DataFrame:
    """A JSON object per row: missing numbers as 0, a missing trajectory as flat."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    filled = df.na.fill(0, numbers)
    filled = filled.select(*[F.when(F.isnan(c), F.lit(0.0)).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in filled.dtypes])
    if "trajectory" in filled.columns:
        filled = filled.na.fill({"trajectory": "flat"})
    return filled.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in filled.columns])).alias("json"))


class KeyedTable:
    """A cache table with rows by key. ``read_through`` works out only keys that it lacks."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...]) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path, schema, list(keys)

    def rows(self) -> DataFrame:
        """Of a key that was written more than once, the last batch."""
        try:
            all_ = self.spark.read.parquet(self.path)
        except Exception as e:  # the table isn't there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)
        last = F.max("_batch").over(Window.partitionBy(*self.keys))
        return all_.withColumn("_last", last).where("_batch = _last").drop("_batch", "_last").select(*self.spark.createDataFrame([], self.schema).columns)

    def known(self) -> DataFrame:
        return self.rows().select(*self.keys).distinct()

    def missing(self, wanted: DataFrame) -> DataFrame:
        return wanted.select(*self.keys).distinct().join(self.known(), self.keys, "left_anti")

    def append(self, df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("append").parquet(self.path)

    def read_through(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], batch: int = 0) -> DataFrame:
        absent = self.missing(wanted)
        if not absent.isEmpty():
            self.append(compute(absent), batch)
        return self.rows().join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")


class AppendLog:
    """A log that only grows: each batch's rows get the next numbers of their key (``seq``), in a given order."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...]) -> None:
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.schema = f"{schema}, seq long"

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:  # the log isn't there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def append(self, df: DataFrame, order: list) -> None:
        last = self.rows().groupBy(*self.keys).agg(F.max("seq").alias("_last"))
        number = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order))
        rows = df.withColumn("_n", number).join(last, self.keys, "left").withColumn("seq", F.col("_n") + F.coalesce("_last", F.lit(0)))
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("append").parquet(self.path)


def from_json_rows(rows: DataFrame, schema: str) -> DataFrame:
    """The rows that ``json_rows`` wrote."""
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")


def deficit(log: DataFrame, wanted: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, deficit) of the wanted keys whose append log holds fewer than ``n`` rows."""
    have = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"))
    return wanted.join(have, keys, "left").select(*keys, (F.lit(n) - F.coalesce("have", F.lit(0))).alias("deficit")).where("deficit > 0")


def first_of_log(log: DataFrame, keys: list[str], n: int) -> DataFrame:
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where(F.col("_n") <= n).drop("_n")


def inferred(prompts: DataFrame, schema: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Rows that a model makes from prompts: ``load`` runs once per task and gives a function of batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return prompts.mapInPandas(run, schema)


def span_mean(hidden: DataFrame, keys: list[str], first: str) -> DataFrame:
    """Contextual word vectors: the mean of hidden states (keys, pos, vec) at positions from the column ``first`` on, at
    length 1."""
    each = hidden.where(F.col("pos") >= F.col(first)).select(*keys, F.posexplode("vec").alias("dim", "x"))
    mean = each.groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return mean.groupBy(*keys).agg(vec.alias("v")).select(*keys, F.transform("v", lambda x: (x / F.greatest(norm, F.lit(1e-12))).cast("float")).alias("vec"))
