"""Loads that arrive as a file stream: appended and coalesced when read, or merged into a target as they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from panelwright.operators.incremental import coalesce_latest


def refresh(spark: SparkSession, source: str, target: str, checkpoint: str, schema) -> StreamingQuery:
    """Starts a query that appends new load files to ``target``, each once; a batch writes only its own rows."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, keys: list[str], sequence: str) -> DataFrame:
    """One row for each key, null ones too: of every column the newest value, whatever order the loads came in."""
    return coalesce_latest(spark.read.parquet(target), keys, sequence)


def stored(loads: DataFrame, keys: list[str], sequence: str, parts: int) -> DataFrame:
    """One row a key as a target keeps it: of every column its newest value that isn't null with the sequence it came with, and the key's part."""
    values = [c for c in loads.columns if c not in (*keys, sequence)]
    newest = [F.max_by(F.struct(F.col(c).alias("value"), F.col(sequence).alias("at")), F.when(F.col(c).isNotNull(), F.col(sequence))).alias(c) for c in values]
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part")
    return loads.groupBy(*keys).agg(*newest).select(*keys, *values, part)


def merge_batch(target: str, batch: DataFrame, keys: list[str], sequence: str, *, parts: int = 64) -> list[int]:
    """Merges loads into ``target`` (Parquet in a folder for each hashed part of keys) and gives the parts that were touched.

    Only the parts that have a key of the batch are read and written. Each column is kept with its own sequence, so loads may come late, in any order,
    or again: the target is what all loads ever merged coalesce to. A part is replaced as a whole when its job commits; a merge that
    failed in between can simply be repeated. Equal sequences of a key's column keep the larger value. One merge runs at a time.
    """
    spark = batch.sparkSession
    fresh = stored(batch.where(F.col(sequence).isNotNull()), keys, sequence, parts)
    touched = sorted(r["part"] for r in fresh.select("part").distinct().collect())  # no more than ``parts``
    if not touched:
        return []
    try:
        old = spark.read.parquet(target).where(F.col("part").isin(*touched))
        both = old.unionByName(fresh, allowMissingColumns=True)
    except AnalysisException:  # the first batch makes the target
        both = fresh
    values = [c for c in both.columns if c not in (*keys, "part")]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(c)["at"], F.col(c)["value"]))).alias(c) for c in values]
    merged = both.groupBy(*keys, "part").agg(*newest)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(target)
    return touched


def merged(spark: SparkSession, target: str) -> DataFrame:
    """The target's rows with plain values."""
    table = spark.read.parquet(target).drop("part")
    plain: list[Column] = [F.col(f.name)["value"].alias(f.name) if isinstance(f.dataType, StructType) and f.dataType.names == ["value", "at"] else F.col(f.name) for f in table.schema.fields]
    return table.select(*plain)


def refresh_merged(spark: SparkSession, source: str, target: str, checkpoint: str, schema, keys: list[str], sequence: str, *, parts: int = 64) -> StreamingQuery:
    """Starts a query that merges new load files into ``target``; a batch that runs again changes nothing."""
    stream = spark.readStream.schema(schema).parquet(source)
    merge = lambda batch, _: merge_batch(target, batch, keys, sequence, parts=parts)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
