"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import checkpointed, give_back, small_batches, written

OVERHEAD = 8
#: A table of partitions with more rows than this isn't broadcast but joined by shuffle.
MOST_PARTS = 100_000


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to a sorted partition's rows the bytes before the row, and before the first row of its text."""
    total, group, began = 0, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("_size").to_numpy()
        before = total + np.concatenate(([0], np.cumsum(size)[:-1]))
        crc, key = batch.column("_crc").to_numpy(), batch.column("_hash").to_numpy()
        new = np.concatenate(([(int(crc[0]), int(key[0])) != group], (crc[1:] != crc[:-1]) | (key[1:] != key[:-1])))
        start = np.maximum.accumulate(np.where(new, before, began))
        total, group, began = int(before[-1] + size[-1]), (int(crc[-1]), int(key[-1])), int(start[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(start, pa.int64())], names=[*batch.schema.names, "_before", "_start"])
    give_back()


def offsets(totals: list) -> tuple[int, list[tuple]]:
    """All bytes, and for each partition the rows and bytes before it and where its first text starts, if before it."""
    at = rows = 0
    out, group, began = [], None, 0
    for t in sorted(totals, key=lambda t: t["_part"]):
        lead = began if t["first"] == group else at
        out.append((t["_part"], rows, at, lead, *t["first"]))
        began = lead if t["last"] == t["first"] else at + t["began"]
        group = t["last"]
        rows += t["rows"]
        at += t["bytes"]
    return at, out


def assign(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, shards: int = 24, whole: float = 0.02) -> DataFrame:
    """The columns ``keep`` (the id, if not given) of each row with ``_size, _crc, _shard, _slot``.

    The global order is by text hash, then id. Bytes are summed up to each row from
    the totals of the partitions before it, and the shard is where that sum falls among
    ``shards`` equal parts of all bytes. Equal texts lie side by side and go by where
    their first row starts, up to ``whole`` of a shard's bytes, so they stay together
    unless they are too many for that. ``_slot`` counts from 0 in each shard. Null texts weigh 8 bytes
    and count as empty ones; equal rows may swap slots; no rows give no shards. A kept column with a result's name gives
    way to the result. Only a row for each partition reaches the driver; their number is that of
    ``spark.sql.shuffle.partitions``, and the table of them is broadcast up to ``MOST_PARTS`` rows.
    """
    keep = [c for c in keep or [id_col] if c.lower() not in ("_size", "_crc", "_shard", "_slot")]
    small_batches(docs.sparkSession)
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        *[F.col(c).alias(f"_in_{c}") for c in keep],
        F.col(id_col).alias("_id"),
        byte_size(F.col(text_col)).alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.xxhash64(text).alias("_hash"),
    )
    order = [F.col("_crc").asc(), F.col("_hash").asc(), F.col("_id").asc_nulls_last()]
    narrow = all(docs.schema[c].dataType.simpleString() != "string" for c in keep)
    # The range bounds are sampled from the rows: of a narrow table texts are read and hashed once, not twice.
    rows = checkpointed(rows) if narrow else rows
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    schema = StructType([*placed.schema.fields, StructField("_before", LongType()), StructField("_start", LongType())])
    placed = (checkpointed if narrow else written)(placed.mapInArrow(running, schema).withColumn("_part", F.shiftright("_at", 33)))

    key = F.struct("_crc", "_hash")
    totals = placed.groupBy("_part").agg(
        F.count("*").alias("rows"), F.sum("_size").alias("bytes"), F.min_by(key, "_at").alias("first"), F.max_by(key, "_at").alias("last"), F.max_by("_start", "_at").alias("began")
    )
    total, known = offsets(totals.collect())
    parts = spark.createDataFrame(known, "_p int, _rows long, _bytes long, _lead long, _lead_crc long, _lead_hash long")
    joined = placed.join(F.broadcast(parts) if len(known) <= MOST_PARTS else parts, F.col("_part") == F.col("_p"))
    leads = (F.col("_crc") == F.col("_lead_crc")) & (F.col("_hash") == F.col("_lead_hash"))
    start = F.when(leads, F.col("_lead")).otherwise(F.col("_bytes") + F.col("_start"))
    limit = int(whole * total / shards)
    at = F.greatest(start, F.col("_bytes") + F.col("_before") - limit)
    joined = joined.withColumn("_place", at).withColumn("_row", F.col("_rows") + F.col("_at").bitwiseAND((1 << 33) - 1))
    joined = joined.withColumn("_shard", F.expr(f"cast(_place * {shards} div {max(total, 1)} as int)"))
    first = joined.groupBy(F.col("_shard").alias("_k")).agg(F.min("_row").alias("_first"))
    return joined.join(F.broadcast(first), F.col("_shard") == F.col("_k")).select(
        *[F.col(f"_in_{c}").alias(c) for c in keep], "_size", "_crc", "_shard", (F.col("_row") - F.col("_first")).alias("_slot")
    )
