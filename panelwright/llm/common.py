"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if it is set.

    Where it is unset, local mode takes a temporary folder and a cluster takes
    one inside the warehouse, which executors share as well.
    """
    sc = spark.sparkContext
    if (where := spark.conf.get("spark.checkpoint.dir", None)) is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if sc.master.startswith("local[") or sc.master == "local":
            where = tempfile.mkdtemp(prefix="panelwright-")
        else:
            where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a narrow table through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Cuts the lineage of a table with texts: Parquet in the shared folder, read back; ``group_bytes`` sets the size of row groups, of which a task holds one, for rows that are large."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    # Else a group's size is looked at after a hundred rows only.
    sized = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1} if group_bytes else {}
    df.write.options(**sized).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that no model learns from; a null id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hash_share(keys: list[Column], salt: str) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def small_batches(spark: SparkSession) -> None:
    """Rows of an Arrow batch: texts are long, and a batch is held in the JVM and in Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, str(ROWS))


@contextlib.contextmanager
def rows_of_a_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it, jobs send so many rows at once to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Returns what a finished task leaves unused in its Python worker to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def with_columns(df: DataFrame, make: Callable[[pa.RecordBatch], list], fields: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds the columns that ``make`` gives for each Arrow batch; the others pass through as they are.

    Batches have ``ROWS`` rows at most and are cut to about 8 MB, so that a run of very long
    texts stays within memory, and a task gives its memory back at its end, as its worker
    outlives it. ``drop`` names input columns that only ``make`` needs; a column that has the name of a
    new one gives way to it.
    """
    small_batches(df.sparkSession)
    extra = StructType.fromDDL(fields)
    new = {c.lower() for c in extra.names}
    kept = [c for c in df.columns if c not in drop and c.lower() not in new]
    schema = StructType(df.select(*kept).schema.fields + extra.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, int(batch.num_rows * 8e6 / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = make(part)
                arrays = [part.column(c) for c in kept] + [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(len(kept) + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def salted_join(rows: DataFrame, counts: DataFrame, keys: list[str], by: Column, parts: int = 24) -> DataFrame:
    """``rows`` with the one row of ``counts`` for its keys, null keys too; those without one go.

    Rows of one key are dealt to ``parts`` tasks by the hash of ``by``, and each row of ``counts`` goes to all of them.
    """
    spread = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = F.col("_salt") == F.col("_dealt")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    dealt = rows.withColumn("_dealt", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    return dealt.join(spread, on).drop("_salt", "_dealt", *[f"_of_{k}" for k in keys])
