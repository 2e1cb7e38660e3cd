"""Long ordered series over many tasks: cuts at equal counts, row numbers, and chunks that overlap by a frame."""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType


def number(rows: DataFrame, c: str) -> Column:
    """A date, time or number as one that sorts alike: days, microseconds, or itself."""
    kind = rows.schema[c].dataType
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp"))
    if isinstance(kind, NumericType):
        return F.col(c)
    raise TypeError(f"{c} is neither a date, a time nor a number")


def cuts_of(rows: DataFrame, at: Column, parts: int) -> list:
    """Up to ``parts - 1`` ordered values that cut the rows into about equal numbers, from a sketch that partitions merge."""
    found = rows.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    return sorted(set(found or []))


def place(at: Column, cuts: list) -> Column:
    """How many cuts are at or before ``at``, none for null: whole groups of cuts are counted first, then those of one group."""
    if not cuts:
        return F.lit(0)
    step = isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    upto = lambda some: F.size(F.filter(some, lambda c: c <= at))
    row = lambda some: F.array(*[F.lit(c) for c in some])
    group = upto(row([g[0] for g in groups]))
    return F.when(group > 0, (group - 1) * step + upto(F.element_at(F.array(*[row(g) for g in groups]), group))).otherwise(0)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "_n", *, parts: int | None = None) -> DataFrame:
    """``rows`` with their places from 0 in the order of their key, without a task for a whole key.

    Rows are dealt by key and by cuts of the first column of ``order``; the counts of the cuts before are added to
    the place within. Rows that are equal in all of ``order`` have any order among them; nulls come first.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = number(rows, order[0])
    dealt = rows.withColumn("_cut", place(at, cuts_of(rows, at, parts)))
    by = [F.col(k) for k in keys]
    sizes = dealt.groupBy(*by, "_cut").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_cut").alias("_of_cut"), before.alias("_before"))
    on = F.col("_cut") == F.col("_of_cut")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    within = F.row_number().over(Window.partitionBy(*by, "_cut").orderBy(*order)) - 1
    found = dealt.join(starts, on).withColumn(name, F.col("_before") + within)
    return found.drop("_cut", "_of_cut", "_before", *[f"_of_{k}" for k in keys])


def with_halos(rows: DataFrame, n: str, longest: int, chunk: int) -> DataFrame:
    """Rows numbered by ``n`` in chunks ``_chunk`` of ``chunk`` rows, each with the ``longest - 1`` rows before it; ``_own`` tells its own."""
    if chunk < longest:
        raise ValueError("a chunk must not be shorter than the longest frame")
    own = F.floor(F.col(n) / chunk)
    spread = rows.withColumn("_chunk", F.explode(F.sequence(own, F.floor((F.col(n) + longest - 1) / chunk))))
    return spread.withColumn("_own", F.col("_chunk") == own)


def over_chunks(
    rows: DataFrame, keys: list[str], order: list[str], longest: int, columns: Callable[[WindowSpec], dict[str, Column]], *, chunk: int = 100_000,
) -> DataFrame:
    """``rows`` with window columns that look back at most ``longest - 1`` rows, worked out chunk by chunk.

    ``columns`` gives them from an ordered window (add a frame with ``rowsBetween``, or use ``lag``), which holds a chunk and
    the rows that its first ones look back to, so a key of any length is spread over tasks.
    """
    spread = with_halos(numbered(rows, keys, order), "_n", longest, chunk)
    window = Window.partitionBy(*keys, "_chunk").orderBy("_n")
    return spread.withColumns(columns(window)).where("_own").drop("_own", "_chunk", "_n")

