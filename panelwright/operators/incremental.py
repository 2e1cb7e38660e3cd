"""Tail refresh: which windows are missing, and how overlapping loads become one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators import panels


def date_windows(start: Column, end: Column, years: int = 10) -> Column:
    """Windows of ``years`` years from ``start`` on, as an array of (start, end); none if it is after ``end``.

    Each window starts the day after the one before it. A start on 29 February goes on from the
    28th, as a start that is clipped once does.
    """
    leap = (F.month(start) == 2) & (F.dayofmonth(start) == 29)
    base = F.when(leap, F.date_sub(start, 1)).otherwise(start)
    count = F.floor(F.months_between(end, start) / (12 * years)).cast("int")
    from_ = lambda i: F.when(i == 0, start).otherwise(F.add_months(base, i * 12 * years))
    window = lambda i: F.struct(from_(i).alias("from_date"), F.least(F.date_sub(F.add_months(base, (i + 1) * 12 * years), 1), end).alias("to_date"))
    return F.when(start <= end, F.filter(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0)) + 1), window), lambda w: w["from_date"] <= end)).otherwise(
        F.array().cast("array<struct<from_date:date,to_date:date>>")
    )


def last_loaded(table: DataFrame, key: str, date: str) -> DataFrame:
    return table.groupBy(key).agg(F.max(date).alias("last_date"))


def missing_windows(keys: DataFrame, loaded: DataFrame, key: str, first: Column, end: Column, *, years: int = 10, force: bool = False) -> DataFrame:
    """One row for each window after a key's last loaded date; all windows for a key that has none, or if forced."""
    known = loaded.select(F.col(key).alias("_key"), "last_date")
    joined = keys.join(known, F.col(key) == F.col("_key"), "left")
    start = first if force else F.coalesce(F.greatest(F.date_add("last_date", 1), first), first)
    return joined.select(key, F.inline(date_windows(start, end, years)))


def coalesce_latest(loads: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """One row for each key: of every column the newest value that is not null."""
    values = [c for c in loads.columns if c not in (*keys, sequence)]
    newest = [F.expr(f"max_by(`{c}`, `{sequence}`) filter (where `{c}` is not null)").alias(c) for c in values]
    return loads.groupBy(*keys).agg(*newest)


def consolidate(
    loads: DataFrame, keys: list[str], sequence: str, preferred: list[str], *, existing: DataFrame | None = None, code: str | None = None, date: str | None = None,
) -> DataFrame:
    """``coalesce_latest`` with the preferred columns first and the others by name.

    ``existing`` is a table of an earlier run, older than every load; ``code`` is padded and ``date`` made a local day first.
    """
    if existing is not None:
        loads = loads.unionByName(existing.withColumn(sequence, F.lit(None).cast(loads.schema[sequence].dataType)), allowMissingColumns=True)
        loads = loads.withColumn(sequence, F.struct(F.col(sequence).isNotNull().alias("new"), F.col(sequence).alias("at")))
    if code:
        loads = loads.withColumn(code, panels.padded_code(F.col(code)))
    if date:
        loads = loads.withColumn(date, panels.local_date(F.col(date)))
    merged = coalesce_latest(loads, keys, sequence)
    first = [c for c in preferred if c in merged.columns]
    return merged.select(*first, *sorted(c for c in merged.columns if c not in first))


def decade_windows(start_year: Column, end: Column, years: int = 10) -> Column:
    """Windows of whole calendar years as an array of (from_date, to_date): each starts on 1 January, the last one ends on ``end``."""
    last = F.year(end)
    first = lambda i: start_year + i * years
    to = lambda i: F.when(first(i) + years - 1 >= last, end).otherwise(F.make_date(first(i) + years - 1, F.lit(12), F.lit(31)))
    window = lambda i: F.struct(F.make_date(first(i), F.lit(1), F.lit(1)).alias("from_date"), to(i).alias("to_date"))
    some = F.transform(F.sequence(F.lit(0), F.floor((last - start_year) / years).cast("int")), window)
    return F.when(start_year <= last, some).otherwise(F.array().cast("array<struct<from_date:date,to_date:date>>"))
