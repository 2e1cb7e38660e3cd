"""Rolling statistics over rows or calendar windows of each key."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from panelwright.operators import ranges


def last_rows(key: str, order: str, n: int) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)


def rolling(c: str, over: WindowSpec, least: int, how: str = "avg") -> Column:
    """A statistic of the window's non-null values; null under ``least`` of them."""
    value = F.expr(f"percentile({c}, 0.5)") if how == "median" else F.expr(f"{how}({c})")
    return F.when(F.count(c).over(over) >= least, value.over(over))


def change(c: str, key: str, order: str, n: int) -> Column:
    """Relative change from the value ``n`` rows before; nothing is filled in."""
    return F.try_divide(F.col(c), F.lag(c, n).over(Window.partitionBy(key).orderBy(order))) - 1


def mid_rank(c: str, over: Column) -> Column:
    """(less + half of equal) / count of the collected window, the current row included."""
    less, equal = F.size(F.filter(over, lambda x: x < F.col(c))), F.size(F.filter(over, lambda x: x == F.col(c)))
    return F.when(F.col(c).isNotNull(), (less + equal * F.lit(0.5)) / F.size(over))


def average_rank(c: str, over: Column) -> Column:
    """Average rank / count of the collected window; differs from ``mid_rank`` by half a place."""
    less, equal = F.size(F.filter(over, lambda x: x < F.col(c))), F.size(F.filter(over, lambda x: x == F.col(c)))
    return F.when(F.col(c).isNotNull(), (less + (equal + 1) * F.lit(0.5)) / F.size(over))


def calendar_values(c: str, key: str, date: str, years: int) -> Column:
    """Non-null values of the last ``years`` calendar years, both ends included."""
    end = f"partition by {key} order by {date} range between interval '{years}' year preceding and current row"
    return F.expr(f"collect_list({c}) over ({end})")


def row_values(c: str, over: WindowSpec) -> Column:
    return F.collect_list(c).over(over)


def guarded(a: str, b: str) -> Column:
    """a / b where b is positive, else null."""
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def calendar_rank(rows: DataFrame, key: str, date: str, c: str, years: int, name: str) -> DataFrame:
    """``rows`` (one for each key and date) with the mid-rank percentile of ``c`` among the last ``years`` calendar years.

    For frames too long to hold as an array in every row: each row meets the calendar years that its window
    touches, so that a task holds one key's year, and only counts are kept. Null values neither count nor rank.
    """
    own = rows.select(F.col(key).alias("_k"), F.col(date).alias("_d"), F.col(c).alias("_v")).where("_v is not null and _d is not null")
    start = F.add_months("_d", -12 * years)
    asks = own.withColumn("_from", start).withColumn("_y", F.explode(F.sequence(F.year("_from"), F.year("_d"))))
    have = own.select(F.col("_k").alias("_hk"), F.year("_d").alias("_hy"), F.col("_d").alias("_hd"), F.col("_v").alias("_hv"))
    met = asks.join(have, (F.col("_k") == F.col("_hk")) & (F.col("_y") == F.col("_hy")) & F.col("_hd").between(F.col("_from"), F.col("_d")))
    less, same = F.count_if(F.col("_hv") < F.col("_v")), F.count_if(F.col("_hv") == F.col("_v"))
    ranks = met.groupBy("_k", "_d").agg(((less + same * F.lit(0.5)) / F.count("*")).alias(name))
    return rows.join(ranks, F.col(key).eqNullSafe(F.col("_k")) & F.col(date).eqNullSafe(F.col("_d")), "left").drop("_k", "_d")


def order_statistics(
    rows: DataFrame, keys: list[str], order: list[str], c: str, stats: dict[str, tuple[str | float, int, int]], *, chunk: int = 100_000,
) -> DataFrame:
    """``rows`` with statistics of the place of ``c`` among its key's last rows, the current one included.

    ``stats`` gives for each new column what it is (``"mid"`` or ``"average"`` for the current value's rank as ``mid_rank`` and ``average_rank`` have
    it, or the share of a quantile, 0.5 for the median), how many rows the frame has, and how many values it needs. Nulls take a row of a frame and no
    place. ``"sum"``, ``"mean"`` and ``"max"`` are of the frame's values, and ``"first"`` is its first row's value where the frame is whole. A key is cut into chunks that overlap by the longest frame; in a chunk the frame's values are kept sorted, so a row
    costs a search and two moves, whatever the frame's length; sums and maxima cost two steps.
    """
    longest = max(n for _, n, _ in stats.values())
    spread = ranges.with_halos(ranges.numbered(rows, keys, order), "_n", longest, max(chunk, longest))
    schema = spread.drop("_n", "_chunk", "_own").schema
    for name in stats:
        schema = schema.add(name, "double")
    arrow = to_arrow_schema(schema)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("_n")
        values = [float("nan") if v is None else float(v) for v in part.column(c).to_pylist()]
        there = part.column(c).is_valid().to_numpy()
        for name, (kind, n, least) in stats.items():
            found = framed(np.array(values), there, kind, n, least) if kind in FRAMED else pa.array(placed(values, kind, n, least), pa.float64())
            part = part.append_column(name, found)
        return part.filter(part.column("_own")).select(arrow.names).cast(arrow)

    return spread.groupBy(*keys, "_chunk").applyInArrow(run, schema)


FRAMED = ("sum", "mean", "max", "first")


def framed(values: np.ndarray, there: np.ndarray, kind: str, n: int, least: int) -> pa.Array:
    """Sum, mean, maximum or first value of each row's frame of ``n`` rows, of the values that are ``there``.

    Rows are cut into blocks of ``n``: a frame is the end of one and the beginning of the next, so nothing is taken away again from what was added.
    """
    size = len(values)
    if kind == "first":
        whole = np.arange(size) >= n - 1
        from_ = np.maximum(np.arange(size) - n + 1, 0)
        return pa.array(values[from_], pa.float64(), mask=~(whole & there[from_]))
    join, nothing = (np.maximum, -np.inf) if kind == "max" else (np.add, 0.0)

    def over(column: np.ndarray, step: np.ufunc) -> np.ndarray:
        blocks = np.append(column, np.zeros(-size % n, column.dtype)).reshape(-1, n)
        begun = step.accumulate(blocks, axis=1).ravel()[:size]
        ended = step.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        from_ = np.arange(size) - n + 1
        two = np.flatnonzero((from_ > 0) & (from_ % n != 0))
        begun[two] = step(begun[two], ended[from_[two]])
        return begun

    found, many = over(np.where(there, values, nothing), join), over(there.astype(np.int64), np.add)
    return pa.array(found / np.maximum(many, 1) if kind == "mean" else found, pa.float64(), mask=many < max(least, 1))


def placed(values: list[float], kind: str | float, n: int, least: int) -> list[float | None]:
    """One statistic of each value's frame of ``n`` rows; nan stands for null."""
    held: list[float] = []
    out: list[float | None] = []
    for i, v in enumerate(values):
        gone = values[i - n] if i >= n else float("nan")
        if gone == gone:
            del held[bisect_left(held, gone)]
        if v == v:
            insort(held, v)
        size = len(held)
        if size < max(least, 1) or (isinstance(kind, str) and v != v):
            out.append(None)
        elif isinstance(kind, str):
            less, upto = bisect_left(held, v), bisect_right(held, v)
            out.append((less + (upto - less + (kind == "average")) * 0.5) / size)
        else:
            at = kind * (size - 1)
            low = int(at)
            high = min(low + 1, size - 1)
            out.append(held[low] + (held[high] - held[low]) * (at - low))
    return out
