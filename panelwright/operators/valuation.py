"""Index valuation from constituents, trailing bands, flows, launches and breadth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwright.operators import rolling


def index_valuation(members: DataFrame, by: list[str], cap: str, profit: str) -> DataFrame:
    """Price-earnings ratios of each group of members, by five weightings; a member without profit or loss has none."""
    c, p = F.col(cap), F.col(profit)
    pe = F.when(p != 0, c / p)
    return members.groupBy(*by).agg(
        F.count(pe).alias("members"),
        F.try_divide(F.sum(c), F.sum(p)).alias("cap_weighted"),
        F.try_divide(F.count(pe), F.sum(F.when(p != 0, F.try_divide(p, c)))).alias("harmonic"),
        F.try_divide(F.sum(F.when(p > 0, c)), F.sum(F.when(p > 0, p))).alias("positive_weighted"),
        F.avg(F.when(pe > 0, pe)).alias("positive_mean"),
        F.median(pe).alias("median_pe"),
    )


def merged_spans(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Spans ``[start, end)`` of each ``by`` with those that overlap or touch made one; a null start or end is open. Empty spans go."""
    low, high = F.to_date(F.lit("0001-01-01")), F.to_date(F.lit("9999-12-31"))
    rows = spans.select(*by, F.coalesce(F.col(start), low).alias("_from"), F.coalesce(F.col(end), high).alias("_to")).where("_from < _to")
    order = Window.partitionBy(*by).orderBy("_from", "_to")
    reached = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("_from") <= reached, 0).otherwise(1)).over(order)
    out = rows.withColumn("_island", island).groupBy(*by, "_island").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    return out.select(*by, F.when(F.col("_from") > low, F.col("_from")).alias(start), F.when(F.col("_to") < high, F.col("_to")).alias(end))


def members_at(rows: DataFrame, spans: DataFrame, *, key: str, group: str, date: str, start: str, end: str, days: int = 128) -> DataFrame:
    """``rows`` once for each ``group`` whose spans ``[start, end)`` of the row's key hold its date; a null start or end is open.

    Both sides meet by key and stretch of ``days`` days: a row is in one stretch, a span in all that it touches between the
    first and last date of the rows. So a pair meets once, and a key with many rows is spread by time. Spans of a
    group that overlap count once. Rows with a null key or date belong to nothing.
    """
    one = merged_spans(spans.where(F.col(key).isNotNull() & F.col(group).isNotNull()), [key, group], start, end)
    ends = rows.agg(F.min(date).alias("low"), F.max(date).alias("high")).first()
    stretch = lambda d: F.floor(F.unix_date(d) / days)
    low, high = F.lit(ends["low"]).cast("date"), F.lit(ends["high"]).cast("date")
    first, last = F.greatest(F.coalesce(F.col(start), low), low), F.least(F.coalesce(F.date_sub(end, 1), high), high)
    spread = one.where(first <= last).select(F.col(key).alias("_key"), group, F.col(start).alias("_from"), F.col(end).alias("_to"), F.explode(F.sequence(stretch(first), stretch(last))).alias("_stretch"))
    inside = (F.col("_from").isNull() | (F.col(date) >= F.col("_from"))) & (F.col("_to").isNull() | (F.col(date) < F.col("_to")))
    return rows.join(spread, (F.col(key) == F.col("_key")) & (stretch(F.col(date)) == F.col("_stretch")) & inside).drop("_key", "_from", "_to", "_stretch")


def derived_ratios(
    panel: DataFrame, *, gdp: str, bond: str, caps: dict[str, str], earnings: dict[str, str], balances: dict[str, tuple[str, str]],
) -> DataFrame:
    """``panel`` with its valuation ratios: ``caps`` over output, for each weighting of ``earnings`` (its price-earnings column) the earnings yield, its ratio to
    the bond's and its spread over it, and ``balances`` (two columns each) over one another.

    Output, bond yields and price-earnings ratios that aren't positive give nulls; a balance over zero does as well.
    """
    positive = lambda c: F.when(F.col(f"`{c}`") > 0, F.col(f"`{c}`"))
    out = {name: F.col(f"`{cap}`") / positive(gdp) for name, cap in caps.items()}
    for name, pe in earnings.items():
        earned = 1 / positive(pe)
        out |= {f"earnings_yield_{name}": earned, f"equity_bond_ratio_{name}": earned / positive(bond), f"equity_bond_spread_{name}": earned - positive(bond)}
    out |= {name: F.try_divide(F.col(f"`{a}`"), F.col(f"`{b}`")) for name, (a, b) in balances.items()}
    return panel.withColumns(out)


def bands(c: str, over: WindowSpec, least: int) -> Column:
    """20, 50 and 80 % values of a trailing window; null under ``least`` values."""
    return F.when(F.count(c).over(over) >= least, F.expr(f"percentile({c}, array(0.2, 0.5, 0.8))").over(over))


def trailing_days(by: list[str], date: str, days: int) -> WindowSpec:
    """The last ``days`` calendar days, the current one included."""
    return Window.partitionBy(*by).orderBy(F.unix_date(date)).rangeBetween(-(days - 1), 0)


def first_of_parent(rows: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """One row a parent, the first by ``order``: share classes of a fund count once."""
    rest = [c for c in rows.columns if c != parent]
    return rows.groupBy(parent).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(parent, "_row.*")


def launches(rows: DataFrame, by: list[str], date: str, scale: str, days: tuple[int, ...]) -> DataFrame:
    """Counts and total scale over trailing calendar days, on each date with a launch.

    Rows are summed by date first, so that the ordered window has a row a date.
    """
    daily = rows.groupBy(*by, date).agg(F.count("*").alias("_n"), F.sum(scale).alias("_s"))
    over = {d: trailing_days(by, date, d) for d in days}
    return daily.select(
        *by, date,
        *[F.sum("_n").over(w).alias(f"count_{d}") for d, w in over.items()],
        *[F.sum("_s").over(w).alias(f"scale_{d}") for d, w in over.items()],
    )


def inflow(shares: str, price: str, key: str, date: str) -> Column:
    """Change of shares since the row before, at the current price."""
    return (F.col(shares) - F.lag(shares).over(Window.partitionBy(key).orderBy(date))) * F.col(price)


def breadth(rows: DataFrame, key: str, date: str, c: str, years: int, below: float = 0.2) -> DataFrame:
    """Share of members on each date that stand under their own trailing percentile ``below``."""
    ranked = rows.select(date, rolling.mid_rank(c, rolling.calendar_values(c, key, date, years)).alias("_rank"))
    return ranked.groupBy(date).agg(F.count("_rank").alias("members"), F.avg((F.col("_rank") < below).cast("double")).alias("share_below"))
