"""Checks and coverage of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def future_rows(panel: DataFrame, date: str, sources: list[str]) -> DataFrame:
    """One row for each source date column: how many rows have a source date after their own."""
    counts = panel.agg(*[F.count_if(F.col(s) > F.col(date)).alias(s) for s in sources])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("violations")) for s in sources])))


def assert_no_future(panel: DataFrame, date: str, sources: list[str]) -> None:
    bad = [r["source"] for r in future_rows(panel, date, sources).collect() if r["violations"]]
    if bad:
        raise ValueError(f"rows use data from after their date: {', '.join(bad)}")


def coverage(panel: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-null counts by key."""
    return panel.groupBy(key).agg(*[F.count(c).alias(c) for c in columns])


def span(panel: DataFrame, key: str, date: str) -> DataFrame:
    """First and last date and rows by key."""
    return panel.groupBy(key).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n_rows"))


def label_violations(labels: DataFrame) -> DataFrame:
    """Dates that have more than one label, or a lower bound over the upper one."""
    twice = labels.groupBy("date").count().where("count > 1").select("date", F.lit("duplicate date").alias("violation"))
    wrong = labels.where("star_low > star_high").select("date", F.lit("low over high").alias("violation"))
    return twice.unionByName(wrong)


def assert_labels(labels: DataFrame) -> DataFrame:
    bad = label_violations(labels).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['date']}: {r['violation']}" for r in bad))
    return labels
