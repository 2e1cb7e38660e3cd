"""Resolving rated observations to one label a date, and merging sources by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unanimous(rows: DataFrame, date: str, value: str, order: list[Column]) -> DataFrame:
    """The first row by ``order`` of each date whose rows agree on the value; null dates are one group."""
    # The first row is chosen within partitions first, and agreement is two aggregates: no task holds all rows of a date.
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(date).orderBy(*order))).where("_n = 1").drop("_n")
    agreed = rows.groupBy(F.col(date).alias("_date")).agg(F.min(value).alias("_low"), F.max(value).alias("_high")).where("_low = _high")
    return first.join(agreed, F.col(date).eqNullSafe(F.col("_date"))).drop("_date", "_low", "_high")


def conflicts(rows: DataFrame, date: str, value: str, ids: str) -> DataFrame:
    """Dates whose rows disagree, with the values and ids joined by ``|``."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|")
    found = rows.groupBy(date).agg(F.count_distinct(value).alias("_n"), joined(value).alias("values"), joined(ids).alias("ids"))
    return found.where("_n > 1").drop("_n")


def overlay(preferred: list[DataFrame], fallback: DataFrame, date: str) -> DataFrame:
    """``fallback`` rows on dates that none of the ``preferred`` tables has."""
    for table in preferred:
        fallback = fallback.join(table.select(F.col(date).alias("_taken")).distinct(), F.col(date) == F.col("_taken"), "left_anti")
    return fallback


def on_calendar(rows: DataFrame, calendar: DataFrame, date: str) -> DataFrame:
    return rows.join(calendar.select(F.col(date).alias("_open")).distinct(), F.col(date) == F.col("_open"), "left_semi")


def intervals(rows: DataFrame, star: str = "star") -> DataFrame:
    """``star_low``, ``star_high`` filled from the point where missing, and ``target_mid``; what is no number is null."""
    rows = rows.withColumns({c: F.col(c).try_cast("double") for c in (star, "star_low", "star_high")})
    low, high = F.coalesce("star_low", star), F.coalesce("star_high", star)
    rows = rows.withColumns({"star_low": low, "star_high": high})
    return rows.withColumn("target_mid", F.coalesce(F.col(star), (F.col("star_low") + F.col("star_high")) / 2))


def in_order(rows: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """The columns in their fixed order, null where ``rows`` lacks one, by date."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]).orderBy(date)


def weighted(rows: DataFrame, status: str, weights: dict[str, tuple[float, float]]) -> DataFrame:
    """``base_weight``, ``confidence`` and their product as ``weight``; an unknown status is an error."""
    unknown = rows.where(~F.col(status).isin(*weights) | F.col(status).isNull()).limit(1).collect()
    if unknown:
        raise ValueError(f"unknown status {unknown[0][status]!r}")
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v[i]))]), F.col(status))
    return rows.withColumns({"base_weight": pick(0), "confidence": pick(1)}).withColumn("weight", F.col("base_weight") * F.col("confidence"))


def interval_conflicts(old: DataFrame, new: DataFrame, date: str) -> DataFrame:
    """Dates where the new point is outside the old interval or the bounds or status changed."""
    o, n = old.alias("o"), new.alias("n")
    outside = (F.col("n.star") < F.col("o.star_low")) | (F.col("n.star") > F.col("o.star_high"))
    changed = [F.coalesce(F.col(f"n.{c}") != F.col(f"o.{c}"), F.lit(True)) for c in ("star_low", "star_high", "status")]
    return o.join(n, F.col(f"o.{date}") == F.col(f"n.{date}")).where(F.coalesce(outside, F.lit(False)) | changed[0] | changed[1] | changed[2]).select(
        F.col(f"o.{date}").alias(date), F.col("o.status").alias("old_status"), F.col("n.status").alias("new_status")
    )


def year_status_counts(rows: DataFrame, date: str, status: str, values: list[str]) -> DataFrame:
    return rows.groupBy(F.year(date).alias("year")).pivot(status, values).count().na.fill(0)


#: What a review reason stands for, and the confidence in it.
REVIEWED = {"approximate_range": ("range", 0.75), "near_threshold_only": ("threshold", 0.50)}
#: Weights of the price-only study by status; others weigh nothing.
STUDY_WEIGHTS = {"exact": 1.0, "range": 0.55, "approx": 0.50, "derived": 0.25}


def of_map(values: dict[str, object], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), c)


def review_labels(queue: DataFrame, base_weights: dict[str, float], *, strict: bool = True) -> DataFrame:
    """Interval and threshold labels of a review queue (``reason, range_low, range_high``), closed days left out.

    The weight is the status's base weight times the confidence, so 0 for a threshold whose base weight is 0. Another reason is an error
    as soon as its row is used, or with ``strict`` off left out.
    """
    rows = queue.where(~F.coalesce(F.col("reason") == "market_closed_no_new_target", F.lit(False)))
    known = F.coalesce(F.col("reason").isin(*REVIEWED), F.lit(False))
    status = of_map({k: v[0] for k, v in REVIEWED.items()}, F.col("reason"))
    if strict:
        status = F.when(known, status).otherwise(F.raise_error(F.concat(F.lit("unexpected review reason "), F.coalesce("reason", F.lit("null")))))
    else:
        rows = rows.where(known)
    rows = rows.withColumn("status", status).withColumn("confidence", of_map({k: v[1] for k, v in REVIEWED.items()}, F.col("reason")))
    rows = rows.withColumns({"star": F.lit(None).cast("double"), "star_low": F.col("range_low").try_cast("double"), "star_high": F.col("range_high").try_cast("double")})
    return intervals(rows).withColumn("weight", of_map(base_weights, F.col("status")) * F.col("confidence"))


def label_counts(labels: DataFrame, by: str = "source_priority") -> DataFrame:
    """Rows, trainable rows (weight over 0) and threshold rows by source."""
    return labels.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_if(F.col("weight") > 0).alias("trainable"), F.count_if(F.col("status") == "threshold").alias("threshold_only"))


def study_labels(labels: DataFrame) -> DataFrame:
    """Labels of the price-only study: interval from the point where missing, its middle as target, weighted by status; weight 0 goes."""
    rows = labels.withColumns({c: F.col(c).try_cast("double") for c in ("star", "star_low", "star_high")})
    rows = rows.withColumns({"star_low": F.coalesce("star_low", "star"), "star_high": F.coalesce("star_high", "star")})
    weight = F.coalesce(of_map(STUDY_WEIGHTS, F.col("status")), F.lit(0.0))
    return rows.withColumn("target_mid", (F.col("star_low") + F.col("star_high")) / 2).withColumn("weight", weight).where("weight > 0")


def target_seed(candidates: DataFrame, least: float = 0.90) -> DataFrame:
    """Conservative first targets: articles whose confident realtime candidates agree on one star, the strongest for each date and star.

    ``candidates`` has ``article_id, publish_date, title, star, context, relation, confidence``. Equal confidence goes by article and place.
    """
    sure = candidates.where((F.col("relation") == "realtime") & (F.col("confidence") >= least))
    best = F.max_by(F.struct("publish_date", "title", "confidence", "context"), F.struct("confidence", (-F.col("start")).alias("start")))
    one = sure.groupBy("article_id").agg(F.min("star").alias("star"), F.max("star").alias("_most"), best.alias("_best")).where("star = _most")
    rows = one.select(F.col("_best.publish_date").alias("date"), "star", "article_id", "_best.title", "_best.confidence", "_best.context", F.lit("seed_auto").alias("review_status"))
    place = F.struct((-F.col("confidence")).alias("c"), "article_id")
    rest = [c for c in rows.columns if c not in ("date", "star")]
    return rows.groupBy("date", "star").agg(F.min_by(F.struct(*rest), place).alias("_row")).select("date", "star", "_row.*")


def legacy_mismatches(exact: DataFrame, legacy: DataFrame, date: str = "date", tolerance: float = 1e-9) -> DataFrame:
    """Dates whose exact star differs from the legacy label's."""
    old = legacy.select(date, F.col("star").try_cast("double").alias("legacy_star"), F.col("status").alias("legacy_status"))
    return exact.join(old, date).where(F.abs(F.col("star") - F.col("legacy_star")) > tolerance)
