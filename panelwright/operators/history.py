"""Historical runs: manual overrides, review by sentence, closed days, gap fills and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators import evidence

# Cues that a sentence speaks of the day itself, or of another one.
CURRENT_RANGE_CUES = ("今天", "今日", "目前", "当前", "收盘", "还在", "回到", "回到了", "重回", "边界")
NONCURRENT_RANGE_CUES = ("上周", "上个月", "昨天", "昨日", "此前", "之前", "当时", "曾经", "历史", "如果", "假如", "才能", "才回到")
AMBIGUOUS_RELATIONS = ("generic", "historical", "range_or_rule")


def manual_over_auto(auto: DataFrame, manual: DataFrame, *, date: str = "date", tie: str = "article_id") -> DataFrame:
    """One row a date: verified rows before automatic ones, then the most confident, then the smallest ``tie``.

    Columns that one side lacks are null. A null confidence comes last; null dates are one group.
    """
    status = F.col("review_status") if "review_status" in auto.columns else F.lit("seed_auto")
    rows = auto.withColumn("review_status", status).unionByName(manual.withColumn("review_status", F.lit("verified_manual")), allowMissingColumns=True)
    level = F.when(F.col("review_status") == "verified_manual", 0).when(F.col("review_status") == "seed_auto", 1).otherwise(2)
    place = F.struct(level, F.coalesce(-F.col("confidence"), F.lit(float("inf"))), F.col(tie))
    return rows.groupBy(date).agg(F.min_by(F.struct(*[c for c in rows.columns if c != date]), place).alias("_row")).select(date, "_row.*")


def ambiguous(candidates: DataFrame, least: float = 0.9) -> DataFrame:
    """Candidates for people to look at: an unclear relation, or a confidence under ``least``."""
    return candidates.where(F.col("relation").isin(*AMBIGUOUS_RELATIONS) | (F.col("confidence") < least))


def is_precise(star: Column, found: Column) -> Column:
    """False for a whole number that the evidence doesn't spell with ``.0``: such wording names a regime."""
    whole = F.round(star)
    spelt = F.regexp(found, F.concat(F.lit(r"(?U)(?<!\d)"), whole.cast("int").cast("string"), F.lit(r"\.0\s*星")))
    return (F.abs(star - whole) > 1e-9) | F.coalesce(spelt, F.lit(False))


def sentence_review(text: Column, vocabulary: evidence.Vocabulary = evidence.Vocabulary()) -> Column:
    """Why an opening has no exact value: (reason, range_low, range_high, reference_star, evidence).

    A closed market counts first. Then the first sentence that speaks of the day itself and holds a range
    or a near threshold; the range wins within a sentence.
    """
    head = evidence.opening(text, vocabulary)
    closed = F.regexp_extract(head, f"(?U){evidence.MARKET_CLOSED}", 0)
    ranged, near = f"(?U){evidence.APPROX_RANGE}", f"(?U){evidence.NEAR_THRESHOLD}"
    telling = F.filter(
        F.transform(F.split(head, r"(?<=[。！？\n])"), evidence.squeezed),
        lambda s: ~evidence.any_of(s, NONCURRENT_RANGE_CUES) & evidence.any_of(s, CURRENT_RANGE_CUES) & (s.rlike(ranged) | s.rlike(near)),
    )
    first = F.coalesce(F.try_element_at(telling, F.lit(1)), F.lit(""))
    open_day, has_range, has_near = closed == "", first.rlike(ranged), first.rlike(near)
    low, high = (F.when(open_day & has_range, F.regexp_extract(first, ranged, i).try_cast("double")) for i in (1, 2))
    return F.struct(
        F.when(~open_day, "market_closed_no_new_target").when(has_range, "approximate_range").when(has_near, "near_threshold_only").otherwise("no_exact_text_evidence").alias("reason"),
        F.least(low, high).alias("range_low"),
        F.greatest(low, high).alias("range_high"),
        F.when(open_day & ~has_range & has_near, F.regexp_extract(first, near, 1).try_cast("double")).alias("reference_star"),
        F.when(~open_day, evidence.squeezed(closed)).when(first != "", first).otherwise(F.substring(evidence.squeezed(head), 1, 320)).alias("evidence"),
    )


def unsolved(queue: DataFrame, solved: DataFrame, date: str = "date") -> DataFrame:
    """Queued rows whose date has no exact value by now."""
    return queue.join(solved.select(date).distinct(), date, "left_anti")


def missing_years(rows: DataFrame, date: str, first: int, last: int) -> DataFrame:
    """Years of ``first`` to ``last`` that no row falls in."""
    expected = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return expected.join(rows.select(F.year(date).alias("year")).distinct(), "year", "left_anti")


def closed_market(queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue without its closed days, and those as exclusions."""
    closed = F.coalesce(F.col("reason") == "market_closed_no_new_target", F.lit(False))
    return queue.where(~closed), queue.where(closed).withColumn("review_status", F.lit("excluded_market_closed"))


def exclude_closed(direct: DataFrame, exclusions: DataFrame, closed: DataFrame, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Moves rows on known closed dates (``date, title``) to the exclusions; a listed date without a row is an error."""
    absent = closed.join(direct.select(date).distinct(), date, "left_anti").limit(1).collect()
    if absent:
        raise ValueError(f"known closed date {absent[0][date]} has no row")
    moved = direct.drop("title").join(closed.select(date, "title"), date).withColumns(
        {"reason": F.lit("market_closed_no_new_target"), "review_status": F.lit("excluded_by_market_calendar_audit")}
    )
    moved = moved.select(*[c for c in moved.columns if c in {*exclusions.columns, date, "title", "reason", "review_status"}])
    return direct.join(closed.select(date), date, "left_anti"), exclusions.unionByName(moved, allowMissingColumns=True)


def gap_fill(legacy: DataFrame, covered: list[DataFrame], *, date: str = "date", weight: float = 0.7) -> DataFrame:
    """Exact legacy rows on dates that none of ``covered`` has, at a fixed weight; any other status there is an error."""
    for table in covered:
        legacy = legacy.join(table.select(date).distinct(), date, "left_anti")
    exact = F.coalesce(F.col("status") == "exact", F.lit(False))
    status = F.when(exact, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("legacy row is not exact on "), F.coalesce(F.col(date).cast("string"), F.lit("null")))))
    fixed = {"status": status, "weight": F.lit(weight), "confidence": F.lit(weight), "source_priority": F.lit("legacy_only_gap_fill")}
    return legacy.withColumns(fixed)


def in_years(articles: DataFrame, date: str, first: int, last: int) -> DataFrame:
    """Articles dated in ``first`` to ``last``; what is no date goes."""
    day = F.try_to_date(F.col(date).cast("string"))
    return articles.withColumn(date, day).where(F.year(date).between(first, last))


def year_counts(articles: DataFrame, date: str) -> DataFrame:
    return articles.groupBy(F.year(date).alias("year")).agg(F.count("*").alias("articles"))
