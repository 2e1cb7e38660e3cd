"""Backward as-of joins, exact matches allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators import ranges
from panelwright.sources import io


def asof_by_key(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, *, tie: list[str], values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the latest ``right`` row of its key at or before its time.

    One shuffle: both sides are put together and the last right row is carried forward.
    Equal right times go by ``tie``, the largest last. Right rows with a null time or key are left out;
    such left rows stay without values.
    """
    order = [F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)]
    carried = F.struct(*[F.col(c).alias(c) for c in values])
    lefts = left.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct("*").alias("_left"))
    rights = right.where(" and ".join(f"{c} is not null" for c in [*keys, right_time]))
    rights = rights.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(right_time).alias("_time"), F.lit(0).alias("_side"), carried.alias("_right"), *order)
    both = lefts.unionByName(rights, allowMissingColumns=True)
    window = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_time", "_side", *[f"_t{i}" for i in range(len(tie))])
    found = F.when(F.col("_time").isNotNull(), F.last("_right", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    joined = both.withColumn("_found", found).where("_side = 1")
    return joined.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in values])


def asof_by_date(left: DataFrame, right: DataFrame, left_date: str, right_date: str, *, tie: list[str], values: list[str]) -> DataFrame:
    """``left`` with the latest ``right`` row at or before its date, for a right side without a key.

    The match is found once for each distinct left date and joined back by that date, so the ordered
    window runs over calendar days, however many rows the left side has.
    """
    one = Window.partitionBy(right_date).orderBy(*[F.desc(c) for c in tie])
    rights = right.where(F.col(right_date).isNotNull()).withColumn("_n", F.row_number().over(one)).where("_n = 1")
    rights = rights.select(F.lit(0).alias("_all"), F.col(right_date).alias("_date"), *values)
    days = left.select(F.lit(0).alias("_all"), F.col(left_date).alias("_day")).where("_day is not null").distinct()
    match = asof_by_key(days, rights, ["_all"], "_day", "_date", tie=[], values=values).drop("_all")
    return left.join(match, F.col(left_date) == F.col("_day"), "left").drop("_day")


def asof(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, *, tie: list[str], values: list[str],
    keys: tuple[str, ...] = (), parts: int | None = None, most: int = 1_000_000,
) -> DataFrame:
    """``left`` with the ``values`` of the latest ``right`` row (of its key, if there are ``keys``) at or before its time.

    For series without a key, and for keys of any length: times are cut into ``parts`` ranges of about equal numbers
    of rows, each range of a key is a window of its own, and the last right row before a range goes into it as its first row. A range
    with more than ``most`` left rows (many of one time) is dealt to several tasks by the hash of the rows, its right rows to all of them. Both sides are shuffled once.

    Equal right times go by ``tie``, the largest last. Right rows with a null time or key are left out; such left
    rows stay without values.
    """
    spark = left.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ks = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(a) for k, a in zip(keys, ks)]
    rights = right.where(" and ".join(f"`{c}` is not null" for c in [*keys, right_time]))
    carried = F.struct(*[F.col(c).alias(c) for c in values])
    rank = F.struct(F.col("_time"), *[F.col(c) for c in tie])
    lefts = left.select(*named, ranges.number(left, left_time).alias("_time"), F.struct("*").alias("_left"), F.lit(1).alias("_side"))
    rights = rights.withColumn("_time", ranges.number(rights, right_time)).select(*named, "_time", rank.alias("_rank"), carried.alias("_right"), F.lit(0).alias("_side"))
    cuts = ranges.cuts_of(lefts.select("_time").unionByName(rights.select("_time")), F.col("_time"), parts)
    lefts, rights = (x.withColumn("_range", ranges.place(F.col("_time"), cuts)) for x in (lefts, rights))
    # A row for each range of a key: how many left rows it has, and the last right row of it and before it.
    ends = rights.groupBy(*ks, "_range").agg(F.max_by("_right", "_rank").alias("_end")).withColumn("_lefts", F.lit(0).cast("long"))
    asked = lefts.groupBy(*ks, "_range").agg(F.count("*").alias("_lefts"))
    marks = ends.unionByName(asked, allowMissingColumns=True).groupBy(*ks, "_range").agg(F.max_by("_end", F.col("_end").isNotNull()).alias("_end"), F.sum("_lefts").alias("_lefts"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*ks).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    marks = io.kept(marks.select(*ks, "_range", "_lefts", before.alias("_right")).where("_lefts > 0"))
    total = marks.agg(F.sum("_lefts")).first()[0] or 0
    most = max(most, total // 10_000)  # so at most 10,000 ranges are dealt on, and their table can be broadcast
    tasks = F.ceil(F.col("_lefts") / most)
    hot = F.broadcast(marks.where(tasks > 1).select(*[F.col(k).alias(f"{k}_h") for k in ks], F.col("_range").alias("_range_h"), tasks.alias("_tasks")))

    def dealt(rows: DataFrame, part: Column) -> DataFrame:
        on = F.col("_range") == F.col("_range_h")
        for k in ks:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}_h"))
        return rows.join(hot, on, "left").withColumn("_part", part).drop("_range_h", "_tasks", *[f"{k}_h" for k in ks])

    many = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_tasks"), F.lit(1).cast("long")) - 1))
    lefts = dealt(lefts, F.when(F.col("_tasks").isNotNull(), F.pmod(F.xxhash64(F.to_json("_left")), "_tasks")).otherwise(0).cast("long"))
    first = marks.where("_right is not null").select(*ks, "_range", "_right", F.lit(-1).alias("_side"))
    both = lefts.unionByName(dealt(rights, many), allowMissingColumns=True).unionByName(dealt(first, many), allowMissingColumns=True)
    window = Window.partitionBy(*ks, "_range", "_part").orderBy("_time", "_side", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col("_time").isNotNull(), F.last("_right", ignorenulls=True).over(window))
    joined = both.withColumn("_found", found).where("_side = 1")
    return joined.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in values])
