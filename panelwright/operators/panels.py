"""Building panels: dates and codes made alike, checked joins of sources and labels."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def local_date(value: Column, zone: str = "Asia/Shanghai") -> Column:
    """The day in ``zone`` of a date, time or text; null for what is none. A text without an offset is in UTC, the session's zone."""
    return F.to_date(F.from_utc_timestamp(F.try_to_timestamp(value.cast("string")), zone))


def padded_code(code: Column, width: int = 6) -> Column:
    """The code with zeros in front up to ``width``; longer codes stay."""
    text = code.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def code_violations(rows: DataFrame, code: str, date: str, names: dict[str, str]) -> DataFrame:
    """Codes without a name, and codes and dates that more than one row has."""
    unknown = rows.where(~F.coalesce(F.col(code).isin(*names), F.lit(False))).groupBy(F.col(code).alias("code")).count().select("code", F.lit("unknown code").alias("violation"))
    twice = rows.groupBy(code, date).count().where("count > 1").groupBy(F.col(code).alias("code")).count().select("code", F.lit("repeated date").alias("violation"))
    return unknown.unionByName(twice)


def named_series(rows: DataFrame, names: dict[str, str], *, code: str = "code", date: str = "date", name: str = "name") -> DataFrame:
    """``rows`` with local dates, padded codes and the codes' names; an unknown code or a repeated date of a code is an error."""
    rows = rows.withColumns({date: local_date(F.col(date)), code: padded_code(F.col(code))})
    bad = code_violations(rows, code, date, names).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['code']}: {r['violation']}" for r in bad))
    pick = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return rows.withColumn(name, F.element_at(pick, F.col(code)))


def prefixed(rows: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """Columns other than ``keys`` get the prefix, and underscores for dots."""
    return rows.select(*[F.col(f"`{c}`").alias(c if c in keys else prefix + c.replace(".", "_")) for c in rows.columns])


def with_target(panel: DataFrame, target: DataFrame, date: str = "date", *, how: str = "left", prefix: str = "target_") -> DataFrame:
    """``panel`` with the label of its date; a date with several labels is an error."""
    twice = target.groupBy(date).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][date]} has several labels")
    return panel.join(prefixed(target, prefix, [date]), date, how)


def refreshed(panel: DataFrame, target: DataFrame, date: str = "date", *, prefix: str = "target_") -> DataFrame:
    """``panel`` with its embedded labels replaced by fresh ones; rows without one go."""
    return with_target(panel.select(*[c for c in panel.columns if not c.startswith(prefix)]), target, date, how="inner", prefix=prefix)


def completeness(panel: DataFrame, target: DataFrame, key: str, date: str = "date", status: str = "target_status") -> DataFrame:
    """One row: labelled rows of the panel, and those expected, a row for each label's date and key."""
    parts = panel.agg(F.count(status).alias("n"), F.count_distinct(key).alias("keys")).unionByName(target.agg(F.count_distinct(date).alias("dates")), allowMissingColumns=True)
    return parts.agg(F.max("n").alias("n_rows"), (F.max("keys") * F.max("dates")).alias("expected"))


def model_rows(panel: DataFrame, target: DataFrame, key: str, date: str = "date", status: str = "target_status") -> DataFrame:
    """The labelled rows; fewer or more than a row for each label's date and key is an error."""
    n = completeness(panel, target, key, date, status).first()
    if n["n_rows"] != n["expected"]:
        raise ValueError(f"expected {n['expected']} labelled rows, found {n['n_rows']}")
    return panel.where(F.col(status).isNotNull())


def counted(seen: Observation) -> dict[str, int] | None:
    """What an observation saw; None if the optimizer left it out together with an empty table."""
    try:
        return dict(seen.get)
    except Py4JJavaError:
        return None


def write_checked(table: DataFrame, path: str, wrong: dict[str, Column], *, helpers: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``table`` without ``helpers`` to ``path`` and reads it back; an error if any count in ``wrong`` (aggregates by what they count) isn't 0.

    The counts are taken while the rows are written, so a check costs no job of its own. After an error the files stay, for a look at them.
    """
    seen = Observation()
    table.observe(seen, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in wrong.items()]).drop(*helpers).write.parquet(path)
    found = {n: v for n, v in (counted(seen) or {}).items() if v}
    if found:
        raise ValueError("; ".join(f"{n}: {v}" for n, v in found.items()))
    return table.sparkSession.read.parquet(path)


def write_series(rows: DataFrame, names: dict[str, str], path: str, *, code: str = "code", date: str = "date", name: str = "name") -> DataFrame:
    """What ``named_series`` gives, written to ``path`` and checked on the way; null dates of a code count as one."""
    rows = rows.withColumns({date: local_date(F.col(date)), code: padded_code(F.col(code))})
    pick = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    nth = F.row_number().over(Window.partitionBy(code, date).orderBy(F.lit(0)))
    marked = rows.withColumns({name: F.try_element_at(pick, F.col(code)), "_nth": nth})
    return write_checked(marked, path, {"rows of an unknown code": F.count_if(F.col(name).isNull()), "rows of a repeated date": F.count_if(F.col("_nth") > 1)}, helpers=("_nth",))


def write_model_rows(panel: DataFrame, target: DataFrame, path: str, key: str, date: str = "date", *, status: str = "status", prefix: str = "target_") -> DataFrame:
    """The rows of ``panel`` with a label of their date, written to ``path``.

    What ``with_target`` and ``model_rows`` check by jobs is counted on the way: several labels of a date, and labelled rows other than one for
    each label's date and key. Rows of a null key are no rows of a panel.
    """
    values = [c for c in target.columns if c != date]
    dates, several = Observation(), F.count_if(F.col("_labels") > 1)
    one = target.groupBy(date).agg(F.count("*").alias("_labels"), *[F.first(c).alias(c) for c in values]).observe(dates, F.count(date).alias("dates"), several.alias("several"))
    labelled = panel.join(prefixed(one, prefix, [date]), date).where(F.col(f"{prefix}{status}").isNotNull() & F.col(key).isNotNull()).drop(f"{prefix}_labels")
    first = F.row_number().over(Window.partitionBy(key).orderBy(date)) == 1
    rows = Observation()
    labelled.withColumn("_first", first).observe(rows, F.count("*").alias("rows"), F.count_if("_first").alias("keys")).drop("_first").write.parquet(path)
    got = counted(rows) or {"rows": 0, "keys": 0}
    of = counted(dates) or target.groupBy(date).agg(F.count("*").alias("_labels")).agg(F.count(date).alias("dates"), several.alias("several")).first()
    if of["several"]:
        raise ValueError(f"{of['several']} dates have several labels")
    if got["rows"] != got["keys"] * of["dates"]:
        raise ValueError(f"expected {got['keys'] * of['dates']} labelled rows, found {got['rows']}")
    return panel.sparkSession.read.parquet(path)
