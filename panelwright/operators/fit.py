"""Weighted and sign-constrained fits: sums in Spark, p x p solves on the summed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType

from panelwright.operators import asof, ranges


def centres(rows: DataFrame, cols: list[str]) -> dict[str, float]:
    """Means of columns, 0 without values: what ``moments`` and ``gram`` may subtract, so that columns far from 0 keep their digits in the products."""
    found = rows.agg(*[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(str(i)) for i, c in enumerate(cols)]).first()
    return dict(zip(cols, found))


def moments(rows: DataFrame, by: list[str], features: list[str], target: str, weight: str, shift: dict[str, float] | None = None) -> DataFrame:
    """One row for each group: ``n``, ``sw`` and the weighted sums and products of features and target, less their ``shift``; rows with a null are left out."""
    cols = [*features, target]
    full = rows.where(" and ".join(f"{c} is not null" for c in [*cols, weight]))
    w = F.col(weight)
    less = [F.col(c) - F.lit(shift[c]) if shift else F.col(c) for c in cols]
    sums = [F.sum(w * c).alias(f"s{i}") for i, c in enumerate(less)]
    products = [F.sum(w * a * b).alias(f"p{i}_{j}") for i, a in enumerate(less) for j, b in enumerate(less) if i <= j]
    return full.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("sw"), *sums, *products)


def non_negative(gram: np.ndarray, moment: np.ndarray, scale: float) -> np.ndarray:
    """The ``b >= 0`` of least ``b'Gb - 2b'm``, by active sets: the coefficient that gains most comes in, those that turn negative go out.

    Needs only sums of products, and a few solves for any number of features. ``scale`` is the target's sum of squares, by which gains are judged.
    """
    p = len(moment)
    size = np.sqrt(np.maximum(np.diag(gram), 0) * max(scale, 0.0)) * 1e-11
    b, used = np.zeros(p), np.zeros(p, bool)
    for _ in range(10 * p + 10):
        gain = np.where(used, -np.inf, moment - gram @ b)
        best = int(np.argmax(gain - size)) if p else 0
        if not p or gain[best] <= size[best]:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            free = np.zeros(p)
            free[at] = np.linalg.pinv(gram[np.ix_(at, at)], hermitian=True) @ moment[at]
            low = at[free[at] <= 0]
            if not len(low):
                break
            step = min(b[i] / (b[i] - free[i]) if b[i] > free[i] else 0.0 for i in low)
            b = b + step * (free - b)
            used[at[b[at] <= 1e-15 * max(1.0, np.abs(b).max())]] = False
            b[~used] = 0.0
            if not used.any():
                free = b
                break
        b = free
    return b


def solve(row: dict, p: int, signs: list[int] | None = None) -> tuple[float, list[float], float]:
    """Intercept, coefficients and weighted SSE from one row of moments.

    With ``signs`` every coefficient has its sign or is zero. Products are centred first; a singular system has its
    least-norm solution.
    """
    sw = row["sw"]
    mean = np.array([row[f"s{i}"] for i in range(p + 1)]) / sw
    cov = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)]) - sw * np.outer(mean, mean)
    if signs:
        turn = np.array(signs, float)
        beta = turn * non_negative(cov[:p, :p] * np.outer(turn, turn), cov[:p, p] * turn, cov[p, p])
    else:
        beta = np.linalg.pinv(cov[:p, :p], hermitian=True) @ cov[:p, p]
    sse = float(cov[p, p] - 2 * beta @ cov[:p, p] + beta @ cov[:p, :p] @ beta)
    return float(mean[p] - beta @ mean[:p]), beta.tolist(), max(sse, 0.0)


def gram(rows: DataFrame, by: list[str], features: list[str], target: str, weight: str, shift: dict[str, float] | None = None) -> DataFrame:
    """Sums and pairwise products of all features and the target in one pass, by group and by which features are null.

    ``mask`` has a ``1`` for each null feature; ``n``, ``sw``, ``s<i>`` and ``p<i>_<j>`` are as in ``moments``. Any choice of features has its
    moments in the rows whose mask is ``0`` for all of them.
    """
    full = rows.where(f"`{target}` is not null and `{weight}` is not null")
    mask = F.concat(*[F.when(F.col(f).isNull(), "1").otherwise("0") for f in features]).alias("mask")
    less = lambda c: F.col(c).cast("double") - F.lit(shift[c] if shift else 0.0)
    w, cols = F.col(weight), [F.coalesce(less(f), F.lit(0.0)) for f in features] + [less(target)]
    sums = [F.sum(w * c).alias(f"s{i}") for i, c in enumerate(cols)]
    products = [F.sum(w * a * b).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return full.groupBy(*by, mask).agg(F.count("*").alias("n"), F.sum(w).alias("sw"), *sums, *products)


def sub_moments(cube: DataFrame, by: list[str], features: list[str], specs: dict[str, list[str]]) -> DataFrame:
    """Moments of every specification (``spec``; all have as many features) from ``gram``'s rows: each reads its own part of the products."""
    of = {f: i for i, f in enumerate(features)}
    structs = []
    for name, chosen in specs.items():
        at = [*(of[f] for f in chosen), len(features)]
        there = F.lit(True)
        for i in at[:-1]:
            there = there & (F.substring("mask", i + 1, 1) == "0")
        sums = [F.col(f"s{i}").alias(f"s{k}") for k, i in enumerate(at)]
        products = [F.col(f"p{min(at[k], at[m])}_{max(at[k], at[m])}").alias(f"p{k}_{m}") for k in range(len(at)) for m in range(k, len(at))]
        structs.append(F.struct(F.lit(name).alias("spec"), there.alias("_there"), *sums, *products))
    return cube.select(*by, "n", "sw", F.inline(F.array(*structs))).where("_there").drop("_there")


def fitted(
    sums: DataFrame, by: list[str], features: list[str], signs: list[int] | None = None, shift: Callable[[dict], list[float]] | None = None,
) -> DataFrame:
    """A model for each row of moments: ``intercept double, coefs array<double>, sse double``.

    ``shift`` gives what was subtracted from the features and the target of a row's moments; the model is of columns as they are.
    """

    def moved(row: dict) -> tuple[float, list[float], float]:
        intercept, coefs, sse = solve(row, len(features), signs)
        if shift:
            *x, y = shift(row)
            intercept += y - sum(c * v for c, v in zip(coefs, x))
        return intercept, coefs, sse

    schema = sums.select(*by, "n").schema.add("intercept", "double").add("coefs", ArrayType(DoubleType())).add("sse", "double")

    def run(batches):
        for batch in batches:
            out = [moved(r) for r in batch.to_dict("records")]
            frame = batch[[*by, "n"]].copy()
            frame["intercept"], frame["coefs"], frame["sse"] = [x[0] for x in out], pd.Series([x[1] for x in out], dtype=object, index=frame.index), [x[2] for x in out]
            yield frame

    return sums.mapInPandas(run, schema)


def predicted(features: list[str]) -> Column:
    """The prediction of a joined model row, null if a feature is."""
    total = F.col("intercept")
    for i, f in enumerate(features):
        total = total + F.element_at("coefs", i + 1) * F.col(f)
    return total


def interval_error(p: Column, low: Column, high: Column) -> Column:
    """Distance to [low, high], 0 inside; null where any of them is."""
    return F.when(p.isNotNull() & low.isNotNull() & high.isNotNull(), F.greatest(low - p, p - high, F.lit(0.0)))


def measures(p: Column, star: Column, low: Column, high: Column, weight: Column) -> dict[str, Column]:
    """Aggregates of the errors of a prediction, over the rows that have one."""
    err = interval_error(p, low, high)
    exact = F.when(star.isNotNull() & p.isNotNull(), p - star)
    return {
        "n": F.count(p),
        "n_exact": F.count(exact),
        "interval_mae": F.avg(err),
        "weighted_mae": F.try_divide(F.sum(err * weight), F.sum(F.when(err.isNotNull(), weight))),
        "hit_rate": F.avg(F.when(err.isNotNull(), (err == 0).cast("double"))),
        "exact_mae": F.avg(F.abs(exact)),
        "exact_rmse": F.sqrt(F.avg(exact * exact)),
        "within_tenth": F.avg((F.abs(exact) <= 0.1).cast("double")),
        "regime_accuracy": F.avg(F.when(exact.isNotNull(), (F.floor(p) == F.floor(star)).cast("double"))),
    }


def scores(rows: DataFrame, by: list[str], *, p: str = "prediction", star: str = "star", low: str = "star_low", high: str = "star_high", weight: str = "weight") -> DataFrame:
    """Counts, interval and exact errors, hit rate and regime accuracy by group."""
    found = measures(*[F.col(c) for c in (p, star, low, high, weight)])
    return rows.where(F.col(p).isNotNull()).groupBy(*by).agg(*[c.alias(n) for n, c in found.items()])


def largest_with_ties(rows: DataFrame, c: str, n: int) -> DataFrame:
    """Rows whose absolute value is among the ``n`` largest, ties of the last one included."""
    sized = rows.withColumn("_abs", F.abs(c)).where("_abs is not null")
    least = sized.orderBy(F.desc("_abs")).limit(n).agg(F.min("_abs")).first()[0]
    return sized.where(F.col("_abs") >= F.lit(least)).drop("_abs")


def mean_and_scale(rows: DataFrame, features: list[str], weight: str) -> DataFrame:
    """One row for each feature: weighted mean and population scale over the rows without a null; a scale of 0 is an error when used.

    The means are fetched first, so that deviations are summed and not differences of large squares.
    """
    full = rows.where(" and ".join(f"{c} is not null" for c in [*features, weight]))
    w = F.col(weight)
    means = full.agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in features]).first()
    spread = full.agg(*[F.sqrt(F.sum(w * (F.col(c) - F.lit(means[c])) ** 2) / F.sum(w)).alias(c) for c in features])
    found = spread.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(means[c]).alias("mean"), F.col(c).alias("scale")) for c in features])))
    return found.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.raise_error(F.concat(F.lit("no variance in "), F.col("feature")))))


def verdict(scores: DataFrame, core: str, baseline: str, *, model: str = "model", by: str = "exact_mae") -> DataFrame:
    """One row: whether the core model's error is under the baseline's, both errors and their ratio."""
    of = lambda m: F.max(F.when(F.col(model) == m, F.col(by)))
    both = scores.agg(of(core).alias("core_error"), of(baseline).alias("baseline_error"))
    said = F.when(F.col("core_error") < F.col("baseline_error"), "core_model_beats_baseline").otherwise("core_model_does_not_beat_baseline")
    return both.select(said.alias("verdict"), "core_error", "baseline_error", F.try_divide("core_error", "baseline_error").alias("ratio"))


def signs_hold(models: DataFrame, signs: list[int]) -> Column:
    """Whether a model's coefficients have their directions or are 0."""
    return F.forall(F.zip_with("coefs", F.array(*[F.lit(s) for s in signs]), lambda c, s: c * s >= -1e-12), lambda x: x)


def anchors(rows: DataFrame, period: str, y: str, x: str, slope: Column) -> DataFrame:
    """The level that each row implies at a slope, by period: count, mean, population spread, least and most."""
    level = F.col(y) - slope * F.col(x)
    return rows.groupBy(period).agg(
        F.count(level).alias("n"), F.avg(level).alias("anchor_mean"), F.stddev_pop(level).alias("anchor_std"), F.min(level).alias("anchor_min"), F.max(level).alias("anchor_max")
    )


def changes(rows: DataFrame, key: str, date: str, y: str, x: str, most_gap: int = 7) -> DataFrame:
    """Changes of ``y`` and ``x`` since the key's row before, over gaps of 1 to ``most_gap`` days."""
    by = Window.partitionBy(key).orderBy(date)
    since = lambda c: F.col(c) - F.lag(c).over(by)
    found = rows.select(key, date, since(y).alias("y_change"), since(x).alias("x_change"), F.datediff(F.col(date), F.lag(date).over(by)).alias("gap"))
    return found.where(F.col("gap").between(1, most_gap) & F.col("y_change").isNotNull() & F.col("x_change").isNotNull())


def change_study(pairs: DataFrame, key: str, date: str, split: int, least: float = 0.05) -> DataFrame:
    """By key: a line of ``y_change`` on ``x_change`` up to the year ``split``, its error after it, and how often a change moves against ``x``."""
    train = F.year(date) <= split
    line = pairs.where(train).groupBy(key).agg(F.count("*").alias("train_pairs"), F.regr_slope("y_change", "x_change").alias("slope"), F.regr_intercept("y_change", "x_change").alias("intercept"))
    tested = pairs.where(~train).join(line, key)
    residual = F.abs(F.col("y_change") - F.col("intercept") - F.col("slope") * F.col("x_change"))
    moved = (F.abs("y_change") >= least) & (F.abs("x_change") > 1e-12)
    against = F.when(moved, (F.signum("y_change") == -F.signum("x_change")).cast("double"))
    return tested.groupBy(key).agg(
        F.first("train_pairs").alias("train_pairs"), F.count("*").alias("holdout_pairs"), F.count_if(F.abs("y_change") >= least).alias("changed"),
        F.first("intercept").alias("intercept"), F.first("slope").alias("slope"), F.avg(residual).alias("change_mae"), F.avg(against).alias("against_share"),
    )


def pool_in(out: list[tuple[float, float, float, float]], low: float, high: float, sw: float, sy: float) -> None:
    """Adds what comes next to decreasing pools ``(from, to, weight, sum)``: a pool with a lower mean than the next one takes it in."""
    while out and out[-1][3] * sw < sy * out[-1][2]:
        low, _, before, total = out.pop()
        sw, sy = sw + before, sy + total
    out.append((low, high, sw, sy))


def pooled(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """``keep, x_from, x_to, sw, sy`` pooled within each ``by``, whose rows pass in order of ``x_from``.

    A task walks through its sorted rows, whatever number of groups they are of, and holds the pools of one.
    """
    ordered = rows.repartition(*by).sortWithinPartitions(*by, "x_from").select(*by, "x_from", "x_to", "sw", "sy")
    schema = rows.select(*keep, "x_from", "x_to", "sw", "sy").schema
    arrow = to_arrow_schema(schema)
    same = lambda v: None if v is None else "nan" if v != v else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, []
        done: list[tuple] = []

        def made() -> pa.RecordBatch:
            cols = [pa.array([k[i] for k, _ in done], f.type) if i < len(keep) else pa.array([p[i - len(keep)] for _, p in done], f.type) for i, f in enumerate(arrow)]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, schema=arrow)

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols):
                key = tuple(map(same, row[: len(by)]))
                if key != now:
                    done += [(own, p) for p in open_]
                    now, own, open_ = key, row[: len(by)], []
                pool_in(open_, *row[len(by) :])
            if done:
                yield made()
        done += [(own, p) for p in open_]
        if done:
            yield made()

    return ordered.mapInArrow(run, schema)


def isotonic(rows: DataFrame, by: list[str], x: str, y: str, weight: str, *, parts: int | None = None) -> DataFrame:
    """The decreasing weighted isotonic fit of each group as steps ``x_from, x_to, value``, all groups in one plan.

    Equal ``x`` are summed first. Violators are pooled within ranges of ``x`` and then the pools of a group are pooled: the order of pooling
    doesn't matter, so what comes together for a group is about the steps of its curve. Rows with a null, or without weight, are left out.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = rows.where(" and ".join(f"`{c}` is not null" for c in [*by, x, y, weight])).where(F.col(weight) > 0)
    level = full.groupBy(*by, F.col(x).cast("double").alias("x_from")).agg(F.sum(weight).cast("double").alias("sw"), F.sum(F.col(weight) * F.col(y)).cast("double").alias("sy"))
    level = level.select(*by, "x_from", F.col("x_from").alias("x_to"), "sw", "sy")
    ranged = level.withColumn("_range", ranges.place(F.col("x_from"), ranges.cuts_of(level, F.col("x_from"), parts)))
    once = pooled(ranged, [*by, "_range"], by)
    return pooled(once, by, by).select(*by, "x_from", "x_to", (F.col("sy") / F.col("sw")).alias("value"))


def on_curve(rows: DataFrame, curve: DataFrame, by: list[str], x: str, name: str = "prediction") -> DataFrame:
    """``rows`` with the value of their group's steps at ``x``: straight between steps, held at both ends; null without a curve or ``x``."""
    ends = curve.select(*by, F.explode(F.array(F.struct(F.col("x_from").alias("_at"), F.col("value").alias("_v")), F.struct(F.col("x_to").alias("_at"), F.col("value").alias("_v")))).alias("_e")).select(*by, "_e.*").distinct()
    after = Window.partitionBy(*by).orderBy("_at", F.desc("_v"))
    ends = ends.select("*", F.lead("_at").over(after).alias("_at2"), F.lead("_v").over(after).alias("_v2"))
    first = ends.groupBy(*by).agg(F.min_by("_v", "_at").alias("_v")).select(*by, F.lit(float("-inf")).alias("_at"), "_v", F.lit(None).cast("double").alias("_at2"), F.lit(None).cast("double").alias("_v2"))
    found = asof.asof(rows, ends.unionByName(first), x, "_at", keys=tuple(by), tie=[], values=["_at", "_v", "_at2", "_v2"])
    between = F.col("_v") + (F.col("_v2") - F.col("_v")) * (F.col(x) - F.col("_at")) / (F.col("_at2") - F.col("_at"))
    return found.withColumn(name, F.when(F.col("_at2").isNull() | (F.col("_v") == F.col("_v2")), F.col("_v")).otherwise(between)).drop("_at", "_v", "_at2", "_v2")
