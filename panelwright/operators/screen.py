"""Screening single factors beside a base factor: expanding folds, gated choice, holdout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators import fit

BASE_ONLY = "__base_only__"
SCORED = ("star", "star_low", "star_high", "target_mid", "weight")


def long_rows(rows: DataFrame, period: str, base: str, candidates: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each input row and specification, with ``feature`` and ``extra``; the base alone has an extra of zero."""
    pairs = [F.struct(F.lit(BASE_ONLY).alias("feature"), F.lit(0.0).alias("extra"))]
    pairs += [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("extra")) for c in candidates]
    return rows.select(*keep, F.col(period).alias("period"), *SCORED, F.col(base).cast("double").alias("base"), F.inline(F.array(*pairs)))


def models(long: DataFrame, folds: list[tuple[int, int, int]], base_sign: int) -> DataFrame:
    """A fit for each fold (last training period, first and last test period) and feature, on all periods up to its end.

    The data are summed once by period; folds add up those sums. A base coefficient
    without ``base_sign`` is an error as soon as the model is used; 0 takes either sign.
    """
    shift = fit.centres(long, ["base", "extra", "target_mid"])
    by_period = fit.moments(long, ["period", "feature"], ["base", "extra"], "target_mid", "weight", shift)
    ends = F.inline(F.array(*[F.struct(F.lit(a).alias("fold"), F.lit(b).alias("test_from"), F.lit(c).alias("test_to")) for a, b, c in folds]))
    spread = by_period.select("*", ends).where("period <= fold")
    sums = spread.groupBy("fold", "test_from", "test_to", "feature").agg(*[F.sum(c).alias(c) for c in by_period.columns[2:]]).where("sw > 0")
    found = fit.fitted(sums, ["fold", "test_from", "test_to", "feature"], ["base", "extra"], shift=lambda _: list(shift.values()))
    if not base_sign:
        return found.withColumnRenamed("n", "n_train")
    right = F.element_at("coefs", 1) * base_sign > 0
    return found.withColumn("coefs", F.when(right, F.col("coefs")).otherwise(F.raise_error(F.concat(F.lit("wrong sign of the base coefficient with "), F.col("feature"))))).withColumnRenamed("n", "n_train")


def predictions(long: DataFrame, found: DataFrame) -> DataFrame:
    """Test rows of every fold and feature with ``prediction`` and ``residual``; the models are one row a fold and feature."""
    m = F.broadcast(found.withColumnRenamed("feature", "_feature"))
    joined = long.join(m, (F.col("feature") == F.col("_feature")) & F.col("period").between(F.col("test_from"), F.col("test_to"))).drop("_feature")
    joined = joined.withColumn("prediction", fit.predicted(["base", "extra"]))
    return joined.withColumn("residual", F.col("target_mid") - F.col("prediction"))


def screened(
    rows: DataFrame, *, period: str, base: str, candidates: dict[str, str], folds: list[tuple[int, int, int]],
    base_sign: int = -1, least_train: int = 50, least_test: int = 20,
) -> DataFrame:
    """Mean scores of each candidate over the folds and its gain in exact error over the base alone.

    ``rows`` has ``star, star_low, star_high, target_mid, weight``. A candidate with too few complete training or
    test rows in any fold is left out.
    """
    long = long_rows(rows, period, base, list(candidates))
    scored = fit.scores(predictions(long, models(long, folds, base_sign)), ["fold", "feature", "n_train"])
    enough = scored.where((F.col("n_train") >= least_train) & (F.col("n") >= least_test))
    names = ("exact_mae", "interval_mae", "within_tenth", "regime_accuracy")
    found = enough.groupBy("feature").agg(F.count("*").alias("folds"), *[F.avg(c).alias(c) for c in names]).where(F.col("folds") == len(folds)).drop("folds")
    kinds = F.create_map(*[F.lit(x) for k, v in ({BASE_ONLY: "base"} | candidates).items() for x in (k, v)])
    # A row a feature, so one partition holds them all.
    baseline = F.max(F.when(F.col("feature") == BASE_ONLY, F.col("exact_mae"))).over(Window.partitionBy(F.lit(0)))
    return found.select("feature", F.element_at(kinds, F.col("feature")).alias("category"), *names, (baseline - F.col("exact_mae")).alias("gain"))


def best_feature(screen: DataFrame, categories: list[str] | None = None) -> str | None:
    """The candidate with the least error, optionally within categories; None unless it gains on the base."""
    rows = screen.where(F.col("feature") != BASE_ONLY)
    rows = rows if categories is None else rows.where(F.col("category").isin(*categories))
    best = rows.orderBy("exact_mae", "interval_mae", "feature").limit(1).collect()
    return best[0]["feature"] if best and best[0]["gain"] > 0 else None


def holdout(rows: DataFrame, *, period: str, base: str, extras: list[str], split: int, last: int, base_sign: int = -1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows after ``split`` with each specification's prediction and residual, fitted on the rows up to it."""
    long = long_rows(rows, period, base, extras, keep)
    return predictions(long, models(long, [(split, split + 1, last)], base_sign))


def grid(
    rows: DataFrame, *, key: str, period: str, specs: dict[str, list[str]], signs: list[int], folds: list[tuple[int, int]],
) -> DataFrame:
    """Mean scores over expanding folds (last training period, test period) of every key and specification, best first.

    A specification is a list of features with ``signs``; rows with a null in its features are left out for it alone. The data are
    summed once, by key, period and which features are null; a specification reads its part of the products, folds add up periods, and fits are sign-constrained.
    Test rows aren't multiplied either: each meets all models of its key at once.
    """
    width = len(signs)
    features = sorted({f for chosen in specs.values() for f in chosen})
    shift = fit.centres(rows, [*features, "target_mid"])
    cube = fit.gram(rows.withColumnsRenamed({key: "key", period: "period"}), ["key", "period"], features, "target_mid", "weight", shift)
    by_period = fit.sub_moments(cube, ["key", "period"], features, specs)
    ends = F.inline(F.array(*[F.struct(F.lit(a).alias("fold"), F.lit(b).alias("test")) for a, b in folds]))
    sums = by_period.select("*", ends).where("period <= fold").groupBy("key", "spec", "fold", "test")
    sums = sums.agg(*[F.sum(c).alias(c) for c in by_period.columns if c not in ("key", "period", "spec")]).where("sw > 0")
    of = lambda row: [shift[f] for f in (*specs[row["spec"]], "target_mid")]
    models = fit.fitted(sums, ["key", "spec", "fold", "test"], [f"f{i}" for i in range(width)], signs, of)
    # A row for each key and test period has all its models, so a data row is joined once and scored under each.
    packed = models.groupBy(F.col("key").alias("_key"), F.col("test").alias("_test")).agg(F.map_from_entries(F.collect_list(F.struct("spec", F.struct("intercept", "coefs")))).alias("_models"))
    tested = rows.join(packed, (F.col(key) == F.col("_key")) & (F.col(period) == F.col("_test")))
    names = ("exact_mae", "interval_mae", "within_tenth", "regime_accuracy")
    predicted, sums = {}, []
    for i, (name, chosen) in enumerate(specs.items()):
        model = F.col("_models")[name]
        p = model["intercept"]
        for k, f in enumerate(chosen):
            p = p + model["coefs"][k] * F.col(f).cast("double")
        predicted[f"_p{i}"] = p
        found = fit.measures(F.col(f"_p{i}"), *[F.col(c) for c in ("star", "star_low", "star_high", "weight")])
        sums += [found[n].alias(f"{n}_{i}") for n in names] + [found["n"].alias(f"n_{i}")]
    each = tested.withColumns(predicted).groupBy("_key", "_test").agg(*sums)
    rows_of = F.inline(F.array(*[F.struct(F.lit(s).alias("spec"), *[F.col(f"{n}_{i}").alias(n) for n in (*names, "n")]) for i, s in enumerate(specs)]))
    scored = each.select(F.col("_key").alias("key"), rows_of).where("n > 0")
    return scored.groupBy("key", "spec").agg(*[F.avg(c).alias(c) for c in names]).orderBy("exact_mae", "interval_mae", "key", "spec")


def refitted(rows: DataFrame, *, key: str, period: str, chosen: str, models: dict[str, tuple[list[str], list[int]]], split: int) -> DataFrame:
    """Scores by ``model`` on the rows of the key ``chosen`` after ``split`` of sign-constrained fits on its rows up to it.

    ``models`` gives the features and signs of each. A row counts for a model if it has all its features.
    """
    own = rows.where(F.col(key) == chosen)
    out = None
    for name, (features, signs) in models.items():
        train = own.where(F.col(period) <= split)
        shift = fit.centres(train, [*features, "target_mid"])
        sums = fit.moments(train, [], features, "target_mid", "weight", shift).where("sw > 0")
        model = fit.fitted(sums, [], features, signs, lambda _, shift=shift: list(shift.values())).select("intercept", "coefs")
        tested = own.where(F.col(period) > split).join(F.broadcast(model))  # one row
        one = fit.scores(tested.withColumn("prediction", fit.predicted(features)), []).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def best_spec(table: DataFrame) -> tuple[str, str] | None:
    """Key and specification of the first row of a grid; None if it is empty."""
    first = table.select("key", "spec").head(1)
    return (first[0]["key"], first[0]["spec"]) if first else None


def model_table(rows: DataFrame, *, period: str, features: list[str], isotonic: list[str], split: int, least_train: int = 100) -> DataFrame:
    """Scores after ``split`` of a weighted line on each feature and, for ``isotonic`` ones, of a decreasing isotonic fit, best first.

    A feature with fewer than ``least_train`` complete training rows is left out. An isotonic fit pools equal values, is
    read off linearly between its steps and held at its ends.
    """
    train, test = rows.where(F.col(period) <= split), rows.where(F.col(period) > split)
    weighed = F.col("weight").isNotNull() & F.col("target_mid").isNotNull()
    enough = train.agg(*[F.count_if(F.col(f).isNotNull() & weighed).alias(f) for f in features]).first()
    features = [f for f in features if enough[f] >= least_train]
    long = lambda df: df.select(*SCORED, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))
    lines = fit.fitted(fit.moments(long(train), ["feature"], ["x"], "target_mid", "weight"), ["feature"], ["x"]).select(F.col("feature").alias("_feature"), "intercept", "coefs")
    joined = long(test).join(F.broadcast(lines), F.col("feature") == F.col("_feature")).withColumn("prediction", fit.predicted(["x"]))
    found = fit.scores(joined, ["feature"]).select(F.concat(F.lit("linear:"), "feature").alias("model"), "n", "interval_mae", "exact_mae", "exact_rmse", "within_tenth")
    some = [f for f in features if f in isotonic]
    if some:
        apart = lambda df: long(df).where(F.col("feature").isin(*some))
        curve = fit.isotonic(apart(train), ["feature"], "x", "target_mid", "weight")
        one = fit.scores(fit.on_curve(apart(test.where(weighed)), curve, ["feature"], "x"), ["feature"]).withColumn("model", F.concat(F.lit("isotonic:"), "feature"))
        found = found.unionByName(one.select(*found.columns))
    return found.orderBy("exact_mae", "interval_mae", "model")
