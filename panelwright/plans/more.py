"""Queries of historical runs, factor screens and valuation series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.operators import audit, evidence, fit, history, resolve, rolling, screen, valuation
from panelwright.plans import modelsql
from panelwright.plans.registry import DAILY, LINES, MENTIONS, articles, daily, lines, query, rounded, table
from panelwright.sources import io


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rated rows: the status decides which source they are of."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("article_id"), F.col("o_orderdate").cast("date").alias("date"), (F.lit(10) + key % 50).cast("int").alias("tenths"),
        (100 - key % 7).cast("int").alias("confidence"), "o_orderstatus", "o_orderpriority",
    )


RATED = """rated AS (SELECT o_orderkey AS article_id, CAST(o_orderdate AS DATE) AS date, CAST(10 + o_orderkey % 50 AS INTEGER) AS tenths,
  CAST(100 - o_orderkey % 7 AS INTEGER) AS confidence, o_orderstatus, o_orderpriority FROM orders)"""


@query(f"""WITH {RATED} SELECT date, article_id, tenths, confidence, CASE WHEN o_orderpriority = '1-URGENT' THEN 'verified_manual' ELSE 'seed_auto' END AS review_status FROM rated
QUALIFY row_number() OVER (PARTITION BY date ORDER BY o_orderpriority = '1-URGENT' DESC, confidence DESC, article_id) = 1""")
def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rated(spark, sf_dir)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return history.manual_over_auto(rows.where(~urgent), rows.where(urgent)).select("date", "article_id", "tenths", "confidence", "review_status")


@query(f"""WITH {MENTIONS} SELECT article_id, location, CAST(CASE k WHEN 3 THEN 13 WHEN 6 THEN 16 ELSE 11 END AS INTEGER) AS start, star, relation, confidence FROM m WHERE relation = 'generic'""")
def ambiguity_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for review."""
    return history.ambiguous(evidence.candidates(articles(spark, sf_dir))).select("article_id", "location", "start", "star", "relation", "confidence")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS article_id, CAST((10 + o_orderkey % 50) / 10.0 AS DOUBLE) AS star, NOT (o_orderkey % 12 = 5 AND o_orderkey % 10 = 0) AS is_precise
FROM orders WHERE o_orderkey % 12 IN (0, 1, 2, 3, 5, 11)""")
def precision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact observations, and whether a whole number is spelt as one."""
    rows = evidence.observed(articles(spark, sf_dir), ["article_id"])
    return rows.select("article_id", "star", history.is_precise(F.col("star"), F.col("evidence")).alias("is_precise"))


@query("""SELECT CASE WHEN o_orderkey % 12 = 10 THEN 'market_closed_no_new_target' ELSE 'no_exact_text_evidence' END AS reason, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS articles
FROM orders WHERE o_orderkey % 12 IN (4, 6, 7, 9, 10) GROUP BY 1, 2""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily articles without an exact value by reason and year, judged by sentence."""
    rows = articles(spark, sf_dir).where(evidence.is_daily(F.col("title")))
    rows = rows.where(evidence.observation(F.col("title"), F.col("text"), F.col("publish_date")).isNull())
    return rows.groupBy(history.sentence_review(F.col("text"))["reason"].alias("reason"), F.year("publish_date").alias("year")).agg(F.count("*").alias("articles"))


@query(f"""WITH {RATED} SELECT article_id, date FROM rated WHERE o_orderstatus <> 'F' AND date NOT IN (SELECT date FROM rated WHERE o_orderstatus = 'F' AND date IS NOT NULL)""")
def unsolved_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, solved = rated(spark, sf_dir), F.col("o_orderstatus") == "F"
    return history.unsolved(rows.where(~solved), rows.where(solved)).select("article_id", "date")


@query("""SELECT CAST(y AS INTEGER) AS year FROM generate_series(1990, 2002) g(y) WHERE y NOT IN (SELECT year(o_orderdate) FROM orders)""")
def missing_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.missing_years(table(spark, sf_dir, "orders"), "o_orderdate", 1990, 2002)


@query(f"""WITH {RATED}, c AS (SELECT DISTINCT date FROM rated WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
SELECT article_id, date, CASE WHEN date IN (SELECT date FROM c) THEN 'excluded_by_market_calendar_audit' ELSE 'kept' END AS review_status FROM rated""")
def closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row, kept or moved to the exclusions by a list of closed days."""
    rows = rated(spark, sf_dir).select("article_id", "date", "o_orderstatus", "o_orderpriority")
    closed = rows.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select("date").distinct().withColumn("title", F.lit("closed"))
    none = rows.select("article_id", "date").where("false")
    kept, moved = history.exclude_closed(rows, none, closed)
    return kept.select("article_id", "date", F.lit("kept").alias("review_status")).unionByName(moved.select("article_id", "date", "review_status"))


@query(f"""WITH {RATED} SELECT article_id, date, 'exact' AS status, CAST(0.7 AS DOUBLE) AS weight FROM rated WHERE o_orderpriority = '5-LOW'
AND date NOT IN (SELECT date FROM rated WHERE o_orderpriority = '1-URGENT') AND date NOT IN (SELECT date FROM rated WHERE o_orderpriority = '2-HIGH')""")
def legacy_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rated(spark, sf_dir)
    of = lambda p: rows.where(F.col("o_orderpriority") == p)
    return history.gap_fill(of("5-LOW").withColumn("status", F.lit("exact")), [of("1-URGENT"), of("2-HIGH")]).select("article_id", "date", "status", "weight")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS article_id, CASE WHEN o_orderkey % 12 = 10 THEN 'excluded_market_closed' ELSE 'kept' END AS review_status
FROM orders WHERE o_orderkey % 12 IN (4, 6, 7, 9, 10)""")
def closed_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue of daily articles, split into what stays and the closed days."""
    rows = articles(spark, sf_dir).where(evidence.is_daily(F.col("title")))
    # Out of an array, so that a text is put together once and not wherever it is used.
    rows = rows.select("article_id", F.inline(F.array(F.struct("title", "text", "publish_date"))))
    rows = rows.where(evidence.observation(F.col("title"), F.col("text"), F.col("publish_date")).isNull())
    # Kept, so that both parts are read from what was judged once.
    queue, closed = history.closed_market(io.kept(rows.select("article_id", evidence.reason(F.col("text")).alias("reason"))))
    return queue.select("article_id", F.lit("kept").alias("review_status")).unionByName(closed.select("article_id", "review_status"))


@query(f"""WITH {DAILY} SELECT code, date, value, CAST(year(date) AS INTEGER) AS year FROM daily""")
def panel_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series written as Parquet by year, and read back."""
    path = io.shared_path(spark, "panel")
    io.write_panel(daily(spark, sf_dir), path, "date")
    return io.read_parts(spark, path)


@query(f"""WITH {DAILY} SELECT CAST(to_json({{'code': code, 'n_rows': count(*), 'first_date': strftime(min(date), '%Y-%m-%d'), 'last_date': strftime(max(date), '%Y-%m-%d')}}) AS VARCHAR) AS value
FROM daily GROUP BY code""")
def span_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and dates of each series as JSON, written as an audit file and read back."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    spans = audit.span(daily(spark, sf_dir), "code", "date").select("code", "n_rows", day("first_date"), day("last_date"))
    path = io.shared_path(spark, "audit")
    io.write_audit(spans, path)
    return spark.read.text(path)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as labels: the log price is the target, known to a tenth."""
    rows = lines(spark, sf_dir)
    key = {"target_mid": F.col("y"), "star": F.col("y"), "star_low": F.col("y") - 0.1, "star_high": F.col("y") + 0.1, "weight": F.col("w")}
    return rows.withColumns(key).withColumn("interaction", F.col("x") * F.col("z"))


FACTORS = {"z": "slow", "w": "rate", "interaction": "slow"}
FOLDS = [(1996, 1997, 1997), (1997, 1998, 1998)]
#: One fold for each year that has one after it.
ALL_FOLDS = [(y, y + 1, y + 1) for y in range(1996, 2001)]
#: Each line with every factor beside the base.
LONG = f"""{LINES}, long AS (SELECT year, y, w, x AS f0, unnest([{{'feature': '__base_only__', 'category': 'base', 'extra': 0.0::DOUBLE}}, {{'feature': 'z', 'category': 'slow', 'extra': z}},
  {{'feature': 'w', 'category': 'rate', 'extra': w}}, {{'feature': 'interaction', 'category': 'slow', 'extra': x * z}}], recursive := true) FROM r)"""
SCREENED = lambda folds: f"""{LONG}, t AS (SELECT s.fold || feature AS g, s.fold AS fold, year <= s.fold AS tr, long.* EXCLUDE (extra), extra AS f1 FROM long JOIN (VALUES {', '.join(f'({a})' for a, _, _ in folds)}) s(fold) ON year <= s.fold + 1),
{modelsql.stepwise('t', 2)},
each AS (SELECT fold, feature, category, {modelsql.scored()} FROM (SELECT *, p2 AS p FROM a2) WHERE NOT tr GROUP BY 1, 2, 3),
folded AS (SELECT feature, category, avg(exact_mae) AS exact_mae, avg(interval_mae) AS interval_mae, avg(within_tenth) AS within_tenth, avg(regime_accuracy) AS regime_accuracy FROM each GROUP BY 1, 2),
found AS (SELECT *, (SELECT exact_mae FROM folded WHERE category = 'base') - exact_mae AS gain FROM folded)"""  # noqa: E731


@query(f"""WITH {SCREENED(ALL_FOLDS)} SELECT feature, category, {modelsql.rounded(["exact_mae", "interval_mae", "within_tenth", "regime_accuracy", "gain"])} FROM found""")
def factor_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates beside the base factor over expanding folds up to the last year."""
    return rounded(screen.screened(labelled(spark, sf_dir), period="year", base="x", candidates=FACTORS, folds=ALL_FOLDS, base_sign=0))


@query(f"""WITH {SCREENED(FOLDS)},
chosen AS ((SELECT feature FROM found WHERE category <> 'base' AND gain > 0 ORDER BY exact_mae, interval_mae, feature LIMIT 1) UNION
  (SELECT feature FROM found WHERE category = 'slow' AND gain > 0 ORDER BY exact_mae, interval_mae, feature LIMIT 1) UNION SELECT '__base_only__'),
h AS (SELECT feature AS g, year <= 1998 AS tr, long.* EXCLUDE (extra), extra AS f1 FROM long SEMI JOIN chosen USING (feature)),
{modelsql.stepwise('h', 2).replace('a0', 'h0').replace('a1', 'h1').replace('a2', 'h2')}, s AS (SELECT feature, {modelsql.scored()} FROM (SELECT *, p2 AS p FROM h2) WHERE NOT tr GROUP BY 1)
SELECT feature, n, n_exact, {modelsql.rounded([c for c in modelsql.SCORES if c not in ("n", "n_exact")])} FROM s""")
def holdout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base alone, the best factor and the best slow factor on the years after the last fold."""
    rows = labelled(spark, sf_dir)
    found = screen.screened(rows, period="year", base="x", candidates=FACTORS, folds=FOLDS, base_sign=0)
    chosen = sorted({f for f in (screen.best_feature(found), screen.best_feature(found, ["slow"])) if f})
    tested = screen.holdout(rows, period="year", base="x", extras=chosen, split=1998, last=9999, base_sign=0)
    return rounded(fit.scores(tested, ["feature"]))


@query(f"""WITH {LINES}, g AS (SELECT year, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b FROM r GROUP BY year)
SELECT year, round(b, 6) AS slope, round(my - b * mx, 6) AS anchor FROM g""")
def yearly_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and implied level of the log price by year, unweighted."""
    rows = lines(spark, sf_dir).groupBy("year").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    return rows.select("year", F.round("b", 6).alias("slope"), F.round("a", 6).alias("anchor"))


@query("""WITH m AS (SELECT l_suppkey AS code, CAST(year(l_shipdate) AS INTEGER) AS year, l_extendedprice AS c, l_extendedprice * (l_discount - 0.035) AS p FROM lineitem),
e AS (SELECT *, CASE WHEN p <> 0 THEN c / p END AS pe FROM m)
SELECT code, year, count(pe) AS members, round(sum(c) / nullif(sum(p), 0), 4) AS cap_weighted, round(count(pe) / nullif(sum(p / c) FILTER (WHERE p <> 0), 0), 4) AS harmonic,
  round(sum(c) FILTER (WHERE p > 0) / sum(p) FILTER (WHERE p > 0), 4) AS positive_weighted, round(avg(pe) FILTER (WHERE pe > 0), 4) AS positive_mean, round(median(pe), 4) AS median_pe FROM e GROUP BY 1, 2""")
def index_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as indices of their lines of a year."""
    price = F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("year"), price.alias("c"), (price * (F.col("l_discount") - 0.035)).alias("p"))
    found = valuation.index_valuation(rows, ["code", "year"], "c", "p")
    return found.select("code", "year", "members", *[F.round(c, 4).alias(c) for c in found.columns[3:]])


@query(f"""WITH {DAILY}, w AS (SELECT *, count(value) OVER r AS n, quantile_cont(value, 0.2) OVER r AS a, quantile_cont(value, 0.5) OVER r AS b, quantile_cont(value, 0.8) OVER r AS c,
  avg(value) OVER r AS m, lag(value) OVER (PARTITION BY code ORDER BY date) AS v FROM daily WINDOW r AS (PARTITION BY code ORDER BY date ROWS BETWEEN 239 PRECEDING AND CURRENT ROW))
SELECT code, date, CASE WHEN n >= 120 THEN round(a, 3) END AS low, CASE WHEN n >= 120 THEN round(b, 3) END AS mid, CASE WHEN n >= 120 THEN round(c, 3) END AS high,
  round(value / m - 1, 6) AS from_mean, round(ln(value / v), 6) AS log_change FROM w""")
def trailing_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = rolling.last_rows("code", "date", 240)
    rows = daily(spark, sf_dir).select(
        "code", "date", valuation.bands("value", over, 120).alias("b"), (F.col("value") / F.avg("value").over(over) - 1).alias("m"),
        F.ln(F.col("value") / F.lag("value").over(Window.partitionBy("code").orderBy("date"))).alias("l"),
    )
    parts = [F.round(F.col("b")[i], 3).alias(n) for i, n in enumerate(("low", "mid", "high"))]
    return rows.select("code", "date", *parts, F.round("m", 6).alias("from_mean"), F.round("l", 6).alias("log_change"))


@query(f"""WITH {DAILY}, t AS (SELECT code, date, round(sum(value) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 2) AS turnover FROM daily),
w AS (SELECT *, list(turnover) OVER (PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL 3 YEAR PRECEDING AND CURRENT ROW) AS vs FROM t)
SELECT code, date, turnover, round((len(list_filter(vs, lambda x: x < turnover)) + 0.5 * len(list_filter(vs, lambda x: x = turnover))) / len(vs), 6) AS percentile_3y FROM w""")
def turnover_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily(spark, sf_dir).select("code", "date", F.round(F.sum("value").over(rolling.last_rows("code", "date", 20)), 2).alias("turnover"))
    return rows.select("code", "date", "turnover", F.round(rolling.mid_rank("turnover", rolling.calendar_values("turnover", "code", "date", 3)), 6).alias("percentile_3y"))


@query("""WITH f AS (SELECT o_custkey, o_orderpriority AS code, CAST(o_orderdate AS DATE) AS date, o_totalprice AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1),
d AS (SELECT code, date, count(*) AS n, sum(s) AS s FROM f GROUP BY 1, 2)
SELECT code, date, CAST(sum(n) OVER a AS BIGINT) AS count_30, CAST(sum(n) OVER b AS BIGINT) AS count_90, CAST(sum(n) OVER c AS BIGINT) AS count_180,
  round(sum(s) OVER a, 2) AS scale_30, round(sum(s) OVER b, 2) AS scale_90, round(sum(s) OVER c, 2) AS scale_180
FROM d WINDOW a AS (PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW), c AS (PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL 179 DAY PRECEDING AND CURRENT ROW)""")
def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as parents and their first order as the launch, by priority."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("code"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("s"))
    first = valuation.first_of_parent(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).withColumn("date", F.col("o_orderdate").cast("date"))
    found = valuation.launches(first, ["code"], "date", "s", (30, 90, 180))
    return found.select(*[F.round(c, 2).alias(c) if c.startswith("scale") else c for c in found.columns])


@query("""WITH d AS (SELECT o_orderpriority AS code, CAST(o_orderdate AS DATE) AS date, count(*) AS n, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2),
i AS (SELECT code, date, (n - lag(n) OVER (PARTITION BY code ORDER BY date)) * p AS v FROM d)
SELECT code, date, round(v, 4) AS inflow_1, CASE WHEN count(v) OVER a >= 3 THEN round(sum(v) OVER a, 4) END AS inflow_5, CASE WHEN count(v) OVER b >= 10 THEN round(sum(v) OVER b, 4) END AS inflow_20
FROM i WINDOW a AS (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def net_inflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order counts as shares at the mean order value."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("code"), F.col("o_orderdate").cast("date").alias("date"))
    rows = rows.agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("p")).select("code", "date", valuation.inflow("n", "p", "code", "date").alias("v"))
    total = lambda n, least: F.round(rolling.rolling("v", rolling.last_rows("code", "date", n), least, "sum"), 4)
    return rows.select("code", "date", F.round("v", 4).alias("inflow_1"), total(5, 3).alias("inflow_5"), total(20, 10).alias("inflow_20"))


@query("""WITH m AS (SELECT l_suppkey AS code, last_day(CAST(l_shipdate AS DATE)) AS date, round(sum(l_extendedprice) / sum(l_quantity), 6) AS v FROM lineitem GROUP BY 1, 2),
w AS (SELECT date, v, list(v) OVER (PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL 5 YEAR PRECEDING AND CURRENT ROW) AS vs FROM m),
k AS (SELECT date, (len(list_filter(vs, lambda x: x < v)) + 0.5 * len(list_filter(vs, lambda x: x = v))) / len(vs) AS rank FROM w)
SELECT date, count(rank) AS members, round(avg(CASE WHEN rank < 0.2 THEN 1.0 ELSE 0.0 END), 6) AS share_below FROM k GROUP BY date""")
def breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' monthly price levels against their own five years."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.last_day(F.col("l_shipdate").cast("date")).alias("date"))
    rows = rows.agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("v"))
    return valuation.breadth(rows, "code", "date", "v", 5).withColumn("share_below", F.round("share_below", 6))


@query(f"""WITH {LINES}, t AS (SELECT s.fold AS g, year <= s.fold AS tr, y, w, x AS f0, z AS f1, w AS f2, x * z AS f3 FROM r JOIN generate_series(1996, 2000) s(fold) ON year <= s.fold + 1),
{modelsql.stepwise('t', 4)},
l AS (SELECT g, y, w, unnest([{{'k': 1, 'p': p1}}, {{'k': 2, 'p': p2}}, {{'k': 3, 'p': p3}}, {{'k': 4, 'p': p4}}], recursive := true) FROM a4 WHERE NOT tr),
s AS (SELECT g, k, {modelsql.scored()} FROM l GROUP BY 1, 2)
SELECT CAST(g AS INTEGER) AS fold, CAST(k AS INTEGER) AS n_factors, n, n_exact, {modelsql.rounded([c for c in modelsql.SCORES if c not in ("n", "n_exact")])} FROM s""")
def nested_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence of models, each with a factor more, fitted up to each fold and scored on the next year."""
    rows = labelled(spark, sf_dir)
    folds = spark.range(1996, 2001).select(F.col("id").cast("int").alias("fold"))
    features = ["x", "z", "w", "interaction"]
    # Sums of all features once; each model solves a leading part of them.
    by_year = fit.moments(rows, ["year"], features, "target_mid", "weight")
    sums = by_year.join(F.broadcast(folds), F.col("year") <= F.col("fold")).groupBy("fold").agg(*[F.sum(c).alias(c) for c in by_year.columns[1:]])
    tests = rows.withColumn("fold", F.col("year") - 1)
    out = None
    for k in range(1, len(features) + 1):
        last = len(features)
        names = {f"s{last}": f"s{k}", f"p{last}_{last}": f"p{k}_{k}"} | {f"p{i}_{last}": f"p{i}_{k}" for i in range(k)}
        part = sums.select("fold", "n", "sw", *[f"s{i}" for i in range(k)], *[f"p{i}_{j}" for i in range(k) for j in range(i, k)], *[F.col(a).alias(b) for a, b in names.items()])
        model = fit.fitted(part, ["fold"], features[:k]).drop("n")
        scored = tests.join(F.broadcast(model), "fold").withColumn("prediction", fit.predicted(features[:k]))
        one = fit.scores(scored, ["fold"]).withColumn("n_factors", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


EVERY = """obs AS (SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' ' || o_orderpriority AS day, CAST(o_orderkey % 3 AS DOUBLE) / 2 + 3 AS star,
  1.0 - (o_orderkey % 7) / 100.0 AS confidence FROM orders)"""


def every_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an observation; ``day`` is its date and priority."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.concat_ws(" ", F.col("o_orderdate").cast("date").cast("string"), "o_orderpriority").alias("day"),
        ((key % 3).cast("double") / 2 + 3).alias("star"), (1.0 - (key % 7) / 100.0).alias("confidence"),
    )


@query(f"""WITH {EVERY}, g AS (SELECT *, min(star) OVER (PARTITION BY day) = max(star) OVER (PARTITION BY day) AS agree,
  row_number() OVER (PARTITION BY day ORDER BY id % 7, id) AS k FROM obs) SELECT day, star, id FROM g WHERE agree AND k = 1""")
def unanimous_targets_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unanimous(every_observed(spark, sf_dir), "day", "star", [F.desc("confidence"), F.asc("id")]).select("day", "star", "id")


@query(f"""WITH {EVERY} SELECT day, array_to_string(list_sort(list(DISTINCT CAST(star AS VARCHAR))), '|') AS values,
  array_to_string(list_sort(list(DISTINCT CAST(id AS VARCHAR))), '|') AS ids FROM obs GROUP BY day HAVING count(DISTINCT star) > 1""")
def same_day_conflicts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.conflicts(every_observed(spark, sf_dir), "day", "star", "id")


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS s FROM orders),
u AS (SELECT date, CASE WHEN bool_or(s = 'F') THEN 'direct' WHEN bool_or(s = 'O') THEN 'range' ELSE 'fallback' END AS status FROM d WHERE s IN ('F', 'O', 'P') GROUP BY 1)
SELECT CAST(year(date) AS INTEGER) AS year, count(*) FILTER (WHERE status = 'direct') AS direct, count(*) FILTER (WHERE status = 'range') AS range,
  count(*) FILTER (WHERE status = 'fallback') AS fallback FROM u WHERE date IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem) GROUP BY 1""")
def unified_by_year_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``unified_by_year`` over the orders of every priority."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_orderstatus").distinct()
    source = lambda s, name: days.where(F.col("o_orderstatus") == s).select("date", F.lit(name).alias("status"))
    direct = source("F", "direct")
    ranged = resolve.overlay([direct], source("O", "range"), "date")
    rest = resolve.overlay([direct, ranged], source("P", "fallback"), "date")
    calendar = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    rows = resolve.on_calendar(direct.unionByName(ranged).unionByName(rest), calendar, "date")
    return resolve.year_status_counts(rows, "date", "status", ["direct", "range", "fallback"])
