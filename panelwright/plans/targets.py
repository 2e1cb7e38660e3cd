"""Queries of panels with labels, label sources, windows of whole years, and grids of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.operators import audit, evidence, fit, history, incremental, ingest, panels, resolve, rolling, screen, search, valuation
from panelwright.plans import modelsql
from panelwright.plans.more import RATED, labelled, rated
from panelwright.plans.registry import DAILY, FILES, LINES, ORACLES, PHRASE, articles, daily, files, lines, query, rounded, table
from panelwright.sources import io

NAMES = {"000001": "urgent", "000002": "high", "000003": "medium", "000004": "not specified", "000005": "low"}
CODED = f"""{DAILY}, coded AS (SELECT '00000' || substr(code, 1, 1) AS code, date, value FROM daily)"""
LABEL = """label AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST((10 + count(*) % 50) / 10.0 AS DOUBLE) AS star, 'exact' AS status FROM orders GROUP BY 1)"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series by a code of one digit."""
    return daily(spark, sf_dir).withColumn("code", F.substring("code", 1, 1))


def label(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """One label a date, from the number of its orders."""
    rows = table(spark, sf_dir, "orders").where(where).groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("n"))
    return rows.select("date", ((F.lit(10) + F.col("n") % 50) / 10.0).cast("double").alias("star"), F.lit("exact").alias("status"))


@query("""SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS local_day FROM events""")
def local_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in another time zone of times written as text."""
    return table(spark, sf_dir, "events").select("event_id", panels.local_date(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("local_day"))


@query(f"""WITH {CODED}, {LABEL} SELECT c.code, CASE c.code WHEN '000001' THEN 'urgent' WHEN '000002' THEN 'high' WHEN '000003' THEN 'medium' WHEN '000004' THEN 'not specified' ELSE 'low' END AS name,
  c.date, c.value, l.star AS target_star, l.status AS target_status FROM coded c LEFT JOIN label l ON c.date = l.date""")
def panel_with_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named series with the label of their date."""
    rows = panels.named_series(coded(spark, sf_dir), NAMES)
    return panels.with_target(rows, label(spark, sf_dir)).select("code", "name", "date", "value", "target_star", "target_status")


@query(f"""WITH {CODED}, {LABEL} SELECT (SELECT count(*) FROM coded JOIN label USING (date)) AS n_rows, (SELECT count(DISTINCT code) FROM coded) * (SELECT count(*) FROM label) AS expected""")
def panel_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = label(spark, sf_dir)
    return panels.completeness(panels.with_target(coded(spark, sf_dir), target), target, "code")


@query(f"""WITH {DAILY}, fresh AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST((10 + count(*) % 50) / 10.0 AS DOUBLE) AS star FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT code, date, value, star AS target_star FROM daily JOIN fresh USING (date)""")
def refreshed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel whose stale labels give way to those of a later run."""
    stale = panels.with_target(daily(spark, sf_dir), label(spark, sf_dir))
    return panels.refreshed(stale, label(spark, sf_dir, "o_orderstatus = 'F'")).select("code", "date", "value", "target_star")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 1 THEN 'range' ELSE 'threshold' END AS status,
  CAST(CASE o_orderkey % 4 WHEN 1 THEN 4.0 END AS DOUBLE) AS star_low, CAST(CASE o_orderkey % 4 WHEN 1 THEN 4.5 END AS DOUBLE) AS star_high, CAST(CASE o_orderkey % 4 WHEN 1 THEN 4.25 END AS DOUBLE) AS target_mid,
  CAST(CASE o_orderkey % 4 WHEN 1 THEN 0.4125 ELSE 0.0 END AS DOUBLE) AS weight FROM orders WHERE o_orderkey % 4 IN (1, 2)""")
def review_interval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a review queue whose reason goes by the key: closed, range, threshold or nothing."""
    key = F.col("o_orderkey")
    reasons = F.array(*[F.lit(x) for x in ("market_closed_no_new_target", "approximate_range", "near_threshold_only", "no_exact_text_evidence")])
    ranged = key % 4 == 1
    queue = table(spark, sf_dir, "orders").select(key.alias("id"), F.get(reasons, (key % 4).cast("int")).alias("reason"), F.when(ranged, "4.0").alias("range_low"), F.when(ranged, "4.5").alias("range_high"))
    found = resolve.review_labels(queue, {"exact": 1.0, "range": 0.55, "approx": 0.50, "threshold": 0.0}, strict=False)
    return found.select("id", "status", "star_low", "star_high", "target_mid", F.round("weight", 6).alias("weight"))


@query("""SELECT o_orderpriority AS source_priority, count(*) AS n_rows, count(*) FILTER (WHERE o_orderstatus <> 'P') AS trainable, count(*) FILTER (WHERE o_orderstatus = 'P') AS threshold_only FROM orders GROUP BY 1""")
def label_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as labels: open ones are ranges, pending ones thresholds of weight 0."""
    status = F.when(F.col("o_orderstatus") == "P", "threshold").when(F.col("o_orderstatus") == "O", "range").otherwise("exact")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source_priority"), status.alias("status"))
    return resolve.label_counts(rows.withColumn("weight", F.when(F.col("status") == "threshold", 0.0).otherwise(1.0)))


@query("""SELECT o_orderkey AS id, CAST(CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 0.55 END AS DOUBLE) AS weight,
  CAST(CASE o_orderstatus WHEN 'F' THEN (10 + o_orderkey % 50) / 10.0 ELSE 3.5 END AS DOUBLE) AS target_mid FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def price_study_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as labels of the price-only study; pending ones are unresolved."""
    exact, ranged = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(exact, "exact").when(ranged, "range").otherwise("unresolved").alias("status"),
        F.when(exact, (F.lit(10) + F.col("o_orderkey") % 50) / 10.0).alias("star"), F.when(ranged, 3.0).alias("star_low"), F.when(ranged, 4.0).alias("star_high"),
    )
    return resolve.study_labels(rows).select("id", "weight", "target_mid")


@query("""WITH c AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST((10 + o_orderkey % 50) / 10.0 AS DOUBLE) AS star, CAST(o_orderkey AS VARCHAR) AS article_id,
  CASE o_orderkey % 12 WHEN 0 THEN 0.995 WHEN 1 THEN 0.96 WHEN 2 THEN 0.99 WHEN 8 THEN 0.99 WHEN 11 THEN 0.96 ELSE 0.93 END AS confidence FROM orders WHERE o_orderkey % 12 IN (0, 1, 2, 4, 7, 8, 11))
SELECT date, star, article_id, CAST(confidence AS DOUBLE) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY date, star ORDER BY confidence DESC, article_id) = 1""")
def target_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.target_seed(evidence.candidates(articles(spark, sf_dir))).select("date", "star", "article_id", "confidence")


@query(f"""WITH {RATED}, old AS (SELECT date, CAST(min(tenths) AS DOUBLE) AS legacy_star FROM rated WHERE o_orderpriority = '5-LOW' GROUP BY 1)
SELECT article_id, date, CAST(tenths AS DOUBLE) AS star, legacy_star FROM rated JOIN old USING (date) WHERE o_orderpriority <> '5-LOW' AND tenths <> legacy_star""")
def legacy_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated orders against the lowest label of their date among those of low priority."""
    rows = rated(spark, sf_dir)
    low = F.col("o_orderpriority") == "5-LOW"
    old = rows.where(low).groupBy("date").agg(F.min("tenths").cast("string").alias("star")).withColumn("status", F.lit("exact"))
    exact = rows.where(~low).select("article_id", "date", F.col("tenths").cast("double").alias("star"))
    return resolve.legacy_mismatches(exact, old).select("article_id", "date", "star", "legacy_star")


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS articles FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY 1""")
def articles_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.year_counts(history.in_years(articles(spark, sf_dir), "publish_date", 1996, 1999), "publish_date")


@query(f"""WITH {FILES}, h AS (SELECT path, key, sha256(text) AS h FROM f) SELECT count(*) AS files, count(DISTINCT key) AS canonical_articles, count(*) - count(DISTINCT h) AS exact_duplicates FROM h""")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.counts(ingest.canonical(files(spark, sf_dir)))


@query("""WITH k AS (SELECT l_suppkey AS code, CAST(year(min(l_shipdate)) - 25 AS INTEGER) AS first, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY 1),
w AS (SELECT code, first + 10 * i AS y, last FROM k, generate_series(0, 9) g(i))
SELECT code, make_date(y, 1, 1) AS from_date, CASE WHEN y + 9 >= year(last) THEN last ELSE make_date(y + 9, 12, 31) END AS to_date FROM w WHERE y <= year(last)""")
def calendar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-year windows by supplier from 25 years before its first line to its last one."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.year(F.min("l_shipdate")).alias("first"), F.max("l_shipdate").cast("date").alias("last"))
    return rows.select("code", F.inline(incremental.decade_windows(F.col("first") - 25, F.col("last"))))


@query(f"""WITH g AS (SELECT DISTINCT substr('{PHRASE}', i, 3) AS g FROM range(1, {len(PHRASE) - 1}) r(i)),
d AS (SELECT doc_id, source, text, lower(text) AS t, string_split(lower(text), '') AS cs, greatest(length(text) - 2, 0) AS dl FROM documents),
c AS (SELECT doc_id, source, text, dl, t, g, CAST(len(list_filter(range(1, len(cs) - 1), lambda i: cs[i] || cs[i + 1] || cs[i + 2] = g)) AS DOUBLE) AS tf FROM d, g),
s AS (SELECT g, count(*) FILTER (WHERE tf > 0) AS df FROM c GROUP BY g), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
h AS (SELECT doc_id, any_value(source) AS source, any_value(text) AS text, round(-sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS rank
  FROM c JOIN s USING (g), n WHERE contains(t, '{PHRASE}') GROUP BY doc_id ORDER BY 4, 1 LIMIT 20), p AS (SELECT *, instr(lower(text), '{PHRASE}') AS pos FROM h)
SELECT doc_id AS doc, rank, source, CASE WHEN pos > 81 THEN '…' ELSE '' END || substr(text, greatest(pos - 80, 1), least(pos - 1, 80)) || '[' || substr(text, pos, {len(PHRASE)}) || ']' || substr(text, pos + {len(PHRASE)}, 80) AS snippet FROM p""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits with their source and a snippet."""
    docs = table(spark, sf_dir, "documents")
    hits = search.search(docs, PHRASE, doc="doc_id", text="text").withColumn("rank", F.round("rank", 6))
    return search.described(hits, docs, doc="doc_id", text="text", query=PHRASE, columns=["source"])


@query(f"""WITH {LINES}, k AS (SELECT year, y - 0.04 * x AS a FROM r)
SELECT year, count(*) AS n, round(avg(a), 6) AS anchor_mean, round(stddev_pop(a), 6) AS anchor_std, round(min(a), 6) AS anchor_min, round(max(a), 6) AS anchor_max FROM k GROUP BY year""")
def implied_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fit.anchors(lines(spark, sf_dir), "year", "y", "x", F.lit(0.04))
    return found.select("year", "n", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


@query(f"""WITH {DAILY}, v AS (SELECT code, date, ln(value) AS y, ln(sum(value) OVER (PARTITION BY date)) AS x FROM daily),
c AS (SELECT code, date, y - lag(y) OVER w AS dy, x - lag(x) OVER w AS dx, date - lag(date) OVER w AS gap FROM v WINDOW w AS (PARTITION BY code ORDER BY date)),
p AS (SELECT * FROM c WHERE gap BETWEEN 1 AND 7),
l AS (SELECT code, count(*) AS train_pairs, regr_slope(dy, dx) AS slope, regr_intercept(dy, dx) AS intercept FROM p WHERE year(date) <= 1999 GROUP BY 1)
SELECT code, any_value(train_pairs) AS train_pairs, count(*) AS holdout_pairs, count(*) FILTER (WHERE abs(dy) >= 0.05) AS changed, round(any_value(intercept), 6) AS intercept, round(any_value(slope), 6) AS slope,
  round(avg(abs(dy - intercept - slope * dx)), 6) AS change_mae, round(avg(CASE WHEN sign(dy) = -sign(dx) THEN 1.0 ELSE 0.0 END) FILTER (WHERE abs(dy) >= 0.05 AND abs(dx) > 1e-12), 6) AS against_share
FROM p JOIN l USING (code) WHERE year(date) > 1999 GROUP BY 1""")
def change_day_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-to-day changes of a series against those of the total."""
    rows = daily(spark, sf_dir).select("code", "date", F.ln("value").alias("y"), F.ln(F.sum("value").over(Window.partitionBy("date"))).alias("x"))
    found = fit.change_study(fit.changes(rows, "code", "date", "y", "x"), "code", "date", 1999)
    return found.select("code", "train_pairs", "holdout_pairs", "changed", *[F.round(c, 6).alias(c) for c in found.columns[4:]])


@query(f"""WITH {LINES}, e AS (SELECT avg(abs(9 + 0.04 * x - y)) AS a, avg(abs(9.5 + 0.03 * x - y)) AS b FROM r)
SELECT CASE WHEN a < b THEN 'core_model_beats_baseline' ELSE 'core_model_does_not_beat_baseline' END AS verdict, round(a, 6) AS core_error, round(b, 6) AS baseline_error, round(a / b, 6) AS ratio FROM e""")
def holdout_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fixed lines on the log price, one as the core model and one as the baseline."""
    models = F.inline(F.array(*[F.struct(F.lit(n).alias("model"), (a + b * F.col("x")).alias("prediction")) for n, a, b in (("core", 9, 0.04), ("baseline", 9.5, 0.03))]))
    rows = lines(spark, sf_dir).select(F.col("y").alias("star"), F.col("y").alias("star_low"), F.col("y").alias("star_high"), F.col("w").alias("weight"), models)
    found = fit.verdict(fit.scores(rows, ["model"]), "core", "baseline")
    return found.select("verdict", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query(f"""WITH {LINES}, m AS (SELECT sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * z) / sum(w) AS mz FROM r)
SELECT 'x' AS feature, round(any_value(mx), 6) AS mean, round(sqrt(sum(w * (x - mx) ** 2) / any_value(sw)), 6) AS scale FROM r, m
UNION ALL SELECT 'z', round(any_value(mz), 6), round(sqrt(sum(w * (z - mz) ** 2) / any_value(sw)), 6) FROM r, m""")
def feature_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fit.mean_and_scale(lines(spark, sf_dir), ["x", "z"], "w")
    return found.select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


MEANS, BACKS, RANKS = (5, 10, 20, 60, 120), (20, 60), (60, 120, 252)
_LAST = lambda n: f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
GRID = ["exact_mae", "interval_mae", "within_tenth", "regime_accuracy"]
SPECS = {f"mean_{a} change_{b} rank_{c}": [f"mean_{a}", f"change_{b}", f"rank_{c}"] for a in MEANS for b in BACKS for c in RANKS}
_SPECS = [(f"mean_{a}", f"change_{b}", f"rank_{c}") for a in MEANS for b in BACKS for c in RANKS]


#: Each day of a series with each specification's features.
SPEC_LONG = f"""{DAILY}, v AS (SELECT *, {", ".join(f"ln(avg(value) {_LAST(n)}) AS mean_{n}" for n in MEANS)},
  {", ".join(f"value / lag(value, {n}) OVER (PARTITION BY code ORDER BY date) - 1 AS change_{n}" for n in BACKS)}, {", ".join(f"list(value) {_LAST(n)} AS l{n}" for n in RANKS)} FROM daily),
q AS (SELECT code, year(date) AS year, ln(value) AS y, {", ".join(f"mean_{n}" for n in MEANS)}, {", ".join(f"change_{n}" for n in BACKS)},
  {", ".join(f"(len(list_filter(l{n}, lambda x: x < value)) + 0.5::DOUBLE * len(list_filter(l{n}, lambda x: x = value))) / len(l{n}) AS rank_{n}" for n in RANKS)} FROM v),
u AS (SELECT code, year, y, 1.0::DOUBLE AS w, unnest([{", ".join(f"{{'spec': '{' '.join(s)}', 'f0': {s[0]}, 'f1': {s[1]}, 'f2': {s[2]}}}" for s in _SPECS)}], recursive := true) FROM q)"""


def grid_sql(folds: list[int]) -> str:
    """Table ``grid`` (``key``, ``spec`` and mean scores) over folds that end with these years."""
    return f"""t AS (SELECT code || '|' || spec || '|' || s.fold AS g, year <= s.fold AS tr, u.* FROM u JOIN (VALUES {', '.join(f'({f})' for f in folds)}) s(fold) ON year <= s.fold + 1 WHERE f0 IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL),
{modelsql.signed('t', 3)},
p AS (SELECT g, code, spec, y, w, my + b[1] * (f0 - m[1]) + b[2] * (f1 - m[2]) + b[3] * (f2 - m[3]) AS p FROM t JOIN best USING (g) WHERE NOT tr),
s AS (SELECT g, code, spec, {modelsql.scored()} FROM p GROUP BY 1, 2, 3),
grid AS (SELECT code AS key, spec, {", ".join(f"avg({c}) AS {c}" for c in GRID)} FROM s GROUP BY 1, 2)"""


@query(f"""WITH {SPEC_LONG}, {grid_sql([1998, 1999, 2000])} SELECT key, spec, {modelsql.rounded(GRID)} FROM grid""")
def spec_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty specifications of three features by series, over expanding folds up to the last year."""
    return rounded(screen.grid(io.kept(spec_rows(spark, sf_dir)), key="code", period="year", specs=SPECS, signs=[1, 1, 1], folds=[(1998, 1999), (1999, 2000), (2000, 2001)]))


def spec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series with the features of all specifications."""
    over = lambda n: rolling.last_rows("code", "date", n)
    means, backs, ranks = MEANS, BACKS, RANKS
    rows = daily(spark, sf_dir).select(
        "code", F.year("date").alias("year"), F.ln("value").alias("y"),
        *[F.ln(F.avg("value").over(over(n))).alias(f"mean_{n}") for n in means],
        *[rolling.change("value", "code", "date", n).alias(f"change_{n}") for n in backs],
        *[rolling.mid_rank("value", rolling.row_values("value", over(n))).alias(f"rank_{n}") for n in ranks],
    )
    return rows.withColumns({"target_mid": F.col("y"), "star": F.col("y"), "star_low": F.col("y") - 0.1, "star_high": F.col("y") + 0.1, "weight": F.lit(1.0)})


_TABLE = ("interval_mae", "exact_mae", "exact_rmse", "within_tenth")


@query(f"""WITH {LINES}, t AS (SELECT year <= 1998 AS tr, y, w, unnest([{{'g': 'x', 'f0': x}}, {{'g': 'z', 'f0': z}}, {{'g': 'interaction', 'f0': x * z}}], recursive := true) FROM r),
{modelsql.stepwise('t', 1)},
train AS (SELECT g, f0 AS x, w, y FROM t WHERE tr AND g <> 'interaction'), {modelsql.pooled('train')},
ends AS (SELECT g, min(x) AS first, max(x) AS last FROM steps GROUP BY g),
asked AS (SELECT DISTINCT g, f0, least(greatest(f0, first), last) AS x FROM t JOIN ends USING (g) WHERE NOT tr),
read AS (SELECT a.g, a.f0, max(s.x) FILTER (WHERE s.x <= a.x) AS lx, arg_max(s.v, s.x) FILTER (WHERE s.x <= a.x) AS lv, min(s.x) FILTER (WHERE s.x >= a.x) AS hx, arg_min(s.v, s.x) FILTER (WHERE s.x >= a.x) AS hv, any_value(a.x) AS x
  FROM asked a JOIN steps s USING (g) GROUP BY 1, 2),
p AS (SELECT 'linear:' || g AS model, y, w, p1 AS p FROM a1 WHERE NOT tr
  UNION ALL SELECT 'isotonic:' || g, y, w, CASE WHEN hx > lx THEN lv + (hv - lv) * (x - lx) / (hx - lx) ELSE lv END FROM t JOIN read USING (g, f0) WHERE NOT tr),
s AS (SELECT model, {modelsql.scored()} FROM p GROUP BY 1) SELECT model, n, {modelsql.rounded(_TABLE)} FROM s""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and isotonic fits of the log price on single features."""
    return rounded(screen.model_table(labelled(spark, sf_dir), period="year", features=["x", "z", "interaction"], isotonic=["x", "z"], split=1998))


@query(f"""WITH {RATED}, l AS (SELECT date, CAST(tenths AS DOUBLE) AS star_low, CAST(confidence - 60 AS DOUBLE) AS star_high FROM rated)
SELECT date, 'duplicate date' AS violation FROM l GROUP BY date HAVING count(*) > 1 UNION ALL SELECT date, 'low over high' FROM l WHERE star_low > star_high""")
def label_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated orders as labels: dates that repeat, and bounds in the wrong order."""
    rows = rated(spark, sf_dir).select("date", F.col("tenths").cast("double").alias("star_low"), (F.col("confidence") - 60).cast("double").alias("star_high"))
    return audit.label_violations(rows)


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
SELECT date, CASE WHEN n % 2 = 0 THEN 'exact' ELSE 'range' END AS old_status, CASE WHEN f % 2 = 0 THEN 'exact' ELSE 'range' END AS new_status FROM d
WHERE n - 1 <> f - 1 OR n + 1 <> f + 1 OR n % 2 <> f % 2 OR f < n - 1 OR f > n + 1""")
def interval_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from the number of a date's orders against those from its finished ones."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    of = lambda c: days.select("date", F.col(c).alias("star"), (F.col(c) - 1).alias("star_low"), (F.col(c) + 1).alias("star_high"), F.when(F.col(c) % 2 == 0, "exact").otherwise("range").alias("status"))
    return resolve.interval_conflicts(of("n"), of("f"), "date")


@query(f"""WITH {DAILY} SELECT a.code, a.date, round((count(*) FILTER (WHERE b.value < a.value) + 0.5 * count(*) FILTER (WHERE b.value = a.value)) / count(*), 6) AS percentile_5y
FROM daily a JOIN daily b ON a.code = b.code AND b.date BETWEEN a.date - INTERVAL 5 YEAR AND a.date GROUP BY 1, 2""")
def long_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-rank percentile over five years by a join of year buckets."""
    return rolling.calendar_rank(daily(spark, sf_dir), "code", "date", "value", 5, "percentile_5y").select("code", "date", F.round("percentile_5y", 6).alias("percentile_5y"))


@query(ORACLES["ranked_search"])
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase of ``ranked_search``, answered from postings of titles and texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), "text")
    built = search.index(docs, "doc_id", ["title", "text"])
    found = search.search_index(built, docs, PHRASE, doc="doc_id")
    return found.select("doc", F.round("rank", 6).alias("rank"))


@query(ORACLES["ranked_search"])
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase of ``ranked_search``, answered from a stored index: the folders of its trigrams, places instead of texts, and bounds of blocks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), "text")
    path = io.shared_path(spark, "index")
    search.store_index(docs, "doc_id", ["title", "text"], path, block=256)
    return search.search_stored(spark, path, PHRASE).select("doc", F.round("rank", 6).alias("rank"))


#: Rows of a word that occurs often, with every window that begins at a hit.
WORD = "the"
_WIDE, _SIZE = 34, len(WORD)


@query(f"""WITH d AS (SELECT doc_id AS doc, text, length(text) AS n, lower(text) AS t FROM documents WHERE contains(lower(text), '{WORD}') AND length(lower(text)) = length(text)),
h AS (SELECT doc, list_filter(list_transform(range(1, n - {_SIZE} + 2), lambda i: CASE WHEN t[i:i + {_SIZE - 1}] = '{WORD}' THEN i END), lambda i: i IS NOT NULL) AS spots, text, n FROM d),
w AS (SELECT doc, spots, text, n, unnest(spots) AS a FROM h), k AS (SELECT *, len(list_filter(spots, lambda b: b >= a AND b + {_SIZE} <= a + {_WIDE})) AS hits FROM w QUALIFY row_number() OVER (PARTITION BY doc ORDER BY hits DESC, a) = 1),
l AS (SELECT *, list_max(list_filter(spots, lambda b: b >= a AND b + {_SIZE} <= a + {_WIDE})) + {_SIZE} AS last FROM k),
b AS (SELECT doc, text, n, spots, greatest(least(a - greatest(({_WIDE} - (last - a)) // 2, 0), n - {_WIDE} + 1), 1) AS begin FROM l),
e AS (SELECT *, least(begin + {_WIDE}, n + 1) AS until, list_filter(spots, lambda x: x >= begin AND x + {_SIZE} <= least(begin + {_WIDE}, n + 1)) AS inside FROM b),
c AS (SELECT doc, begin, until, n, i, text[i] AS ch, len(list_filter(inside, lambda x: x <= i AND i < x + {_SIZE})) > 0 AS cov, len(list_filter(inside, lambda x: x <= i - 1 AND i - 1 < x + {_SIZE})) > 0 AS was,
  len(list_filter(inside, lambda x: x <= i + 1 AND i + 1 < x + {_SIZE})) > 0 AS will FROM (SELECT *, unnest(range(begin, until)) AS i FROM e))
SELECT doc, CASE WHEN begin > 1 THEN ' … ' ELSE '' END || string_agg(CASE WHEN cov AND NOT was THEN '[' ELSE '' END || ch || CASE WHEN cov AND NOT will THEN ']' ELSE '' END, '' ORDER BY i) ||
  CASE WHEN until <= n THEN ' … ' ELSE '' END AS snippet FROM c GROUP BY doc, begin, until, n""")
def best_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each document with the most hits of a word."""
    docs = table(spark, sf_dir, "documents").where(F.length(F.lower("text")) == F.length("text"))
    return docs.select(F.col("doc_id").alias("doc"), search.best_snippet(F.col("text"), WORD).alias("snippet")).where("snippet is not null")


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\w\p{L}\p{M}\p{N}_]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM w) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM p GROUP BY term""")
def word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and occurrences of each word."""
    docs = table(spark, sf_dir, "documents")
    return search.term_counts(docs, "doc_id", search.postings(docs, "doc_id", "text", search.words(F.col("text"))))


@query(f"""WITH {SPEC_LONG}, {grid_sql([1998, 1999])},
pick AS (SELECT key AS code, spec FROM grid ORDER BY round(exact_mae, 9), round(interval_mae, 9), key, spec LIMIT 1),
h AS (SELECT u.*, u.year <= 2000 AS tr FROM u JOIN pick ON u.code = pick.code AND u.spec = pick.spec WHERE f0 IS NOT NULL),
c3 AS (SELECT 'core' AS g, tr, y, w, f0, f1, f2 FROM h WHERE f1 IS NOT NULL AND f2 IS NOT NULL), c1 AS (SELECT 'baseline' AS g, tr, y, w, f0 FROM h),
{modelsql.signed('c3', 3, '3')},
{modelsql.signed('c1', 1, '1')},
e AS (SELECT 'core' AS model, avg(abs(my + b[1] * (f0 - m[1]) + b[2] * (f1 - m[2]) + b[3] * (f2 - m[3]) - y)) AS mae FROM c3, best3 WHERE NOT tr
  UNION ALL SELECT 'baseline', avg(abs(my + b[1] * (f0 - m[1]) - y)) FROM c1, best1 WHERE NOT tr),
two AS (SELECT max(mae) FILTER (WHERE model = 'core') AS core, max(mae) FILTER (WHERE model = 'baseline') AS base FROM e)
SELECT code, spec, CASE WHEN core < base THEN 'core_model_beats_baseline' ELSE 'core_model_does_not_beat_baseline' END AS verdict, round(core, 6) AS core_error, round(base, 6) AS baseline_error,
  round(core / base, 6) AS ratio FROM two, pick""")
def fitted_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's best specification on early folds, fitted up to 2000 beside its first feature alone, and which is better afterwards."""
    rows = io.kept(spec_rows(spark, sf_dir))
    grid = screen.grid(rows, key="code", period="year", specs=SPECS, signs=[1, 1, 1], folds=[(1998, 1999), (1999, 2000)])
    best = screen.best_spec(grid.orderBy(F.round("exact_mae", 9), F.round("interval_mae", 9), "key", "spec"))
    if best is None:
        return spark.createDataFrame([], "code string, spec string, verdict string, core_error double, baseline_error double, ratio double")
    features = SPECS[best[1]]
    models = {"core": (features, [1, 1, 1]), "baseline": (features[:1], [1])}
    found = fit.verdict(screen.refitted(rows, key="code", period="year", chosen=best[0], models=models, split=2000), "core", "baseline")
    return rounded(found).select(F.lit(best[0]).alias("code"), F.lit(best[1]).alias("spec"), "*")


@query(f"""WITH s AS (SELECT l_suppkey AS g, l_quantity AS x, 1.0::DOUBLE AS w, ln(l_extendedprice / l_quantity) AS y FROM lineitem), {modelsql.pooled('s')}
SELECT CAST(g AS BIGINT) AS l_suppkey, x AS quantity, round(v, 5) AS price FROM steps""")
def supplier_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decreasing curve of the log unit price by quantity for each supplier, read off at each quantity that it has sold."""
    price = F.ln(F.col("l_extendedprice") / F.col("l_quantity")).alias("y")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("quantity"), price, F.lit(1.0).alias("w"))
    curve = fit.isotonic(rows, ["l_suppkey"], "quantity", "y", "w")
    found = fit.on_curve(rows.select("l_suppkey", "quantity").distinct(), curve, ["l_suppkey"], "quantity", "price")
    return found.withColumn("price", F.round("price", 5))


@query("".join((f"""WITH {LINES}, """, ", ".join(
    f"""t{k} AS (SELECT s.fold AS g, year <= s.fold AS tr, y, w, x AS f0{", z AS f1" if k > 1 else ""}{", x * z AS f2" if k > 2 else ""} FROM r JOIN generate_series(1996, 2000) s(fold) ON year <= s.fold + 1),
{modelsql.signed(f"t{k}", k, str(k))}"""
    for k in (1, 2, 3)), ", e AS (", " UNION ALL ".join(
    f"SELECT g, {k} AS k, y, w, my + {' + '.join(f'b[{i + 1}] * (f{i} - m[{i + 1}])' for i in range(k))} AS p FROM t{k} JOIN best{k} USING (g) WHERE NOT tr" for k in (1, 2, 3)),
    f"""), s AS (SELECT g, k, {modelsql.scored()} FROM e GROUP BY 1, 2)
SELECT CAST(g AS INTEGER) AS fold, CAST(k AS INTEGER) AS n_factors, n, {modelsql.rounded(["interval_mae", "exact_mae", "exact_rmse"])} FROM s""")))  # fmt: skip
def signed_nested_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence of models whose coefficients can't be negative, each with a factor more, from one cube of products."""
    rows = labelled(spark, sf_dir)
    features = ["x", "z", "interaction"]
    cube = io.kept(fit.gram(rows, ["year"], features, "target_mid", "weight"))
    tests = rows.withColumn("fold", F.col("year") - 1)
    out = None
    for k in range(1, len(features) + 1):
        by_year = fit.sub_moments(cube, ["year"], features, {"all": features[:k]}).drop("spec")
        sums = by_year.select("*", F.explode(F.sequence(F.lit(1996), F.lit(2000))).alias("fold")).where("year <= fold").groupBy("fold")
        model = fit.fitted(sums.agg(*[F.sum(c).alias(c) for c in by_year.columns[1:]]), ["fold"], features[:k], [1] * k).drop("n")
        one = fit.scores(tests.join(F.broadcast(model), "fold").withColumn("prediction", fit.predicted(features[:k])), ["fold"]).withColumn("n_factors", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("fold", "n_factors", "n", "interval_mae", "exact_mae", "exact_rmse"))


@query("""WITH v AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS cap, l_extendedprice * (l_discount - 0.035) AS profit FROM lineitem),
s AS (SELECT l_suppkey AS code, l_returnflag AS idx, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(quantile_disc(l_shipdate, 0.2) AS DATE) END AS since,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(quantile_disc(l_shipdate, 0.7) AS DATE) END AS until FROM lineitem GROUP BY l_suppkey, l_returnflag),
m AS (SELECT idx, year(date) AS year, cap AS c, profit AS p, CASE WHEN profit <> 0 THEN cap / profit END AS pe FROM v JOIN s ON v.code = s.code AND (since IS NULL OR date >= since) AND (until IS NULL OR date < until))
SELECT idx AS "index", CAST(year AS INTEGER) AS year, count(pe) AS members, round(sum(c) / nullif(sum(p), 0), 4) AS cap_weighted, round(avg(pe) FILTER (WHERE pe > 0), 4) AS positive_mean, round(median(pe), 4) AS median_pe FROM m GROUP BY 1, 2""")
def members_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valuation of indices whose members come and go: suppliers belong to an index from its first fifth of shipping dates to its last three tenths, some from ever or for ever."""
    lines_ = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    values = lines_.select(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("date"), price.alias("cap"), (price * (F.col("l_discount") - 0.035)).alias("profit"))
    ends = lines_.groupBy(F.col("l_suppkey").alias("code"), F.col("l_returnflag").alias("index")).agg(F.expr("percentile_disc(0.2) within group (order by unix_date(cast(l_shipdate as date)))").alias("a"), F.expr("percentile_disc(0.7) within group (order by unix_date(cast(l_shipdate as date)))").alias("b"))
    day = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    spans = ends.select("code", "index", F.when(F.col("code") % 5 != 0, day("a")).alias("since"), F.when(F.col("code") % 3 != 0, day("b")).alias("until"))
    found = valuation.members_at(values, spans, key="code", group="index", date="date", start="since", end="until").withColumn("year", F.year("date"))
    out = valuation.index_valuation(found, ["index", "year"], "cap", "profit")
    return out.select("index", "year", "members", *[F.round(c, 4).alias(c) for c in ("cap_weighted", "positive_mean", "median_pe")])


@query("""WITH p AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_extendedprice), 2) AS mc, round(sum(l_extendedprice * (l_discount - 0.05)), 2) AS gdp, round(avg(l_tax) - 0.04, 6) AS bond,
  round(sum(l_extendedprice) / nullif(round(sum(l_extendedprice * (l_discount - 0.05)), 2), 0), 6) AS pe, round(sum(l_quantity), 2) AS fb FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, year, round(CASE WHEN gdp > 0 THEN mc / gdp END, 6) AS mc_to_gdp, round(CASE WHEN pe > 0 THEN 1 / pe END, 6) AS earnings_yield_all, round(CASE WHEN pe > 0 AND bond > 0 THEN 1 / pe / bond END, 4) AS equity_bond_ratio_all,
  round(CASE WHEN pe > 0 AND bond > 0 THEN 1 / pe - bond END, 6) AS equity_bond_spread_all, round(fb / mc, 8) AS balance_to_mc FROM p""")
def valuation_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of valuation ratios by supplier and year."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year"))
    profit = F.round(F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)), 2)
    rows = rows.agg(
        F.round(F.sum("l_extendedprice"), 2).alias("mc"), profit.alias("gdp"), F.round(F.avg("l_tax") - 0.04, 6).alias("bond"),
        F.round(F.try_divide(F.sum("l_extendedprice"), profit), 6).alias("pe"), F.round(F.sum("l_quantity"), 2).alias("fb"),
    )
    found = valuation.derived_ratios(rows, gdp="gdp", bond="bond", caps={"mc_to_gdp": "mc"}, earnings={"all": "pe"}, balances={"balance_to_mc": ("fb", "mc")})
    digits = {"mc_to_gdp": 6, "earnings_yield_all": 6, "equity_bond_ratio_all": 4, "equity_bond_spread_all": 6, "balance_to_mc": 8}
    return found.select("l_suppkey", "year", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(f"""WITH {CODED}, {LABEL}, full_days AS (SELECT date FROM coded GROUP BY date HAVING count(*) = 5)
SELECT code, date, value, CASE code WHEN '000001' THEN 'urgent' WHEN '000002' THEN 'high' WHEN '000003' THEN 'medium' WHEN '000004' THEN 'not specified' ELSE 'low' END AS name,
  star AS target_star, status AS target_status FROM coded JOIN full_days USING (date) JOIN label USING (date)""")
def checked_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named series and their labels on days that all series have, checked while they are written."""
    named = panels.write_series(coded(spark, sf_dir).withColumn("date", F.col("date").cast("string")), NAMES, io.shared_path(spark, "series"))
    whole = named.groupBy("date").agg(F.count("*").alias("n")).where(F.col("n") == len(NAMES)).select("date")
    return panels.write_model_rows(named.join(whole, "date"), label(spark, sf_dir).join(whole, "date"), io.shared_path(spark, "model"), "code").select("code", "date", "value", "name", "target_star", "target_status")
