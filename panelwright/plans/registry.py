"""Queries over the reference tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.operators import asof, audit, evidence, fit, incremental, ingest, resolve, rolling, search
from panelwright.plans import modelsql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DAILY = """daily AS (SELECT o_orderpriority AS code, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"""
LEVEL = """level AS (SELECT period_end, CAST(period_end + 45 AS DATE) AS available_date, level FROM (
    SELECT last_day(CAST(l_shipdate AS DATE)) AS period_end, round(sum(l_extendedprice) / sum(l_quantity), 6) AS level FROM lineitem GROUP BY 1))"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by priority and day: five daily series."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("code"), F.col("o_orderdate").cast("date").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly price level, available 45 days after the month's end."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.last_day(F.col("l_shipdate").cast("date")).alias("period_end"))
    out = lines.agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("level"))
    return out.select("period_end", F.date_add("period_end", 45).alias("available_date"), "level")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = level(spark, sf_dir).withColumn("available", F.col("available_date"))
    return asof.asof_by_date(daily(spark, sf_dir), source, "date", "available", tie=["period_end"], values=["period_end", "available_date", "level"])


@query(f"""WITH {DAILY}, {LEVEL},
joined AS (SELECT d.*, l.period_end, l.available_date, l.level FROM daily d ASOF LEFT JOIN level l ON d.date >= l.available_date),
w AS (SELECT *, count(value) OVER rows20 AS n, avg(value) OVER rows20 AS m,
    list(value) OVER (PARTITION BY code ORDER BY date RANGE BETWEEN INTERVAL 1 YEAR PRECEDING AND CURRENT ROW) AS vs
  FROM joined WINDOW rows20 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT code, date, value, period_end, available_date, level, CAST(date_diff('day', available_date, date) AS INTEGER) AS age_days,
  CASE WHEN n >= 10 THEN round(m, 6) END AS mean_20,
  round((len(list_filter(vs, lambda x: x < value)) + 0.5 * len(list_filter(vs, lambda x: x = value))) / len(vs), 6) AS percentile_1y
FROM w""")
def flagship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series as-of joined to a lagged monthly level, with age, rolling mean and one-year percentile."""
    rows = panel(spark, sf_dir)
    return rows.select(
        "code", "date", "value", "period_end", "available_date", "level", F.datediff("date", "available_date").alias("age_days"),
        F.round(rolling.rolling("value", rolling.last_rows("code", "date", 20), 10), 6).alias("mean_20"),
        F.round(rolling.mid_rank("value", rolling.calendar_values("value", "code", "date", 1)), 6).alias("percentile_1y"),
    )


@query("""WITH e AS (SELECT * FROM events WHERE event_type = 'error'), p AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT p.event_id, p.user_id, p.ts, e.ts AS error_ts, e.value AS error_value FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.ts >= e.ts""")
def asof_purchase_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'error'").select("user_id", "ts", "event_id", F.col("ts").alias("error_ts"), F.col("value").alias("error_value"))
    return asof.asof_by_key(left, right, ["user_id"], "ts", "ts", tie=["event_id"], values=["error_ts", "error_value"])


@query("""WITH m AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS period_end, count(*) FILTER (WHERE l_returnflag = 'R') AS returns, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1)
SELECT period_end, CAST(period_end + CASE WHEN returns > 0 THEN 7 ELSE 20 END AS DATE) AS available_date, returns, quantity FROM m""")
def conditional_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.last_day(F.col("l_shipdate").cast("date")).alias("period_end"))
    rows = lines.agg(F.count_if(F.col("l_returnflag") == "R").alias("returns"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rows.select("period_end", F.date_add("period_end", F.when(F.col("returns") > 0, 7).otherwise(20)).alias("available_date"), "returns", "quantity")


@query(f"""WITH {DAILY}, w AS (SELECT *,
  lag(value, 20) OVER o AS v20, lag(value, 60) OVER o AS v60,
  count(value) OVER r5 AS n5, sum(value) OVER r5 AS s5, count(value) OVER r240 AS n240, median(value) OVER r240 AS m240,
  count(value) OVER r250 AS n250, avg(value) OVER r250 AS a250, max(value) OVER r252 AS x252
FROM daily WINDOW o AS (PARTITION BY code ORDER BY date), r5 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  r240 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 239 PRECEDING AND CURRENT ROW), r250 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW),
  r252 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
SELECT code, date, round(value / v20 - 1, 6) AS change_20, round(value / v60 - 1, 6) AS change_60, CASE WHEN n5 >= 3 THEN round(s5, 2) END AS sum_5,
  CASE WHEN n240 >= 120 THEN round(m240, 3) END AS median_240, CASE WHEN n250 >= 120 THEN round(ln(value) - ln(a250), 6) END AS gap_250,
  round(value / x252 - 1, 6) AS drawdown_252 FROM w""")
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = lambda n: rolling.last_rows("code", "date", n)
    return daily(spark, sf_dir).select(
        "code", "date",
        F.round(rolling.change("value", "code", "date", 20), 6).alias("change_20"),
        F.round(rolling.change("value", "code", "date", 60), 6).alias("change_60"),
        F.round(rolling.rolling("value", over(5), 3, "sum"), 2).alias("sum_5"),
        F.round(rolling.rolling("value", over(240), 120, "median"), 3).alias("median_240"),
        F.round(F.ln("value") - F.ln(rolling.rolling("value", over(250), 120)), 6).alias("gap_250"),
        F.round(F.col("value") / F.max("value").over(over(252)) - 1, 6).alias("drawdown_252"),
    )


@query(f"""WITH {DAILY}, w AS (SELECT *, list(value) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS a,
  list(value) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS b FROM daily)
SELECT code, date, CASE WHEN len(a) >= 120 THEN round((len(list_filter(a, lambda x: x < value)) + 0.5 * len(list_filter(a, lambda x: x = value))) / len(a), 6) END AS mid_rank_252,
  CASE WHEN len(b) >= 180 THEN round((len(list_filter(b, lambda x: x < value)) + 0.5 * (len(list_filter(b, lambda x: x = value)) + 1)) / len(b), 6) END AS average_rank_500 FROM w""")
def rolling_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (rolling.last_rows("code", "date", n) for n in (252, 500))
    return daily(spark, sf_dir).select(
        "code", "date",
        F.when(F.count("value").over(a) >= 120, F.round(rolling.mid_rank("value", rolling.row_values("value", a)), 6)).alias("mid_rank_252"),
        F.when(F.count("value").over(b) >= 180, F.round(rolling.average_rank("value", rolling.row_values("value", b)), 6)).alias("average_rank_500"),
    )


@query(f"""WITH {DAILY}, {LEVEL}, joined AS (SELECT d.*, l.period_end, l.available_date FROM daily d ASOF LEFT JOIN level l ON d.date >= l.available_date)
SELECT 'available_date' AS source, count(*) FILTER (WHERE available_date > date) AS violations FROM joined
UNION ALL SELECT 'period_end', count(*) FILTER (WHERE period_end > date) FROM joined""")
def future_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.future_rows(panel(spark, sf_dir), "date", ["available_date", "period_end"])


@query(f"""WITH {DAILY}, {LEVEL}, joined AS (SELECT d.*, l.level FROM daily d ASOF LEFT JOIN level l ON d.date >= l.available_date)
SELECT code, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows, count(value) AS value, count(level) AS level FROM joined GROUP BY code""")
def panel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    return audit.span(rows, "code", "date").join(audit.coverage(rows, "code", ["value", "level"]), "code")


@query("""SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1""")
def latest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_orderkey", "o_totalprice")
    one = rows.groupBy("o_custkey", "date").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("r"))
    return one.select("o_custkey", "date", "r.o_orderkey", "r.o_totalprice")


@query(f"""WITH {DAILY}, cap AS (SELECT code, date, value, sum(value) OVER (PARTITION BY date) AS total FROM daily)
SELECT code, date, round(value / total, 6) AS share, round(1 / value, 12) AS yield, strftime(date, '%Y-%m-%d') AS day FROM cap WHERE total > 0 AND value > 0""")
def guarded_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily(spark, sf_dir).withColumn("total", F.sum("value").over(Window.partitionBy("date"))).withColumn("one", F.lit(1.0))
    rows = rows.where("total > 0 and value > 0")
    return rows.select("code", "date", F.round(rolling.guarded("value", "total"), 6).alias("share"), F.round(rolling.guarded("one", "value"), 12).alias("yield"), F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("""WITH k AS (SELECT l_suppkey AS code, CAST(max(l_shipdate) AS DATE) AS last_date FROM lineitem GROUP BY 1),
s AS (SELECT code, greatest(CAST(last_date + 1 AS DATE), DATE '1995-01-01') AS f FROM k),
b AS (SELECT code, f, CASE WHEN month(f) = 2 AND day(f) = 29 THEN CAST(f - 1 AS DATE) ELSE f END AS c FROM s),
w AS (SELECT code, CASE WHEN i = 0 THEN f ELSE CAST(c + to_years(CAST(10 * i AS INTEGER)) AS DATE) END AS from_date,
  least(CAST(CAST(c + to_years(CAST(10 * (i + 1) AS INTEGER)) AS DATE) - 1 AS DATE), DATE '2030-12-31') AS to_date FROM b, generate_series(0, 5) g(i))
SELECT code, from_date, to_date FROM w WHERE from_date <= DATE '2030-12-31'""")
def missing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("date"))
    loaded = incremental.last_loaded(lines, "code", "date")
    return incremental.missing_windows(loaded.select("code"), loaded, "code", F.lit("1995-01-01").cast("date"), F.lit("2030-12-31").cast("date"))


@query("""SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, arg_max(o_orderstatus, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS status,
  arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderkey % 2 = 1) AS price FROM orders GROUP BY 1, 2""")
def coalesced_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    loads = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_orderkey",
        F.when(~even, F.col("o_totalprice")).alias("price"), F.when(even, F.col("o_orderstatus")).alias("status"),
    )
    return incremental.consolidate(loads, ["o_custkey", "date"], "o_orderkey", ["date", "o_custkey"])


OBSERVED = """obs AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey % 3 AS DOUBLE) / 2 + 3 AS star, 1.0 - (o_orderkey % 7) / 100.0 AS confidence FROM orders)"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_orderdate").cast("date").alias("date"), ((key % 3).cast("double") / 2 + 3).alias("star"), (1.0 - (key % 7) / 100.0).alias("confidence")
    )


@query(f"""WITH {OBSERVED}, g AS (SELECT *, min(star) OVER (PARTITION BY date) = max(star) OVER (PARTITION BY date) AS agree,
  row_number() OVER (PARTITION BY date ORDER BY id % 7, id) AS k FROM obs) SELECT date, star, id FROM g WHERE agree AND k = 1""")
def unanimous_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unanimous(observed(spark, sf_dir), "date", "star", [F.desc("confidence"), F.asc("id")]).select("date", "star", "id")


@query(f"""WITH {OBSERVED} SELECT date, array_to_string(list_sort(list(DISTINCT CAST(star AS VARCHAR))), '|') AS values,
  array_to_string(list_sort(list(DISTINCT CAST(id AS VARCHAR))), '|') AS ids FROM obs GROUP BY date HAVING count(DISTINCT star) > 1""")
def same_day_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.conflicts(observed(spark, sf_dir), "date", "star", "id")


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS s FROM orders),
a AS (SELECT date, 'direct' AS status FROM d WHERE s = 'F'), b AS (SELECT date, 'range' AS status FROM d WHERE s = 'O' AND date NOT IN (SELECT date FROM a)),
c AS (SELECT date, 'fallback' AS status FROM d WHERE s = 'P' AND date NOT IN (SELECT date FROM a) AND date NOT IN (SELECT date FROM b)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT CAST(year(date) AS INTEGER) AS year, count(*) FILTER (WHERE status = 'direct') AS direct, count(*) FILTER (WHERE status = 'range') AS range,
  count(*) FILTER (WHERE status = 'fallback') AS fallback FROM u WHERE date IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem) GROUP BY 1""")
def unified_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by priority, on trading days only, counted by year and status."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_orderstatus").distinct()
    source = lambda s, name: days.where(F.col("o_orderstatus") == s).select("date", F.lit(name).alias("status"))
    direct = source("F", "direct")
    ranged = resolve.overlay([direct], source("O", "range"), "date")
    rest = resolve.overlay([direct, ranged], source("P", "fallback"), "date")
    calendar = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    rows = resolve.on_calendar(direct.unionByName(ranged).unionByName(rest), calendar, "date")
    return resolve.year_status_counts(rows, "date", "status", ["direct", "range", "fallback"])


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN (10 + o_orderkey % 50) / 10.0 END AS star,
  CASE WHEN o_orderkey % 2 = 1 THEN 3.0 END AS lo, CASE WHEN o_orderkey % 2 = 1 THEN 4.0 END AS hi, o_orderstatus AS status FROM orders)
SELECT id, CAST(coalesce(lo, star) AS DOUBLE) AS star_low, CAST(coalesce(hi, star) AS DOUBLE) AS star_high, CAST(round(coalesce(star, (lo + hi) / 2), 6) AS DOUBLE) AS target_mid,
  CASE status WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.495 ELSE 0.0 END::DOUBLE AS weight FROM r""")
def interval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("id"), F.when(key % 2 == 0, (F.lit(10) + key % 50) / 10.0).alias("star"),
        F.when(key % 2 == 1, 3.0).alias("star_low"), F.when(key % 2 == 1, 4.0).alias("star_high"), F.col("o_orderstatus").alias("status"),
    )
    rows = resolve.weighted(resolve.intervals(rows), "status", {"F": (1.0, 1.0), "O": (0.55, 0.9), "P": (0.0, 1.0)})
    return rows.select("id", "star_low", "star_high", F.round("target_mid", 6).alias("target_mid"), F.round("weight", 6).alias("weight"))


SENTENCES = (
    "今天大盘下跌，截止到收盘，回到{v}星。", "目前在{v}星。", "今天大盘上涨一些，在{v}星。", "市场还在{v}星。", "上周回到{v}星。", "如果细一些计算，目前大约是{v}。",
    "大盘在{v}-5.9星之间。", "盘中一度回到{v}星。", "今天大盘在{v}星。", "距离{v}星很接近。", "A股没有交易，休市。", "市场平静。\n目前{d}，市场在{v}星。",
)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article for each order: the sentence goes by its key, the date is the order's."""
    key = F.col("o_orderkey")
    value = F.format_string("%.1f", (F.lit(10) + key % 50) / 10.0)
    date = F.col("o_orderdate").cast("date")
    body = F.element_at(F.array(*[F.lit(s) for s in SENTENCES]), (key % len(SENTENCES) + 1).cast("int"))
    day = F.concat(F.year(date).cast("string"), F.lit("年"), F.month(date).cast("string"), F.lit("月"), F.dayofmonth(date).cast("string"), F.lit("日"))
    title = F.when(key % len(SENTENCES) == 8, evidence.GLOBAL_MARKER).otherwise(evidence.ARTICLE_MARKER)
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("article_id"), date.alias("publish_date"), title.alias("title"),
        F.concat(F.lit("# "), title, F.lit("\n"), F.replace(F.replace(body, F.lit("{v}"), value), F.lit("{d}"), day)).alias("text"),
    )


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS article_id, CAST((10 + o_orderkey % 50) / 10.0 AS DOUBLE) AS star,
  CASE o_orderkey % 12 WHEN 0 THEN 'closing_statement' WHEN 1 THEN 'current_state_statement' WHEN 2 THEN 'today_market_statement' WHEN 3 THEN 'opening_state_statement'
    WHEN 5 THEN 'fine_current_statement' ELSE 'dated_current_statement' END AS method FROM orders WHERE o_orderkey % 12 IN (0, 1, 2, 3, 5, 11)""")
def evidence_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.observed(articles(spark, sf_dir), ["article_id"]).select("article_id", "star", "method")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS article_id, CASE o_orderkey % 12 WHEN 6 THEN 'approximate_range' WHEN 9 THEN 'near_threshold_only'
    WHEN 10 THEN 'market_closed_no_new_target' ELSE 'no_exact_text_evidence' END AS reason,
  CAST(CASE WHEN o_orderkey % 12 = 6 THEN (10 + o_orderkey % 50) / 10.0 END AS DOUBLE) AS range_low, CAST(CASE WHEN o_orderkey % 12 = 6 THEN 5.9 END AS DOUBLE) AS range_high,
  CAST(CASE WHEN o_orderkey % 12 = 9 THEN (10 + o_orderkey % 50) / 10.0 END AS DOUBLE) AS reference_star FROM orders WHERE o_orderkey % 12 IN (4, 6, 7, 9, 10)""")
def evidence_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).where(evidence.is_daily(F.col("title")))
    rows = rows.where(evidence.observation(F.col("title"), F.col("text"), F.col("publish_date")).isNull())
    return rows.select("article_id", evidence.review(F.col("title"), F.col("text")).alias("r")).select("article_id", "r.reason", "r.range_low", "r.range_high", "r.reference_star")


MENTIONS = """m AS (SELECT CAST(o_orderkey AS VARCHAR) AS article_id, 'text' AS location, 'arabic' AS pattern, o_orderkey % 12 AS k, CAST(CASE o_orderkey % 12 WHEN 6 THEN 5.9 ELSE (10 + o_orderkey % 50) / 10.0 END AS DOUBLE) AS star,
  CASE WHEN o_orderkey % 12 IN (3, 6, 9) THEN 'generic' ELSE 'realtime' END AS relation,
  CAST(CASE o_orderkey % 12 WHEN 0 THEN 0.995 WHEN 1 THEN 0.96 WHEN 2 THEN 0.99 WHEN 8 THEN 0.99 WHEN 11 THEN 0.96 WHEN 4 THEN 0.93 WHEN 7 THEN 0.93 ELSE 0.72 END AS DOUBLE) AS confidence FROM orders WHERE o_orderkey % 12 NOT IN (5, 10))"""


@query(f"""WITH {MENTIONS} SELECT article_id, location, pattern, star, relation, confidence FROM m""")
def evidence_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention with its relation and confidence; the SQL knows them from the sentences' numbers."""
    return evidence.candidates(articles(spark, sf_dir)).select("article_id", "location", "pattern", "star", "relation", "confidence")


FILES = """f AS (SELECT 'a/[2024-01-01-0000] t ' || doc_id || '.md' AS path, '[2024-01-01-0000]t' || doc_id AS key, '.md' AS suffix, text, CAST(NULL AS VARCHAR) AS url FROM documents
  UNION ALL SELECT 'b/[2024-01-01-0000]t' || doc_id || '.html', '[2024-01-01-0000]t' || doc_id, '.html', text, 'u' || doc_id FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a markdown file and as a page."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("d"), "text")
    md = docs.select(F.concat(F.lit("a/[2024-01-01-0000] t "), "d", F.lit(".md")).alias("relative_path"), F.lit(".md").alias("suffix"), "text", F.lit(None).cast("string").alias("source_url"))
    html = docs.select(F.concat(F.lit("b/[2024-01-01-0000]t"), "d", F.lit(".html")).alias("relative_path"), F.lit(".html").alias("suffix"), "text", F.concat(F.lit("u"), "d").alias("source_url"))
    rows = md.unionByName(html)
    rows = rows.withColumn("stem", F.regexp_extract("relative_path", r"([^/]+?)\.[^./]+$", 1))
    return rows.select(
        F.substring(F.sha1(F.col("relative_path").cast("binary")), 1, 20).alias("article_id"), ingest.article_key(F.col("stem")).alias("article_key"), "relative_path", "suffix",
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "source_url", F.lit(False).alias("failed"),
    )


@query(f"""WITH {FILES}, h AS (SELECT *, substr(sha1(path), 1, 20) AS id, sha256(text) AS h FROM f),
d AS (SELECT *, first_value(id) OVER (PARTITION BY h ORDER BY string_split(path, '/')) AS first_id FROM h)
SELECT id AS article_id, key AS article_key, CASE WHEN first_id <> id THEN first_id END AS duplicate_of,
  row_number() OVER k = 1 AS is_canonical, first_value(id) OVER k AS canonical_article_id, coalesce(url, max(url) OVER (PARTITION BY key)) AS source_url
FROM d WINDOW k AS (PARTITION BY key ORDER BY CASE suffix WHEN '.md' THEN 0 ELSE 1 END, first_id <> id, path)""")
def canonical_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.canonical(files(spark, sf_dir)).select("article_id", "article_key", "duplicate_of", "is_canonical", "canonical_article_id", "source_url")


#: Text nodes of HTML without scripts, styles and comments; the entities are those that the pages given hold, with or without their semicolon.
NODES = r"""list_filter([trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '&copy;?', chr(169), 'g'), '&middot;?', chr(183), 'g'),
  '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), E' \t\n\r') FOR n IN regexp_split_to_array({html}, '(?s)<[^>]*>|' || chr(1))], lambda n: n <> '')"""


@query(rf"""WITH c AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>', chr(1), 'g') AS h FROM pages),
e AS (SELECT page_id, h, regexp_extract(h, '(?s)<h1\b[^>]*>(.*?)</h1>', 1) AS h1, regexp_extract(h, '(?s)<title\b[^>]*>(.*?)</title>', 1) AS named FROM c)
SELECT page_id, coalesce(nullif(array_to_string({NODES.format(html="h1")}, ' '), ''), nullif(array_to_string({NODES.format(html="named")}, ' '), '')) AS title,
  CAST(NULL AS VARCHAR) AS source_url, CAST(length(array_to_string({NODES.format(html="h")}, chr(10))) AS INTEGER) AS n_text FROM e""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and text of every page."""
    return ingest.pages_text(table(spark, sf_dir, "pages"), "html", ["page_id"]).select("page_id", "title", "source_url", F.length("text").alias("n_text"))


PHRASE = "onthe"


@query(f"""WITH g AS (SELECT DISTINCT substr('{PHRASE}', i, 3) AS g FROM range(1, {len(PHRASE) - 1}) r(i)),
d AS (SELECT doc_id, lower(text) AS t, string_split(lower(text), '') AS cs, greatest(length(text) - 2, 0) AS dl FROM documents),
c AS (SELECT doc_id, dl, t, g, CAST(len(list_filter(range(1, len(cs) - 1), lambda i: cs[i] || cs[i + 1] || cs[i + 2] = g)) AS DOUBLE) AS tf FROM d, g),
s AS (SELECT g, count(*) FILTER (WHERE tf > 0) AS df FROM c GROUP BY g), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d)
SELECT doc_id AS doc, round(-sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS rank
FROM c JOIN s USING (g), n WHERE contains(t, '{PHRASE}') GROUP BY doc_id ORDER BY 2, 1 LIMIT 20""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), PHRASE, doc="doc_id", text="text").withColumn("rank", F.round("rank", 6))


@query("""WITH c AS (SELECT doc_id, string_split(lower(text), '') AS cs FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(cs) - 1, 1)), lambda i: cs[i] || cs[i + 1] || cs[i + 2])) AS term FROM c)
SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM p GROUP BY term""")
def trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.term_counts(docs, "doc_id", search.postings(docs, "doc_id", "text"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ingest.first_json(F.col("props"), ("missing", "k")).cast("long").alias("k"))


LINES = """r AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, ln(l_extendedprice) AS y, l_quantity AS x, l_discount AS z, 1 + l_tax AS w FROM lineitem)"""


def rounded(found: DataFrame) -> DataFrame:
    """Doubles to six places."""
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.year("l_shipdate").alias("year"), F.ln("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("z"), (1 + F.col("l_tax")).alias("w"))


@query(f"""WITH {LINES}, m AS (SELECT year, count(*) AS n, sum(w) sw, sum(w * x) / sum(w) mx, sum(w * y) / sum(w) my FROM r GROUP BY year),
b AS (SELECT year, any_value(n) n, any_value(mx) mx, any_value(my) my, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS slope FROM r JOIN m USING (year) GROUP BY year)
SELECT year, n, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept FROM b""")
def weighted_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = fit.moments(lines(spark, sf_dir), ["year"], ["x"], "y", "w")
    found = fit.fitted(sums, ["year"], ["x"])
    return found.select("year", "n", F.round(F.col("coefs")[0], 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


#: Centred products by group, and from them the fits on both features, on either of them, and on none.
SOLVED = """c AS (SELECT g, count(*) AS n, any_value(sw) AS sw, any_value(mx) AS mx, any_value(mz) AS mz, any_value(my) AS my, sum(w * (x - mx) * (x - mx)) AS xx, sum(w * (z - mz) * (z - mz)) AS zz,
  sum(w * (x - mx) * (z - mz)) AS xz, sum(w * (x - mx) * (y - my)) AS xy, sum(w * (z - mz) * (y - my)) AS zy, sum(w * (y - my) * (y - my)) AS yy FROM t JOIN (
    SELECT g, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * z) / sum(w) AS mz, sum(w * y) / sum(w) AS my FROM t GROUP BY g) USING (g) GROUP BY g),
b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM c)"""


@query(f"""WITH {LINES}, t AS (SELECT year AS g, * FROM r), {SOLVED},
s AS (SELECT g, n, mx, mz, my, unnest([{{'o': 1, 'a': 0.0, 'b': 0.0, 'e': yy}}, {{'o': 2, 'a': xy / xx, 'b': 0.0, 'e': yy - xy * xy / xx}}, {{'o': 3, 'a': 0.0, 'b': zy / zz, 'e': yy - zy * zy / zz}},
  {{'o': 4, 'a': bx, 'b': bz, 'e': yy - bx * xy - bz * zy}}]) AS m FROM b)
SELECT CAST(g AS INTEGER) AS year, n, round(m.a, 6) AS quantity, round(m.b, 6) AS discount, round(my - m.a * mx - m.b * mz, 6) AS intercept FROM s WHERE m.a >= 0 AND m.b <= 0
QUALIFY row_number() OVER (PARTITION BY g ORDER BY m.e, m.o) = 1""")
def monotone_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-constrained fits by year, price rising with quantity and not with the discount."""
    sums = fit.moments(lines(spark, sf_dir), ["year"], ["x", "z"], "y", "w")
    found = fit.fitted(sums, ["year"], ["x", "z"], [1, -1])
    return found.select("year", "n", F.round(F.col("coefs")[0], 6).alias("quantity"), F.round(F.col("coefs")[1], 6).alias("discount"), F.round("intercept", 6).alias("intercept"))


@query(f"""WITH {LINES}, t AS (SELECT f AS g, r.* FROM r JOIN generate_series(1997, 2000) s(f) ON year <= f), {SOLVED},
p AS (SELECT g AS fold, 'quantity' AS spec, my - xy / xx * mx + xy / xx * x AS p, y, r.w FROM r JOIN b ON r.year = g + 1
  UNION ALL SELECT g, 'quantity and discount', my - bx * mx - bz * mz + bx * x + bz * z, y, r.w FROM r JOIN b ON r.year = g + 1)
SELECT CAST(fold AS INTEGER) AS fold, spec, count(*) AS n, round(avg(greatest(y - 0.1 - p, p - y - 0.1, 0.0)), 6) AS interval_mae, round(avg(abs(p - y)), 6) AS exact_mae,
  round(sqrt(avg((p - y) * (p - y))), 6) AS exact_rmse FROM p GROUP BY 1, 2""")
def expanding_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two specifications fitted on the years up to each fold and scored on the next one; the data are summed once by year."""
    rows = lines(spark, sf_dir)
    tests = rows.withColumn("fold", F.col("year") - 1)
    ends = F.explode(F.sequence(F.lit(1997), F.lit(2000))).alias("fold")
    out = None
    for name, features in (("quantity", ["x"]), ("quantity and discount", ["x", "z"])):
        by_year = fit.moments(rows, ["year"], features, "y", "w")
        sums = by_year.select("*", ends).where("year <= fold").groupBy("fold").agg(*[F.sum(c).alias(c) for c in by_year.columns[1:]])
        model = fit.fitted(sums, ["fold"], features).drop("n")
        scored = tests.join(F.broadcast(model), "fold").withColumn("prediction", fit.predicted(features))
        scored = scored.select("fold", "prediction", F.col("y").alias("star"), (F.col("y") - 0.1).alias("star_low"), (F.col("y") + 0.1).alias("star_high"), F.col("w").alias("weight"))
        found = fit.scores(scored, ["fold"]).select("fold", F.lit(name).alias("spec"), "n", *[F.round(c, 6).alias(c) for c in ("interval_mae", "exact_mae", "exact_rmse")])
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""WITH {LINES}, p AS (SELECT year, 9 + 0.04 * x AS p, y, y - 0.1 AS lo, y + 0.1 AS hi, w FROM r),
e AS (SELECT *, greatest(lo - p, p - hi, 0.0) AS err FROM p)
SELECT year, count(*) AS n, count(*) AS n_exact, round(avg(err), 6) AS interval_mae, round(sum(err * w) / sum(w), 6) AS weighted_mae, round(avg(CASE WHEN err = 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
  round(avg(abs(p - y)), 6) AS exact_mae, round(sqrt(avg((p - y) * (p - y))), 6) AS exact_rmse, round(avg(CASE WHEN abs(p - y) <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS within_tenth,
  round(avg(CASE WHEN floor(p) = floor(y) THEN 1.0 ELSE 0.0 END), 6) AS regime_accuracy FROM e GROUP BY year""")
def scores_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(
        "year", (9 + 0.04 * F.col("x")).alias("prediction"), F.col("y").alias("star"), (F.col("y") - 0.1).alias("star_low"), (F.col("y") + 0.1).alias("star_high"), F.col("w").alias("weight")
    )
    found = fit.scores(rows, ["year"])
    return found.select("year", "n", "n_exact", *[F.round(c, 6).alias(c) for c in found.columns[3:]])


@query("""WITH t AS (SELECT o_orderkey, o_totalprice - 150000 AS residual FROM orders), k AS (SELECT min(a) AS least FROM (SELECT abs(residual) AS a FROM t ORDER BY a DESC LIMIT 10))
SELECT o_orderkey, round(residual, 2) AS residual FROM t, k WHERE abs(residual) >= least""")
def largest_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") - 150000).alias("residual"))
    return fit.largest_with_ties(rows, "residual", 10).select("o_orderkey", F.round("residual", 2).alias("residual"))


@query(f"""WITH {DAILY}, c AS (SELECT code, date, value - lag(value) OVER w AS change, date - lag(date) OVER w AS gap FROM daily WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, count(*) AS n, round(avg(CASE WHEN change < 0 THEN 1.0 ELSE 0.0 END), 6) AS falling, round(stddev_pop(change) / 1000, 4) AS spread FROM c WHERE gap BETWEEN 1 AND 7 GROUP BY code""")
def change_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("code").orderBy("date")
    rows = daily(spark, sf_dir).select("code", (F.col("value") - F.lag("value").over(by)).alias("change"), F.datediff("date", F.lag("date").over(by)).alias("gap"))
    rows = rows.where("gap between 1 and 7")
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.round(F.avg((F.col("change") < 0).cast("double")), 6).alias("falling"), F.round(F.stddev_pop("change") / 1000, 4).alias("spread"))


@query(f"""WITH r AS (SELECT 1 AS g, CAST(p_size AS DOUBLE) AS x, 1.0::DOUBLE AS w, p_retailprice AS y FROM part), {modelsql.pooled('r')}
SELECT CAST(x AS INTEGER) AS p_size, round(v, 6) AS prediction FROM steps""")
def isotonic_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decreasing weighted isotonic fit of price by size."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("label"), F.lit(1.0).alias("weight"))
    packed = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    model = IsotonicRegression(isotonic=False, weightCol="weight").fit(packed)
    return model.transform(packed).select(F.col("x").cast("int").alias("p_size"), F.round("prediction", 6).alias("prediction")).distinct()
