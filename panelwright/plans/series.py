"""Queries over long series that have no key, or one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import asof, ingest, rolling
from panelwright.plans.registry import query, table
from panelwright.sources import io
from panelwright.streaming import refresh

SERIES = """s AS (SELECT l_shipdate AS at, l_orderkey, l_linenumber, l_extendedprice AS v, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS i FROM lineitem)"""
ORDER = ["at", "l_orderkey", "l_linenumber", "v"]


def line_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as one series of prices."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("at"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))


@query("""WITH p AS (SELECT ts AS bought_at, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY ts)
SELECT event_id, ts, purchase, bought_at FROM events e ASOF LEFT JOIN p ON e.ts >= p.bought_at""")
def asof_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last purchase by anyone at or before it: times on both sides and no key."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("ts").alias("bought_at"))
    return asof.asof(events.select("event_id", "ts"), bought, "ts", "bought_at", tie=["purchase"], values=["purchase", "bought_at"])


@query("""WITH o AS (SELECT o_orderpriority AS urgency, o_orderdate AS ordered_at, max(o_orderkey) AS latest FROM orders GROUP BY ALL),
l AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate, CASE WHEN l_orderkey % 3 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS urgency FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice, latest, ordered_at FROM l ASOF LEFT JOIN o ON l.urgency = o.urgency AND l.l_shipdate >= o.ordered_at""")
def asof_latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item with the latest order of an urgency before it was shipped: two keys, of which one has most rows."""
    urgency = F.when(F.col("l_orderkey") % 3 == 0, "1-URGENT").otherwise("5-LOW").alias("urgency")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", urgency)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("urgency"), F.col("o_orderdate").alias("ordered_at"), F.col("o_orderkey").alias("latest"))
    found = asof.asof(lines, orders, "l_shipdate", "ordered_at", keys=("urgency",), tie=["latest"], values=["latest", "ordered_at"])
    return found.select("l_orderkey", "l_linenumber", "l_extendedprice", "latest", "ordered_at")


@query(f"""WITH {SERIES}, w AS (SELECT *, list(v) OVER (ORDER BY i ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS a,
  list(v) OVER (ORDER BY i ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS b, median(v) OVER (ORDER BY i ROWS BETWEEN 239 PRECEDING AND CURRENT ROW) AS m FROM s)
SELECT l_orderkey, l_linenumber, v, CASE WHEN len(a) >= 120 THEN round((len(list_filter(a, lambda x: x < v)) + 0.5 * len(list_filter(a, lambda x: x = v))) / len(a), 6) END AS mid_rank_252,
  CASE WHEN len(b) >= 180 THEN round((len(list_filter(b, lambda x: x < v)) + 0.5 * (len(list_filter(b, lambda x: x = v)) + 1)) / len(b), 6) END AS average_rank_500,
  CASE WHEN i >= 120 THEN round(m, 3) END AS median_240 FROM w""")
def series_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling percentiles and a rolling median over one series of all line items."""
    stats = {"mid_rank_252": ("mid", 252, 120), "average_rank_500": ("average", 500, 180), "median_240": (0.5, 240, 120)}
    found = rolling.order_statistics(line_series(spark, sf_dir), [], ORDER, "v", stats)
    return found.select("l_orderkey", "l_linenumber", "v", F.round("mid_rank_252", 6).alias("mid_rank_252"), F.round("average_rank_500", 6).alias("average_rank_500"), F.round("median_240", 3).alias("median_240"))


@query(f"""WITH {SERIES}, w AS (SELECT *, lag(v, 20) OVER o AS v20, lag(v, 60) OVER o AS v60, sum(v) OVER (ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s5,
  avg(v) OVER (ORDER BY i ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS m250, max(v) OVER (ORDER BY i ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS h252 FROM s WINDOW o AS (ORDER BY i))
SELECT l_orderkey, l_linenumber, v, round(v / v20 - 1, 6) AS change_20, round(v / v60 - 1, 6) AS change_60, CASE WHEN i >= 3 THEN round(s5, 2) END AS sum_5,
  CASE WHEN i >= 120 THEN round(ln(v) - ln(m250), 6) END AS gap_250, round(v / h252 - 1, 6) AS drawdown_252 FROM w""")
def series_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes, sums, gaps and drawdowns over one series of all line items, by chunks that overlap."""
    stats = {"v20": ("first", 21, 21), "v60": ("first", 61, 61), "s5": ("sum", 5, 3), "m250": ("mean", 250, 120), "h252": ("max", 252, 1)}
    found = rolling.order_statistics(line_series(spark, sf_dir), [], ORDER, "v", stats)
    change = lambda c: F.round(F.try_divide("v", c) - 1, 6)
    return found.select(
        "l_orderkey", "l_linenumber", "v", change("v20").alias("change_20"), change("v60").alias("change_60"), F.round("s5", 2).alias("sum_5"),
        F.round(F.ln("v") - F.ln("m250"), 6).alias("gap_250"), F.round(F.col("v") / F.col("h252") - 1, 6).alias("drawdown_252"),
    )


def event_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as loads of a user's day: each brings a value or a property, and sets its sequence."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        "user_id", F.to_date("ts").alias("date"), F.col("event_id").alias("load"),
        F.when(F.col("event_type") != "click", F.col("value")).alias("value"), F.when(F.col("event_id") % 3 == 0, k).alias("k"), F.when(F.col("event_type") == "purchase", F.col("event_type")).alias("kind"),
    )


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS date, event_id AS load, CASE WHEN event_type <> 'click' THEN value END AS value,
  CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_type = 'purchase' THEN event_type END AS kind FROM events)
SELECT user_id, date, arg_max(value, load) FILTER (WHERE value IS NOT NULL) AS value, arg_max(k, load) FILTER (WHERE k IS NOT NULL) AS k, arg_max(kind, load) FILTER (WHERE kind IS NOT NULL) AS kind
FROM e GROUP BY user_id, date""")
def merged_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads merged batch by batch, late ones first and some of them twice, into a target of which each batch rewrites what it touches."""
    loads = event_loads(spark, sf_dir)
    target = io.shared_path(spark, "loads")
    for batch in (loads.where("load % 4 = 3"), loads.where("load % 4 < 2"), loads.where("load % 2 = 1"), loads.where("load % 4 = 2")):
        refresh.merge_batch(target, batch, ["user_id", "date"], "load", parts=16)
    return refresh.merged(spark, target)


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'high' ELSE CAST(event_id % 100 AS VARCHAR) END AS level, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS body_k,
  event_type AS body_type FROM events""")
def variant_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads of which some lack a field and some have another type for one, flattened."""
    events = table(spark, sf_dir, "events")
    k = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"k": '), F.get_json_object("props", "$.k"), F.lit(", "))).otherwise("")
    level = F.when(F.col("event_id") % 5 == 0, F.lit('"high"')).otherwise((F.col("event_id") % 100).cast("string"))
    text = F.concat(F.lit('{"data": [{"level": '), level, F.lit(', "body": {'), k, F.lit('"type": "'), "event_type", F.lit('"}}]}'))
    found = io.flattened_variant(io.variant_rows(events.select("event_id", text.alias("text")), "text", "data"))
    return found.withColumnsRenamed({c: c.replace(".", "_") for c in found.columns})


BODY = "translate(coalesce(text, ''), '0123456789#', '')"


@query(f"""WITH d AS (SELECT doc_id, doc_id % 5 AS kind, '2022-03-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS day, {BODY} AS body FROM documents)
SELECT CASE kind WHEN 0 THEN 'y/[2021-01-05-0930]t ' || doc_id || '.md' WHEN 1 THEN 'a/[2020-05-06]x/t' || doc_id || '.md' WHEN 2 THEN 'a/[2021-01-05]t' || doc_id || '.json' WHEN 3 THEN 'a/[2020-05-06-1200] folder /t' || doc_id || '.json'
    ELSE 'a/2019-12-31 note ' || doc_id || '.txt' END AS relative_path,
  CASE kind WHEN 0 THEN '[2021-01-05-0930]t' || doc_id WHEN 1 THEN 't' || doc_id WHEN 2 THEN '[2021-01-05]t' || doc_id WHEN 3 THEN 't' || doc_id ELSE '2019-12-31note' || doc_id END AS article_key,
  CASE kind WHEN 0 THEN day WHEN 2 THEN day WHEN 4 THEN NULL ELSE '2020-05-06' END AS publish_date,
  CASE kind WHEN 0 THEN 'Head ' || doc_id WHEN 1 THEN 'x' WHEN 2 THEN 'Name ' || doc_id WHEN 3 THEN 'folder' ELSE '2019-12-31 note ' || doc_id END AS title,
  sha256(CASE kind WHEN 0 THEN '# Head ' || doc_id || chr(10) || '_' || substr(day, 1, 4) || '年' || substr(day, 6, 2) || '月' || substr(day, 9, 2) || '日 09:30_' || chr(10) || body WHEN 3 THEN '[PARSE_ERROR] malformed JSON' ELSE body END) AS text_sha256,
  CASE WHEN kind = 2 THEN 'u' || doc_id END AS source_url, kind = 3 AS failed FROM d""")
def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all kinds, some broken, as articles: titles and dates from within, else from the path or its folder."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("d"), (F.col("doc_id") % 5).alias("kind"), F.expr(BODY).alias("body"), F.concat(F.lit("2022-03-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("day"))
    of = lambda *some: F.when(F.col("kind") == 0, some[0]).when(F.col("kind") == 1, some[1]).when(F.col("kind") == 2, some[2]).when(F.col("kind") == 3, some[3]).otherwise(some[4])
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    path = of(text("y/[2021-01-05-0930]t ", F.col("d"), ".md"), text("a/[2020-05-06]x/t", F.col("d"), ".md"), text("a/[2021-01-05]t", F.col("d"), ".json"), text("a/[2020-05-06-1200] folder /t", F.col("d"), ".json"), text("a/2019-12-31 note ", F.col("d"), ".txt"))
    part = lambda at, n: F.substring("day", at, n)
    head = text("# Head ", F.col("d"), "\n_", part(1, 4), "年", part(6, 2), "月", part(9, 2), "日 09:30_\n", F.col("body"))
    good = F.to_json(F.struct(F.col("day").alias("date"), text("Name ", F.col("d")).alias("name"), F.col("body").alias("article"), text("u", F.col("d")).alias("link")))
    files = d.select(path.alias("relative_path"), of(head, F.col("body"), good, F.lit('{"title": '), F.col("body")).alias("raw"))
    files = files.select(
        "relative_path", F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1)).alias("suffix"), F.regexp_extract("relative_path", r"([^/]+?)\.[^./]+$", 1).alias("stem"),
        F.octet_length("raw").cast("long").alias("size_bytes"), F.sha2("raw", 256).alias("sha256"), F.sha1(F.col("relative_path").cast("binary")).alias("article_id"), "raw",
    )
    found = ingest.parsed(files).withColumn("text_sha256", F.sha2("text", 256))
    return ingest.manifest(found).select("relative_path", "article_key", "publish_date", "title", "text_sha256", "source_url", "failed")


@query("""SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS status, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS note, o_orderkey % 2 AS half FROM orders""")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two label files with a byte order mark and different columns, written and read as one table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("status"), F.col("o_orderstatus").alias("note"))
    paths = []
    for half, gone in ((0, "note"), (1, "status")):
        paths.append(io.shared_path(spark, f"labels{half}"))
        io.write_csv(orders.where(F.col("o_orderkey") % 2 == half).drop(gone), paths[-1])
    found = io.read_label_files(spark, paths, "o_orderkey bigint, price double")
    return found.select("o_orderkey", "price", "status", "note", (F.col("o_orderkey") % 2).alias("half"))


@query("""SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer""")
def differing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet parts of which some lack a column, as one table."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    path = io.shared_path(spark, "parts")
    rows.where("c_custkey % 3 = 0").drop("segment").write.parquet(path)
    rows.where("c_custkey % 3 <> 0").drop("balance").write.mode("append").parquet(path)
    return io.read_parts(spark, path).select("c_custkey", "name", "balance", "segment")
