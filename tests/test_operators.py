"""Operators against hand-made rows and plain Python."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from panelwright.operators import asof, audit, evidence, fit, incremental, ingest, resolve, rolling, search
from panelwright.sources import io

DAY = dt.date(2024, 1, 1)


def test_asof_by_date_takes_latest_and_breaks_ties(spark):
    left = spark.createDataFrame([(1, DAY), (2, DAY + dt.timedelta(5)), (3, None)], "id int, day date")
    right = spark.createDataFrame([(DAY, 1, "a"), (DAY, 2, "b"), (DAY + dt.timedelta(6), 3, "c"), (None, 4, "d")], "at date, n int, v string")
    got = {r["id"]: r["v"] for r in asof.asof_by_date(left, right, "day", "at", tie=["n"], values=["v"]).collect()}
    assert got == {1: "b", 2: "b", 3: None}


def test_asof_by_key_ignores_other_keys_and_nulls(spark):
    left = spark.createDataFrame([("x", 5), ("y", 5), (None, 5)], "k string, t int")
    right = spark.createDataFrame([("x", 5, 1), ("x", 6, 2), ("y", None, 3)], "k string, t int, v int")
    got = {r["k"]: r["v"] for r in asof.asof_by_key(left, right, ["k"], "t", "t", tie=["v"], values=["v"]).collect()}
    assert got == {"x": 1, "y": None, None: None}


def test_percentiles_against_brute_force(spark):
    random.seed(5)
    days = sorted(random.sample(range(1500), 200))
    rows = [("k", DAY + dt.timedelta(d), float(random.randint(0, 20))) for d in days]
    table = spark.createDataFrame(rows, "key string, date date, v double")
    over = rolling.last_rows("key", "date", 30)
    got = table.select(
        "date",
        rolling.mid_rank("v", rolling.calendar_values("v", "key", "date", 1)).alias("a"),
        rolling.average_rank("v", rolling.row_values("v", over)).alias("b"),
    ).orderBy("date").collect()
    for i, r in enumerate(got):
        start = (rows[i][1].replace(year=rows[i][1].year - 1)) if rows[i][1] != dt.date(2024, 2, 29) else dt.date(2023, 2, 28)
        year = [x[2] for x in rows[: i + 1] if x[1] >= start]
        last = [x[2] for x in rows[max(0, i - 29) : i + 1]]
        v = rows[i][2]
        assert abs(r["a"] - (sum(x < v for x in year) + 0.5 * year.count(v)) / len(year)) < 1e-9
        assert abs(r["b"] - (sum(x < v for x in last) + (last.count(v) + 1) / 2) / len(last)) < 1e-9


def test_future_rows_are_found(spark):
    rows = spark.createDataFrame([(DAY, DAY), (DAY, DAY + dt.timedelta(1))], "date date, src date")
    assert audit.future_rows(rows, "date", ["src"]).first()["violations"] == 1


def test_missing_windows_and_coalesced_loads(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    loaded = spark.createDataFrame([("a", dt.date(2026, 9, 22))], "k string, last_date date")
    first, end = F.lit("2026-09-01").cast("date"), F.lit("2026-10-10").cast("date")
    got = {r["k"]: (r["from_date"], r["to_date"]) for r in incremental.missing_windows(keys, loaded, "k", first, end).collect()}
    assert got == {"a": (dt.date(2026, 9, 23), dt.date(2026, 10, 10)), "b": (dt.date(2026, 9, 1), dt.date(2026, 10, 10))}
    done = spark.createDataFrame([("a", dt.date(2026, 10, 10)), ("b", dt.date(2026, 12, 1))], "k string, last_date date")
    assert incremental.missing_windows(keys, done, "k", first, end).count() == 0
    loads = spark.createDataFrame([(1, 1, 5, None), (1, 2, None, 7)], "k int, seq int, a int, b int")
    assert incremental.coalesce_latest(loads, ["k"], "seq").select("a", "b").first() == (5, 7)


def test_leap_start_goes_on_from_the_day_before(spark):
    got = spark.range(1).select(incremental.date_windows(F.lit("1992-02-29").cast("date"), F.lit("2013-01-01").cast("date")).alias("w")).first()["w"]
    assert [(w["from_date"].isoformat(), w["to_date"].isoformat()) for w in got] == [
        ("1992-02-29", "2002-02-27"), ("2002-02-28", "2012-02-27"), ("2012-02-28", "2013-01-01"),
    ]


CASES = [
    ("今天大盘上涨。\n截止到收盘，回到4.7星。", 4.7, "closing_statement"),
    ("大盘波动，在4.9-5星之间。", None, None),
    ("目前在4.7星，距离4.8星不远。", 4.7, "current_state_statement"),
    ("昨天收盘回到4.6星。", None, None),
    ("盘中一度回到4.6星。", None, None),
    ("今天大盘微跌，在4.2星。", 4.2, "today_market_statement"),
    ("还在4.2星。后来涨到4.3星。", 4.2, "opening_state_statement"),
    ("如果细一些计算，目前大约是4.25。", 4.2, "fine_current_statement"),
    ("1月3日收盘回到4.1星。", None, None),
    ("1月1日收盘回到4.1星。", 4.1, "closing_statement"),
]


def test_observations_of_sentences(spark):
    rows = [(i, "指数估值数据", "# t\n" + t, DAY) for i, (t, _, _) in enumerate(CASES)]
    table = spark.createDataFrame(rows, "i int, title string, text string, day date")
    got = {r["i"]: r["o"] for r in table.select("i", evidence.observation(F.col("title"), F.col("text"), F.col("day")).alias("o")).collect()}
    for i, (_, star, method) in enumerate(CASES):
        assert (got[i] and (got[i]["star"], got[i]["method"])) == (star and (star, method)), CASES[i]


def test_candidates_decode_halves_numerals_and_titles(spark):
    table = spark.createDataFrame([("a", DAY, "49星", "目前4星半，比如三星。")], "article_id string, publish_date date, title string, text string")
    got = {(r["pattern"], r["star"]) for r in evidence.candidates(table).collect()}
    assert got == {("compact_title", 4.9), ("arabic_half", 4.5), ("chinese", 3.0)}


def test_labels_and_conflicts(spark):
    rows = spark.createDataFrame([(DAY, 4.0, 1), (DAY, 4.0, 2), (None, 3.0, 3), (None, 3.5, 4)], "date date, star double, id int")
    assert [r["id"] for r in resolve.unanimous(rows, "date", "star", [F.asc("id")]).collect()] == [1]
    assert resolve.conflicts(rows, "date", "star", "id").first()["values"] == "3.0|3.5"


def test_monotone_fit_against_row_level(spark):
    rng = np.random.RandomState(1)
    x, y = rng.rand(200, 2), rng.rand(200)
    y += 2 * x[:, 0] + x[:, 1]
    table = spark.createDataFrame([(0, *map(float, (*a, b)), 1.0) for a, b in zip(x, y)], "g int, a double, b double, y double, w double")
    sums = fit.moments(table, ["g"], ["a", "b"], "y", "w")
    free = fit.fitted(sums, ["g"], ["a", "b"]).first()
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert np.allclose([free["intercept"], *free["coefs"]], want)
    signed = fit.fitted(sums, ["g"], ["a", "b"], [1, -1]).first()
    only = np.polyfit(x[:, 0], y, 1)
    assert signed["coefs"][1] == 0 and np.allclose(signed["coefs"][0], only[0])


def test_search_needs_three_characters_and_ranks(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, "alpha " + "x" * 300), (3, None)], "id int, text string")
    assert [r["doc"] for r in search.search(docs, "alpha", doc="id", text="text").collect()] == [1, 2]
    assert search.search(docs, "al", doc="id", text="text").count() == 0


def test_files_to_canonical_articles(spark, tmp_path):
    stem = "[2026-01-06-2030]第1期 3.9星"
    (tmp_path / f"{stem}.md").write_text("# 第1期 3.9星\n_2026年01月06日 20:30_\nbody", encoding="utf-8")
    (tmp_path / f"{stem}.html").write_text("<meta property='og:title' content='t'><meta property='og:url' content='http://u'><p>body</p>", encoding="utf-8")
    (tmp_path / "x.png").write_bytes(b"0")
    rows = ingest.canonical(ingest.parsed(ingest.scan(spark, str(tmp_path)))).collect()
    assert len(rows) == 2 and len({r["canonical_article_id"] for r in rows}) == 1
    best = next(r for r in rows if r["is_canonical"])
    assert (best["suffix"], best["title"], best["publish_date"], best["source_url"]) == (".md", "第1期 3.9星", "2026-01-06", "http://u")


def test_payload_is_flattened(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"d": 1, "pe": {"ew": 2.5}}]}')
    assert io.read_payload(spark, str(tmp_path / "a.json")).columns == ["d", "pe.ew"]
