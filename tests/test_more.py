"""Historical runs, factor screens and valuation series against hand-made rows and plain numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.plans import more, registry  # noqa: F401
from panelwright.operators import evidence, history, screen, valuation
from panelwright.sources import io

DAY = dt.date(2024, 1, 1)


def test_manual_rows_win_and_null_confidence_is_last(spark):
    auto = spark.createDataFrame([(DAY, "a", 0.9, "x"), (DAY, "b", None, "y"), (DAY + dt.timedelta(1), "c", None, "z"), (DAY + dt.timedelta(1), "d", 0.1, "z")], "date date, article_id string, confidence double, extra string")
    manual = spark.createDataFrame([(DAY, "m", 0.2)], "date date, article_id string, confidence double")
    got = {r["date"]: (r["article_id"], r["review_status"], r["extra"]) for r in history.manual_over_auto(auto, manual).collect()}
    assert got == {DAY: ("m", "verified_manual", None), DAY + dt.timedelta(1): ("d", "seed_auto", "z")}


SENTENCES = [
    ("# t\n昨天在4.5-4.6星。今天还在4.7-4.6星之间。", ("approximate_range", 4.6, 4.7, None)),
    ("# t\n目前距离5星很接近。今天在4.7-4.8星。", ("near_threshold_only", None, None, 5.0)),
    ("# t\n今天A股没有交易。目前在4.7-4.8星。", ("market_closed_no_new_target", None, None, None)),
    ("# t\n大盘在4.5-4.6星。", ("no_exact_text_evidence", None, None, None)),
    ("", ("no_exact_text_evidence", None, None, None)),
    (None, ("no_exact_text_evidence", None, None, None)),
]


def test_openings_are_judged_by_sentence(spark):
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)], "i int, text string")
    rows = table.select("i", history.sentence_review(F.col("text")).alias("r")).orderBy("i").collect()
    assert [tuple(r["r"][k] for k in ("reason", "range_low", "range_high", "reference_star")) for r in rows] == [w for _, w in SENTENCES]


def test_whole_numbers_need_their_decimal(spark):
    table = spark.createDataFrame([(5.0, "回到5星级"), (5.0, "回到5.0星"), (5.0, "15.0星"), (4.9, "4.9"), (5.0, None)], "star double, found string")
    assert [r[0] for r in table.select(history.is_precise(F.col("star"), F.col("found"))).collect()] == [False, True, False, True, False]


def test_closed_days_and_gap_fill_raise_on_surprises(spark):
    direct = spark.createDataFrame([(DAY, "x"), (DAY + dt.timedelta(1), "y")], "date date, evidence string")
    none = spark.createDataFrame([], "date date, reason string, evidence string")
    closed = spark.createDataFrame([(DAY, "holiday")], "date date, title string")
    kept, moved = history.exclude_closed(direct, none, closed)
    assert [r["evidence"] for r in kept.collect()] == ["y"] and moved.first()["title"] == "holiday"
    with pytest.raises(ValueError):
        history.exclude_closed(direct, none, spark.createDataFrame([(dt.date(2020, 1, 1), "t")], closed.schema))
    legacy = spark.createDataFrame([(DAY, "exact"), (DAY + dt.timedelta(2), "range")], "date date, status string")
    assert history.gap_fill(legacy, [legacy.where("status = 'range'")]).first()["weight"] == 0.7
    with pytest.raises(Exception, match="not exact"):
        history.gap_fill(legacy, [direct]).collect()


def made(spark, n=900):
    rng = np.random.RandomState(3)
    x, good, noise = rng.rand(n), rng.rand(n), rng.rand(n)
    y = 5 - 2 * x + good + 0.05 * rng.rand(n)
    year = 2022 + np.arange(n) % 4
    rows = [(int(a), *map(float, (b, c, d, e, e, e - 0.1, e + 0.1, 1 + f))) for a, b, c, d, e, f in zip(year, x, good, noise, y, noise)]
    fields = "year int, x double, good double, noise double, target_mid double, star double, star_low double, star_high double, weight double"
    return spark.createDataFrame(rows, fields), year, x, good, noise, y


def test_screen_against_numpy(spark):
    table, year, x, good, noise, y = made(spark)
    folds = [(2022, 2023, 2023), (2023, 2024, 2024)]
    table = table.withColumn("rare", F.when(F.rand(1) < 0.02, 1.0))
    found = screen.screened(table, period="year", base="x", candidates={"good": "a", "noise": "b", "rare": "b"}, folds=folds)
    got = {r["feature"]: r for r in found.collect()}
    assert set(got) == {screen.BASE_ONLY, "good", "noise"}

    def error(extra):
        out = []
        for end, test, _ in folds:
            design = np.column_stack([np.ones(len(x)), x, *extra])
            root = np.sqrt(1 + noise)[:, None]
            fit = year <= end
            beta = np.linalg.lstsq((design * root)[fit], y[fit] * root[fit, 0], rcond=None)[0]
            out.append(np.abs(design @ beta - y)[year == test].mean())
        return np.mean(out)

    assert np.isclose(got["good"]["exact_mae"], error([good])) and np.isclose(got[screen.BASE_ONLY]["exact_mae"], error([]))
    assert np.isclose(got["good"]["gain"], error([]) - error([good]))
    assert screen.best_feature(found) == "good" and screen.best_feature(found, ["none"]) is None
    tested = screen.holdout(table, period="year", base="x", extras=["good"], split=2024, last=2025)
    assert tested.groupBy("feature").count().collect()[0]["count"] == (year == 2025).sum()
    with pytest.raises(Exception, match="wrong sign"):
        screen.screened(table, period="year", base="x", candidates={}, folds=folds, base_sign=1).collect()


def test_valuation_launches_and_breadth(spark):
    members = spark.createDataFrame([("i", 10.0, 1.0), ("i", 20.0, -1.0), ("i", 30.0, 2.0), ("i", 5.0, 0.0), ("e", None, None)], "i string, cap double, profit double")
    got = {r["i"]: r for r in valuation.index_valuation(members, ["i"], "cap", "profit").collect()}
    assert (got["i"]["cap_weighted"], got["i"]["positive_weighted"], got["i"]["positive_mean"], got["i"]["median_pe"]) == (32.5, 40 / 3, 12.5, 10.0)
    assert np.isclose(got["i"]["harmonic"], 3 / (0.1 - 0.05 + 2 / 30)) and got["e"]["cap_weighted"] is None
    funds = spark.createDataFrame([("p", DAY, 1, 5.0), ("p", DAY, 2, 7.0), ("q", DAY + dt.timedelta(29), 1, 1.0), ("r", DAY + dt.timedelta(30), 1, 2.0)], "parent string, date date, n int, s double")
    rows = valuation.launches(valuation.first_of_parent(funds, "parent", ["date", "n"]), [], "date", "s", (30,)).orderBy("date").collect()
    assert [(r["count_30"], r["scale_30"]) for r in rows] == [(1, 5.0), (2, 6.0), (2, 3.0)]
    series = spark.createDataFrame([("a", DAY + dt.timedelta(i), float(9 - i)) for i in range(9)] + [("b", DAY + dt.timedelta(i), float(i)) for i in range(9)], "k string, date date, v double")
    last = valuation.breadth(series, "k", "date", "v", 1).orderBy(F.desc("date")).first()
    assert (last["members"], last["share_below"]) == (2, 0.5)


def test_closed_days_leave_the_queue_and_a_null_reason_stays(spark):
    queue = spark.createDataFrame([("a", "market_closed_no_new_target"), ("b", "approximate_range"), ("c", None)], "article_id string, reason string")
    kept, closed = history.closed_market(queue)
    assert sorted(r["article_id"] for r in kept.collect()) == ["b", "c"]
    assert [(r["article_id"], r["review_status"]) for r in closed.collect()] == [("a", "excluded_market_closed")]


def test_sinks_keep_null_dates_and_every_row(spark, tmp_path):
    rows = spark.createDataFrame([(DAY, 1.0), (DAY + dt.timedelta(366), None), (None, 3.0)], "date date, value double")
    io.write_panel(rows, str(tmp_path / "panel"), "date")
    got = {r["date"]: (r["value"], r["year"]) for r in spark.read.parquet(str(tmp_path / "panel")).collect()}
    assert got == {DAY: (1.0, 2024), DAY + dt.timedelta(366): (None, 2025), None: (3.0, None)}
    io.write_audit(rows.where("value = 3").select("value"), str(tmp_path / "audit"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "audit")).collect()] == ['{"value":3.0}']


def test_resolving_reads_orders_of_every_priority(spark):
    sf = "/root/testdata/sf0.001"
    found = [registry.QUERIES[f"{n}_whole"](spark, sf) for n in ("unanimous_targets", "same_day_conflicts")]
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    groups = orders.select(F.col("o_orderdate").cast("date"), "o_orderpriority").distinct().count()
    assert sum(f.count() for f in found) == groups
    assert {r[0] for f in found for r in f.selectExpr("substr(day, 12)").distinct().collect()} == {r[0] for r in orders.select("o_orderpriority").distinct().collect()}


def test_reasons_alone_and_a_queue_judged_once(spark):
    texts = [None, "", "# t", "# t\nA股没有交易，休市", "# t\n大约在4.9-5星级", "# t\n距离5.0星很接近", "# t\r\n距离 4 星级很接近，A股没有交易", "A股没有交易", "# t 当前3-4星"]
    rows = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "i int, title string, text string")
    found = rows.select(evidence.reason(F.col("text")).alias("a"), evidence.review(F.col("title"), F.col("text"))["reason"].alias("b")).collect()
    assert [r["a"] for r in found] == [r["b"] for r in found] and len({r["a"] for r in found}) == 4
    plan = more.closed_market(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()
