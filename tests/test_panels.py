"""Panels, label sources, grids, files and streams against hand-made rows and plain numpy."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import evidence, fit, history, incremental, ingest, panels, resolve, rolling, screen, search
from panelwright.sources import io
from panelwright.streaming import refresh

DAY = dt.date(2024, 1, 1)


def test_dates_and_codes_are_made_alike(spark):
    rows = spark.createDataFrame([("2024-01-01 15:59:59",), ("2024-01-01T16:00:00Z",), ("2024-01-02T00:00:00+08:00",), ("2024-01-01",), ("bad",), (None,)], "d string")
    assert [r[0] and r[0].day for r in rows.select(panels.local_date(F.col("d"))).collect()] == [1, 2, 2, 1, None, None]
    codes = spark.createDataFrame([("985",), ("1000002",), ("000985",), (None,)], "c string")
    assert [r[0] for r in codes.select(panels.padded_code(F.col("c"))).collect()] == ["000985", "1000002", "000985", None]


def test_unknown_codes_repeated_dates_and_labels_raise(spark):
    rows = spark.createDataFrame([("985", "2024-01-01", 1.0), ("1000002", "2024-01-01", 2.0)], "code string, date string, v double")
    names = {"000985": "a", "1000002": "b"}
    assert {r["name"] for r in panels.named_series(rows, names).collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="unknown code"):
        panels.named_series(rows, {"000985": "a"})
    with pytest.raises(ValueError, match="repeated date"):
        panels.named_series(rows.union(rows), names)
    panel = panels.named_series(rows, names)
    target = spark.createDataFrame([(DAY, 4.0, "exact")], "date date, star double, status string")
    full = panels.with_target(panel, target)
    assert panels.model_rows(full, target, "code").count() == 2
    with pytest.raises(ValueError, match="several labels"):
        panels.with_target(panel, target.union(target))
    with pytest.raises(ValueError, match="expected 4"):
        panels.model_rows(full, target.union(spark.createDataFrame([(dt.date(2024, 1, 2), 4.0, "exact")], target.schema)), "code")
    later = spark.createDataFrame([(DAY, 4.5, "range")], target.schema)
    assert [r["target_star"] for r in panels.refreshed(full, later).collect()] == [4.5, 4.5]
    assert panels.prefixed(spark.createDataFrame([(1, 2)], "k int, `pe.ew` int"), "x_", ["k"]).columns == ["k", "x_pe_ew"]


def test_label_sources(spark):
    queue = spark.createDataFrame([("approximate_range", "4.0", "4.4"), ("near_threshold_only", None, None), ("market_closed_no_new_target", None, None), ("odd", None, None)], "reason string, range_low string, range_high string")
    weights = {"exact": 1.0, "range": 0.55, "threshold": 0.0}
    got = {r["status"]: (r["target_mid"], r["weight"]) for r in resolve.review_labels(queue, weights, strict=False).collect()}
    assert got["threshold"] == (None, 0.0) and got["range"][0] == 4.2 and abs(got["range"][1] - 0.4125) < 1e-12
    with pytest.raises(Exception, match="unexpected review reason"):
        resolve.review_labels(queue, weights).collect()
    found = spark.createDataFrame(
        [("a", DAY, "t", 4.0, 0, "c", "realtime", 0.95), ("a", DAY, "t", 4.0, 9, "d", "realtime", 0.99), ("b", DAY, "t", 4.0, 0, "c", "realtime", 0.93), ("c", DAY, "t", 4.0, 0, "c", "realtime", 0.95),
         ("c", DAY, "t", 4.5, 5, "c", "realtime", 0.95), ("d", None, "t", 3.0, 0, "c", "realtime", 0.9), ("e", DAY, "t", 2.0, 0, "c", "generic", 0.99)],
        "article_id string, publish_date date, title string, star double, start int, context string, relation string, confidence double",
    )
    assert sorted((r["article_id"], r["star"], r["context"]) for r in resolve.target_seed(found).collect()) == [("a", 4.0, "d"), ("d", 3.0, "c")]
    labels = spark.createDataFrame([("exact", "4.0", None, None), ("unresolved", "4.0", None, None), ("derived", None, "3", "4"), ("other", "1", None, None)], "status string, star string, star_low string, star_high string")
    assert sorted((r["weight"], r["target_mid"]) for r in resolve.study_labels(labels).collect()) == [(0.25, 3.5), (1.0, 4.0)]
    assert resolve.in_order(labels, ["star", "notes", "status"], "status").columns == ["star", "notes", "status"]


SENTENCES = [
    ("收盘时大盘回落，降到4.3星。", 4.3, "closing_statement"),
    ("截至收盘，今天市场在4.4星级。", 4.4, "closing_statement"),
    ("到下午收盘，大盘从4.9星回到5星。", 5.0, "closing_statement"),
    ("中午收盘，大盘回到4.3星。", None, None),
    ("今天大盘盘中一度到4.3星，截止到收盘，回到4.2星。", 4.2, "closing_statement"),
    ("如果大盘跌到5星就好了。", None, None),
    ("2021年收盘时回到3.5星。", None, None),
    ("要再跌一些，才会回到5星。", None, None),
    ("上个月收盘回到4.8星，目前在4.6星。", None, None),
    ("上个月收盘回到4.8星。目前在4.6星。", 4.6, "current_state_statement"),
    ("说明。\n\n目前2024年1月1日大盘平稳，市场在4.1星。", 4.1, "dated_current_statement"),
    ("说明。\n\n目前2023年12月29日大盘平稳，市场在4.1星。", None, None),
]


def test_more_observations_of_sentences(spark):
    rows = [(i, "指数估值数据", "# t\n" + t, DAY) for i, (t, _, _) in enumerate(SENTENCES)] + [(98, "美股指数估值数据", "# t\n目前在4.6星。", DAY), (99, "指数估值数据", None, DAY)]
    table = spark.createDataFrame(rows, "i int, title string, text string, publish_date date")
    got = {r["i"]: (r["star"], r["method"]) for r in evidence.observed(table, ["i"]).collect()}
    again = {r["i"]: r["o"] for r in table.select("i", evidence.observation(F.col("title"), F.col("text"), F.col("publish_date")).alias("o")).collect()}
    assert {i: tuple(o)[0:3:2] for i, o in again.items() if o} == got
    assert 98 not in got and 99 not in got
    for i, (t, star, method) in enumerate(SENTENCES):
        assert got.get(i) == (star and (star, method)), t


def test_candidates_leave_out_copies_and_repetitions(spark):
    rows = [("a", DAY, "49星", "目前4星半，目前4星半。", None, True), ("b", DAY, "t", "4.1星", "a", False), ("c", None, "t", "x", None, None), ("d", None, "t", "4.2星", "", None)]
    table = spark.createDataFrame(rows, "article_id string, publish_date date, title string, text string, duplicate_of string, is_canonical boolean")
    got = [(r["article_id"], r["star"], r["start"]) for r in evidence.ranked(evidence.candidates(table)).collect()]
    assert got == [("a", 4.5, 2), ("a", 4.5, 8), ("a", 4.9, 0), ("d", 4.2, 0)]
    assert ingest.counts(table).first()[:] == (4, 1, 1) and history.year_counts(table, "publish_date").count() == 2


def test_scales_verdicts_and_signs(spark):
    table = spark.createDataFrame([(1.0, 5.0, 1.0), (3.0, 5.0, 3.0), (None, 1.0, 1.0)], "a double, b double, w double")
    assert fit.mean_and_scale(table, ["a"], "w").first()[:] == ("a", 2.5, pytest.approx(np.sqrt(0.75)))
    with pytest.raises(Exception, match="no variance in b"):
        fit.mean_and_scale(table, ["a", "b"], "w").collect()
    scores = spark.createDataFrame([("core", 0.2), ("base", 0.1)], "model string, exact_mae double")
    assert fit.verdict(scores, "core", "base").first()[:] == ("core_model_does_not_beat_baseline", 0.2, 0.1, 2.0)
    models = spark.createDataFrame([([1.0, -1.0],), ([1.0, 1.0],), ([0.0, 0.0],)], "coefs array<double>")
    assert [r[0] for r in models.select(fit.signs_hold(models, [1, -1])).collect()] == [True, False, True]


def nonnegative(x, y, w, signs):
    """Weighted least squares over all sets of used features; the best with right signs."""
    best = None
    for use in itertools.chain.from_iterable(itertools.combinations(range(x.shape[1]), k) for k in range(x.shape[1] + 1)):
        a = np.column_stack([np.ones(len(y)), x[:, use]]) * np.sqrt(w)[:, None]
        beta = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0]
        if all(b * signs[i] >= -1e-12 for b, i in zip(beta[1:], use)):
            sse = ((a @ beta - y * np.sqrt(w)) ** 2).sum()
            if best is None or sse < best[0] - 1e-9:
                best = (sse, beta, use)
    return best


def test_grid_against_row_level_fits(spark):
    rng = np.random.RandomState(2)
    x, years = rng.rand(400, 3), rng.randint(2020, 2024, 400)
    y = 3 + x[:, 0] - x[:, 1] + rng.rand(400) / 5
    data = [("k", int(a), *map(float, b), float(c), float(c), float(c), float(c), 1.0) for a, b, c in zip(years, x, y)]
    data[5] = (*data[5][:3], None, *data[5][4:])
    table = spark.createDataFrame(data, "code string, year int, a double, b double, c double, target_mid double, star double, star_low double, star_high double, weight double")
    specs = {"abc": ["a", "b", "c"], "aac": ["a", "a", "c"]}
    got = {r["spec"]: r["exact_mae"] for r in screen.grid(table, key="code", period="year", specs=specs, signs=[1, -1, 1], folds=[(2021, 2022), (2022, 2023)]).collect()}
    errors = []
    for end, test in ((2021, 2022), (2022, 2023)):
        live = np.arange(400) != 5
        _, beta, use = nonnegative(x[(years <= end) & live], y[(years <= end) & live], np.ones(((years <= end) & live).sum()), [1, -1, 1])
        at = (years == test) & live
        errors.append(np.abs(beta[0] + x[at][:, use] @ beta[1:] - y[at]).mean())
    assert got["abc"] == pytest.approx(np.mean(errors), abs=1e-9) and got["aac"] > got["abc"]


def pooled(x, y, w):
    """Decreasing step values at distinct x by pooling neighbours that rise."""
    blocks = []
    for v in sorted(set(x)):
        at = x == v
        blocks.append([(y[at] * w[at]).sum() / w[at].sum(), w[at].sum(), [v]])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.array([v for b in blocks for v in b[2]]), np.array([b[0] for b in blocks for _ in b[2]])


def test_model_table_against_lines_and_pooling(spark):
    rng = np.random.RandomState(6)
    x, w, years = rng.randint(0, 40, 600) / 10, rng.rand(600) + 0.5, rng.randint(2020, 2022, 600)
    y = 5 - x + rng.randn(600) / 3
    table = spark.createDataFrame([(int(a), float(b), None, *[float(c)] * 4, float(d)) for a, b, c, d in zip(years, x, y, w)], "year int, x double, none double, target_mid double, star double, star_low double, star_high double, weight double")
    got = {r["model"]: r["exact_mae"] for r in screen.model_table(table, period="year", features=["x", "none"], isotonic=["x"], split=2020).collect()}
    train, test = years == 2020, years == 2021
    xs, ys = pooled(x[train], y[train], w[train])
    assert set(got) == {"linear:x", "isotonic:x"} and got["isotonic:x"] == pytest.approx(np.abs(np.interp(x[test], xs, ys) - y[test]).mean(), abs=1e-6)
    slope, level = np.polyfit(x[train], y[train], 1, w=np.sqrt(w[train]))
    assert got["linear:x"] == pytest.approx(np.abs(level + slope * x[test] - y[test]).mean(), abs=1e-9)


def test_windows_of_whole_years(spark):
    got = spark.range(1).select(incremental.decade_windows(F.lit(1994), F.lit("2016-08-03").cast("date")).alias("w")).first()["w"]
    assert [(w["from_date"].isoformat(), w["to_date"].isoformat()) for w in got] == [("1994-01-01", "2003-12-31"), ("2004-01-01", "2013-12-31"), ("2014-01-01", "2016-08-03")]
    assert spark.range(1).select(F.size(incremental.decade_windows(F.lit(2020), F.lit("2016-08-03").cast("date")))).first()[0] == 0


def test_consolidate_with_an_earlier_table(spark):
    loads = spark.createDataFrame([("985", "2024-01-01 17:00:00", 1, None, 7.0)], "code string, date string, seq int, a double, b double")
    old = spark.createDataFrame([("000985", "2024-01-02", 5.0, 6.0), ("000001", "2024-01-02", 1.0, None)], "code string, date string, a double, b double")
    got = incremental.consolidate(loads, ["code", "date"], "seq", ["date", "code"], existing=old, code="code", date="date")
    assert got.columns == ["date", "code", "a", "b"]
    assert sorted((r["code"], r["date"].isoformat(), r["a"], r["b"]) for r in got.collect()) == [("000001", "2024-01-02", 1.0, None), ("000985", "2024-01-02", 5.0, 7.0)]


def test_late_loads_of_a_stream_equal_the_batch(spark, tmp_path):
    schema = "k string, seq int, a int, b int"
    loads = [[("x", 3, 30, None), (None, 3, 1, 1)], [("x", 2, 20, 21), ("y", 1, None, 5)], [("x", 4, None, 41), (None, 2, 9, 9)]]
    for i, rows in enumerate(loads):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        refresh.refresh(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/at", spark.createDataFrame([], schema).schema).awaitTermination()
    got = refresh.current(spark, f"{tmp_path}/out", ["k"], "seq").collect()
    batch = incremental.coalesce_latest(spark.createDataFrame(sum(loads, []), schema), ["k"], "seq").collect()
    assert sorted(map(str, got)) == sorted(map(str, batch)) and {r["k"]: (r["a"], r["b"]) for r in got} == {"x": (30, 41), "y": (None, 5), None: (1, 1)}


def test_csv_keeps_a_mark_and_types(spark, tmp_path):
    io.write_csv(spark.createDataFrame([(DAY, 4.5)], "date date, star double").coalesce(1), f"{tmp_path}/a")
    io.write_csv(spark.createDataFrame([("x", "2024-01-02", "range")], "star string, date string, status string").coalesce(1), f"{tmp_path}/b")
    assert next((tmp_path / "a").glob("*.csv")).read_bytes()[:3] == b"\xef\xbb\xbf"
    got = io.read_label_files(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], "date date, star double")
    assert sorted((r["date"].day, r["star"], r["status"]) for r in got.collect()) == [(1, 4.5, None), (2, None, "range")]
    with pytest.raises(ValueError, match="expected 3 files"):
        spark.range(4).coalesce(1).write.parquet(f"{tmp_path}/p")
        io.read_parts(spark, f"{tmp_path}/p", 3)


def test_pages_and_broken_json(spark, tmp_path):
    html = "<meta name='og:title' content='no'><meta property='twitter:title' content='yes'><h1>one</h1><script>x</script><h1>two</h1><p>a<b>b</b></p>"
    assert ingest.parse_page(html)[:3] == ("yes", None, "one\ntwo\na\nb")
    assert ingest.parse_page("<title>t</title><h1>o<i>n</i>e</h1><h1>two</h1>")[0] == "o n e" and ingest.parse_page(None)[:3] == (None, None, "")
    (tmp_path / "a.json").write_text('{"text": "body", "date": "2024-01-01"}')
    (tmp_path / "b.json").write_text('{"text": ')
    (tmp_path / "c.json").write_text('["x"]')
    got = {r["relative_path"]: (r["text"], r["failed"]) for r in ingest.parsed(ingest.scan(spark, str(tmp_path))).collect()}
    assert got == {"a.json": ("body", False), "b.json": ("[PARSE_ERROR] malformed JSON", True), "c.json": ('["x"]', False)}


def test_index_and_bucketed_percentile(spark):
    docs = spark.createDataFrame([(1, "alpha", "x"), (2, None, "an Alphabet"), (3, "al", "pha"), (4, "alp pha lph", "")], "id int, title string, text string")
    built = search.index(docs, "id", ["title", "text"])
    assert [r["doc"] for r in search.search_index(built, docs, "ALPHA", doc="id").collect()] == [1, 2]
    assert search.search_index(built, docs, "al", doc="id").count() == 0
    hits = search.search_index(built, docs, "alpha", doc="id")
    assert {r["doc"]: r["snippet"] for r in search.described(hits, docs, doc="id", text="text", query="alpha", columns=["title"]).collect()}[2] == "an [Alpha]bet"
    rows = spark.createDataFrame([("k", DAY + dt.timedelta(200 * i), v) for i, v in enumerate([3.0, 1.0, 2.0, None, 2.0, 5.0, 0.0])], "k string, d date, v double")
    a = rolling.calendar_rank(rows, "k", "d", "v", 2, "r").orderBy("d").collect()
    b = rows.select("d", rolling.mid_rank("v", rolling.calendar_values("v", "k", "d", 2)).alias("r")).orderBy("d").collect()
    assert [r["r"] for r in a] == [r["r"] for r in b] and a[3]["r"] is None
