"""Long series, point-in-time members, model chains, stored search, merges and payloads against brute force."""

import datetime as dt
import json
import random
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import asof, fit, panels, ranges, rolling, screen, search, valuation
from panelwright.sources import io
from panelwright.streaming import refresh

DAY = dt.date(2024, 1, 1)


@pytest.mark.parametrize("keyed", [False, True])
def test_asof_over_ranges_equals_a_scan(spark, keyed):
    random.seed(5)
    at = lambda: None if random.random() < 0.03 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=random.choice([random.randint(0, 5000), 777]))
    key = lambda: random.choice(["a", "a", "a", "b", None])
    lefts = [(i, key(), at()) for i in range(900)] + [(1, "a", dt.datetime(2024, 1, 1, 0, 12, 57))] * 40
    rights = [(i, key(), at(), random.randint(0, 3)) for i in range(200)]
    left = spark.createDataFrame(lefts, "i int, k string, t timestamp")
    right = spark.createDataFrame(rights, "v int, k string, u timestamp, r int")
    got = asof.asof(left, right, "t", "u", keys=("k",) if keyed else (), tie=["r", "v"], values=["v", "r"], parts=7, most=50)
    assert got.columns == ["i", "k", "t", "v", "r"]

    def scan(k, t):
        have = [(u, r, v) for v, j, u, r in rights if u is not None and t is not None and u <= t and (not keyed or (j is not None and j == k))]
        return max(have)[2] if have else None

    want = sorted((i, str(k), str(t), scan(k, t)) for i, k, t in lefts)
    assert sorted(((r["i"], str(r["k"]), str(r["t"]), r["v"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert asof.asof(left.limit(0), right, "t", "u", tie=[], values=["v"]).count() == 0
    assert {r["v"] for r in asof.asof(left, right.limit(0), "t", "u", tie=[], values=["v"]).collect()} == {None}


def test_places_and_numbers_count_as_a_sort_does(spark):
    random.seed(6)
    values = [None, *[random.randint(0, 50) for _ in range(300)]]
    rows = spark.createDataFrame([(v, i, i % 2) for i, v in enumerate(values)], "v int, i int, k int")
    for cuts in ([], [10], [3, 7, 20, 21, 40], list(range(0, 50, 3))):
        got = rows.select("v", ranges.place(F.col("v"), cuts).alias("p")).collect()
        assert all(r["p"] == (0 if r["v"] is None else bisect_right(cuts, r["v"])) for r in got)
    for keys in ([], ["k"]):
        got = ranges.numbered(rows, keys, ["v", "i"], parts=5).collect()
        for k in {r["k"] if keys else None for r in got}:
            mine = sorted((r for r in got if not keys or r["k"] == k), key=lambda r: (r["v"] is not None, r["v"] or 0, r["i"]))
            assert [r["_n"] for r in mine] == list(range(len(mine)))


def test_chunks_with_halos_equal_whole_windows(spark):
    random.seed(7)
    values = [None if random.random() < 0.1 else float(random.randint(0, 30)) for _ in range(400)]
    rows = spark.createDataFrame([(i, v, "x" if i % 7 else None) for i, v in enumerate(values)], "t int, v double, k string")
    stats = {"mid": ("mid", 20, 5), "average": ("average", 33, 1), "median": (0.5, 12, 3), "high": (0.8, 12, 3)}
    for keys in ([], ["k"]):
        got = rolling.order_statistics(rows, keys, ["t"], "v", stats, chunk=40).collect()
        assert len(got) == len(values)
        for k in {r["k"] if keys else 0 for r in got}:
            mine = sorted((r for r in got if not keys or r["k"] == k), key=lambda r: r["t"])
            for i, r in enumerate(mine):
                for name, (kind, n, least) in stats.items():
                    have = [x["v"] for x in mine[max(0, i - n + 1) : i + 1] if x["v"] is not None]
                    want = None
                    if len(have) >= least and (not isinstance(kind, str) or r["v"] is not None):
                        less, same = sum(x < r["v"] for x in have) if r["v"] is not None else 0, sum(x == r["v"] for x in have)
                        want = float(np.quantile(have, kind)) if not isinstance(kind, str) else (less + (same + (kind == "average")) / 2) / len(have)
                    assert (r[name] is None) == (want is None) and (want is None or abs(r[name] - want) < 1e-12)
    summed = ranges.over_chunks(rows, [], ["t"], 30, lambda w: {"s": F.sum("v").over(w.rowsBetween(-29, 0)), "l": F.lag("v", 29).over(w)}, chunk=30).collect()
    for r in summed:
        have = [v for v in values[max(0, r["t"] - 29) : r["t"] + 1] if v is not None]
        assert r["s"] == (sum(have) if have else None) and r["l"] == (values[r["t"] - 29] if r["t"] >= 29 else None)
    with pytest.raises(ValueError):
        ranges.with_halos(rows, "t", 30, 29)


def test_members_come_and_go(spark):
    random.seed(8)
    day = lambda n: DAY + dt.timedelta(n)
    rows = [(i, random.choice(["a", "b", None]), None if random.random() < 0.05 else day(random.randint(0, 400))) for i in range(300)]
    spans = [(random.choice(["a", "b", None]), random.choice(["x", "y"]), random.choice([None, day(random.randint(-50, 300))]), random.choice([None, day(random.randint(0, 450))])) for _ in range(25)]
    values = spark.createDataFrame(rows, "i int, k string, d date")
    got = valuation.members_at(values, spark.createDataFrame(spans, "k string, g string, s date, e date"), key="k", group="g", date="d", start="s", end="e", days=30)
    inside = lambda d, s, e: (s is None or d >= s) and (e is None or d < e) and (s is None or e is None or s < e)
    want = sorted({(i, g) for i, k, d in rows for j, g, s, e in spans if k is not None and k == j and d is not None and inside(d, s, e)})
    assert sorted((r["i"], r["g"]) for r in got.select("i", "g").collect()) == want


def test_non_negative_fits_of_twelve_factors_meet_their_conditions(spark):
    rng = np.random.RandomState(9)
    x = rng.randn(400, 12) @ rng.randn(12, 12)
    signs = rng.choice([-1, 1], 12)
    y = x @ (rng.randn(12) * signs * (rng.rand(12) > 0.4)) + rng.randn(400) + 7
    row = {"sw": 400.0} | {f"s{i}": c.sum() for i, c in enumerate([*x.T, y])} | {f"p{i}_{j}": float(np.dot(a, b)) for i, a in enumerate([*x.T, y]) for j, b in enumerate([*x.T, y]) if i <= j}
    intercept, coefs, sse = fit.solve(row, 12, list(signs))
    b = np.array(coefs)
    left = y - intercept - x @ b
    gain = ((x - x.mean(axis=0)).T @ left) * signs
    assert (b * signs >= 0).all() and abs(left.sum()) < 1e-6 and abs(sse - left @ left) < 1e-6
    assert np.abs(gain[b != 0]).max() < 1e-6 and (gain[b == 0] < 1e-6).all()
    # Least squares on the rows themselves, with the same factors, is the same fit.
    used = np.flatnonzero(b)
    design = np.column_stack([np.ones(400), x[:, used]])
    assert np.allclose(np.linalg.lstsq(design, y, rcond=None)[0], [intercept, *b[used]])


def test_a_cube_of_products_gives_the_moments_of_any_choice(spark):
    random.seed(10)
    value = lambda: None if random.random() < 0.2 else random.random()
    rows = spark.createDataFrame([(i % 2, value(), value(), value(), value(), 1.0 + i % 3) for i in range(200)], "g int, a double, b double, c double, y double, w double")
    cube = fit.gram(rows, ["g"], ["a", "b", "c"], "y", "w")
    got = fit.sub_moments(cube, ["g"], ["a", "b", "c"], {"ca": ["c", "a"], "ab": ["a", "b"]})
    for name, features in (("ca", ["c", "a"]), ("ab", ["a", "b"])):
        want = {r["g"]: r for r in fit.moments(rows, ["g"], features, "y", "w").collect()}
        mine = got.where(F.col("spec") == name).groupBy("g").agg(*[F.sum(c).alias(c) for c in got.columns if c not in ("g", "spec")])
        for r in mine.collect():
            assert all(abs(r[c] - want[r["g"]][c]) < 1e-9 for c in want[r["g"]].asDict() if c != "g")


def test_isotonic_curves_of_groups_equal_pooling_in_one_go(spark):
    random.seed(11)
    data = [(g, float(random.randint(0, 40)), random.gauss(-g, 1), random.choice([0.0, 0.5, 2.0])) for g in (1, 2) for _ in range(150)]
    rows = spark.createDataFrame(data, "g int, x double, y double, w double")
    curve = fit.isotonic(rows, ["g"], "x", "y", "w", parts=6)
    for g in (1, 2):
        level = {}
        for k, x, y, w in data:
            if k == g and w > 0:
                a = level.setdefault(x, [0.0, 0.0])
                a[0], a[1] = a[0] + w, a[1] + w * y
        xs = sorted(level)
        means = [(level[x][0], level[x][1]) for x in xs]
        # The greatest mean of a span to the right, least over starts: the minimax form of the fit.
        want = [min(max(sum(m[1] for m in means[i : j + 1]) / sum(m[0] for m in means[i : j + 1]) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))]
        asked = spark.createDataFrame([(g, x) for x in xs] + [(g, -5.0), (g, 99.0), (g, None), (7, 1.0)], "g int, x double")
        got = {(r["g"], r["x"]): r["prediction"] for r in fit.on_curve(asked, curve, ["g"], "x").collect()}
        assert np.allclose([got[g, x] for x in xs], want)
        assert got[g, -5.0] == pytest.approx(want[0]) and got[g, 99.0] == pytest.approx(want[-1]) and got[g, None] is None and got[7, 1.0] is None


def test_stored_search_reads_its_folders_and_ranks_alike(spark, tmp_path):
    random.seed(12)
    words = ["alpha", "alphabet", "beta", "gamma", "ALPHA", "delta"]
    data = [(i, random.choice([None, "", random.choice(words)]), None if i % 17 == 0 else " ".join(random.choices(words, k=random.randint(0, 12)))) for i in range(120)]
    data += [(500, "", "x İstanbul y"), (501, "", "aaaaaa")]
    docs = spark.createDataFrame(data, "id long, title string, text string")
    path = str(tmp_path / "index")
    search.store_index(docs, "id", ["title", "text"], path, buckets=16, block=8)
    built = search.index(docs, "id", ["title", "text"])
    for phrase in ("a alph", "ALPHABET", "zzz", "al", "aaaa"):
        want = [(r["doc"], round(r["rank"], 9)) for r in search.search_index(built, docs, phrase, doc="id", limit=10).collect()]
        got = search.search_stored(spark, path, phrase, limit=10, first=2)
        assert [(r["doc"], round(r["rank"], 9)) for r in got.collect()] == want
    assert [r["doc"] for r in search.search_stored(spark, path, "nbul").collect()] == [500] == [r["doc"] for r in search.search(docs, "nbul", doc="id", text="text").collect()]
    # A word's trigrams are in three folders at most, and no other is read.
    wanted = {r[0] for r in spark.createDataFrame([("alp",), ("lph",), ("pha",)], "t string").select(search.bucket_of(F.col("t"), 16)).collect()}
    read = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(*wanted)).select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    seen = {int(r["f"].split("bucket=")[1].split("/")[0]) for r in read}
    assert seen == wanted and len(list((tmp_path / "index" / "postings").glob("bucket=*"))) > 3


def test_best_snippets_against_brute_force(spark):
    random.seed(13)
    texts = [None, "", "the", "x" * 100, "The THE tHe", "the" * 40, " ".join(random.choices(["the", "other", "a", "thethe", "xx"], k=200)), "a" * 60 + " the"] + ["".join(random.choices("the xyz", k=random.randint(1, 150))) for _ in range(40)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(search.best_snippet(F.col("t"), "The")).collect()]

    def brute(text):
        low, n = (text or "").lower(), len(text or "")
        hits = [i for i in range(n) if low.startswith("the", i)]
        if not hits:
            return None
        whole = lambda a: [b for b in hits if b >= a and b + 3 <= a + 34]
        start = max(hits, key=lambda a: (len(whole(a)), -a))
        begin = max(min(start - max((34 - (whole(start)[-1] + 3 - start)) // 2, 0), n - 34), 0)
        end = min(begin + 34, n)
        inside = [b for b in hits if b >= begin and b + 3 <= end]
        cov = lambda i: any(b <= i < b + 3 for b in inside)
        body = "".join(("[" if cov(i) and not cov(i - 1) else "") + text[i] + ("]" if cov(i) and not cov(i + 1) else "") for i in range(begin, end))
        return (" … " if begin > 0 else "") + body + (" … " if end < n else "")

    assert got == [brute(t) for t in texts]


def test_merges_equal_the_batch_and_touch_their_parts(spark, tmp_path):
    random.seed(14)
    loads = [(random.choice([None, *range(30)]), s, random.choice([None, random.random()]), random.choice([None, "u", "v"])) for s in range(200)]
    table = spark.createDataFrame(loads, "k int, s long, a double, b string")
    target = str(tmp_path / "target")
    for part in (table.where("s >= 120"), table.where("s < 150"), table.where("s < 150"), table.limit(0)):
        refresh.merge_batch(target, part, ["k"], "s", parts=8)
    want = {}
    for k, s, a, b in loads:
        row = want.setdefault(k, {})
        row |= {n: v for n, v in (("a", a), ("b", b)) if v is not None}
    assert {r["k"]: {n: r[n] for n in ("a", "b") if r[n] is not None} for r in refresh.merged(spark, target).collect()} == want
    one = spark.createDataFrame([(5, 900, 9.0, None)], table.schema)
    before = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "target").glob("part=*")}
    touched = refresh.merge_batch(target, one, ["k"], "s", parts=8)
    after = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "target").glob("part=*")}
    assert len(touched) == 1 and [p for p in before if before[p] != after[p]] == [f"part={touched[0]}"]
    assert refresh.merged(spark, target).where("k = 5").first()["a"] == 9.0
    source = tmp_path / "source"
    table.write.parquet(str(source))
    for _ in range(2):
        refresh.refresh_merged(spark, str(source), str(tmp_path / "streamed"), str(tmp_path / "check"), table.schema, ["k"], "s", parts=4).awaitTermination()
    assert {r["k"]: {n: r[n] for n in ("a", "b") if r[n] is not None} for r in refresh.merged(spark, str(tmp_path / "streamed")).collect()} == want


def test_checks_are_counted_while_tables_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("985", "2024-01-01", 1.0), ("1000002", "2024-01-01", 2.0)], "code string, date string, v double")
    names = {"000985": "a", "1000002": "b"}
    panel = panels.write_series(rows, names, str(tmp_path / "a"))
    assert {r["name"] for r in panel.collect()} == {"a", "b"} and panel.columns == ["code", "date", "v", "name"]
    with pytest.raises(ValueError, match="unknown code: 1"):
        panels.write_series(rows, {"000985": "a"}, str(tmp_path / "b"))
    with pytest.raises(ValueError, match="repeated date: 2"):
        panels.write_series(rows.union(rows), names, str(tmp_path / "c"))
    target = spark.createDataFrame([(DAY, 4.0, "exact")], "date date, star double, status string")
    assert panels.write_model_rows(panel, target, str(tmp_path / "d"), "code").count() == 2
    with pytest.raises(ValueError, match="several labels"):
        panels.write_model_rows(panel, target.union(target), str(tmp_path / "e"), "code")
    with pytest.raises(ValueError, match="expected 4"):
        panels.write_model_rows(panel, target.union(spark.createDataFrame([(dt.date(2024, 1, 2), 4.0, "exact")], target.schema)), str(tmp_path / "f"), "code")
    assert panels.write_series(rows.limit(0), names, str(tmp_path / "g")).count() == 0
    assert panels.write_model_rows(panel.limit(0), target, str(tmp_path / "h"), "code").count() == 0
    with pytest.raises(ValueError, match="several labels"):
        panels.write_model_rows(panel.limit(0), target.union(target), str(tmp_path / "i"), "code")


def test_payloads_whose_fields_differ(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"a": 1, "b": {"c": 2.5, "d": "x"}}, {"b": {"c": 3}, "odd name": [1, 2]}]}))
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"a": "one", "b": {"d": None}}, {}]}))
    (tmp_path / "c.json").write_text("no json")
    (tmp_path / "d.json").write_text(json.dumps({"other": 1}))
    table = io.read_variant(spark, str(tmp_path / "*.json"))
    fields = io.variant_fields(table)
    assert fields["a"] == "string" and set(fields) == {"a", "b.c", "b.d", "odd name"}
    got = io.flattened_variant(table).collect()
    assert sorted(str(r["a"]) for r in got) == ["1", "None", "None", "one"]
    assert sorted(float(r["b.c"]) for r in got if r["b.c"] is not None) == [2.5, 3.0] and [r["b.d"] for r in got if r["b.d"] is not None] == ["x"]
    assert [r["odd name"] for r in got if r["odd name"] is not None] == ["[1,2]"]


def test_ratios_are_guarded(spark):
    panel = spark.createDataFrame([(10.0, 2.0, 4.0, 5.0, 3.0, 6.0), (10.0, 0.0, -1.0, 5.0, 3.0, 0.0), (10.0, None, 4.0, -5.0, None, 6.0)], "mc double, gdp double, bond double, `pe.ew` double, fb double, om double")
    got = valuation.derived_ratios(panel, gdp="gdp", bond="bond", caps={"mc_to_gdp": "mc"}, earnings={"ew": "pe.ew"}, balances={"fb_to_om": ("fb", "om")}).collect()
    names = ("mc_to_gdp", "earnings_yield_ew", "equity_bond_ratio_ew", "equity_bond_spread_ew", "fb_to_om")
    assert [tuple(r[n] for n in names) for r in got] == [(5.0, 0.2, 0.05, -3.8, 0.5), (None, 0.2, None, None, None), (None, None, None, None, None)]


def test_the_best_of_a_grid_is_refitted_and_judged(spark):
    rng = np.random.RandomState(15)
    data = [(k, 2000 + i // 40, *map(float, x), float(2 + 3 * x[0] + rng.randn() * 0.05), 1.0) for k in ("p", "q") for i, x in enumerate(rng.rand(200, 3))]
    rows = spark.createDataFrame(data, "k string, y int, a double, b double, c double, star double, weight double")
    rows = rows.withColumns({"target_mid": F.col("star"), "star_low": F.col("star") - 0.1, "star_high": F.col("star") + 0.1})
    grid = screen.grid(rows, key="k", period="y", specs={"bc": ["b", "c"], "ac": ["a", "c"]}, signs=[1, 1], folds=[(2000, 2001), (2001, 2002)])
    key, spec = screen.best_spec(grid)
    assert spec == "ac" and screen.best_spec(grid.limit(0)) is None
    tested = screen.refitted(rows, key="k", period="y", chosen=key, models={"core": (["a", "c"], [1, 1]), "baseline": (["b"], [1])}, split=2002)
    said = fit.verdict(tested, "core", "baseline").first()
    assert said["verdict"] == "core_model_beats_baseline" and said["ratio"] < 0.2


def test_columns_far_from_zero_keep_their_digits(spark):
    rng = np.random.RandomState(16)
    x, z = 1e9 + rng.rand(300), 5e8 + rng.rand(300)
    y = 3e9 + 2 * x - 1.5 * z + rng.randn(300) * 1e-3
    rows = spark.createDataFrame([(1, float(a), float(b), float(c), 1.0 + i % 2) for i, (a, b, c) in enumerate(zip(x, z, y))], "g int, x double, z double, y double, w double")
    shift = fit.centres(rows, ["x", "z", "y"])
    model = fit.fitted(fit.moments(rows, ["g"], ["x", "z"], "y", "w", shift), ["g"], ["x", "z"], shift=lambda _: list(shift.values()))
    assert np.allclose(model.first()["coefs"], [2, -1.5], atol=2e-3)
    cube = fit.sub_moments(fit.gram(rows, ["g"], ["x", "z"], "y", "w", shift), ["g"], ["x", "z"], {"zx": ["z", "x"]})
    model = fit.fitted(cube, ["g", "spec"], ["f0", "f1"], [-1, 1], lambda row: [shift["z"], shift["x"], shift["y"]]).withColumns({"f0": F.lit(float(z[0])), "f1": F.lit(float(x[0]))})
    assert np.allclose(model.first()["coefs"], [-1.5, 2], atol=2e-3) and abs(model.select(fit.predicted(["f0", "f1"])).first()[0] - y[0]) < 0.01


def test_postings_and_stored_blocks_of_odd_texts(spark, tmp_path):
    texts = ["abcabc", None, "", "ab", "ABC İx", "\U0001f600ab\U0001f600ab", "abc" * 400, "abcabc"]
    docs = spark.createDataFrame([(min(i, 6), t) for i, t in enumerate(texts)], "id long, text string")
    # Without explode and groupBy as the SQL has it: nothing is shuffled.
    posted = search.postings(docs, "id", "text")
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()
    low = [(i, docs_text) for i, docs_text in [(r["id"], r["t"]) for r in docs.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("t")).collect()]]
    want = {}
    for i, t in low:
        for k in range(len(t) - 2):
            ids, n = want.setdefault(t[k : k + 3], (set(), [0]))
            ids.add(i)
            n[0] += 1
    got = {r["term"]: (r["docs"], r["occurrences"]) for r in search.term_counts(docs, "id", posted).collect()}
    assert got == {t: (len(ids), n[0]) for t, (ids, n) in want.items()}
    named = search.term_counts(docs, "id", search.postings(docs, "id", "text", search.words(F.col("text")))).where("term = 'abcabc'").first()
    assert (named["docs"], named["occurrences"]) == (2, 2)
    # Places come back from the store, and it writes no posting twice.
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    search.store_index(rows, "id", ["text"], str(tmp_path / "index"), buckets=4, block=2)
    stored = spark.read.parquet(str(tmp_path / "index" / "postings"))
    ids = {(r["block"], i): d for r in stored.where("bucket = -1").collect() for i, d in enumerate(r["ids"])}
    places = {(ids[r["block"], r["at"]], r["term"]): r["places"] for r in search.unpacked(stored.where("bucket >= 0")).collect()}
    every = {}
    for i, (_, t) in enumerate(low):
        for k in range(len(t) - 2):
            every.setdefault((i, t[k : k + 3]), []).append(k)
    assert places == every and set(ids.values()) == set(range(len(texts)))
    assert [r["doc"] for r in search.search_stored(spark, str(tmp_path / "index"), "bcab", limit=1, first=1).collect()] == [r["doc"] for r in search.search(rows, "bcab", doc="id", text="text", limit=1).collect()]


def test_frames_and_pools_of_many_groups_without_a_call_each(spark):
    random.seed(15)
    data = [(i, None if random.random() < 0.2 else round(random.uniform(1, 9), 2)) for i in range(60)]
    rows = spark.createDataFrame(data, "t int, v double")
    stats = {"f": ("first", 4, 4), "s": ("sum", 5, 3), "m": ("mean", 7, 2), "h": ("max", 6, 1)}
    got = {r["t"]: r for r in rolling.order_statistics(rows, [], ["t"], "v", stats, chunk=7).collect()}
    for i in range(60):
        frame = lambda n: [v for _, v in data[max(i - n + 1, 0) : i + 1] if v is not None]  # noqa: B023, E731
        want = (data[i - 3][1] if i > 2 else None, sum(frame(5)) if len(frame(5)) >= 3 else None, sum(frame(7)) / len(frame(7)) if len(frame(7)) >= 2 else None, max(frame(6), default=None))
        assert all((a is None and b is None) or a == pytest.approx(b) for a, b in zip((got[i]["f"], got[i]["s"], got[i]["m"], got[i]["h"]), want))
    # A group's rows may go on over batches, and a float key may be no number.
    many = spark.range(4000).select((F.col("id") % 5).cast("double").alias("g"), (F.col("id") % 800).cast("double").alias("x"), F.rand(1).alias("y"), F.lit(1.0).alias("w"))
    many = many.withColumn("g", F.when(F.col("g") == 4, float("nan")).otherwise(F.col("g")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    curve = fit.isotonic(many, ["g"], "x", "y", "w", parts=3)
    assert "FlatMapGroups" not in curve._jdf.queryExecution().executedPlan().toString()
    steps = curve.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("x_from", "x_to", "value"))).alias("s")).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(steps) == 5
    for r in steps:
        values = [s["value"] for s in r["s"]]
        assert values == sorted(values, reverse=True) and all(a["x_to"] < b["x_from"] for a, b in zip(r["s"], r["s"][1:]))
