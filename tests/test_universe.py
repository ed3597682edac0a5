"""Undone membership, html tables, guards, file sets, lists, resumed scoring and balanced folds against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import folds, models
from eventloom.operators import universe as U
from eventloom.sources import filesets
from eventloom.sources import tables as T
from eventloom.streaming import scoring

DAY = dt.date


def day(k):
    return DAY(2020, 1, 1) + dt.timedelta(k)


# ---- membership ----


def walk_back(today, changes, start, end):
    """date -> members for each business day, by undoing the log a day at a time."""
    state, history, first = set(today), {}, False
    for d in sorted({c[0] for c in changes}, reverse=True):
        if start <= d <= end:
            history[d] = set(state)
            first = first or d == start
        if d < start:
            break
        for _, _, added, removed in sorted((c for c in changes if c[0] == d), key=lambda c: c[1]):
            if added:
                state.discard(added)
            if removed:
                state.add(removed)
    if not first:
        history[start] = set(state)
    out, now = set(), set()
    d = start
    while d <= end:
        now = history.get(d, now)
        out |= {(d, t) for t in now if d.weekday() < 5}
        d += dt.timedelta(1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_undone_membership(spark, seed):
    r = random.Random(seed)
    names = [f"t{k}" for k in range(12)]
    today = r.sample(names, 5) + ["always"]
    changes = [(day(r.randint(-20, 120)), k, r.choice([*names, None]), r.choice([*names, None])) for k in range(60)]
    changes += [(day(30), 100, "t0", "t0"), (day(0), 101, "t1", None), (day(90), 102, None, "t2")]
    log = spark.createDataFrame(changes, "date date, seq int, added string, removed string")
    spans = U.undone(spark.createDataFrame([(t,) for t in [*today, today[0]]], "ticker string"), log, str(day(0)), str(day(90)))
    grid = U.business_day_grid(spans, str(day(90)))
    got = [tuple(x) for x in grid.collect()]
    assert len(got) == len(set(got)) and set(got) == walk_back(today, changes, day(0), day(90))


def test_contradictions(spark):
    changes = [(day(10), 0, "a", None), (day(20), 0, "a", None), (day(30), 0, "b", None), (day(40), 0, None, "c")]
    log = spark.createDataFrame(changes, "date date, seq int, added string, removed string")
    spans = U.undone(spark.createDataFrame([("a",), ("c",)], "ticker string"), log, str(day(0)), str(day(60))).collect()
    # a is added twice, so it wasn't there between; b is added but isn't on the list; c is removed and on it
    assert sorted((s.ticker, s.valid_from, s.valid_to, s.contradictions) for s in spans) == [("a", day(20), None, 1), ("c", day(0), None, 1)]


# ---- tables in pages ----


def test_page_tables():
    html = """<p>x</p><table><thead><tr><th rowspan=2>Date</th><th colspan="2">Added</th><th colspan=2>Removed</th></tr><tr><th>Ticker</th><th>Security<th>ticker</th><th></th></tr></thead>
      <tr><td rowspan="2">June 3, 2020</td><td>AA.B</td><td>A &amp; B<br>Co</td><td>C</td></tr><tr><td>D</td><td><b>D</b> Inc</td><td></td><td>z</td><td>more</td></tr></table>
      <table><tr><td colspan=0>1</td><td rowspan=0>2</td></tr><tr><td>3</td></table><table></table><table><tr><th>only</th></tr></table>"""
    first, second, third, fourth = T.page_tables(html)
    assert first[1] == ["Date", "Added_Ticker", "Added_Security", "Removed_ticker", "Removed", ""]
    assert first[2] == [["June 3, 2020", "AA.B", "A & B Co", "C", "", ""], ["June 3, 2020", "D", "D Inc", "", "z", "more"]]
    assert second[1:] == (["", ""], [["1", "2"], ["3", "2"]]) and third[1:] == ([], []) and fourth[1:] == (["only"], [])


@pytest.mark.parametrize("html", [None, "", "no table", "<td>lost</td>", "<table><tr><td>open", "<table><table><tr><td>in</td></table></td></table>", "<table><tr><td rowspan=x colspan=-3>a"])
def test_odd_pages(html):
    found = list(T.page_tables(html))
    assert [c for _, _, rows in found for row in rows for c in row if c] == [w for w in ("open", "in", "a") if html and f"<td>{w}" in html or html and html.endswith(f">{w}")]


def test_change_log(spark):
    page = "<table><tr><th>Effective Date</th><th colspan=2>Added</th><th>Removed Symbol</th></tr><tr><th>Effective date</th><th>Ticker</th><th>Security</th><th>Removed symbol</th></tr>{}</table>"
    rows = "<tr><td>June 3, 2020</td><td>BRK.B</td><td>x</td><td></td></tr><tr><td>2020-06-04</td><td> </td><td></td><td>C</td></tr><tr><td>soon</td><td>D</td><td></td><td></td></tr>"
    pages = spark.createDataFrame([(1, page.format(rows)), (2, page.format("")), (3, None)], "page long, html string")
    got = T.change_log(T.html_tables(pages, "page")).collect()
    assert sorted((r.date, r.added, r.removed) for r in got) == [(DAY(2020, 6, 3), "BRK-B", None), (DAY(2020, 6, 4), None, "C")]
    other = spark.createDataFrame([(1, "<table><tr><th>Date</th><th>Added ticker</th></tr><tr><td>2020-06-04</td><td>x</td></tr></table>")], "page long, html string")
    with pytest.raises(Exception, match="lacks a date"):
        T.change_log(T.html_tables(other, "page")).collect()


# ---- look-ups ----


def snapshots(spark, every, n=5):
    return spark.createDataFrame([(day(every * k), t) for k in range(n) for t in ("a", "b")[: 1 + k % 2]], "snapshot date, ticker string")


def test_cadence(spark):
    for every, want in ((1, 7), (7, 7), (8, 65), (31, 65)):
        assert U.tolerance_days(snapshots(spark, every)) == want
    assert U.tolerance_days(snapshots(spark, 1, 1)) == U.tolerance_days(snapshots(spark, 1, 0)) == 65
    rows = spark.createDataFrame([(k, day(k), t) for k in range(-3, 130) for t in "ab"] + [(999, None, "a"), (998, day(3), None)], "id int, date date, ticker string")
    daily = {(r.id, r.ticker) for r in U.members_by_cadence(rows, snapshots(spark, 1), "date").collect()}
    assert daily == {(k, t) for k in range(0, 12) for t in "ab" if t == "a" or k in (1, 3)}
    monthly = {(r.id, r.ticker) for r in U.members_by_cadence(rows, snapshots(spark, 31, 2), "date").collect()}
    assert monthly == {(k, t) for k in range(0, 97) for t in "ab" if t == "a" or k >= 31}


def test_a_look_up_after_the_horizon_fails(spark):
    u = snapshots(spark, 10)
    ask = lambda *ks: spark.createDataFrame([(day(k),) for k in ks], "date date")
    got = {(r.date, r.ticker) for r in U.members_at(u, ask(-400, -1, 0, 10, 19, 60), str(day(60))).collect()}
    assert got == {(day(0), "a"), (day(10), "a"), (day(10), "b"), (day(19), "a"), (day(19), "b"), (day(60), "a")}
    with pytest.raises(Exception, match="after what is known"):
        U.members_at(u, ask(5, 61), str(day(60))).collect()
    checks = {r.check: (r["rows"], r.violations, r.passed) for r in U.defence(u, ask(-400, -1, 5, 10, 61, 99), str(day(60))).collect()}
    assert checks == {"future": (2, 0, True), "ancient": (2, 0, True), "known": (3, 0, True)}


# ---- file sets and lists ----


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_file_set(spark, tmp_path):
    path = str(tmp_path / "prices")
    rows = [(t, day(k), c, v) for t in ("A", "B", "C") for k, (c, v) in enumerate([(1.0, 5.0), (0.0, 5.0), (2.0, 0.0), (None, 5.0), (3.0, None), (4.0, 1.0)])]
    filesets.write_tickers(spark.createDataFrame(rows, "ticker string, date date, close double, volume double"), path)
    found = filesets.read_tickers(spark, path, ["A", "C", "missing"])
    assert sorted((r.ticker, r.close) for r in found.collect()) == [("A", 1.0), ("A", 4.0), ("C", 1.0), ("C", 4.0)]
    assert "PartitionFilters: [" in plan(found) and "ticker" in plan(found).split("PartitionFilters: [")[1].split("]")[0]
    assert filesets.read_tickers(spark, path, ["A"], "returns").count() == 4 and filesets.read_tickers(spark, path, ["A"], first=str(day(1)), last=str(day(5))).count() == 1
    for tickers, missing in ((["A", "nobody"], "fail"), (["nobody"], "skip")):
        with pytest.raises(FileNotFoundError):
            filesets.read_tickers(spark, path, tickers, missing=missing)
    filesets.write_tickers(spark.createDataFrame([("A", day(9), 9.0, 9.0)], "ticker string, date date, close double, volume double"), path)
    assert filesets.read_tickers(spark, path, ["A", "B"]).groupBy("ticker").count().orderBy("ticker").collect() == [("A", 1), ("B", 2)]


@pytest.mark.parametrize("limit", [1 << 16, 10])
def test_list_scan(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(filesets, "LIST_KEYS", limit)
    path = str(tmp_path / "rows")
    spark.range(20_000).selectExpr("id", "id % 5000 as k").union(spark.sql("select -1L, cast(null as long)")).write.parquet(path)
    rows = spark.read.parquet(path)
    wanted = [3, 77, 77, 4999, 10**9, None] + list(range(500, 900))
    found = filesets.list_scan(rows, spark.createDataFrame([(k,) for k in wanted], "k long"), "k")
    assert sorted(r.id for r in found.collect()) == [i for i in range(20_000) if i % 5000 in set(wanted)]
    assert "GreaterThanOrEqual(k,3)" in plan(found) and found.columns == rows.columns
    assert filesets.list_scan(rows, spark.createDataFrame([(None,)], "k long"), "k").count() == 0


# ---- resumed scoring ----


def test_a_killed_run_continues(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(40).withColumn("text", F.concat(F.lit("t"), "id")).repartition(8).write.parquet(source)
    calls = []

    def scorer(dies_at=None, down=lambda: F.lit(False)):
        def score(batch):
            calls.append(batch.count())
            if dies_at is not None and len(calls) > dies_at:
                # the rows are written, then the process is lost before the batch is committed
                scoring._put(batch.select("id", "text", F.lit(-1).alias("score"), F.lit("lost").alias("error")), f"{out}/tries", "new-000000002")
                raise RuntimeError("killed")
            return batch.select("id", "text", F.when(~down(), F.length("text")).alias("score"), F.when(down(), F.lit("no answer")).alias("error"))

        return score

    with pytest.raises(Exception, match="killed"):
        scoring.score_new_files(spark, source, "id long, text string", out, scorer(dies_at=2), files=2)
    assert len(calls) == 3
    odd = scorer(down=lambda: F.col("id") % 10 == 3)
    scoring.score_new_files(spark, source, "id long, text string", out, odd, files=2)
    assert len(calls) == 5  # four batches, one of them twice
    good, bad = scoring.results(spark, out, "id")
    ids = sorted(r.id for r in good.collect()) + sorted(r.id for r in bad.collect())
    assert sorted(ids) == list(range(40)) and all(r.score == len(r.text) for r in good.collect())
    failed = bad.count()
    assert scoring.retry_failures(spark, out, "id", scorer(down=lambda: F.col("id") == 33)) == failed
    good, bad = scoring.results(spark, out, "id")
    assert good.count() + bad.count() == 40 and bad.count() <= 1
    scoring.retry_failures(spark, out, "id", scorer())
    assert scoring.results(spark, out, "id")[0].count() == 40 and scoring.retry_failures(spark, out, "id", scorer()) == 0
    # nothing new: no batch is scored again; new files are
    n = len(calls)
    scoring.score_new_files(spark, source, "id long, text string", out, scorer(), files=2)
    assert len(calls) == n
    spark.range(40, 43).withColumn("text", F.lit("x")).coalesce(1).write.mode("append").parquet(source)
    scoring.score_new_files(spark, source, "id long, text string", out, scorer(), files=2)
    assert scoring.results(spark, out, "id")[0].count() == 43


# ---- folds ----


@pytest.mark.parametrize("sizes", [[5, 5, 5, 5, 5, 5], [9, 1, 1, 1, 7, 3, 3], [4], [1] * 20 + [30]])
def test_balanced_folds(spark, sizes):
    rows = [(f"g{k:02}" if k else None, i) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(3)
    got = {r.g: (r.size, r.fold) for r in folds.balanced_folds(df, "g", 3).collect()}
    load, want = [0, 0, 0], {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = load.index(min(load))
        want[f"g{k:02}" if k else None] = (sizes[k], at)
        load[at] += sizes[k]
    assert got == want
    with_fold = folds.with_fold(df, "g", 3)
    assert with_fold.count() == len(rows) and with_fold.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_out_of_fold_uses_whole_groups(spark):
    r = random.Random(3)
    rows = [(k, f"g{k % 7}", r.random(), float(k % 2)) for k in range(210)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    scored = models.out_of_fold(df, ["x"], "y", "logistic", "g", 3, balanced=True)
    assert scored.count() == 210 and scored.columns == ["id", "g", "x", "y", "p"]
    folded = folds.with_fold(df, "g", 3)
    fitted = models.fit(folded.where("fold != 1"), ["x"], "y", "logistic")
    want = models.predict(fitted, folded.where("fold = 1"), "logistic").select("id", F.col("p").alias("want"))
    assert want.count() >= 60 and scored.join(want, "id").where("abs(p - want) > 1e-9").count() == 0


# ---- month grids and capital ----


def test_month_grid_fills_from_the_first_snapshot(spark):
    u = spark.createDataFrame([(DAY(2020, 3, 15), "a"), (DAY(2020, 3, 15), "b"), (DAY(2020, 5, 31), "c"), (DAY(2020, 6, 2), "d"), (DAY(2020, 6, 20), "e")], "snapshot date, ticker string")
    got = sorted((r.month_end, r.ticker) for r in U.filled_month_grid(u, "2020-01-31", "2020-07-30").collect())
    want = [(DAY(2020, m, d), t) for m, d, ts in ((1, 31, "ab"), (2, 29, "ab"), (3, 31, "ab"), (4, 30, "ab"), (5, 31, "c"), (6, 30, "e")) for t in ts]
    assert got == want
    assert U.filled_month_grid(u.limit(0), "2020-01-31", "2020-07-30").count() == 0
    gap = U.static_months(u, "x", "2020-01-31").collect()
    assert [(g.period_start, g.period_end) for g in gap] == [(DAY(2020, 1, 31), DAY(2020, 3, 14))] and not U.static_months(u, "x", "2020-03-15").count()


def test_capital_buckets(spark):
    members = [f"m{k:02}" for k in range(10)]
    u = spark.createDataFrame([(day(5), t) for t in members] + [(day(50), "other")], "snapshot date, ticker string")
    prices = spark.createDataFrame([(t, day(1), 1.0 + k) for k, t in enumerate(members)] + [("m00", day(9), 1000.0), ("m09", day(10), 0.0), ("out", day(2), 4.5), ("other", day(60), 1.0)], "ticker string, date date, close double")
    shares = spark.createDataFrame([(t, day(2), 10.0) for t in [*members[:9], "out", "other"]], "ticker string, date date, shares double")
    rows = [(1, "m00", day(9)), (2, "m00", day(10)), (3, "m08", day(9)), (4, "m09", day(9)), (5, "out", day(9)), (6, "m00", day(4)), (7, None, day(9)), (8, "m00", None), (9, "other", day(55)), (10, "other", day(61))]
    got = {r.id: (r.bucket, r.coverage) for r in U.capital_buckets(spark.createDataFrame(rows, "id int, ticker string, date date"), prices, shares, u).collect()}
    # the price of day 9 counts from day 10 on; m09 has no shares; m09's price of 0 is none; the last snapshot's only member has no price before day 60
    assert got == {1: ("small", 0.9), 2: ("mega", 0.9), 3: ("mega", 0.9), 4: ("unknown", 0.9), 5: ("mid", 0.9), 6: ("unknown", None), 7: ("unknown", 0.9), 8: ("unknown", None), 9: ("unknown", None), 10: ("mega", 1.0)}
