"""Operators outside the training-data subpackage against cases worked out by hand or by plain Python."""

import datetime as dt
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from eventloom.functions import dates as D
from eventloom.functions import text as T
from eventloom.functions.ranks import newey_west_short, pooled_rank_correlation, rank_correlation
from eventloom.operators import documents, evaluation, joins, models, sampling, series
from eventloom.sources import files
from eventloom.streaming import jobs

DAY = dt.date


def column(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


@pytest.mark.parametrize(
    ("ts", "want"),
    [
        ("2020-03-02 12:59:00", DAY(2020, 3, 2)), ("2020-03-02 13:00:00", DAY(2020, 3, 3)), ("2020-03-06 16:00:00", DAY(2020, 3, 9)), ("2020-03-07 12:00:00", DAY(2020, 3, 9)),
        ("2020-03-15 22:30:00", DAY(2020, 3, 16)), (None, None),
    ],
)
def test_entry_date(spark, ts, want):
    assert column(spark, ts).select(D.entry_date(F.col("x").cast("timestamp_ntz"))).first()[0] == want


@pytest.mark.parametrize(
    ("call", "ingest", "want"),
    [
        (DAY(2020, 1, 13), None, DAY(2020, 1, 15)), (DAY(2024, 1, 15), DAY(2024, 1, 16), DAY(2024, 1, 16)), (DAY(2024, 1, 15), None, DAY(2024, 1, 15)),
        (DAY(2023, 7, 5), None, DAY(2023, 7, 7)), (DAY(2023, 7, 6), DAY(2023, 7, 6), DAY(2023, 7, 6)), (None, DAY(2024, 1, 1), None),
    ],
)
def test_availability(spark, call, ingest, want):
    df = spark.createDataFrame([(call, ingest)], "c date, i date")
    assert df.select(D.availability_date(F.col("c"), F.col("i"), "2023-07-06")).first()[0] == want


def test_business_days_by_counting(spark):
    days = [DAY(2023, 12, 20) + dt.timedelta(k) for k in range(15)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", *[D.add_business_days(F.col("d"), n).alias(f"n{n + 9}") for n in range(-8, 9) if n], D.business_days_between(F.lit("2023-12-01").cast("date"), F.col("d")).alias("k")).collect()
    for r in got:
        for n in range(-8, 9):
            if n:
                d, left = r.d, abs(n)
                while left:
                    d += dt.timedelta(1 if n > 0 else -1)
                    left -= d.weekday() < 5
                assert r[f"n{n + 9}"] == d, (r.d, n)
        assert r.k == sum((DAY(2023, 12, 1) + dt.timedelta(i)).weekday() < 5 for i in range((r.d - DAY(2023, 12, 1)).days))


def test_rank_correlation(spark):
    rows = [("up", k, 2.0 * k) for k in range(1, 6)] + [("down", k, -k) for k in range(1, 6)] + [("gap", a, b) for a, b in zip([1, None, 3, 4, 5], [5, 4, 3, None, 1], strict=True)]
    rows += [("flat", 1, k) for k in range(4)] + [("none", None, 1.0)]
    df = spark.createDataFrame([(g, None if a is None else float(a), None if b is None else float(b)) for g, a, b in rows], "g string, a double, b double")
    got = {r.g: r.ic for r in rank_correlation(df, "a", "b", ["g"]).collect()}
    assert got["flat"] is None and "none" not in got
    assert [round(got[g], 9) for g in ("up", "down", "gap")] == [1, -1, -1]


@pytest.mark.parametrize("series", [[0.1, -0.2, 0.3, 0.05, 0.2, -0.1], [0.1, 0.3], [0.2], [], [0.0, 0.0, 0.0], [1.0, -1.0, 1.0, -1.0, 1.0], [0.5] * 4])
def test_newey_west_of_a_short_series(spark, series):
    n, want = len(series), None
    if n >= 2 and any(series):
        mean = sum(series) / n
        dev = [x - mean for x in series]
        total = sum(d * d for d in dev) / (n - 1)
        for k in range(1, 4):
            if k <= n - 2:
                total += 2 * (1 - k / 4) * sum(a * b for a, b in zip(dev[k:], dev, strict=False)) / (n - k)
        want = pytest.approx(mean / math.sqrt(max(total, 1e-15) / n))
    elif n >= 2:
        want = 0.0
    df = spark.createDataFrame([(series,)], "s array<double>")
    assert df.select(newey_west_short(F.col("s"), 3)).first()[0] == want


def test_a_rank_correlation_of_zero_is_zero(spark):
    rows = [("zero", a, b) for a, b in zip((0.1, 0.2, 0.3, 0.4), (0.2, 0.4, 0.1, 0.3), strict=True)] + [("tied", a, b) for a, b in zip((1.0, 1.0, 2.0, 2.0), (0.1, 0.7, 0.1, 0.7), strict=True)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(3)
    assert [r.ic for r in rank_correlation(df, "a", "b", ["g"]).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_by_search(spark, forward, strict):
    r = random.Random(forward * 2 + strict)
    day = lambda: DAY(2020, 1, 1) + dt.timedelta(r.randint(0, 60))
    left = [(i, r.choice("ab"), day()) for i in range(80)] + [(80, "a", None), (81, None, day())]
    right = sorted({(r.choice("ab"), day()) for _ in range(25)})
    right = [(k, d, float(i)) for i, (k, d) in enumerate(right)]
    out = joins.asof(spark.createDataFrame(left, "i long, k string, at date"), spark.createDataFrame(right, "k string, q date, v double"), "k", "at", "q", ["v"], 7, strict=strict, forward=forward).collect()
    assert len(out) == len(left)
    for x in out:
        near = [(q, v) for k, q, v in right if x.at and k == x.k and ((x.at < q if strict else x.at <= q) if forward else (q < x.at if strict else q <= x.at)) and abs((q - x.at).days) <= 7]
        want = (min(near) if forward else max(near)) if near else (None, None)
        assert (x.q, x.v) == want, x


def test_pooled_rank_correlation_counts_equal_pairs_once(spark):
    r = random.Random(5)
    some = [None, float("nan"), -1.0, 0.0, 2.5, 7.0, 1e300]
    rows = [(g, r.choice(some), r.choice(some)) for g in ("a", "b", None) for _ in range(300)] + [("c", 1.0, 2.0)] * 40 + [("d", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    want = {x.g: (x.n, x.ic) for x in rank_correlation(df, "a", "b", ["g"]).collect()}
    assert {x.g: (x.n, x.ic) for x in pooled_rank_correlation(df, "a", "b", ["g"]).collect()} == want
    once = df.groupBy("g", "a", "b").agg(F.count("*").alias("k"))
    assert {x.g: (x.n, x.ic) for x in pooled_rank_correlation(once, "a", "b", ["g"], times=F.col("k")).collect()} == want
    # the pairs of windows and horizons are made of counted rows: no window runs over a group's rows
    flat = evaluation.window_correlations(df.withColumn("c", F.col("b")), {1: "a"}, {1: "b", 2: "c"}, "g", 1, 2)
    assert {x.g: (x.n, x.ic) for x in flat.where("horizon = 2").collect()} == want
    assert "_rows" in flat._jdf.queryExecution().optimizedPlan().toString()


def test_asof_finds_the_answer_of_a_day_once(spark):
    left = spark.range(2000).selectExpr("id as i", "'a' as k", "date_add(date'2020-01-01', cast(id % 3 as int)) as at").unionByName(spark.sql("select -1L as i, cast(null as string) as k, date'2020-01-01' as at"))
    right = spark.sql("select * from values ('a', date'2020-01-03', 7.0D), (null, date'2020-01-02', 8.0D) as t(k, q, v)")
    assert joins.nearest(left, right, "k", "at", "q", ["v"], 400, forward=True).count() == 4
    out = joins.asof(left, right, "k", "at", "q", ["v"], 400, forward=True)
    # a frame that reaches to the end is read anew at each row
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    got = {(r.k, r.v): r.n for r in out.groupBy("k", "v").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", 7.0): 2000, (None, None): 1}


def test_validated_join_fails_on_repeats(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k long, a string"), spark.createDataFrame([(1, "z")], "k long, b string")
    with pytest.raises(Exception, match="repeated key"):
        joins.one_to_one(a, b, ["k"]).collect()


def test_next_quote(spark):
    cal = spark.createDataFrame([(k, DAY(2020, 3, 2) + dt.timedelta(k)) for k in range(6)], "pos long, date date")
    quotes = spark.createDataFrame([(DAY(2020, 3, 5), "A", 104.0), (DAY(2020, 3, 3), "A", None), (DAY(2020, 3, 7), "A", 107.0)], "date date, ticker string, close double")
    plans = spark.createDataFrame([("A", DAY(2020, 3, 2)), ("A", DAY(2020, 3, 5)), ("A", DAY(2020, 2, 1)), ("B", DAY(2020, 3, 2)), ("A", DAY(2020, 3, 6))], "ticker string, date date")
    got = {(r.ticker, r.date): r.quote for r in joins.next_quote(plans, quotes, cal, 3).collect()}
    assert got == {("A", DAY(2020, 3, 2)): 104.0, ("A", DAY(2020, 3, 5)): 104.0, ("A", DAY(2020, 2, 1)): None, ("B", DAY(2020, 3, 2)): None, ("A", DAY(2020, 3, 6)): 107.0}
    short = {(r.ticker, r.date): r.quote for r in joins.next_quote(plans, quotes, cal, 2).collect()}
    assert short["A", DAY(2020, 3, 2)] is None


def test_complete_votes(spark):
    sample = spark.createDataFrame([("s1",), ("s2",)], "id string")
    judge = lambda rows: spark.createDataFrame(rows, "id string, label string, seq long")
    full = judge([("s1", "a", 1), ("s1", "b", 2), ("s2", "", 1)])
    assert {(r.id, r.label_0) for r in joins.complete_votes(sample, [full], "id").collect()} == {("s1", "b"), ("s2", "keep")}
    with pytest.raises(Exception, match="lacks an id"):
        joins.complete_votes(sample, [full, judge([("s1", "a", 1)])], "id").collect()


def walk(prices, weight):
    """The gap state machine as a loop."""
    out, last, missing, censored = [], None, 0, False
    for p in prices:
        pnl, gap = 0.0, 0
        if last is None:
            last = p
        elif not censored:
            if p is not None:
                pnl, last, missing = weight * (p / last - 1), p, 0
            else:
                missing += 1
                gap = missing if missing < 3 else 0
                censored = missing >= 3
        out.append((round(pnl, 9), gap, censored))
    return out


def test_gap_states_follow_the_loop(spark):
    r = random.Random(8)
    runs = {i: [r.choice([None, None, 100.0, 105.0, 90.0, 110.0]) for _ in range(r.randint(1, 14))] for i in range(60)} | {99: [100.0, 110.0], 98: [100.0, None, 105.0], 97: [100.0, None, None, None, 101.0]}
    rows = [("t", i, DAY(2020, 1, 1) + dt.timedelta(k), 0.5, p) for i, ps in runs.items() for k, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "ticker string, interval long, date date, weight double, price double")
    got = {}
    for x in sorted(series.gap_states(df).collect(), key=lambda x: (x.interval, x.date)):
        got.setdefault(x.interval, []).append((round(x.pnl, 9), x.gap_days, x.censored))
    assert got == {i: walk(ps, 0.5) for i, ps in runs.items()}
    assert got[99][1][0] == 0.05 and got[98][2][0] == 0.025


def test_buckets(spark):
    rows = [(m, f"t{j}", float(j), j / 100) for m in (1, 2) for j in range(18)]
    df = spark.createDataFrame(rows, "m int, ticker string, v double, r double")
    got = {(x.m, x.bucket): round(x.ret, 9) for x in evaluation.bucket_returns(df, "v", "r", ["m"], 3, 5).collect()}
    assert got == {(m, b): v for m in (1, 2) for b, v in enumerate((0.025, 0.085, 0.145))}
    assert {x.m for x in evaluation.bucket_returns(df.where("m = 2 or v < 5"), "v", "r", ["m"], 3, 5).collect()} == {2}
    two = evaluation.bucket_returns(df.withColumn("v", F.col("v") % 2 + 1), "v", "r", ["m"], 5, 1).collect()
    assert 0 < len({x.bucket for x in two}) < 5
    assert evaluation.bucket_returns(df.limit(0), "v", "r", ["m"], 3, 5).columns == ["m", "bucket", "ret", "n"]


def test_equity_and_drawdown(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([0.01, 0.02, -0.01])] + [("b", k, v) for k, v in enumerate([0.1, -0.1818181818, None, -1.5, 0.2])], "ticker string, date int, ret double")
    got = {(x.ticker, x.date): x.equity for x in series.equity_and_drawdown(df).collect()}
    assert [round(got["a", k], 6) for k in range(3)] == [1.01, 1.0302, 1.019898]
    assert got["b", 2] == got["b", 1] and math.isclose(got["b", 3], got["b", 2] * -0.5)  # losses over 100 % keep their sign


def test_threshold_and_ensemble(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (1, 0.9)], "y int, p double")
    t = evaluation.best_threshold(df, "y", "p", 1000, 0.96).first().threshold
    assert sum(p >= t for y, p in [(1, 0.35), (1, 0.8), (1, 0.9)] if y) == 3
    row = evaluation.classification_report(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, q int"), "y", "q", []).first()
    assert row.precision == 2 / 3 and row.tn == 1 and row.recall == 1


def test_text_features(spark):
    names = [f"h{k:02}" for k in range(1, 31)]
    texts = ["Good morning and welcome.", "a b c d e", "a b c d e f", None, "from the filing", "from Goldman Sachs", "Non-GAAP EPS was $1.12, up 5.2% YoY with revenue guidance.", "ABc DEF g H"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", *T.features(F.col("t"))).orderBy("i").collect()
    on = lambda i: {n for n in names if rows[i][n]}
    assert "h03" in on(0) and "h22" in on(1) and "h22" not in on(2) and on(3) == set() and "h02" not in on(4) and "h02" in on(5)
    assert {"h09", "h12", "h13", "h17", "h18"} <= on(6)
    assert rows[7].h26 == 5 / 11


def test_small_text_functions(spark):
    df = spark.createDataFrame([('{"label": "A"}',), ('x {"label": " b "} y',), ("no",), ('{"label": "q"}',), ("",), (None,), ('{"k": 1}',)], "raw string")
    label, error = T.json_label(F.col("raw"), ["a", "b"])
    assert [tuple(r) for r in df.select(label, error).collect()] == [("a", None), ("b", None), (None, "no_json"), (None, "bad_label"), (None, "empty"), (None, "empty"), (None, "no_label")]
    items = [('["a", " b ", "", "c", "d"]',), ("single",), (None,)]
    assert [r[0] for r in spark.createDataFrame(items, "v string").select(T.text_items(F.col("v"))).collect()] == [["a", "b", "c"], ["single"], []]
    one = column(spark, 'One. Two? "Three" x. four').select(T.sentences(F.col("x")), T.phrase_key(F.lit("  Ab--C 9! ")), T.lexicon_score(F.lit("good bad good."), ["good"], ["bad", "good"])).first()
    assert list(one) == [["One.", "Two?", '"Three" x. four'], "ab c 9", 1 / 3]
    assert column(spark, None).select(T.ordered_class(F.col("x"), [("A", "a")], "B")).first()[0] == "Unknown"


def test_lines_and_pairs(spark):
    d = spark.createDataFrame([(1, "a\nb\na\nc\nb")], "doc_id long, text string")
    assert [r.line for r in documents.first_lines(d).orderBy("pos").collect()] == ["a", "b", "c"]
    s = documents.sentence_rows(spark.createDataFrame([(5, "Short one. This sentence is long enough to keep, indeed it is.")], "doc_id long, text string"), 40).collect()
    assert [r.sentence_id for r in s] == ["5#0000000"]
    turns = spark.createDataFrame([(1, 0, "u"), (1, 1, "a"), (1, 2, "a"), (1, 3, "s"), (1, 4, "a")], "conv_id long, turn long, role string")
    assert [(r.turn, r.question_turn, r.orphan) for r in documents.question_pairs(turns, "u", "a", "s").orderBy("turn").collect()] == [(1, 0, False), (2, 0, False), (4, None, True)]


def test_samples_and_logs(spark):
    df = spark.range(103).select(F.col("id"), F.when(F.col("id") < 3, "x").when(F.col("id") < 40, "y").otherwise("z").alias("g"))
    got = sampling.stratified_sample(df, "g", "id", 20, 1)
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"x": 1, "y": 7, "z": 12}
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in sampling.stratified_sample(df.repartition(7), "g", "id", 20, 1).collect())
    split = {(r.g, r.split): r["count"] for r in sampling.three_way_split(df, "g", "id", 1).groupBy("g", "split").count().collect()}
    assert split["y", "train"] == 23 and split["z", "test"] == 12
    log = spark.createDataFrame([("A", "miss"), ("B", "miss")], "ticker string, status string")
    new = spark.createDataFrame([("A", "ok"), ("B", "gone")], "ticker string, status string")
    assert sorted(map(tuple, sampling.log_failures(log, new, True).collect())) == [("B", "gone")]
    assert sorted(map(tuple, sampling.log_failures(log, new, False).collect())) == [("B", "gone"), ("B", "miss")]


def test_files(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Ticker,SignalType,A,B\nBRK.B,x,1,z\nC,delete,2,9\n")
    wide = files.coerce(files.wide_csv(spark, str(tmp_path / "w.csv"), ["Ticker", "SignalType", "A", "B"]), ["A"], [], ["B"])
    assert [tuple(r) for r in wide.collect()] == [("BRK-B", "x", 1, 0)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("in/w.csv", "a,b\n1,2\n3,\n")
    assert [tuple(r) for r in files.zipped_csv(spark, str(tmp_path / "z.zip"), ["a", "b"], "w.csv", 1).collect()] == [("1", "2"), ("3", "")]
    (tmp_path / "h.csv").write_text('Fund\n,as of\nTicker,Name\n"AAPL",Apple\n-,cash x\nbrk b,no\nBF-B,yes\n')
    assert {r.ticker for r in files.csv_after_preamble(spark, str(tmp_path / "h.csv"), "Ticker,").collect()} == {"AAPL", "-", "BF-B"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/AAPL_Q1-2020.txt").write_text("hello")
    (tmp_path / "t/notes.txt").write_text("no")
    assert [tuple(r) for r in files.transcripts(spark, str(tmp_path / "t")).collect()] == [("AAPL", "Q1-2020", "hello")]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i long, a string"), spark.createDataFrame([(1, 5), (2, 6)], "i long, b long")
    assert sorted(map(tuple, files.zip_columns(a, b, "i").collect())) == [(1, "x", 5), (2, "y", 6)]
    with pytest.raises(Exception, match="row counts differ"):
        files.zip_columns(a, b.limit(1), "i").collect()
    with pytest.raises(KeyError):
        files.select_present(a, ["nope"], [])
    assert files.select_present(a, ["a"], ["i", "nope", "a"]).columns == ["a", "i"]
    files.write_manifest(a, str(tmp_path / "m"), "p", {"k": "1"})
    assert files.fresh(spark, str(tmp_path / "m"), "p", {"k": "1"}) and not files.fresh(spark, str(tmp_path / "m"), "p", {"k": "2"})
    a.limit(1).write.mode("overwrite").parquet(str(tmp_path / "m/data"))
    assert not files.fresh(spark, str(tmp_path / "m"), "p", {"k": "1"})


def test_models(spark):
    rows = [(i, f"g{i % 7}", float(i % 10), None if i % 9 == 0 else float(i % 4), float(i % 10 > 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, g string, a double, b double, y double")
    assert models.fit(df.limit(5), ["a", "b"], "y", "logistic") in {k / 5 for k in range(6)}
    assert models.fit(df.where("y = 1"), ["a"], "y", "logistic") == 1.0
    out = models.out_of_fold(df, ["a", "b"], "y", "logistic", "g")
    assert out.count() == 200 and out.where("(p > 0.5) != (y = 1)").count() == 0
    assert models.nonzero_features(df.withColumn("z", 3 * F.col("a")), ["a", "b"], "z") == ["a"]
    text = spark.createDataFrame([(f"good fine {i % 5}" if i % 2 else f"bad poor {i % 5}", float(i % 2)) for i in range(60)], "t string, y double")
    assert models.text_model(text, "t", "y").transform(text).where("prediction != y").count() == 0
    board = spark.createDataFrame([("a", 0.8, 0.97, True, False), ("b", 0.8, 0.98, True, True), ("c", 0.9, 0.5, True, False), ("d", 0.99, 1.0, False, False)], "model string, macro_f1 double, recall double, eligible boolean, ensemble boolean")
    assert [r.model for r in models.leaderboard(board, 0.96).collect()] == ["b", "a"]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    turns = [(1, 0, "user"), (1, 1, "assistant"), (2, 0, "assistant"), (1, 2, "system"), (1, 3, "assistant")]
    schema = "conv_id long, turn long, role string"
    spark.createDataFrame(turns, schema).coalesce(1).write.parquet(src)
    q = jobs.open_questions(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from pairs").collect())) == [(1, 1, 0), (1, 3, -1), (2, 0, -1)]
    sink = lambda b, e: jobs.keep_latest(b, e, out, "conv_id", "turn")
    stream = spark.readStream.schema(schema).parquet(src)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    spark.createDataFrame([(2, 9, "user")], schema).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(f"{out}/1").collect())) == [(1, 3, "assistant"), (2, 9, "user")]
    events = spark.createDataFrame([(dt.datetime(2024, 1, d, 12), "a", 1.5) for d in (1, 1, 2, 9)], "ts timestamp, event_type string, value double")
    events.coalesce(1).write.parquet(f"{src}-e")
    q = jobs.daily_counts(spark.readStream.schema(events.schema).parquet(f"{src}-e")).writeStream.format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.day), r.n) for r in spark.sql("select * from days").collect()) == [("2024-01-01", 2), ("2024-01-02", 1)]


def test_validation(spark):
    from eventloom.operators import validation

    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    got = {r.check: (r.rows, r.violations, r.passed) for r in validation.violations(df, {"a": F.col("a") > 0, "b": F.col("b") == "x"}).collect()}
    assert got == {"a": (2, 0, True), "b": (2, 1, False)}
    w = column(spark, " ".join(f"w{k}" for k in range(10))).select(validation.token_windows("x", 4, 2)).first()[0]
    assert [x[0] for x in w] == ["w0", "w2", "w4", "w6"] and w[-1][-1] == "w9"


def test_search_prefers_the_weaker_penalty(spark):
    rows = [(i, DAY(2020, 1, 1) + dt.timedelta(i), None, float(i * 37 % 100), float(i * 37 % 100) * 2) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, d date, e date, a double, y double")
    best, means = models.search(df, [("2020-06-01", "2020-08-01"), ("2020-08-01", "2020-10-01")], "d", "e", ["a"], "y", "lasso", [{"regParam": 1e6}, {"regParam": 0.01}])
    assert best == {"regParam": 0.01} and means[0] is None and means[1] > 0.99


def test_value_ranks_match_average_ranks(spark):
    from eventloom.functions import ranks

    inf, nan = float("inf"), float("nan")
    values = [None, nan, inf, -inf, 0.0, 1e300, -1e300, 3.5, 3.5, 3.5, None, nan, 7.0, 7.0]
    rows = [(k, "a" if k % 3 else None, v) for k, v in enumerate(values * 3)] + [(100 + k, "b", float(k * k % 17)) for k in range(40)] + [(200, "c", inf)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    want = {r.id: r.r for r in df.select("id", ranks.average_rank("v", ["g"]).cast("double").alias("r")).collect()}
    got = ranks.with_rank(df, "v", ["g"]).collect()
    assert {r.id: r["rank"] for r in got} == want and len(got) == len(rows)
    assert {r["size"] for r in got if r.g == "b"} == {40}
    assert ranks.with_rank(df.where("id < 0"), "v", ["g"]).count() == 0


def test_strict_past_percentile_brute_force(spark):
    import datetime
    import random

    rng, day = random.Random(5), datetime.date(2020, 1, 1)
    dates = [None] + [day + datetime.timedelta(k) for k in (0, 1, 2, 3, 40, 64, 65, 128, 300, 700, 701)]
    values = [None, float("inf"), float("-inf"), *map(float, range(-4, 9))]
    rows = [(k, rng.choice(["a", "a", "b", None]), rng.choice(values), rng.choice(dates), rng.choice(dates)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v double, at date, known date").repartition(3)
    for r in joins.strict_past_percentile(df, "id", "v", "at", "known", ["g"]).collect():
        past = [v for _, g, v, _, known in rows if g == r.g and v is not None and known is not None and r.at is not None and known < r.at]
        want = sum(v <= r.v for v in past) / len(past) if past and r.v is not None else None
        assert r.pct == want
    assert joins.strict_past_percentile(df.where("known is null"), "id", "v", "at", "known", ["g"]).where("pct is not null").count() == 0
