"""Row features, trade logs, transcripts, dictionaries, manifests and zoos against known cases."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from eventloom.operators import evaluation, features, models, trades, transcripts
from eventloom.sources import files

DAY = dt.date


def test_row_features(spark):
    a, b, c, d = (f"AspectTheme_{x}" for x in ("Forecast_ESG - High - Positive", "Forecast_Other - Low - Negative", "Fluff_ESG - High - Positive", "Surprise_ESG - Medium - Neutral"))
    assert [x.column for x in features.cells([a, b, c, d, "x", "AspectTheme_Forecast - High"])] == [a, b, d]
    df = spark.createDataFrame([(1, 2.0, None, 9.0, 4.0, "Real Estate"), (2, None, 5.0, 9.0, None, None)], f"id long, `{a}` double, `{b}` double, `{c}` double, `{d}` double, SECTOR string")
    out = features.row_features(df, ["id"])
    assert len(out.columns) == 61
    one, two = out.orderBy("id").collect()
    assert (one.aspect_Forecast_total, one.aspect_Forecast_net_sentiment, one.aspect_Forecast_mag_weighted) == (2.0, 2.0, 6.0)
    assert (two.aspect_Forecast_total, two.aspect_Forecast_net_sentiment, two.aspect_Forecast_mag_weighted) == (5.0, -5.0, 5.0)
    assert (one.theme_ESG_total, one.theme_ESG_net_sentiment, one.theme_ESG_mag_weighted) == (6.0, 2.0, 14.0)
    assert one.theme_CapitalAllocation_total == 0.0 and one.ATCClassifierScore is None
    assert one.sector_Real_Estate == 1 and sum(two[f"sector_{s.replace(' ', '_')}"] for s in features.SECTORS) == 0


def test_trade_log_gives_each_reason_and_keeps_the_rules(spark):
    day = lambda k: DAY(2020, 1, 1) + dt.timedelta(k)
    quotes = spark.createDataFrame([("a", day(k), 10.0 + k) for k in (0, 1, 30, 31, 90)] + [("gone", day(k), 5.0) for k in (0, 1, 2)], "ticker string, date date, close double")
    plans = spark.createDataFrame([(1, "a", day(0), day(29)), (2, "a", day(10), day(30)), (3, "a", day(30), day(60)), (4, "gone", day(1), day(20)), (5, "none", day(1), day(2)), (6, "a", day(90), day(95))], "trade_id long, ticker string, planned_entry_date date, planned_exit_date date")
    log = trades.trade_log(plans, quotes, 5)
    got = {r.trade_id: (r.skip_reason, r.entry_price, r.exit_price) for r in log.collect()}
    assert got == {
        1: (None, 10.0, 40.0), 2: (trades.NO_ENTRY, None, None), 3: (trades.CENSORED, 40.0, None), 4: (trades.DELISTED, 5.0, None), 5: (trades.NO_ENTRY, None, None),
        6: (trades.CENSORED, 100.0, None),
    }
    assert trades.trade_violations(log).count() == 0


def test_trade_rules_find_each_fault(spark):
    d, e = DAY(2020, 1, 2), DAY(2020, 1, 1)
    rows = [
        (1, d, e, 1.0, d, d, 1.0, None), (2, e, e, 1.0, d, e, 1.0, None), (3, e, None, 1.0, e, None, None, trades.NO_ENTRY), (4, e, e, 1.0, e, None, 2.0, trades.CENSORED),
        (5, e, e, 1.0, e, e, None, trades.DELISTED), (6, e, None, None, e, None, None, trades.DELISTED), (7, None, None, None, None, None, None, None),
    ]
    log = spark.createDataFrame(rows, "trade_id long, planned_entry_date date, actual_entry_date date, entry_price double, planned_exit_date date, actual_exit_date date, exit_price double, skip_reason string")
    assert [r.check for r in trades.trade_violations(log).orderBy("trade_id").collect()] == list(trades.trade_rules())


CALL = """Some Company, Q1 2024 Earnings Call, Apr 30, 2024

Presentation Operator Message
Operator
Good day.

Presenter Speech
Executives
Vice President of Investor Relations
Welcome all.
Executives - Chair & CEO
First line.

Second paragraph.

Question and Answer Operator Message
Operator
Next.

Answer
Executives - CFO
An answer that nobody asked for.

Question
Analysts - Some Bank
Why?

Answer
Executives - CFO
Because.

Because.

Answer
Executives - Chair & CEO
And so on.

Answer
Executives - Chair & CEO
And so on.

Answer
Executives
Our next question is from a shareholder.

Question
Analysts - Other Bank
How much?

Question
Analysts - Third Bank
When?

Answer
Executives
Soon.

Answer
Executives
Thank you. That concludes the call.
"""


def test_transcript_units(spark):
    calls = spark.createDataFrame([("X_1", CALL), ("none", None), ("bare", "no header here"), ("empty", "")], "call string, text string")
    got = [tuple(r)[1:] for r in transcripts.units(calls, "call", "text").orderBy("order").collect()]
    assert [(k[1], k[2], k[3], k[4]) for k in got] == [
        ("X_1__pres__01", "presenter", "Executives", "Vice President of Investor Relations"), ("X_1__pres__02", "presenter", "Executives", "Chair & CEO"), ("X_1__qa__002", "qa", "Executives", "CFO"),
        ("X_1__qa__003", "qa", "Executives", "CFO"), ("X_1__qa__004", "qa", "Executives", "Chair & CEO"), ("X_1__qa__005", "qa", "Analysts", "Other Bank"), ("X_1__qa__006", "qa", "Executives", "Executives"),
    ]
    assert [k[6] for k in got] == ["Welcome all.", "First line.\n\nSecond paragraph.", "An answer that nobody asked for.", "Because.\n\nBecause.", "And so on.", "", "Soon."]
    assert [k[5] for k in got] == [None, None, None, "Why?", "Why?", "Our next question is from a shareholder.\n\nHow much?", "When?"]
    assert [k[8] for k in got] == [None, None, "orphan_answer", None, None, "orphan_question", None]
    assert [k[7] for k in got] == [len(k[6]) for k in got]


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Seq,Word,Positive,Negative\n1, GOOD ,2009,0\n2,bad,,2009\n3,odd,x,2009\n4,,1,1\n5,none,0,0\n6,Bad,0,\n")
    words = files.dictionary(spark, str(tmp_path / "d.csv"))
    assert sorted(map(tuple, words.collect())) == [("bad", False, True), ("good", True, False)]
    docs = spark.createDataFrame([(1, "Good good bad odd"), (2, "odd"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.positive, r.negative, r.score) for r in files.dictionary_scores(docs, words).collect()}
    assert got == {1: (2, 1, 1 / 3), 2: (0, 0, None), 3: (0, 0, None)}


def test_store_replaces_one_key_and_reads_one(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "items array<string>"
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "key string, items array<string>")
    files.write_documents(df, ["key"], path)
    files.write_documents(spark.createDataFrame([("b", ["w"])], "key string, items array<string>"), ["key"], path)
    assert files.read_documents(spark, path, schema, key="a").first()["items"] == ["x", "y"]
    assert files.read_documents(spark, path, schema, key="b").first()["items"] == ["w"]


def test_zoo_never_scores_a_group_with_its_own_model(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        y = float(rng.random() < 0.5)
        rows.append((i, f"g{i % 8}", y + rng.gauss(0, 0.4), rng.random(), f"{'good' if y else 'bad'} word {i % 8}", y))
    df = spark.createDataFrame(rows, "id long, g string, a double, noise double, t string, y double").cache()
    families = {"signal": models.Family("logistic", ["a"]), "noise": models.Family("logistic", ["noise"]), "words": models.Family("text", ["t"]), "rules": models.Family("rules", ["noise"])}
    scored = models.zoo(df, families, "id", "y", "g", 3).cache()
    assert scored.count() == 240 * 5
    # brute force: a fit on the other folds gives the same probability
    folded = df.withColumn("fold", F.pmod(F.xxhash64("g"), F.lit(3)))
    k = folded.first().fold
    want = models.predict(models.fit(folded.where(F.col("fold") != k), ["a"], "y", "logistic"), folded.where(F.col("fold") == k), "logistic").select("id", F.col("p").alias("want"))
    off = scored.where("model = 'signal'").join(want, "id").where("abs(p - want) > 1e-9")
    assert want.count() > 0 and off.count() == 0
    report = {r.model: r for r in models.zoo_report(scored, "y", 0.9).collect()}
    assert all(r.recall >= 0.9 for r in report.values())
    assert report["words"].macro_f1 == 1.0 and report["signal"].macro_f1 > 0.8 > report["noise"].macro_f1


def test_fit_windows_see_nothing_of_the_fold(spark):
    rows = [(DAY(2020, 1, 1) + dt.timedelta(k), None if k % 5 == 0 else DAY(2020, 1, 1) + dt.timedelta(k + 20), None if k % 7 == 0 else 1.0) for k in range(200)]
    df = spark.createDataFrame(rows, "at date, ends date, y double")
    got = {r.fold: r for r in models.fit_windows(df, [("2020-03-01", "2020-04-01"), ("2019-01-01", "2019-02-01")], "at", "ends", "y").collect()}
    start = DAY(2020, 3, 1)
    seen = [r for r in rows if r[2] is not None and r[0] < start and (r[1] is None or r[1] < start)]
    assert (got[0].rows, got[0].first, got[0].last, got[0].last_end, got[0].clean) == (len(seen), min(r[0] for r in seen), max(r[0] for r in seen), max(r[1] for r in seen if r[1]), True)
    assert (got[1].rows, got[1].first, got[1].clean) == (0, None, True)


def test_block_bootstrap_against_numpy(spark):
    x, block, draws, seed = [float(i * i % 17) for i in range(20)], 6, 50, 42
    values = spark.createDataFrame([(i, v) for i, v in enumerate(x)][::-1], "m int, v double")
    got = {r.draw: (r.mean, r.sd) for r in evaluation.block_bootstrap(values, "m", "v", block, draws, seed).collect()}
    ks = spark.range(draws).select("id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    starts = {(r.id, r.k): r.h % 15 for r in ks.select("id", "k", F.xxhash64("id", "k", F.lit(seed)).alias("h")).collect()}
    assert len(got) == draws
    for d in range(draws):
        drawn = [v for k in range(1, 5) for v in x[starts[d, k] : starts[d, k] + block]][: len(x)]
        assert np.allclose(got[d], (np.mean(drawn), np.std(drawn)))
