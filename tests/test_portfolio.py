"""The simulated portfolio against a day-by-day walk in plain Python, and its gap states by hand."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from eventloom.operators import portfolio as P

START = dt.date(2020, 1, 1)


def day(k):
    return START + dt.timedelta(days=k)


def walk(signals, prices, rebalances, rules):
    """(daily rows, trades) as one reads them off the rules, a day at a time."""
    first, last = min(s[0] for s in signals), max(s[0] for s in signals)
    quotes = {(t, d): p for t, d, p in prices if p is not None and p > 0 and first <= d <= last + dt.timedelta(days=30)}
    cal = sorted({d for _, d in quotes})
    pos = {d: i for i, d in enumerate(cal)}
    reb = sorted(d for d in set(rebalances) if first <= d <= last and d in pos)

    def quote(t, d):
        for k in range(pos[d], min(len(cal), pos[d] + rules.quote_days + 1)):
            if (t, cal[k]) in quotes:
                return cal[k], quotes[t, cal[k]]
        return None, None

    def legs(d):
        best = {}
        for when, t, s in signals:
            if when == d and s is not None and s == s and (t not in best or (abs(s), s) > (abs(best[t]), best[t])):
                best[t] = s
        n = len(best)
        if n < 2 * rules.floor:
            return {}
        k = max(rules.floor, -int(-(n * rules.share) // 1))
        up = sorted(best, key=lambda t: (-best[t], t))
        raw = dict.fromkeys([*up[:k], *up[-k:]], 0.0)
        for t in up[:k]:
            raw[t] += 1 / k
        for t in up[-k:]:
            raw[t] -= 1 / k
        return raw

    def rescaled(w):
        gross = sum(map(abs, w.values()))
        return {t: x * 2 / gross for t, x in w.items()} if gross > 1e-10 else w

    daily, trades, gone = [], [], set()
    now, held, before = {}, {}, {}
    for i, d in enumerate(cal[:-1]):
        if d > last:
            break
        turnover = 0.0
        if d in reb:
            start = cal[max(0, i - rules.lookback + 1)]
            net = defaultdict(float)
            for c in {s[0] for s in signals if start <= s[0] <= d}:
                for t, x in legs(c).items():
                    net[t] += x
            mean = sum(net.values()) / len(net) if net else 0
            target = rescaled({t: x - mean for t, x in net.items()})
            entry = {t: quote(t, d) for t in target}
            w = rescaled({t: x for t, x in target.items() if entry[t][0]})
            if w:
                turnover = sum(abs(w.get(t, 0) - before.get(t, 0)) for t in {*w, *before})
                before = w
                held = {t: [x, pos[entry[t][0]], entry[t][1], 0, False] for t, x in w.items() if abs(x) > 1e-12}
                nxt = next((x for x in reb if x > d), None)
                for t in target:
                    out = quote(t, nxt) if entry[t][0] and nxt else (None, None)
                    trades.append([d, t, w.get(t), *entry[t], nxt if entry[t][0] else None, *out])
        row = defaultdict(float, date=d, turnover=turnover, rebalanced=d in reb)
        for t, state in held.items():
            w, entered, price, streak, censored = state
            if entered > i:
                continue
            row["n_positions"] += 1
            row["gross"] += abs(w)
            row["net"] += w
            after = quotes.get((t, cal[i + 1]))
            if censored or (after is None and streak == 2):
                state[4] = True
                if after is None:
                    again = any((t, x) in quotes for x in cal[i + 1 : i + 1 + rules.recovery_days])
                    kind = "recovered_gap" if again else "final_gap"
                    row[f"{kind}_weight"] += abs(w)
                    row[f"n_{kind}"] += 1
                    if not again:
                        gone.add(t)
            elif after is None:
                state[3] += 1
                row[f"filled_{state[3]}d_weight"] += abs(w)
                row[f"n_filled_{state[3]}d"] += 1
            else:
                row["pnl"] += w * (after / price - 1)
                state[2], state[3] = after, 0
        daily.append(row)
    for x in trades:
        x.append("skip_no_entry_quote" if x[3] is None else None if x[6] else "delisting_exit_used" if x[1] in gone else "right_censored_no_exit_quote")
    return daily, trades


def frames(spark, signals, prices, rebalances):
    return (
        spark.createDataFrame(signals, "date date, ticker string, score double"), spark.createDataFrame(prices, "ticker string, date date, close double"),
        spark.createDataFrame([(d,) for d in rebalances], "date date"),
    )


def check(spark, signals, prices, rebalances, rules):
    got = P.simulate(*frames(spark, signals, prices, rebalances), rules)
    daily, trades = walk(signals, prices, rebalances, rules)
    rows = {r.date: r.asDict() for r in got.daily.collect()}
    assert sorted(rows) == [r["date"] for r in daily]
    for r in daily:
        for name, value in rows[r["date"]].items():
            want = r[name]
            assert value == want if isinstance(value, bool) or name == "date" else value == pytest.approx(want, abs=1e-9), (r["date"], name)
    have = sorted((list(r) for r in got.trades.collect()), key=lambda r: (r[0], r[1]))
    trades.sort(key=lambda r: (r[0], r[1]))
    assert len(have) == len(trades)
    for a, b in zip(have, trades, strict=True):
        assert [pytest.approx(x, abs=1e-9) if isinstance(x, float) else x for x in b] == a
    return daily, trades


def test_simulation(spark):
    r = random.Random(6)
    names = [f"t{k:02}" for k in range(14)]
    prices, gaps = [], defaultdict(int)
    for k in range(150):
        if day(k).weekday() > 4:
            continue
        for t in names:
            if gaps[t]:
                gaps[t] -= 1
            elif r.random() < 0.05:
                gaps[t] = r.choice([0, 1, 2, 5, 9, 60])
            elif not (t == "t03" and k > 70):  # leaves the market
                prices.append((t, day(k), r.choice([None, 0.0, -1.0]) if r.random() < 0.02 else round(r.uniform(5, 50), 2)))
    # signals on weekends too, before the first quote, and a long time without any
    signals = [(day(r.choice([k for k in range(-3, 110) if not 40 < k < 60])), r.choice(names), r.choice([None, float("nan"), 0.0, 1.0, -1.0, r.gauss(0, 1)])) for _ in range(1500)]
    mondays = [day(k) for k in range(160) if day(k).weekday() == 0]
    daily, trades = check(spark, signals, prices, [*mondays, day(200)], P.Rules(lookback=4, floor=2))
    for name in ("n_filled_1d", "n_filled_2d", "n_recovered_gap", "n_final_gap"):
        assert any(row[name] for row in daily), name
    assert {t[-1] for t in trades} == {None, "skip_no_entry_quote", "right_censored_no_exit_quote", "delisting_exit_used"}
    # holdings stay over rebalances that see no cohort
    assert any(row["rebalanced"] and not row["turnover"] and row["n_positions"] for row in daily)


def one_position(spark, closes, weight=0.5):
    """The states of one holding entered on day 0; closes: a price, or None, for each day."""
    quotes = spark.createDataFrame([("a", day(k), p) for k, p in enumerate(closes) if p] + [("z", day(k), 1.0) for k in range(len(closes))], "ticker string, date date, close double")
    calendar = spark.createDataFrame([(day(k), k) for k in range(len(closes))], "date date, pos int")
    held = spark.createDataFrame([(day(0), "a", weight, 0, len(closes) - 1)], "interval date, ticker string, weight double, entry_pos int, stop_pos int")
    return [(round(r.pnl, 12), r.gap_days, r.long_gap, r.recovered) for r in P.position_days(held, quotes, calendar, P.Rules()).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("closes", "weight", "want"),
    [
        ([100.0, 110.0], 0.5, [(0.05, 0, False, False)]),
        ([100.0, 90.0], -0.3, [(0.03, 0, False, False)]),
        ([100.0, None], 0.5, [(0.0, 1, False, False)]),
        ([100.0, None, 105.0], 0.5, [(0.0, 1, False, False), (0.025, 0, False, False)]),
        ([100.0, None, None, 105.0, 105.0], 0.5, [(0.0, 1, False, False), (0.0, 2, False, False), (0.025, 0, False, False), (0.0, 0, False, False)]),
        ([100.0, None, None, None, 105.0, 110.0], 0.5, [(0.0, 1, False, False), (0.0, 2, False, False), (0.0, 0, True, True), (0.0, 0, False, False), (0.0, 0, False, False)]),
        ([100.0, None, None, None, None], 0.5, [(0.0, 1, False, False), (0.0, 2, False, False), (0.0, 0, True, False), (0.0, 0, True, False)]),
    ],
)
def test_gap_states_of_a_holding(spark, closes, weight, want):
    assert one_position(spark, closes, weight) == want


def test_recovery_window(spark):
    closes = [100.0, *[None] * 33, 101.0, 101.0]
    states = one_position(spark, closes)
    # the next quote is on day 34: 31 days after day 3, 30 after day 4
    assert [s[3] for s in states[2:6]] == [False, False, True, True] and all(s[2] for s in states[2:33])


def test_nothing_to_hold(spark):
    signals, prices, days = [(day(0), "a", 1.0), (day(3), "b", 2.0)], [("a", day(k), 1.0) for k in range(5)], [day(0)]
    daily, trades = check(spark, signals, prices, days, P.Rules())
    assert len(daily) == 4 and not trades
    none = P.simulate(*frames(spark, [], prices, days), P.Rules())
    assert none.daily.count() == 0 and none.trades.count() == 0
