"""Importance resampling and the divergence audit against plain Python, on rows with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from eventloom.llm import divergence, importance
from eventloom.llm.common import utf8


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def runs(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def texts(n, seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeéñXYZ09") for _ in range(r.randint(1, 9))) for _ in range(60)]
    return [r.choice((" ", ", ", "\n")).join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_checksums_of_runs():
    some = ["", "a", " Ab c-9 é", "x" * 1000 + " " + "y" * 65 + " " + "z" * 64 + " q", *texts(50, 3)]
    row, bucket, words = importance.feature_buckets(*utf8(pa.array(some)), importance.Crc())
    assert words.tolist() == [len(runs(t)[0]) for t in some]
    want = sorted((i, zlib.crc32(f.encode()) % importance.BUCKETS) for i, t in enumerate(some) for f in runs(t)[1])
    assert sorted(zip(row.tolist(), bucket.tolist(), strict=True)) == want


def resampled(docs, target):
    """The whole result by plain Python: (doc_id, n_features, weight, score, rank)."""
    size = importance.BUCKETS
    hashed = [[zlib.crc32(f.encode()) % size for f in runs(t)[1]] for _, t in docs]
    s, t = Counter(b for x in hashed for b in x), Counter(zlib.crc32(f.encode()) % size for x in target for f in runs(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + size) / ((s[b] + 1.0) * (all_t + size)))) for b in range(size)]
    out = []
    for (doc_id, text), x in zip(docs, hashed, strict=True):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        out.append((doc_id, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(runs(text)[0])))
    able = [r for r in out if r[4] >= importance.MIN_WORDS]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: 5 * len(able) // 100]
    result = [[*r[:4], None] for r in out]
    for k, r in enumerate(drawn, 1):
        next(x for x in result if tuple(x[:4]) == r[:4] and x[4] is None)[4] = k
    return sorted(map(tuple, result), key=str)


def test_resample(spark):
    rows = [(i, t) for i, t in enumerate(texts(400, 1))] + [(None, texts(1, 2)[0]), (None, None), (500, ""), (501, "one " * 30_000)]
    rows += [(900, texts(9, 4)[-1] + " more words" * 20)] * 40
    df = spark.createDataFrame([(a, b, "x", 1.0, "y") for a, b in rows], "doc_id long, text string, score string, weight double, key string").repartition(7)
    target = [None, *texts(20, 1)[:9]]
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=str) == resampled(rows, target)


def test_resample_of_nothing(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert importance.resample(docs, target).count() == 0
    few = importance.resample(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), target)
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in few.collect()) == [(1, 6, None), (2, 0, None)]


def test_ids_that_are_strings(spark):
    docs = spark.createDataFrame([(f"d{i}", "w " * 25) for i in range(40)] + [(None, "w " * 25)], "doc_id string, text string")
    got = importance.resample(docs, docs.select("text"))
    drawn = sorted((r["rank"], r.doc_id) for r in got.collect() if r["rank"])
    best = sorted(got.collect(), key=lambda r: (-r.score, r.doc_id is None, r.doc_id or ""))[:2]
    assert drawn == [(i, r.doc_id) for i, r in enumerate(best, 1)]


def test_kth_key_with_many_equal_rows(spark):
    r = random.Random(5)
    keys = ["%032x" % (r.randrange(1 << 20) << r.choice((0, 40, 90))) for _ in range(300)] + ["%032x" % 77] * 200
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(5)
    keys.sort()
    for k in (1, 2, 150, 260, len(keys)):
        key, left = importance.kth_key(df, k)
        assert key == keys[k - 1] and left == k - keys.index(key)


def audited(rows, min_docs, top):
    groups, by_lang = {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        t = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text))
        groups.setdefault((lang, source), Counter()).update(t)
        by_lang.setdefault(lang, Counter()).update(set(t))
    out = []
    for lang, df in by_lang.items():
        kept = [t for t, n in df.items() if n >= min_docs]
        mine = {s: c for (at, s), c in groups.items() if at == lang}
        whole = sum(mine.values(), Counter())

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in mine.items()}
        for s, c in mine.items():
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def test_audit(spark):
    r = random.Random(8)
    pool = ["alpha", "Beta", "gämma", "Ünd", "d", "eps", "zeta", "42"]
    rows = [(r.choice(["en", "de", "EN", None]), r.choice(["a", "b", "c", None]), " ".join(r.choices(pool, range(1, 9), k=r.randint(0, 12)))) for _ in range(300)]
    rows += [("en", "empty", None), ("xx", "only", "word"), ("yy", "p", "word"), ("yy", "q", ""), ("en", "a", "alpha " * 50_000)] + [("en", "a", "same row")] * 40
    df = spark.createDataFrame([(*x, 1, "n") for x in rows], "lang string, source string, text string, term int, docs string").repartition(6)
    got = divergence.audit(df, 10, 3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == audited(rows, 10, 3)
    assert divergence.audit(df.limit(0)).count() == 0


@pytest.mark.parametrize("count", [0, 8_999_999_999, 9_000_000_000, 10**12])
def test_shares_are_exact(spark, count):
    df = spark.createDataFrame([(count, 3 * count, 7)], "n long, total long, v long")
    assert df.select(divergence.share("n", "total", "v")).first()[0] == 1 + 10**9 * (count + 5) // (3 * count + 35)
