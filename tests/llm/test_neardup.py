"""Near-duplicate classes against all pairs, the similarity by its definition, and components by hand."""

import random

import numpy as np
import pyarrow as pa
import pytest

from eventloom.llm import neardup
from eventloom.llm.common import utf8


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n)]


def brute(texts):
    """Smallest index of each text's class by all pairs."""
    element, times, cut, _, _ = neardup.shingles(*utf8(neardup.lower(pa.array(texts, pa.string()))))
    df = np.zeros(neardup.IDF_BUCKETS)
    own = [(element[a:b], times[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for e, _ in own:
        df[np.unique(neardup.bucket(e))] += 1
    idf = (1 + np.log((len(texts) + 1) / (df + 1))).astype(np.float32)
    vec = [dict(zip(e.tolist(), (t * idf[neardup.bucket(e)]).tolist(), strict=True)) for e, t in own]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if vec[a] and vec[b]:
                least = sum(min(w, vec[b].get(k, 0)) for k, w in vec[a].items())
                if least / (sum(vec[a].values()) + sum(vec[b].values()) - least) >= neardup.THRESHOLD:
                    x, y = label[a], label[b]
                    label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@pytest.fixture(scope="module")
def texts():
    out = [None, "", "...", "one two", "One, two!", "one two three"]
    base = words(200, 1)
    for k in range(40):  # copies of one text with one to six words changed
        w = list(base)
        for i in random.Random(k).sample(range(200), k % 7):
            w[i] = f"new{k}x{i}"
        out.append(" ".join(w))
    for k in range(30):
        w = words(60, 100 + k)
        out += [" ".join(w), " ".join(w[:58]), " ".join(w + ["tail"])]
    return out + [" ".join(words(30_000, 9)), " ".join(words(30_000, 9)[:-100]), "same " * 50, "same " * 51]


def test_classes(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, fp string, total string").repartition(5)
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    kept = neardup.drop_near_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(got.values())


def test_a_chain_in_large_buckets_is_one_class(spark):
    """Each text reaches the threshold with the one before and the one after alone; a core that all share fills the buckets."""
    core, tail = words(1200, 5), words(20 * 1000 + 60, 6)
    rows = [(k, " ".join(core + tail[20 * k : 20 * k + 60])) for k in range(1000)]
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.class_id for r in found.collect()} == {0}


def test_near_copies_without_ids_and_a_column_named_row(spark):
    base = words(400, 50)
    near = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in (20, 160, 300)]
    for ids in ((None, 2, 5), (None, None, 5)):
        df = spark.createDataFrame([*((i, t, "mine") for i, t in zip(ids, near, strict=True)), (9, "else " + " ".join(words(50, 51)), "mine")], "doc_id long, text string, _row string")
        least = min((i for i in ids if i is not None), default=None)
        got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(df).collect()), key=str)
        assert got == sorted([*((i, least) for i in ids), (9, 9)], key=str)
        kept = neardup.drop_near_copies(df).collect()
        assert sorted((r.doc_id for r in kept), key=str) == sorted([least, 9], key=str) and {r._row for r in kept} == {"mine"}


def test_vectors_are_exact():
    idf = np.linspace(1, 3, neardup.IDF_BUCKETS).astype(np.float32)
    element = np.sort(np.random.default_rng(2).integers(0, 1 << 44, 500).astype(np.uint64))
    times = np.ones(500, np.int64)
    times[[3, 70]] = 70_000, 2
    name, weight = neardup._read_vector(neardup.write_vector(element, times), idf)
    assert (name == element).all() and np.allclose(weight, times * idf[neardup.bucket(element)])


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "A b. c d e f"), (3, None), (3, None), (None, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(df).collect()), key=str)
    assert got == sorted([(7, 7), (7, 7), (None, 7), (9, 7), (3, 3), (3, 3), (None, None)], key=str)
    assert sum(r.doc_id == 7 for r in neardup.drop_near_copies(df.where("doc_id is not null")).collect()) == 1
    assert neardup.classes(df.limit(0)).count() == 0 and neardup.drop_near_copies(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 301), (301, 300), (300, 301)]
    df = spark.createDataFrame([(f"{a:04}".encode(), f"{b:04}".encode()) for a, b in edges], "a binary, b binary")
    got = {int(r.node): int(r.root) for r in neardup.components(df).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}


def test_samples_estimate_weighted_jaccard():
    """Two rows agree in one consistent sample with the probability of their similarity."""
    r = np.random.default_rng(3)
    e = np.sort(r.integers(0, 1 << 44, 300).astype(np.uint64))
    wa, wb = r.uniform(0.5, 4, 300), r.uniform(0.5, 4, 300)
    wb[:100] = wa[:100]
    old = neardup.BANDS, neardup.ROWS
    neardup.BANDS, neardup.ROWS = 600, 1
    try:
        both = neardup.band_hashes(np.concatenate([e, e]), np.concatenate([wa, wb]), np.array([0, 300, 600]), neardup.Pool())
    finally:
        neardup.BANDS, neardup.ROWS = old
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((both[0] == both[1]).mean() - want) < 0.07
