"""The Jaccard join against all pairs, its hashes and its bounds."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from eventloom.llm import jaccard


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(n_shingles, component) of each row by all pairs; rows are (doc_id, text), ids may be null or repeated."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    least = {}
    for (doc_id, _), at in zip(rows, label, strict=True):
        if doc_id is not None:
            least[at] = min(doc_id, least.get(at, doc_id))
    return sorted(((doc_id, len(s), least.get(at)) for (doc_id, _), s, at in zip(rows, sets, label, strict=True)), key=str)


def words(n, seed, letters="abcdefghé"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(n)]


def rows():
    out, r = [], random.Random(4)
    base = words(120, 1)
    for k in range(60):  # a family: copies with up to four words changed
        w = list(base)
        for i in r.sample(range(120), k % 5):
            w[i] = f"new{k}x{i}"
        out.append(" ".join(w))
    passage = words(40, 2)
    out += [" ".join(words(own, 100 + own + 7 * k) + passage) for k in range(6) for own in (3, 5, 6, 7, 8, 9, 60)]  # around the threshold by a shared passage
    for n in range(1, 14):  # short sets, one word off, with the exact bound among them
        w = words(n + 4, 50 + n)
        out += [" ".join(w), " ".join(w[:-1]), " ".join([*w, "end"]), " ".join([*w, "end", "of"]), "\t".join(w).upper()]
    out += [None, "", " \n ", "one", "ONE", "one two", "one  two three four", "One two three four five", "é" * 3, "É" * 3, "x\x00y z"]
    out += ["same " * 5, "same " * 500, " ".join(words(20_000, 9)), " ".join(words(20_000, 9)[:-3500]), " ".join(words(20_000, 9)[:-4200])]
    ids = list(range(10, 10 + len(out)))
    r.shuffle(ids)
    named = list(zip(ids, out, strict=True))
    named += [named[0], named[0], (named[3][0], named[70][1]), (None, named[5][1]), (None, "nobody else says this at all"), (None, None)]
    r.shuffle(named)
    return named


@pytest.fixture(scope="module")
def corpus():
    return rows()


def collected(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_join(spark, corpus):
    df = spark.createDataFrame([(a, b, 1, "k") for a, b in corpus], "doc_id long, text string, unit int, key string").repartition(6)
    got = jaccard.join(df)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert collected(got) == brute(corpus)


def test_exact_end_alone_finds_all_links(spark, corpus, monkeypatch):
    """Without pivots, in small blocks and slices, with heavy lists."""
    monkeypatch.setattr(jaccard, "pivoted", lambda lists: lists.limit(0).selectExpr("gid a", "gid b"))
    for name, value in (("BLOCK", 7), ("SLICE", 5), ("HEAVY_MEANS", 0), ("HEAVY_LEAST", 3)):
        monkeypatch.setattr(jaccard, name, value)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    assert collected(jaccard.join(df)) == brute(corpus)


def test_exact_end_tells_no_more_links_than_rows(spark, monkeypatch):
    """A family that no pivot joined: all its pairs link, but a block tells only what joins its parts."""
    base, told, raised = words(150, 3), [], jaccard.raised
    family = [(k, " ".join([*base, f"own{k}"])) for k in range(300)]
    monkeypatch.setattr(jaccard, "pivoted", lambda lists: lists.limit(0).selectExpr("gid a", "gid b"))
    monkeypatch.setattr(jaccard, "raised", lambda roots, links: told.append(links.count()) or raised(roots, links))
    df = spark.createDataFrame(family, "doc_id long, text string").repartition(3)
    assert {r.component_id for r in jaccard.join(df).collect()} == {0}
    assert told and 299 <= told[0] < 3 * 300


def test_short_lists_meet_by_size_and_place(spark):
    """Forty texts of which each shares one shingle late in its prefix can't link, so none meets another; two that share all up to there, or in a long list, do."""
    late = [(1, gid, 100, 15, 1, gid) for gid in range(40)]
    other_size = [(2, 40, 100, 0, 1, 40), (2, 41, 70, 0, 1, 41)]
    near = [(3, 50, 100, 15, 16, 50), (3, 51, 100, 15, 16, 51)]
    crowd = [(4, gid, 100, 15, 1, gid) for gid in range(100, 100 + jaccard.SHORT + 1)]
    left = spark.createDataFrame(late + other_size + near + crowd, "token long, gid long, n long, pos int, seq int, root long")
    met = jaccard.meetings(left).collect()
    assert {r.gid for r in met} == {50, 51} | {r[1] for r in crowd}
    assert len({r.key for r in met if r.gid in (50, 51)}) == 1


def test_pivots_join_a_family_about_the_threshold(spark, monkeypatch):
    """Members with up to seven words changed: pairs link about as often as not, but nearly all link with the one that changed least."""
    r, base, told, raised = random.Random(7), words(300, 11), [], jaccard.raised
    family = []
    for k in range(250):
        w = list(base)
        for i in r.sample(range(300), 1 + k % 7):
            w[i] = f"new{k}x{i}"
        family.append((k, " ".join(w)))
    monkeypatch.setattr(jaccard, "raised", lambda roots, links: told.append(links.count()) or raised(roots, links))
    df = spark.createDataFrame(family, "doc_id long, text string").repartition(3)
    assert collected(jaccard.join(df)) == brute(family)
    assert told and told[0] < 60, told


def test_levels_are_those_of_all_rows(spark, corpus):
    df = spark.createDataFrame([(t,) for _, t in corpus], "_text string").repartition(5)
    levels, heavy = jaccard.bucket_levels(df)
    count = np.zeros(1 << jaccard.BUCKET_BITS, np.int64)
    for _, t in corpus:
        np.add.at(count, jaccard.Sets(pa.array([t], pa.string())).bucket(), 1)
    assert (levels == jaccard.level(count)).all()
    assert heavy == jaccard.level(np.array(jaccard.HEAVY_LEAST))
    steps = jaccard.level(np.arange(1 << 20)).astype(int)
    assert (np.diff(steps) >= 0).all() and steps[:65].tolist() == list(range(65))
    assert jaccard.level(np.array([0, 10**6, 10**7, 1 << 62])).tolist() == [0, 223, 255, 255]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert jaccard.join(empty).count() == 0
    named = spark.createDataFrame([("b", "a b c d e f"), ("a", "A b c d e f"), (None, None)], "doc_id string, text string")
    assert collected(jaccard.join(named)) == [("a", 2, "a"), ("b", 2, "a"), (None, 0, None)]


def test_hashes_tell_thue_morse_strings_apart():
    morse = np.array([bin(i).count("1") % 2 for i in range(4096)], np.uint8)
    data = np.concatenate([morse + 97, 98 - morse])
    h = jaccard.piece_hashes(data, np.array([0, 4096]), np.array([4096, 8192]))
    assert h[0] != h[1]
    r = np.random.default_rng(3)
    some = [r.integers(0, 256, n, np.uint8).tobytes() for n in list(range(1, 40)) * 5]
    some += [s[:-1] + bytes([s[-1] ^ 1]) for s in some] + [b"a" * n for n in range(1, 50)] + [b"\x00" * n for n in range(1, 50)]
    at = np.cumsum([0, *map(len, some)])
    found = jaccard.piece_hashes(np.frombuffer(b"".join(some), np.uint8), at[:-1], at[1:])
    assert len(set(found.tolist())) == len(set(some))


def test_sets_do_not_depend_on_the_block():
    texts = [" ".join(words(n, n)) for n in (0, 1, 4, 5, 6, 300)]
    whole = jaccard.Sets(pa.array(texts))
    for k, t in enumerate(texts):
        one = jaccard.Sets(pa.array([t]))
        assert one.token.tolist() == whole.token[whole.cut[k] : whole.cut[k + 1]].tolist()
        assert len(one.token) == len(shingles(t))


@pytest.mark.parametrize("n", range(1, 60))
def test_bounds(n):
    """The prefix, and the least intersection, are the ones the threshold asks for."""
    least = next(o for o in range(1, n + 1) if 100 * o >= 80 * n)
    assert jaccard.prefix_size(n) == n - least + 1
    for m in range(n, 2 * n):
        need = (80 * (n + m) + 179) // 180
        for o in range(1, n + 1):
            assert (100 * o >= 80 * (n + m - o)) == (o >= need)
