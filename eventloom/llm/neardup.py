"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of five-word shingles, in IDF_BUCKETS hash buckets: a shingle's frequency is its bucket's. The
   table has a fixed size whatever the corpus, all rows count, and what it must tell apart (lines and passages that
   much of the corpus shares) stands far above a bucket's usual load.
2. A map over the texts gives each a fingerprint of its words and BANDS hashes of ROWS weighted samples each. Texts with
   equal fingerprints are one unit from here on.
3. In each bucket (band, hash) every unit is paired with the bucket's pivot, and with the pivot of those that share the
   next band as well, and with its neighbours in the bucket sorted by further bands: candidates are linear in the
   units, whatever the size of a bucket. Pairs whose total weights rule out the threshold go.
4. Each candidate is verified: exact weighted Jaccard similarity of the two shingle vectors, THRESHOLD or more.
5. Connected components of the verified links (large-star, small-star) give the classes. Where a bucket still holds
   more than one component, steps 3 to 5 are repeated with other pivots, TURNS turns in all.
6. What the turns leave is ended exactly: in every bucket that still holds more than one component, all pairs of units of
   different components are compared. So each pair that shares a band and reaches the threshold is in one class.

Words are runs of bytes outside white space and . , ; : ! ? quotes and brackets, in lower case. A text of one to four words has one
shingle of them all.

Where one side of a join is an aggregate of the other, it is staged first: Spark then sees two plain shuffles and splits a key that holds
much of the rows (a pivot, a large bucket, a star).

Defined cases: null texts and texts without words are alone in their class; a null doc_id takes the class of its copies and near copies, and
null if none has an id; repeated rows share a class; the class id is the smallest doc_id of the class; an empty table gives an
empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Runs, _powers, blocks, byte_set, mix, neighbours, numbered, odd_ids, partitions, small_batches, stage, utf8
from .toxicity import lower

SHINGLE, THRESHOLD = 5, 0.8
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** 4) ** 14, 0.06 %.
BANDS, ROWS = 14, 4
#: Turns of candidate search; a bucket is sorted by DEPTH bands at each of these distances.
TURNS, DEPTH, STRIDES = 3, 5, (1, 3)
#: In the exact end, units of a block, and units that it meets in one group of rows; buckets of up to DONE units need no
#: such end, as the pivots of the first two turns are in each of their pairs.
BLOCK, SLICE, DONE = 256, 1024, 3
IDF_BUCKETS = 1 << 16
#: Ids that may be broadcast to select texts; more are joined by a shuffle.
BROADCAST_IDS = 300_000
_SEP = byte_set(ASCII_SPACE, b""".,;:!?"'()[]{}""")
_ROW_SHIFT = np.uint64(44)
_E_MASK = np.uint64((1 << 44) - 1)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Runs, np.ndarray]:
    """(element, times, cut, words, word hashes): row r has the sorted distinct 44-bit elements cut[r] .. cut[r + 1]."""
    words = Runs(data, at, _SEP)
    h = words.hashes()
    whole = np.flatnonzero(words.row[SHINGLE - 1 :] == words.row[: -(SHINGLE - 1)]) if len(h) >= SHINGLE else np.zeros(0, np.int64)
    p = _powers(SHINGLE)
    key = sum((h[whole + k] * p[k] for k in range(SHINGLE)), np.zeros(len(whole), np.uint64))
    row = words.row[whole]
    n = np.diff(words.first)
    for r in np.flatnonzero((n > 0) & (n < SHINGLE)).tolist():
        key = np.append(key, (h[words.first[r] : words.first[r + 1]] * p[: n[r]]).sum(dtype=np.uint64) + np.uint64(n[r]))
        row = np.append(row, r)
    packed = (row.astype(np.uint64) << _ROW_SHIFT) | (mix(key) >> np.uint64(20))
    packed, times = np.unique(packed, return_counts=True)
    cut = np.searchsorted(packed, np.arange(len(at), dtype=np.uint64) << _ROW_SHIFT)
    return packed & _E_MASK, times, cut, words, h


def bucket(element: np.ndarray) -> np.ndarray:
    return (element >> np.uint64(28)).astype(np.int64)


def fingerprints(words: Runs, h: np.ndarray) -> list[bytes | None]:
    """128 bits of each row's word sequence; null without words."""
    n = np.diff(words.first)
    some = n > 0
    place = np.arange(len(h)) - np.repeat(words.first[:-1], n)
    p = _powers(int(n.max(initial=0)))[place] if len(h) else np.zeros(0, np.uint64)
    starts = words.first[:-1][some]
    out = np.zeros((len(n), 2), np.uint64)
    if len(starts):
        out[some, 0] = mix(np.add.reduceat(h * p, starts) + n[some].astype(np.uint64))
        out[some, 1] = mix(np.add.reduceat(mix(h + np.uint64(7)) * p, starts) ^ n[some].astype(np.uint64))
    raw = out.tobytes()
    return [raw[16 * k : 16 * k + 16] if some[k] else None for k in range(len(n))]


class Pool:
    """Draws for the weighted samples: r and c from Gamma(2, 1), b uniform; an element's hash picks one for each sample."""

    def __init__(self):
        rng = np.random.default_rng(20_240_601)
        r, c = rng.gamma(2.0, 1.0, 1 << 16), rng.gamma(2.0, 1.0, 1 << 16)
        self.r, self.b = np.maximum(r, 1e-3).astype(np.float32), rng.random(1 << 16).astype(np.float32)
        self.inverse, self.log_c = (1 / self.r).astype(np.float32), np.log(np.maximum(c, 1e-6)).astype(np.float32)


def band_hashes(element: np.ndarray, weight: np.ndarray, cut: np.ndarray, pool: Pool) -> np.ndarray:
    """For each row that has elements, BANDS hashes, each of ROWS consistent samples (element, level)."""
    starts = cut[:-1][np.diff(cut) > 0]
    log_w = np.log(weight).astype(np.float32)
    low = (mix(element) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.zeros((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        draw = mix(element + np.uint64((band + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        value = np.zeros(len(starts), np.uint64)
        for k in range(ROWS):
            i = ((draw >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            r, b = pool.r[i], pool.b[i]
            level = np.floor(log_w * pool.inverse[i] + b)
            log_a = pool.log_c[i] - r * (level - b + 1) + np.float32(256)
            name = low ^ (level.astype(np.int64).astype(np.uint32) * np.uint32(0x9E3779B1))
            # the bits of a positive float sort as the number does; equal values are told apart by the sample's name
            packed = (np.maximum(log_a, 0).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | name
            least = np.minimum.reduceat(packed, starts) & np.uint64(0xFFFFFFFF)
            value = mix(value + least + np.uint64(k + 1))
        out[:, band] = value
    return out


# ---- the stages ----


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, docs = np.zeros(IDF_BUCKETS, np.int64), 0
    for block in blocks(batches, "_text"):
        element, _, cut, _, _ = shingles(*utf8(lower(block.column("_text"))))
        row = np.repeat(np.arange(block.num_rows), np.diff(cut))
        seen = np.unique(row * IDF_BUCKETS + bucket(element)) % IDF_BUCKETS
        count += np.bincount(seen, minlength=IDF_BUCKETS)
        docs += block.num_rows
    used = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(count[used], docs))], ["bucket", "n"])


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """Weight of each bucket: 1 + log(documents / documents with it). IDF_BUCKETS numbers, whatever the input."""
    got = rows.mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(IDF_BUCKETS)
    df[at[at >= 0]] = n[at >= 0]
    total = n[at < 0].sum()
    return (1 + np.log((total + 1) / (df + 1))).astype(np.float32)


def _sign(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    pool = Pool()
    for block in blocks(batches, "_text"):
        element, times, cut, words, h = shingles(*utf8(lower(block.column("_text"))))
        weight = times * idf[bucket(element)]
        total = np.concatenate([[0], np.cumsum(weight, dtype=np.float64)])
        some = np.diff(cut) > 0
        bands = np.zeros((block.num_rows, BANDS), np.uint64)
        if some.any():
            bands[some] = band_hashes(element, weight, cut, pool)
        columns = [block.column("doc_id"), block.column("key"), pa.array(fingerprints(words, h), pa.binary()), pa.array((total[cut[1:]] - total[cut[:-1]]).astype(np.float32))]
        columns += [pa.array(bands[:, k].view(np.int64)) for k in range(BANDS)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "fp", "total", *(f"b{k}" for k in range(BANDS))])


def signatures(rows: DataFrame, idf) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    bands = ", ".join(f"b{k} long" for k in range(BANDS))
    return rows.mapInArrow(lambda b: _sign(b, idf.value), f"doc_id {kind}, key long, fp binary, total float, {bands}")


def members(units: DataFrame) -> DataFrame:
    """(band, hash, then, fp, total) of units that share a bucket with another; then is the next band's hash."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"b{k}").alias("hash"), F.col(f"b{(k + 1) % BANDS}").alias("then")) for k in range(BANDS)]))
    member = units.select("fp", "total", each.alias("at")).select("fp", "total", "at.*")
    shared = stage(member.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    return member.join(shared, ["band", "hash"])


def adjacent(member: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs (fp, other, total, other_total) of units next to each other in a bucket sorted by their further bands.

    Near copies share bands, so they sort near one another. The order is global (see neighbours): no bucket is gathered.
    """
    bands = units.select("fp", F.array(*[f"b{k}" for k in range(BANDS)]).alias("bands"))
    rest = F.array(*[F.array(*[F.get("bands", F.pmod(F.col("band") + d * s, F.lit(BANDS))) for d in range(1, DEPTH)]) for s in STRIDES])
    sorts = member.join(bands, "fp").select("band", "hash", "fp", "total", F.posexplode(rest).alias("stride", "rest"))
    order = ["band", "hash", "stride", "rest", "fp"]
    rows = neighbours(sorts, order, ["band", "hash", "stride", "fp", "total"], after=False)
    same = (F.col("band") == F.col("before.band")) & (F.col("hash") == F.col("before.hash")) & (F.col("stride") == F.col("before.stride"))
    return rows.where(same).select("fp", "total", F.col("before.fp").alias("other"), F.col("before.total").alias("other_total"))


def candidates(member: DataFrame, units: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b), a < b: each unit with the pivots of its buckets, where both aren't in one component yet.

    The first turn takes the smallest fingerprint, so the bands agree on few pairs, and adds adjacent units; later turns
    take the first and last by a hash of (fingerprint, band, turn), so every band has pivots of its own.
    """
    order = F.xxhash64("fp", "band", F.lit(turn)) if turn else F.lit(0)
    one = F.struct(order.alias("order"), "fp", "total", "root")
    pairs = None
    for keys in (["band", "hash"], ["band", "hash", "then"]):
        pivots = [F.min(one), F.max(one)] if turn else [F.min(one)]
        pivot = member.groupBy(*keys).agg(F.array(*pivots).alias("pivots"), (F.min("root") != F.max("root")).alias("mixed"))
        both = member.join(stage(pivot.where("mixed").drop("mixed"), "pivots"), keys).select("fp", "total", "root", F.explode("pivots").alias("pivot"))
        both = both.where(F.col("root") != F.col("pivot.root"))
        found = both.select("fp", "total", F.col("pivot.fp").alias("other"), F.col("pivot.total").alias("other_total"))
        pairs = found if pairs is None else pairs.unionByName(found)
    if not turn:
        pairs = pairs.unionByName(adjacent(member, units))
    near = F.least("total", "other_total") >= THRESHOLD * 0.999 * F.greatest("total", "other_total")
    return pairs.where(near).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def write_vector(element: np.ndarray, times: np.ndarray) -> bytes:
    """Elements in 6 bytes each; their counts where these aren't 1."""
    more = np.flatnonzero(times != 1)
    parts = (np.array([len(element), len(more)], np.uint32), (element >> np.uint64(12)).astype(np.uint32), more.astype(np.uint32), times[more].astype(np.uint32))
    return b"".join(x.tobytes() for x in parts) + (element & np.uint64(0xFFF)).astype(np.uint16).tobytes()


def _read_vector(raw: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(elements, weights)"""
    n, m = np.frombuffer(raw, np.uint32, 2).tolist()
    high, more, times = (np.frombuffer(raw, np.uint32, k, at) for k, at in ((n, 8), (m, 8 + 4 * n), (m, 8 + 4 * (n + m))))
    low = np.frombuffer(raw, np.uint16, n, 8 + 4 * (n + 2 * m))
    weight = idf[high >> np.uint32(16)]
    weight[more] *= times
    return (high.astype(np.uint64) << np.uint64(12)) | low, weight


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, vec), once for each fingerprint that a task meets; fp is that of the row's key, which another text may have by chance."""
    seen: set[bytes] = set()
    for block in blocks(batches, "_text"):
        fresh = [fp not in seen for fp in block.column("fp").to_pylist()]
        if not any(fresh):
            continue
        block = block.filter(pa.array(fresh, pa.bool_()))
        element, times, cut, words, h = shingles(*utf8(lower(block.column("_text"))))
        own, keep = fingerprints(words, h), []
        for k, fp in enumerate(block.column("fp").to_pylist()):
            if own[k] == fp and fp not in seen:
                seen.add(fp)
                keep.append(k)
        vec = [write_vector(element[cut[k] : cut[k + 1]], times[cut[k] : cut[k + 1]]) for k in keep]
        yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in keep], pa.binary()), pa.array(vec, pa.binary())], ["fp", "vec"])


def vectors_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, vec) of the wanted (key, fp), once each; staged."""
    found = rows.join(sized_broadcast(wanted), "key").select("fp", "_text").mapInArrow(_vectors, "fp binary, vec binary")
    found = stage(found, "vectors")
    # rows that are wholly repeated have one key and may lie in several tasks
    if found.count() > wanted.select("fp").distinct().count():
        found = stage(found.dropDuplicates(["fp"]), "vectors")
    return found


def similarity(a: bytes, b: bytes, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two vectors."""
    (na, wa), (nb, wb) = _read_vector(a, idf), _read_vector(b, idf)
    at = np.minimum(np.searchsorted(na, nb), len(na) - 1)
    both = na[at] == nb
    least = float(np.minimum(wa[at[both]], wb[both]).sum())
    return least / (float(wa.sum()) + float(wb.sum()) - least)


def _verify(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        va, vb = batch.column("va"), batch.column("vb")
        sim = [similarity(x.as_py(), y.as_py(), idf) for x, y in zip(va, vb, strict=True)]
        keep = pa.array([s >= THRESHOLD for s in sim], pa.bool_())
        out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim, pa.float64())], ["a", "b", "similarity"])
        yield out.filter(keep)


class Block:
    """The vectors of some units by shingle, to compare another with all of them at once."""

    def __init__(self, vectors: list[bytes], idf: np.ndarray):
        read = [_read_vector(v, idf) for v in vectors]
        name, weight = np.concatenate([n for n, _ in read]), np.concatenate([w for _, w in read]).astype(np.float64)
        row = np.repeat(np.arange(len(read)), [len(n) for n, _ in read])
        order = np.argsort(name, kind="stable")
        self.idf, self.row, self.weight = idf, row[order], weight[order]
        self.name, first = np.unique(name[order], return_index=True)
        self.first = np.append(first, len(order))
        self.total = np.bincount(row, weight, len(read))

    def near(self, vector: bytes) -> list[int]:
        """The units that may reach the threshold with the vector: all that do, and those a rounding error below it."""
        name, weight = _read_vector(vector, self.idf)
        at = np.minimum(np.searchsorted(self.name, name), len(self.name) - 1)
        hit = self.name[at] == name
        first = self.first[at[hit]]
        n = self.first[at[hit] + 1] - first
        place = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        least = np.bincount(self.row[place], np.minimum(self.weight[place], np.repeat(weight[hit], n)), len(self.total))
        return np.flatnonzero(least >= (THRESHOLD - 1e-4) * (self.total + float(weight.sum()) - least)).tolist()


def _meet(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of components, from sorted groups of rows: the units of a block (side 0), then those that they meet."""
    now = block = None
    own: list[tuple] = []
    seen: set[tuple] = set()
    for batch in batches:
        links = []
        for key, side, fp, root, vec in zip(*(batch.column(c).to_pylist() for c in ("key", "side", "fp", "root", "vec")), strict=True):
            if key != now:
                now, block, own, seen = key, None, [], set()
            if side == 0:
                own.append((fp, root, vec))
                continue
            block = block or Block([v for _, _, v in own], idf)
            for k in block.near(vec):
                other, other_root, other_vec = own[k]
                link = min(root, other_root), max(root, other_root)
                if root == other_root or link in seen:
                    continue
                (_, va), (_, vb) = sorted([(fp, vec), (other, other_vec)])
                if similarity(va, vb, idf) >= THRESHOLD:
                    seen.add(link)
                    links.append(link)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])


def remaining(member: DataFrame, roots: DataFrame, vectors: DataFrame, idf) -> DataFrame | None:
    """Links (a, b) of components, from all pairs of units of different components that share a bucket; None without such pairs.

    In each mixed bucket the units outside its largest component are few; they meet all units of the bucket. Each of the few
    belongs to one block, that of the largest bucket it is among the few of, so a vector is sent once to a block and not once
    to a pair; large blocks, and large crowds that meet one, are dealt by hash.
    """
    keys = ["band", "hash"]
    at = rooted(member.select(*keys, "fp"), "fp", roots)
    parts = at.groupBy(*keys, "root").agg(F.count("*").alias("n"))
    held = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("most"))
    mixed = stage(at.join(stage(held.where(f"roots > 1 and n > {DONE}").drop("roots"), "held"), keys), "mixed")
    if not mixed.limit(1).count():
        return None
    few = mixed.where("root != most")
    home = few.groupBy("fp", "root").agg(F.max(F.struct("n", "band", "hash")).alias("home"))
    size = home.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.struct("home.band", "home.hash", F.pmod(F.xxhash64("fp"), "blocks").alias("number"))
    homes = stage(home.join(size, "home").select("fp", "root", block.alias("block")), "homes")
    meets = few.select(*keys, "fp").join(homes.select("fp", "block"), "fp").select(*keys, "block").distinct()
    met = stage(mixed.join(meets, keys).select("fp", "root", "block").distinct(), "met")
    slices = stage(met.groupBy("block").agg(F.ceil(F.count("*") / SLICE).alias("slices")), "slices")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")
    here = homes.join(slices, "block").select("block", every, F.lit(0).alias("side"), "fp", "root")
    there = met.join(slices, "block").select("block", F.pmod(F.xxhash64("fp"), "slices").alias("slice"), F.lit(1).alias("side"), "fp", "root")
    rows = here.unionByName(there).select(F.xxhash64("block", "slice").alias("key"), "side", "fp", "root").join(vectors, "fp")
    rows = rows.repartition(partitions(member.sparkSession), "key").sortWithinPartitions("key", "side")
    return rows.mapInArrow(lambda b: _meet(b, idf.value), "a binary, b binary")


def sized_broadcast(ids: DataFrame) -> DataFrame:
    """ids marked for broadcast if a count shows that they're few; else as they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def verified(pairs: DataFrame, vectors: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold, with it."""
    one = pairs.join(vectors.select(F.col("fp").alias("b"), F.col("vec").alias("vb")), "b")
    two = one.join(vectors.select(F.col("fp").alias("a"), F.col("vec").alias("va")), "a")
    return two.mapInArrow(lambda x: _verify(x, idf.value), "a binary, b binary, similarity double")


def linked(rows: DataFrame, units: DataFrame, idf) -> DataFrame:
    """(node, root) of the units that have a verified link."""
    member = stage(members(units), "members")
    wanted = stage(units.join(member.select("fp").distinct(), "fp").select("key", "fp"), "wanted")
    vectors = vectors_of(rows, wanted)
    roots = tested = None
    for turn in range(TURNS):
        at = member.withColumn("root", F.col("fp")) if roots is None else rooted(member, "fp", roots)
        pairs = candidates(at, units, turn)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        new = verified(pairs, vectors, idf).select("a", "b")
        if roots is None:
            roots = components(new)
        else:
            # links between components; their components, and what was under their roots before
            for c in ("a", "b"):
                new = rooted(new, c, roots).drop(c).withColumnRenamed("root", c)
            roots = raised(roots, new)
        tested = pairs if tested is None else tested.unionByName(pairs)
    new = remaining(member, roots, vectors, idf)
    return roots if new is None else raised(roots, new)


def raised(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after links between roots."""
    above = components(links)
    moved = roots.select("node", F.col("root").alias("old"))
    return stage(rooted(moved, "old", above).select("node", "root").union(above).distinct(), "roots")


def rooted(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """df with `root`, that of the column's node; a node without links is its own."""
    named = roots.select(F.col("node").alias("_node"), "root")
    return df.join(named, df[column] == named["_node"], "left").select(*[df[c] for c in df.columns], F.coalesce("root", column).alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) is connected with.

    Alternating large-star and small-star until every node points at its root; each round is staged.
    """
    edges = stage(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges")
    while True:
        # large-star: each node's larger neighbours go to the smallest of its neighbourhood
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).union(edges.select("high", "low"))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high"))
        # small-star: each node's smaller neighbours and itself go to the smallest of them
        large = stage(large.distinct(), "large")
        least = stage(large.groupBy("high").agg(F.min("low").alias("m")), "least")
        small = large.join(least, "high")
        small = small.where("low != m").select(F.col("m").alias("low"), F.col("low").alias("high")).union(small.select("m", "high")).distinct()
        edges = stage(small, "stars")
        high = edges.groupBy("high").count()
        open_ends = edges.join(high.select(F.col("high").alias("low")), "low", "left_semi")
        if not high.where("count > 1").limit(1).count() and not open_ends.limit(1).count():
            break
    return stage(edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(edges.select("low", "low")).distinct(), "roots")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, kept (the one of its class that stays) for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    key = F.xxhash64(docs[id_col], docs[text_col])
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"), key.alias("key"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(rows))
    signed = stage(signatures(rows, idf), "signatures")
    same = signed.where("fp is not null").groupBy("fp", "total", *(f"b{k}" for k in range(BANDS)))
    units = stage(same.agg(F.min("doc_id").alias("rep"), F.min("key").alias("key")), "units")
    roots = linked(rows, units, idf)
    named = units.select("fp", "rep").join(roots, units["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "named")
    smallest = stage(named.groupBy("root").agg(F.min("rep").alias("class_id")), "smallest")
    by_fp = named.join(smallest, "root").select("fp", "class_id")
    out = signed.select("doc_id", "fp").join(by_fp, "fp", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)) | (F.col("doc_id").isNull() & F.col("class_id").isNull()))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one row of each class: that with the smallest doc_id, null last.

    Where a doc_id is null or repeated, rows are told apart by a number of their own.
    """
    if odd_ids(docs):
        rows, row = numbered(docs)
        found = classes(rows, row).select(F.col("doc_id").alias(row), "class_id")
        first = F.min_by(row, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row))
        best = rows.select(row, "doc_id").join(found, row).groupBy("class_id").agg(first.alias(row))
        return rows.join(best.select(row), row, "left_semi").select(docs.columns)
    gone = stage(classes(docs).where(~F.col("kept")).select("doc_id"), "gone")
    return docs.join(sized_broadcast(gone), "doc_id", "left_anti").select(docs.columns)
