"""N-gram Jaccard join by grouped prefixes: every pair of documents whose five-word shingle sets reach PERCENT, as components.

1. Shingles are counted in 2 ** BUCKET_BITS hash buckets (a fixed-size table); the global order of shingles is (level of the bucket's count, hash). Any order gives
   the same result; this one puts passages that several texts share last. Only what stands out of a bucket's usual load does so: what doesn't is in prefixes by
   chance, and texts that share it meet in the exact end. With few buckets these meetings grow faster than the input.
2. A map over the texts gives each its set's size, a fingerprint and its prefix: two sets that link share one of their first n - ceil(0.8 n) + 1 shingles.
   Equal sets are one unit; units of equal prefix and size are one group, so a prefix is posted once for a group.
3. Prefix shingles that more than one group has make the lists. Each group is paired with the few it shares most with among the pivots of its lists; these
   pairs, and those of the units of a group with its first, are verified on the whole sets and give components (large-star, small-star).
4. The exact end compares all groups that share a list and aren't in one component. Those outside a list's largest component are few; they are gathered in blocks by the
   longest list they are in, and meet what shares a list with them, in short lists only what sizes and places allow. A first pass over the prefixes alone keeps those with a partner whose sizes and shared shingles allow
   the threshold: nothing more is shared up to the last shared one, nor up to the end of the prefix that ends first.
5. What is kept is expanded to the groups' units, whose whole sets are compared block by block; a block tells only the links that join what it hasn't joined yet.

Links inside a component change nothing, so copies and large families cost their size, not its square. Blocks and slices are of bounded size; a list that is itself long (see
HEAVY) is never sorted in one task.

Words are runs of bytes outside white space; only A-Z are lower-cased. Shingles are 54-bit hashes, 48 bits where sets are compared: two sets of 600
shingles have a false match with probability 1e-9.

Defined cases: a null text or one without words has n_shingles 0 and is alone; one to four words are one shingle; repeated rows and equal sets
share a component; a null doc_id takes the component of its links, and null if none has an id; ids of any type, the smallest names the component; very long texts
are one block of their own; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Runs, blocks, byte_set, mix, partitions, small_batches, stage, utf8
from .neardup import components, raised, rooted, sized_broadcast

SHINGLE, PERCENT = 5, 80
#: Hash buckets whose counts order the shingles, and those of a range: 2 ** 24 bytes on the driver and in each worker, whatever the input.
BUCKET_BITS, RANGE_BITS = 24, 16
#: Pivots of a list before the exact end, and how many of them a group is verified with.
PIVOTS, PARTNERS = 3, 3
#: In the exact end, rows of a block, rows that it meets in one task's group, and rows of a list whose pairs are looked at one by one.
BLOCK, SLICE, SHORT = 256, 1024, 64
#: A shingle whose bucket counts more than so many times the mean bucket, and so many more, has HEAVY in its name: its list may hold much of the rows.
HEAVY_MEANS, HEAVY_LEAST, HEAVY = 4, 4096, np.uint64(1 << 62)
#: Bits of the map that tells which texts' sets are wanted: 2 MB, whatever the input; a full map only filters less.
MAP_BITS = 24
_ROWS, _BITS = 1024, 54
_SEP = byte_set(ASCII_SPACE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOKEN = np.uint64((1 << _BITS) - 1)


def piece_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs: each piece of eight bytes is mixed with its place before it is added."""
    size = end - start
    pieces = -(-size // 8)
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    begin = np.repeat(start, pieces) + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded.data, strides=(1,))
    n = np.minimum(np.repeat(end, pieces) - begin, 8).astype(np.uint64)
    value = words[begin] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * n))
    value = mix(mix(value + n) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)


def _chain(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = mix(out + h[at + k])
    return out


class Sets:
    """Shingle sets of a block's rows: row r has the sorted distinct tokens cut[r] .. cut[r + 1]."""

    def __init__(self, column: pa.Array):
        data, at = utf8(column)
        data = _LOWER[data]
        words = Runs(data, at, _SEP)
        h = piece_hashes(data, words.start, words.end)
        whole = np.flatnonzero(words.row[SHINGLE - 1 :] == words.row[: 1 - SHINGLE]) if len(h) >= SHINGLE else np.zeros(0, np.int64)
        n = np.diff(words.first)
        token, row = [_chain(h, whole, SHINGLE)], [words.row[whole]]
        for k in range(1, SHINGLE):
            short = np.flatnonzero(n == k)
            token.append(_chain(h, words.first[short], k))
            row.append(short)
        packed = (np.concatenate(row).astype(np.uint64) << np.uint64(_BITS)) | (np.concatenate(token) >> np.uint64(64 - _BITS))
        packed = np.unique(packed)
        self.token = packed & _TOKEN
        # row 1024, the end of a full block, is past 64 bits
        self.cut = np.append(np.searchsorted(packed, np.arange(len(at) - 1, dtype=np.uint64) << np.uint64(_BITS)), len(packed))
        self.size = np.diff(self.cut)
        self.row = np.repeat(np.arange(len(at) - 1), self.size)

    def bucket(self) -> np.ndarray:
        return (self.token >> np.uint64(_BITS - BUCKET_BITS)).astype(np.int64)

    def digests(self, token: np.ndarray, size: np.ndarray) -> list[bytes | None]:
        """128 bits of each row's tokens, in any order, and of its set's size; null without tokens."""
        some, out = np.flatnonzero(size), np.zeros((len(size), 2), np.uint64)
        if len(some):
            starts = (np.cumsum(size) - size)[some]
            for k, salt in enumerate((1, 2)):
                out[some, k] = mix(np.add.reduceat(mix(mix(token + np.uint64(salt)) + np.uint64(salt)), starts) + self.size[some].astype(np.uint64))
        raw = out.tobytes()
        return [raw[16 * k : 16 * k + 16] if size[k] else None for k in range(len(size))]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for block in blocks(batches, "_text"):
        for first in range(0, block.num_rows, _ROWS):
            part = block.slice(first, _ROWS)
            yield part, Sets(part.column("_text"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, at, n): the buckets of each range that a task has met, in two bytes each, and their counts in four."""
    count = np.zeros(1 << BUCKET_BITS, np.uint32)
    for _, sets in _sets(batches):
        np.add.at(count, sets.bucket(), 1)
    for part, own in enumerate(count.reshape(-1, 1 << RANGE_BITS)):
        at = np.flatnonzero(own)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([own[at].tobytes()], pa.binary())], ["part", "at", "n"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, levels, total) of the ranges that a task has got."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, at, n in zip(*(batch.column(c) for c in ("part", "at", "n")), strict=True):
            own = counts.setdefault(part.as_py(), np.zeros(1 << RANGE_BITS, np.int64))
            own[np.frombuffer(at.as_py(), np.uint16)] += np.frombuffer(n.as_py(), np.uint32)
    for part, own in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level(own).tobytes()], pa.binary()), pa.array([int(own.sum())], pa.int64())], ["part", "levels", "total"])


def level(count: np.ndarray) -> np.ndarray:
    """A byte that rises with the count: the count up to 64, then steps of a sixteenth, 255 from seven million on."""
    return np.minimum(np.where(count <= 64, count, 64 + np.log(np.maximum(count, 64) / 64) / np.log(1 + 1 / 16)), 255).astype(np.uint8)


def bucket_levels(rows: DataFrame) -> tuple[np.ndarray, int]:
    """The level of each bucket's count, and the level above which a bucket is heavy."""
    counts = rows.select("_text").mapInArrow(_counts, "part int, at binary, n binary")
    got = counts.repartition(partitions(rows.sparkSession), "part").mapInArrow(_levels, "part int, levels binary, total long").toArrow()
    out = np.zeros((1 << (BUCKET_BITS - RANGE_BITS), 1 << RANGE_BITS), np.uint8)
    for part, levels in zip(got.column("part").to_pylist(), got.column("levels"), strict=True):
        out[part] = np.frombuffer(levels.as_py(), np.uint8)
    mean = sum(got.column("total").to_pylist()) >> BUCKET_BITS
    return out.ravel(), int(level(np.array(HEAVY_MEANS * mean + HEAVY_LEAST)))


def prefix_size(n):
    """n - ceil(n * PERCENT / 100) + 1"""
    return n - (PERCENT * n + 99) // 100 + 1


def _sign(batches: Iterator[pa.RecordBatch], levels: np.ndarray, heavy: int) -> Iterator[pa.RecordBatch]:
    for block, sets in _sets(batches):
        # tokens are sorted within a row, so a stable sort by the bucket's level leaves ties in the order of tokens
        own = levels[sets.bucket()]
        order = np.argsort((sets.row << 8) | own, kind="stable")
        keep = np.where(sets.size > 0, prefix_size(sets.size), 0)
        place = np.arange(len(order)) - np.repeat(sets.cut[:-1], sets.size)
        first = order[place < np.repeat(keep, sets.size)]
        prefix = sets.token[first]
        offsets = np.concatenate([[0], np.cumsum(keep)])
        columns = [
            block.column("doc_id"), block.column("key"), pa.array(sets.size.astype(np.int64)), pa.array(sets.digests(sets.token, sets.size), pa.binary()),
            pa.array(sets.digests(prefix, keep), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((prefix | np.where(own[first] > heavy, HEAVY, np.uint64(0))).view(np.int64))),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "fp", "group_fp", "prefix"])


def signatures(rows: DataFrame, levels) -> DataFrame:
    """doc_id, key, n (size of the set), fp (of the set), group_fp (of prefix and size), prefix in the global order; fp is null for an empty set."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _sign(b, *levels.value), f"doc_id {kind}, key long, n long, fp binary, group_fp binary, prefix array<long>")


def _vectors(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    def some(batches):
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            yield batch.filter(pa.array((wanted[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1))

    for block, sets in _sets(some(batches)):
        short = sets.token >> np.uint64(_BITS - 48)
        high, low = (short >> np.uint64(16)).astype(np.uint32), (short & np.uint64(0xFFFF)).astype(np.uint16)
        vec = [high[a:b].tobytes() + low[a:b].tobytes() for a, b in zip(sets.cut[:-1].tolist(), sets.cut[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([block.column("key"), pa.array(vec, pa.binary())], ["key", "vec"])


def vectors_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(unit, vec), the sets of the wanted (unit, key); staged. Texts are not shuffled: a bit map picks them where they lie."""
    slot = F.pmod(F.xxhash64("key"), F.lit(1 << MAP_BITS))
    bits = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    words[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    sent = rows.sparkSession.sparkContext.broadcast(words)
    found = rows.select("key", "_text", slot.alias("slot")).mapInArrow(lambda b: _vectors(b, sent.value), "key long, vec binary")
    found = stage(found.join(sized_broadcast(wanted), "key").select("unit", "vec"), "sets")
    # rows that are wholly repeated have one key
    return stage(found.dropDuplicates(["unit"]), "sets") if found.count() > wanted.count() else found


def _read(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return (np.frombuffer(raw, np.uint32, n).astype(np.uint64) << np.uint64(16)) | np.frombuffer(raw, np.uint16, n, 4 * n)


def links(a: bytes, b: bytes) -> bool:
    x, y = _read(a), _read(b)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [links(x.as_py(), y.as_py()) for x, y in zip(batch.column("va"), batch.column("vb"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs (a, b) of units whose sets reach the threshold."""
    one = pairs.join(vectors.select(F.col("unit").alias("b"), F.col("vec").alias("vb")), "b")
    two = one.join(vectors.select(F.col("unit").alias("a"), F.col("vec").alias("va")), "a")
    return two.select("a", "b", "va", "vb").mapInArrow(_verify, "a long, b long")


class Index:
    """The tokens of a few rows, sorted, to compare another row with all of them at once."""

    def __init__(self, rows: list[np.ndarray]):
        self.size = np.array([len(r) for r in rows])
        name = np.concatenate(rows)
        self.order = np.argsort(name, kind="stable")
        self.row = np.repeat(np.arange(len(rows)), self.size)[self.order]
        self.name, first = np.unique(name[self.order], return_index=True)
        self.first = np.append(first, len(name))

    def hits(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the sorted tokens, place in those asked for) of each match."""
        at = np.minimum(np.searchsorted(self.name, tokens), len(self.name) - 1)
        hit = np.flatnonzero(self.name[at] == tokens)
        first = self.first[at[hit]]
        n = self.first[at[hit] + 1] - first
        return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n), np.repeat(hit, n)


def _values(column: pa.Array) -> list:
    """A column's values; those of a list column as arrays, not number by number."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    at = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[at[0] : at[-1]], at[1:-1] - at[0]) if len(column) else []


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, bool, tuple]]:
    """(key, is it of side 0, the columns' values) of sorted rows."""
    for batch in batches:
        for key, side, *values in zip(*(_values(batch.column(c)) for c in ("key", "side", *columns)), strict=True):
            yield key, side == 0, tuple(values)


def _promise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, side, gid, root) of the rows of a key that share enough with one of its other side and another component to link (see SHARED)."""
    names = ["key", "side", "gid", "root"]
    now, own, index, out = None, [], None, []

    def ended():
        found = [(now, 0, *own[k][:2]) for k in np.flatnonzero(hot)] if index else []
        return found + out

    def batch(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names)

    for key, first, (gid, root, n, tokens, pos) in _groups(batches, ["gid", "root", "n", "tokens", "pos"]):
        if key != now:
            if now is not None:
                yield batch(ended())
            now, own, index, out = key, [], None, []
        if first:
            own.append((gid, root, n, tokens, pos))
            continue
        if not own:
            continue
        if index is None:
            index, hot = Index([r[3] for r in own]), np.zeros(len(own), bool)
            place = np.concatenate([r[4] for r in own])[index.order]
            ids, roots, sizes = (np.array([r[k] for r in own]) for k in (0, 1, 2))
        at, asked = index.hits(tokens)
        row = index.row[at]
        shared = np.bincount(row, minlength=len(own))
        last_a, last_b = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        np.maximum.at(last_a, row, place[at])
        np.maximum.at(last_b, row, pos[asked])
        need = (PERCENT * (sizes + n) + 99 + PERCENT) // (100 + PERCENT)
        most = shared + np.minimum(np.minimum(sizes - last_a, n - last_b) - 1, (PERCENT * np.maximum(sizes, n) + 99) // 100 - 1)
        ok = (shared > 0) & (roots != root) & (100 * np.minimum(sizes, n) >= PERCENT * np.maximum(sizes, n)) & (most >= need) & (ids != gid)
        if ok.any():
            hot |= ok
            out.append((key, 1, gid, root))
    if now is not None:
        yield batch(ended())


class Forest:
    """Components of what one key's rows link: of a family whose rows all link, only the links that join two of its parts are told."""

    def __init__(self):
        self.above = {}

    def root(self, node: int) -> int:
        above = self.above
        while (up := above.get(node, node)) != node:
            above[node] = node = above.get(up, up)
        return node

    def joins(self, a: int, b: int) -> bool:
        """Were a and b in different components? They're in one now."""
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)
        return a != b


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of components, fewer than the rows of a group, from sorted groups of rows: the units of a block (side 0), then those that they meet."""
    now, own, index, forest = None, [], None, Forest()
    for key, first, (root, vec) in _groups(batches, ["root", "vec"]):
        if key != now:
            now, own, index, forest = key, [], None, Forest()
        if first:
            own.append((root, _read(vec)))
            continue
        if not own:
            continue
        index = index or Index([v for _, v in own])
        tokens = _read(vec)
        both = np.bincount(index.row[index.hits(tokens)[0]], minlength=len(own))
        new = [(root, own[k][0]) for k in np.flatnonzero(100 * both >= PERCENT * (index.size + len(tokens) - both)).tolist() if forest.joins(root, own[k][0])]
        if new:
            a, b = zip(*new, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


#: Least intersection of linked sets of na and nb shingles, and sizes that may link.
NEED = f"({PERCENT} * (na + nb) + {99 + PERCENT}) div {100 + PERCENT}"
SIZES = f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"
#: What two sets may share if they share a shingle: no more up to it than either has in lists, and what follows it.
PLACES = f"least(sa, sb) + least(na - pa - 1, nb - pb - 1) >= {NEED}"
#: And if they share so many: nothing more up to the last of them, nor up to the end of the prefix that ends first.
SHARED = f"shared + least(na - last_a - 1, nb - last_b - 1, greatest({PERCENT} * na + 99, {PERCENT} * nb + 99) div 100 - 1) >= {NEED}"


def lists_of(groups: DataFrame) -> DataFrame:
    """(token, gid, n, pos, seq) of the prefix shingles that more than one group has; seq: place among those of its group, from 1. Staged.

    Shingles are counted where they are sorted; heavy ones stay without a count, as their lists are too long to be sorted in one task.
    """
    posted = groups.select("gid", F.posexplode("prefix").alias("pos", "token"))
    light, heavy = posted.where(F.col("token") < int(HEAVY)), posted.where(F.col("token") >= int(HEAVY))
    several = light.withColumn("held", F.count("*").over(W.partitionBy("token"))).where("held > 1").drop("held").unionByName(heavy)
    shared = stage(several, "shared")
    return stage(shared.join(groups.select("gid", "n"), "gid").withColumn("seq", F.row_number().over(W.partitionBy("gid").orderBy("pos"))), "lists")


def _side(name: str, row: str = "") -> list:
    """Columns of a list's row as one side of a pair."""
    return [F.col(f"{row}{c}").alias(n) for c, n in (("gid", name), ("n", f"n{name}"), ("pos", f"p{name}"), ("seq", f"s{name}"))]


def pivoted(lists: DataFrame) -> DataFrame:
    """Pairs (a, b): each group with the PARTNERS that it shares most with among its lists' pivots: the group that has the list's shingle first in its
    prefix, and the first ones by hashes.

    A hash picks the same group in all lists of a family, so what two share is counted nearly in full; what is missed is left to the exact end. In a family whose
    members are about as far apart as the threshold, few link with one that a hash picks, and the exact end would compare nearly all with all. The one that has a
    shared shingle first has the fewest of its own: it is nearest to the others.
    """
    one = lambda k: F.min(F.struct(F.when(F.lit(k == 0), F.col("pos")).alias("own"), F.xxhash64("gid", F.lit(k)).alias("order"), "gid", "n", "pos", "seq"))
    first = lists.groupBy("token").agg(F.array(*[one(k) for k in range(PIVOTS)]).alias("pivots"))
    first = stage(first.select("token", F.explode(F.array_distinct(F.transform("pivots", lambda p: p.dropFields("own", "order")))).alias("pivot")), "pivots")
    met = lists.join(first, "token").select(*_side("a"), *_side("b", "pivot.")).where(f"a != b and {SIZES} and {PLACES}")
    both = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"), F.max("pa").alias("last_a"), F.max("pb").alias("last_b")).where(SHARED)
    top = both.withColumn("place", F.row_number().over(W.partitionBy("a").orderBy(F.desc("shared"), F.desc("b")))).where(f"place <= {PARTNERS}")
    return top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mixed(lists: DataFrame, held: DataFrame) -> DataFrame:
    """Lists of several components, with root; held: (gid, root), a row for each component that a group has units of."""
    at = lists.join(held, "gid")
    several = stage(at.groupBy("token").agg((F.min("root") != F.max("root")).alias("several")).where("several").select("token"), "mixed")
    return at.join(several, "token")


def meetings(left: DataFrame) -> DataFrame:
    """(key, side, gid, root): blocks of at most BLOCK rows (side 0) with slices of the rows that they meet in a list (side 1); staged.

    In each list the groups outside its largest component are few; they meet all of it. Each of the few belongs to one block, that of the longest list
    it is among the few of, so a family is a few blocks, however many lists it shares. In lists of up to SHORT rows, most of which share a shingle by chance, pairs are
    looked at first, and only those whose sizes and places allow the threshold meet.
    """
    held = left.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("length"), F.max_by("root", F.struct("n", "root")).alias("most"))
    few = stage(left.join(stage(held, "lengths"), "token").where("root != most"), "few")
    one = few.where(f"length <= {SHORT}").select("token", "length", "most", F.col("root").alias("ra"), *_side("a"))
    two = left.select("token", F.col("root").alias("rb"), *_side("b"))
    # two of the few meet once
    near = one.join(two, "token").where(f"ra != rb and (rb = most or a < b) and {SIZES} and {PLACES}")
    near = stage(near.select("token", "length", F.col("a").alias("gid"), F.col("ra").alias("root"), "b", "rb"), "near")
    crowds = few.where(f"length > {SHORT}").select("token", "length", "gid", "root")
    home = crowds.unionByName(near.select(crowds.columns)).groupBy("gid", "root").agg(F.max(F.struct("length", "token")).alias("home"))
    size = home.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.xxhash64("home.token", F.pmod(F.xxhash64("gid", "root"), "blocks"))
    homes = stage(home.join(size, "home").select("gid", "root", block.alias("block")), "homes")
    meets = crowds.join(homes, ["gid", "root"]).select("token", "block").distinct()
    met = left.select("token", "gid", "root").join(meets, "token").select("gid", "root", "block")
    met = met.union(near.join(homes, ["gid", "root"]).select(F.col("b").alias("gid"), F.col("rb").alias("root"), "block"))
    met = stage(met.distinct(), "met")
    slices = stage(met.groupBy("block").agg(F.ceil(F.count("*") / SLICE).alias("slices")), "slices")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")
    here = homes.join(slices, "block").select("block", every, F.lit(0).alias("side"), "gid", "root")
    there = met.join(slices, "block").select("block", F.pmod(F.xxhash64("gid"), "slices").alias("slice"), F.lit(1).alias("side"), "gid", "root")
    return stage(here.unionByName(there).select(F.xxhash64("block", "slice").alias("key"), "side", "gid", "root"), "meetings")


def by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "side")


def remaining(left: DataFrame) -> DataFrame:
    """(key, side, gid, root): the meetings that may bring a link, by what the prefixes share; staged."""
    met = meetings(left)
    row = F.array_sort(F.collect_list(F.struct("token", "pos")))  # as many as a prefix has shingles
    prefix = left.join(met.select("gid", "root").distinct(), ["gid", "root"], "left_semi").groupBy("gid", "root", "n").agg(row.alias("row"))
    prefix = prefix.select("gid", "root", "n", F.col("row.token").alias("tokens"), F.col("row.pos").alias("pos"))
    rows = by_key(met.join(prefix, ["gid", "root"]).select("key", "side", "gid", "root", "n", "tokens", "pos"))
    return stage(rows.mapInArrow(_promise, "key long, side int, gid long, root long"), "promising")


def linked(rows: DataFrame, units: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, root) of the units that have a link."""

    def vectors_for(named: DataFrame) -> DataFrame:
        return vectors_of(rows, stage(units.join(named.distinct(), "unit").select("unit", "key"), "wanted"))

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("unit")).union(pairs.select("b"))

    lists = lists_of(groups)
    heads = stage(units.groupBy("gid").agg(F.min("unit").alias("head"), F.count("*").alias("held")), "heads")
    several = heads.where("held > 1").select("gid", "head")
    # one pair for each group, by its first unit, and one for each other unit of a group
    pairs = pivoted(lists)
    for c in ("a", "b"):
        pairs = pairs.join(heads.select(F.col("gid").alias(c), F.col("head").alias(f"h{c}")), c)
    inside = units.join(several, "gid").where("unit != head").select(F.col("head").alias("a"), F.col("unit").alias("b"))
    pairs = stage(pairs.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).union(inside), "pairs")
    roots = components(verified(pairs, vectors_for(both(pairs))))
    # then all pairs of different components: block by block, and those within groups
    held = stage(rooted(units.select("gid", "unit"), "unit", roots), "held")
    left = stage(mixed(lists, held.select("gid", "root").distinct()), "left")
    may = stage(remaining(left).join(held, ["gid", "root"]).select("key", "side", "unit", "root"), "may")
    one, other = (held.join(several, "gid").select("gid", F.col("unit").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    own = stage(one.join(other, "gid").where("a < b and ra != rb").select("a", "b"), "own")
    vectors = vectors_for(may.select("unit").union(both(own)))
    found = by_key(may.join(vectors, "unit").select("key", "side", "root", "vec")).mapInArrow(_meet, "a long, b long")
    new = verified(own, vectors)
    for c in ("a", "b"):
        new = rooted(new, c, roots).drop(c).withColumnRenamed("root", c)
    return raised(roots, found.union(new).where("a != b"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"), F.xxhash64(docs[id_col], docs[text_col]).alias("key"))
    levels = spark.sparkContext.broadcast(bucket_levels(rows))
    signed = stage(signatures(rows, levels), "signatures")
    some = signed.where("fp is not null")
    groups = some.select("group_fp", "n", "prefix").groupBy("group_fp", "n", "prefix").agg(F.lit(1)).select("group_fp", "n", "prefix")
    groups = stage(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")
    units = some.groupBy("fp", "group_fp").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"))
    units = stage(units.join(groups.select("group_fp", "gid"), "group_fp").withColumn("unit", F.monotonically_increasing_id()), "units")
    roots = linked(rows, units, groups)
    named = stage(rooted(units.select("fp", "rep", "unit"), "unit", roots), "named")
    least = stage(named.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    by_fp = stage(named.join(least, "root").select("fp", "component_id"), "components")
    out = signed.select("doc_id", "n", "fp").join(by_fp, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) >= {SHINGLE} THEN list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT r, len(s) AS n, unnest(s) AS f FROM s),
l AS (SELECT a.r AS x, b.r AS y FROM e a JOIN e b ON a.f = b.f AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT r AS x, r AS y FROM s UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y),
c AS (SELECT reach.x AS r, min(doc_id) AS component_id FROM reach JOIN s ON s.r = reach.y GROUP BY reach.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN c USING (r)
"""
