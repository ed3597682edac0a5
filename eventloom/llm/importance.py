"""Target-distribution importance resampling with an exact draw.

1. All features (runs of one to three words) of documents and of benchmark texts are counted in BUCKETS hash buckets: one map over the texts with
   partial counts, one row for each bucket on the driver, whatever the input.
2. The gains of the buckets, an array of fixed size, are broadcast; a second map sums them over each document's features. Ids, weights and
   scores are staged without the texts.
3. Distributed radix selection finds the exact k-th key: a key is the hexadecimal form of (score descending, doc_id, n_features), its
   digits are counted from the left (at most 65,537 counts a pass), and each pass keeps the rows that share the prefix of the k-th.
4. Only the rows up to the k-th key are range-sorted and ranked, by a prefix sum over the ranges. Nothing is joined.

The crc32 of a run comes from those of its words: a checksum is linear, so that of "a b" is the shifted one of "a" with that of " b".

Defined cases: a null or empty text has no features, weight 0, and is never drawn; a null doc_id draws its noise as an empty id and
comes last among ties; ids may be whole numbers or strings (by their bytes); rows of one doc_id tie by n_features and are alike beyond, so
which of them is drawn doesn't show; without benchmark texts T is 0; fewer than 20 eligible documents draw none; empty tables give an empty table; other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Runs, blocks, partitions, range_parts, small_batches, stage, utf8

BUCKETS, LONGEST = 10_000, 3
MIN_WORDS, PERCENT, SEED = 20, 5, "42"
#: Hexadecimal digits of a key that a pass counts.
DIGITS = 4
_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(_POLYNOMIAL), crc >> 1)
    return crc


class Crc:
    """crc32 of many byte runs at once. A raw checksum starts at 0 and isn't inverted, so it is linear in the bytes.

    Lengths under `near` have four tables of 256 entries each; longer ones go by the bits of their length, with a table for each 2 ** k.
    """

    def __init__(self, near: int = 64):
        one, byte = _crc_table(), np.arange(256, dtype=np.uint32)
        step = np.stack([self._step(one, byte << np.uint32(8 * j)) for j in range(4)])
        # at[d][b]: byte b with d bytes after it; by_length[d][j][b]: byte j of a checksum is b, d zero bytes follow
        at, by_length = [one], [np.stack([byte << np.uint32(8 * j) for j in range(4)])]
        for _ in range(near - 1):
            at.append(self._step(one, at[-1]))
            by_length.append(self._step(one, by_length[-1]))
        self.near, self.at, self.by_length, self.powers = near, np.stack(at).ravel(), np.stack(by_length).ravel(), [step]
        self.memo: dict[int, np.ndarray] = {}

    @staticmethod
    def _step(one: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return one[crc & np.uint32(0xFF)] ^ (crc >> np.uint32(8))

    @staticmethod
    def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return tables[0][crc & 0xFF] ^ tables[1][(crc >> 8) & 0xFF] ^ tables[2][(crc >> 16) & 0xFF] ^ tables[3][crc >> 24]

    def _near(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        base, out = length * 1024, 0
        for j in range(4):
            out = self.by_length[base + (256 * j + ((crc >> np.uint32(8 * j)) & np.uint32(0xFF)))] ^ out
        return out

    def shift(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Raw checksums with `length` zero bytes after them."""
        if int(length.max(initial=0)) < self.near:
            return self._near(crc, length)
        out, far = crc.copy(), length >= self.near
        out[~far] = self._near(crc[~far], length[~far])
        for k in range(int(length.max()).bit_length()):
            if len(self.powers) <= k:
                self.powers.append(np.stack([self._apply(self.powers[-1], row) for row in self.powers[-1]]))
            some = np.flatnonzero(far & ((length >> k) & 1 == 1))
            out[some] = self._apply(self.powers[k], out[some])
        return out

    def shifted(self, start: int, length: np.ndarray) -> np.ndarray:
        """One raw checksum with each of the lengths; those under 4 * near from a table."""
        table = self.memo.get(start)
        if table is None:
            table = self.memo[start] = self.shift(np.full(4 * self.near, start, np.uint32), np.arange(4 * self.near))
        out = table[np.minimum(length, len(table) - 1)]
        far = np.flatnonzero(length >= len(table))
        if len(far):
            out[far] = self.shift(np.full(len(far), start, np.uint32), length[far])
        return out

    def raw(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Raw checksums of runs that aren't empty: pieces of near bytes by table, joined by shifts."""
        size = end - start
        pieces = -(-size // self.near)
        first = np.cumsum(pieces) - pieces
        number = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
        begin = np.repeat(start, pieces) + number * self.near
        stop = np.minimum(begin + self.near, np.repeat(end, pieces))
        n = stop - begin
        total = np.cumsum(n)
        place = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - n, n)
        value = self.at[(np.repeat(total, n) - 1 - np.arange(len(place))) * 256 + data[np.repeat(begin, n) + place]]
        part = np.bitwise_xor.reduceat(value, total - n) if len(n) else np.zeros(0, np.uint32)
        if len(part) == len(start):
            return part
        return np.bitwise_xor.reduceat(self.shift(part, np.repeat(end, pieces) - stop), first)


_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_SEP = np.ones(256, bool)
_SEP[48:58] = _SEP[97:123] = _SEP[128:] = False


def feature_buckets(data: np.ndarray, at: np.ndarray, crc: Crc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of a block's rows, and the words of each row."""
    data = _UPPER[data]
    words = Runs(data, at, _SEP)
    size = words.end - words.start
    raw = crc.raw(data, words.start, words.end)
    blank = crc.shifted(int(crc.at[0x20]), size) ^ raw  # of " word"
    rows, found = [], []
    run, length = raw, size
    for n in range(LONGEST):
        if n:
            inside = words.row[n:] == words.row[:-n]
            run, length = crc.shift(run[:-1], size[n:] + 1) ^ blank[n:], length[:-1] + size[n:] + 1
        else:
            inside = np.ones(len(raw), bool)
        whole = ~(run ^ crc.shifted(0xFFFFFFFF, length))
        rows.append(words.row[n:][inside])
        found.append((whole[inside] % BUCKETS).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found), np.diff(words.first)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, crc = np.zeros(BUCKETS, np.int64), Crc()
    for block in blocks(batches, "_text"):
        count += np.bincount(feature_buckets(*utf8(block.column("_text")), crc)[1], minlength=BUCKETS)
    used = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("text").alias("_text")).mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket. BUCKETS numbers, whatever the input."""
    s, t = bucket_counts(docs).withColumnRenamed("n", "s"), bucket_counts(target).withColumnRenamed("n", "t")
    both = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    every = W.partitionBy()
    own, other = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((other + 1) * (F.sum("s").over(every) + F.lit(float(BUCKETS)))) / ((own + 1) * (F.sum("t").over(every) + F.lit(float(BUCKETS))))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").toArrow().column("gain").to_numpy()


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    crc = Crc()
    for block in blocks(batches, "_text"):
        row, bucket, words = feature_buckets(*utf8(block.column("_text")), crc)
        n = np.bincount(row, minlength=block.num_rows)
        weight = np.bincount(row, gain[bucket], block.num_rows)  # whole numbers far below 2 ** 53
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n, words, weight))], ["doc_id", "n_features", "n_words", "weight"])


def noise(doc_id):
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, gain) -> DataFrame:
    """doc_id, n_features, n_words, weight, score for each row; gain is a broadcast array."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    found = rows.mapInArrow(lambda b: _weigh(b, gain.value), f"doc_id {kind}, n_features long, n_words long, weight long")
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id")))


def _hex(number):
    """Sixteen digits that sort as the number does."""
    return F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")


def sort_key(rows: DataFrame):
    """A string of hexadecimal digits that sorts by score descending, doc_id ascending, null last, then n_features."""
    known = F.col("doc_id").cast("long") if isinstance(rows.schema["doc_id"].dataType, IntegralType) else None
    own = _hex(known) if known is not None else F.concat(F.hex(F.col("doc_id").cast("string").cast("binary")), F.lit("-"))
    return F.concat(_hex(-1 - F.col("score")), F.when(F.col("doc_id").isNull(), F.lit("~")).otherwise(F.concat(F.lit("-"), own)), _hex(F.col("n_features")))


def kth_key(keyed: DataFrame, k: int) -> tuple[str, int]:
    """The k-th smallest of the column key, k from 1, and how many rows that equal it are among the first k.

    A pass counts the next digits of the keys with the prefix found so far: at most 16 ** DIGITS counts and a few more, on the driver.
    """
    prefix, left = "", k
    while True:
        at = len(prefix)
        digit = F.substring("key", at + 1, DIGITS).alias("digit")
        counts = keyed.where(F.col("key").startswith(prefix)).groupBy(digit).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("digit").collect()
        for row in counts:
            if left <= row.n:
                break
            left -= row.n
        if row.low == row.high:
            return row.low, left
        # the digits that all the keys that are left share need no pass of their own
        same = next(i for i, (a, b) in enumerate(zip(row.low, row.high, strict=False)) if a != b)
        prefix = row.low[:same]


def ranked(chosen: DataFrame) -> DataFrame:
    """chosen with rank in the order of key; rows of one key are dealt over ranges by their row number."""
    dealt = range_parts(chosen, ["key", "row"], "chosen")
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("_part").agg(F.count("*").alias("n")).select(F.col("_part").alias("_p"), before.alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy("key", "row"))
    return dealt.withColumn("_own", own).join(parts, F.col("_part") == F.col("_p")).withColumn("rank", F.col("_before") + F.col("_own"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs; rank is null for rows that aren't drawn."""
    spark = docs.sparkSession
    small_batches(spark)
    gain = spark.sparkContext.broadcast(gains(docs, target))
    rows = stage(scores(docs, gain).withColumn("row", F.monotonically_increasing_id()), "scores")
    keyed = rows.withColumn("key", sort_key(rows))
    able = keyed.where(F.col("n_words") >= min_words)
    k = able.count() * percent // 100
    out = ("doc_id", "n_features", "weight", "score")
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    last, _ = kth_key(able, k)
    inside = (F.col("n_words") >= min_words) & (F.col("key") <= last)
    drawn = ranked(keyed.where(inside)).select(*out, F.when(F.col("rank") <= k, F.col("rank")).cast("long").alias("rank"))
    return keyed.where(~inside).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(drawn)


ORACLE = f"""
WITH crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor({_POLYNOMIAL}, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
texts AS (
  SELECT 's' AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
runs AS (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
         list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM texts),
names AS (SELECT DISTINCT f FROM runs),
hashed AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(f)) + 1),
         lambda k: ('0x' || hex(f)[2 * k - 1:2 * k])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS b FROM names, crc_table),
placed AS (SELECT side, r, b FROM runs JOIN hashed USING (f)),
counts AS (SELECT i AS b, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM range({BUCKETS}) x(i) LEFT JOIN (
  SELECT b, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM placed GROUP BY b) y ON y.b = x.i),
gain AS (SELECT b, floor(1000 * ln(((t + 1) * (sum(s) OVER () + {BUCKETS})) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS g FROM counts),
weights AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS weight FROM placed JOIN gain USING (b) WHERE side = 's' GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (r) WHERE side = 's'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS o, count(*) FILTER (n_words >= {MIN_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {MIN_WORDS} AND o <= {PERCENT} * n // 100 THEN o END::BIGINT AS rank FROM ordered
"""
