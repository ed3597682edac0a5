"""Source divergence audit: how far the sources of a language differ in their words.

Plain relational: matches of TERM are exploded and counted by (lang, source, term); a language keeps the terms of MIN_DOCS of its
documents or more; the language's groups are crossed with its kept terms, so that absent terms count zero; a self-join on (lang, term)
gives the distance of each pair of sources, a window ranks. A term's share is 1 + floor(10**9 * (count + 5) / (N + 5 * V)), in whole numbers.

Each text gives its distinct terms and then all its terms to one aggregation, so documents and occurrences are counted in one shuffle, after
map-side sums. Kept terms meet the groups by (lang, slice of the terms), so a language with most of the rows is dealt over many tasks; terms
are cut to the first TOP before they are shuffled for their ranks. The result holds every pair of sources of a language: its size is
the square of the sources, which are assumed few (thousands), whatever the documents.

Defined cases: null text, lang or source count as empty strings; a group whose documents have no terms has a count of zero for every kept term;
a language without kept terms has pairs of value 0 and no terms; repeated rows count each; ties rank by the item's bytes; a language
with one source has no pairs; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, stage

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP, SMOOTH, UNIT = 30, 50, 5, 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text):
    """text with A-Z in lower case and all else as it is; lower() is faster where there is nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term."""
    found = rows.select("lang", "source", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)).alias("every"))
    found = found.select("lang", "source", "every", F.array_distinct("every").alias("own"))
    each = found.select("lang", "source", F.size("own").alias("n_own"), F.posexplode(F.concat("own", "every")).alias("at", "term"))
    first = (F.col("at") < F.col("n_own")).cast("long")
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - first).alias("n"), F.sum(first).alias("docs"))


def share(count: str, total: str, terms: str):
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)); in decimals where a long may not hold it."""
    over = f"({total} + {SMOOTH} * {terms})"
    exact = F.expr(f"cast({UNIT} as decimal(10, 0)) * cast({count} + {SMOOTH} as decimal(20, 0)) div cast({over} as decimal(20, 0))")
    return 1 + F.when(F.col(count) < 9_000_000_000, F.expr(f"({UNIT}L * ({count} + {SMOOTH})) div {over}")).otherwise(exact)


def dense_shares(rows: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """((lang, source) of all groups, (lang, term, source, n, p, q) for each group and kept term); q is the language's share."""
    docs = F.sum("docs").over(W.partitionBy("lang", "term"))
    kept = stage(term_counts(rows).withColumn("_docs", docs).where(F.col("_docs") >= min_docs).select("lang", "term", "source", "n"), "terms")
    groups = stage(rows.select("lang", "source").distinct(), "groups")
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "lang_total", "v")
    n = partitions(rows.sparkSession)
    slices = named.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    crossed = terms.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")).join(slices, ["lang", "slice"])
    full = crossed.join(kept, ["lang", "term", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = full.select("lang", "term", "source", "n", share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("q"))
    return groups, stage(full, "shares")


def pair_rows(groups: DataFrame, dense: DataFrame) -> DataFrame:
    """(lang, source, item, value): summed distance of each two sources of a language."""
    a = dense.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"))
    b = dense.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"))
    both = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(F.abs(F.col("pa") - F.col("pb"))).alias("value"))
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    values = both.select("lang", "value", F.explode(sides).alias("at")).select("lang", "at.*", "value")
    every = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source != item")
    return every.join(values, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the distances of sources (part pair) and the terms that a source has too often (part term)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups, dense = dense_shares(rows, min_docs)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_rows(groups, dense).withColumn("rank", F.row_number().over(order))
    terms = dense.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    parts = [p.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for p, name in ((pairs, "pair"), (terms, "term"))]
    return parts[0].unionByName(parts[1])


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
kc AS (SELECT c.* FROM c JOIN k USING (lang, term)),
lt AS (SELECT k.lang, k.term, sum(n)::HUGEINT AS n FROM k JOIN kc USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM lt GROUP BY lang),
gt AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN kc USING (lang, source) GROUP BY ALL),
p AS (SELECT gt.lang, gt.source, lt.term, coalesce(kc.n, 0)::HUGEINT AS n,
             1 + {UNIT}::HUGEINT * (coalesce(kc.n, 0) + {SMOOTH}) // (gt.total + {SMOOTH} * l.v) AS p, 1 + {UNIT}::HUGEINT * (lt.n + {SMOOTH}) // (l.total + {SMOOTH} * l.v) AS q
      FROM gt JOIN l USING (lang) JOIN lt USING (lang) LEFT JOIN kc ON kc.lang = gt.lang AND kc.source = gt.source AND kc.term = lt.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "C") AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM o WHERE part = 'pair' OR rank <= {TOP}
"""
