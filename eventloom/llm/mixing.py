"""Mix sources to target weights, cut at the exact budget.

Each row gets a hash-random key of its doc_id and text; sizes and keys are staged without the texts, dealt by range of (source, key)
and sorted, prefix sums of their sizes run within a part and are carried over parts by one small sum for each source and part. A source whose target exceeds its
size repeats whole epochs; the rest of the budget is cut in the order of the keys, the last document in part.

Defined cases: a null source is a source of its own, ordered last; null or empty texts have size 0 and take 0; repeated
rows are taken on their own (only rows of equal doc_id and text tie, and either order of those gives the same rows); a null doc_id
takes its key from the text; a source without words has target 0; an empty table gives an empty table.
Sources are few (one row each is ordered on one task); rows of a source may be a third of all, as ranges split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import range_parts, stage

#: Weights of the sources by code point, repeating; share of all sizes to take; epochs of a source at most.
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: weighted shares, none above `most` times its size.

    The excess is shared anew until none is above. In the order of most * size / weight the capped sources come first,
    so one pass of running sums finds the level that the others get for each unit of weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("w", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("most", F.col("source_size").cast("double") * most)
    full = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    all_rows = full.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = by.withColumns({
        "budget": F.sum(F.col("source_size").cast("double")).over(all_rows) * share,
        "before": F.coalesce(F.sum("most").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "w_left": F.sum("w").over(full.rowsBetween(0, W.unboundedFollowing)),
    }).withColumn("level", (F.col("budget") - F.col("before")) / F.col("w_left"))
    # the first source that its level doesn't fill gives the level of all after it
    by = by.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("before", "level"))).over(all_rows)["level"])
    return by.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) for each row; keep: columns of docs to add."""
    extra = [docs[c].alias(f"_keep_{i}") for i, c in enumerate(keep or [])]
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(SEED), F.md5(F.coalesce("text", F.lit("")))))
    rows = stage(docs.select("doc_id", "source", word_count("text").alias("size"), key.alias("_key"), *extra), "sizes")
    order = [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id"), F.col("size")]
    dealt = range_parts(rows, order, "mix")
    by = targets(dealt).withColumnRenamed("source", "_source")
    parts = dealt.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before)
    parts = parts.join(by, parts["source"].eqNullSafe(by["_source"])).select(
        F.col("source").alias("_source"), F.col("_part").alias("_p"), "_before", "source_size", "target"
    )
    inner = W.partitionBy("source", "_part").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    dealt = dealt.withColumn("_own", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = dealt.join(parts, (dealt["_part"] == parts["_p"]) & dealt["source"].eqNullSafe(parts["_source"]))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before") - F.col("_own")))
    return joined.select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"),
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep or [])],
    )


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', doc_id::VARCHAR, '{SEED}', md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             source_size::DOUBLE * 2 AS most FROM s),
r AS (SELECT *, sum(source_size::DOUBLE) OVER () * 1.5 AS budget,
             coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
l AS (SELECT *, (budget - before) / w_left AS lvl FROM r),
t AS (SELECT source, source_size, least(most, coalesce((SELECT arg_min(lvl, before) FROM l WHERE lvl * w <= most) * w, most)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM p
"""
