"""Queries over documents, conversations, events and labels, each with SQL that gives the same rows where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as O
from ..operators import sampling as S
from ..sources.views import SIGNALS, signals, table
from .market import R
from .registry import query

GOOD, BAD = ["the", "with", "and", "then", "that"], ["of", "are", "in", "the"]


def _feature_sql() -> str:
    special = {
        11: f"regexp_matches(t, '{T.FORWARD}') AND regexp_matches(t, '{T.MODAL}')", 14: "len(regexp_extract_all(t, '\\d'))::DOUBLE / greatest(length(t), 1)", 21: "length(t)",
        22: "len(regexp_extract_all(t, '[^\\t\\n\\x0B\\f\\r ]+')) BETWEEN 1 AND 5", 24: "len(regexp_extract_all(t, '!'))", 25: "len(regexp_extract_all(t, '[,;]'))::DOUBLE / greatest(length(t), 1)",
        26: "length(array_to_string(regexp_extract_all(t, '\\p{Lu}{2,}'), ''))::DOUBLE / greatest(length(t), 1)",
    }
    columns = [f"round(CAST({special.get(k) or f"regexp_matches(t, '{T.FLAGS[k]}')"} AS DOUBLE), {R}) AS h{k:02}" for k in range(1, 31)]
    return f"SELECT doc_id, {', '.join(columns)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


@query(_feature_sql())
def f09_f10_text_features(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", F.lower("text").alias("low"))
    f = d.select("doc_id", *T.features(F.col("text"), F.col("low")))
    # rounded on the product, as the SQL does: half a digit counts as it lies in binary, not as it is written
    return f.select("doc_id", *[(F.round(F.col(c) * 10.0**R) / 10.0**R).alias(c) for c in f.columns[1:]])


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('{"','".join(GOOD)}'))) AS p,
len(list_filter(w, lambda x: x IN ('{"','".join(BAD)}') AND x NOT IN ('{"','".join(GOOD)}'))) AS n FROM w) SELECT doc_id, round(CASE WHEN p + n > 0 THEN (p - n)::DOUBLE / (p + n) END, {R}) AS score FROM c""")
def f05_s13_lexicon_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(T.lexicon_score(F.col("text"), GOOD, BAD), R).alias("score"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS key FROM documents")
def f04_f11_phrase_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.phrase_key(F.col("text"))).alias("key"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'), '([.!?]) ([A-Z0-9"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 40) AS s FROM documents)
SELECT doc_id || '#' || lpad((i - 1)::VARCHAR, 7, '0') AS sentence_id, md5(s[i]) AS digest FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""")
def f06_f08_w21_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return O.sentence_rows(table(spark, sf, "documents"), 40).select("sentence_id", F.md5("text").alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), f AS (SELECT doc_id, line, min(i) AS i FROM l GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, md5(line) AS line FROM f""")
def w19_first_lines(spark: SparkSession, sf: str) -> DataFrame:
    return O.first_lines(table(spark, sf, "documents")).withColumn("line", F.md5("line"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, len(list_filter(range(1, len(l) + 1), lambda i: i = 1 OR l[i] != l[i - 1])) AS kept, CAST(len(l) AS INT) AS lines FROM l""")
def w18_adjacent_copies(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select("doc_id", F.size(O.without_adjacent_copies(lines)).cast("long").alias("kept"), F.size(lines).alias("lines"))


@query("""SELECT doc_id, len(list_filter(string_split_regex(text, '\\n[\\t ]*\\n|\\n(?:[A-Z][A-Z ]+:)'), lambda p: trim(p) != '')) AS paragraphs FROM documents""")
def f07_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """A blank line or a structural header ends a paragraph."""
    parts = F.split("text", r"\n[\t ]*\n|\n(?:[A-Z][A-Z ]+:)")
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(parts, lambda p: F.trim(p) != "")).cast("long").alias("paragraphs"))


@query("""WITH a AS (SELECT conv_id, turn, role, max(CASE WHEN role = 'system' THEN turn END) OVER w AS cut, max(CASE WHEN role = 'user' THEN turn END) OVER w AS q FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT conv_id, turn, CASE WHEN q > coalesce(cut, -1) THEN q END AS question_turn, NOT coalesce(q > coalesce(cut, -1), FALSE) AS orphan FROM a WHERE role = 'assistant'""")
def w20_f01_question_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return O.question_pairs(table(spark, sf, "conversations"), "user", "assistant", "system")


@query(f"""WITH {SIGNALS}, o AS (SELECT sector, ticker, signal_type, min(signal_id) AS first FROM signals GROUP BY 1, 2, 3), c AS (SELECT sector, signal_type, count(*) AS n, min(first) AS first FROM o GROUP BY 1, 2)
SELECT sector, CAST(row_number() OVER (PARTITION BY sector ORDER BY n DESC, first) AS INT) AS rank, signal_type, n FROM c QUALIFY rank <= 3""")
def g03_top_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return O.top_phrases(signals(spark, sf), "sector", "ticker", "signal_type", "signal_id", 3)


REPLY = "CASE event_id % 5 WHEN 0 THEN '{\"label\": \"click\"}' WHEN 1 THEN 'Sure: {\"label\": \" View \"} ok' WHEN 2 THEN 'none' WHEN 3 THEN '{\"label\": \"other\"}' END"


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' END AS label, CASE event_id % 5 WHEN 2 THEN 'no_json' WHEN 3 THEN 'bad_label' WHEN 4 THEN 'empty' END AS error,
length(json_extract_string(props, '$.' || json_keys(props)[1])) AS n FROM events""")
def m03_json_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("raw", F.expr(REPLY))
    label, error = T.json_label(F.col("raw"), ["click", "view"])
    first = F.get(F.map_values(F.from_json("props", "map<string,string>")), F.lit(0))
    return e.select("event_id", label.alias("label"), error.alias("error"), F.length(first).cast("long").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 1.0::DOUBLE WHEN o_orderpriority LIKE '2%' THEN 0.5 WHEN o_orderpriority LIKE '5%' THEN -1.0 ELSE 0.0 END AS ordinal, CAST(sign(o_totalprice - 150000) AS INT) AS side,
round(1 / (1 + exp(-(o_totalprice - 150000) / 50000)), 8) AS p FROM orders""")
def m01_m02_ordinal_and_logistic(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("o_totalprice") - 150000
    kind = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(kind == "1", 1.0).when(kind == "2", 0.5).when(kind == "5", -1.0).otherwise(0.0).alias("ordinal"), F.signum(x).cast("int").alias("side"), F.round(1 / (1 + F.exp(-x / 50000)), R).alias("p")
    )


@query("""SELECT p_partkey, CASE WHEN p_type IS NULL THEN 'Unknown' WHEN regexp_matches(p_type, '(?i)brushed|polished') THEN 'Finish' WHEN regexp_matches(p_type, '(?i)steel$') THEN 'Steel' ELSE 'Other' END AS class FROM part""")
def f03_ordered_classes(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("Finish", "(?i)brushed|polished"), ("Steel", "(?i)steel$")]
    return table(spark, sf, "part").select("p_partkey", T.ordered_class(F.col("p_type"), rules, "Other").alias("class"))


SAMPLE = """WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), q AS (SELECT source, size * 50.0 / sum(size) OVER () AS x FROM s), f AS (SELECT source, CAST(floor(x) AS BIGINT) AS w, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source) AS r, 50 - sum(CAST(floor(x) AS BIGINT)) OVER () AS l FROM q),
n AS (SELECT source, w + CASE WHEN r <= l THEN 1 ELSE 0 END AS quota FROM f)"""


@query(SAMPLE + " SELECT doc_id, source FROM (SELECT doc_id, source, quota, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id) AS k FROM documents JOIN n USING (source)) WHERE k <= quota")
def t06_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.stratified_sample(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 50, 7)


@query("""WITH g AS (SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || ':3'), doc_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY quality) AS pos FROM labels)
SELECT doc_id, quality, CASE WHEN pos < 0.6 THEN 'train' WHEN pos < 0.8 THEN 'val' ELSE 'test' END AS split FROM g""")
def t07_p10_three_way_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.three_way_split(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 3)


@query(f"""WITH {SIGNALS}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM signals)) SELECT date FROM d WHERE i % greatest(1, n // 12) = 0 AND i // greatest(1, n // 12) < 12""")
def t04_evenly_spaced(spark: SparkSession, sf: str) -> DataFrame:
    return S.evenly_spaced(signals(spark, sf), "date", 12)


@query(f"""WITH {SIGNALS}, t AS (SELECT ticker FROM signals GROUP BY 1 ORDER BY count(*) DESC, ticker LIMIT 5), m AS (SELECT max(date) AS last FROM signals) SELECT signal_id FROM signals, m WHERE ticker IN (SELECT ticker FROM t) AND date > last - INTERVAL 12 MONTH""")
def t05_t03_j15_frequent_and_recent(spark: SparkSession, sf: str) -> DataFrame:
    s = signals(spark, sf)
    top = s.groupBy("ticker").count().orderBy(F.desc("count"), "ticker").limit(5)
    last = s.agg(F.add_months(F.max("date"), -12).alias("after"))
    return s.join(F.broadcast(top), "ticker", "left_semi").join(F.broadcast(last), F.col("date") > F.col("after")).select("signal_id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderdate >= DATE '1996-06-01' THEN 'new' ELSE 'old' END AS state FROM orders WHERE o_orderstatus != 'P' OR o_orderdate >= DATE '1996-06-01'""")
def k02_u01_j14_upsert(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    old = o.where("o_orderstatus != 'P'").select("id", F.lit("old").alias("state"))
    new = o.where("o_orderdate >= date'1996-06-01'").select("id", F.lit("new").alias("state"))
    return S.upsert(old, new, ["id"])


@query("""SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def u02_u03_set_algebra(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    one, two = (c.where(x).select(F.col("c_custkey").alias("k")) for x in ("c_mktsegment = 'BUILDING'", "c_acctbal > 5000"))
    drop = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return one.union(two).distinct().exceptAll(drop.distinct())


@query("""SELECT l_orderkey, l_linenumber, CAST(coalesce(try_cast(CASE WHEN l_linenumber % 3 = 0 THEN 'x' ELSE l_linenumber::VARCHAR END AS INT), 0) AS INT) AS code, round(l_quantity + l_discount - l_tax, 8) AS total,
round(3 * l_quantity + 2 * l_discount + l_tax, 8) AS weighted, CAST(l_returnflag = 'A' AS INT) AS is_a, CAST(l_returnflag = 'N' AS INT) AS is_n, CAST(l_returnflag = 'R' AS INT) AS is_r FROM lineitem""")
def p01_p05_row_features(spark: SparkSession, sf: str) -> DataFrame:
    """Coercion, sums over columns, magnitude weights and one-hot codes in one projection."""
    text = F.when(F.col("l_linenumber") % 3 == 0, F.lit("x")).otherwise(F.col("l_linenumber").cast("string"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.coalesce(text.try_cast("int"), F.lit(0)).alias("code"), F.round(z("l_quantity") + z("l_discount") - z("l_tax"), R).alias("total"),
        F.round(3 * z("l_quantity") + 2 * z("l_discount") + z("l_tax"), R).alias("weighted"), *[(F.col("l_returnflag") == f).cast("int").alias(f"is_{f.lower()}") for f in "ANR"],
    )


@query(f"""WITH {SIGNALS} SELECT signal_id, CASE WHEN score > 250000 AND signal_type IN ('1-URGENT', '2-HIGH') THEN 1 WHEN score < 50000 AND signal_type = '5-LOW' THEN -1 ELSE 0 END AS side FROM signals WHERE date <= DATE '2000-06-30' AND score IS NOT NULL""")
def p08_p11_p16_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Eligible rows with a long, short or flat side by an event gate and a score gate."""
    s = signals(spark, sf).where("date <= '2000-06-30' and score is not null")
    kind, score = F.col("signal_type"), F.col("score")
    side = F.when((score > 250000) & kind.isin("1-URGENT", "2-HIGH"), 1).when((score < 50000) & (kind == "5-LOW"), -1).otherwise(0)
    return s.select("signal_id", side.alias("side"))


@query(f"""WITH {SIGNALS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date, signal_id) AS k FROM signals) SELECT signal_id, k <= 5 AS train FROM k""")
def w05_t01_first_k(spark: SparkSession, sf: str) -> DataFrame:
    k = F.row_number().over(W.partitionBy("ticker").orderBy("date", "signal_id"))
    return signals(spark, sf).select("signal_id", (k <= 5).alias("train"))


@query(f"""WITH {SIGNALS}, s AS (SELECT ticker, last_day(date) AS month, list_sort(list(DISTINCT signal_type)) AS s FROM signals GROUP BY 1, 2), l AS (SELECT *, lag(s) OVER (PARTITION BY ticker ORDER BY month) AS p FROM s)
SELECT ticker, month, round(CASE WHEN p IS NOT NULL THEN len(list_intersect(s, p))::DOUBLE / len(list_distinct(list_concat(s, p))) END, {R}) AS overlap FROM l""")
def w04_set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    s = signals(spark, sf).groupBy("ticker", F.last_day("date").alias("month")).agg(F.collect_set("signal_type").alias("s"))
    p = F.lag("s").over(W.partitionBy("ticker").orderBy("month"))
    s = s.withColumn("p", p)
    return s.select("ticker", "month", F.round(F.size(F.array_intersect("s", "p")) / F.size(F.array_union("s", "p")), R).alias("overlap"))
