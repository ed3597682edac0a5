"""The trained sentence splitter as queries, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sentences as S
from ..sources.files import staged
from ..sources.views import table
from .registry import query

LEAST = 40


def _log(n: str, p: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {n} * ln({p}) ELSE 0 END"


def _ratio(a: str, b: str, ab: str, n: str) -> str:
    rest, p = f"({n} - {a} - {b} + {ab})", f"({b} / {n})"
    p1, p2 = f"({ab} / {a})", f"(({b} - {ab}) / ({n} - {a}))"
    apart = " + ".join((_log(ab, p1), _log(f"({a} - {ab})", f"1 - {p1}"), _log(f"({b} - {ab})", p2), _log(rest, f"1 - {p2}"))).replace("CASE", "(CASE").replace("END", "END)")
    same = " + ".join((_log(b, p), _log(f"({a} - {ab} + {rest})", f"1 - {p}"))).replace("CASE", "(CASE").replace("END", "END)")
    return f"2 * (({apart}) - ({same}))"


INITIAL, NUMBER, LETTER = (lambda w: f"regexp_matches({w}, '^\\p{{L}}$')"), (lambda w: f"regexp_matches({w}, '^[0-9][0-9.,]*$')"), (lambda w: f"regexp_matches({w}, '\\p{{L}}')")
SHARE, SIZE = "(SELECT sum(n_period)::DOUBLE / sum(n_plain + n_period) FROM types)", "(length(w) - dots)"
MODEL = f"""s AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x != '') AS ts FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, i - 1 AS pos, ts[i] AS tok FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM s)),
b AS (SELECT *, regexp_replace(regexp_replace(tok, '^["''(\\[]+', ''), '["'')\\],;:]+$', '') AS bare FROM e),
t AS (SELECT doc_id, pos, tok, CASE WHEN regexp_matches(bare, '[!?]$') THEN 'mark' WHEN regexp_matches(bare, '\\.\\.$|…$') THEN 'dots' WHEN ends_with(bare, '.') THEN 'period' ELSE 'none' END AS kind,
  lower(regexp_replace(bare, '[.!?…]+$', '')) AS w, NOT regexp_matches(tok, '[,;:]["'')\\]]*$') AS closed, bare[1] != lower(bare[1]) AS upper, bare[1] != upper(bare[1]) AS low, bare != '' AS real FROM b),
p AS (SELECT *, lead(w) OVER d AS nxt, lead(upper) OVER d AS nxt_upper, lead(low) OVER d AS nxt_lower, lead(real) OVER d AS nxt_real FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
types AS (SELECT w, (count(*) FILTER (kind != 'period'))::DOUBLE AS n_plain, (count(*) FILTER (kind = 'period'))::DOUBLE AS n_period, count(*) FILTER (low) AS n_lower FROM t WHERE real GROUP BY w),
tot AS (SELECT sum(n_plain + n_period) AS n FROM types),
a0 AS (SELECT w, n_plain AS rest, n_period AS ab, length(w) - length(replace(w, '.', '')) AS dots FROM types WHERE n_period > 0 AND {LETTER("w")} AND NOT {INITIAL("w")}),
short AS (SELECT * FROM (SELECT w, 2 * (({_log("ab", f"{S.CLOSE}::DOUBLE")}) + ({_log("rest", f"1 - {S.CLOSE}::DOUBLE")}) - ({_log("ab", SHARE)}) - ({_log("rest", f"1 - {SHARE}")})) * exp(-{SIZE}) * (dots + 1) * pow({SIZE}::DOUBLE, -rest) AS score FROM a0)
  WHERE score >= {S.ABBREVIATION}),
known AS (SELECT p.*, short.w IS NOT NULL AS short, p.closed AND (kind = 'mark' OR (kind = 'period' AND short.w IS NULL AND NOT {INITIAL("p.w")} AND NOT {NUMBER("p.w")})) AS ends FROM p LEFT JOIN short ON short.w = p.w AND p.kind = 'period'),
fol AS (SELECT * FROM known WHERE real AND nxt_real),
brk AS (SELECT count(*)::DOUBLE AS a FROM fol WHERE ends),
st0 AS (SELECT nxt, count(*)::DOUBLE AS ab FROM fol WHERE ends AND {LETTER("nxt")} GROUP BY nxt),
st1 AS (SELECT nxt, a, n_plain + n_period AS b, ab, n FROM st0 JOIN types ON types.w = nxt, brk, tot WHERE n * ab > a * (n_plain + n_period) AND a < n),
starters AS (SELECT * FROM (SELECT nxt, {_ratio("a", "b", "ab", "n")} AS score FROM st1) WHERE score >= {S.STARTER}),
pr0 AS (SELECT w, nxt, count(*)::DOUBLE AS ab FROM fol WHERE kind = 'period' AND ({INITIAL("w")} OR {NUMBER("w")}) AND {LETTER("nxt")} GROUP BY 1, 2 HAVING count(*) > 1),
pr1 AS (SELECT pr0.w, nxt, x.n_plain + x.n_period AS a, y.n_plain + y.n_period AS b, ab, n FROM pr0 JOIN types x ON x.w = pr0.w JOIN types y ON y.w = nxt, tot),
pairs AS (SELECT * FROM (SELECT w, nxt, {_ratio("a", "b", "ab", "n")} AS score FROM pr1 WHERE n * ab > a * b AND a < n) WHERE score >= {S.PAIR}),
mid AS (SELECT nxt, count(*) AS n_mid FROM fol WHERE kind = 'none' AND nxt_upper GROUP BY nxt)"""


@query(f"WITH {MODEL} SELECT 'abbreviation' AS kind, w, NULL::VARCHAR AS next, round(score, 4) AS score FROM short UNION ALL SELECT 'starter', NULL, nxt, round(score, 4) FROM starters UNION ALL SELECT 'pair', w, nxt, round(score, 4) FROM pairs")
def f08_sentence_model(spark: SparkSession, sf: str) -> DataFrame:
    """What the corpus says of its periods: abbreviations, sentence starters, pairs, with their scores."""
    m = S.train(table(spark, sf, "documents"))
    none = F.lit(None).cast("string")
    parts = [(m.abbreviations, "abbreviation", F.col("w"), none), (m.starters, "starter", none, F.col("next")), (m.pairs, "pair", F.col("w"), F.col("next"))]
    rows = [df.select(F.lit(kind).alias("kind"), w.alias("w"), nxt.alias("next"), F.round("score", 4).alias("score")) for df, kind, w, nxt in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""WITH {MODEL}, j AS (SELECT k.*, starters.nxt IS NOT NULL AS starts, pairs.w IS NOT NULL AS paired, coalesce(ty.n_lower, 0) AS n_lower, coalesce(mid.n_mid, 0) AS n_mid, ab.w IS NOT NULL AS abbr FROM known k
  LEFT JOIN starters ON starters.nxt = k.nxt LEFT JOIN pairs ON pairs.w = k.w AND pairs.nxt = k.nxt LEFT JOIN types ty ON ty.w = k.nxt LEFT JOIN mid ON mid.nxt = k.nxt LEFT JOIN short ab ON ab.w = k.w),
g AS (SELECT *, nxt_upper AND ((n_lower > 0 AND n_mid = 0) OR starts) AS begins FROM j),
c AS (SELECT *, nxt IS NOT NULL AND closed AND CASE kind WHEN 'none' THEN FALSE WHEN 'mark' THEN TRUE ELSE CASE WHEN kind = 'dots' OR abbr THEN begins
  WHEN {INITIAL("w")} OR {NUMBER("w")} THEN NOT paired AND NOT nxt_lower AND NOT ({INITIAL("w")} AND nxt_upper AND n_lower = 0) ELSE TRUE END END AS stop FROM g),
n AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c),
x AS (SELECT doc_id, k, string_agg(tok, ' ' ORDER BY pos) AS text FROM n GROUP BY 1, 2)
SELECT doc_id || '#' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::VARCHAR, 7, '0') AS sentence_id, md5(text) AS digest FROM x WHERE length(text) >= {LEAST}""")
def f08_trained_sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pairs = staged(S.follow_counts(docs), "pairs")
    return S.split(docs, S.train_on(docs, pairs), LEAST, pairs).select("sentence_id", F.md5("text").alias("digest"))
