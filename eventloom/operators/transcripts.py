"""Call transcripts cut into units: sections by header lines, speakers by role lines, answers with their questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The lines that structure a transcript.
PRESENTER, QUESTION, ANSWER = "Presenter Speech", "Question", "Answer"
HEADERS = ["Presentation Operator Message", PRESENTER, "Question and Answer Operator Message", QUESTION, ANSWER]
ROLES = ["Executives", "Analysts", "Analyst", "Operator", "Company Representatives", "Company Representative"]
TITLES = r"(?i)\b(CEO|CFO|CTO|COO|Chief|Chair|Chairman|Chairwoman|President|Vice\s+President|VP|EVP|SVP|Executive|Director|Treasurer|Investor\s+Relations|Head\s+of|Analyst|Founder|Officer)\b"
HOST_INTRO = r"(?i)^(Thanks?[,.]\s|Our\s+next\s+question\b|Turning\s+(back|to)\b|Thank\s+you[.,]?\s+(Turning|That\s+concludes)|We\s+received\b)|\bnext\s+question\s+is\s+from\b"
HOST_CLOSING = r"(?i)^(Thank\s+you[.,]?\s+)?That\s+concludes\b"

_HEADER = rf"(?m)^({'|'.join(HEADERS)})[ \t\r]*$"
_ROLE = r"(?m)^[ \t]*(Executives|Analysts?|Operator|Company[ \t]+Representatives?)([ \t]*-[ \t]*\S.*)?[ \t\r]*$"
_BLANK = " \t\r\n"


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANK))


def _block(kind: Column, part: Column) -> Column:
    """kind, role, title, body of one speaker's part: its first line is the role; a title may be the line after a bare role."""
    head = lambda text: _strip(F.regexp_extract(text, r"^([^\n]*)", 1))
    rest = lambda text: _strip(F.regexp_replace(text, r"^[^\n]*", ""))
    part = _strip(part)
    line, body = head(part), rest(part)
    titled = line.isin(ROLES) & head(body).rlike(TITLES) & (F.length(head(body)) < 120)
    role = _strip(F.regexp_extract(line, r"^(.*?)( - |$)", 1))
    title = F.when(titled, head(body)).when(F.contains(line, F.lit(" - ")), _strip(F.regexp_extract(line, r"^.*? - (.*)$", 1))).otherwise(line)
    return F.struct(kind.alias("kind"), role.alias("role"), title.alias("title"), F.when(titled, rest(body)).otherwise(body).alias("body"))


def _parts(section: Column) -> Column:
    """A section's parts by speaker; without a role line it is one part."""
    chunk = F.regexp_replace(section, r"^[^\n]*\n?", "")
    cut = F.split(chunk, rf"(?={_ROLE})")
    by_role = F.filter(cut, lambda p: p.rlike(rf"\A{_ROLE.removeprefix('(?m)^').replace('$', '($|\\n)')}"))
    whole = F.filter(F.array(chunk), lambda p: _strip(p) != "")
    return F.when(F.size(by_role) > 0, by_role).otherwise(whole)


def blocks(text: Column) -> Column:
    """The blocks of a transcript in order; operator messages, adjacent copies and a host's closing words are left out.

    A host's lead-in (a bare executive line) is a question, and goes before the analyst's question that follows it.
    """
    kind = lambda s: F.regexp_extract(s, _HEADER, 1)
    sections = F.filter(F.split(text, rf"(?={_HEADER})"), lambda s: kind(s).isin(PRESENTER, QUESTION, ANSWER))
    found = F.flatten(F.transform(sections, lambda s: F.transform(_parts(s), lambda p: _block(kind(s), p))))
    found = F.filter(found, lambda b: (b.role != "") | (b.body != ""))
    return found


def _host(b: Column) -> Column:
    return (b.kind != PRESENTER) & (F.lower(b.role) == "executives") & (b.title == b.role)


def _tidy(found: Column) -> Column:
    same = lambda b, i: (i > 0) & F.get(found, i - 1).role.eqNullSafe(b.role) & F.get(found, i - 1).title.eqNullSafe(b.title) & F.get(found, i - 1).body.eqNullSafe(b.body)
    kept = F.filter(found, lambda b, i: ~same(b, i))
    kept = F.filter(kept, lambda b: ~(_host(b) & b.body.rlike(HOST_CLOSING)))
    return F.transform(kept, lambda b: F.when(_host(b) & b.body.rlike(HOST_INTRO), b.withField("kind", F.lit(QUESTION))).otherwise(b))


def _join_lead_ins(found: Column) -> Column:
    lead_in = lambda b: F.coalesce(_host(b) & (b.kind == QUESTION), F.lit(False))
    asked = lambda b: F.coalesce((b.kind == QUESTION) & F.startswith(F.lower(b.role), F.lit("analyst")), F.lit(False))
    whole = lambda b, i: F.when(asked(b) & (i > 0) & lead_in(F.get(found, i - 1)), b.withField("body", F.concat(F.get(found, i - 1).body, F.lit("\n\n"), b.body))).otherwise(b)
    joined = F.transform(found, lambda b, i: F.struct(whole(b, i).alias("b"), (lead_in(b) & asked(F.get(found, i + 1))).alias("gone")))
    return F.transform(F.filter(joined, lambda j: ~j.gone), lambda j: j.b)


def units(calls: DataFrame, call: str, text: str) -> DataFrame:
    """call, order, unit_id, kind (presenter, qa), role, title, question, text, n_chars, warning of each unit.

    An answer takes the latest question that was answered at once; a question that nothing answers and an answer without a
    question are units with a warning. A null or empty text, or one without headers, has no units.
    """
    rows = calls.where(F.col(text).isNotNull()).select(F.col(call), blocks(F.col(text)).alias("_b"))
    rows = rows.withColumn("_b", _tidy(F.col("_b"))).withColumn("_b", _join_lead_ins(F.col("_b")))
    rows = rows.select(call, F.posexplode("_b").alias("_n", "_b")).select(call, "_n", "_b.*")
    by = W.partitionBy(call).orderBy("_n")
    answered = F.coalesce(F.lead("kind").over(by) == ANSWER, F.lit(False))
    rows = rows.withColumn("_answered", answered)
    asked = F.when(F.col("kind") == QUESTION, F.struct("body", "_answered"))
    rows = rows.withColumn("_q", F.last(asked, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)))
    question = F.when(F.col("kind") == QUESTION, F.col("body")).when((F.col("kind") == ANSWER) & F.col("_q._answered"), F.col("_q.body"))
    kept = rows.where((F.col("kind") != QUESTION) | ~F.col("_answered")).withColumns({
        "_question": question, "order": F.row_number().over(by) - 1, "_speech": F.count_if(F.col("kind") == PRESENTER).over(by),
    })
    kind, speech = F.col("kind"), F.col("kind") == PRESENTER
    number = F.when(speech, F.concat(F.lit("__pres__"), F.lpad(F.col("_speech").cast("string"), 2, "0"))).otherwise(F.concat(F.lit("__qa__"), F.lpad(F.col("order").cast("string"), 3, "0")))
    said = F.when(kind == QUESTION, F.lit("")).otherwise(F.col("body"))
    return kept.select(
        call, "order", F.concat(F.col(call).cast("string"), number).alias("unit_id"), F.when(speech, "presenter").otherwise("qa").alias("kind"), "role", "title",
        F.col("_question").alias("question"), said.alias("text"), F.length(said).alias("n_chars"),
        F.when(kind == QUESTION, "orphan_question").when((kind == ANSWER) & F.col("_question").isNull(), "orphan_answer").alias("warning"),
    )
