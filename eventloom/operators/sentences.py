"""Sentence splitting that learns from the corpus which periods end a sentence, after Kiss and Strunk's unsupervised method.

One pass counts tokens as they are written, a second counts what follows those with a stop. From these counts log-likelihood ratios give abbreviations,
frequent sentence starters, and pairs that belong together over an initial's or a number's period; case within sentences tells which
words are lower-cased there. Splitting judges each pair of a token that may end a sentence and its follower once, by joins with these tables; the texts
are then split where they lie.

A token is a run without white space; quotes and brackets around it and commas, colons and semicolons after it are set aside. doc_id is unique
and not null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import staged

#: Fixed thresholds of the method: score of an abbreviation, ratios of a starter and of a pair.
ABBREVIATION, STARTER, PAIR, CLOSE = 0.3, 30.0, 7.88, 0.99
SPACE = r"[ \t\n\x0B\f\r]+"
#: Tokens that end in a stop, whatever closes them; tokens with a stop or of marks alone, and what follows them.
ENDING = r"[.!?…][\"')\]]*$"
#: Pairs that don't end a sentence, and their bytes, up to which they are broadcast.
INSIDE_PAIRS, INSIDE_BYTES = 500_000, 16 << 20
SPACES, CLOSERS = re.compile(SPACE), frozenset(".!?…\"')]")
STOPPED = r"(?<![^ \t\n\x0B\f\r])([^ \t\n\x0B\f\r]*[.!?…][\"')\],;:]*|[\"'(\[)\],;:]+)(?=[ \t\n\x0B\f\r]+([^ \t\n\x0B\f\r]+))"


class Model(NamedTuple):
    """abbreviations: w, score; starters: next, score; pairs: w, next, score; cases: next, n_lower, n_mid."""

    abbreviations: DataFrame
    starters: DataFrame
    pairs: DataFrame
    cases: DataFrame


def _token(t: Column) -> Column:
    """kind (mark, dots, period or none), w (lower case, without its stop), closed (nothing but quotes and brackets follows), upper, lower (its first letter)."""
    first = lambda x: [(F.substring(x, 1, 1) != F.lower(F.substring(x, 1, 1))).alias("upper"), (F.substring(x, 1, 1) != F.upper(F.substring(x, 1, 1))).alias("lower")]
    # most tokens are letters, with or without a period
    plain = F.struct(F.when(t.endswith("."), "period").otherwise("none").alias("kind"), F.lower(F.rtrim(t, F.lit("."))).alias("w"), F.lit(True).alias("closed"), *first(t), F.lit(True).alias("real"))
    bare = F.regexp_replace(F.regexp_replace(t, r"^[\"'(\[]+", ""), r"[\"')\],;:]+$", "")
    kind = F.when(bare.rlike(r"[!?]$"), "mark").when(bare.rlike(r"\.\.$|…$"), "dots").when(bare.endswith("."), "period").otherwise("none")
    word = F.regexp_replace(bare, r"[.!?…]+$", "")
    other = F.struct(kind.alias("kind"), F.lower(word).alias("w"), (~t.rlike(r"[,;:][\"')\]]*$")).alias("closed"), *first(bare), (bare != "").alias("real"))
    return F.when(t.rlike(r"^\p{L}+\.?$"), plain).when(t.isNotNull(), other)


def words(text: str) -> Column:
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def token_counts(docs: DataFrame) -> DataFrame:
    """token, n, and its parts (see _token): every token as it is written is parsed once, however often it occurs; staged."""
    raw = docs.where("text is not null").select(F.explode(F.split("text", SPACE)).alias("token")).where("token != ''").groupBy("token").agg(F.count("*").alias("n"))
    return staged(raw.withColumn("t", _token(F.col("token"))), "tokens")


def follow_counts(docs: DataFrame) -> DataFrame:
    """token, follower, n: what follows tokens with a stop and tokens of marks alone; token is null for a text's first."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(STOPPED), F.lit(1)).alias("token"), F.regexp_extract_all("text", F.lit(STOPPED), F.lit(2)).alias("follower"))
    first = F.struct(F.lit(None).cast("string").alias("token"), F.regexp_extract("text", r"^[ \t\n\x0B\f\r]*([^ \t\n\x0B\f\r]*)", 1).alias("follower"))
    rows = docs.where("text is not null").select(F.explode(F.concat(pairs, F.array(first))).alias("p")).select("p.*")
    return rows.where("follower != ''").groupBy("token", "follower").agg(F.count("*").alias("n"))


def stops(docs: DataFrame) -> DataFrame:
    """doc_id, pos, token, follower of the tokens that may end a sentence; the last one of a text isn't among them."""
    pairs = F.transform(F.col("_w"), lambda t, i: F.struct(i.alias("pos"), t.alias("token"), F.get("_w", i + 1).alias("follower")))
    some = F.filter(pairs, lambda p: p["token"].rlike(ENDING) & p["follower"].isNotNull())
    return docs.where("text is not null").select("doc_id", words("text").alias("_w")).select("doc_id", F.explode(some).alias("p")).select("doc_id", "p.*")


def _log(n: Column, p: Column) -> Column:
    """n * log(p), 0 for no cases."""
    return F.when(n > 0, n * F.log(p)).otherwise(F.lit(0.0))


def likelihood_ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Does b follow a more or less often than by chance? a, b: how often each occurs, ab: together, n: tokens."""
    p, with_a, without = b / n, ab / a, (b - ab) / (n - a)
    rest = n - a - b + ab
    same = _log(b, p) + _log(a - ab + rest, 1 - p)
    apart = _log(ab, with_a) + _log(a - ab, 1 - with_a) + _log(b - ab, without) + _log(rest, 1 - without)
    return 2 * (apart - same)


def is_initial(w: str) -> Column:
    return F.col(w).rlike(r"^\p{L}$")


def is_number(w: str) -> Column:
    return F.col(w).rlike(r"^[0-9][0-9.,]*$")


def has_letter(w: str) -> Column:
    return F.col(w).rlike(r"\p{L}")


def type_counts(tokens: DataFrame) -> DataFrame:
    """w, n_plain, n_period, n_lower, n_upper: how often a type occurs without and with a period, and begins in lower case or not; staged."""
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    period = F.col("t.kind") == "period"
    real = tokens.where("t.real").groupBy(F.col("t.w").alias("w"))
    return staged(real.agg(count(~period).alias("n_plain"), count(period).alias("n_period"), count(F.col("t.lower")).alias("n_lower"), count(F.col("t.upper")).alias("n_upper")), "types")


def abbreviations(types: DataFrame) -> DataFrame:
    """w, score of the types that a period belongs to: a ratio of likelihoods, less for long types and for those that occur without one."""
    total = types.agg(F.sum(F.col("n_plain") + F.col("n_period")).alias("_n"), F.sum("n_period").alias("_stops"))
    dots = F.length("w") - F.length(F.replace(F.col("w"), F.lit("."), F.lit("")))
    size = (F.length("w") - dots).cast("double")
    share, ab, rest = F.col("_stops") / F.col("_n"), F.col("n_period").cast("double"), F.col("n_plain").cast("double")
    ratio = 2 * (_log(ab, F.lit(CLOSE)) + _log(rest, F.lit(1 - CLOSE)) - _log(ab, share) - _log(rest, 1 - share))
    score = ratio * F.exp(-size) * (dots + 1) * F.pow(size, -rest)
    some = types.where(has_letter("w") & ~is_initial("w") & (F.col("n_period") > 0)).crossJoin(F.broadcast(total))  # one row
    return some.select("w", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def train(docs: DataFrame) -> Model:
    """The tables that a corpus gives; each is staged."""
    return train_on(docs, follow_counts(docs))


def train_on(docs: DataFrame, pairs: DataFrame) -> Model:
    """The same with what follows what in docs (see follow_counts), where that has other uses."""
    tokens = token_counts(docs)
    types = type_counts(tokens)
    short = staged(abbreviations(types), "abbreviations")
    n = types.agg(F.sum(F.col("n_plain") + F.col("n_period")).alias("_n"))
    every = types.select(F.col("w").alias("next"), (F.col("n_plain") + F.col("n_period")).alias("b"), "n_lower", "n_upper")
    follows = pairs.select(_token(F.col("token")).alias("t"), _token(F.col("follower")).alias("f"), F.col("token").isNull().alias("first"), "n").where("f.real")
    follows = follows.select("first", F.coalesce("t.real", F.lit(False)).alias("real"), "t.kind", "t.closed", "t.w", F.col("f.w").alias("next"), F.col("f.upper").alias("upper"), "n")
    known = follows.join(short.select("w", F.lit(True).alias("short")), "w", "left")
    plain_period = (F.col("kind") == "period") & F.col("short").isNull() & ~is_initial("w") & ~is_number("w")
    ends = F.col("real") & F.col("closed") & ((F.col("kind") == "mark") | plain_period)
    known = staged(known.withColumn("ends", F.coalesce(ends, F.lit(False))), "known")
    breaks = known.where("ends").agg(F.sum("n").alias("a"))
    # what begins sentences
    after = known.where("ends").groupBy("next").agg(F.sum("n").alias("ab")).join(every, "next").where(has_letter("next"))
    ratio = likelihood_ratio(F.col("a"), F.col("b"), F.col("ab"), F.col("_n"))
    often = F.col("_n") * F.col("ab") > F.col("a") * F.col("b")
    starters = after.crossJoin(F.broadcast(breaks)).crossJoin(F.broadcast(n)).where(often & (F.col("a") < F.col("_n"))).select("next", ratio.alias("score")).where(F.col("score") >= STARTER)  # one row each
    # what belongs together over the period of an initial or a number
    firsts = types.select("w", (F.col("n_plain") + F.col("n_period")).alias("a"))
    both = known.where(F.col("real") & (F.col("kind") == "period") & (is_initial("w") | is_number("w"))).groupBy("w", "next").agg(F.sum("n").alias("ab")).where("ab > 1").where(has_letter("next"))
    both = both.join(firsts, "w").join(every, "next").crossJoin(F.broadcast(n))
    pairs = both.where(often & (F.col("a") < F.col("_n"))).select("w", "next", ratio.alias("score")).where(F.col("score") >= PAIR)
    # capitals that nothing explains: all of them but those after a stop of any kind, after marks alone and at the beginning of a text
    other = known.where("upper and (first or not real or kind != 'none')").groupBy("next").agg(F.sum("n").alias("n_after"))
    cases = every.join(other, "next", "left").select("next", "n_lower", (F.col("n_upper") - F.coalesce("n_after", F.lit(0))).alias("n_mid"))
    return Model(short, staged(starters, "starters"), staged(pairs, "pairs"), staged(cases, "cases"))


def _ending(pairs: DataFrame, model: Model) -> DataFrame:
    """pairs (token, follower, ...) with ends: does the token end a sentence before its follower?"""
    keep = pairs.columns
    parsed = pairs.select(*keep, _token(F.col("token")).alias("t"), _token(F.col("follower")).alias("f"))
    at = parsed.select(*keep, "t.kind", "t.closed", "t.w", F.col("f.w").alias("next"), F.col("f.upper").alias("upper"), F.col("f.lower").alias("lower"))
    seen = at.join(model.abbreviations.select("w", F.lit(True).alias("short")), "w", "left").join(model.starters.select("next", F.lit(True).alias("starts")), "next", "left")
    seen = seen.join(model.pairs.select("w", "next", F.lit(True).alias("paired")), ["w", "next"], "left").join(model.cases, "next", "left").fillna(False, ["short", "starts", "paired"]).fillna(0, ["n_lower", "n_mid"])
    begins = F.col("upper") & (((F.col("n_lower") > 0) & (F.col("n_mid") == 0)) | F.col("starts"))
    lone = is_initial("w") | is_number("w")
    name = is_initial("w") & F.col("upper") & (F.col("n_lower") == 0)
    ends = F.when(F.col("kind") == "mark", F.lit(True)).when((F.col("kind") == "dots") | F.col("short"), begins).when(lone, ~F.col("paired") & ~F.col("lower") & ~name).otherwise(F.lit(True))
    return seen.select(*keep, ((F.col("kind") != "none") & F.col("closed") & ends).alias("ends"))


def boundaries(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, pos of each token that ends a sentence and isn't its text's last."""
    return _ending(stops(docs), model).where("ends").select("doc_id", "pos")


def _cut(frames: Iterator[pd.DataFrame], inside, least: int) -> Iterator[pd.DataFrame]:
    """doc_id, n, text of the sentences of whole texts; inside: pairs of a token and its follower that belong to one sentence."""
    inside, ending = inside.value, re.compile(ENDING)
    for frame in frames:
        out = []
        for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
            words = [w for w in SPACES.split(text) if w]
            first, n = 0, 0
            for k, word in enumerate(words):
                last = k + 1 == len(words)
                if last or (word[-1] in CLOSERS and ending.search(word) and (word, words[k + 1]) not in inside):
                    said = " ".join(words[first : k + 1])
                    first = k + 1
                    if len(said) >= least:
                        out.append((doc_id, n, said))
                        n += 1
        yield pd.DataFrame(out, columns=["doc_id", "n", "text"])


def split(docs: DataFrame, model: Model, least: int, pairs: DataFrame | None = None) -> DataFrame:
    """sentence_id (doc_id#0000000), text: sentences of `least` characters or more, white space as one space, numbered over those kept.

    Each pair of a token and its follower is judged once, however often it occurs. Where those that don't end a sentence are few, they are broadcast and texts are
    split where they lie; otherwise the stops of a text are joined to it. pairs: what follow_counts gives for docs, if it is known.
    """
    pairs = (follow_counts(docs) if pairs is None else pairs).where("token is not null").select("token", "follower")
    inside = staged(_ending(pairs.where(F.col("token").rlike(ENDING)), model).where("not ends").select("token", "follower"), "inside")
    n, size = inside.agg(F.count("*"), F.sum(F.octet_length("token") + F.octet_length("follower"))).first()
    real = docs.where("text is not null").select("doc_id", "text")
    if n <= INSIDE_PAIRS and (size or 0) <= INSIDE_BYTES:
        sent = docs.sparkSession.sparkContext.broadcast({(r.token, r.follower) for r in inside.collect()})
        kind = docs.schema["doc_id"].dataType.simpleString()
        kept = real.mapInPandas(lambda f: _cut(f, sent, least), f"doc_id {kind}, n int, text string")
    else:
        kept = split_by_join(real, model, least)
    return kept.select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.lpad(F.col("n").cast("string"), 7, "0")).alias("sentence_id"), "text")


def split_by_join(docs: DataFrame, model: Model, least: int) -> DataFrame:
    """doc_id, n, text: a text's stops are gathered and joined to it; its words never leave its row."""
    found = boundaries(docs, model).groupBy("doc_id").agg(F.array_sort(F.collect_list("pos")).alias("_stops"))
    both = docs.join(found, "doc_id", "left").select("doc_id", "_stops", words("text").alias("_w")).where("size(_w) > 0")
    both = both.withColumn("_ends", F.concat(F.coalesce("_stops", F.array().cast("array<int>")), F.array(F.size("_w") - 1)))
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_ends", i - 1) + 1)
    cut = F.transform("_ends", lambda e, i: F.array_join(F.slice("_w", start(i) + 1, e - start(i) + 1), " "))
    return both.select("doc_id", F.posexplode(F.filter(cut, lambda s: F.length(s) >= least)).alias("n", "text"))
