"""The trained sentence splitter on English with abbreviations, and its likelihood ratios by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import sentences as S


def corpus():
    r = random.Random(1)
    verbs, things = ["went", "spoke", "left", "stayed", "smiled"], ["market", "house", "report", "river", "meeting"]
    people = ["Mr. Bell", "Mrs. Stone", "Dr. Hall", "J. Marsh", "Anna"]
    out = []
    for k in range(300):
        said = []
        for _ in range(r.randint(3, 9)):
            said.append(r.choice([
                f"{r.choice(people)} {r.choice(verbs)} to the {r.choice(things)}.", f"The {r.choice(things)} cost approx. {r.randint(2, 90)} dollars.",
                f"In the {r.choice(things)} there was, e.g. a {r.choice(things)}, and a {r.choice(things)}.", f"We met {r.choice(people)} on No. {r.randint(1, 9)} street.", "Was the meeting long?",
                f"They said: \"The {r.choice(things)} is open.\"", f"Nobody at the {r.choice(things)} knew!", f"On that street some dollars remain, an open and long {r.choice(things)}.",
            ]))
        out.append((k, " ".join(said)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return S.train(spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4))


def sentences(spark, model, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = S.split(df, model, 1).orderBy("sentence_id").collect()
    return [[r.text for r in rows if r.sentence_id.startswith(f"{k}#")] for k in range(len(texts))]


def test_abbreviations(model):
    found = {r.w for r in model.abbreviations.collect()}
    assert {"mr", "mrs", "dr", "approx", "e.g", "no"} <= found and not found & {"market", "house", "street", "report", "j"}


@pytest.mark.parametrize(
    "parts",
    [
        ["Mr. Bell went to the market.", "Dr. Hall stayed."],
        ["It cost approx. 9 dollars.", "The house is old."],
        ["Was it long?", "Nobody knew!", "Anna left."],
        ['They said: "The river is open."', "We met J. Marsh on No. 4 street."],
        ["There was, e.g. a house, and a river.", "In the end we left."],
        ["He stopped at approx.", "Nobody knew!"],
        ["No stop at all"],
        ["one."],
    ],
)
def test_split(spark, model, parts):
    assert sentences(spark, model, " ".join(parts)) == [parts]


def test_every_word_is_kept_in_order(spark, model):
    texts = [t.replace(" ", "  \n") for _, t in corpus()[:60]]
    for text, found in zip(texts, sentences(spark, model, *texts), strict=True):
        assert " ".join(found) == " ".join(text.split())


def test_odd_texts(spark, model):
    assert sentences(spark, model, None, "", " \n\t ", ".", "...", "a . b", '"', "É. Été. ") == [[], [], [], ["."], ["..."], ["a .", "b"], ['"'], ["É. Été."]]
    long = "The house is old. " * 20_000
    assert sentences(spark, model, long) == [["The house is old."] * 20_000]
    short = S.split(spark.createDataFrame([(1, "Anna left. The long river stayed. No. 4 it is.")], "doc_id long, text string"), model, 15).collect()
    assert [tuple(r) for r in short] == [("1#0000000", "The long river stayed.")]


def test_both_ways_of_splitting_agree(spark, model, monkeypatch):
    texts = [t for _, t in corpus()[:80]] + [None, "", "Mr. Bell. Dr. Hall... \"So!\" he said. e.g. This. (No. 5.) J. Marsh", "é. É. à"]
    one = sentences(spark, model, *texts)
    monkeypatch.setattr(S, "INSIDE_PAIRS", -1)
    assert sentences(spark, model, *texts) == one


def test_training_on_nothing(spark):
    none = S.train(spark.createDataFrame([], "doc_id long, text string"))
    assert [df.count() for df in none] == [0, 0, 0, 0]
    assert sentences(spark, none, "One here. Two there. mr. Three") == [["One here.", "Two there.", "mr.", "Three"]]


def test_likelihood_ratio(spark):
    a, b, ab, n = 40, 30, 20, 1000
    lik = lambda k, m, p: (k * math.log(p) if k else 0) + ((m - k) * math.log(1 - p) if m - k else 0)
    want = 2 * (lik(ab, a, ab / a) + lik(b - ab, n - a, (b - ab) / (n - a)) - lik(ab, a, b / n) - lik(b - ab, n - a, b / n))
    got = spark.range(1).select(S.likelihood_ratio(*[F.lit(float(x)) for x in (a, b, ab, n)])).first()[0]
    assert got == pytest.approx(want)
