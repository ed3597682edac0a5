"""The pipeline's stages against brute force on the smallest tables, and on a table with odd rows."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from eventloom.llm import decontam, mixing, neardup, quality, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, step in C.STAGES:
        out.append(step(spark, out[-1], DATA).cache())
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_each_stage_drops_what_its_operator_rejects(spark, stages):
    docs, clean, good, single, unleaked, mixed = stages
    labels, bench = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert all(s.columns == docs.columns for s in stages[:-1])
    assert ids(clean) == ids(toxicity.score(docs, labels).where("predicted = 0"))
    assert ids(good) == ids(quality.judge(clean).where("kept"))
    assert ids(single) == {r.class_id for r in neardup.classes(good).select("class_id").collect()}
    assert ids(unleaked) == ids(single) - ids(decontam.contaminated(single, bench))
    texts = {r.doc_id: r.text for r in single.collect()}
    leaked = {d for d, t in texts.items() for b in bench.collect() if re.sub(r"\s+", " ", b.text.lower()).strip() in re.sub(r"\s+", " ", t.lower())}
    assert leaked <= ids(single) - ids(unleaked)
    assert [f.name for f in mixed.schema][:5] == docs.columns and mixed.where("taken <= 0").count() == 0


def test_mixture_of_what_is_left(stages):
    left, mixed = stages[-2].toPandas(), stages[-1].toPandas()  # noqa: F841
    db = duckdb.connect()
    db.register("documents", left)
    want = {r[0]: r[1:] for r in db.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE}) WHERE taken > 0").fetchall()}
    assert {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in stages[-1].collect()} == want


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, C.run(spark, DATA).select("doc_id", "taken").collect())) == sorted(map(tuple, stages[-1].select("doc_id", "taken").collect()))


def test_odd_rows(spark):
    # words of hash digits: a counter in each word would compress so well that the quality rules reject the text
    good = [" ".join(hashlib.md5(f"{k} {i}".encode()).hexdigest()[: 4 + i % 7] for i in range(70)) for k in range(6)]
    rows = [(None, good[0]), (None, good[0]), (None, good[1]), (1, good[2]), (1, good[2]), (2, good[2] + " end"), (3, None), (4, ""), (5, good[3]), (None, good[3]), (6, good[4])]
    docs = spark.createDataFrame([(i, t, None, "s" if i else None, None, 7, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, target string")
    for _, step in C.STAGES:
        docs = step(spark, docs, DATA).cache()
    got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert got == sorted([(None, good[0]), (None, good[1]), (1, good[2]), (5, good[3]), (6, good[4])], key=str)
    assert {"size", "target", "mix_size", "mix_target", "taken"} <= set(docs.columns)


def test_no_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, step in C.STAGES:
        docs = step(spark, docs, DATA)
    assert docs.count() == 0 and docs.agg(F.sum("taken")).first()[0] is None
