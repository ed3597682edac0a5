"""Text queries against their SQL on texts where engines tend to differ."""

import duckdb
import pytest

from eventloom.plans import registry


def differences(spark, folder, name: str, texts: list[str | None]) -> list:
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = [tuple(r) for r in registry.queries()[name](spark, str(folder)).select(*want.columns).collect()]
    return sorted(set(got) ^ set(want.fetchall()), key=str)


def test_sentences_keep_digits_at_their_ends(spark, tmp_path):
    # the k-th sentence begins and ends with digits of k
    texts = [" ".join(f"{k}{k} is how this sentence of some length begins and it ends with {k}{k}!" for k in range(30)), "  One sentence that is long enough, between spaces.  ", "", None]
    assert differences(spark, tmp_path, "f06_f08_w21_sentences", texts) == []


@pytest.mark.parametrize("word", ["with Eauéé laen", "éfrom Xyz", "maïs mayé beliefs", "the marginé", "ſafe harbor", "baſis points", "outlooK", "thanK you", "beliefſ may", "with ıI", "EPSé 8K", "from Kelvin", "webcaſt", "İn operator :", "RISK step 1", "dividendſ"])
def test_features_see_words_as_the_sql_does(spark, tmp_path, word):
    assert differences(spark, tmp_path, "f09_f10_text_features", [word, f"x {word} y.", f"\n{word}\n"]) == []


def test_features_round_as_the_sql_does(spark, tmp_path):
    assert differences(spark, tmp_path, "f09_f10_text_features", ["," * 23 + "x" * 2537, "7" * k + "x" * (2560 - k) if (k := 23) else "", "," * 3, None]) == []
