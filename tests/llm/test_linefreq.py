import duckdb

from vecspark.llm import linefreq

SCHEMA = "doc_id long, text string, source string, n_words string, kept string, _row long"


def rows():
    filler = [" ".join(f"w{d}x{k}" for k in range(40)) for d in range(30)]
    out = [(d, f"{filler[d]}\nSubscribe  to OUR list\nsubscribe to our LIST", "hot", "a", "b", 0) for d in range(30)]
    out += [(d, filler[d % 5], "other", None, None, None) for d in range(30, 34)]
    out += [(50, None, "hot", "", "", 1), (51, "", None, "", "", 1), (52, " \t\n ", "hot", "", "", 1), (None, "short text", None, "", "", 1)]
    out += [(53, "a b c d e f g h " * 5 + "tail", "hot", "", "", 1), (54, "Subscribe to our list\n" * 9, "hot", "", "", 1)]
    out += [(55, "q " * 4000, "x", "", "", 1), (56, "# * $ % & | < >\nä€😀 x\x0by\x0cz", "x", "", "", 1), (56, "# * $ % & | < >\nä€😀 x\x0by\x0cz", "x", "", "", 1)]
    return out


def test_matches_the_sql(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = linefreq.line_frequency(df).drop("removed_lines")
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    want = con.execute(linefreq.ORACLE).fetchdf()
    key = lambda x: sorted((tuple(None if v != v else v for v in r) for r in x.itertuples(index=False)), key=str)
    pdf = got.toPandas()
    assert list(pdf.columns) == list(want.columns)
    assert key(pdf.astype(object)) == key(want.astype(object))


def test_boilerplate_goes_and_depleted_documents_are_rejected(spark):
    got = {r["doc_id"]: r for r in linefreq.line_frequency(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got[0]["removed_lines"] == [1, 2] and got[0]["kept"] and got[0]["n_left_words"] == 40
    assert not got[54]["kept"] and got[54]["n_left_words"] == 0
    assert got[30]["n_removed_lines"] == 0 and got[30]["kept"]
    assert got[53]["base_failed"] and got[53]["n_repeat_words"] == 40
    assert got[50]["n_words"] == 0 and got[50]["base_failed"]


def test_empty_table(spark):
    assert linefreq.line_frequency(spark.createDataFrame([], SCHEMA)).collect() == []
