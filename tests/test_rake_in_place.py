"""RAKE scores a document where it is."""

from textloom.operators import mining


def test_no_shuffle_of_words(spark):
    docs = spark.createDataFrame([(1, "deep learning and deep nets with the cat"), (2, "the of"), (3, None), (4, "Red red fox. Red fox, the red")], "doc_id long, text string")
    found = mining.rake(docs, unique=True)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, found.collect()))
    # 4: "red red fox red fox" (five words) and "red": red (15 + 1) / 4 = 4, fox 10 / 2 = 5
    assert rows == [(1, 1, "deep learning", 4.0), (1, 2, "deep nets", 4.0), (1, 3, "cat", 1.0), (4, 1, "red red fox red fox", 22.0), (4, 2, "red", 4.0)]


def test_rows_of_one_id_are_one_document(spark):
    rows = spark.createDataFrame([(1, "big cat"), (1, "big dog and cat"), (2, "cat")], "doc_id long, text string")
    found = {(r.doc_id, r.phrase): r.score for r in mining.rake(rows).collect()}
    assert found == {(1, "big cat"): 3.5, (1, "big dog"): 4.0, (1, "cat"): 1.5, (2, "cat"): 1.0}
