"""The words of a text are evaluated once."""

from pyspark.sql import functions as F

from textloom.functions import text as X


def test_readability_tokenizes_once(spark):
    rows = spark.createDataFrame([("A <b>table</b> at http://a.b/c stands.",)], "text string").localCheckpoint()
    plan = rows.select(X.flesch(F.col("text")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]+>") == 1  # the pattern of tags, which stood there once for each use of the words


def test_white_space_of_the_hash(spark):
    one = [" a  b\tc\n", "a b c", "A\x0bb \r\n c", "\fa b\fc"]
    found = spark.createDataFrame([(t,) for t in one], "text string").select(X.content_hash(F.col("text")).alias("h")).distinct().count()
    assert found == 1
