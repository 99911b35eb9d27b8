"""No language is left out for being one of many."""

from pyspark.sql import functions as F

from acyclica.llm import language_id


def test_all_languages_are_learned(spark):
    rows = spark.createDataFrame([(i, f"l{i:03}", f"word{i} text") for i in range(503)], "id long, lang string, text string")
    net = language_id.train(rows, "text", "lang", F.col("id"))
    assert net.langs == [f"l{i:03}" for i in range(503)]
