"""Tokens as column expressions."""

from pyspark.sql import functions as F

from lodestone.functions.text import code_tokens

TEXTS = {
    "..a.B_c--": ["a.b_c", "a", "b", "c"],
    "HTTPServer2Go fooBar": ["httpserver2go", "http", "server2", "go", "foobar", "foo", "bar"],
    "src/x.X.x": ["src/x.x.x", "src", "x", "x", "x"],
    "___ ab": ["ab"],
    "Ab": ["ab"],
}


def test_a_run_is_taken_apart_once(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "text string, tokens array<string>").withColumn("got", code_tokens("text"))
    assert [(r.text, r.got) for r in df.where("got <> tokens").collect()] == []
    plan = df.select("got").where(F.size("got") > 0)._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 3  # the run's ends, and the two borders of camel case
