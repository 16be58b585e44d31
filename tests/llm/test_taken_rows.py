"""Rows that differ in any column are rows of their own in the mix."""

from pyspark.sql import functions as F

from normscope.llm import mixing


def test_rows_that_differ_elsewhere_stay(spark):
    rows = [(1, "one two three", "s", lang, tags) for lang, tags in [("en", ["a", None]), ("en", [None, "a"]), ("de", None), (None, None)]] + [(2, "four", "s", "en", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tags array<string>")
    # every row is taken once at least: the one source's target is one and a half times its size
    got = mixing.taken(df)
    assert got.columns == df.columns
    assert {(r["doc_id"], r["lang"], str(r["tags"])) for r in got.collect()} == {(a, d, str(e)) for a, _, _, d, e in rows}
    assert got.where("doc_id = 2").count() >= 2
    maps = df.withColumn("m", F.create_map(F.lit("k"), F.col("lang")))
    assert mixing.taken(maps).select("doc_id", "lang").distinct().count() == 4
