"""The text an embedder receives: tags of any case, spacing and number."""
from pyspark.sql import functions as F

from shelfwatch.functions.titles import embedding_text

ROWS = [
    ("9 cm pot", "Pot", [" pot ", None, "", "Red", "red", "RED ", " x ", "a", "b", "c", "d", "e"], "Acme"),
    (None, None, None, None),
    ("x", None, ["x", "Y"], None),
    ("٩cm A1B2C-3 é1cm", "K", ["acme", "k ", "٠"], "Acme"),
]


def test_only_the_tags_that_are_shown_are_looked_up(spark):
    rows = spark.createDataFrame(ROWS, "title string, kind string, tags array<string>, vendor string")
    texts = rows.select(embedding_text(F.col("title"), F.col("kind"), F.col("tags"), F.col("vendor")).alias("text"))
    assert [r.text for r in texts.collect()] == ["Pot. Red. x. a. b. c. d", "", "x. Y", "K. é1cm. ٠"]
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" in plan and "array_contains" not in plan
