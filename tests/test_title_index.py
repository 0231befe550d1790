"""Title searches through the posting table equal a scan, and read few of its rows."""
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfwatch.plans import title_index
from shelfwatch.plans.listing import escape_like
from shelfwatch.session import scratch_path

TITLES = [None, "", "ab", "Abc", "50% off_mug", "50 percent off mug", "a\\b path", "ΣΟΦΟΣ mug", "İstanbul mug", "MUG  mug", "mu", "😀😀😀 cup", "x" * 20_000 + "mug"]
PATTERNS = ["mug", "MUG", "0% o", "f_m", "ab", "", "σοφος", "istanbul", "😀😀😀", "u%p", "mug%mug", "___", "xxxxmug", "abcd", "b%c"]


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(4)
    words = ["red", "blue", "mug", "cup", "ring", "lamp"]
    rows = [(i, t) for i, t in enumerate(TITLES)] + [(100 + i, " ".join(rng.choices(words, k=4))) for i in range(400)]
    products = spark.createDataFrame([(i, t, "gram", 0) for i, t in rows], "product_id long, title string, gram string, bucket int")
    path = scratch_path(spark, "titles")
    title_index.build_title_index(products, path, rows_per_bucket=20)
    return products, path


def ids(df):
    return sorted(r["product_id"] for r in df.select("product_id").collect())


@pytest.mark.parametrize("escape", [False, True])
def test_equals_a_scan(spark, indexed, escape):
    products, path = indexed
    for q in PATTERNS:
        pattern = f"%{escape_like(q) if escape else q}%"
        assert ids(title_index.search_titles(spark, path, q, escape)) == ids(products.filter(F.col("title").ilike(pattern))), q


def test_opens_only_buckets_of_candidates(spark, indexed):
    _, path = indexed
    found = title_index.candidates(spark, path, "%xxxmug%")
    assert found.count() == 1 and "In(gram, [" in found._jdf.queryExecution().executedPlan().toString()
    assert spark.read.parquet(f"{path}/titles").select("bucket").distinct().count() > 10
    searched = title_index.search_titles(spark, path, "xxxmug")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+\)\]", searched)) == 1
    assert title_index.candidates(spark, path, "%m%") is None


def test_counts_rank_only(spark, indexed):
    """A batch written again doubles the counts and changes no result; a renamed product leaves its old words."""
    products, path = indexed
    before = ids(title_index.search_titles(spark, path, "lamp"))
    batch = products.filter("product_id in (1, 2)").withColumn("title", F.lit("tall lamp"))
    for _ in range(2):
        title_index.add_titles(batch, path)
    assert ids(title_index.search_titles(spark, path, "lamp")) == sorted([*before, 1, 2])
    title_index.add_titles(batch.withColumn("title", F.lit("vase")), path)
    assert ids(title_index.search_titles(spark, path, "lamp")) == before
    assert ids(title_index.search_titles(spark, path, "vase")) == [1, 2]


def test_empty_table(spark):
    path = scratch_path(spark, "titles")
    none = spark.createDataFrame([], "product_id long, title string")
    title_index.build_title_index(none, path)
    assert title_index.search_titles(spark, path, "mug").count() == 0 and title_index.search_titles(spark, path, "m").count() == 0


def test_literal_runs():
    assert title_index.literal_runs(r"%ab\%c_d%") == ["ab%c", "d"] and title_index.literal_runs("%%") == []


def test_products_are_read_once_per_batch(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    products = spark.range(50).selectExpr("id AS product_id", "'red ring' AS title").mapInPandas(seen, "product_id long, title string")
    path = str(tmp_path / "index")
    title_index.build_title_index(products, path)
    assert read.value == 50
    title_index.add_titles(products, path)
    assert read.value == 100
    assert title_index.search_titles(spark, path, "ring").count() == 50


def test_held_titles_add_no_postings(spark):
    products = spark.range(60).selectExpr("id AS product_id", "CASE WHEN id % 7 > 0 THEN concat('ring ', id) END AS title")
    path = scratch_path(spark, "titles")
    title_index.build_title_index(products.filter("product_id < 40"), path, rows_per_bucket=10)
    batch = products.filter("product_id >= 20").withColumn("title", F.when(F.col("product_id") < 25, F.concat(F.lit("new "), "title")).otherwise(F.col("title")))
    files = []
    for _ in range(2):
        title_index.add_titles(batch, path)
        files.append(sorted(spark.read.parquet(f"{path}/{part}").inputFiles() for part in ("postings", "grams", "titles")))
    assert files[0] == files[1]
    assert ids(title_index.search_titles(spark, path, "new")) == [20, 22, 23, 24]
    assert ids(title_index.search_titles(spark, path, "ring")) == [i for i in range(60) if i % 7]
    # Postings of 20 (renamed) to 24 come twice, those of titles that stayed as they were once.
    held = {r["product_id"]: r["count"] for r in spark.read.parquet(f"{path}/postings").filter("gram = 'rin'").groupBy("product_id").count().collect()}
    assert {i for i, n in held.items() if n > 1} == {20, 22, 23, 24}
