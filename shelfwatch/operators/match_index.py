"""Look-alike groups that grow day by day: a stored band index and a stored label forest.

A folder holds four tables, each cut by day, so a day that is run again replaces its own rows:

* ``rows``: the day's hashed products (id, store_id, h);
* ``values``: per day and hash the smallest id, copies and extreme stores;
* ``bands``: band keys of hashes first seen that day, in parts by (band, key);
* ``links``: for labels that lost their place that day, the label they now belong to.

A new day keys its new hashes, opens the parts of the band index they fall in, compares
only pairs of which one side is new, and joins the labels of the pairs found.  Labels are
hash values; the smallest of a group stands for it, and a label's place is found by following
links.  Nothing is rewritten: groups without a new pair are not touched.  Products only
come in; after removals build the index anew.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.constants import MAX_HASH_DISTANCE
from shelfwatch.functions.bits import hamming
from shelfwatch.operators.components import components
from shelfwatch.operators.hamming import band_keys, near_pairs
from shelfwatch.session import cut_lineage

TABLES = {
    "rows": "id long, store_id long, h long", "values": "h long, rep long, copies long, s_lo long, s_hi long",
    "bands": "band int, key long, h long, part int", "links": "label long, parent long",
}


class MatchIndex:
    def __init__(self, spark: SparkSession, path: str, distance: int = MAX_HASH_DISTANCE, segments: int = 8, parts: int = 256):
        self.spark, self.path, self.distance, self.segments, self.parts = spark, path.rstrip("/"), distance, segments, parts
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}")

    def table(self, name: str, before: str | None = None) -> DataFrame:
        """All rows of a table, or those of days before ``before``."""
        rows = self.spark.read.schema(f"{TABLES[name]}, day string").parquet(f"{self.path}/{name}")
        return rows if before is None else rows.filter(F.col("day") < before)

    def _write(self, name: str, day: str, rows: DataFrame) -> None:
        writer = rows.hint("rebalance", "part").write if name == "bands" else rows.write
        by = {"partitionBy": "part"} if name == "bands" else {}
        writer.mode("overwrite").parquet(f"{self.path}/{name}/day={day}", **by)

    def _keyed(self, hashes: DataFrame) -> DataFrame:
        keyed = hashes.select("h", F.posexplode(band_keys(self.distance, self.segments)).alias("band", "key"))
        return keyed.withColumn("part", F.pmod(F.xxhash64("band", "key"), F.lit(self.parts)).cast("int"))

    def places(self, labels: DataFrame, before: str | None = None) -> DataFrame:
        """label, root of every label asked for: links are followed, two steps become one each round."""
        links = self.table("links", before).select("label", "parent")
        at = cut_lineage(labels.select("label").distinct().withColumn("root", F.col("label")))
        while True:
            step = links.select(F.col("label").alias("root"), "parent")
            at = cut_lineage(at.join(step, "root", "left").select(
                "label", F.coalesce("parent", "root").alias("root"), F.col("parent").isNotNull().alias("moved")))
            moved, at = at.filter("moved").take(1), at.select("label", "root")
            if not moved:
                return at

    def add_day(self, day: str, hashes: DataFrame) -> None:
        """Take in the day's products (id, store_id, h); days go forward, a day may be repeated."""
        rows = cut_lineage(hashes.select("id", "store_id", "h"))
        self._write("rows", day, rows)
        self._write("values", day, rows.groupBy("h").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("store_id").alias("s_lo"), F.max("store_id").alias("s_hi")))
        new = cut_lineage(rows.select("h").distinct().join(self.table("values", day).select("h").distinct(), "h", "left_anti"))
        keyed = self._keyed(new)
        self._write("bands", day, keyed)
        touched = [r["part"] for r in keyed.select("part").distinct().collect()]  # ``parts`` at most
        stored = self.table("bands", day).filter(F.col("part").isin(touched)).select("band", "key", "h")
        old = stored.join(keyed.select("band", "key").distinct(), ["band", "key"], "left_semi").select("h").distinct()
        both = new.select(F.col("h").alias("rep"), "h", F.lit(True).alias("fresh")).unionByName(
            old.select(F.col("h").alias("rep"), "h", F.lit(False).alias("fresh")))
        pairs = cut_lineage(near_pairs(cut_lineage(both), self.distance, segments=self.segments, fresh="fresh").select("a", "b"))
        roots = self.places(pairs.select(F.explode(F.array("a", "b")).alias("label")), day)
        ends = [roots.select(F.col("label").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
        joined = components(reduce(lambda df, end: df.join(end, end.columns[0]), ends, pairs), "a_root", "b_root")
        self._write("links", day, joined.filter("node <> component").select(F.col("node").alias("label"), F.col("component").alias("parent")))

    def matches(self) -> DataFrame:
        """(product_id, canonical_id, distance) of groups that span at least two stores, as of the last day."""
        values = self.table("values").groupBy("h").agg(
            F.min("rep").alias("rep"), F.min("s_lo").alias("s_lo"), F.max("s_hi").alias("s_hi"))
        placed = cut_lineage(values.join(self.places(values.select(F.col("h").alias("label"))), F.col("h") == F.col("label")).drop("label"))
        groups = placed.groupBy("root").agg(
            F.min(F.struct("rep", "h")).alias("first"), F.min("s_lo").alias("s_lo"), F.max("s_hi").alias("s_hi")).filter("s_lo <> s_hi")
        found = placed.select("h", "root").join(groups.select("root", "first"), "root")
        return self.table("rows").select("id", "h").join(found, "h").select(
            F.col("id").alias("product_id"), F.col("first.rep").alias("canonical_id"),
            hamming(F.col("h"), F.col("first.h")).cast("int").alias("distance"))
