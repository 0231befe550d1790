"""Driver tables seen as storefront tables.

Each view derives from whole driver tables: suppliers are stores, (supplier, part)
pairs are listings, ship dates are observation days.
"""
from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.functions.domains import host_of, tld
from shelfwatch.operators.rollup import backfill_rollup
from shelfwatch.session import tune
from shelfwatch.sources.tables import load

AS_OF = "2001-10-15"
DAY = "2001-06-15"
SPLIT_DAY = "2000-01-01"
ROWS_PER_TASK = 100_000


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    # --- observations and listings -------------------------------------------
    @cached_property
    def items(self) -> DataFrame:
        """Line items dealt by part: groups and joins on the part, with whatever else, need no further exchange.

        The number of tasks follows the rows, so a task's maps and sorts are as large at any size of the table.
        """
        items = self.table("lineitem")
        tasks = max(2, math.ceil(items.count() / ROWS_PER_TASK))
        price = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long")
        return items.select(
            F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("part_id"),
            F.col("l_shipdate").cast("date").alias("observed_on"), price.alias("price_cents"),
        ).repartition(tasks, "part_id")

    @cached_property
    def obs(self) -> DataFrame:
        """One price per (store, part, day)."""
        return self.items.groupBy("store_id", "part_id", "observed_on").agg(F.min("price_cents").alias("price_cents"))

    def listings(self, obs: DataFrame) -> DataFrame:
        per = obs.groupBy("store_id", "part_id").agg(
            F.min("observed_on").alias("first_on"), F.max("observed_on").alias("last_on"),
            F.min("price_cents").alias("price_cents"), F.max("price_cents").alias("compare_at_cents"),
        )
        part = self.table("part").withColumnRenamed("p_partkey", "part_id")
        kind = F.when(F.col("p_size") % 10 == 0, None).when(F.col("p_type") == "PROMO", "uncategorized")
        return per.join(part, "part_id").select(
            (F.col("store_id") * 1000000000 + F.col("part_id")).alias("product_id"), "store_id", "part_id",
            F.col("part_id").alias("source_id"),
            F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("part_id").cast("string")).alias("handle"),
            F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("product_type"),
            F.when(F.col("part_id") % 11 != 0, F.concat(F.lit("https://cdn.example/"), F.col("part_id").cast("string"), F.lit(".jpg"))).alias("image_url"),
            F.lower(F.lpad(F.hex(self._hash()), 16, "0")).alias("image_hash"),
            "price_cents", "compare_at_cents",
            kind.otherwise(F.lower("p_type")).alias("category"),
            F.when(F.col("p_size") <= 40, F.substring_index("p_name", " ", -1)).alias("niche"),
            F.when(F.col("p_size") != 7, F.col("first_on").cast("timestamp")).alias("published_at"),
            F.col("first_on").cast("timestamp").alias("first_seen_at"),
            F.col("last_on").cast("timestamp").alias("last_seen_at"),
            "p_size",
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.listings(self.obs)

    @cached_property
    def variants(self) -> DataFrame:
        k = F.col("k")
        turn = (F.col("part_id") + k) % 3
        return self.products.select("product_id", "part_id", "price_cents", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(
            (F.col("product_id") * 2 + k).alias("variant_id"), "product_id", k.cast("long").alias("source_id"),
            F.concat(F.lit("Size "), k.cast("string")).alias("title"),
            (F.col("price_cents") + 250 * k).alias("price_cents"),
            F.when(turn == 1, True).when(turn == 2, False).alias("available"),
        )

    # --- stores --------------------------------------------------------------
    @cached_property
    def base_stores(self) -> DataFrame:
        nation = self.table("nation")
        s, region = F.col("s_suppkey"), F.col("n_regionkey")

        def by_region(*values):
            chain = F.when(region == 0, values[0])
            for i, v in enumerate(values[1:4], 1):
                chain = chain.when(region == i, v)
            return chain.otherwise(values[4])

        lang = F.when(F.col("s_nationkey") % 4 == 0, "en").when(F.col("s_nationkey") % 4 == 1, "de-DE").when(
            F.col("s_nationkey") % 4 == 2, "EN")
        df = self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            s.alias("store_id"), F.col("s_name").alias("name"),
            F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), by_region(".com", ".co.uk", ".shop", ".de", ".net")).alias("domain"),
            F.col("n_name").alias("country"), by_region("ZAR", "USD", "JPY", "EUR", "AED").alias("currency"),
            lang.alias("language"),
            F.when(s % 3 != 0, F.concat("n_name", F.lit(" goods by "), "s_name")).alias("description"),
            (s % 17 == 0).alias("is_hidden"), (s % 13 != 0).alias("is_active"),
            (s % 3).cast("int").alias("fail_count"), (1 + s % 5).cast("int").alias("crawl_priority"),
            F.when(s % 5 == 0, F.concat(F.lit("cat_"), (s % 10).cast("string"))).alias("context_category"),
            F.when(s % 5 == 0, F.lit(AS_OF).cast("timestamp") - F.make_dt_interval((s % 30).cast("int"))).alias("context_at"),
        )
        return df.withColumn("tld", tld(F.col("domain")))

    @cached_property
    def stores(self) -> DataFrame:
        real = F.when(F.col("category") != "uncategorized", F.col("category"))
        figures = self.products.groupBy("store_id").agg(
            F.count(F.lit(1)).alias("product_count"), F.min("price_cents").alias("min_price_cents"),
            F.max("price_cents").alias("max_price_cents"), F.round(F.avg("price_cents")).cast("long").alias("avg_price_cents"),
            F.to_date(F.min("published_at")).alias("launch_date"), F.min("first_seen_at").alias("first_seen_at"),
            F.max("last_seen_at").alias("last_crawled_at"), F.min(real).alias("primary_category"),
        )
        return self.base_stores.join(figures, "store_id")

    # --- history, matches, spread ----------------------------------------------
    @cached_property
    def metrics(self) -> DataFrame:
        return backfill_rollup(self.obs)

    @cached_property
    def groups(self) -> DataFrame:
        """Parts listed by several stores: the canonical listing is the smallest id."""
        return self.pairs.groupBy("part_id").agg(
            F.min("product_id").alias("canonical_id"), F.count(F.lit(1)).alias("n")
        ).filter("n > 1").select("part_id", "canonical_id")

    @cached_property
    def pairs(self) -> DataFrame:
        """Ids of all listings without their attributes."""
        pairs = self.items.select("store_id", "part_id").distinct()
        return pairs.withColumn("product_id", F.col("store_id") * 1000000000 + F.col("part_id"))

    @cached_property
    def matches(self) -> DataFrame:
        return self.pairs.join(self.groups, "part_id").select("product_id", "canonical_id", F.lit(0).alias("distance"))

    @cached_property
    def spread(self) -> DataFrame:
        """Month-end snapshots of the stores that listed a group in the month."""
        monthly = self.obs.join(self.groups, "part_id").groupBy(
            "part_id", "canonical_id", F.last_day("observed_on").alias("observed_on"), "store_id"
        ).agg(F.min("price_cents").alias("lo"), F.max("price_cents").alias("hi"))
        # A group is a part: with the part among the keys its rows stay where they are.
        return monthly.groupBy("part_id", "canonical_id", "observed_on").agg(
            F.count(F.lit(1)).alias("store_count"), F.min("lo").alias("min_price_cents"), F.max("hi").alias("max_price_cents")
        ).filter("store_count > 1").drop("part_id")

    @staticmethod
    def _hash():
        bits = F.conv(F.substring(F.md5(F.col("p_name").cast("binary")), 1, 15), 16, 10).cast("long")
        return bits.bitwiseXOR(F.pow(F.lit(2), F.col("part_id") % 40).cast("long") - 1)

    @cached_property
    def hashes(self) -> DataFrame:
        part = self.table("part").withColumnRenamed("p_partkey", "part_id")
        return part.select(F.col("part_id").alias("id"), (F.col("part_id") % 7).alias("store_id"), self._hash().alias("h"))

    @cached_property
    def hashed_products(self) -> DataFrame:
        """One product per part with its image hash and price."""
        part = self.table("part").withColumnRenamed("p_partkey", "part_id")
        return part.select(
            F.col("part_id").alias("product_id"), (F.col("part_id") % 7).alias("store_id"),
            F.lower(F.lpad(F.hex(self._hash()), 16, "0")).alias("image_hash"),
            F.round(F.col("p_retailprice") * 100).cast("long").alias("price_cents"),
        )

    # --- discovery -------------------------------------------------------------
    @cached_property
    def names(self) -> DataFrame:
        """Raw certificate names of page hosts."""
        host = host_of(F.col("url"))
        return self.table("pages").select(
            "page_id", F.explode(F.array(host, F.concat(F.lit("*."), F.upper(host)), F.concat(F.lit("www."), host))).alias("name")
        )

    @cached_property
    def queue(self) -> DataFrame:
        c = F.col("c_custkey")
        status = F.when(c % 5 == 0, "pending").when(c % 5 == 1, "checking").when(c % 5 == 2, "shopify").when(
            c % 5 == 3, "not_shopify").otherwise("error")
        checked = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval((c % 60).cast("int"), F.lit(0), F.lit(30))
        return self.table("customer").select(
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".com")).alias("domain"),
            F.lit("ct_log").alias("source"), status.alias("status"),
            F.when(c % 5 > 1, checked).alias("checked_at"), (c % 3).cast("int").alias("attempts"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        s = F.col("store_id")
        return self.base_stores.select(
            s.alias("id"), F.upper("domain").alias("domain"), F.concat(F.lit("owner@"), "domain").alias("email"),
            F.when(s % 2 == 0, "wrong data").alias("reason"), F.lit("pending").alias("status"),
            F.lit(AS_OF).cast("timestamp").alias("created_at"), "country",
        )

    # --- vectors -----------------------------------------------------------------
    @cached_property
    def exemplars(self) -> DataFrame:
        """Mean vector per (label, strongest block): at most labels x 4 rows whatever the table size."""
        e = self.table("embeddings")
        block = F.floor((F.array_position("embedding", F.array_max("embedding")) - 1) / 16).cast("int")
        cells = e.select(
            F.concat(F.lit("cat_"), F.col("label").cast("string")).alias("category"),
            F.concat(F.lit("block_"), block.cast("string")).alias("niche"), F.posexplode("embedding").alias("pos", "v"),
        )
        means = cells.groupBy("category", "niche", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
        return means.groupBy("category", "niche").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"]).alias("embedding")
        ).select("category", "niche", F.lit(0).alias("example_idx"), "embedding")

    @cached_property
    def vector_parts(self) -> DataFrame:
        """Vectors as weighted votes of twenty stores."""
        v = F.col("vec_id")
        w = F.when(v % 4 == 0, 0.7).when(v % 4 == 1, 0.8).when(v % 4 == 2, 1.4).otherwise(1.0)
        return self.table("embeddings").select(
            v.alias("part_id"), (v % 20).alias("store_id"), "embedding", w.alias("weight")
        )

    # --- wire formats --------------------------------------------------------------
    @cached_property
    def wire(self) -> DataFrame:
        """Listing attributes as the wire shows them: text prices in tenths of a cent, padded text."""
        mills = F.col("price_cents") * 10 + F.col("part_id") % 10
        text = F.concat(F.floor(mills / 1000).cast("string"), F.lit("."), F.lpad((mills % 1000).cast("string"), 3, "0"))
        return self.products.withColumn("mills", mills).withColumn("price_text", text)

    @cached_property
    def catalog_pages(self) -> DataFrame:
        """Catalog documents of at most 250 products each, as JSON text."""
        columns = ["product_id", "part_id", "p_size", "title", "handle", "vendor", "product_type", "published_at", "first_seen_at",
                   "image_url", "price_text"]

        def product(r):
            src = F.struct(r["image_url"].alias("src"))
            return F.struct(
                F.when(r["p_size"] != 13, r["product_id"]).alias("id"),
                F.when(r["p_size"] != 17, F.concat(F.lit("  "), r["title"], F.lit(" "))).otherwise(F.lit("  ")).alias("title"),
                r["handle"].alias("handle"), r["vendor"].alias("vendor"), r["product_type"].alias("product_type"),
                F.concat_ws(", ", r["vendor"], F.lit(""), r["title"]).alias("tags"),
                F.date_format(r["published_at"], "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
                F.date_format(r["first_seen_at"], "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
                F.when(r["part_id"] % 2 == 0, F.array(src)).otherwise(F.array()).alias("images"),
                src.alias("image"),
                F.array(
                    F.struct((r["product_id"] * 2).alias("id"), F.lit("Small").alias("title"), r["price_text"].alias("price"),
                             F.lit("").alias("compare_at_price"), F.lit(True).alias("available")),
                    F.struct((r["product_id"] * 2 + 1).alias("id"), F.lit(" Large ").alias("title"),
                             F.concat(F.lit("9"), r["price_text"]).alias("price"),
                             F.concat(F.lit("10"), r["price_text"]).alias("compare_at_price"), F.lit(None).cast("boolean").alias("available")),
                ).alias("variants"),
            )

        page = F.floor(F.col("part_id") / 250).cast("long")
        # Rows meet as they are; the documents, several times as wide, are made behind the shuffle.
        rows = self.wire.groupBy("store_id", page.alias("page_no")).agg(F.collect_list(F.struct(*columns)).alias("rows"))
        return rows.select("store_id", "page_no", F.to_json(F.struct(F.transform("rows", product).alias("products"))).alias("body"))

    @cached_property
    def sitemap_docs(self) -> DataFrame:
        """Sitemap documents of at most 250 URLs each."""
        url = F.concat(
            F.lit("<url><loc>https://shop.example/products/"), "handle", F.lit("?ref=map</loc>"),
            F.when(F.col("image_url").isNotNull(), F.concat(
                F.lit("<image:image><image:loc>"), "image_url", F.lit("</image:loc><image:title>"), "title",
                F.lit("</image:title></image:image>"))).otherwise(F.lit("")),
            F.lit("</url>"),
        )
        head = ('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" '
                'xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">'
                "<url><loc>https://shop.example/pages/about</loc></url>")
        return self.products.groupBy("store_id", F.floor(F.col("part_id") / 250).alias("page_no")).agg(
            F.concat(F.lit(head), F.array_join(F.collect_list(url), ""), F.lit("</urlset>")).alias("body")
        )

    @cached_property
    def probes(self) -> DataFrame:
        """Recorded probe results of every store."""
        s = F.col("store_id")
        doc = F.to_json(F.struct(
            F.when(s % 11 != 5, s + 7000).alias("id"),
            F.when(s % 7 != 3, F.concat(F.lit("s"), s.cast("string"), F.lit(".platform.example"))).alias("myshopify_domain"),
            F.concat(F.lit(" "), "name", F.lit(" ")).alias("name"), F.col("description"),
            F.when(s % 2 == 0, "us").otherwise(F.col("country")).alias("country"), F.lower("currency").alias("currency"),
        ))
        ips = F.when(s % 4 == 0, F.array().cast("array<string>")).when(
            s % 4 == 1, F.array(F.concat(F.lit("23.227.38."), (s % 250).cast("string")))
        ).otherwise(F.array(F.lit("203.0.113.9")))
        headers = F.when(s % 4 == 2, F.create_map(F.lit("x-shopid"), s.cast("string"))).otherwise(
            F.create_map(F.lit("server"), F.lit("web")))
        return self.base_stores.select(
            "domain", ips.alias("resolved_ips"), headers.alias("headers"),
            F.when(s % 9 == 8, 404).otherwise(200).alias("meta_status"), doc.alias("meta_json"),
            F.concat(F.coalesce("language", F.lit("")), F.lit(", fr")).alias("content_language"),
            (s % 6 != 0).alias("allowed"),
        )
