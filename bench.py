"""Time the headline queries; prints one JSON line."""
from __future__ import annotations

import json
import os
import time

from checks.all import QUERIES
from checks.views import Views
from shelfwatch.session import cut_lineage, local_session

HEADLINE = [
    "q5_backfill_rollup", "q5_daily_rollup", "q5_daily_from_latest", "a3_price_changes", "j4_latest_prior",
    "j8_hamming_pairs", "q1_components", "q2_match_products", "q6_spread_job",
    "j5_nearest_exemplar", "q3_assign_category", "a13_vote_category", "a12_primary_category",
    "q9_products_page", "q9_feed_page", "q9_stores_page", "a7_facets", "a8_global_stats", "p5_product_details",
    "w2_upsert_products", "w5_refresh_stores", "q7_normalize_products", "x1_normalize_domain", "x11_embedding_text",
    "n2_clean_documents",
]


# In an order in which each derives from those before.
STORED = [
    "obs", "products", "variants", "base_stores", "stores", "metrics", "pairs", "groups", "matches", "spread", "hashes",
    "hashed_products", "names", "exemplars", "vector_parts", "wire", "catalog_pages",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "16g", "bench")
    views = Views(spark, folder)
    # The tables that queries start from are stored first: the clock runs for the queries alone.
    for name in STORED:
        views.__dict__[name] = cut_lineage(getattr(views, name))
    QUERIES["s1_table_scan"](views).collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](views).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
