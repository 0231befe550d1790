"""Readers over files."""
import json
import os

from shelfwatch.plans.categorise import context_parts
from shelfwatch.sources import catalog_json, seeds, sitemap, taxonomy


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_catalog_files(spark, tmp_path):
    good = {"products": [
        {"id": 1, "title": " Mug ", "handle": "mug", "tags": ["a", "b"], "images": [{"src": "i1"}], "image": {"src": "i2"},
         "published_at": None, "created_at": "2024-01-01T00:00:00Z",
         "variants": [{"id": 11, "price": "5.005", "available": None}, {"id": 12, "price": "bad", "compare_at_price": "9"},
                      {"id": "x", "price": "1"}]},
        {"id": "7", "title": "text id", "handle": "x"},
        {"id": 2, "title": "", "handle": "y"}, "junk", 5, None, [1], {"id": 6, "title": 5, "handle": "numeric title"},
        {"id": 8, "title": "Odd parts", "handle": "o", "vendor": 3, "tags": 4, "images": ["i"], "image": {"src": "i8"}, "variants": ["v", {"id": 81, "title": 1, "price": 2.5}]},
        {"id": 3, "title": "No images", "handle": "z", "tags": "p, q", "images": [{}], "image": {"src": "i3"}},
        {"id": 4, "title": "Single", "handle": "s", "images": [], "image": {"src": "i4"}},
    ]}
    write(tmp_path / "c/store_id=5/page_no=1/a.json", json.dumps(good))
    write(tmp_path / "c/store_id=5/page_no=2/a.json", "{broken")
    raw = catalog_json.parse_catalog_pages(catalog_json.read_catalog_json(spark, str(tmp_path / "c")))
    products, variants = catalog_json.normalize_catalog(raw)
    by = {r["source_id"]: r for r in products.collect()}
    assert set(by) == {1, 3, 4, 8}
    assert (by[8]["vendor"], by[8]["tags"], by[8]["image_url"], by[8]["price_cents"]) == (None, [], "i8", 250)
    report = catalog_json.page_report(catalog_json.read_catalog_json(spark, str(tmp_path / "c"))).collect()
    assert [(r["page_no"], r["products"], r["rejected"]) for r in report] == [(1, 7, 4)]
    assert (by[1]["title"], by[1]["tags"], by[1]["image_url"], by[1]["price_cents"], by[1]["compare_at_cents"]) == ("Mug", ["a", "b"], "i1", 500, 900)
    assert by[1]["published_at"].year == 2024
    assert (by[3]["image_url"], by[3]["tags"], by[4]["image_url"]) == (None, ["p", "q"], "i4")
    assert {(r["source_id"], r["price_cents"], r["available"]) for r in variants.collect()} == {(11, 500, None), (12, None, None), (81, 250, None)}


def test_catalog_elements_cost_no_schema(spark):
    """No schema of a whole element is made up, and a list that starts with null gives way to the single image."""
    body = json.dumps({"products": [
        {"id": 1, "title": "A", "handle": "a", "images": [None, {"src": "i1"}], "image": {"src": "i2"}},
        {"id": 2, "title": "B", "handle": "b", "images": [{"src": 5}], "image": {"src": "i2"}, "vendor": {"name": "v"}}]})
    raw = catalog_json.parse_catalog_pages(spark.createDataFrame([(1, 1, body)], "store_id long, page_no long, body string"))
    products, _ = catalog_json.normalize_catalog(raw)
    assert {(r["source_id"], r["image_url"], r["vendor"]) for r in products.collect()} == {(1, "i2", None), (2, None, None)}
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert "schemaofvariant(e#" not in plan.lower().replace("_", "")


def test_sitemap_files(spark, tmp_path):
    doc = """<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">
<url><loc>https://s.com/</loc></url>
<url><loc>https://s.com/products/no-image</loc></url>
<url><loc>https://s.com/products/blue-shirt?x=1</loc><image:image><image:loc>https://i/1.jpg</image:loc><image:title><![CDATA[Blue & Shirt]]></image:title></image:image></url>
</urlset>"""
    write(tmp_path / "m/store_id=3/a.xml", doc)
    want = {(3, "no-image", "no image", None), (3, "blue-shirt", "Blue & Shirt", "https://i/1.jpg")}
    read = sitemap.sitemap_products(sitemap.read_sitemap(spark, str(tmp_path / "m")))
    assert {tuple(r) for r in read.select("store_id", "handle", "title", "image_url").collect()} == want
    parsed = sitemap.sitemap_products(sitemap.parse_sitemap(spark.createDataFrame([(3, doc)], "store_id long, body string")))
    assert {tuple(r) for r in parsed.select("store_id", "handle", "title", "image_url").collect()} == want
    assert parsed.filter("handle = 'blue-shirt'").first()["source_id"] == -225335211236040


def test_seed_file(spark, tmp_path):
    write(tmp_path / "seed.txt", "Example.com\n\n www.example.com \nnot a domain\nmail.example.com\n")
    assert [tuple(r) for r in seeds.read_seed(spark, str(tmp_path / "seed.txt")).collect()] == [("example.com", "manual", "pending")]


def test_taxonomy_file(spark, tmp_path):
    write(tmp_path / "t.json", json.dumps({"category": "Pets", "niche": "Cats", "titles": ["Cat Bed"]}))
    got = taxonomy.exemplar_rows(taxonomy.read_taxonomy(spark, str(tmp_path / "t.json"))).orderBy("example_idx").collect()
    assert [r["example_text"] for r in got] == ["Pets. Cats", "Cats", "Cat Bed"]


def test_context_parts(spark):
    stores = spark.createDataFrame([(1, " Shop ", None)], "store_id long, name string, description string")
    types = spark.createDataFrame([(1, "Misc", 9), (1, "Shoes", 400), (1, "Hats", 100)], "store_id long, product_type string, c long")
    titles = spark.createDataFrame([(1, " "), (1, "Red hat")], "store_id long, title string")
    got = {(r["text"], round(r["weight"], 6)) for r in context_parts(stores, types, titles).collect()}
    assert got == {("Shop", 0.7), ("Shoes", 2.8), ("Hats", 2.1), ("Red hat", 1.0)}


def test_page_bundles(spark, tmp_path):
    """Many pages a file; documents come back as they were, broken, empty and odd ones too."""
    rows = [(s, n, body) for s in range(30) for n, body in enumerate(['{"products": [{"id": 1, "title": "a\\n\u00df\u2028", "handle": "h"}]}', "{broken\r\n", "", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16"), None])]
    pages = spark.createDataFrame(rows, catalog_json.BUNDLE).repartition(2)
    path = tmp_path / "bundles"
    catalog_json.write_page_bundles(pages, str(path))
    assert len(list(path.glob("*.json"))) == 2
    assert {tuple(r) for r in catalog_json.read_page_bundles(spark, str(path)).select("store_id", "page_no", "body").collect()} == set(rows)
    products, _ = catalog_json.normalize_catalog(catalog_json.parse_catalog_pages(catalog_json.read_page_bundles(spark, str(path))))
    assert products.count() == 30


def test_recorded_pages_take_a_small_part_of_their_length(spark):
    from urllib.parse import urlsplit

    from pyspark.sql import functions as F

    from checks.q_sources import _spoilt_files
    from checks.views import Views

    pages = _spoilt_files(Views(spark, "/root/testdata/sf0.001"))
    stored = sum(os.path.getsize(urlsplit(name).path) for name in pages.inputFiles())
    assert 3 * stored < pages.agg(F.sum(F.length("body")).alias("n")).first()["n"]


def test_compressed_page_bundles(spark, tmp_path):
    rows = [(s, n, body) for s in range(30) for n, body in enumerate(['{"products": [{"id": 1}]}', "{broken\r\n", "", "\u2028", None])]
    catalog_json.write_page_bundles(spark.createDataFrame(rows, catalog_json.BUNDLE).repartition(2), str(tmp_path / "pages"), "gzip")
    assert sorted(map(tuple, catalog_json.read_page_bundles(spark, str(tmp_path / "pages")).collect()), key=repr) == sorted(rows, key=repr)


def test_documents_are_made_behind_the_shuffle(spark):
    from checks.views import Views

    plan = Views(spark, "/root/testdata/sf0.001").catalog_pages._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "partial_collect_list" in line]
    assert sent and not any("compare_at_price" in line for line in sent)
