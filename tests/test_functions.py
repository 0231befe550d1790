"""Literal cases of the column functions."""
import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import bits, catalog, domains, policy, titles


def run(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_domains(spark):
    cases = {
        "*.Example.com": "example.com", "www.shop.co.uk.": "shop.co.uk", "store.example.com": "store.example.com",
        "a.b.example.com": None, "mail.example.com": None, "mail.com": "mail.com", "foo.herokuapp.com": None,
        "xn--abc.com": None, "agency.gov.uk": None, "school.edu": None, "www.co.uk": "co.uk", "müller.de": "müller.de",
        "a_b.com": None, "localhost": None, "1.2.3.4": None, "a..b.com": None, "": None, None: None, " www.com": None,
        "x.storage.googleapis.com": None, "shop.example.com.au": "shop.example.com.au", "api.example.com.au": None,
        "a" * 64 + ".com": None, ".example.com": None, "example.com/": None, "*.": None, "example.c": None,
    }
    assert run(spark, domains.normalize_domain, list(cases)) == list(cases.values())


def test_cents(spark):
    cases = {"19.99": 1999, "19.985": 1998, "19.995": 2000, "1e2": 10000, "19,99": None, "-1": None, "100000001": None,
             "100000000": 10000000000, "": None, "NaN": None, None: None, "0": 0}
    assert run(spark, catalog.to_cents, list(cases)) == list(cases.values())


def test_titles(spark):
    cases = {"Rug 70x50 cm red": "Rug red", "bag 22 kg": "bag", "42 mm lens": "lens", "250ml bottle": "bottle",
             "Casio MTP-E510D-7AVDF": "Casio", "R8853100014 x": "x", "MK5735 watch": "watch", "MK57 watch": "MK57 watch",
             None: "", "a -- b": "a b"}
    assert run(spark, titles.clean_title, list(cases)) == list(cases.values())


def test_embedding_text(spark):
    rows = [
        ("Blue Shirt", "Shirts", ["acme", "shirts", "Cotton", "cotton"], "Acme", "Shirts. Blue Shirt. Cotton"),
        ("22 kg", None, None, None, "22 kg"),
        ("Mug", "mug", ["a", "b", "c", "d", "e", "f", "g"], "", "mug. a. b. c. d. e. f"),
        (None, None, [" x "], None, "x"),
    ]
    df = spark.createDataFrame(rows, "t string, k string, g array<string>, v string, want string")
    out = df.select(titles.embedding_text(F.col("t"), F.col("k"), F.col("g"), F.col("v")), "want").collect()
    assert all(r[0] == r[1] for r in out), out


def test_ids_and_handles(spark):
    assert run(spark, catalog.stable_id, ["blue-shirt"]) == [-225335211236040]
    assert run(spark, catalog.handle_from_url, ["https://x.com/products/a-b/?x=1", "https://x.com/pages/a", "https://x.com/products/"]) == ["a-b", None, None]


def test_tags(spark):
    assert run(spark, catalog.parse_tags, ["a, b,,c", '["x", "y z"]', None, "[sale, new"]) == [
        ["a", "b", "c"], ["x", "y z"], [], ["[sale", "new"]]
    assert len(run(spark, catalog.parse_tags, [",".join("t%d" % i for i in range(60))])[0]) == 40


def test_hashes(spark):
    assert run(spark, bits.hash_to_long, ["ffffffffffffffff", "8000000000000001", "00", "zz00000000000000"]) == [
        -1, -9223372036854775807, None, None]


def test_discount(spark):
    df = spark.createDataFrame([(75, 100), (100, 100), (100, None), (0, 10)], "p long, c long")
    assert [r[0] for r in df.select(policy.discount_percent(F.col("p"), F.col("c"))).collect()] == [25, None, None, 100]


def test_priority(spark):
    df = spark.createDataFrame(
        [("2024-05-20", 5, 9), ("2023-01-01", 10, 9), ("2023-01-01", 0, 9), ("2023-01-01", 5, 9)], "f string, n long, o long")
    got = df.select(policy.crawl_priority(F.col("f").cast("timestamp"), F.col("n"), F.col("o"), "2024-06-01")).collect()
    assert [r[0] for r in got] == [1, 1, 5, 3]


def test_cursor(spark):
    df = spark.createDataFrame([(123, 45), (-5, 9)], "s long, i long")
    c = policy.encode_cursor(F.col("s"), F.col("i"))
    assert df.select(c).first()[0] == "MTIzOjQ1"
    assert [r[0] for r in df.select(policy.decode_cursor(c)["score"]).collect()] == [123, -5]
    assert run(spark, policy.decode_cursor, ["zzz!", "YWJj", "", "not-a-cursor"]) == [None] * 4


@pytest.mark.parametrize("text,want", [("2024-01-02T03:04:05Z", 1704164645), ("2024-01-02T03:04:05+01:00", 1704161045), ("soon", None), ("2024", None)])
def test_parse_ts(spark, text, want):
    assert run(spark, lambda c: F.unix_seconds(catalog.parse_ts(c)), [text]) == [want]


def test_document_cleaning_sql_knows_every_script(spark, tmp_path):
    """The SQL and the query agree where letters, digits and spaces beyond ASCII meet a pattern."""
    import duckdb

    from checks.all import QUERIES, SQL
    from checks.views import Views

    texts = ["212.161 in\u00dflich", "\u00df5 cm", "5\u00a0cm x", "\u0663 cm b", "a \u0663\u0664x7 mm", "7 cm\u00e9", '5"\u00e9t', "ABC12\u00e9", "\u00c9ABC12",
             "ABC12\u0663", "ABC12-\u00e9", "e\u0301 5 m", "5 m\u0301", "\u2003x\u2003", "x\u2028", "a\u00a0,\u00a0b", "snake_5 cm", "\u5b575 cm", "3\u00d74 cm",
             "\u203f5 cm", "\u24b65 cm", "\u00bd5 cm", "x y", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = tmp_path / "d"
    rows.select("doc_id", "text", *[F.lit(None).cast(k).alias(c) for c, k in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]).coalesce(1).write.parquet(str(folder / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in QUERIES["n2_clean_documents"](Views(spark, str(folder))).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = dict(con.execute(SQL["n2_clean_documents"]).fetchall())
    assert {i: (texts[i], got[i], want[i]) for i in got if got[i] != want[i]} == {}
    assert got[0] == "212.161 in\u00dflich" and got[2] == "x"
