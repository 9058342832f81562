"""Captured sites: extraction by tiers, page accounts, feeds in columns, selector schemas, discovery strategies, sinks and the commands."""

import json

import pytest

from stockroom import cli
from stockroom.operators import analyze, discover, extract
from stockroom.sources import export, html as H, payloads as P
from stockroom.sources.captures import Captures


def test_page_accounts(spark):
    full = json.dumps([{}] * 100)
    pages = [("a", 1, 200, full), ("a", 2, 200, "[{}]"), ("b", 1, 200, full), ("b", 2, 429, None), ("c", 1, 500, ""), ("d", 1, 200, full), ("e", 1, 200, "[]"), ("f", 1, 200, "{}"), ("g", 2, 200, "[]"), ("a", 2, 500, "again")]
    got = {r.site: (r.pages_completed, r.records, r.complete, r.error) for r in P.page_account(spark.createDataFrame(pages, "site string, page_no int, http_status int, body string"), "woocommerce").collect()}
    assert got["a"][:2] == (2, 101) and got["b"] == (1, 100, False, "HTTP 429") and got["c"] == (0, 0, False, "HTTP 500") and got["d"] == (1, 100, False, None) and got["e"] == (1, 0, True, None)
    assert got["f"] == (0, 0, False, "unreadable page") and got["g"][:2] == (0, 0)
    assert P.page_account(spark.createDataFrame([], "site string, page_no int, http_status int, body string"), "magento").count() == 0


def test_feeds_in_columns(spark):
    feeds = [(1, "id\ttitle\tprice\n1\t A \t5.00 EUR\n2\t\t1\n", None), (2, 'id,title,price,additional_image_link\n3,"B, b",7,"u, v,"\n', "text/csv"), (3, "<rss><channel><item><title>C</title><id>4</id></item></channel></rss>", "text/xml"), (4, None, None), (5, "", "text/csv"), (6, "<rss><broken", "text/xml")]
    rows = P.feed_items(spark.createDataFrame(feeds, "n int, body string, content_type string")).selectExpr("n", "try_variant_get(raw, '$.title', 'string') t", "try_variant_get(raw, '$.currency', 'string') c", "size(try_variant_get(raw, '$.additional_image_link', 'array<string>')) k").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "A", "EUR", 0), (2, "B, b", "", 2), (3, "C", "", 0)]


def test_selector_schemas(spark):
    page = """<ul class='list'><li class="card x" data-id="7"><a href="/p/7"><b>One</b> two</a><span class=price>$1</span><div class="card"><a href="/p/8">in</a></div></li><li>no</li></ul><div class=card></div>"""
    schema = {"baseSelector": "ul.list .card, p#one", "fields": [{"name": "title", "selector": "a", "type": "text"}, {"name": "link", "selector": "a[href^='/p']", "type": "attribute", "attribute": "href"}, {"name": "price", "selector": "span.price, [itemprop=price]", "type": "text"}]}
    rows = H.css_select(spark.createDataFrame([(1, page), (2, None), (3, "<p id=one><a>x")], "n int, html string"), schema).selectExpr("n", "pos", "to_json(raw) j").collect()
    assert sorted((r.n, r.pos, tuple(sorted(json.loads(r.j).items()))) for r in rows) == [(1, 0, (("link", "/p/7"), ("price", "$1"), ("title", "One two"))), (1, 1, (("link", "/p/8"), ("title", "in"))), (3, 0, (("title", "x"),))]
    with pytest.raises(ValueError):
        H.selector("a > b")
    with pytest.raises(ValueError):
        H.selector(" ")


def test_layers_use_metadata_and_pictures(spark):
    rows = [
        (1, "<script type='application/ld+json'>{\"@type\":\"Product\",\"name\":\"A\",\"offers\":{\"price\":0}}</script><meta property='product:price:amount' content='7'>", None, [("", 9), ("i1", 1), ("i2", 5)]),
        (2, "<meta property='og:type' content='product'><meta property='og:title' content='page'>", {"og:title": "crawl", "og:image": "", "x": "y"}, None),
        (3, "<p>", None, [("i", None)]), (4, None, {}, []),
    ]
    parts = H.page_parts(spark.createDataFrame(rows, "page_id int, html string, metadata map<string,string>, images array<struct<src:string,score:int>>"))
    got = {r.page_id: (r.name, r.price, r.image, r.layer) for r in H.layered(parts).collect()}
    assert got == {1: ("A", "7", "i2", "json_ld"), 2: ("crawl", None, None, "opengraph")}
    assert [r.page_id for r in H.has_price_and_image(H.layered(parts)).collect()] == [1]


def captures(spark, folder):
    offer = '<script type="application/ld+json">{"@type":"Product","name":"%s","sku":"k","image":"https://i/x","description":"d","brand":{"name":"M"},"offers":{"price":%s,"priceCurrency":"EUR"}}</script>'
    write = lambda kind, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{kind}.parquet")
    write("pages", [("b.example", "https://b.example/p/1", offer % ("Blue Lamp", 5)), ("b.example", "https://b.example/p/2", offer % ("Red Lamp", 7)), ("c.example", "https://c.example/", "<p>nothing")], "site string, url string, html string")
    write("api_pages", [("a.example", json.dumps({"products": [{"id": 1, "title": "Blue Lamp", "handle": "bl", "vendor": "M", "variants": [{"price": "4.00", "sku": "s"}], "images": [{"src": "https://i/y"}]}]}), 200)], "site string, body string, http_status int")
    write("probes", [("a.example", "/products.json", 200, '{"products":[]}')], "site string, path string, status int, body string")
    write("sitemaps", [("a.example", "/sitemap_products_1.xml", "<urlset><url><loc>https://a.example/products/bl</loc></url><url><loc>https://a.example/cart</loc></url></urlset>")], "site string, path string, body string")
    write("links", [("b.example", "https://b.example/", "https://b.example/p/1")], "site string, source string, target string")


def test_commands(spark, tmp_path, capsys):
    folder, store = str(tmp_path / "captures"), str(tmp_path / "store")
    captures(spark, folder)

    def say(*argv):
        assert cli.main(list(argv)) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    rows = say("extract", "a.example", "--captures", folder)
    assert [(r["title"], r["tier"], r["platform"], r["price"]) for r in rows] == [("Blue Lamp", "api", "shopify", "4.0000000000")]
    assert say("detect", "a.example", "--captures", folder)[0]["platform"] == "shopify"
    assert [r["url"] for r in say("discover", "a.example", "--captures", folder)] == ["https://a.example/products/bl"]
    assert [(r["url"], r["strategy"]) for r in say("discover", "b.example", "--captures", folder)] == [("https://b.example/p/1", "crawl")]
    found = say("compare", "blue lamp", "-s", "a.example", "-s", "b.example", "--captures", folder)
    assert [r["store"] for r in found[:2]] == ["a.example", "b.example"] and found[-1]["matches"] >= 2
    say("snapshot", "b.example", "--captures", folder, "--store", store)
    assert say("changes", "b.example", "--store", store) == []
    assert len(say("history", "b.example", " red lamp ", "--store", store)) == 1
    stats = say("analyze", "b.example", "--captures", folder)
    assert stats[0]["total"] == 2 and stats[1] == {"value": "M", "n": 2, "first_idx": stats[1]["first_idx"]}
    out = str(tmp_path / "out")
    say("extract", "b.example", "--captures", folder, "-o", out)
    read = P.json_file(spark, out).selectExpr("try_variant_get(raw, '$.title', 'string') t").collect()
    assert sorted(r.t for r in read) == ["Blue Lamp", "Red Lamp"]
    (tmp_path / "p.json").write_text('[{"title": "A", "price": "1", "image_url": "i", "product_url": "u"}, {"price": "-1"}]')
    report = say("validate", str(tmp_path / "p.json"), "-m", "ebay")
    assert report[0]["total"] == 2 and report[0]["invalid"] == 2 and any(r.get("field") == "title" for r in report[1:])
    assert cli.main(["detect", "a.example", "--captures", str(tmp_path / "none")]) == 1


def test_single_pages_and_outside_readers(spark, tmp_path):
    captures(spark, str(tmp_path))
    pages = Captures(spark, str(tmp_path)).get("pages")
    assert [r.title for r in extract.extract_one(pages, "https://b.example/p/2").collect()] == ["Red Lamp"] and extract.extract_one(pages, "https://c.example/").count() == 0
    read = extract.by_batches(pages, lambda rows: ({"url": r["url"], "title": "?"} for r in rows), "url string, title string")
    assert read.count() == 3 and {r.title for r in read.collect()} == {"?"}
    with pytest.raises(ValueError):
        extract.tiered({})
    assert extract.tiered({"api": extract.from_api(spark.createDataFrame([], "site string, platform string, body string"))}).count() == 0


def test_strategies_without_anything(spark):
    sites = spark.createDataFrame([("a", "generic")], "site string, platform string")
    assert discover.strategies(sites, spark.createDataFrame([("a", "/sitemap.xml", "<bad"), ("b", "/sitemap.xml", None)], "site string, path string, body string")).count() == 0


def test_files_are_whole(spark, tmp_path):
    df = spark.createDataFrame([(i, f"Ä {i} & <b>", None, "x") for i in range(5)], "id int, title string, price string, external_id string").repartition(3)
    export.to_json(df, str(tmp_path / "j"), array=True)
    lists = [json.loads(f.read_text()) for f in (tmp_path / "j").glob("part-*")]
    assert sorted(r["id"] for x in lists for r in x) == list(range(5)) and all(r["price"] is None for x in lists for r in x)
    export.to_json(df.limit(0), str(tmp_path / "e"), array=True)
    assert all(json.loads(f.read_text()) == [] for f in (tmp_path / "e").glob("part-*"))
    export.to_feed(df, str(tmp_path / "f"), "google_shopping", single=True)
    (one,) = (tmp_path / "f").glob("part-*")
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(one.read_text()).findall(".//item")) == 5
    assert list(export.to_frame(df.orderBy("id")).id) == list(range(5))


def test_top(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 3)], "g string, n int")
    assert [r.n for r in analyze.top(df, 1, "n").collect()] == [1] and sorted((r.g, r.n) for r in analyze.top(df, 1, "n", by=("g",)).collect()) == [("a", 1), ("b", 3)]
