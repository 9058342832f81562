"""Each operator on small fixtures with nulls, blanks, ties, repeats and empty tables."""

import json
import os
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from stockroom.functions import text as X
from stockroom.operators import analyze, dedupe, discover, match, monitor, normalize as N, validate
from stockroom.sources import export, html as H, payloads as P
from stockroom.streaming import watch

CATALOG = "idx long, title string, price string, currency string, image_url string, product_url string, vendor string, gtin string, sku string, description string, in_stock boolean, category_path array<string>, additional_images array<string>, product_type string, store string"


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [
        (0, "A", "10.00", "USD", "i", "u", "BrandX", "4006381333931", "s0", "d", True, ["Home", "Bath"], None, "Towel", "x"),
        (1, "B", "20.00", "USD", "i", "u", " BrandX ", None, "s1", "", False, None, ["j"], "Towel", "x"),
        (2, "C", "abc", "EUR", None, "u", "BrandY", "", None, None, None, [], None, None, "y"),
        (3, None, None, None, " ", None, " ", None, None, None, None, None, [], "", "y"), (4, "A", "-3", "USD", "i", "u", None, "4006381333931 ", "s0", "d", True, None, None, "Mat", "x"),
    ]
    return spark.createDataFrame(rows, CATALOG)


def test_statistics(catalog):
    r = analyze.catalog_stats(catalog).collect()[0]
    assert (r.total, r.in_stock, r.out_of_stock, r.has_images, r.has_gtin) == (5, 4, 1, 3, 2) and (r.price_min, r.price_max, r.price_avg, r.price_median) == (10, 20, 15, 15)
    assert {(x.value, x.n) for x in analyze.count_field(catalog, "vendor").collect()} == {("BrandX", 2), ("BrandY", 1)}
    assert {(x.value, x.n) for x in analyze.count_categories(catalog).collect()} == {("Home", 1), ("Bath", 1), ("Towel", 2), ("Mat", 1)}
    assert {x.bucket: x.n for x in analyze.price_distribution(catalog, (0, 10, 20)).collect()} == {"0-10": 0, "10-20": 1, "20+": 1}
    assert {x.value: float(x.share) for x in analyze.brand_breakdown(catalog).collect()} == {"BrandX": 66.67, "BrandY": 33.33}
    assert [float(x.quality) for x in analyze.quality(catalog).orderBy("idx").collect()] == [1.0, 0.85, 0.4, 0.0, 0.85]


def test_statistics_of_nothing(catalog):
    r = analyze.catalog_stats(catalog.limit(0)).collect()[0]
    assert r.total == 0 and r.price_avg == 0 and r.completeness == 0 and float(analyze.batch_quality(catalog.limit(0)).collect()[0].quality) == 0
    assert analyze.outliers(catalog.limit(0)).count() == 0 and validate.report(catalog.limit(0), "ebay").collect()[0].pass_rate == 0


def test_outliers(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(["10", "50", "55", "48", "52", "500"])], "idx long, price string")
    assert [r.idx for r in analyze.outliers(df).collect()] == [5] and analyze.outliers(df.where("idx = 1")).count() == 0
    assert analyze.outliers(spark.createDataFrame([(i, "7") for i in range(4)], "idx long, price string")).count() == 0


def test_validation(catalog, spark):
    with pytest.raises(ValueError):
        validate.issues(catalog, "nowhere")
    found = {(r.idx, r.field, r.severity) for r in validate.issues(catalog, "google_shopping").collect()}
    assert (3, "title", "error") in found and (4, "price", "error") in found and (1, "gtin", "warning") in found and (0, "gtin", "warning") not in found
    assert all((i, "brand", "error") in {(r.idx, r.field, r.severity) for r in validate.issues(catalog, "amazon").collect()} for i in range(5))
    assert (0, "brand") not in {(r.idx, r.field) for r in validate.issues(catalog, "amazon", vendor_is_brand=True).collect()}
    assert validate.report(catalog, "google_shopping").collect()[0].invalid == 3
    assert [(r.idx_a, r.idx_b) for r in validate.exact_duplicates(catalog, "gtin").collect()] == [(0, 4)]
    responses = spark.createDataFrame([("i", 404, "image/png", None)], "image_url string, status int, content_type string, failure string")
    assert {r.idx: r.error for r in validate.image_issues(catalog, responses).collect()} == {0: "HTTP 404", 1: "HTTP 404", 4: "HTTP 404", 2: "no image address", 3: "no image address"}


def plain_greedy(a, b, t):
    used, out = set(), set()
    for i, x in a:
        best, at = 0.0, None
        for j, y in b:
            s = SequenceMatcher(None, x.lower().strip(), y.lower().strip()).ratio()
            if j not in used and s > best:
                best, at = s, j
        if at is not None and best >= t:
            used.add(at)
            out.add((i, at))
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_fuzzy_match_equals_the_plain_loop(spark, threshold):
    import random

    rnd = random.Random(2)
    words = ["blue", "red", "widget", "gear", "pro", "max", "x1", "mini"]
    a = [(i, " ".join(rnd.choices(words, k=3)) + " " * (i % 2)) for i in range(60)] + [(60, ""), (61, "long " * 80)]
    b = [(i, " ".join(rnd.choices(words, k=3)).upper()) for i in range(50)] + [(50, " "), (51, "red gear")]
    da, db = (spark.createDataFrame([(i, t, "5" if i % 2 else "7") for i, t in rows], "idx long, title string, price string") for rows in (a, b))
    assert {(r.a, r.b) for r in match.fuzzy_match(da, db, threshold).collect()} == plain_greedy(a, b, threshold)
    diff = match.catalog_diff(da, db, threshold).collect()
    assert sum(r.side == "both" for r in diff) + sum(r.side == "only_a" for r in diff) == len(a) and sum(r.side != "only_a" for r in diff) == len(b)
    assert match.fuzzy_match(da.limit(0), db, threshold).count() == 0


def test_fuzzy_match_of_many_equal_titles(spark):
    """A title that most rows have is matched to the end, its rows beside similar titles as in the plain loop."""
    titles = lambda k, n: [(i, "blue gear 1" if i % 3 else f"blue gear {i % k}") for i in range(n)]
    a, b = titles(7, 240), titles(5, 180)
    frame = lambda rows: spark.createDataFrame(rows, "idx long, title string")
    assert {(r.a, r.b) for r in match.fuzzy_match(frame(a), frame(b), 0.8).collect()} == plain_greedy(a, b, 0.8)
    same = spark.range(30_000).selectExpr("id as idx", "'Blue Gear' as title")
    found = match.fuzzy_match(same, same, 0.9)
    assert found.count() == 30_000 and found.where("a <> b or sim <> 1").count() == 0


def test_the_two_catalogues_hold_all_rows(spark, sf):
    from stockroom.plans import market

    a, b = market._two_catalogs(spark, sf)
    assert sorted(r.idx for r in a.union(b).select("idx").collect()) == sorted(r.idx for r in market.catalog(spark, sf).select("idx").collect())


def test_best_competitors_and_identifiers(spark):
    mine = spark.createDataFrame([(1, "Blue Widget Pro"), (2, None)], "idx long, title string")
    others = spark.createDataFrame([(7, "s", "0", "blue widget pro"), (8, "s", "9", "Blue Widget Max"), (9, "t", "4", "blue widget pro"), (10, "t", "5", "blue widget pro")], "idx long, store string, price string, title string")
    assert [(r.idx, r.store, r.competitor) for r in match.best_competitors(mine, others).collect()] == [(1, "t", 9)]
    ids = spark.createDataFrame([(1, "12 ", None), (2, "", "12"), (3, None, "")], "idx long, gtin string, sku string")
    assert {r.idx for r in match.match_identifiers(ids, spark.createDataFrame([(" 12",), ("",)], "wanted_id string")).collect()} == {1, 2}


def rows_of_joins(plan):
    """The rows that each join of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if kind.endswith("JoinExec") else []
    return own + [n for p in inner + children for n in rows_of_joins(p)]


def test_competitors_of_common_titles_do_not_meet_one_by_one(spark):
    """300 own rows and 300 offers of one title: each own row meets the store's first offer, not all of them; the results are those of a plain loop."""
    mine = spark.createDataFrame([(i, "Blue Widget Pro" if i % 2 else "Blue Widget Max") for i in range(300)] + [(0, "Red Gadget")], "idx long, title string")
    rows = [(1000 + i, "st"[i % 2], str(i % 5), ("blue widget pro", "Blue widget Mox")[i % 3 == 0]) for i in range(300)] + [(1, "u", "7", "red gadget"), (None, "v", "8", "red gadget"), (3, "w", None, "red gadget")]
    others = spark.createDataFrame(rows, "idx long, store string, price string, title string")
    want = {}
    for i, t in [tuple(r) for r in mine.collect()]:
        for c, store, price, title in rows:
            sim = match.ratio(t.lower(), title.lower())
            if sim >= 0.8:
                want[i, store] = max(want.get((i, store), ((-1,),)), ((sim, c is not None, -(c or 0)), c, float(price or 0)))
    found = match.best_competitors(mine, others, 0.8)
    got = {(r.idx, r.store): (r.competitor, float(r.competitor_price), r.sim) for r in found.collect()}
    assert got == {k: (c, p, o[0]) for k, (o, c, p) in want.items() if p > 0} and (0, "v") in got
    assert max(rows_of_joins(found._jdf.queryExecution().executedPlan())) <= 3 * 301  # stores that an own row meets


def test_changes_history_and_alerts(spark):
    rows = spark.createDataFrame([("d", 1, 1, "A", "10"), ("d", 1, 2, "B", "5"), ("d", 2, 1, " a ", "15"), ("d", 2, 2, "a", "12"), ("d", 2, 3, "C", None), ("e", 1, 1, "x", "1")], "domain string, taken_at int, idx long, title string, price string")
    found = monitor.changes(rows)
    assert {(r.domain, r.title_key, r.change) for r in found.collect()} == {("d", "a", "price_change"), ("d", "b", "removed"), ("d", "c", "new")}
    assert [float(r.price) for r in monitor.price_history(rows, "A").orderBy("taken_at").collect()] == [10, 12]
    assert [r.rule for r in monitor.alerts(found, [("up", "d", "A", "new_price > old_price"), ("no", "e", None, "true")]).collect()] == ["up"]
    assert monitor.changes(rows.limit(0)).count() == 0


def test_values(spark):
    urls = {"https://a.com/blog": True, "https://a.com/x/cart/y": True, "https://a.com/p.JSON": True, "https://a.com/2024/01/02/x": True, "https://a.com/products/a b": False, "https://a.com": True, "a.com/x": False, "": True, "https://a.com/about;v=1?x": True}
    df = spark.createDataFrame([(u, w) for u, w in urls.items()], "u string, w boolean")
    assert all(r.w == r.g for r in df.select("w", discover.is_non_product("u").alias("g")).collect())
    v = spark.sql("select '1,299.00 EUR' a, '29,99' b, 'EUR 19.99' c, cast(null as string) d, '\\t x\\u00a0' e").select(*[X.price_string(c).alias(c) for c in "abcd"], X.stripped("e").alias("e"), X.money("c").alias("m")).collect()[0]
    assert (v.a.amount, v.a.currency) == ("1299.00", "EUR") and v.b.amount == "29.99" and v.c.amount == "EUR" and v.d.amount == "" and v.e == "x" and v.m == 0
    texts = ["was $9.99\nnow €1.299,00", "XYZ 5.00", "EUR 12.50", None, "total $5", "1299.99 kr", "costs\n$ 7", "GBP 0 then USD 3,50", "12 EUR"]
    got = {r.t: (r.p.price, r.p.currency) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.text_price("t").alias("p")).collect()}
    assert [got[t] for t in texts] == [("1299.00", "EUR"), ("5.00", None), ("12.50", "EUR"), (None, None), (None, None), ("1299.99", "SEK"), ("7.00", "USD"), ("3.50", "USD"), ("12.00", "EUR")]


def raws(spark, *cases):
    return spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, b string").select("i", F.try_parse_json("b").alias("raw"), F.lit("https://s/").alias("shop"))


def test_dialects(spark):
    shop = {"id": 1, "title": " T ", "body_html": "<p>x</p>", "handle": "h", "tags": "a, b,", "product_type": "K", "variants": [{"id": 5, "price": "9.50", "compare_at_price": "12", "sku": "q", "barcode": "400-638133393 1", "inventory_quantity": 0}, {"id": 6, "price": "bad"}], "images": [{"src": "u"}, {"src": "w"}]}
    r = N.normalize(raws(spark, shop, {"title": ""}, {"title": "only"}), "shopify").collect()
    assert len(r) == 1 and (r[0].title, float(r[0].price), r[0].gtin, r[0].in_stock, r[0].tags, r[0].additional_images, r[0].product_url, len(r[0].variants)) == ("T", 9.5, "4006381333931", True, ["a", "b"], ["w"], "https://s/products/h", 1)
    woo = {"id": 2, "name": "W", "prices": {"price": "899", "regular_price": "1099", "currency_minor_unit": 2}, "tags": [{"name": "t"}], "categories": [{"name": "c"}]}
    w = N.normalize(raws(spark, woo, {"name": "adm", "price": "5.5"}), "woocommerce").orderBy("i").collect()
    assert (float(w[0].price), float(w[0].compare_at_price), w[0].tags, w[0].category_path) == (8.99, 10.99, ["t"], ["c"]) and float(w[1].price) == 5.5
    g = N.normalize(raws(spark, {"@type": ["Product"], "name": "L", "offers": {"price": 3, "itemCondition": "x/RefurbishedCondition"}, "brand": "B"}, [], 5, None)).collect()
    assert [(x.title, x.condition, x.vendor) for x in g] == [("L", "REFURBISHED", "B")]
    with pytest.raises(ValueError):
        N.normalize(raws(spark, {}), "nowhere")


def test_html_layers(spark):
    ld = '<script type="application/ld+json">{"@type":"ProductGroup","name":"G","review":{"author":"x"},"hasVariant":[{"offers":{"price":"0"}},{"offers":[{"price":"7"}]}]}</script><script type="application/ld+json">bad</script>'
    pages = spark.createDataFrame([(1, f"<html>{ld}<meta property=og:image content=pic></html>"), (2, "<meta property='product:price:amount' content='4'><meta property='og:title' content='Caf&eacute;'>"), (3, None), (4, "<p>")], "page_id long, html string")
    parts = H.page_parts(pages)
    raw = [json.loads(r.j) for r in H.json_ld(parts).select(F.to_json("raw").alias("j")).collect()]
    assert len(raw) == 1 and "review" not in raw[0] and raw[0]["offers"]["price"] == "7"
    rows = {r.page_id: r for r in H.layered(parts).collect()}
    assert set(rows) == {1, 2} and (rows[1].price, rows[1].image) == ("7", "pic") and (rows[2].name, rows[2].price, rows[2].layer) == ("Café", "4", "opengraph")
    images = spark.sql("select array(struct('a' as src, 1 as score), struct('b' as src, 4 as score), struct('c' as src, 4 as score)) i, map('og:title','m','x','y') m, map('og:title','p','og:url','u') p")
    r = images.select(H.best_image("i").alias("b"), H.merged_og("m", "p").alias("og")).collect()[0]
    assert r.b == "b" and r.og == {"og:title": "m", "og:url": "u"}


def test_merging_and_detection(spark):
    df = spark.createDataFrame([(1, 0, "Blue Lamp", ""), (1, 1, "blue lamp deluxe", "s1"), (1, 2, "", "x"), (1, 3, "Red", "r")], "page_id long, idx long, title string, sku string")
    assert [(r.title, r.sku) for r in dedupe.merge_chunks(df, ["sku"]).orderBy("idx").collect()] == [("Blue Lamp", "s1"), ("Red", "r")]
    sites = spark.createDataFrame([("a",), ("b",)], "site string")
    probes = spark.createDataFrame([("a", "/wp-json/", 200, '{"namespaces":[]}'), ("a", "/products.json", 404, "{}")], "site string, path string, status int, body string")
    assert {(r.site, r.platform) for r in discover.platforms(discover.signals(probes=probes), sites).collect()} == {("a", "woocommerce"), ("b", "generic")}


def test_sinks(spark, catalog, tmp_path):
    with pytest.raises(ValueError):
        export.to_feed(catalog, str(tmp_path / "f"), "nowhere")
    export.to_feed(catalog, str(tmp_path / "g"), "google_shopping")
    text = "".join(open(tmp_path / "g" / f).read() for f in os.listdir(tmp_path / "g") if f.startswith("part"))
    assert text.startswith("<?xml") and text.rstrip().endswith("</rss>") and text.count("<item>") == 5
    export.to_feed(catalog, str(tmp_path / "i"), "idealo")
    assert spark.read.csv(str(tmp_path / "i"), sep="\t", header=True).columns == list(export.IDEALO)
    export.to_csv(catalog, str(tmp_path / "c"), single=True)
    assert {r.category_path for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()} == {"Home; Bath", None}
    export.to_json(catalog, str(tmp_path / "j"))
    export.to_parquet(catalog, str(tmp_path / "p"), "store")
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 5
    export.append_snapshot(catalog.select("idx", "title"), str(tmp_path / "s"), "d.example")
    export.append_snapshot(catalog.select("idx", "title"), str(tmp_path / "s"), "d.example")
    assert spark.read.parquet(str(tmp_path / "s")).select("snapshot_id").distinct().count() == 2
    (tmp_path / "x.json").write_text('[{"title": "a"}, null, {"title": "b"}]')
    assert P.json_file(spark, str(tmp_path / "x.json")).count() == 2


def test_watching_snapshots_as_a_stream(spark, tmp_path):
    schema = "domain string, taken_at int, idx long, title string, price string"
    for n, rows in enumerate([[("d", 1, 1, "A", "10")], [("d", 2, 1, "A", "12"), ("d", 2, 2, "B", "1")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = []
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        watch.watch(stream, str(tmp_path / "store"), lambda df, _: seen.extend(tuple(r)[:3] for r in df.collect()), str(tmp_path / "state")).awaitTermination()
        assert sorted(seen) == ([] if n == 0 else [("d", "a", "price_change"), ("d", "b", "new")])


def test_the_rest_works_without_the_training_data_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['stockroom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith(('p1_', 'p5_', 'p6_', 'p7_', 'p8_')) for k in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0
