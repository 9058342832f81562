"""Queries over captured sites: whole extractions, page accounts, feeds in columns, selector schemas, discovery strategies, sinks read back, watched snapshots.

Captures are built from the catalogue and read back, so the catalogue itself is what the SQL gives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from stockroom.operators import analyze, discover, extract
from stockroom.plans.base import catalog, offers, registry, with_views
from stockroom.plans.market import _CHANGES, snapshot_rows
from stockroom.session import shared_folder, table
from stockroom.sources import export, html as H, payloads as P
from stockroom.streaming import watch

QUERIES, ORACLE, query = registry()
_T, _P = "trim(title)", "cast(price as double)"
_SITE = "concat('s', cast(idx % 10 as varchar))"


def _site() -> F.Column:
    return F.concat(F.lit("s"), (F.col("idx") % 10).cast("string"))


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("@") else F.coalesce(F.col(p[1:]).cast("string"), F.lit("")) for p in parts])


@query("s3_page_account", "select cast(p_partkey as varchar) as site, case p_partkey % 4 when 0 then 2 when 1 then 1 when 2 then 1 else 2 end::bigint as pages_completed, case when p_partkey % 4 = 3 then 3 else 2 end::bigint as pages_expected, case p_partkey % 4 when 0 then 103 when 1 then 100 when 2 then 3 else 200 end::bigint as records, p_partkey % 4 = 0 as complete, case when p_partkey % 4 = 1 then 'HTTP 503' end as error from part")
def page_account(spark, sf):
    """A full run, one that fails on its second page, one whose short first page ends it, and one that lacks its last page."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("site"), (F.col("p_partkey") % 4).alias("k"))
    items = lambda n: F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("{}"), n), ","), F.lit("]"))
    body = lambda n, total: F.concat(F.lit('{"items":'), items(n), F.lit(',"total_count":'), F.lit(str(total)), F.lit("}"))
    page = lambda no, status, text: F.struct(F.lit(no).alias("page_no"), F.lit(status).alias("http_status"), text.alias("body"))
    runs = [(page(1, 200, body(100, 103)), page(2, 200, body(3, 103))), (page(1, 200, body(100, 103)), page(2, 503, F.lit("busy"))), (page(1, 200, body(3, 103)), page(2, 200, body(100, 103))), (page(1, 200, body(100, 203)), page(2, 200, body(100, 203)))]
    pages = F.get(F.array(*[F.array(*r) for r in runs]), F.col("k").cast("int"))
    return P.page_account(p.select("site", F.explode(pages).alias("x")).select("site", "x.*"), "magento")


@query("s7_text_feeds", with_views(f"select external_id, {_T} as title, {_P} as price, idx % 2 = 0 as tabs, 2 as pictures from catalog"))
def text_feeds(spark, sf):
    """Feeds in columns, half with tabs; a quoted line end and additional pictures."""
    head = ["id", "title", "price", "description", "additional_image_link"]
    cells = ["@external_id", "@title", "@price", '"a\nb"', "u1; u2"]
    feed = lambda sep, pictures: F.concat(*[x for c in (*head, None, *cells) for x in ((F.lit("\n"),) if c is None else (_text(c), F.lit("" if c in (head[-1], cells[-1]) else sep)))])
    tabs = feed("\t", "")
    commas = feed(",", "")
    body = F.when(F.col("idx") % 2 == 0, F.replace(tabs, F.lit("u1; u2"), F.lit("u1, u2"))).otherwise(F.replace(commas, F.lit("u1; u2"), F.lit('"u1,u2"')))
    feeds = catalog(spark, sf).select(_site().alias("site"), (F.col("idx") % 2 == 0).alias("tabs"), body.alias("body"), F.lit("text/csv").alias("content_type"))
    rows = P.feed_items(feeds)
    return rows.select(F.try_variant_get("raw", "$.id", "string").alias("external_id"), F.try_variant_get("raw", "$.title", "string").alias("title"), F.try_variant_get("raw", "$.price", "string").cast("double").alias("price"), "tabs", F.size(F.try_variant_get("raw", "$.additional_image_link", "array<string>")).alias("pictures"))


_CARD = {"baseSelector": "div.item, [data-product]", "fields": [{"name": "title", "selector": "h2 a", "type": "text"}, {"name": "price", "selector": "[itemprop='price']", "type": "attribute", "attribute": "content"}, {"name": "sku", "selector": ".code", "type": "text"}]}


def _cards(spark, sf) -> DataFrame:
    markup = _text("<body><h2><a>no card</a></h2><div class='big item'><h2>x <a href=#>", "@title", "</a></h2><br><meta itemprop=price content='", "@price", "'><p><i class=code>", "@sku", "</i></div><li data-product><h2><a>second</a></h2></li></body>")
    return catalog(spark, sf).select(_site().alias("site"), F.col("product_url").alias("url"), markup.alias("html"), "idx")


@query("s16_css_select", with_views(f"select idx, 0 as pos, {_T} as title, price, sku from catalog union all select idx, 1, 'second', null, null from catalog"))
def css_select(spark, sf):
    get = lambda f: F.try_variant_get("raw", f"$.{f}", "string").alias(f)
    return H.css_select(_cards(spark, sf).select("idx", "html"), _CARD).select("idx", F.col("pos").cast("int").alias("pos"), get("title"), get("price"), get("sku"))


def _sites(spark, sf) -> DataFrame:
    return catalog(spark, sf).select(_site().alias("site")).distinct()


@query("r5_strategies", with_views(f"select distinct {_SITE} as site, concat('https://', {_SITE}, '.example/products/', cast(idx as varchar)) as url, case when idx % 10 < 4 then 'product_sitemap' when idx % 10 < 7 then 'sitemap' else 'crawl' end as strategy from catalog where idx % 10 < 7 or idx % 100 < 10"))
def strategies(spark, sf):
    """Sites whose product sitemap, general sitemap or links give their addresses."""
    c = catalog(spark, sf).withColumns({"site": _site(), "k": F.col("idx") % 10}).withColumn("url", F.concat(F.lit("https://"), "site", F.lit(".example/products/"), F.col("idx").cast("string")))
    platform = F.when(F.col("k") < 4, "shopify").otherwise("generic")
    place = F.when(F.col("k") < 4, "/sitemap_products_1.xml").otherwise("/sitemap.xml")
    locations = c.where("k < 7").groupBy("site", place.alias("path")).agg(F.array_join(F.transform(F.collect_list("url"), lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))), "").alias("x"))
    sitemaps = locations.select("site", "path", F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("body"))
    other = sitemaps.where("path <> '/sitemap.xml'").select("site", F.lit("/sitemap.xml").alias("path"), F.lit("<urlset><url><loc>https://x.example/products/other</loc></url></urlset>").alias("body"))
    home = F.concat(F.lit("https://"), "site", F.lit(".example/"))
    links = c.where("k >= 7 and idx % 100 < 10").select("site", home.alias("source"), F.col("url").alias("target"))
    starts = c.where("k >= 7").select("site", home.alias("url")).distinct()
    return discover.strategies(c.select("site", platform.alias("platform")).distinct(), sitemaps.unionByName(other), links, starts).select("site", "url", "strategy")


@query("r3_from_feed", with_views(f"select external_id, {_T} as title, {_P} as price, cast((40 + 15 + case when coalesce(image_url,'') <> '' then 15 else 0 end + case when description <> '' then 15 else 0 end + 15) / 100.0 as double) as quality from catalog"))
def from_feed(spark, sf):
    """Google feeds to products with their quality; the sku is the feed's id."""
    c = catalog(spark, sf).withColumn("site", _site())
    items = export.google_items(c.withColumn("condition", F.lit("NEW")))
    feeds = items.select(F.lit("s").alias("site"), F.concat(F.lit('<?xml version="1.0"?><rss xmlns:g="http://base.google.com/ns/1.0"><channel>'), "item", F.lit("</channel></rss>")).alias("body"))
    return extract.from_feed(feeds).select("external_id", "title", "price", "quality")


def _captures(spark, sf) -> dict[str, DataFrame]:
    """Sites of the catalogue: 0 to 3 with an API of Shopify, 4 to 6 with pages, 7 to 9 with a feed; the API of site 0 lacks prices and pictures and so fails the gate, its pages don't."""
    c = catalog(spark, sf).withColumns({"site": _site(), "k": F.col("idx") % 10})
    variant = F.struct(F.when(F.col("k") > 0, F.col("price")).alias("price"), F.when(F.col("k") > 0, F.col("sku")).alias("sku"))
    product = F.struct(F.when(F.col("k") > 0, F.col("idx")).alias("id"), F.when(F.col("k") > 0, F.col("title")).otherwise(F.lit(" ")).alias("title"), F.array(variant).alias("variants"))
    api = c.where("k < 4").select("site", F.concat(F.lit('{"products":['), F.to_json(product), F.lit("]}")).alias("body"), F.lit(200).alias("http_status"))
    offer = F.struct(F.lit("EUR").alias("priceCurrency"), F.col("price").alias("price"))
    block = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("title").alias("name"), F.array(offer).alias("offers"), F.lit("https://i.example/x.jpg").alias("image")))
    pages = c.where("k = 0 or k between 4 and 6").select("site", F.col("product_url").alias("url"), F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>")).alias("html"))
    feeds = export.google_items(c.where("k > 6")).select(F.lit("s7").alias("site"), F.concat(F.lit('<rss xmlns:g="http://base.google.com/ns/1.0"><channel>'), "item", F.lit("</channel></rss>")).alias("body"))
    probes = c.where("k < 4").select("site", F.lit("/products.json").alias("path"), F.lit(200).alias("status"), F.lit('{"products":[]}').alias("body")).distinct()
    return {"sites": c.select("site").distinct(), "api": api, "pages": pages, "feeds": feeds, "probes": probes}


_EXTRACTED = f"select case when idx % 10 > 6 then 's7' else {_SITE} end as site, case when idx % 10 = 0 then 'unified_crawl' when idx % 10 < 4 then 'api' when idx % 10 < 7 then 'unified_crawl' else 'google_feed' end as tier, case when idx % 10 < 4 then 'shopify' else 'generic' end as platform, {_T} as title, {_P} as price from catalog"


@query("r1_extract", with_views(_EXTRACTED))
def extracted(spark, sf):
    """Captured sites by the first tier that is good enough."""
    x = _captures(spark, sf)
    return extract.extract(x["sites"], x["pages"], x["api"], x["feeds"], probes=x["probes"]).select("site", "tier", "platform", "title", "price")


@query("r2_extract_one", with_views(f"select {_T} as title, {_P} as price from catalog where idx = 14"))
def extract_one(spark, sf):
    return extract.extract_one(_captures(spark, sf)["pages"], "https://shop.example/p/14").select("title", "price")


@query("r9_statistics", with_views("select count(*) as total, min(cast(price as double)) as price_min, max(cast(price as double)) as price_max from catalog where idx % 10 in (0, 4, 5, 6)"))
def statistics(spark, sf):
    """Statistics of what the pages of the sites show."""
    return extract.statistics(extract.tiered({"unified_crawl": extract.from_pages(_captures(spark, sf)["pages"])})).select("total", "price_min", "price_max")


@query("k2_json_array", with_views("select idx, title, cast(cast(price as decimal(18,2)) as varchar) as price from catalog"))
def json_array(spark, sf):
    """Products as files of one JSON list each, read back."""
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    export.to_json(catalog(spark, sf).select("idx", "title", F.col("price").cast("decimal(18,2)").alias("price"), "gtin"), path, array=True)
    get = lambda c, kind: F.try_variant_get("raw", f"$.{c}", kind).alias(c)
    return P.json_file(spark, path).select(get("idx", "long"), get("title", "string"), get("price", "string"))


@query("k3_feed_files", with_views(f"select external_id, {_T} as title from catalog"))
def feed_files(spark, sf):
    """Google feeds of several files, each whole, read back."""
    path = f"{shared_folder(spark)}/rss-{uuid.uuid4().hex}"
    export.to_feed(catalog(spark, sf).repartition(3), path, "google_shopping", "A & B")
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("body"), F.lit("text/xml").alias("content_type"))
    return P.feed_items(files).select(F.try_variant_get("raw", "$.id", "string").alias("external_id"), F.try_variant_get("raw", "$.title", "string").alias("title"))


@query("o2_top_brands", with_views("select vendor as value, count(*) as n from catalog where trim(vendor) <> '' group by vendor order by n desc, value limit 20"))
def top_brands(spark, sf):
    return analyze.top(analyze.count_field(catalog(spark, sf), "vendor"), 20, F.desc("n"), "value").select("value", "n")


@query("o2_dearest_by_store", with_views("select store, idx, l_suppkey from (select *, row_number() over (partition by store order by cast(price as decimal(18,2)) desc, idx, l_suppkey) as r from offers) where r <= 3"))
def dearest_by_store(spark, sf):
    return analyze.top(offers(spark, sf), 3, F.desc(F.col("price").cast("decimal(18,2)")), "idx", "l_suppkey", by=("store",)).select("store", "idx", "l_suppkey")


@query("has_price_and_image", with_views("select idx as page_id from catalog where coalesce(image_url,'') <> ''"))
def has_price_and_image(spark, sf):
    block = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("title").alias("name"), F.array(F.struct("price")).alias("offers"), F.col("image_url").alias("image")))
    pages = catalog(spark, sf).select(F.col("idx").alias("page_id"), F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>")).alias("html"))
    return H.has_price_and_image(H.layered(H.page_parts(pages).drop("html"))).select("page_id")


@query("r8_sessions", "select event_type as domain, min(ts) as start, max(ts) + interval 2 hour as \"end\", count(*) as n from (select *, sum(fresh) over (partition by event_type order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by event_type order by ts, event_id) < interval 2 hour then 0 else 1 end as fresh from events)) group by event_type, s")
def sessions(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("domain"), F.col("ts").cast("timestamp").alias("at"))
    return watch.sessions(rows, "2 hours").select("domain", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("r8_watch", with_views("") + _CHANGES + " select * from ch", "old_price new_price")
def watched(spark, sf):
    """The two newest snapshots of each shop, delivered to a stream one after the other: what it gives after the last one."""
    folder = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    rows = snapshot_rows(spark, sf)
    last = rows.agg(F.max("taken_at")).first()[0]
    for i, part in enumerate((rows.where(F.col("taken_at") < last), rows.where(F.col("taken_at") == last))):
        part.write.parquet(f"{folder}/in{i}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in{i}")
        keep = lambda df, n, i=i: df.write.mode("overwrite").parquet(f"{folder}/out/{i}-{n}")
        watch.watch(stream, f"{folder}/store", keep, f"{folder}/state{i}").awaitTermination()
    return spark.read.parquet(f"{folder}/out/1-0")
