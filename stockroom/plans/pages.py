"""Queries over payloads: dialects, feeds, HTML layers, detection, discovery, merging, sinks and streams.

Payloads are built from the catalogue and read back, so the catalogue itself is what the SQL gives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from stockroom.functions import text as X
from stockroom.operators import dedupe, discover, normalize as N
from stockroom.plans.base import catalog, registry, with_views
from stockroom.session import shared_folder, table
from stockroom.sources import export, html as H, payloads as P
from stockroom.streaming import watch

QUERIES, ORACLE, query = registry()
_T, _P = "trim(title)", "cast(price as double)"


def _raw(df: DataFrame, **fields) -> DataFrame:
    """``idx``, ``raw`` and ``shop`` of payloads with these fields; a list or struct stays one."""
    return df.select("idx", F.to_variant_object(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("raw"), F.lit("https://shop.example").alias("shop"))


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^[\\s\\pZ\\x{{85}}\\x1c-\\x1f]+|[\\s\\pZ\\x{{85}}\\x1c-\\x1f]+$', '', 'g')"


def _array(e: str) -> str:
    return f"(case when json_type({e}) = 'ARRAY' then from_json({e}, '[\"JSON\"]') else [] end)"


def _plain(e: str, key: str) -> str:
    """The text under ``key`` of an object, or the element itself if it is plain."""
    return f"(case when json_type({e}) = 'OBJECT' then ({e}->>'$.{key}') else ({e}->>'$') end)"


_API = "select page_id, pos - 1 as pos, l[pos] as e from (select page_id, l, unnest(generate_series(1, len(l))) as pos from (select page_id, from_json({list}, '[\"JSON\"]') as l from {table} where http_status = 200 and json_type({list}) = 'ARRAY')) where json_type(l[pos]) = 'OBJECT'"
_DECIMAL = "try_cast({} as decimal(38,10))"


@query(
    "n1_shopify",
    f"""with r as ({_API.format(list="json_extract(try_cast(body as json), '$.products')", table="shopify_products")}), v as (select *, {_array("(e->'$.variants')")} as vs, {_array("(e->'$.images')")} as ims from r)
select page_id, pos, (e->>'$.id') as external_id, {_strip("(e->>'$.title')")} as title, coalesce({_DECIMAL.format("(vs[1]->>'$.price')")}, 0)::double as price, coalesce(e->>'$.vendor', '') as vendor, coalesce({_plain("ims[1]", "src")}, '') as image_url,
 len(vs) = 0 or list_bool_or(list_transform(vs, lambda x: coalesce(try_cast(x->>'$.inventory_quantity' as bigint) > 0, true))) as in_stock, len(list_filter(vs, lambda x: {_DECIMAL.format("coalesce(x->>'$.price', '0')")} is not null)) as variants,
 case when json_type((e->'$.tags')) = 'ARRAY' then len(list_filter(from_json((e->'$.tags'), '["VARCHAR"]'), lambda x: x <> '')) else len(list_filter(string_split(coalesce(e->>'$.tags', ''), ','), lambda x: {_strip("x")} <> '')) end as tags
from v where {_strip("coalesce(e->>'$.title', '')")} <> ''""",
)
def shopify(spark, sf):
    pages = table(spark, sf, "shopify_products").select("page_id", "http_status", "body", F.concat(F.lit("https://"), "domain").alias("shop"))
    return N.normalize(P.api_pages(pages, "shopify"), "shopify").select("page_id", F.col("pos").cast("long").alias("pos"), "external_id", "title", "price", F.coalesce("vendor", F.lit("")).alias("vendor"), "image_url", "in_stock", F.size("variants").cast("long").alias("variants"), F.size("tags").cast("long").alias("tags"))


@query(
    "n5_woocommerce",
    f"""with r as ({_API.format(list="try_cast(body as json)", table="woocommerce_products")}), a as (select *, coalesce(e->>'$._source' = 'woocommerce_admin_api', false) or (((e->'$.prices') is null or json_type((e->'$.prices')) = 'NULL') and coalesce(json_type((e->'$.price')) = 'VARCHAR', false)) as adm, coalesce(try_cast(e->>'$.prices.currency_minor_unit' as int), 2) as unit, {_array("(e->'$.images')")} as ims from r),
p as (select *, coalesce(case when adm then {_DECIMAL.format("(e->>'$.price')")} else (try_cast(e->>'$.prices.price' as decimal(24,6)) / power(10, unit))::decimal(38,10) end, 0) as price, case when adm then {_DECIMAL.format("(e->>'$.compare_at_price')")} else (try_cast(e->>'$.prices.regular_price' as decimal(24,6)) / power(10, unit))::decimal(38,10) end as regular,
 coalesce(case when len(ims) > 0 then {_plain("ims[1]", "src")} else (e->>'$.image_url') end, '') as image_url, {_strip("coalesce(nullif(e->>'$.title', ''), (e->>'$.name'), '')")} as title from a)
select page_id, pos, coalesce(e->>'$.id', '') as external_id, title, price::double as price, case when regular <> price then regular::double end as compare_at_price, coalesce(case when adm then (e->>'$.currency') else (e->>'$.prices.currency_code') end, 'USD') as currency, image_url,
 len(list_filter({_array("(e->'$.categories')")}, lambda x: coalesce({_plain("x", "name")}, '') <> '')) as categories from p where title <> '' and (price > 0 or image_url <> '' or coalesce(e->>'$.sku', '') <> '' or coalesce(e->>'$.id', '') <> '')""",
)
def woocommerce(spark, sf):
    pages = table(spark, sf, "woocommerce_products").select("page_id", "http_status", "body", F.concat(F.lit("https://"), "domain").alias("shop"))
    return N.normalize(P.api_pages(pages, "woocommerce"), "woocommerce").select("page_id", F.col("pos").cast("long").alias("pos"), "external_id", "title", "price", "compare_at_price", "currency", "image_url", F.size("category_path").cast("long").alias("categories"))


@query("n6_magento", with_views(f"select idx, sku as external_id, {_T} as title, {_P} as price, concat('https://shop.example/media/catalog/product/', idx, '.jpg') as image_url, concat('https://shop.example/k', idx, '.html') as product_url, gtin from catalog"))
def magento(spark, sf):
    attribute = lambda code, value: F.struct(F.lit(code).alias("attribute_code"), value.alias("value"))
    ident = F.col("idx").cast("string")
    raw = _raw(catalog(spark, sf), id=F.col("idx"), name=F.concat(F.lit(" "), "title"), price=F.col("price").cast("double"), sku=F.col("sku"), custom_attributes=F.array(attribute("image", F.concat(F.lit("/"), ident, F.lit(".jpg"))), attribute("ean", F.lit("0")), attribute("url_key", F.concat(F.lit("k"), ident)), attribute("gtin", F.col("gtin"))))
    return N.normalize(raw, "magento").select("idx", "external_id", "title", "price", "image_url", "product_url", "gtin")


@query("n7_shopware", with_views(f"select idx, {_T} as title, {_P} as price, 'EUR' as currency, case when trim(vendor) <> '' then vendor else vendor end as vendor, coalesce(in_stock, true) as in_stock, 1 as variants from catalog"))
def shopware(spark, sf):
    raw = _raw(catalog(spark, sf), id=F.col("idx"), name=F.col("title"), price=F.col("price"), vendor=F.col("vendor"), in_stock=F.col("in_stock"), variants=F.array(F.struct(F.col("idx").alias("id"), F.col("price").alias("price"))))
    return N.normalize(raw, "shopware").select("idx", "title", "price", "currency", "vendor", "in_stock", F.size("variants").alias("variants"))


def _gtin_sql(c: str) -> str:
    return f"case when regexp_matches({c}, '^0+$') then null else {c} end"


_FEED_SQL = with_views(f"select external_id, {_T} as title, {_P} as price, 'USD' as currency, {_gtin_sql('gtin')} as gtin, coalesce(image_url, '') as image_url, in_stock is null or in_stock as in_stock from catalog")


@query("n8_google_feed_xml", _FEED_SQL)
def feed_xml(spark, sf):
    """K3, then S4, S6, S8 and N8: the Google feed written as XML and read back."""
    items = export.google_items(catalog(spark, sf))
    feeds = items.select(F.concat(F.lit('<rss xmlns:g="http://base.google.com/ns/1.0"><channel>'), "item", F.lit("</channel></rss>")).alias("body")).where(P.is_xml("body", F.lit("")))
    return N.normalize(P.xml_feed(feeds).withColumn("shop", F.lit("s")), dialect=N.google_feed).select("external_id", "title", "price", "currency", "gtin", "image_url", "in_stock")


@query("n8_google_feed_csv", _FEED_SQL)
def feed_csv(spark, sf):
    """K1, then S7 and N8: feed columns written as CSV files and read back."""
    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    export.to_csv(export.google_fields(catalog(spark, sf)), path)
    return N.normalize(P.csv_feed(spark, path).withColumn("shop", F.lit("s")), dialect=N.google_feed).select("external_id", "title", "price", "currency", "gtin", "image_url", "in_stock")


_LD_SQL = with_views(f"select idx, sku, {_T} as title, {_P} as price, 'EUR' as currency, coalesce(image_url,'') as image_url, {_gtin_sql('gtin')} as gtin, trim(vendor) as vendor, idx % 3 <> 0 as in_stock, case when idx % 5 = 0 then 'USED' else 'NEW' end as condition from catalog")


def _ld_pages(spark, sf) -> DataFrame:
    c = catalog(spark, sf)
    offer = F.struct(F.col("price").alias("price"), F.lit("EUR").alias("priceCurrency"), F.when(F.col("idx") % 3 == 0, "https://schema.org/OutOfStock").otherwise("https://schema.org/InStock").alias("availability"), F.when(F.col("idx") % 5 == 0, "https://schema.org/UsedCondition").alias("itemCondition"))
    body = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("title").alias("name"), "sku", F.col("gtin").alias("gtin13"), F.array("image_url").alias("image"), F.struct(F.trim("vendor").alias("name")).alias("brand"), F.array(offer).alias("offers"), F.lit("secret").alias("review")))
    page = F.when(F.col("idx") % 2 == 0, body).otherwise(F.concat(F.lit('{"@graph":[{"@type":"WebPage","mainEntity":'), body, F.lit("}]}")))
    markup = F.concat(F.lit('<html><head><meta property="og:title" content="Og &amp; '), F.col("idx").cast("string"), F.lit('"><meta content="product" property="og:type"></head><script type="application/ld+json">'), page, F.lit("</script></html>"))
    return c.select("idx", markup.alias("html"))


@query("n10_json_ld", _LD_SQL)
def json_ld(spark, sf):
    """S9 to S12 and N10."""
    found = H.json_ld(H.page_parts(_ld_pages(spark, sf)).drop("html")).where(F.try_variant_get("raw", "$.review", "string").isNull())
    return N.normalize(found.select("idx", "raw", F.lit("s").alias("shop")), dialect=N.schema_org).select("idx", "sku", "title", "price", "currency", "image_url", "gtin", F.coalesce("vendor", F.lit(None).cast("string")).alias("vendor"), "in_stock", "condition")


@query("s13_opengraph", with_views("select idx, concat('Og & ', idx) as title, 'product' as type from catalog"))
def opengraph(spark, sf):
    return H.page_parts(_ld_pages(spark, sf)).select("idx", F.col("og")["og:title"].alias("title"), F.col("og")["og:type"].alias("type"))


@query("n11_opengraph", with_views(f"select idx, {_T} as title, {_P} as price, 'GBP' as currency from catalog"))
def opengraph_products(spark, sf):
    c = catalog(spark, sf)
    raw = c.select("idx", F.to_variant_object(F.create_map(F.lit("og:title"), F.col("title"), F.lit("product:price:amount"), F.col("price"), F.lit("product:price:currency"), F.lit("GBP"))).alias("raw"), F.lit("s").alias("shop"))
    return N.normalize(raw).select("idx", "title", "price", "currency")


@query("n12_direct", with_views(f"select idx, {_T} as title, {_P} as price, sku from catalog"))
def direct(spark, sf):
    c = catalog(spark, sf)
    price = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("$"), "price")).otherwise(F.replace("price", F.lit("."), F.lit(",")))
    return N.normalize(_raw(c, product_name=F.col("title"), price=price, sku=F.col("sku"))).select("idx", "title", "price", "sku")


@query("s16_css_cards", with_views(f"select idx, {_T} as title, {_P} as price, sku from catalog"))
def css_cards(spark, sf):
    c = catalog(spark, sf)
    markup = F.concat(F.lit("<div><p>x</p><div class='card product'><h2 class=title>"), "title", F.lit("</h2><br><span class='price'>$"), "price", F.lit("</span><b itemprop=sku>"), "sku", F.lit("</b></div><p class=price>1</p></div>"))
    return N.normalize(H.css_cards(c.select("idx", markup.alias("html"))).withColumn("shop", F.lit("s")), dialect=N.direct).select("idx", "title", "price", "sku")


def _markdown(c: DataFrame) -> DataFrame:
    number = F.when(F.col("idx") % 3 == 0, F.concat(F.lit("€ "), F.replace("price", F.lit("."), F.lit(",")))).when(F.col("idx") % 3 == 1, F.concat(F.lit("GBP "), "price")).otherwise(F.concat(F.lit("$"), "price"))
    return c.select("idx", F.concat(F.lit("intro\n# "), "title", F.lit("\nfree shipping from $5.00\nwas $7.00 before\n"), number, F.lit(" incl.\n")).alias("markdown"))


@query("f1_markdown_price", with_views(f"select idx, {_T} as title, {_P} as price, case idx % 3 when 0 then 'EUR' when 1 then 'GBP' else 'USD' end as currency from catalog"))
def markdown_price(spark, sf):
    m = _markdown(catalog(spark, sf)).select("idx", H.text_title("markdown").alias("title"), H.text_price("markdown").alias("p"))
    return m.select("idx", "title", F.col("p.price").cast("double").alias("price"), F.col("p.currency").alias("currency"))


@query("s18_layered", with_views(f"select idx as page_id, case when idx % 4 = 0 then {_T} when idx % 4 = 1 then concat('Og & ', idx) else {_T} end as name, {_P} as price, case when idx % 4 = 0 then 'json_ld' when idx % 4 = 1 then 'opengraph' else 'text' end as layer from catalog"))
def layered(spark, sf):
    c = catalog(spark, sf)
    pages = _ld_pages(spark, sf).join(_markdown(c), "idx")
    keep = F.when(F.col("idx") % 4 == 0, F.col("html")).when(F.col("idx") % 4 == 1, F.regexp_replace("html", "<script.*", "")).otherwise(F.lit("<html></html>"))
    parts = H.page_parts(pages.select(F.col("idx").alias("page_id"), "markdown", keep.alias("html")))
    return H.layered(parts).select("page_id", "name", F.col("price").cast("double").alias("price"), "layer")


@query("s20_sitemap_urls", with_views("select idx, product_url as url from catalog"))
def sitemap(spark, sf):
    c = catalog(spark, sf)
    body = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), "product_url", F.lit(" </loc></url><url><loc></loc></url></urlset>"))
    return P.sitemap_urls(c.select("idx", F.when(F.col("idx") < 0, "<bad").otherwise(body).alias("body")))


def _urls(spark, sf) -> DataFrame:
    kinds = ["/products/x", "/blog/x", "/p/x.json", "/2024/01/02/x", "/cart", "/a/category/b", "/", "/about;v=1"]
    c = catalog(spark, sf)
    return c.select("idx", (F.col("idx") % 20).cast("string").alias("site"), F.concat(F.lit("https://s.example"), F.get(F.array(*map(F.lit, kinds)), (F.col("idx") % 8).cast("int")), F.when(F.col("idx") % 16 == 8, F.lit("?q=1")).otherwise("")).alias("url"))


@query("url_filter", with_views("select idx, idx % 8 <> 0 as non_product from catalog"))
def url_filter(spark, sf):
    return _urls(spark, sf).select("idx", discover.is_non_product("url").alias("non_product"))


@query("url_discovery", with_views("select distinct cast(idx % 20 as varchar) as site, concat('https://s.example/products/x', case when idx % 16 = 8 then '?q=1' else '' end) as url from catalog where idx % 8 = 0"))
def url_discovery(spark, sf):
    return discover.discovered(_urls(spark, sf)).select("site", "url")


@query("url_woocommerce_filter", with_views("select idx, cast(idx % 10 as varchar) as site from catalog where (idx % 10) < 5 or (idx // 10) % 10 < 5"))
def woocommerce_filter(spark, sf):
    site = F.col("idx") % 10
    share = F.when(site < 5, F.floor(F.col("idx") / 10) % 10 < 1).otherwise(F.floor(F.col("idx") / 10) % 10 < 5)
    urls = catalog(spark, sf).select("idx", site.cast("string").alias("site"), F.when(share, "https://s/Product/x").otherwise("https://s/page/x").alias("url"))
    return discover.product_urls_of_woocommerce(urls).select("idx", "site")


@query("domain_of_url", with_views("select idx, concat('u@h', idx % 3, '.example:80') as domain from catalog"))
def domain_of_url(spark, sf):
    host = F.concat(F.lit("u@h"), (F.col("idx") % 3).cast("string"), F.lit(".example:80"))
    return catalog(spark, sf).select("idx", X.domain(F.when(F.col("idx") % 2 == 0, host).otherwise(F.concat(F.lit("https://"), host, F.lit("/a?b")))).alias("domain"))


@query("n13_without_markup", with_views(f"select idx, {_T} as text from catalog"))
def without_markup(spark, sf):
    return catalog(spark, sf).select("idx", X.without_markup(F.concat(F.lit("<STYLE a>x\ny</style><p>"), "title", F.lit("</p><script>1</script> "))).alias("text"))


@query("n14_gtin", with_views(f"select idx, {_gtin_sql('gtin')} as gtin from catalog"))
def gtin(spark, sf):
    return catalog(spark, sf).select("idx", X.gtin(F.when(F.col("idx") % 2 == 0, F.concat_ws("-", F.substring("gtin", 1, 5), F.substring("gtin", 6, 20))).otherwise(F.when(F.col("gtin").startswith("0"), F.substring("gtin", 2, 20)).otherwise(F.col("gtin")))).alias("g"), F.col("gtin").alias("had")).select("idx", F.when(F.col("had").isNotNull(), F.col("g")).alias("gtin"))


@query("detect_platform", with_views("select cast(idx as varchar) as site, case idx % 4 when 0 then 'shopify' when 1 then 'woocommerce' when 2 then 'magento' else 'generic' end as platform, case idx % 4 when 0 then 0.5 when 1 then 0.25 when 2 then cast(1.0 as double) / 3 else 1 end as confidence from catalog"))
def detect_platform(spark, sf):
    c = catalog(spark, sf).select(F.col("idx").cast("string").alias("site"), (F.col("idx") % 4).alias("k"))
    pages = c.select("site", F.when(F.col("k") == 0, "<META name='generator' content='Shopify'>").when(F.col("k") == 1, "<link href=/wp-content/plugins/woocommerce/x>").otherwise("<p>").alias("html"))
    headers = c.select("site", F.when(F.col("k") == 2, F.create_map(F.lit("X-Magento-Tags"), F.lit("1"))).otherwise(F.create_map(F.lit("server"), F.lit("x"))).alias("headers"))
    probes = c.where("k = 0").select("site", F.lit("/products.json").alias("path"), F.lit(200).alias("status"), F.lit('{"products":[]}').alias("body"))
    return discover.platforms(discover.signals(pages, headers, probes), c).select("site", "platform", "confidence")


@query("crawl_reachable", "select p_partkey as k, floor(p_partkey / 10) as site, case when p_partkey % 10 = 0 then 0 else p_partkey % 10 end as depth from part where p_partkey % 10 <= 3")
def reachable(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.floor(F.col("p_partkey") / 10).alias("site"))
    links = p.where("p_partkey % 10 < 9").select("site", F.col("p_partkey").alias("source"), (F.col("p_partkey") + 1).alias("target")).join(p.select(F.col("p_partkey").alias("target")), "target", "left_semi")
    return discover.reachable(links, p.where("p_partkey % 10 = 0").select("site", F.col("p_partkey").alias("url"))).select(F.col("url").alias("k"), F.col("site").cast("double").alias("site"), F.col("depth").cast("long").alias("depth"))


@query("r1_first_good_tier", with_views("select cast(idx as varchar) as source, case when idx % 3 = 0 then 'api' when idx % 3 = 1 then 'unified' else 'css' end as tier from catalog"))
def first_good_tier(spark, sf):
    c = catalog(spark, sf).select(F.col("idx").cast("string").alias("source"), (F.col("idx") % 3).alias("k"))
    tiers = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(i).alias("tier_rank"), q.cast("double").alias("quality"), n.alias("n")) for i, (t, q, n) in enumerate([("api", F.when(F.col("k") == 0, 0.4).otherwise(0.2), F.lit(3)), ("unified", F.lit(0.9), F.when(F.col("k") == 1, 2).otherwise(0)), ("css", F.lit(0.0), F.lit(1))])])).alias("x")
    return discover.first_good_tier(c.select("source", tiers).select("source", "x.*")).select("source", "tier")


@query("d1_same_offers", with_views("select name, arg_min(idx, rnk * 100000000 + idx) as idx from (select lower(trim(title)) as name, idx, 3 - (case when idx % 7 = 1 then 1 else 0 end) - (case when idx % 5 = 2 then 1 else 0 end) as rnk from catalog) group by name"))
def same_offers(spark, sf):
    """Of the rows of a name the one with most fields filled, the first of ties: the whole catalogue."""
    c = catalog(spark, sf).select(F.lit(1).alias("page_id"), "idx", F.col("title").alias("name"), F.lit("1").alias("price"), F.lit(None).cast("string").alias("sku"), F.when(F.col("idx") % 7 == 1, "x").alias("image"), F.when(F.col("idx") % 5 == 2, "y").otherwise(" ").alias("url"))
    return dedupe.same_offers(c, ["name", "price", "image", "url"]).select(X.key("name").alias("name"), "idx")


@query("d4_merge_chunks", with_views("select idx - idx % 2 as page_id, count(*) as rows_in, min(sku) as sku from catalog group by 1"))
def merge_chunks(spark, sf):
    c = catalog(spark, sf)
    chunks = c.select((F.col("idx") - F.col("idx") % 2).alias("page_id"), "idx", F.concat(F.lit("Product "), (F.col("idx") - F.col("idx") % 2).cast("string"), F.when(F.col("idx") % 2 == 1, " extra").otherwise("")).alias("title"), "sku", F.lit(1).cast("long").alias("rows_in"))
    merged = dedupe.merge_chunks(chunks, ["sku"]).groupBy("page_id").agg(F.min("sku").alias("sku"), F.count("*").alias("left"))
    return merged.join(chunks.groupBy("page_id").agg(F.sum("rows_in").alias("rows_in")), "page_id").where("left = 1").select("page_id", "rows_in", "sku")


@query("k1_flat_csv", with_views("select cast(idx as varchar) as idx, coalesce(gtin,'') as gtin, case when idx % 2 = 0 then array_to_string(string_split(product_type,' '),'; ') else '' end as category_path from catalog"))
def flat_csv(spark, sf):
    return export.flat(catalog(spark, sf)).select("idx", "gtin", "category_path")


@query("k3_google_items", with_views("select concat('<item><g:id>', external_id, '</g:id><g:title>', trim(title), '</g:title>', case when trim(description) <> '' then concat('<g:description>', description, '</g:description>') else '' end, '<g:link>', product_url, '</g:link>', case when coalesce(image_url,'') <> '' then concat('<g:image_link>', image_url, '</g:image_link>') else '' end, '<g:price>', price, ' USD</g:price><g:availability>', case when coalesce(in_stock, true) then 'in stock' else 'out of stock' end, '</g:availability>', case when gtin is not null then concat('<g:gtin>', gtin, '</g:gtin>') else '' end, case when condition is not null then '<g:condition>new</g:condition>' else '' end, '</item>') as item from catalog"))
def google_items(spark, sf):
    return export.google_items(catalog(spark, sf))


@query("k4_idealo_rows", with_views("select sku, trim(title) as title, price, coalesce(gtin,'') as gtin, coalesce(condition,'') as condition, '' as delivery_time from catalog"))
def idealo_rows(spark, sf):
    return export.idealo_rows(catalog(spark, sf)).select("sku", "title", "price", "gtin", "condition", "delivery_time")


def _event_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("title_key"), F.col("event_type").alias("domain"), F.col("event_id").alias("idx"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("price"))


def _streamed(transform, spark, sf: str) -> DataFrame:
    """Runs a stream over the events to its end and gives what its sink holds."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    base = table(spark, sf, "events")
    base.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(base.schema).parquet(f"{folder}/in")
    done = transform(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _as_events(stream: DataFrame) -> DataFrame:
    return stream.select(F.col("user_id").cast("string").alias("title_key"), F.col("event_type").alias("domain"), F.col("event_id").alias("idx"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("price"))


_LAG = "select event_type as domain, cast(user_id as varchar) as title_key, event_id, value, lag(value) over (partition by event_type, user_id order by ts, event_id) as last, row_number() over (partition by event_type, user_id order by ts, event_id) as n from events"


@query("r8_price_changes", f"select domain, title_key, case when n = 1 then 'new' else 'price_change' end as change, last as old_price, value as new_price from ({_LAG}) where n = 1 or value <> last")
def price_changes(spark, sf):
    return _streamed(lambda s: watch.price_changes(_as_events(s)), spark, sf).select("domain", "title_key", "change", "old_price", "new_price")


@query("r8_windowed_batch", "select event_type as domain, date_trunc('day', ts) as start, count(*) as n, min(value) as low, max(value) as high from events group by 1, 2")
def windowed(spark, sf):
    return watch.windowed(_event_rows(spark, sf), "1 day").select("domain", F.col("start").cast("timestamp_ntz").alias("start"), "n", "low", "high")
