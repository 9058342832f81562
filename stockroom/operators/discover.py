"""Platform detection, URL discovery and tiered choice over captured pages, headers, probes and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockroom.functions import text as X
from stockroom.sources.payloads import sitemap_urls

# Places of product sitemaps by platform, then of general ones, in the order in which they are tried.
PRODUCT_SITEMAPS = {
    "shopify": ("/sitemap_products_1.xml",),
    "woocommerce": ("/product-sitemap.xml", "/product-sitemap1.xml"),
    "magento": ("/pub/media/sitemap/sitemap.xml", "/media/sitemap.xml"),
    "bigcommerce": ("/xmlsitemap.php",),
    "shopware": ("/sitemap.xml",),
    "generic": (),
}
SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml")
# Paths that no product page has.
PATHS = (
    "/",
    "/about",
    "/about-us",
    "/contact",
    "/contact-us",
    "/blog",
    "/cart",
    "/checkout",
    "/account",
    "/login",
    "/register",
    "/search",
    "/faq",
    "/privacy",
    "/privacy-policy",
    "/terms",
    "/terms-of-service",
    "/terms-and-conditions",
    "/shipping",
    "/shipping-policy",
    "/returns",
    "/return-policy",
    "/refund-policy",
    "/sitemap",
    "/brands",
    "/categories",
    "/pages",
    "/wishlist",
    "/compare",
    "/basket",
    "/help",
    "/support",
    "/careers",
    "/press",
    "/newsletter",
    "/my-account",
    "/order-tracking",
    "/rewards",
)
# Segments of paths that no product page has.
SEGMENTS = (
    "checkout",
    "basket",
    "cart",
    "login",
    "register",
    "account",
    "blog",
    "faq",
    "help",
    "support",
    "careers",
    "press",
    "my-account",
    "order-tracking",
    "wp-admin",
    "wp-includes",
    "feed",
    "author",
    "tag",
    "category",
    "wp-login.php",
    "newsletter",
    "unsubscribe",
    "journal",
    "news",
    "stories",
    "articles",
    "recipe",
    "recipes",
    "tea_collections",
    "product_collection",
    "our-story",
    "sustainability",
    "charity",
    "events",
    "product-category",
    "product-tag",
)
# Endings that no product page has.
ENDINGS = (
    ".xml",
    ".json",
    ".txt",
    ".pdf",
    ".png",
    ".jpg",
    ".jpeg",
    ".gif",
    ".svg",
    ".css",
    ".js",
    ".ico",
    ".woff",
    ".woff2",
    ".ttf",
    ".eot",
    ".map",
    ".gz",
)
#: Platforms in the order in which ties go, and how many signals each can give.
SIGNALS = {"shopify": 4, "woocommerce": 4, "magento": 3, "bigcommerce": 3, "shopware": 4, "generic": 1}
# What pages of each platform have in their markup, and the name of the signal.
HTML_SIGNALS = (
    ("shopify", "meta:generator=shopify", r"""<meta[^>]+name=["']generator["'][^>]+content=["']shopify"""),
    ("woocommerce", "meta:generator=wordpress", r"""<meta[^>]+name=["']generator["'][^>]+content=["']wordpress"""),
    ("bigcommerce", "meta:platform=bigcommerce", r"""<meta[^>]+name=["']platform["'][^>]+content=["']bigcommerce"""),
    ("shopware", "meta:generator=shopware", r"""<meta[^>]+name=["']generator["'][^>]+content=["'][^"']*shopware"""),
    ("shopify", "cdn:shopify", r"cdn\.shopify\.com"), ("bigcommerce", "cdn:bigcommerce", r"cdn(11)?\.bigcommerce\.com"), ("woocommerce", "cdn:woocommerce", "/wp-content/plugins/woocommerce/"), ("shopware", "cdn:shopware", "/bundles/storefront/|shopware-storefront"),
)


def is_non_product(url: Column | str) -> Column:
    """Whether an address is hardly a product page: by ending, exact path, segment or a dated path."""
    path = F.lower(F.regexp_replace(X.url_path(url), "/+$", ""))
    ending = F.concat(F.lit("."), F.element_at(F.split(path, r"\."), -1))
    segments = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    return (path.contains(".") & ending.isin(*ENDINGS)) | path.isin(*PATHS) | (path == "") | F.arrays_overlap(segments, F.array(*map(F.lit, SEGMENTS))) | path.rlike(r"/\d{4}/\d{2}/\d{2}/")


def product_urls_of_woocommerce(urls: DataFrame, by: str = "site") -> DataFrame:
    """Per site the addresses with /product/ if they are 30 % or more, else all."""
    hit = F.lower("url").contains("/product/")
    shares = urls.groupBy(by).agg((F.count_if(hit) >= F.count("*") * 0.3).alias("_only"))
    return urls.join(shares, by).where(~F.col("_only") | hit).drop("_only")


def discovered(urls: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct product addresses (columns site, url, optional idx); ``most`` keeps the first of each site by idx, then url."""
    rows = urls.where(~is_non_product("url"))
    rows = rows.groupBy("site", "url").agg(F.min("idx" if "idx" in urls.columns else F.lit(0)).alias("idx"))
    return rows if most is None else rows.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("idx", "url"))).where(F.col("_n") <= most).drop("_n")


def strategies(sites: DataFrame, sitemaps: DataFrame, links: DataFrame | None = None, starts: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """``site``, ``url``, ``strategy``: the product addresses of each site by the first strategy that gives any: its platform's product sitemaps, general sitemaps, addresses within reach of the start pages.

    ``sites``: site, platform; ``sitemaps``: site, path, body (captured); ``links``, ``starts``: see ``reachable``. Of sitemaps of one rank the earliest place with addresses counts.
    WooCommerce addresses are narrowed to those with /product/ where these are 30 % or more. ``most`` keeps the first of each site by address.
    """
    places = [(p, path, i) for p, paths in PRODUCT_SITEMAPS.items() for i, path in enumerate(paths)] + [(p, path, 10 + i) for p in PRODUCT_SITEMAPS for i, path in enumerate(SITEMAPS)]
    table = F.broadcast(sites.sparkSession.createDataFrame(places, "platform string, path string, place int"))  # fixed values
    captured = sitemaps.join(sites.select("site", "platform"), "site").join(table, ["platform", "path"]).groupBy("site", "path", "platform").agg(F.min("place").alias("place"), F.max("body").alias("body"))
    found = sitemap_urls(captured).where(~is_non_product("url")).select("site", "url", "place", "platform")
    shops = product_urls_of_woocommerce(found.where("platform = 'woocommerce'"))
    found = found.where("platform <> 'woocommerce'").unionByName(shops).select("site", "url", "place")
    if links is not None and starts is not None:
        found = found.unionByName(reachable(links, starts).where(~is_non_product("url")).select("site", "url", F.lit(20).alias("place")))
    first = found.groupBy("site").agg(F.min("place").alias("place"))
    named = F.when(F.col("place") < 10, "product_sitemap").when(F.col("place") < 20, "sitemap").otherwise("crawl")
    rows = found.join(first, ["site", "place"]).groupBy("site", "url").agg(F.min(named).alias("strategy"))
    return rows if most is None else rows.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("url"))).where(F.col("_n") <= most).drop("_n")


def reachable(links: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """``site``, ``url``, ``depth``: addresses within ``depth`` links (site, source, target) of the start pages (site, url), by breadth-first joins."""
    seen = start.select("site", "url").distinct().withColumn("depth", F.lit(0))
    frontier, steps = seen, links.select("site", F.col("source").alias("url"), "target")
    for d in range(1, depth + 1):
        known = seen.select("site", "url")
        frontier = frontier.select("site", "url").join(steps, ["site", "url"]).select("site", F.col("target").alias("url")).distinct().join(known, ["site", "url"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def signals(pages: DataFrame | None = None, headers: DataFrame | None = None, probes: DataFrame | None = None) -> DataFrame:
    """``site``, ``platform``, ``signal`` out of pages (site, html), headers (site, map of headers) and probes (site, path, status, body)."""
    found = []

    def gathered(df: DataFrame, parts: list) -> DataFrame:
        return df.select("site", F.explode(F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(p).alias("platform"), F.lit(s).alias("signal"))) for p, s, cond in parts]))).alias("x")).select("site", "x.*")

    if pages is not None:
        html = F.lower("html")
        found.append(gathered(pages.where(F.length("html") <= 10 * 1024 * 1024), [(p, s, html.rlike(r)) for p, s, r in HTML_SIGNALS]))
    if headers is not None:
        names = F.transform(F.map_keys("headers"), lambda k: F.lower(k))
        link = F.lower(F.array_join(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == "link")), " "))
        found.append(
            gathered(
                headers,
                [
                    ("shopify", "header:shopify", F.array_contains(names, "x-shopid") | F.array_contains(names, "x-shopify-stage")), ("magento", "header:magento", F.exists(names, lambda k: k.startswith("x-magento"))),
                    ("woocommerce", "header:wp-json", link.contains("wp-json") & link.contains("api.w.org")), ("shopware", "header:shopware", F.array_contains(names, "sw-version-id") | F.array_contains(names, "sw-context-token")),
                ],
            )
        )
    if probes is not None:
        v, ok = F.try_parse_json("body"), F.col("status") == 200
        found.append(
            gathered(
                probes,
                [
                    ("shopify", "api:products", ok & (F.col("path") == "/products.json") & F.try_variant_get(v, "$.products", "variant").isNotNull()), ("woocommerce", "api:wp-json", ok & (F.col("path") == "/wp-json/") & F.try_variant_get(v, "$.namespaces", "variant").isNotNull()),
                    ("magento", "api:storeConfigs", ok & (F.col("path") == "/rest/V1/store/storeConfigs") & F.try_variant_get(v, "$[0]", "variant").isNotNull()), ("shopware", "api:config", ok & (F.col("path") == "/api/_info/config")),
                ],
            )
        )
    if not found:
        raise ValueError("nothing to look at")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def platforms(found: DataFrame, sites: DataFrame) -> DataFrame:
    """Per site the platform with most signals (ties in the fixed order) and confidence, signals over the most it can give; generic with confidence 1 where there are none."""
    order = F.lit(99)
    most = F.lit(1)
    for i, (p, n) in enumerate(SIGNALS.items()):
        order, most = F.when(F.col("platform") == p, i).otherwise(order), F.when(F.col("platform") == p, n).otherwise(most)
    counts = found.distinct().groupBy("site", "platform").agg(F.count("*").alias("n")).withColumns({"o": -order, "most": most})
    best = counts.groupBy("site").agg(F.max(F.struct("n", "o", "platform", "most")).alias("x"))
    return sites.select("site").distinct().join(best, "site", "left").select("site", F.coalesce("x.platform", F.lit("generic")).alias("platform"), F.coalesce(F.least(F.col("x.n") / F.col("x.most"), F.lit(1.0)), F.lit(1.0)).alias("confidence"), F.coalesce("x.n", F.lit(0)).cast("long").alias("signals"))


def first_good_tier(results: DataFrame, gate: float = 0.3, ungated: tuple[str, ...] = ("css", "llm")) -> DataFrame:
    """Per source the first tier (tier, tier_rank, quality, n products) that has products and, unless ungated, reaches the gate."""
    ok = (F.col("n") > 0) & ((F.col("quality") >= gate) | F.col("tier").isin(*ungated))
    return results.where(ok).groupBy("source").agg(F.min_by(F.struct("tier", "quality", "n"), "tier_rank").alias("x")).select("source", "x.*")
