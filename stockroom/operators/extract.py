"""From captured payloads of sites to products: detection, tiers with a quality gate, feeds, single pages and site statistics as one plan each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from stockroom.functions import text as X
from stockroom.operators import analyze, discover, normalize
from stockroom.session import staged
from stockroom.sources import html, payloads

#: Tiers in the order in which they are tried.
TIERS = ("api", "unified_crawl", "google_feed", "css", "llm")
#: Tiers that count with any product.
UNGATED = ("css", "llm")


def detect(sites: DataFrame, pages: DataFrame | None = None, headers: DataFrame | None = None, probes: DataFrame | None = None) -> DataFrame:
    """``site``, ``platform``, ``confidence`` and ``signals`` of each site; generic where nothing shows a platform."""
    if pages is None and headers is None and probes is None:
        return discover.platforms(sites.sparkSession.createDataFrame([], "site string, platform string, signal string"), sites)
    return discover.platforms(discover.signals(pages, headers, probes), sites)


def from_api(pages: DataFrame) -> DataFrame:
    """Products of captured API pages (site, platform, body, optionally http_status) by the dialect of their platform; other platforms have no API that is read."""
    parts = []
    for platform in ("shopify", "woocommerce", "magento", "shopware"):
        rows = payloads.api_pages(pages.where(F.col("platform") == platform).withColumn("shop", F.concat(F.lit("https://"), "site")), platform)
        dialect = {"shopify": normalize.shopify, "woocommerce": normalize.woocommerce, "magento": normalize.magento, "shopware": normalize.shopware}[platform]
        parts.append(normalize.normalize(rows.select("site", "shop", "raw"), platform, dialect).drop("shop"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def from_pages(pages: DataFrame) -> DataFrame:
    """Products of captured HTML pages (site, url, html, optionally markdown, metadata, images) by the layered scan; each page is told by its url."""
    parts = html.page_parts(pages.withColumn("page_id", F.struct("site", "url")))
    found = html.layered(parts.drop("html"))
    columns = {"title": X.stripped("name"), "price": X.money("price"), "currency": F.coalesce("currency", F.lit("USD")), "image_url": F.col("image"), "product_url": F.coalesce("url", "page_id.url"), "description": X.without_markup("description")}
    stock = F.coalesce("availability", F.lit(""))
    columns |= {"external_id": F.coalesce("sku", "gtin"), "sku": F.col("sku"), "vendor": F.col("vendor"), "gtin": X.gtin("gtin"), "in_stock": (stock == "") | stock.contains("InStock")}
    rows = found.select("page_id.site", F.col("page_id.url").alias("page_url"), "layer", F.explode(F.array(normalize.product(**columns))).alias("p")).where(F.col("p").isNotNull() & normalize.is_product(F.col("p")))
    return rows.select("site", "page_url", "layer", *[F.coalesce("p.condition", F.lit("NEW")).alias(n) if n == "condition" else F.col(f"p.{n}") for n, _ in normalize.FIELDS])


def from_feed(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Products of captured feeds (site, body, optionally content_type) of either kind, with their ``quality``."""
    rows = payloads.feed_items(feeds, body).withColumn("shop", F.concat(F.lit("https://"), "site"))
    return analyze.quality(normalize.normalize(rows, dialect=normalize.google_feed).drop("shop", "pos"))


def from_cards(pages: DataFrame, schema: dict | None = None) -> DataFrame:
    """Products of the cards of captured HTML pages (site, url, html), by a schema of selectors or the usual marks of cards."""
    rows = html.css_select(pages.select("site", "url", "html"), schema) if schema else html.css_cards(pages.select("site", "url", "html"))
    return normalize.normalize(rows.withColumn("shop", F.col("url")).drop("pos"), dialect=normalize.direct).withColumnRenamed("url", "page_url").drop("shop")


def by_batches(pages: DataFrame, reader: Callable[[Iterable[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that an outside reader (a model, a service) gives for captured pages, a batch at a time: the hook for scans that aren't built here."""

    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(list(reader(pdf.to_dict("records"))), columns=names)

    return pages.mapInPandas(run, schema)


def tiered(tiers: dict[str, DataFrame], gate: float = 0.3) -> DataFrame:
    """Products of each site's first good tier with ``tier``, ``quality`` (of the row) and ``tier_quality``: the first that has products and whose mean quality reaches the gate, for the last tiers any that has products.

    ``tiers``: products (with site) by tier name. Sites without any product give no row.
    """
    parts = None
    for tier in TIERS:
        if tier in tiers:
            df = tiers[tier].select("site", *[n for n, _ in normalize.FIELDS], F.lit(tier).alias("tier"))
            parts = df if parts is None else parts.unionByName(df)
    if parts is None:
        raise ValueError(f"no tier given; known: {', '.join(TIERS)}")
    rows = staged(analyze.quality(parts))  # scored and chosen from
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    scores = rows.groupBy(F.col("site").alias("source"), "tier").agg(F.avg(F.col("quality").cast("double")).alias("quality"), F.count("*").alias("n")).withColumn("tier_rank", rank)
    best = discover.first_good_tier(scores, gate, UNGATED).select(F.col("source").alias("site"), "tier", F.col("quality").alias("tier_quality"))
    return rows.join(best, ["site", "tier"])


def extract(sites: DataFrame, pages: DataFrame | None = None, api: DataFrame | None = None, feeds: DataFrame | None = None, headers: DataFrame | None = None, probes: DataFrame | None = None, schema: dict | None = None, gate: float = 0.3) -> DataFrame:
    """Products of each site by the first good tier of what was captured, with ``tier``, ``tier_quality`` and the site's detected ``platform``.

    ``api``: site, body (and http_status); pages of an API are read by the dialect of the detected platform.
    """
    kinds = detect(sites, pages.select("site", "html") if pages is not None else None, headers, probes).select("site", "platform")
    tiers = {}
    if api is not None:
        tiers["api"] = from_api(api.drop("platform").join(kinds, "site"))
    if pages is not None:
        tiers |= {"unified_crawl": from_pages(pages), "css": from_cards(pages, schema)}
    if feeds is not None:
        tiers["google_feed"] = from_feed(feeds)
    return tiered(tiers, gate).join(kinds, "site")


def extract_one(pages: DataFrame, url: str) -> DataFrame:
    """The product of one captured page, the most complete one if there are several; no row if it shows none."""
    rows = analyze.quality(from_pages(pages.where(F.col("url") == url)))
    return rows.orderBy(F.desc("quality"), "title", "external_id").limit(1)


def statistics(products: DataFrame) -> DataFrame:
    """Catalogue statistics of each site's extracted products."""
    return analyze.catalog_stats(products)
