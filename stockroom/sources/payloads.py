"""Captured API pages, feeds, sitemaps and JSON files as rows of raw records (``raw`` variant). Bodies that can't be read give no rows."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stockroom.functions import text as X

#: Longest body that is read, in characters.
BODY_LIMIT = 10 * 1024 * 1024
FEED = ("id", "title", "description", "link", "price", "sale_price", "gtin", "ean", "brand", "image_link", "availability", "condition", "product_type", "mpn")


def api_pages(pages: DataFrame, platform: str, body: str = "body") -> DataFrame:
    """One row per record of captured pages, with ``raw`` and ``pos``: the list under ``products`` (Shopify) or ``items`` (Magento), or the top-level list; only pages of status 200 where that is known."""
    parsed = pages.where(F.coalesce(F.col("http_status") == 200, F.lit(True)) if "http_status" in pages.columns else F.lit(True)).withColumn("_v", F.try_parse_json(body))
    path = {"shopify": "$.products", "magento": "$.items"}.get(platform, "$")
    kept = [c for c in pages.columns if c != body]
    return parsed.select(*kept, F.posexplode(F.try_variant_get("_v", path, "array<variant>")).alias("pos", "raw")).where("raw is not null and not is_variant_null(raw)")


#: Records of a full page, by platform.
PAGE_SIZES = {"shopify": 250, "woocommerce": 100, "magento": 100}


def page_account(pages: DataFrame, platform: str, body: str = "body", by: str = "site") -> DataFrame:
    """Per site what captured pages (page_no, http_status, body) amount to: ``pages_completed``, ``pages_expected`` (null if nothing says), ``records``, ``complete`` and ``error``.

    Pages count from the first on while each has status 200, a readable list and is full; a page with fewer records is the last one. A page that fails ends the account with an
    error. Magento says how many records there are; the others are complete when a short page is reached. Repeated captures of a page count once, the last successful one.
    """
    v = F.try_parse_json(body)
    path = {"shopify": "$.products", "magento": "$.items"}.get(platform, "$")
    read = pages.select(by, F.col("page_no").cast("long").alias("page_no"), F.col("http_status").alias("status"), F.when(F.col("http_status") == 200, F.size(F.try_variant_get(v, path, "array<variant>"))).alias("n"), F.try_variant_get(v, "$.total_count", "long").alias("total"))
    read = read.where("page_no is not null").groupBy(by, "page_no").agg(F.max("n").alias("n"), F.max("status").alias("status"), F.max("total").alias("total"))
    size = PAGE_SIZES[platform]
    short = F.coalesce(F.col("n"), F.lit(-1)) < size
    ends = read.groupBy(by).agg(F.min(F.when(short, F.col("page_no"))).alias("end"), F.min("page_no").alias("begin"), F.count("*").alias("had"), F.max("page_no").alias("last"), F.max("total").alias("total"))
    counted = read.join(ends, by).where((F.col("begin") <= 1) & (F.col("page_no") <= F.coalesce("end", "last")) & F.col("n").isNotNull())
    sums = counted.groupBy(by).agg(F.count("*").alias("pages_completed"), F.sum("n").alias("records"), F.max("page_no").alias("reached"))
    out = ends.join(sums, by, "left").join(read.select(by, F.col("page_no").alias("end"), F.col("status").alias("end_status"), F.col("n").alias("end_n")), [by, "end"], "left")
    records = F.coalesce("records", F.lit(0)).cast("long")
    expected = F.ceil(F.col("total") / size).cast("long") if platform == "magento" else F.lit(None).cast("long")
    failed = F.col("end").isNotNull() & F.col("end_n").isNull()
    complete = ~failed & (records >= F.col("total") if platform == "magento" else F.col("end").isNotNull())
    error = F.when(failed, F.when(F.col("end_status") != 200, F.concat(F.lit("HTTP "), F.col("end_status").cast("string"))).otherwise("unreadable page"))
    return out.select(by, F.coalesce("pages_completed", F.lit(0)).cast("long").alias("pages_completed"), expected.alias("pages_expected"), records.alias("records"), F.coalesce(complete, F.lit(False)).alias("complete"), error.alias("error"))


def is_xml(body: Column | str, content_type: Column | str) -> Column:
    kind, text = F.lower(F.coalesce(X.col(content_type), F.lit(""))), F.ltrim(F.coalesce(X.col(body), F.lit("")))
    return F.when(kind.contains("xml"), True).when(kind.contains("csv") | kind.contains("tab-separated"), False).otherwise(text.startswith("<?xml") | text.startswith("<rss") | text.startswith("<feed"))


def _feed_row(value) -> Column:
    """A feed's record (put out by a generator, so that it is built once, not per field read) as a variant of the dialect ``google_feed``; ``value(name)`` gives a field's stripped text."""
    price, sale = X.price_string(value("price")), X.price_string(value("sale_price"))
    plain = [F.when(value(n) != "", value(n)).otherwise("").alias(n) for n in FEED if n not in ("price", "sale_price", "gtin", "ean")]
    row = F.struct(
        F.lit("google_feed").alias("_source"), *plain, price["amount"].alias("price"), sale["amount"].alias("sale_price"), F.when(price["currency"] != "", price["currency"]).otherwise(sale["currency"]).alias("currency"),
        F.coalesce(X.first_filled(value("gtin"), value("ean")), F.lit("")).alias("gtin"), value("additional_image_link").alias("additional_image_link"),
    )
    return F.to_variant_object(row)


def xml_feed(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Items of RSS feeds (or entries of Atom ones) held in a column: a ``g:`` field before the plain one, repeated additional pictures as a list; items without a title go."""
    names = [n for n in FEED] + ["additional_image_link"]
    fields = [T.StructField(p + n, T.ArrayType(T.StringType()) if n == "additional_image_link" else T.StringType()) for n in names for p in ("g:", "")]
    item = T.StructType(fields)
    schema = T.StructType([T.StructField("channel", T.StructType([T.StructField("item", T.ArrayType(item))])), T.StructField("item", T.ArrayType(item)), T.StructField("entry", T.ArrayType(item))])
    parsed = feeds.where(F.length(body) <= BODY_LIMIT).withColumn("_x", F.from_xml(F.col(body), _ddl(schema)))
    items = F.coalesce(F.col("_x.channel.item"), F.col("_x.item"), F.col("_x.entry"))
    kept = [c for c in feeds.columns if c != body]
    rows = parsed.select(*kept, F.posexplode(items).alias("pos", "_i"))

    def value(name: str) -> Column:
        if name == "additional_image_link":
            return F.filter(F.transform(F.coalesce(F.col("_i").getField("g:additional_image_link"), F.array().cast("array<string>")), lambda s: X.stripped(s)), lambda s: s != "")
        return F.coalesce(X.first_filled(X.stripped(F.col("_i").getField(f"g:{name}")), X.stripped(F.col("_i").getField(name))), F.lit(""))

    return rows.where(value("title") != "").select(*kept, "pos", F.explode(F.array(_feed_row(value))).alias("raw"))


def _ddl(schema: T.StructType) -> str:
    def kind(t) -> str:
        if isinstance(t, T.StructType):
            return "struct<" + ",".join(f"`{f.name}`:{kind(f.dataType)}" for f in t.fields) + ">"
        return f"array<{kind(t.elementType)}>" if isinstance(t, T.ArrayType) else t.simpleString()

    return ", ".join(f"`{f.name}` {kind(f.dataType)}" for f in schema.fields)


def csv_feed(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Records of a CSV or TSV feed file with a header; additional pictures are split at commas, rows without a title go."""
    rows = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    have = set(rows.columns)

    def value(name: str) -> Column:
        if name == "additional_image_link":
            return F.filter(F.transform(F.split(X.stripped(name) if name in have else F.lit(""), ","), lambda s: X.stripped(s)), lambda s: s != "")
        return X.stripped(name) if name in have else F.lit("")

    return rows.where(value("title") != "").select(F.explode(F.array(_feed_row(value))).alias("raw"))


_TEXT_ROW = "array<map<string,string>>"


def text_feed(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Records of CSV or TSV feeds held in a column (TSV if the first line has a tab): additional pictures are split at commas, rows without a title go; bodies beyond the limit give none."""
    kept = [c for c in feeds.columns if c != body]
    kinds = ", ".join([*(f"`{c}` {feeds.schema[c].dataType.simpleString()}" for c in kept), f"_rows {_TEXT_ROW}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                text = (text or "").lstrip("\ufeff")
                rows = csv.DictReader(io.StringIO(text), delimiter="\t" if "\t" in text.partition("\n")[0] else ",")
                try:
                    found.append([[(k.strip(), v) for k, v in r.items() if k and isinstance(v, str)] for r in rows])
                except csv.Error:  # a field beyond the parser's limit: nothing of the feed is sure
                    found.append([])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.map_(pa.string(), pa.string())))], names=[*kept, "_rows"])

    rows = feeds.where(F.length(body) <= BODY_LIMIT).select(body, *kept).mapInArrow(run, kinds).select(*kept, F.posexplode("_rows").alias("pos", "_r"))

    def value(name: str) -> Column:
        text = X.stripped(F.col("_r")[name])
        return F.filter(F.transform(F.split(text, ","), lambda s: X.stripped(s)), lambda s: s != "") if name == "additional_image_link" else text

    return rows.where(value("title") != "").select(*kept, "pos", F.explode(F.array(_feed_row(value))).alias("raw"))


def feed_items(feeds: DataFrame, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """Records of captured feeds of either kind, told apart by content type, then by how the body begins."""
    xml = F.coalesce(is_xml(body, content_type if content_type in feeds.columns else F.lit("")), F.lit(False))
    return xml_feed(feeds.where(xml), body).unionByName(text_feed(feeds.where(~xml), body))


def sitemap_urls(sitemaps: DataFrame, body: str = "body") -> DataFrame:
    """``url`` of each location of sitemaps; indexes and malformed ones give none."""
    usable = sitemaps.where(~F.coalesce(F.col(body), F.lit("")).rlike("<(?:[a-z]+:)?sitemapindex"))
    text = F.regexp_replace(F.col(body), r"<(/?)[A-Za-z]+:(url|loc|urlset)\b", "<$1$2")
    parsed = usable.withColumn("_x", F.from_xml(text, "url array<struct<loc string>>"))
    kept = [c for c in sitemaps.columns if c != body]
    return parsed.select(*kept, F.explode("_x.url").alias("u")).select(*kept, X.stripped("u.loc").alias("url")).where("url <> ''")


def json_file(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file that holds a JSON list (or lines of objects): ``raw``."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"), F.transform(F.filter(F.split("value", "\n"), lambda s: F.trim(s) != ""), F.try_parse_json))).alias("raw")).where("raw is not null and not is_variant_null(raw)")
