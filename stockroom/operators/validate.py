"""Marketplace rules as data, exact duplicates and image checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockroom.functions import text as X

# What each marketplace requires, recommends and limits.
RULES = {
    "google_shopping": {"required": ("title", "price", "image_url", "product_url"), "recommended": ("gtin",), "longest": {"description": 5000, "title": 150}},
    "idealo": {"required": ("title", "price", "product_url", "image_url", "sku_or_external_id", "delivery_time", "delivery_cost"), "recommended": ("gtin",), "longest": {"title": 255}},
    "amazon": {"required": ("title", "price", "image_url", "gtin", "brand", "condition"), "recommended": (), "longest": {"title": 200, "description": 2000}},
    "ebay": {"required": ("title", "price", "image_url", "condition"), "recommended": ("gtin",), "longest": {"title": 80}},
}
#: Fields that any rule looks at.
FIELDS = tuple(sorted({f for r in RULES.values() for f in (*r["required"], *r["recommended"], *r["longest"])} - {"sku_or_external_id"} | {"sku", "external_id"}))
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp", "image/gif", "image/svg+xml", "image/avif", "image/bmp", "image/tiff")


def _value(products: DataFrame, field: str, vendor_is_brand: bool) -> Column:
    if field == "brand" and "brand" not in products.columns:
        return X.stripped("vendor") if vendor_is_brand and "vendor" in products.columns else F.lit("")
    return X.stripped(field) if field in products.columns else F.lit("")


def issues(products: DataFrame, marketplace: str, vendor_is_brand: bool = False) -> DataFrame:
    """``idx``, ``field``, ``error``, ``severity`` of each broken rule. One generated projection; an unknown marketplace raises ValueError."""
    if marketplace not in RULES:
        raise ValueError(f"unknown marketplace {marketplace!r}; known: {', '.join(RULES)}")
    rules = RULES[marketplace]
    issue = lambda field, error, severity="error": F.struct(F.lit(field).alias("field"), (F.lit(error) if isinstance(error, str) else error).alias("error"), F.lit(severity).alias("severity"))
    found = []
    for field in rules["required"]:
        if field == "sku_or_external_id":
            missing = (_value(products, "sku", False) == "") & (_value(products, "external_id", False) == "")
            found.append(F.when(missing, issue("sku/external_id", "sku or external_id is required")))
        else:
            found.append(F.when(_value(products, field, vendor_is_brand) == "", issue(field, f"{field} is required")))
    for field, most in rules["longest"].items():
        n = F.length(_value(products, field, False))
        found.append(F.when(n > most, issue(field, F.concat(F.lit("too long: "), n.cast("string"), F.lit(f" > {most}")))))
    found.append(F.when(F.col("price").try_cast("double") < 0, issue("price", "price is negative")))
    for field in rules["recommended"]:
        found.append(F.when(_value(products, field, False) == "", issue(field, f"{field} is recommended", "warning")))
    return products.select("idx", F.explode(F.array_compact(F.array(*found))).alias("x")).select("idx", "x.*")


def report(products: DataFrame, marketplace: str, vendor_is_brand: bool = False) -> DataFrame:
    """One row: total, valid, invalid (products with an error), warnings, pass_rate in percent (0 for no products)."""
    found = issues(products, marketplace, vendor_is_brand)
    per_product = found.groupBy("idx").agg(F.max((F.col("severity") == "error").cast("int")).alias("bad"), F.count_if(F.col("severity") == "warning").alias("w"))
    bad = per_product.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"))
    both = products.agg(F.count("*").alias("total")).join(F.broadcast(bad))
    valid = F.col("total") - F.col("invalid")
    return both.select("total", valid.alias("valid"), F.col("invalid").cast("long").alias("invalid"), F.col("warnings").cast("long").alias("warnings"), F.coalesce(F.round(F.try_divide(valid * 100, F.col("total")), 4), F.lit(0)).cast("decimal(9,4)").alias("pass_rate"))


def exact_duplicates(products: DataFrame, field: str) -> DataFrame:
    """``idx_a`` (the first with the value), ``idx_b``: each later row with the same stripped value; blanks never match.

    The first rows are found by a pre-aggregated groupBy and joined, so a value that holds a third of the rows is no single task's window.
    """
    rows = products.select("idx", X.stripped(field).alias("value")).where("value <> ''")
    first = rows.groupBy("value").agg(F.min("idx").alias("idx_a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, "value").where("idx > idx_a").select("idx_a", F.col("idx").alias("idx_b"), "value")


def image_issues(products: DataFrame, responses: DataFrame) -> DataFrame:
    """``idx``, ``error``: no address, status 400 or more, other content types, failures. ``responses``: image_url, status, content_type, failure, one row per address."""
    rows = products.select("idx", X.stripped("image_url").alias("image_url")).join(responses, "image_url", "left")
    kind = F.lower(F.trim(F.element_at(F.split(F.coalesce("content_type", F.lit("")), ";"), 1)))
    error = (
        F.when(F.col("image_url") == "", "no image address")
        .when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(F.col("status").isNotNull() & (kind != "") & ~kind.isin(*IMAGE_TYPES), F.concat(F.lit("content type "), kind))
    )
    return rows.select("idx", error.alias("error")).where("error is not null")
