"""Statistics of one catalogue. Products carry ``idx`` (their stable order) beside the product columns.

Null and blank fields count as missing, prices that are no positive number too; empty catalogues give zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockroom.functions import text as X

COMPLETE = ("title", "price", "image_url", "description", "vendor", "gtin")
BUCKETS = (0, 10, 25, 50, 100, 250, 500, 1000)


def priced(products: DataFrame) -> DataFrame:
    return products.withColumn("amount", X.positive("price").cast("decimal(20,6)"))


def has_image() -> Column:
    return X.filled("image_url") | (F.coalesce(F.size("additional_images"), F.lit(0)) > 0)


def completeness(products: DataFrame) -> Column:
    parts = [F.when(X.money("price") > 0, 1).otherwise(0) if c == "price" else X.filled(c).cast("int") for c in COMPLETE]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / F.lit(len(COMPLETE))


def catalog_stats(products: DataFrame) -> DataFrame:
    """One row: counts of all, in stock, out of stock, with image and with article number, price range, mean and median, completeness. One pass, map-side combined."""
    stock = F.coalesce(F.col("in_stock"), F.lit(True))
    rows = priced(products).withColumn("complete", completeness(products))
    zero = lambda c, scale: F.coalesce(F.round(c, scale), F.lit(0)).cast(f"decimal(20,{scale})")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(stock).alias("in_stock"),
        F.count_if(~stock).alias("out_of_stock"),
        F.count_if(has_image()).alias("has_images"),
        F.count_if(X.filled("gtin")).alias("has_gtin"),
        zero(F.min("amount"), 2).alias("price_min"),
        zero(F.max("amount"), 2).alias("price_max"),
        zero(F.avg("amount"), 2).alias("price_avg"),
        zero(F.median("amount").cast("decimal(20,6)"), 2).alias("price_median"),
        zero(F.avg(F.col("complete").cast("decimal(20,10)")), 4).alias("completeness"),
    )


def count_field(products: DataFrame, field: str) -> DataFrame:
    """``value``, ``n``, ``first_idx`` of a field's stripped values, blank ones skipped; order by n descending, then first_idx."""
    return products.select(X.stripped(field).alias("value"), "idx").where("value <> ''").groupBy("value").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def count_categories(products: DataFrame) -> DataFrame:
    """Counts of all path elements and product types: ``value``, ``n``."""
    path = F.filter(F.coalesce("category_path", F.array().cast("array<string>")), lambda c: c != "")
    kind = X.stripped("product_type")
    values = F.concat(path, F.when(kind != "", F.array(kind)).otherwise(F.array().cast("array<string>")))
    return products.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def price_distribution(products: DataFrame, edges: tuple = BUCKETS) -> DataFrame:
    """``bucket``, ``lower``, ``n``: histogram over [lower, next) with an open last bucket; empty buckets stay, prices below the first go."""
    edges = tuple(sorted(edges))
    label = lambda i: f"{edges[i]}-{edges[i + 1]}" if i + 1 < len(edges) else f"{edges[i]}+"
    amount = F.col("amount")
    number = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        number = F.when(amount >= e, i).otherwise(number)
    counts = priced(products).select(number.alias("i")).where("i is not null").groupBy("i").agg(F.count("*").alias("n"))
    frame = products.sparkSession.createDataFrame([(i, label(i), float(e)) for i, e in enumerate(edges)], "i int, bucket string, lower double")
    return frame.join(counts, "i", "left").select("bucket", "lower", F.coalesce("n", F.lit(0)).alias("n"))


def outliers(products: DataFrame, multiplier: float = 2.0) -> DataFrame:
    """Products whose price lies more than ``multiplier`` sample deviations from the mean; none with fewer than two prices or no deviation."""
    rows = priced(products).where("amount is not null")
    stats = rows.agg(F.count("*").alias("k"), F.avg(F.col("amount").cast("double")).alias("mean"), F.stddev_samp(F.col("amount").cast("double")).alias("sd"))
    return rows.join(F.broadcast(stats)).where((F.col("k") > 1) & (F.col("sd") > 0) & (F.abs(F.col("amount").cast("double") - F.col("mean")) > multiplier * F.col("sd"))).drop("k", "mean", "sd")


def brand_breakdown(products: DataFrame) -> DataFrame:
    """``value``, ``n``, ``share``: percent of the products with a vendor."""
    counts = count_field(products, "vendor")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("value", "n", F.round(F.col("n") * 100 / F.col("total"), 2).cast("decimal(9,2)").alias("share"))


def quality(products: DataFrame) -> DataFrame:
    """``products`` with ``quality``: 0 without a title, else 0.4 and 0.15 for each of price, image, description and sku, at most 1."""
    signals = [X.money("price") > 0, X.filled("image_url"), X.filled("description"), X.filled("sku")]
    total = F.lit(40)
    for s in signals:
        total = total + F.when(s, 15).otherwise(0)
    return products.withColumn("quality", (F.when(~X.filled("title"), 0).otherwise(F.least(total, F.lit(100))) / 100).cast("decimal(5,2)"))


def batch_quality(products: DataFrame) -> DataFrame:
    return quality(products).agg(F.coalesce(F.round(F.avg("quality"), 4), F.lit(0)).cast("decimal(9,4)").alias("quality"), F.count("*").alias("products"))


# --- several catalogues -----------------------------------------------------------------------------------------------------


def brand_coverage(catalogs: DataFrame, stores: list[str]) -> DataFrame:
    """Brand by store counts, zero-filled; ``stores`` fixes the columns, so a store without brands keeps its own."""
    rows = catalogs.select(X.stripped("vendor").alias("brand"), "store").where("brand <> ''")
    return rows.groupBy("brand").agg(*[F.count_if(F.col("store") == s).alias(s) for s in stores])


def coverage_long(catalogs: DataFrame) -> DataFrame:
    """The same in long form, for any number of stores: brand, store, n (cells above zero)."""
    return catalogs.select(X.stripped("vendor").alias("brand"), "store").where("brand <> ''").groupBy("brand", "store").agg(F.count("*").alias("n"))


def price_positions(matches: DataFrame) -> DataFrame:
    """Where own prices stand: ``matches`` has idx, price (own) and competitor_price; unmatched products have null there.

    Per idx: rank (1 and the number of cheaper ones), of, percentile, market mean, min and max over own and competitors' prices. A product without a valid own price has zeros.
    """
    own, other = F.col("price"), F.col("competitor_price")
    g = matches.groupBy("idx").agg(F.first("price").alias("own"), F.count("competitor_price").alias("k"), F.count_if(other < own).alias("cheaper"), F.sum("competitor_price").alias("s"), F.min("competitor_price").alias("lo"), F.max("competitor_price").alias("hi"))
    n = F.col("k") + 1
    valid = F.coalesce(F.col("own") > 0, F.lit(False))
    give = lambda c, scale: F.when(valid, F.round(c, scale)).otherwise(0).cast(f"decimal(20,{scale})")
    return g.select(
        "idx",
        F.when(valid, F.col("cheaper") + 1).otherwise(0).cast("long").alias("rank"),
        F.when(valid, n).otherwise(0).cast("long").alias("of"),
        give((1 - F.col("cheaper") / n) * 100, 1).alias("percentile"),
        give((F.coalesce("s", F.lit(0)) + F.col("own")) / n, 2).alias("market_avg"),
        give(F.least("lo", "own"), 2).alias("market_min"),
        give(F.greatest("hi", "own"), 2).alias("market_max"),
    )


def assortment_gaps(mine: DataFrame, others: DataFrame) -> DataFrame:
    """``kind`` (brand or category) and ``value`` that competitors have and ``mine`` hasn't."""

    def values(df: DataFrame) -> DataFrame:
        brands = df.select(F.lit("brand").alias("kind"), X.stripped("vendor").alias("value"))
        kinds = df.select(F.lit("category").alias("kind"), X.stripped("product_type").alias("value"))
        return brands.unionByName(kinds).where("value <> ''").distinct()

    return values(others).join(values(mine), ["kind", "value"], "left_anti")


def top(df: DataFrame, n: int, *orders, by: tuple[str, ...] = ()) -> DataFrame:
    """The first ``n`` rows in the given order, of each group if ``by`` names any. Orders should end in a key, so that ties have one result."""
    if not by:
        return df.orderBy(*orders).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*orders))).where(F.col("_n") <= n).drop("_n")
