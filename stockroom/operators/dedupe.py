"""Merging of raw products within a page or a source."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stockroom.functions import text as X


def filled(columns: list[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + X.filled(c).cast("int")
    return total


def same_offers(products: DataFrame, fields: list[str], by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Of rows with the same name, price and sku (within ``by``) the one with most filled ``fields``, first of ties. Pre-aggregated per key."""
    key = F.md5(F.concat_ws(":", X.key("name"), F.coalesce("price", F.lit("")), F.coalesce("sku", F.lit(""))))
    rows = products.withColumn("_key", key).withColumn("_filled", filled(fields))
    best = rows.groupBy(*by, "_key").agg(F.max_by(F.struct(*products.columns), F.struct("_filled", (-F.col("idx")).alias("i"))).alias("x"))
    return best.select("x.*")


def _close(a: str, b: str) -> bool:
    """Whether two titles name one product: one begins with the other, or their ratio is above 0.9."""
    if a.startswith(b) or b.startswith(a):
        return True
    if 2 * min(len(a), len(b)) <= 0.9 * (len(a) + len(b)):
        return False
    m = SequenceMatcher(None, a, b)
    return m.quick_ratio() > 0.9 and m.ratio() > 0.9


def _leaders(titles: pa.Table) -> pa.Table:
    """For each title of a page (in order of its first row) the first row of the earliest leading title that it is close to; a title close to none leads."""
    titles = titles.sort_by("first")
    leading: list[tuple[str, int]] = []
    found = []
    for t, first in zip(titles.column("t").to_pylist(), titles.column("first").to_pylist()):
        home = next((i for name, i in leading if _close(name, t)), None)
        if home is None:
            leading.append((t, first))
        found.append(first if home is None else home)
    return titles.append_column("lead", pa.array(found, pa.int64()))


def merge_chunks(products: DataFrame, fields: list[str], by: str = "page_id") -> DataFrame:
    """Products of one page read in overlapping chunks, merged: a title belongs to the earliest (by idx) leading title of the page that equals it, begins it or begins with it, or has a ratio above 0.9.

    The leading row stays, and its empty ``fields`` are filled with the first value among its rows. Products without a title go. Equal titles of a page are one before titles are
    compared, so that only distinct ones meet in one task.
    """
    rows = products.withColumn("_t", X.key("title")).where("_t <> ''")
    titles = rows.groupBy(F.col(by).alias("page"), F.col("_t").alias("t")).agg(F.min(F.col("idx").cast("long")).alias("first"))
    leads = titles.groupBy("page").applyInArrow(_leaders, f"page {products.schema[by].dataType.simpleString()}, t string, first long, lead long")
    joined = rows.join(leads, F.col(by).eqNullSafe(F.col("page")) & (F.col("_t") == F.col("t")))
    has = lambda f: F.col(f).isNotNull() & (F.col(f).cast("string") != "")
    fill = [F.min_by(f, F.when(has(f), F.col("idx"))).alias(f"_{f}") for f in fields]
    merged = joined.groupBy("page", "lead").agg(F.min_by(F.struct(*products.columns), "idx").alias("x"), *fill)
    return merged.select(*[F.coalesce(f"_{c}", f"x.{c}").alias(c) if c in fields else F.col(f"x.{c}").alias(c) for c in products.columns])
