"""Sinks: CSV, JSON, marketplace feeds, Parquet, snapshots. Each writes by partition; single-file feeds are an option, not the rule."""

from __future__ import annotations

import html
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stockroom.functions import text as X

IDEALO = ("sku", "brand", "title", "product_url", "price", "delivery_time", "delivery_cost", "gtin", "image_url", "category", "description", "condition")
GOOGLE = ("id", "title", "description", "link", "image_link", "price", "availability", "gtin", "brand", "condition", "mpn")


def flat(products: DataFrame) -> DataFrame:
    """All columns as text: lists joined by ``; ``, structs as JSON, null as blank, timestamps as ISO 8601."""

    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "array<string>":
            return X.joined(c)
        if kind.startswith(("array", "struct", "map", "variant")):
            return F.coalesce(F.to_json(c), F.lit(""))
        if kind == "timestamp":
            return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit(""))
        return F.coalesce(c.cast("string"), F.lit(""))

    return products.select(*[one(c, k).alias(c) for c, k in products.dtypes])


def to_csv(products: DataFrame, path: str, single: bool = False, sep: str = ",") -> None:
    df = flat(products)
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def plain_json(products: DataFrame) -> DataFrame:
    """Money as text and instants as ISO 8601, as JSON wants them."""
    texts = {c: F.col(c).cast("string") for c, k in products.dtypes if k.startswith("decimal")}
    return products.withColumns(texts | {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for c, k in products.dtypes if k == "timestamp"})


def json_texts(products: DataFrame, indent: int = 2) -> DataFrame:
    """``item``: each product as indented JSON, null fields and letters beyond ASCII kept."""
    texts = plain_json(products).select(F.to_json(F.struct(*products.columns), {"ignoreNullFields": "false"}).alias("item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = " " * indent
        for batch in batches:
            laid = [pad + json.dumps(json.loads(t), ensure_ascii=False, indent=indent).replace("\n", "\n" + pad) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(laid, pa.string())], names=["item"])

    return texts.mapInArrow(run, "item string")


def to_json(products: DataFrame, path: str, array: bool = False, indent: int = 2) -> None:
    """One JSON object per line, or with ``array`` one indented list per file; money as text."""
    if array:
        _framed(json_texts(products, indent), "[", "]", ",").write.mode("overwrite").text(path)
    else:
        plain_json(products).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def to_frame(products: DataFrame):
    """The products as a pandas frame, for catalogues that fit into the driver."""
    return products.toPandas()


def _framed(items: DataFrame, head: str, tail: str, between: str = "") -> DataFrame:
    """Lines of files each of which is whole: per partition the head, the items (``between`` behind all but the last) and the tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lambda xs: pa.RecordBatch.from_arrays([pa.array(xs, pa.string())], names=["item"])
        yield lines([head])
        held: str | None = None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                whole = [t + between for t in ([held] if held is not None else []) + texts[:-1]]
                held = texts[-1]
                yield lines(whole)
        yield lines([*([held] if held is not None else []), tail])

    if items.isEmpty():  # no partition, no file
        return items.sparkSession.createDataFrame([(f"{head}\n{tail}",)], "item string").coalesce(1)
    return items.mapInArrow(run, "item string")


def to_parquet(products: DataFrame, path: str, *partition_by: str) -> None:
    products.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def _field(products: DataFrame, *names: str) -> Column:
    have = [X.stripped(n) for n in names if n in products.columns]
    return F.coalesce(X.first_filled(*have), F.lit("")) if have else F.lit("")


def google_fields(products: DataFrame, vendor_is_brand: bool = False) -> DataFrame:
    """The eleven fields of a Google Shopping item."""
    stock = F.coalesce(F.col("in_stock"), F.lit(True)) if "in_stock" in products.columns else F.lit(True)
    values = {
        "id": _field(products, "external_id", "sku"), "title": _field(products, "title"), "description": _field(products, "description"), "link": _field(products, "product_url"), "image_link": _field(products, "image_url"),
        "price": F.trim(F.concat_ws(" ", _field(products, "price"), _field(products, "currency"))), "availability": F.when(stock, "in stock").otherwise("out of stock"), "gtin": _field(products, "gtin"),
        "brand": _field(products, "brand", *["vendor"] * vendor_is_brand), "condition": F.lower(_field(products, "condition")), "mpn": _field(products, "mpn"),
    }
    return products.select(*[values[g].alias(g) for g in GOOGLE])


def escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def google_items(products: DataFrame, vendor_is_brand: bool = False) -> DataFrame:
    """``item``: the RSS item of each product; empty fields are left out."""
    f = google_fields(products, vendor_is_brand)
    parts = [F.when(F.col(c) != "", F.concat(F.lit(f"<g:{c}>"), escaped(F.col(c)), F.lit(f"</g:{c}>"))) for c in GOOGLE]
    return f.select(F.concat(F.lit("<item>"), F.concat_ws("", *parts), F.lit("</item>")).alias("item"))


def idealo_rows(products: DataFrame) -> DataFrame:
    """The twelve columns of an idealo feed; the article's number is the sku or the external id."""
    names = {"sku": ("sku", "external_id"), "brand": ("brand",), "category": ("product_type",)}
    return products.select(*[_field(products, *names.get(c, (c,))).alias(c) for c in IDEALO])


def to_feed(products: DataFrame, path: str, kind: str, title: str = "Products", single: bool = False) -> None:
    """A marketplace feed; an unknown kind raises ValueError. Each partition writes a whole file of its own; ``single`` puts small catalogues into one file."""
    products = products.coalesce(1) if single else products
    if kind == "idealo":
        idealo_rows(products).write.mode("overwrite").option("header", True).option("sep", "\t").option("emptyValue", "").csv(path)
    elif kind == "google_shopping":
        head = f'<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0" xmlns:g="http://base.google.com/ns/1.0"><channel><title>{html.escape(title, quote=False)}</title>'
        _framed(google_items(products), head, "</channel></rss>").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown feed {kind!r}; known: google_shopping, idealo")


def append_snapshot(products: DataFrame, path: str, domain: str, taken_at: Column | None = None) -> str:
    """Appends a snapshot of a domain's products, partitioned by domain and snapshot; gives the snapshot's id."""
    ident = uuid.uuid4().hex
    rows = products.withColumns({"domain": F.lit(domain), "snapshot_id": F.lit(ident), "created_at": F.current_timestamp() if taken_at is None else taken_at})
    rows.write.mode("append").partitionBy("domain", "snapshot_id").parquet(path)
    return ident
