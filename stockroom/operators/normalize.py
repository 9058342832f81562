"""Raw payloads of each dialect to the product schema, over VARIANT columns.

A dialect is one struct expression over ``raw`` (variant) and ``shop`` (address); rows without a title give null. Payloads of any shape give a result or null,
never an error: fields are read with ``try_variant_get`` and numbers with ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockroom.functions import text as X

VARIANT = "struct<variant_id:string,title:string,price:decimal(38,10),sku:string,in_stock:boolean>"
FIELDS = (
    ("external_id", "string"), ("title", "string"), ("description", "string"), ("price", "decimal(38,10)"), ("compare_at_price", "decimal(38,10)"), ("currency", "string"), ("image_url", "string"),
    ("product_url", "string"), ("sku", "string"), ("gtin", "string"), ("mpn", "string"), ("vendor", "string"), ("product_type", "string"), ("in_stock", "boolean"), ("condition", "string"),
    ("variants", f"array<{VARIANT}>"), ("tags", "array<string>"), ("additional_images", "array<string>"), ("category_path", "array<string>"),
)
PRODUCT = ", ".join(f"{n} {t}" for n, t in FIELDS)
#: Fixed order of the dialects' tests.
PLATFORMS = ("shopify", "woocommerce", "magento", "bigcommerce", "shopware", "generic")


def get(path: str, kind: str = "string", of: Column | str = "raw") -> Column:
    return F.try_variant_get(X.col(of), path, kind)


def _some(*columns: Column) -> Column:
    """The first value that isn't null or empty, else null."""
    return X.first_filled(*columns)


def _list(path: str, of: str = "raw") -> Column:
    return F.coalesce(get(path, "array<variant>", of), F.array().cast("array<variant>"))


def _strings(column: Column) -> Column:
    return F.filter(column, lambda s: s.isNotNull() & (s != ""))


def _plain(v: Column, key: str) -> Column:
    """The text under ``key`` of an object, or the element itself if it is plain."""
    whole = F.try_variant_get(v, "$", "string")
    return F.coalesce(F.try_variant_get(v, key, "string"), F.when(~whole.startswith("{") & ~whole.startswith("["), whole))


def _names(path: str, key: str = "$.name") -> Column:
    """The names of a list of objects or of plain texts."""
    return _strings(F.transform(_list(path), lambda v: _plain(v, key)))


def product(**columns: Column) -> Column:
    """The product struct; what isn't given has its default."""
    defaults = {"in_stock": F.lit(True), "description": F.lit(""), "image_url": F.lit(""), "external_id": F.lit(""), "price": F.lit(0)}
    empty = {"variants", "tags", "additional_images", "category_path"}
    out = []
    for name, kind in FIELDS:
        c = columns.get(name, defaults.get(name, F.array() if name in empty else F.lit(None)))
        c = F.coalesce(c.cast(kind), defaults[name].cast(kind)) if name in defaults else F.coalesce(c.cast(kind), F.array().cast(kind)) if name in empty else c.cast(kind)
        out.append(c.alias(name))
    return F.when(columns["title"] != "", F.struct(*out))


def _shop() -> Column:
    return F.regexp_replace(F.coalesce("shop", F.lit("")), "/+$", "")


def shopify() -> Column:
    first = F.get(_list("$.variants"), 0)
    of = lambda path, kind="string": F.try_variant_get(first, path, kind)
    images = _list("$.images")
    sources = F.transform(images, lambda v: _plain(v, "$.src"))
    variant = lambda v: F.struct(
        F.coalesce(F.try_variant_get(v, "$.id", "string"), F.lit("")).alias("variant_id"), F.coalesce(F.try_variant_get(v, "$.title", "string"), F.lit("")).alias("title"),
        F.coalesce(F.try_variant_get(v, "$.price", "string"), F.lit("0")).try_cast("decimal(38,10)").alias("price"), F.try_variant_get(v, "$.sku", "string").alias("sku"),
        F.coalesce(F.try_variant_get(v, "$.inventory_quantity", "long") > 0, F.lit(True)).alias("in_stock"),
    )
    variants = F.filter(F.transform(_list("$.variants"), variant), lambda v: v["price"].isNotNull())
    tags = F.when(get("$.tags", "array<string>").isNotNull(), _strings(get("$.tags", "array<string>"))).otherwise(_strings(F.transform(F.split(F.coalesce(get("$.tags"), F.lit("")), ","), lambda t: X.stripped(t))))
    kind = get("$.product_type")
    stock = (F.size(_list("$.variants")) == 0) | F.exists(_list("$.variants"), lambda v: F.coalesce(F.try_variant_get(v, "$.inventory_quantity", "long") > 0, F.lit(True)))
    return product(
        external_id=get("$.id"), title=X.stripped(get("$.title")), description=X.without_markup(get("$.body_html")), price=X.money(of("$.price")), compare_at_price=of("$.compare_at_price").try_cast("decimal(38,10)"),
        currency=F.coalesce(get("$._shop_currency"), F.lit("USD")), image_url=F.get(sources, 0), additional_images=_strings(F.slice(sources, 2, 100_000)),
        product_url=F.when(F.coalesce(get("$.handle"), F.lit("")) != "", F.concat(_shop(), F.lit("/products/"), get("$.handle"))).otherwise(F.col("shop")), sku=of("$.sku"), gtin=X.gtin(of("$.barcode")),
        vendor=get("$.vendor"), product_type=kind, in_stock=stock, variants=variants, tags=tags, category_path=F.when(kind != "", F.array(kind)),
    )


def woocommerce() -> Column:
    admin = (get("$._source") == "woocommerce_admin_api") | (F.try_variant_get("raw", "$.prices", "variant").isNull() & (F.schema_of_variant(F.try_variant_get("raw", "$.price", "variant")) == "STRING"))
    admin = F.coalesce(admin, F.lit(False))
    unit = F.coalesce(get("$.prices.currency_minor_unit", "int"), F.lit(2))
    scaled = lambda path: (get(path).try_cast("decimal(24,6)") / F.pow(F.lit(10), unit).cast("decimal(12,0)")).cast("decimal(38,10)")
    price = F.coalesce(F.when(admin, get("$.price").try_cast("decimal(38,10)")).otherwise(scaled("$.prices.price")), F.lit(0))
    regular = F.when(admin, get("$.compare_at_price").try_cast("decimal(38,10)")).otherwise(scaled("$.prices.regular_price"))
    sources = F.transform(_list("$.images"), lambda v: _plain(v, "$.src"))
    has = F.size(sources) > 0
    return product(
        external_id=get("$.id"), title=X.stripped(_some(get("$.title"), get("$.name"))), description=X.without_markup(get("$.description")), price=price, compare_at_price=F.when(regular != price, regular),
        currency=F.coalesce(F.when(admin, get("$.currency")).otherwise(get("$.prices.currency_code")), F.lit("USD")), image_url=F.when(has, F.get(sources, 0)).otherwise(get("$.image_url")),
        additional_images=F.when(has, _strings(F.slice(sources, 2, 100_000))).otherwise(get("$.additional_images", "array<string>")), product_url=F.coalesce(_some(get("$.permalink"), get("$.product_url")), F.lit("")), sku=get("$.sku"),
        gtin=X.gtin(_some(get("$.gtin"), get("$.ean"), get("$.barcode"))), mpn=_some(get("$.mpn")), tags=_names("$.tags"), category_path=_names("$.categories"),
    )


def magento() -> Column:
    attributes = F.filter(
        F.transform(_list("$.custom_attributes"), lambda v: F.struct(F.try_variant_get(v, "$.attribute_code", "string").alias("code"), F.try_variant_get(v, "$.value", "string").alias("value"))), lambda a: a["code"].isNotNull()
    )
    value = lambda *codes: F.element_at(F.filter(attributes, lambda a: a["code"].isin(*codes)), -1)["value"]  # noqa: E731  the last one counts
    last = lambda *codes: F.when(F.exists(attributes, lambda a: a["code"].isin(*codes)), value(*codes))
    path = F.coalesce(last("image"), F.lit(""))
    media = lambda p: F.concat(_shop(), F.lit("/media/catalog/product"), p)
    files = F.transform(F.filter(_list("$.media_gallery_entries"), lambda v: ~F.coalesce(F.try_variant_get(v, "$.disabled", "boolean"), F.lit(False))), lambda v: F.try_variant_get(v, "$.file", "string"))
    extra = F.transform(F.filter(_strings(files), lambda f: f != path), media)
    return product(
        external_id=F.coalesce(get("$.sku"), get("$.id")), title=X.stripped(get("$.name")), description=X.without_markup(last("description")), price=X.money(get("$.price")), currency=F.coalesce(get("$.currency"), F.lit("USD")),
        image_url=F.when(path != "", media(path)), additional_images=extra, product_url=F.when(F.coalesce(last("url_key"), F.lit("")) != "", F.concat(_shop(), F.lit("/"), last("url_key"), F.lit(".html"))).otherwise(F.col("shop")),
        sku=get("$.sku"), gtin=_some(last("ean", "gtin", "barcode")), mpn=_some(last("mpn")), vendor=_some(last("manufacturer")),
    )


def shopware() -> Column:
    price = X.money(get("$.price"))
    before = get("$.compare_at_price").try_cast("decimal(38,10)")
    variant = lambda v: F.struct(
        F.coalesce(_some(F.try_variant_get(v, "$.variant_id", "string"), F.try_variant_get(v, "$.id", "string")), F.lit("")).alias("variant_id"), F.coalesce(_some(F.try_variant_get(v, "$.title", "string"), F.try_variant_get(v, "$.name", "string")), F.lit("")).alias("title"),
        F.coalesce(F.try_variant_get(v, "$.price", "string"), F.lit("0")).try_cast("decimal(38,10)").alias("price"), F.try_variant_get(v, "$.sku", "string").alias("sku"), F.coalesce(F.try_variant_get(v, "$.in_stock", "boolean"), F.lit(True)).alias("in_stock"),
    )
    return product(
        external_id=_some(get("$.id"), get("$.sku")), title=X.stripped(_some(get("$.title"), get("$.name"))), description=X.without_markup(get("$.description")), price=price, compare_at_price=F.when(before != price, before),
        currency=F.coalesce(_some(get("$.currency")), F.lit("EUR")), image_url=get("$.image_url"), product_url=F.coalesce(_some(get("$.product_url")), F.col("shop")), sku=get("$.sku"), gtin=X.gtin(_some(get("$.gtin"), get("$.barcode"), get("$.ean"))),
        vendor=_some(get("$.vendor")), in_stock=get("$.in_stock", "boolean"), condition=_some(get("$.condition")), variants=F.filter(F.transform(_list("$.variants"), variant), lambda v: v["price"].isNotNull()),
        tags=get("$.tags", "array<string>"), additional_images=get("$.additional_images", "array<string>"), category_path=get("$.categories", "array<string>"),
    )


def google_feed() -> Column:
    price, sale = X.money(get("$.price")), X.money(get("$.sale_price"))
    reduced = (sale > 0) & (price > 0) & (sale < price)
    availability = F.replace(F.lower(F.coalesce(get("$.availability"), F.lit(""))), F.lit(" "), F.lit("_"))
    condition = F.lower(F.coalesce(get("$.condition"), F.lit("")))
    path = _strings(F.transform(F.split(F.coalesce(get("$.product_type"), F.lit("")), ">"), lambda c: X.stripped(c)))
    return product(
        external_id=get("$.id"), title=X.stripped(get("$.title")), description=X.without_markup(get("$.description")), price=F.when(reduced, sale).otherwise(price), compare_at_price=F.when(reduced, price),
        currency=F.coalesce(_some(get("$.currency")), F.lit("EUR")), image_url=get("$.image_link"), product_url=F.coalesce(_some(get("$.link")), F.col("shop")), sku=F.coalesce(get("$.id"), F.lit("")), gtin=X.gtin(get("$.gtin")), mpn=_some(get("$.mpn")),
        vendor=_some(get("$.brand")), product_type=F.get(path, 0), in_stock=(availability == "") | availability.contains("in_stock"),
        condition=F.when(condition.contains("new"), "NEW").when(condition.contains("refurbished"), "REFURBISHED").when(condition.contains("used"), "USED"), additional_images=get("$.additional_image_link", "array<string>"), category_path=path,
    )


# Names under which article numbers are given, in order of preference.
GTINS = ("gtin13", "gtin", "gtin14", "gtin12", "gtin8", "isbn")
PROPERTY_GTINS = ("gtin13", "gtin12", "gtin14", "gtin8", "gtin", "ean", "isbn")


def schema_org() -> Column:
    offer = F.when(get("$.offers[0]", "variant").isNotNull(), get("$.offers[0]", "variant")).otherwise(get("$.offers", "variant"))
    of = lambda path: F.try_variant_get(offer, path, "string")
    picture = lambda v: F.coalesce(_some(F.try_variant_get(v, "$.url", "string"), F.try_variant_get(v, "$.contentUrl", "string")), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    pictures = F.transform(F.coalesce(get("$.image", "array<variant>"), F.array(get("$.image", "variant"))), picture)
    properties = F.filter(
        F.transform(_list("$.additionalProperty"), lambda v: F.struct(F.lower(F.coalesce(_some(F.try_variant_get(v, "$.propertyID", "string"), F.try_variant_get(v, "$.name", "string")), F.lit(""))).alias("k"), F.try_variant_get(v, "$.value", "string").alias("v"))),
        lambda p: p["k"] != "",
    )
    has = lambda k: F.get(F.filter(properties, lambda p: p["k"] == k), 0)["v"]
    gtin = X.gtin(_some(*[get(f"$.{g}") for g in GTINS], *[of(f"$.{g}") for g in GTINS[:-1]], *[has(g) for g in PROPERTY_GTINS]))
    condition, available = F.coalesce(of("$.itemCondition"), F.lit("")), F.coalesce(of("$.availability"), F.lit(""))
    category = F.coalesce(get("$.category", "array<string>"), F.transform(F.split(F.coalesce(get("$.category"), F.lit("")), "[>/]"), lambda c: X.stripped(c)))
    return product(
        external_id=_some(get("$.sku"), get("$.productID"), gtin), title=X.stripped(get("$.name")), description=X.without_markup(get("$.description")), price=X.money(of("$.price")), currency=F.coalesce(of("$.priceCurrency"), F.lit("USD")),
        image_url=_some(F.get(pictures, 0), get("$.thumbnailUrl"), get('$["og:image"]')), additional_images=_strings(F.slice(pictures, 2, 100_000)), product_url=F.coalesce(get("$.url"), F.col("shop")), sku=_some(get("$.sku"), has("mpn")), gtin=gtin, mpn=_some(get("$.mpn"), of("$.mpn")),
        vendor=F.coalesce(get("$.brand.name"), F.when(F.schema_of_variant(get("$.brand", "variant")) == "STRING", get("$.brand"))), in_stock=(available == "") | available.contains("InStock"),
        condition=F.when(condition.contains("NewCondition"), "NEW").when(condition.contains("RefurbishedCondition"), "REFURBISHED").when(condition.contains("UsedCondition") | condition.contains("DamagedCondition"), "USED"),
        category_path=_strings(category),
    )


def opengraph() -> Column:
    og = lambda k: get(f'$["{k}"]')
    return product(
        external_id=F.coalesce(og("og:product_id"), og("product:retailer_item_id")), title=X.stripped(og("og:title")), description=X.without_markup(og("og:description")), price=X.money(_some(og("og:price:amount"), og("product:price:amount"))),
        currency=F.coalesce(_some(og("og:price:currency"), og("product:price:currency")), F.lit("USD")), image_url=og("og:image"), product_url=F.coalesce(og("og:url"), F.col("shop")), condition=_some(og("product:condition")),
        category_path=F.when(F.coalesce(og("product:category"), F.lit("")) != "", F.array(og("product:category"))),
    )


def direct() -> Column:
    price = X.stripped(F.regexp_replace(F.coalesce(get("$.price"), F.lit("0")), "[$€£]", ""))
    price = F.when(price.contains(",") & price.contains("."), F.replace(price, F.lit(","), F.lit(""))).otherwise(F.replace(price, F.lit(","), F.lit(".")))
    return product(
        external_id=F.coalesce(get("$.sku"), get("$.id")), title=X.stripped(_some(get("$.title"), get("$.name"), get("$.product_name"), get("$.heading"))), description=X.without_markup(get("$.description")), price=X.money(price),
        currency=F.coalesce(_some(get("$.currency"), get("$.price_currency")), F.lit("USD")), image_url=_some(get("$.image"), get("$.image_url"), get("$.src")), product_url=F.coalesce(_some(get("$.product_url"), get("$.url"), get("$.canonical")), F.col("shop")),
        sku=get("$.sku"), gtin=X.gtin(_some(get("$.gtin"), get("$.ean"), get("$.barcode"))), mpn=_some(get("$.mpn")),
    )


def generic() -> Column:
    """Feed row, then JSON-LD, then OpenGraph, then direct fields, told apart by the keys that are there."""
    has = lambda k: F.try_variant_get("raw", f'$["{k}"]', "variant").isNotNull()
    linked = has("name") & (has("offers") | F.coalesce(get('$["@type"]'), F.lit("")).contains("Product"))
    return F.when(get("$._source") == "google_feed", google_feed()).when(linked, schema_org()).when(has("og:title") | has("product:price:amount"), opengraph()).otherwise(direct())


def is_product(p: Column) -> Column:
    """Whether it has a price, a picture or an identifier."""
    return (p["price"] > 0) | X.filled(p["image_url"]) | (F.coalesce(p["sku"], F.lit("")) != "") | X.filled(p["external_id"])


def normalize(raws: DataFrame, platform: str = "generic", dialect=None) -> DataFrame:
    """The products of ``raws`` (raw variant, shop, other columns kept) with the product columns, ``platform`` and default condition NEW.

    Where all rows are of one known ``dialect`` (one of the functions above), only that is tried; else a platform's dialect that yields nothing falls through to the generic ones; rows that are no product are dropped. Null raws give none.
    """
    own = {"shopify": shopify, "woocommerce": woocommerce, "magento": magento, "shopware": shopware}.get(platform)
    if platform not in PLATFORMS:
        raise ValueError(f"unknown platform {platform!r}")
    product = dialect() if dialect else F.coalesce(own(), generic()) if own else generic()
    kept = [c for c in raws.columns if c not in ("raw",) and c not in dict(FIELDS)]
    # a generator, so that the optimizer builds the struct once and not once per column
    rows = raws.where("raw is not null").select(*kept, F.explode(F.array(product)).alias("p"))
    rows = rows.where(F.col("p").isNotNull() & is_product(F.col("p")))
    return rows.select(*kept, *[F.coalesce(F.col("p.condition"), F.lit("NEW")).alias(n) if n == "condition" else F.col(f"p.{n}") for n, _ in FIELDS], F.lit(platform).alias("platform"))
