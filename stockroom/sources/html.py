"""Products in captured HTML pages: JSON-LD, OpenGraph, markdown text, CSS-like selection; and the layers combined.

Attribute and entity handling needs a real parser, so tags are read by the standard library's in Arrow batches; everything behind it is expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stockroom.functions import text as X
from stockroom.sources.payloads import BODY_LIMIT

# Personal data that reviews bring along.
PERSONAL = ("review", "reviews", "author", "creator", "contributor", "editor", "reviewedBy", "comment", "email", "telephone", "address", "contactPoint")
_PAGE = ("WebPage", "ItemPage", "CollectionPage")


class _Page(HTMLParser):
    """Collects ld+json blocks, meta properties and the elements of a product card."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.meta: dict[str, str] = {}
        self._block: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self._block = []
        elif tag == "meta" and a.get("property", "").startswith(("og:", "product:")) and a.get("content"):
            self.meta[a["property"]] = a["content"]

    handle_startendtag = handle_starttag

    def handle_data(self, data):
        if self._block is not None:
            self._block.append(data)

    def handle_endtag(self, tag):
        if tag == "script" and self._block is not None:
            self.blocks.append("".join(self._block))
            self._block = None


class _Cards(HTMLParser):
    """Fields of product cards: elements whose itemtype names a Product, of class ``product`` or with ``data-product``."""

    _VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cards: list[dict[str, str]] = []
        self._open: list[tuple[str, str | None, dict | None]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        names = set(a.get("class", "").split())
        card = {} if "Product" in a.get("itemtype", "") or "product" in names or "data-product" in a else None
        if card is not None:
            self.cards.append(card)
        field = a.get("itemprop") if a.get("itemprop") in ("name", "price", "image", "sku", "description") else next((f for f in ("title", "name", "price", "sku", "description") if f in names), None)
        now = card if card is not None else next((c for _, _, c in reversed(self._open) if c is not None), None)
        if now is not None:
            if tag == "img" and a.get("src"):
                now.setdefault("image", a["src"])
            elif field and a.get("content"):
                now.setdefault(field, a["content"])
                field = None
        if tag not in self._VOID:
            self._open.append((tag, field, now))

    handle_startendtag = handle_starttag

    def handle_data(self, data):
        for tag, field, card in reversed(self._open):
            if card is not None and field:
                if data.strip():
                    card[field] = (card.get(field, "") + " " + data.strip()).strip()
                return

    def handle_endtag(self, tag):
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                del self._open[i:]
                return


def _parsed(parser: HTMLParser, html: str | None):
    try:
        parser.feed(html or "")
        parser.close()
    except Exception:  # a page that can't be read has what came before
        pass
    return parser


def page_parts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``blocks`` (ld+json texts) and ``og`` (map of og:/product: properties, the last value of each); pages beyond the size limit have none."""
    kept = [c for c in pages.columns if c not in ("blocks", "og")]
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_parsed(_Page(), t if t is not None and len(t) <= BODY_LIMIT else "") for t in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            blocks = pa.array([p.blocks for p in found], pa.list_(pa.string()))
            og = pa.array([list(p.meta.items()) for p in found], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, blocks, og], names=[*kept, "blocks", "og"])

    return pages.select(*kept).mapInArrow(run, f"{kinds}, blocks array<string>, og map<string,string>")


def _type(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, '$["@type"]', "string"), F.lit(""))


def _is(v: Column, *words: str) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | _type(v).contains(w)
    return found


def _items(v: Column, path: str) -> Column:
    """The list at ``path``, or the single object there as a list."""
    one = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


def json_ld(parts: DataFrame) -> DataFrame:
    """Products of the ld+json blocks: ``parts`` without blocks, with ``pos`` and ``raw`` (variant without personal data; a group without a price has its first priced variant's offer)."""
    v = F.try_parse_json("block")
    blocks = parts.select(*[c for c in parts.columns if c not in ("blocks", "html")], F.posexplode("blocks").alias("b", "block")).withColumn("v", v).where("v is not null")
    graph = _items(F.col("v"), '$["@graph"]')
    nested = lambda x: F.concat(*[_items(x, f"$.{k}") for k in ("mainEntity", "mainEntityOfPage")])
    from_graph = F.flatten(F.transform(graph, lambda x: F.when(_is(x, "Product"), F.array(x)).when(_is(x, *_PAGE), F.filter(nested(x), lambda y: _is(y, "Product"))).otherwise(F.array().cast("array<variant>"))))
    listed = F.filter(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: _is(x, "Product"))
    found = F.when(_is(F.col("v"), "Product"), F.array("v")).when(F.size(graph) > 0, from_graph).otherwise(listed)
    rows = blocks.select(*[c for c in blocks.columns if c not in ("v", "block")], F.posexplode(found).alias("i", "raw0"))
    priced = lambda o: F.coalesce(F.try_variant_get(o, "$.price", "string").try_cast("double") > 0, F.coalesce(F.try_variant_get(o, "$.price", "string"), F.lit("")) != "")
    offers = F.flatten(F.transform(_items(F.col("raw0"), "$.hasVariant"), lambda x: _items(x, "$.offers")))
    lacks = (F.col("kind") == "ProductGroup") & ~F.exists(_items(F.col("raw0"), "$.offers"), priced)
    rows = rows.withColumn("kind", _type(F.col("raw0"))).withColumn("offer", F.when(lacks, F.get(F.filter(offers, priced), 0)))
    kept = F.map_filter(F.coalesce(F.try_variant_get("raw0", "$", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), lambda k, x: ~k.isin(*PERSONAL) & ~((k == "offers") & F.col("offer").isNotNull()))
    whole = F.when(F.col("offer").isNotNull(), F.map_concat(kept, F.create_map(F.lit("offers"), F.col("offer")))).otherwise(kept)
    return rows.withColumn("fields", whole).withColumn("raw", F.to_variant_object("fields")).withColumn("pos", F.shiftleft(F.col("b").cast("long"), 32) + F.col("i")).drop("b", "i", "raw0", "kind", "offer")


# --- prices and titles in text ------------------------------------------------------------------------------------------------

# Currencies, their signs, and words of lines whose price is not the product's.
CODES = frozenset(
    "USD EUR GBP JPY CAD AUD NZD CHF SEK NOK DKK PLN CZK HUF INR KRW BRL RUB HKD SGD MXN ZAR TRY THB MYR PHP IDR TWD AED SAR CNY VND BGN RON HRK ILS CLP COP PEN ARS UAH KZT QAR KWD BHD OMR JOD EGP NGN KES".split()
)
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW", "₽": "RUB", "R$": "BRL", "kr": "SEK", "zł": "PLN", "CHF": "CHF", "A$": "AUD", "C$": "CAD", "NZ$": "NZD", "HK$": "HKD", "S$": "SGD"}
NOISE = ("shipping", "subtotal", "total", "tax", "discount", "coupon", "cart", r"was\s+\$", "original", "compare", "regular", r"list\s+price", r"you\s+save", "msrp", "rrp", r"from\s+\$", r"starting\s+at", r"add\s+to", r"rug\s+pad", r"protection\s+plan", "warranty", "accessory", r"free\s+shipping", "estimated", r"per\s+month", r"\/month", "installment")
_NOISY = r"(?i)\b(?:" + "|".join(NOISE) + r")\b"
#: An amount: digits, groups of three behind a separator, one or two decimals.
_AMOUNT = r"\d+(?:[.,\s]\d{3}(?!\d))*(?:[.,]\d{1,2}(?!\d))?"
_BEFORE = "|".join(re.escape(s) for s in sorted(SIGNS, key=lambda s: -len(s)))
#: Signs that also stand behind an amount.
_BEHIND = "|".join(s for s in SIGNS if s in "€£¥₹₩₽" or s in ("kr", "zł"))


def _offer(said: Column) -> Column:
    """Price (two decimals, null outside of (0, 1000000]) and currency of a piece of text: an amount with a sign or code around it. Decimals stand behind a comma if exactly two digits do, else behind a point."""
    digits = F.regexp_replace(F.regexp_extract(said, _AMOUNT, 0), r"\s", "")
    comma = digits.rlike(r",\d{2}$")
    amount = F.translate(F.when(comma, F.translate(digits, ".", "")).otherwise(F.translate(digits, ",", "")), ",", ".").try_cast("decimal(20,2)")
    code = F.regexp_extract(said, r"(?:^|\d\s*\S{0,2}\s+)([A-Z]{3})(?![A-Z])", 1)
    sign = F.coalesce(*[F.when(s != "", s) for s in (F.regexp_extract(said, rf"^({_BEFORE})\s*\d", 1), F.regexp_extract(said, rf"\d\s*({_BEHIND})", 1))])
    of_sign = F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair])
    return F.struct(F.when((amount > 0) & (amount <= 1_000_000), amount.cast("string")).alias("price"), F.when(code.isin(*sorted(CODES)), code).otherwise(of_sign[sign]).alias("currency"))


def text_price(text: Column | str) -> Column:
    """The first credible price of a text (``price``, null if there is none) and its ``currency``: one behind a known currency code, else the first on a line that is about no other price."""
    text = F.coalesce(X.col(text), F.lit(""))
    coded = F.regexp_extract_all(text, F.lit(rf"\b(?:{'|'.join(sorted(CODES))})\s+{_AMOUNT}"), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(_NOISY))
    plain = F.flatten(F.transform(lines, lambda line: F.regexp_extract_all(line, F.lit(rf"(?:(?:{_BEFORE})\s*)?{_AMOUNT}(?:\s*(?:{_BEHIND}))?(?:\s+[A-Z]{{3}}(?![A-Za-z]))?"), F.lit(0))))
    offers = F.transform(F.concat(coded, plain), _offer)
    none = F.struct(F.lit(None).cast("string").alias("price"), F.lit(None).cast("string").alias("currency"))
    return F.coalesce(F.get(F.filter(offers, lambda o: o["price"].isNotNull()), 0), none)


def text_title(c: Column | str) -> Column:
    """The title of a markdown text: first heading, second-level heading or bold start of a line, of 3 to 300 characters; else null."""
    found = [X.stripped(F.regexp_extract(X.col(c), p, 1)) for p in (r"(?m)^#\s+(.+)$", r"(?m)^##\s+(.+)$", r"(?m)^\*\*(.+?)\*\*")]
    return F.coalesce(*[F.when((F.length(f) >= 3) & (F.length(f) <= 300), f) for f in found])


def css_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """Product cards of pages as raw records of the direct dialect, by the usual marks of cards: the page's columns, ``pos`` and ``raw``."""
    return _records(pages, html, _Cards)


_PART = re.compile(r"""([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)""")
_CONDITION = re.compile(r"""([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]*))\s*)?\]""")
_TESTS = {"=": str.__eq__, "*=": str.__contains__, "^=": str.startswith, "$=": str.endswith, "~=": lambda have, want: want in have.split()}


def selector(text: str) -> list[list[tuple[str, list]]]:
    """A selector as alternatives of chains of (tag, conditions), a chain's parts being ancestors; tags, classes, ids, attributes and blanks are known, anything else raises ValueError."""
    found = []
    for choice in text.split(","):
        chain = []
        for part in choice.split():
            m = _PART.fullmatch(part)
            if not m or not part:
                raise ValueError(f"selector {text!r} isn't known")
            tests = [("class", "~=", n) if kind == "." else ("id", "=", n) if kind == "#" else (attribute, op or "", a or b or c) for kind, n, attribute, op, a, b, c in _CONDITION.findall(m.group(2))]
            chain.append((m.group(1) or "*", tests))
        if chain:
            found.append(chain)
    if not found:
        raise ValueError("an empty selector")
    return found


def _meets(tag: str, attributes: dict[str, str], part: tuple[str, list]) -> bool:
    return part[0] in ("*", tag) and all(name in attributes and (not op or _TESTS[op](attributes[name], want)) for name, op, want in part[1])


def _selected(path: list[tuple[str, dict]], chains: list) -> bool:
    """Whether the last element of a path from the root is selected."""
    for chain in chains:
        if not _meets(*path[-1], chain[-1]):
            continue
        left = len(chain) - 1
        for element in reversed(path[:-1]):
            if left and _meets(*element, chain[left - 1]):
                left -= 1
        if not left:
            return True
    return False


class _Selected(HTMLParser):
    """Fields of the elements that a schema selects."""

    def __init__(self, base: list, fields: list[tuple[str, list, str | None]]):
        super().__init__(convert_charrefs=True)
        self.base, self.fields = base, fields
        self.cards: list[dict[str, str]] = []
        self._path: list[tuple[str, dict]] = []
        self._open: list[tuple[int, dict]] = []  # depth and record of the open base elements
        self._texts: list[tuple[int, dict, str]] = []  # depth, record and field of the texts that are being read

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in attrs}
        self._path.append((tag, attributes))
        depth = len(self._path)
        if _selected(self._path, self.base):
            self.cards.append({})
            self._open.append((depth, self.cards[-1]))
        if self._open:
            start, card = self._open[-1]
            for name, chains, attribute in self.fields:
                if name not in card and _selected(self._path[start - 1 :], chains):
                    if attribute is None:
                        card[name] = ""
                        self._texts.append((depth, card, name))
                    elif attributes.get(attribute):
                        card[name] = attributes[attribute]
        if tag in _Cards._VOID:
            self._close(depth)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _Cards._VOID:
            self._close(len(self._path))

    def _close(self, depth: int) -> None:
        del self._path[depth - 1 :]
        self._open = [x for x in self._open if x[0] < depth]
        self._texts = [x for x in self._texts if x[0] < depth]

    def handle_data(self, data):
        if data.strip():
            for _, card, name in self._texts:
                card[name] = f"{card[name]} {data.strip()}".strip()

    def handle_endtag(self, tag):
        for i in range(len(self._path) - 1, -1, -1):
            if self._path[i][0] == tag:
                return self._close(i + 1)


def css_select(pages: DataFrame, schema: dict, html: str = "html") -> DataFrame:
    """Records of pages by a schema of selectors: the page's columns, ``pos`` and ``raw``.

    ``schema``: ``baseSelector`` and ``fields``, each with ``name``, ``selector``, ``type`` (``text`` or ``attribute``) and, for attributes, ``attribute``. A field is the first match within its
    record, records inside records take their own fields, and records without any field go. Unknown selectors raise ValueError.
    """
    base = selector(schema["baseSelector"])
    fields = [(f["name"], selector(f["selector"]), f["attribute"] if f.get("type") == "attribute" else None) for f in schema["fields"]]
    return _records(pages, html, lambda: _Selected(base, fields))


def _records(pages: DataFrame, html: str, parser) -> DataFrame:
    kept = [c for c in pages.columns if c != html]
    kinds = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), "cards array<map<string,string>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cards = [[list(c.items()) for c in _parsed(parser(), t).cards if any(c.values())] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(cards, pa.list_(pa.map_(pa.string(), pa.string())))], names=[*kept, "cards"])

    found = pages.select(html, *kept).mapInArrow(run, kinds)
    return found.select(*kept, F.posexplode("cards").alias("pos", "card")).select(*kept, "pos", F.to_variant_object("card").alias("raw"))


def best_image(images: Column | str) -> Column:
    """The address of the picture with the highest score of array<struct<src, score>>, first of ties; null without one."""
    usable = F.filter(X.col(images), lambda i: F.coalesce(i["src"], F.lit("")) != "")
    ranked = F.transform(usable, lambda i, n: F.struct(F.coalesce(i["score"], F.lit(0)).alias("s"), (-n).alias("n"), i["src"].alias("src")))
    return F.array_max(ranked)["src"]


def merged_og(metadata: Column | str, page: Column | str) -> Column:
    """OpenGraph of crawl metadata (``og:`` keys with a value), gaps filled from the page's."""
    first = F.map_filter(F.coalesce(X.col(metadata), F.create_map().cast("map<string,string>")), lambda k, v: k.startswith("og:") & (F.coalesce(v, F.lit("")) != ""))
    return F.map_concat(first, F.map_from_entries(F.filter(F.map_entries(F.coalesce(X.col(page), F.create_map().cast("map<string,string>"))), lambda e: ~F.array_contains(F.map_keys(first), e["key"]))))


def layered(parts: DataFrame) -> DataFrame:
    """One product row per page and JSON-LD product, gaps filled from OpenGraph, text and pictures: page_id, pos, name, price, currency, image, url, description, sku, vendor, gtin, availability, layer.

    ``parts``: page_id, blocks, og, and optionally markdown, metadata (OpenGraph that a crawl gave, before the page's own) and images (array of src and score, whose best fills a missing picture).
    Pages without JSON-LD give one row if OpenGraph or the text shows a product.
    """
    og_of = merged_og("metadata", "og") if "metadata" in parts.columns else F.col("og")
    og = lambda k: F.when(F.col("og")[k] != "", F.col("og")[k])
    text = F.col("markdown") if "markdown" in parts.columns else F.lit(None).cast("string")
    picture = best_image("images") if "images" in parts.columns else F.lit(None).cast("string")
    none = F.struct(F.lit(None).cast("string").alias("price"), F.lit(None).cast("string").alias("currency"))
    texts = F.struct(text_title(text).alias("title"), text_price(text).alias("price")) if "markdown" in parts.columns else F.struct(F.lit(None).cast("string").alias("title"), none.alias("price"))
    # put out by a generator, so that texts are looked through once and not once per field that is read
    base = parts.select("page_id", og_of.alias("og"), "blocks", picture.alias("best"), F.explode(F.array(texts)).alias("md0")).select("page_id", "og", "blocks", "best", F.col("md0.title").alias("md_title"), F.col("md0.price").alias("md"))
    ld = json_ld(base).select("page_id", "pos", "raw")
    # the fields that are read are taken out of each record once
    said = F.from_json(F.to_json(F.col("raw")), _LAYER_FIELDS)
    rows = base.drop("blocks").join(ld.select("page_id", "pos", said.alias("r")), "page_id", "left")
    some = lambda *cs: X.first_filled(*cs)
    zero = lambda c: F.when((F.trim(c) != "0") & (c != ""), c)
    offer = lambda c: F.get(F.filter(_texts("r.offers"), lambda o: F.get_json_object(o, f"$.{c}").isNotNull()), 0)
    of = lambda c: F.get_json_object(offer(c), f"$.{c}")
    price = F.coalesce(zero(F.col("r.price")), zero(of("price")), zero(og("og:price:amount")), zero(og("product:price:amount")), F.col("md.price"))
    image = F.get(F.filter(F.transform(_texts("r.image"), lambda i: F.coalesce(F.get_json_object(i, "$.url"), F.when(~i.startswith("{"), i))), lambda i: i.isNotNull() & (i != "")), 0)
    out = rows.select(
        "page_id", F.coalesce("pos", F.lit(0)).alias("pos"), some("r.name", og("og:title"), F.col("md_title")).alias("name"), price.alias("price"),
        some(of("priceCurrency"), og("og:price:currency"), og("product:price:currency"), F.col("md.currency")).alias("currency"),
        some(image, og("og:image"), F.col("best")).alias("image"), some("r.url", og("og:url")).alias("url"), some("r.description", og("og:description")).alias("description"),
        F.col("r.sku").alias("sku"), F.coalesce(F.get_json_object("r.brand", "$.name"), F.when(~F.col("r.brand").startswith("{"), F.col("r.brand"))).alias("vendor"), some(*[f"r.{g}" for g in ("gtin13", "gtin", "gtin14", "gtin12", "gtin8")]).alias("gtin"), of("availability").alias("availability"),
        F.when(F.col("r").isNotNull(), "json_ld").when(F.size("og") > 0, "opengraph").otherwise("text").alias("layer"), F.coalesce(F.lower(F.col("og")["og:type"]).contains("product"), F.lit(False)).alias("typed"),
    )
    return out.where((F.col("layer") == "json_ld") | F.col("typed") | F.col("price").isNotNull()).drop("typed")


#: What the layers read of a JSON-LD product; objects and lists come as JSON text.
_LAYER_FIELDS = "name string, price string, offers string, image string, url string, description string, sku string, brand string, gtin13 string, gtin string, gtin14 string, gtin12 string, gtin8 string"


def _texts(field: str) -> Column:
    """The elements of a list given as JSON text, or the single one, as texts."""
    c = F.col(field)
    return F.coalesce(F.when(c.startswith("["), F.from_json(c, "array<string>")), F.when(c.isNotNull(), F.array(c)), F.array().cast("array<string>"))


def has_price_and_image(products: DataFrame) -> DataFrame:
    """The rows (of ``layered``) with a price above zero and a picture."""
    return products.where((F.coalesce(F.col("price").try_cast("double"), F.lit(0.0)) > 0) & (F.coalesce("image", F.lit("")) != ""))
