"""Queries of the record operators: nested records, histories and snapshot differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockroom.operators import history, shred
from stockroom.session import table

#: Where the records of a page are, and which of its elements are lists whatever one capture shows.
LAYOUTS = {
    "shopify": {"container": "products", "root": "products", "lists": ("variants", "option_values", "images")},
    "woocommerce": {"container": None, "root": "products", "lists": ("images", "tags", "categories", "variations", "attributes")},
}
#: What names an element of a table, and the paths that count.
ITEM = {"products": "id", "variants": "id", "variations": "id", "images": "src"}
COUNTED = {
    "shopify": r"^products\[\d+\](\.images\[\d+\]|\.variants\[\d+\](\.option_values\[\d+\])?)?$",
    "woocommerce": r"^\[\d+\](\.(images|tags|categories)\[\d+\]|\.variations\[\d+\](\.attributes\[\d+\])?)?$",
}


def p2_tables(spark: SparkSession, sf: str, source: str = "shopify") -> dict[str, DataFrame]:
    layout = LAYOUTS[source]
    return shred.flat_tables(table(spark, sf, f"{source}_products"), "page_id", "body", layout["container"], layout["root"], layout["lists"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each row of the flat tables that counts."""
    parts = []
    for source in LAYOUTS:
        for name, rows in p2_tables(spark, sf, source).items():
            key = ITEM.get(name, "name")
            kind = dict(rows.dtypes).get(key)
            column = F.col(key).cast("string") if kind else F.lit(None).cast("string")
            if kind == "double":  # whole numbers among others
                column = F.coalesce(F.when(F.col(key) == F.floor(key), F.col(key).cast("decimal(38,0)").cast("string")), column)
            parts.append(rows.where(F.col("path").rlike(COUNTED[source])).select(F.lit(source).alias("src"), F.col("page_key").alias("page_id"), "path", F.coalesce("item", column, F.lit("")).alias("item_id")))
    return reduce(DataFrame.unionByName, parts)


def p2_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Shopify variants with the parent's title: the child table joined with its parent by key."""
    t = p2_tables(spark, sf)
    variants, products = t["variants"], t["products"]
    have = lambda df, c: F.col(f"{df}.{c}") if c in {"v": variants, "p": products}[df].columns else F.lit(None).cast("string")
    return variants.alias("v").join(products.alias("p"), F.col("v.parent_id") == F.col("p.node_id")).select(F.col("v.node_id"), F.col("v.parent_id"), have("p", "title").alias("product_title"), have("v", "title").alias("variant_title"), have("v", "price").try_cast("double").alias("price"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return history.versions(table(spark, sf, "snapshots"))


def p3_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return history.ledger(table(spark, sf, "snapshots")).withColumn("price", F.col("price").cast("double"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return history.changes(table(spark, sf, "snapshots"))


QUERIES = {"p2_found": p2_found, "p2_variants": p2_variants, "p3_found": p3_found, "p3_ledger": p3_ledger, "p4_found": p4_found}

_STATES = r"""with d as (select id, domain, epoch_us(cast(case when regexp_matches(created_at, '(Z|[+-]\d\d:?\d\d)$') then created_at else created_at || '+00:00' end as timestamptz)) as t, from_json(products_json, '["JSON"]') as l
  from (select * from snapshots where json_valid(products_json)) where json_type(products_json) = 'ARRAY'),
s as (select domain, t, min(id) as sid, row_number() over (partition by domain order by t) as k from d group by domain, t),
e as (select domain, t, id, generate_subscripts(l, 1) as pos, unnest(l) as p from d),
x as (select domain, t, id, pos, lower(regexp_replace(p->>'$.title', '^[\s\pZ\x{85}\x1c-\x1f]+|[\s\pZ\x{85}\x1c-\x1f]+$', '', 'g')) as title_key,
  concat_ws('|', coalesce(try_cast(trim(p->>'$.price') as decimal(20,6)), 0), coalesce(p->>'$.currency', 'USD'), coalesce(p->>'$.vendor', ''), coalesce(p->>'$.in_stock', 'true')) as version from e),
v as (select domain, k, sid, title_key, arg_max(version, id * 1000000 + pos) as version from x join s using (domain, t) where title_key <> '' group by all)"""



def _elements(e: str) -> str:
    """The elements in place of a list: see ``shred.elements``."""
    text = f"({e}->>'$')"
    return f"(case when json_type({e}) = 'ARRAY' then from_json({e}, '[\"JSON\"]') when json_type({e}) = 'VARCHAR' and ltrim({text}) like '[%' and json_type(try_cast({text} as json)) = 'ARRAY' then from_json(try_cast({text} as json), '[\"JSON\"]') when {e} is null or json_type({e}) = 'NULL' or (json_type({e}) = 'VARCHAR' and trim({text}) = '') then [] else [{e}] end)"


def _level(name: str, parent: str, child: str) -> str:
    """The elements of list ``child`` of the objects of ``parent``."""
    return f"{name} as (select page_id, path || '.{child}[' || (i - 1) || ']' as path, path as above, e as parent, l[i] as e from (select page_id, path, e, l, unnest(generate_series(1, len(l))) as i from (select page_id, path, e, {_elements(f"(e->'$.{child}')")} as l from {parent} where json_type(e) = 'OBJECT')) where l[i] is not null and json_type(l[i]) <> 'NULL')"


_SHOPIFY = f"""b as (select page_id, try_cast(body as json) as j from shopify_products), sl as (select page_id, {_elements("(j->'$.products')")} as l from b where json_type(j) = 'OBJECT'),
sp as (select page_id, 'products[' || (i - 1) || ']' as path, '' as above, null::json as parent, l[i] as e from (select page_id, l, unnest(generate_series(1, len(l))) as i from sl) where l[i] is not null and json_type(l[i]) <> 'NULL'),
{_level("sv", "sp", "variants")}, {_level("so", "sv", "option_values")}, {_level("si", "sp", "images")}"""
_WOO = f"""wb as (select page_id, try_cast(body as json) as j from woocommerce_products), wl as (select page_id, from_json(j, '["JSON"]') as l from wb where json_type(j) = 'ARRAY'),
wp as (select page_id, '[' || (i - 1) || ']' as path, '' as above, null::json as parent, l[i] as e from (select page_id, l, unnest(generate_series(1, len(l))) as i from wl) where l[i] is not null and json_type(l[i]) <> 'NULL'),
{_level("wi", "wp", "images")}, {_level("wt", "wp", "tags")}, {_level("wc", "wp", "categories")}, {_level("wv", "wp", "variations")}, {_level("wa", "wv", "attributes")}"""


def _counted(source: str, name: str, key: str) -> str:
    return f"select '{source}' as src, page_id, path, coalesce(case when json_type(e) = 'OBJECT' then e->>'$.{key}' else e->>'$' end, '') as item_id from {name}"


ORACLE = {
    "p2_found": f"with {_SHOPIFY}, {_WOO} " + " union all ".join([_counted("shopify", n, k) for n, k in (("sp", "id"), ("sv", "id"), ("so", "name"), ("si", "src"))] + [_counted("woocommerce", n, k) for n, k in (("wp", "id"), ("wi", "src"), ("wt", "name"), ("wc", "name"), ("wv", "id"), ("wa", "name"))]),
    "p2_variants": f"with {_SHOPIFY} select page_id || '/' || path as node_id, page_id || '/' || above as parent_id, parent->>'$.title' as product_title, case when json_type(e) = 'OBJECT' then e->>'$.title' end as variant_title, case when json_type(e) = 'OBJECT' then try_cast(e->>'$.price' as double) end as price from sv",
    "p3_ledger": _STATES
    + """, a as (select s.domain, r.sid as rec, s.sid, row_number() over (partition by s.domain, r.sid order by s.t) as k from s join s r on r.domain = s.domain and s.sid <= r.sid),
c as (select a.domain, a.rec, a.k, v.title_key, v.version from v join a on a.domain = v.domain and a.sid = v.sid),
r as (select *, case when lag(k) over w = k - 1 and lag(version) over w = version then 0 else 1 end as fresh from c window w as (partition by domain, rec, title_key order by k)),
g as (select *, sum(fresh) over (partition by domain, rec, title_key order by k) as run from r),
u as (select domain, rec, title_key, version, min(k) as x, max(k) as y from g group by domain, rec, title_key, version, run),
f as (select u.domain, u.rec, u.title_key, u.version, p.sid as from_id, q.sid as to_id from u join a p on p.domain = u.domain and p.rec = u.rec and p.k = u.x left join a q on q.domain = u.domain and q.rec = u.rec and q.k = u.y + 1),
z as (select domain, sid as rec, row_number() over (partition by domain order by sid) as n, lead(sid) over (partition by domain order by sid) as following from s),
h as (select f.*, z.n, z.following, z.n - row_number() over (partition by f.domain, title_key, version, from_id, to_id order by z.n) as island from f join z using (domain, rec))
select domain, title_key, string_split(version, '|')[1]::double as price, string_split(version, '|')[2] as currency, string_split(version, '|')[3] as vendor, string_split(version, '|')[4] = 'true' as in_stock, from_id, to_id, min(rec) as recorded_from, nullif(arg_max(coalesce(following, -1), n), -1) as recorded_to
from h group by domain, title_key, version, from_id, to_id, island""",
    "p3_found": _STATES
    + """, r as (select *, case when lag(k) over w = k - 1 and lag(version) over w = version then 0 else 1 end as fresh from v window w as (partition by domain, title_key order by k)),
g as (select *, sum(fresh) over (partition by domain, title_key order by k) as run from r),
u as (select domain, title_key, min(k) as a, max(k) as b from g group by domain, title_key, run)
select u.domain, u.title_key, f.sid as from_id, coalesce(n.sid, 0) as to_id from u join s f on f.domain = u.domain and f.k = u.a left join s n on n.domain = u.domain and n.k = u.b + 1""",
    "p4_found": _STATES
    + """, c as (select a.domain, a.sid as from_id, b.sid as to_id, a.k from s a join s b on a.domain = b.domain and b.k = a.k + 1),
o as (select c.*, v.title_key, v.version from c join v on v.domain = c.domain and v.k = c.k), n as (select c.*, v.title_key, v.version from c join v on v.domain = c.domain and v.k = c.k + 1)
select coalesce(o.domain, n.domain) as domain, coalesce(o.from_id, n.from_id) as from_id, coalesce(o.to_id, n.to_id) as to_id, coalesce(o.title_key, n.title_key) as title_key,
  case when o.title_key is null then 'added' when n.title_key is null then 'removed' else 'changed' end as change
from o full join n on o.domain = n.domain and o.from_id = n.from_id and o.title_key = n.title_key where o.version is distinct from n.version""",
}
