"""Queries of the single-catalogue operators: statistics, quality, validation, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockroom.functions import text as X
from stockroom.operators import analyze, match, validate
from stockroom.plans.base import catalog, registry, with_views
from stockroom.session import table

QUERIES, ORACLE, query = registry()


_BASE = "c as (select *, case when try_cast(price as decimal(38,10)) > 0 then cast(price as decimal(20,6)) end as amount, coalesce(in_stock, true) as stock, trim(coalesce(vendor,'')) as v, trim(coalesce(image_url,'')) as img from catalog)"


def base(q: str) -> str:
    return with_views("").rstrip() + f", {_BASE} {q}"


_FILLED = "(case when trim(title) <> '' then 1 else 0 end + case when amount is not null then 1 else 0 end + case when img <> '' then 1 else 0 end + case when trim(description) <> '' then 1 else 0 end + case when v <> '' then 1 else 0 end + case when coalesce(gtin,'') <> '' then 1 else 0 end)"


@query(
    "a1_catalog_stats",
    base(
        f"""select count(*) as total, cast(count(*) filter (stock) as bigint) as in_stock, count(*) filter (not stock) as out_of_stock, count(*) filter (img <> '' or idx % 7 = 1) as has_images,
 count(*) filter (coalesce(gtin,'') <> '') as has_gtin, cast(round(min(amount),2) as decimal(20,2)) as price_min, cast(round(max(amount),2) as decimal(20,2)) as price_max,
 cast(round(sum(amount)/count(amount),2) as decimal(20,2)) as price_avg, cast(round(cast(median(amount) as decimal(20,6)),2) as decimal(20,2)) as price_median,
 cast(round(avg({_FILLED} / 6.0),4) as decimal(20,4)) as completeness from c"""
    ),
    "price_min price_max price_avg price_median completeness",
)
def catalog_stats(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.catalog_stats(catalog(spark, sf))


@query("a3_brand_counts", base("select v as value, count(*) as n, min(idx) as first_idx from c where v <> '' group by v"))
def brand_counts(spark, sf):
    return analyze.count_field(catalog(spark, sf), "vendor")


@query("a4_category_counts", base("select value, count(*) as n from (select unnest(case when idx % 2 = 0 then list_append(string_split(product_type,' '), product_type) else [product_type] end) as value from c) group by value"))
def category_counts(spark, sf):
    return analyze.count_categories(catalog(spark, sf))


@query("a6_completeness", base(f"select idx, cast(round({_FILLED} / 6.0, 4) as decimal(9,4)) as completeness from c"), "completeness")
def completeness(spark, sf):
    c = catalog(spark, sf)
    return c.select("idx", F.round(analyze.completeness(c), 4).cast("decimal(9,4)").alias("completeness"))


@query(
    "a7_price_histogram",
    base(
        "select bucket, lower, cast(count(amount) as bigint) as n from (values ('0-10',0.0::double,10.0::double),('10-25',10,25),('25-50',25,50),('50-100',50,100),('100-250',100,250),('250-500',250,500),('500-1000',500,1000),('1000+',1000,1e30)) t(bucket,lower,upper) left join c on amount >= lower and amount < upper group by bucket, lower"
    ),
)
def histogram(spark, sf):
    return analyze.price_distribution(catalog(spark, sf))


@query("a8_outliers", base("select idx, amount from c, (select avg(amount::double) as m, stddev_samp(amount::double) as sd, count(amount) as k from c) where k > 1 and sd > 0 and abs(amount::double - m) > 1.5 * sd"), "amount")
def outliers(spark, sf):
    return analyze.outliers(catalog(spark, sf), 1.5).select("idx", "amount")


@query("a9_brand_share", base("select v as value, count(*) as n, cast(round(count(*) * 100 / sum(count(*)) over (), 2) as decimal(9,2)) as share from c where v <> '' group by v"), "share")
def brand_share(spark, sf):
    return analyze.brand_breakdown(catalog(spark, sf))


_QUALITY = "cast((case when trim(title) = '' then 0 else 40 + case when amount is not null then 15 else 0 end + case when img <> '' then 15 else 0 end + case when trim(description) <> '' then 15 else 0 end + case when trim(sku) <> '' then 15 else 0 end end) / 100 as decimal(5,2))"


@query("a13_quality", base(f"select idx, {_QUALITY} as quality from c"), "quality")
def quality(spark, sf):
    return analyze.quality(catalog(spark, sf)).select("idx", "quality")


@query("a14_quality_mean", base(f"select cast(round(avg({_QUALITY}),4) as decimal(9,4)) as quality, count(*) as products from c"), "quality")
def quality_mean(spark, sf):
    return analyze.batch_quality(catalog(spark, sf))


def _rules_sql(market: str) -> str:
    """The issues of a marketplace as a union, one branch per rule."""
    r = validate.RULES[market]
    have = {"title", "price", "image_url", "product_url", "gtin", "sku", "external_id", "condition", "description"}
    value = lambda f: f"trim(coalesce({f},''))" if f in have else "''"
    parts = []
    for f in r["required"]:
        if f == "sku_or_external_id":
            parts.append("select idx, 'sku/external_id' as field, 'sku or external_id is required' as error, 'error' as severity from catalog where trim(coalesce(sku,'')) = '' and trim(coalesce(external_id,'')) = ''")
        else:
            parts.append(f"select idx, '{f}' as field, '{f} is required' as error, 'error' as severity from catalog where {value(f)} = ''")
    for f, n in r["longest"].items():
        parts.append(f"select idx, '{f}', concat('too long: ', length({value(f)}), ' > {n}'), 'error' from catalog where length({value(f)}) > {n}")
    parts.append("select idx, 'price', 'price is negative', 'error' from catalog where try_cast(price as double) < 0")
    for f in r["recommended"]:
        parts.append(f"select idx, '{f}', '{f} is recommended', 'warning' from catalog where {value(f)} = ''")
    return " union all ".join(parts)


for _market in validate.RULES:

    @query(f"a16_issues_{_market}", with_views(_rules_sql(_market)))
    def issues(spark, sf, market=_market):
        return validate.issues(catalog(spark, sf), market)

    @query(
        f"a15_report_{_market}",
        with_views("")
        + f", i as ({_rules_sql(_market)}), b as (select count(distinct idx) filter (severity = 'error') as invalid, count(*) filter (severity = 'warning') as warnings from i) select t.total, t.total - invalid as valid, invalid, warnings, cast(round((t.total - invalid) * 100 / t.total, 4) as decimal(9,4)) as pass_rate from b, (select count(*) as total from catalog) t",
        "pass_rate",
    )
    def report(spark, sf, market=_market):
        return validate.report(catalog(spark, sf), market)


@query("j9_gtin_duplicates", with_views("select first as idx_a, idx as idx_b, gtin as value from (select idx, gtin, min(idx) over (partition by gtin) as first from catalog where coalesce(gtin,'') <> '') where idx > first"))
def gtin_duplicates(spark, sf):
    return validate.exact_duplicates(catalog(spark, sf), "gtin")


def _image_responses(c: DataFrame) -> DataFrame:
    i = F.col("idx") % 9
    return c.where("coalesce(image_url, '') <> ''").select("image_url", F.when(i == 0, 404).when(i != 1, 200).alias("status"), F.when(i == 2, "text/html; charset=utf-8").otherwise("image/jpeg").alias("content_type"), F.when(i == 1, "timed out").alias("failure"))


@query("f13_image_issues", with_views("select idx, case when coalesce(image_url,'') = '' then 'no image address' when idx % 9 = 0 then 'HTTP 404' when idx % 9 = 1 then 'timed out' else 'content type text/html' end as error from catalog where coalesce(image_url,'') = '' or idx % 9 in (0,1,2)"))
def image_issues(spark, sf):
    c = catalog(spark, sf)
    return validate.image_issues(c, _image_responses(c))


_RATCLIFF = """, pairs as ({pairs}),
r as (select ta, tb, ta a, tb b, 0 k from pairs
  union all
  select ta, tb, u.a, u.b, u.k from (
    select ta, tb, a, b, (select {{'k':g.k,'i':g.i}} from
       (select i,k from unnest(range(1,length(a)+1)) t1(i), unnest(range(1,length(a)+1)) t2(k)) g
       where g.i+g.k-1 <= length(a) and contains(b, substr(a,g.i,g.k)) order by g.k desc, g.i limit 1) m
    from r where a <> '' and b <> '') z,
  lateral (select * from (values
    (substr(z.a,1,z.m.i-1), substr(z.b,1,strpos(z.b,substr(z.a,z.m.i,z.m.k))-1), z.m.k),
    (substr(z.a,z.m.i+z.m.k), substr(z.b,strpos(z.b,substr(z.a,z.m.i,z.m.k))+z.m.k), 0)) v(a,b,k)) u
  where z.m is not null),
sims as (select ta, tb, 2.0::double*sum(k)/(length(ta)+length(tb)) sim from r group by ta, tb)"""


def ratcliff(pairs: str, final: str, more: str = "") -> str:
    return with_views("").replace("with catalog", "with recursive catalog", 1) + more + _RATCLIFF.format(pairs=pairs) + " " + final


@query("j1_title_similarity", ratcliff("select distinct lower(x.p_name) ta, lower(y.p_name) tb from part x join part y on y.p_partkey = x.p_partkey + 1 where x.p_name <> y.p_name", "select ta, tb, round(sim, 6) as sim from sims"))
def title_similarity(spark, sf):
    """Given pairs: each product's title and the next one's."""
    t = catalog(spark, sf).select("idx", X.key("title").alias("t"))
    pairs = t.select((F.col("idx") + 1).alias("idx"), F.col("t").alias("ta")).join(t.select("idx", F.col("t").alias("tb")), "idx").where("ta <> tb").select("ta", "tb").distinct()
    return pairs.select("ta", "tb", F.round(match.similarity("ta", "tb"), 6).alias("sim"))


@query(
    "j8_title_duplicates",
    ratcliff("select x.t ta, y.t tb from n x join n y on x.first < y.first", "select ta as title_a, tb as title_b, round(sim, 6) as sim, x.first as first_a, y.first as first_b, x.n as n_a, y.n as n_b from sims join n x on ta = x.t join n y on tb = y.t where sim >= 0.7", ", n as (select lower(p_name) as t, min(p_partkey) as first, count(*) as n from part group by 1)"),
)
def title_duplicates(spark, sf):
    return match.title_duplicates(catalog(spark, sf), 0.7).withColumn("sim", F.round("sim", 6))


@query("j8_duplicate_members", with_views("select idx, lower(trim(title)) as t from catalog"))
def duplicate_members(spark, sf):
    return match.duplicate_members(catalog(spark, sf))


@query("j11_match_identifiers", with_views("select distinct w as wanted_id, idx from (select lpad(cast(range as varchar),13,'0') as w from range(0,900,7) union select concat('SKU-', range) from range(0,900,50)), catalog where w in (gtin, sku)"))
def match_identifiers(spark, sf):
    wanted = spark.range(0, 900, 7).select(F.lpad(F.col("id").cast("string"), 13, "0").alias("wanted_id")).unionByName(spark.range(0, 900, 50).select(F.concat(F.lit(" SKU-"), F.col("id").cast("string")).alias("wanted_id")))
    return match.match_identifiers(catalog(spark, sf), wanted)




def listings(spark: SparkSession, sf: str) -> DataFrame:
    """The scraped listings as a catalogue, dirty as they are."""
    return table(spark, sf, "products").withColumn("idx", F.col("listing_id"))


#: A text without white space of any kind around it, blank for null.
_SOLID = r"regexp_replace(coalesce({}, ''), '^[\s\pZ\x{{85}}\x1c-\x1f]+|[\s\pZ\x{{85}}\x1c-\x1f]+$', '', 'g')"
_HAS = {c: _SOLID.format(c) + " <> ''" for c in ("title", "image_url", "description", "sku")}


@query("a9_listing_brands", f"select v as value, count(*) as n, min(listing_id) as first_idx from (select {_SOLID.format('vendor')} as v, listing_id from products) where v <> '' group by v")
def listing_brands(spark, sf):
    return analyze.count_field(listings(spark, sf), "vendor")


@query("a13_listing_quality", f"select listing_id, (case when not {_HAS['title']} then 0 else 40 + case when coalesce(try_cast(price as decimal(38,10)), 0) > 0 then 15 else 0 end + " + " + ".join(f"case when {_HAS[c]} then 15 else 0 end" for c in ("image_url", "description", "sku")) + " end) / 100.0::double as quality from products")
def listing_quality(spark, sf):
    return analyze.quality(listings(spark, sf)).select("listing_id", F.col("quality").cast("double").alias("quality"))


@query("j9_listing_numbers", f"select first as idx_a, listing_id as idx_b, g as value from (select listing_id, g, min(listing_id) over (partition by g) as first from (select listing_id, {_SOLID.format('gtin')} as g from products) where g <> '') where listing_id > first")
def listing_numbers(spark, sf):
    return validate.exact_duplicates(listings(spark, sf), "gtin")
