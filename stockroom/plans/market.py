"""Queries over several shops and snapshots: matching, comparison, competition, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockroom.functions import text as X
from stockroom.operators import analyze, match, monitor
from stockroom.plans.base import catalog, offers, registry, with_views
from stockroom.plans.catalog import ratcliff
from stockroom.session import table

QUERIES, ORACLE, query = registry()
STORES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

_LAST = ", o as (select *, cast(price as decimal(20,6)) as p, lower(trim(title)) as k, idx * 1000000 + l_suppkey as pos from offers), s as (select store as domain, taken_at, k as title_key, max_by(p, pos) as price from o group by all)"
_TWO = _LAST + ", a as (select domain, taken_at, row_number() over (partition by domain order by taken_at desc) as age from (select distinct domain, taken_at from s)), n as (select * from s join a using (domain, taken_at) where age = 1), b as (select * from s join a using (domain, taken_at) where age = 2)"


def snapshot_rows(spark, sf):
    return offers(spark, sf).select(F.col("store").alias("domain"), "taken_at", (F.col("idx") * 1000000 + F.col("l_suppkey")).alias("idx"), "title", "price")


@query("d2_last_by_title", with_views("") + _LAST + " select domain, taken_at, title_key, price from s", "price")
def last_by_title(spark, sf):
    return monitor.by_title(snapshot_rows(spark, sf)).drop("title")


@query("w1_latest_two", with_views("") + _TWO + " select domain, taken_at, age, count(*) as n from (select * from n union all select * from b) group by all")
def latest_two(spark, sf):
    return monitor.by_title(rows := snapshot_rows(spark, sf)).join(monitor.latest(rows).select("domain", "taken_at", "age").distinct(), ["domain", "taken_at"]).groupBy("domain", "taken_at", "age").agg(F.count("*").alias("n"))


_CHANGES = _TWO + ", ch as (select coalesce(n.domain, b.domain) as domain, coalesce(n.title_key, b.title_key) as title_key, case when b.domain is null then 'new' when n.domain is null then 'removed' else 'price_change' end as change, b.price as old_price, n.price as new_price from n full join b on n.domain = b.domain and n.title_key = b.title_key where b.price is null or n.price is null or b.price <> n.price)"


@query("j6_changes", with_views("") + _CHANGES + " select * from ch", "old_price new_price")
def changes(spark, sf):
    return monitor.changes(snapshot_rows(spark, sf))


@query("p10_alerts", with_views("") + _CHANGES + " select *, 'drop' as rule from ch where change = 'price_change' and new_price < old_price union all select *, 'europe_new' from ch where domain = 'EUROPE' and change = 'new'", "old_price new_price")
def alerts(spark, sf):
    return monitor.alerts(monitor.changes(snapshot_rows(spark, sf)), [("drop", None, None, "change = 'price_change' and new_price < old_price"), ("europe_new", "EUROPE", None, F.col("change") == "new")])


@query("w2_price_history", with_views("") + _LAST + " select domain, title_key, taken_at, price, price - lag(price) over (partition by domain, title_key order by taken_at) as delta from s", "price delta")
def price_history(spark, sf):
    return monitor.price_history(snapshot_rows(spark, sf))


@query("a10_brand_coverage", with_views("select vendor as brand, " + ", ".join(f"count(*) filter (store = '{s}') as \"{s}\"" for s in STORES) + " from offers where trim(vendor) <> '' group by vendor"))
def brand_coverage(spark, sf):
    return analyze.brand_coverage(offers(spark, sf), STORES)


@query("a10_brand_coverage_long", with_views("select vendor as brand, store, count(*) as n from offers where trim(vendor) <> '' group by all"))
def brand_coverage_long(spark, sf):
    return analyze.coverage_long(offers(spark, sf))



#: White space of any kind around a text, for SQL.
_SPACE = r"'^[\s\pZ\x{85}\x1c-\x1f]+|[\s\pZ\x{85}\x1c-\x1f]+$'"
_OWN = "(select min(domain) from products)"


@query("j10_assortment_gaps", f"with x as (select distinct domain = {_OWN} as own, kind, regexp_replace(value, {_SPACE}, '', 'g') as value from (select domain, 'brand' as kind, vendor as value from products union all select domain, 'category', product_type from products) where value is not null) select distinct kind, value from x where not own and value <> '' and (kind, value) not in (select kind, value from x where own)")
def assortment_gaps(spark, sf):
    """Brands and categories of all other shops that one shop lacks, over all listings."""
    p = table(spark, sf, "products")
    own = F.col("domain") == p.agg(F.min("domain")).first()[0]
    return analyze.assortment_gaps(p.where(own), p.where(~own))


def _competitors(spark, sf):
    """The offers named by the part alone; a stable number per offer."""
    o = offers(spark, sf).withColumn("name", F.regexp_replace("title", r" \d+$", ""))
    return o.select(((F.col("idx") * 1000000 + F.col("l_suppkey")) * 100000 + F.col("l_partkey")).alias("idx"), "store", F.col("name").alias("title"), "price")


_NAMED = ", n as (select *, regexp_replace(title, ' [0-9]+$', '') as name, (idx * 1000000 + l_suppkey) * 100000 + l_partkey as cid from offers), near as (select ta, tb, sim from sims where sim >= 0.8 union all select t, t, 1.0::double from (select distinct lower(p_name) as t from part))"


@query(
    "j5_best_competitors",
    ratcliff(
        "select x.t ta, y.t tb from (select distinct lower(p_name) t from part) x, (select distinct lower(p_name) t from part) y where x.t <> y.t",
        _NAMED
        + ", b as (select ta, tb, sim, store, min(cid) as cid from near join n on lower(trim(name)) = tb group by all), best as (select ta, store, arg_max(struct_pack(cid := cid, sim := sim), struct_pack(sim := sim, c := -cid)) as x from b group by ta, store) "
        "select distinct c.idx, best.store, x.cid as competitor, cast(n.price as double) as competitor_price, round(x.sim, 6) as sim from catalog c join best on lower(trim(c.title)) = ta join n on n.cid = x.cid and n.store = best.store where try_cast(n.price as double) > 0",
    ),
)
def best_competitors(spark, sf):
    return match.best_competitors(catalog(spark, sf), _competitors(spark, sf), 0.8).withColumn("sim", F.round("sim", 6))


@query(
    "a11_price_positions",
    with_views(
        """select c.idx, cast(count(*) filter (p < price) + 1 as bigint) as rank, cast(count(p) + 1 as bigint) as of, cast(round((1 - count(*) filter (p < price) / (count(p) + 1)) * 100, 1) as decimal(20,1)) as percentile,
 (2 * cast((coalesce(sum(p),0) + price) * 100 as bigint) + count(p) + 1) // (2 * (count(p) + 1)) / 100.0 as market_avg, cast(least(min(p), price) as decimal(20,2)) as market_min, cast(greatest(max(p), price) as decimal(20,2)) as market_max
 from (select idx, cast(price as decimal(18,2)) as price from catalog) c left join (select l_partkey, min(cast(price as decimal(18,2))) as p from offers group by l_partkey, store) o on o.l_partkey = c.idx group by c.idx, price"""
    ),
    "percentile market_avg market_min market_max",
)
def price_positions(spark, sf):
    best = offers(spark, sf).groupBy(F.col("l_partkey").alias("idx"), "store").agg(F.min(F.col("price").cast("decimal(18,2)")).alias("competitor_price"))
    own = catalog(spark, sf).select("idx", F.col("price").cast("decimal(18,2)").alias("price"))
    return analyze.price_positions(own.join(best, "idx", "left"))



def _query_frame(spark, sf):
    """The first word pairs of the catalogue's titles as queries."""
    return catalog(spark, sf).select(F.concat_ws(" ", F.slice(F.split(X.key("title"), " "), 1, 2)).alias("query")).distinct()


_Q = ", q as (select distinct array_to_string(string_split(lower(p_name),' ')[1:2], ' ') as query from part)"


@query("j4_query_matches", ratcliff("select q.query ta, y.t tb from q, (select distinct lower(p_name) t from part) y where q.query <> y.t", "select ta as query, tb as title_key, round(sim, 6) as sim from sims where sim >= 0.6 union all select query, query, 1.0 from q where query in (select lower(p_name) from part)", _Q))
def query_matches(spark, sf):
    return match.query_matches(catalog(spark, sf), _query_frame(spark, sf)).select("query", X.key("title").alias("title_key"), F.round("sim", 6).alias("sim")).distinct()


@query(
    "a12_comparison",
    ratcliff(
        "select q.query ta, y.t tb from q, (select distinct lower(p_name) t from part) y where q.query <> y.t",
        ", h as (select ta as query, tb as t from sims where sim >= 0.6 union all select query, query from q), x as (select query, p_partkey as idx, cast(p_retailprice as decimal(18,2)) as price from h join part on lower(p_name) = t) "
        "select query, count(*) as matches, arg_min(idx, price * 100000000 + idx) as cheapest, arg_max(idx, price * 100000000 + idx) as most_expensive, cast(round(sum(price) / count(*), 2) as decimal(20,2)) as average, cast(max(price) - min(price) as decimal(20,2)) as spread from x group by query",
        _Q,
    ),
    "average spread",
)
def comparison(spark, sf):
    return match.comparison(match.query_matches(catalog(spark, sf), _query_frame(spark, sf)))


def _two_catalogs(spark, sf):
    """A third of the catalogue and the rest of it: every row is in one of the two."""
    c = catalog(spark, sf).withColumn("title", F.concat_ws(" ", "title", (F.col("idx") % 50).cast("string")))
    return c.where("idx % 3 = 0"), c.where("idx % 3 <> 0")


#: Both catalogues' titles, with counts of characters by which dissimilar pairs are told beforehand.
_TITLES = ", r0 as (select idx, concat(lower(trim(title)), ' ', idx % 50) as t, idx % 3 = 0 as own, cast(price as decimal(18,2)) as price from catalog), k as (select t, own, [length(t) - length(replace(t, c, '')) for c in string_split(' abcdefghijklmnopqrstuvwxyz0123456789', '')] as cs from (select distinct t, own from r0))"
_NEAR = "select x.t ta, y.t tb from (select t, cs from k where own) x, (select t, cs from k where not own) y where x.t <> y.t and 2 * list_sum(list_transform(list_zip(x.cs, y.cs), lambda z: least(z[1], z[2]))) >= 0.9 * (length(x.t) + length(y.t))"
#: The plain loop: each row in turn takes its best partner that is still free.
_GREEDY = """, near as (select ta, tb, sim from sims where sim >= 0.9 union all select x.t, x.t, 1.0::double from (select t from k where own) x join (select t from k where not own) y on x.t = y.t),
cand as (select x.idx as a, y.idx as b, sim from near join r0 x on x.t = ta and x.own join r0 y on y.t = tb and not y.own), ord as (select a, row_number() over (order by a) as n from (select distinct a from cand)),
greedy as (select 0::bigint as i, []::bigint[] as used, null::bigint as a, null::struct(b bigint, sim double) as x
  union all
  select i + 1, case when y.x is null then used else list_append(used, y.x.b) end, y.a, y.x from (
    select g.i, g.used, o.a, arg_max(struct_pack(b := c.b, sim := c.sim), struct_pack(sim := c.sim, b := -c.b)) filter (not list_contains(g.used, c.b)) as x from greedy g join ord o on o.n = g.i + 1 join cand c on c.a = o.a group by g.i, g.used, o.a) y),
m as (select a, x.b as b, x.sim as sim from greedy where x is not null)"""


@query("j2_fuzzy_match", ratcliff(_NEAR, _GREEDY + " select a, b, round(sim, 6) as sim from m", _TITLES))
def fuzzy_match(spark, sf):
    a, b = _two_catalogs(spark, sf)
    return match.fuzzy_match(a, b, 0.9).withColumn("sim", F.round("sim", 6))


@query(
    "j3_catalog_diff",
    ratcliff(
        _NEAR,
        _GREEDY + " select m.a, m.b, 'both' as side, case when x.price < y.price then 'cheaper_a' when y.price < x.price then 'cheaper_b' else 'equal' end as price_class from m join r0 x on x.idx = m.a join r0 y on y.idx = m.b "
        "union all select idx, null, 'only_a', null from r0 where own and idx not in (select a from m) union all select null, idx, 'only_b', null from r0 where not own and idx not in (select b from m)",
        _TITLES,
    ),
)
def catalog_diff(spark, sf):
    a, b = _two_catalogs(spark, sf)
    return match.catalog_diff(a, b, 0.9)
