"""Catalogue views over the test tables, as SQL that Spark and DuckDB share."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockroom.session import table

#: One catalogue: parts with deterministic gaps.
CATALOG = """
select p_partkey as idx, cast(p_partkey as varchar(20)) as external_id, p_name as title, cast(cast(p_retailprice as decimal(18,2)) as varchar(30)) as price, 'USD' as currency,
  case when p_partkey % 5 = 0 then '' else concat('About ', p_name) end as description,
  case when p_partkey % 7 = 0 then null when p_partkey % 7 = 1 then '' else concat('https://img.example/', cast(p_partkey as varchar(20)), '.jpg') end as image_url,
  concat('https://shop.example/p/', cast(p_partkey as varchar(20))) as product_url,
  case when p_partkey % 11 = 0 then ' ' else p_brand end as vendor,
  case when p_partkey % 6 = 0 then null else lpad(cast(p_partkey % 900 as varchar(20)), 13, '0') end as gtin,
  concat('SKU-', cast(p_partkey as varchar(20))) as sku, p_type as product_type,
  case when p_partkey % 4 = 0 then false when p_partkey % 4 = 1 then null else true end as in_stock, case when p_partkey % 3 = 0 then 'NEW' else null end as condition
from {part}
"""
#: Offers of five shops.
OFFERS = """
select r_name as store, l_orderkey * 10 + l_linenumber as idx, concat(p_name, ' ', cast(p_partkey as varchar(20))) as title, p_brand as vendor, p_type as product_type,
  cast(cast(l_extendedprice as decimal(18,2)) as varchar(30)) as price, cast(year(l_shipdate) as bigint) as taken_at, l_partkey, l_suppkey, l_orderkey, l_linenumber
from {lineitem} join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
"""
TABLES = ("part", "lineitem", "supplier", "nation", "region", "products", "stores", "events", "orders", "customer", "documents")


def sql(spark: SparkSession, sf: str, query: str, **more: DataFrame) -> DataFrame:
    """Spark SQL over the tables that ``query`` names in braces."""
    used = {t: table(spark, sf, t) for t in TABLES if f"{{{t}}}" in query}
    return spark.sql(query, **used, **more)


def plain(query: str) -> str:
    """The same SQL with bare table names."""
    for t in TABLES:
        query = query.replace(f"{{{t}}}", t)
    return query


def with_views(query: str) -> str:
    """DuckDB SQL with the views ``catalog`` and ``offers`` in front."""
    return f"with catalog as ({plain(CATALOG)}), offers as ({plain(OFFERS)}) {query}"


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    df = sql(spark, sf, CATALOG)
    return df.withColumn("category_path", F.when(F.col("idx") % 2 == 0, F.split("product_type", " "))).withColumn("additional_images", F.when(F.col("idx") % 7 == 1, F.array(F.lit("x")))).withColumn("store", F.lit("parts"))


def offers(spark: SparkSession, sf: str) -> DataFrame:
    return sql(spark, sf, OFFERS)


def registry() -> tuple[dict, dict, object]:
    """QUERIES, ORACLE and a decorator that fills them. Decimals come out as doubles, in SQL those named in ``doubles``, so that both engines' results have the same types."""
    queries: dict = {}
    oracle: dict = {}

    def query(name: str, sql_text: str | None = None, doubles: str = ""):
        def add(f):
            @wraps(f)
            def run(spark: SparkSession, sf: str) -> DataFrame:
                df = f(spark, sf)
                return df.withColumns({c: F.col(c).cast("double") for c, kind in df.dtypes if kind.startswith("decimal")})

            queries[name] = run
            if sql_text:
                oracle[name] = f"select * replace ({', '.join(f'cast({c} as double) as {c}' for c in doubles.split())}) from ({sql_text})" if doubles else sql_text
            return run

        return add

    return queries, oracle, query
