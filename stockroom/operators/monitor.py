"""Change detection over exploded snapshots: rows with domain, taken_at, idx, title and price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockroom.functions import text as X


def by_title(rows: DataFrame) -> DataFrame:
    """The last row of each title of a snapshot: domain, taken_at, title_key, title, price. Blank titles are a key of their own."""
    last = F.struct("title", X.money("price").cast("decimal(20,6)").alias("price"))
    return rows.groupBy("domain", "taken_at", X.key("title").alias("title_key")).agg(F.max_by(last, "idx").alias("x")).select("domain", "taken_at", "title_key", "x.*")


def latest(rows: DataFrame, n: int = 2) -> DataFrame:
    """The rows of the ``n`` newest snapshots of each domain, with ``age`` 1 for the newest. Ranks are taken over the snapshots, not over their rows."""
    times = rows.select("domain", "taken_at").distinct()
    ranked = times.withColumn("age", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("taken_at"))).cast("long")).where(F.col("age") <= n)
    return rows.join(ranked, ["domain", "taken_at"])


def changes(rows: DataFrame) -> DataFrame:
    """Domain, title_key, change (new, removed, price_change), old_price, new_price between the two newest snapshots; a domain with one snapshot has none.

    Both snapshots are aggregated at once: per title the last row's price of either.
    """
    aged = latest(rows.select("domain", "taken_at", "idx", "title", "price"))
    price = X.money("price").cast("decimal(20,6)")
    of = lambda age: F.max_by(price, F.when(F.col("age") == age, F.col("idx")))
    has = lambda age: F.max(F.col("age") == age)
    both = aged.groupBy("domain", X.key("title").alias("title_key")).agg(of(1).alias("new_price"), of(2).alias("old_price"), has(1).alias("is_new"), has(2).alias("is_old"))
    # a domain has two snapshots if any of its titles is of the older one
    complete = aged.where("age = 2").select("domain").distinct()
    change = F.when(~F.col("is_old"), "new").when(~F.col("is_new"), "removed").when(F.col("old_price") != F.col("new_price"), "price_change")
    return both.join(complete, "domain", "left_semi").select("domain", "title_key", change.alias("change"), "old_price", "new_price").where("change is not null")


def price_history(rows: DataFrame, title: str | None = None) -> DataFrame:
    """Domain, title_key, taken_at, price and the change against the previous snapshot that lists the product; all products or one."""
    found = by_title(rows)
    if title is not None:
        found = found.where(F.col("title_key") == title.strip().lower())
    before = F.lag("price").over(Window.partitionBy("domain", "title_key").orderBy("taken_at"))
    return found.withColumn("delta", F.col("price") - before).select("domain", "title_key", "taken_at", "price", "delta")


def alerts(found: DataFrame, rules: list[tuple[str, str | None, str | None, Column | str]]) -> DataFrame:
    """Changes that meet a rule (name, domain or None, title or None, condition as SQL or Column): the change with ``rule``, once per rule."""
    parts = None
    for name, domain, title, when in rules:
        hit = (F.expr(when) if isinstance(when, str) else when) & (F.col("domain") == domain if domain else F.lit(True)) & (F.col("title_key") == title.strip().lower() if title else F.lit(True))
        part = F.when(hit, F.lit(name))
        parts = [*(parts or []), part]
    return found.withColumn("rule", F.explode(F.array_compact(F.array(*parts)))) if parts else found.withColumn("rule", F.lit(None).cast("string")).limit(0)
