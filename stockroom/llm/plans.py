"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockroom.llm import bpe, linkage, mix, mojibake, survivors
from stockroom.session import staged, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.same_article(table(spark, sf, "products"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivors.best_by_given_trust(table(spark, sf, "products"), table(spark, sf, "stores"))


def p5_truths(spark: SparkSession, sf: str) -> DataFrame:
    products = table(spark, sf, "products")
    return survivors.truths(survivors.claims_of(survivors.members(products, table(spark, sf, "stores")), products))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf, "documents"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mix.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    return mix.shares(staged(mix.mixture(table(spark, sf, "documents"), targets)), targets)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.found(table(spark, sf, "documents"))


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.restore(table(spark, sf, "documents"), changed_only=True).select("doc_id", "restored", "runs", "text")


QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p5_truths": p5_truths, "p6_ids": p6_ids, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored}
ORACLE: dict[str, str] = {}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
