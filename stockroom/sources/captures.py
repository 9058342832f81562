"""A folder of captured payloads: one Parquet table per kind, each optional.

``sites`` (site), ``pages`` (site, url, html and optionally markdown, metadata, images), ``api_pages`` (site, body, http_status, page_no), ``feeds`` (site, body, content_type), ``headers`` (site, headers),
``probes`` (site, path, status, body), ``sitemaps`` (site, path, body), ``links`` (site, source, target). Without ``sites`` they are those of the other tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

KINDS = ("pages", "api_pages", "feeds", "headers", "probes", "sitemaps", "links")


class Captures:
    def __init__(self, spark: SparkSession, folder: str, site: str | None = None):
        self.spark, self.folder, self.site = spark, folder.rstrip("/"), site

    def get(self, kind: str) -> DataFrame | None:
        """The table of a kind, of one site if one was chosen; None if it wasn't captured."""
        try:
            df = self.spark.read.parquet(f"{self.folder}/{kind}.parquet")
        except AnalysisException:
            return None
        return df if self.site is None else df.where(F.col("site") == self.site)

    def sites(self) -> DataFrame:
        tables = [t for k in ("sites", *KINDS) if (t := self.get(k)) is not None]
        if not tables:
            raise FileNotFoundError(f"{self.folder} holds no captures")
        return reduce(DataFrame.unionByName, [t.select("site") for t in tables]).distinct()
