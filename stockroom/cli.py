"""Commands over captured payloads and kept snapshots: ``python -m stockroom.cli COMMAND ...`` (or with spark-submit).

Fetching isn't part of it: ``--captures`` names a folder of captured payloads (see ``sources.captures``), ``--store`` a folder of snapshots. Results are printed as
JSON lines, or written with ``-o`` as CSV or JSON files.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockroom.operators import analyze, discover, extract, match, monitor, validate
from stockroom.session import session
from stockroom.sources import export, payloads
from stockroom.sources.captures import Captures

#: Products that are printed where no file is named.
SHOWN = 10


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stockroom", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *places: str, captures: bool = True, **options) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        for place in places:
            c.add_argument(place)
        if captures:
            c.add_argument("--captures", required=True, help="folder of captured payloads")
        for flag, default in options.items():
            c.add_argument(f"--{flag}", default=default, type=type(default) if default is not None else str, required=default is None)
        return c

    e = command("extract", "products of a site", "site", max=20)
    e.add_argument("--format", "-f", choices=("csv", "json"), default="json")
    e.add_argument("-o", "--output")
    command("detect", "platform of a site", "site")
    command("discover", "product addresses of a site", "site", max=100)
    c = command("compare", "offers of sites that match a query", "query")
    c.add_argument("--stores", "-s", action="append", required=True)
    command("snapshot", "keep a site's products", "site", store=None, max=200)
    command("changes", "what changed between a domain's two newest snapshots", "domain", captures=False, store=None)
    command("history", "prices of a product over all snapshots", "domain", "product", captures=False, store=None)
    command("analyze", "statistics of a site's products", "site", max=20)
    v = command("validate", "check a JSON file of products against a marketplace's rules", "file", captures=False)
    v.add_argument("--marketplace", "-m", choices=sorted(validate.RULES), default="google_shopping")
    return top


def products_of(captures: Captures) -> DataFrame:
    """Extracted products with ``idx``, their order."""
    rows = extract.extract(captures.sites(), captures.get("pages"), captures.get("api_pages"), captures.get("feeds"), captures.get("headers"), captures.get("probes"))
    return rows.withColumn("idx", F.xxhash64("site", "external_id", "title", "product_url"))


def _first(products: DataFrame, n: int) -> DataFrame:
    return analyze.top(products, n, F.asc("product_url"), F.asc("title"), F.asc("idx"))


def _snapshots(spark: SparkSession, store: str, domain: str) -> DataFrame:
    """Kept snapshots of a domain as rows of ``monitor``."""
    rows = spark.read.parquet(store).where(F.col("domain") == domain)
    return rows.select("domain", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("taken_at"), F.col("idx").cast("long").alias("idx"), "title", F.col("price").cast("string").alias("price"))


def _lines(df: DataFrame) -> list[str]:
    return [r[0] for r in export.plain_json(df).select(F.to_json(F.struct(*df.columns))).toLocalIterator()]


def run(args: argparse.Namespace, spark: SparkSession) -> list[str]:
    """The lines that a command prints."""
    name = args.command
    if name == "validate":
        products = payloads.json_file(spark, args.file).select(*[F.try_variant_get("raw", f"$.{f}", "string").alias(f) for f in validate.FIELDS], F.monotonically_increasing_id().alias("idx"))
        return _lines(validate.report(products, args.marketplace)) + _lines(validate.issues(products, args.marketplace).orderBy("idx", "field", "error"))
    if name == "changes":
        return _lines(monitor.changes(_snapshots(spark, args.store, args.domain)).orderBy("title_key"))
    if name == "history":
        return _lines(monitor.price_history(_snapshots(spark, args.store, args.domain), args.product).select("taken_at", "price").orderBy("taken_at"))
    if name == "compare":
        rows = products_of(Captures(spark, args.captures)).where(F.col("site").isin(*args.stores)).withColumn("store", F.col("site"))
        found = match.query_matches(rows, spark.createDataFrame([(args.query,)], "query string"))
        return _lines(found.orderBy("price", "idx")) + _lines(match.comparison(found))
    captures = Captures(spark, args.captures, args.site)
    if name == "detect":
        return _lines(extract.detect(captures.sites(), captures.get("pages"), captures.get("headers"), captures.get("probes")))
    if name == "discover":
        sites = extract.detect(captures.sites(), captures.get("pages"), captures.get("headers"), captures.get("probes")).select("site", "platform")
        links = captures.get("links")
        starts = links.select("site", F.concat(F.lit("https://"), "site", F.lit("/")).alias("url")).distinct() if links is not None else None
        maps = captures.get("sitemaps")
        maps = maps if maps is not None else spark.createDataFrame([], "site string, path string, body string")
        return _lines(discover.strategies(sites, maps, links, starts, args.max).orderBy("url"))
    products = products_of(captures)
    if name == "analyze":
        rows = _first(products, args.max)
        return _lines(extract.statistics(rows)) + _lines(analyze.top(analyze.count_field(rows, "vendor"), 20, F.desc("n"), "value"))
    if name == "snapshot":
        rows = _first(products, args.max)
        ident = export.append_snapshot(rows.select("idx", "title", "price", "currency", "vendor", "in_stock", "external_id", "product_url"), args.store, args.site)
        return [json.dumps({"snapshot": ident})]
    rows = _first(products, args.max)
    if not args.output:
        return _lines(_first(rows, SHOWN))
    if args.format == "csv":
        export.to_csv(rows, args.output, single=True)
    else:
        export.to_json(rows.coalesce(1), args.output, array=True)
    return [json.dumps({"written": args.output})]


def main(argv: list[str] | None = None) -> int:
    args = _arguments().parse_args(argv)
    spark = SparkSession.getActiveSession() or session()
    try:
        for line in run(args, spark):
            print(line)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
