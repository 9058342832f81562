"""The registry: names, stable schemas, and SQL beside the queries on the smallest data."""

import glob
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

CHECKED = ["a1_catalog_stats", "a9_brand_share", "a16_issues_ebay", "j6_changes", "a11_price_positions", "a12_comparison", "n1_shopify", "n10_json_ld", "f1_markdown_price", "detect_platform", "k3_google_items", "p3_found", "p4_found"]


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 1
    q = entry.queries()
    problems = range(1, 9) if entry.llm_plans else (2, 3, 4)
    assert set(entry.oracle_sql()) <= set(q) and all(any(k.startswith(f"p{n}_") for k in q) for n in problems)


def test_the_rest_works_without_the_llm_subpackage(tmp_path):
    """On a copy without both folders everything else imports, and the registry has the other problems."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__", ".pytest_cache")])
    code = "import __spark_entry__ as e, pkgutil, importlib, stockroom; [importlib.import_module(m.name) for m in pkgutil.walk_packages(stockroom.__path__, 'stockroom.')]; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def rows_of(rows):
    plain = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, sf, name):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = entry.queries()[name](spark, sf)
    assert sorted(got.columns) == columns
    assert rows_of(got.select(*columns).collect()) == rows_of(want.select(", ".join(f'"{x}"' for x in columns)).fetchall())
