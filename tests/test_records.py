"""Nested records, histories and snapshot differences against plain brute force."""

import json
import re
from collections import defaultdict
from datetime import datetime, timezone
from decimal import Decimal

import pytest

from stockroom.operators import history, shred
from stockroom.plans import records
from stockroom.session import staged as session_staged, table

PAGES = "page_id long, body string, path string"
DELIVERIES = "id long, domain string, products_json string, created_at string, extra string"


def plain_pages(rows, kind):
    """(page_id, path, item_id) by direct recursion over the layout."""
    layout = {
        "shopify": {"products": ("id", {"variants": ("id", {"option_values": ("name", {})}), "images": ("src", {})})},
        "woocommerce": {"": ("id", {"images": ("src", {}), "tags": ("name", {}), "categories": ("name", {}), "variations": ("id", {"attributes": ("name", {})})})},
    }[kind]
    out = []

    def listing(v):
        if isinstance(v, str):
            try:
                w = json.loads(v)
            except ValueError:
                w = None
            if isinstance(w, list):
                return w
            return [v] if v.strip() else []
        return v if isinstance(v, list) else [] if v is None else [v]

    def walk(page, value, path, key, below):
        for i, e in enumerate(listing(value)):
            if e is None:
                continue
            place = f"{path}[{i}]"
            ident = e.get(key) if isinstance(e, dict) else e
            out.append((page, place, "" if ident is None else str(ident)))
            if isinstance(e, dict):
                for name, (k, b) in below.items():
                    walk(page, e.get(name), f"{place}.{name}", k, b)

    for page, body in rows:
        try:
            value = json.loads(body or "")
        except ValueError:
            continue
        (name, (key, below)), = layout.items()
        if name and isinstance(value, dict):
            walk(page, value.get(name), name, key, below)
        elif not name and isinstance(value, list):
            walk(page, value, "", key, below)
    return sorted(out)


def test_p2_equals_plain_recursion(spark, sf):
    got = records.p2_found(spark, sf).collect()
    for kind in ("shopify", "woocommerce"):
        want = plain_pages([(r.page_id, r.body) for r in table(spark, sf, f"{kind}_products").collect()], kind)
        assert sorted((r.page_id, r.path, r.item_id) for r in got if r.src == kind) == want and want


def test_p2_odd_pages(spark):
    bodies = [
        '{"products": [null, {"id": 7, "variants": {"id": "8", "price": 1.5}, "images": ["u", null, {"src": null}]}], "more": 1}',
        '{"products": [{"id": 9, "variants": "[{\\"id\\": 10, \\"option_values\\": {\\"name\\": \\"c\\"}}]", "images": "http://x", "body": ""}]}',
        '{"products": {"id": null}}', '{"products": null}', '{"errors": 1}', "[]", "null", "", None, '{"products": [{"id": 1', '{"products": [{"id": NaN}]}',
    ]
    pages = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], PAGES)
    graph = shred.schema_graph(pages, "body", "products", "products", ("variants", "option_values", "images"))
    rows = shred.nodes(pages, "page_id", "body", "products", graph).collect()
    got = {(r.page_key, r.path, r.item or r.columns.get("id") or r.columns.get("src") or r.columns.get("name") or "") for r in rows}
    assert got == {
        (0, "products[1]", "7"), (0, "products[1].variants[0]", "8"), (0, "products[1].images[0]", "u"), (0, "products[1].images[2]", ""),
        (1, "products[0]", "9"), (1, "products[0].variants[0]", "10"), (1, "products[0].variants[0].option_values[0]", "c"), (1, "products[0].images[0]", "http://x"),
        (2, "products[0]", ""),
    }


def test_inlining_keeps_parents_and_finds_shared_and_recursive_elements(spark):
    body = json.dumps([{"id": 1, "prices": {"price": "5", "unit": {"code": "EUR"}}, "maker": {"address": {"town": "a"}}, "shop": {"address": {"town": "b"}}, "part": {"id": 2, "part": {"id": 3}}}])
    tables = shred.flat_tables(spark.createDataFrame([(1, body, "")], PAGES), "page_id", "body", None, "items")
    assert set(tables) == {"items", "address", "part"}
    item = tables["items"].collect()[0]
    assert item.prices_price == "5" and item.prices_unit_code == "EUR" and item.parent_id is None
    parts = {r.node_id: r for r in tables["part"].collect()}
    assert [parts[k].parent_id in parts or parts[k].parent_id == item.node_id for k in parts] == [True, True]
    assert {r.town for r in tables["address"].collect()} == {"a", "b"}
    assert all(not t.limit(0).count() for t in shred.flat_tables(spark.createDataFrame([], PAGES), "page_id", "body", None, "items").values())


def plain_states(rows):
    """Per domain the snapshots in order of instant: (smallest id, versions by key)."""
    found = defaultdict(dict)
    for r in sorted(rows, key=lambda r: r[0]):
        ident, domain, text, at = r[:4]
        try:
            products = json.loads(text or "")
            t = datetime.fromisoformat(re.sub("Z$", "+00:00", at))
        except ValueError:
            continue
        if not isinstance(products, list):
            continue
        t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
        state = found[domain].setdefault(t, (ident, {}))[1]
        for p in products:
            key = ((p.get("title") if isinstance(p, dict) else None) or "").strip().lower()
            if key:
                try:
                    price = Decimal(str(p.get("price")).strip())
                except ArithmeticError:
                    price = Decimal(0)
                state[key] = (price, "USD" if p.get("currency") is None else p["currency"], p.get("vendor") or "", p.get("in_stock", True) is not False)
    return {d: [v for _, v in sorted(x.items())] for d, x in found.items()}


def plain_changes(rows):
    out = []
    for d, states in plain_states(rows).items():
        for (a, x), (b, y) in zip(states, states[1:]):
            out += [(d, a, b, k, "added" if k not in x else "removed" if k not in y else "changed") for k in x | y if x.get(k) != y.get(k)]
    return sorted(out)


def plain_versions(rows):
    out = []
    for d, states in plain_states(rows).items():
        for i, (ident, x) in enumerate(states):
            for k, v in x.items():
                if not i or states[i - 1][1].get(k) != v:
                    out.append((d, k, ident, next((b for b, y in states[i + 1 :] if y.get(k) != v), 0)))
    return sorted(out)


def test_p3_and_p4_equal_plain_loops(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "snapshots").select("id", "domain", "products_json", "created_at").collect()]
    assert sorted(tuple(r) for r in records.p4_found(spark, sf).collect()) == plain_changes(rows)
    assert sorted(tuple(r) for r in records.p3_found(spark, sf).select("domain", "title_key", "from_id", "to_id").collect()) == plain_versions(rows)


def odd_deliveries():
    p = lambda *x: json.dumps([{"title": t, "price": v} for t, v in x])
    return [
        (1, "a", p(("X", 1), ("Y", "2.00")), "2026-01-01T00:00:00Z", "e"), (2, "a", p((" x ", "1.0"), ("y", 3), ("Z", None)), "2026-01-05T02:00:00+02:00", "e"),
        (3, "a", p(("x", 9)), "2026-01-03 00:00:00", "e"), (4, "a", p(("X", 9), ("X", 1)), "2026-01-03T00:00:00+00:00", "e"), (5, "a", "[]", "2026-01-02T00:00:00Z", "e"),
        (6, "a", "{}", "2026-01-04T00:00:00Z", "e"), (7, "a", None, "2026-01-04T00:00:00Z", "e"), (8, "a", "[1, null, {}]", "bad", "e"), (9, None, "[]", "2026-01-04T00:00:00Z", "e"),
        (10, "b", "[null, {\"title\": null}, {\"title\": \" \"}]", "2026-01-04T00:00:00Z", "e"), (11, "b", p(("long " * 30_000, "n/a")), "2026-01-06T00:00:00Z", "e"),
    ]


@pytest.mark.parametrize("bucket_rows", [65_536, 1])
def test_odd_deliveries(spark, bucket_rows):
    rows = [r for r in odd_deliveries() if r[1]]
    df = spark.createDataFrame(odd_deliveries(), DELIVERIES)
    assert sorted(tuple(r) for r in history.changes(df, bucket_rows=bucket_rows).collect()) == plain_changes(rows)
    assert sorted(tuple(r) for r in history.versions(df, bucket_rows=bucket_rows).collect()) == plain_versions(rows)
    assert history.changes(df.limit(0)).count() == history.versions(df.limit(0)).count() == history.ledger(df.limit(0)).count() == 0


def test_ledger_gives_every_past_belief(spark):
    """At each recorded time the open rows are the runs of equal versions of the snapshots known then; unchanged products have no further rows."""
    rows = odd_deliveries()
    ledger = history.ledger(spark.createDataFrame(rows, DELIVERIES)).collect()
    for now in (1, 2, 3, 5, 11):
        # a further delivery of a known instant counts from the beginning
        known = [r for r in rows if r[1] and (r[0] <= now or r[0] == 4 and now == 3)]
        got = sorted((r.domain, r.title_key, r.from_id, r.to_id or 0) for r in ledger if r.recorded_from <= now and (r.recorded_to is None or r.recorded_to > now))
        assert got == plain_versions(known)


def test_late_deliveries_supersede_known_rows(spark):
    """Appending what later deliveries add gives the same ledger as building it at once, and rewrites no row."""
    import random

    rnd = random.Random(3)
    titles = [f"t{i}" for i in range(9)]
    rows = []
    for i, day in enumerate(rnd.sample(range(1, 29), 20)):
        products = [{"title": t, "price": rnd.choice([1, 1, 1, 2])} for t in titles if rnd.random() < 0.8]
        rows.append((i + 1, "ab"[i % 5 == 0], json.dumps(products), f"2026-01-{day:02d}T00:00:00Z", "e"))
    every = lambda rows: session_staged(history.compact(spark.createDataFrame(rows, DELIVERIES)))
    whole = every(rows)
    want = [tuple(r) for r in history.beliefs(whole).select(*BELIEF).collect()]
    known = session_staged(history.beliefs(every(rows[:12])))
    for upto, arrived in ((16, 13), (20, 17)):
        added = session_staged(history.supersede(known, every(rows[:upto]), arrived))
        assert 0 < added.count() < len(want)
        known = known.unionByName(added)
    assert sorted(tuple(-1 if x is None else x for x in r) for r in history.current(known).select(*BELIEF).collect()) == sorted(tuple(-1 if x is None else x for x in r) for r in want)


BELIEF = ["domain", "key", "row", "from_id", "to_id", "recorded_from", "recorded_to"]


def test_neighbours_across_partitions_equal_brute_force(spark):
    import random

    rnd = random.Random(5)
    rows = [(d, t, i) for d in "ab" for i, t in enumerate(rnd.sample(range(1000), 120))]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {(r.domain, r.from_id, r.to_id, r.recorded_from, r.recorded_to) for r in history.neighbours(spark.createDataFrame(rows, "domain string, instant long, snap_id long").select("domain", "instant", "snap_id")).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want = set()
    for d in "ab":
        known, since = [], {}
        for i, t in sorted((i, t) for x, t, i in rows if x == d):
            known = sorted([*known, (t, i)])
            at = known.index((t, i))
            before, after = known[at - 1][1] if at else None, known[at + 1][1] if at + 1 < len(known) else None
            if before is not None:
                then, start = since[before]
                want.add((d, before, then, start, i))
                since[before] = (i, i)
            since[i] = (after, i)
        want |= {(d, a, b, start, None) for a, (b, start) in since.items()}
    assert got == want
