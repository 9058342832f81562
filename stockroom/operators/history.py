"""Snapshots of tables: what changed between consecutive ones, and the bitemporal ledger of all versions.

A *delivery* is one row with an id (order of arrival), an entity group (domain), an instant and a list of records.
Deliveries of one group with the same instant are one *snapshot*, named by their smallest id. Each delivery is parsed
once into a compact table: sorted arrays of 64-bit key hashes and row hashes, the keys and versions beside them in
columns of their own that are read only for what differs. Everything later works on pairs of neighbouring snapshots,
cut into buckets by key hash, so that no task ever holds a whole group.
"""

from __future__ import annotations

import bisect
import json
import math
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from decimal import Decimal, InvalidOperation

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from stockroom.session import staged

#: Products of one snapshot that go into one bucket at most, about.
BUCKET_ROWS = 65_536

_OFFSET = re.compile(r"([+-])(\d{2}):?(\d{2})?$")


def instant_of(text: str | None) -> int | None:
    """Microseconds since 1970 (UTC) of an ISO 8601 time in any offset and notation; without offset it is UTC; None if unreadable."""
    if text is None:
        return None
    s = text.strip().replace(" ", "T", 1)
    if s[-1:] in "zZ":
        s = s[:-1] + "+00:00"
    try:
        t = datetime.fromisoformat(s)
    except ValueError:
        return None
    if t.tzinfo is None:
        t = t.replace(tzinfo=timezone.utc)
    d = t - _EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def number_text(value) -> str:
    """A price as canonical text of its number; ``0`` if missing or not a number."""
    if value is None or isinstance(value, (bool, list, dict)):
        return "0"
    try:
        d = Decimal(str(value).strip())
    except InvalidOperation:
        return "0"
    if not d.is_finite() or not d:
        return "0"
    return format(d.normalize(), "f") if abs(d.adjusted()) < 400 else str(d.normalize())


def version_of(product: dict) -> tuple[str, str, str, bool]:
    """(price, currency, vendor, in_stock) of a product, with the stated defaults for what is missing."""
    currency, vendor, stock = product.get("currency"), product.get("vendor"), product.get("in_stock")
    return number_text(product.get("price")), "USD" if currency is None else str(currency), "" if vendor is None else str(vendor), True if stock is None else bool(stock)


def title_key(product) -> str | None:
    """The product's name: its title in lower case without surrounding white space; None if blank or no text."""
    title = product.get("title") if isinstance(product, dict) else None
    return title.strip().lower() or None if isinstance(title, str) else None


def parse_products(text: str | None) -> dict[str, tuple] | None:
    """Version by key of a delivery, the last of equal keys; None if it is no JSON list."""
    if text is None:
        return None
    try:
        records = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(records, list):
        return None
    return {key: version_of(p) for p in records if (key := title_key(p)) is not None}


COMPACT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("domain", T.StringType()),
        T.StructField("instant", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("rows", T.ArrayType(T.LongType())),
        T.StructField("titles", T.ArrayType(T.StringType())),
        T.StructField("versions", T.ArrayType(T.StringType())),
    ]
)
_COMPACT = pa.schema(
    [("id", pa.int64()), ("domain", pa.string()), ("instant", pa.int64()), ("bucket", pa.int32()), ("keys", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("titles", pa.list_(pa.string())), ("versions", pa.list_(pa.string()))]
)


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def compact(deliveries: DataFrame, group: str = "domain", records: str = "products_json", at: str = "created_at", ident: str = "id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each readable delivery as rows of sorted hash arrays, one row per bucket of keys (at least one, also if it is empty).

    Unreadable deliveries (no JSON list, null, no readable time, null group) give none. The number of buckets is a power of
    two that follows the delivery's size, so buckets of a small and a large delivery nest.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            idents, domains, times = (batch.column(i).to_pylist() for i in range(3))
            for ident_, domain, time_, text in zip(idents, domains, times, batch.column(3)):
                instant = instant_of(time_)
                found = parse_products(text.as_py()) if instant is not None and domain is not None else None
                if found is None:
                    continue
                titles = np.array(list(found), dtype=object)
                versions = np.array([json.dumps(v, ensure_ascii=False) for v in found.values()], dtype=object)
                keys = np.array([_signed(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))) for t in titles], dtype=np.int64)
                rows = np.array([_signed(xxhash.xxh3_64_intdigest(v.encode("utf-8", "surrogatepass"))) for v in versions], dtype=np.int64)
                order = np.argsort(keys, kind="stable")
                n = 1 << max(0, math.ceil(math.log2(max(1, len(keys)) / bucket_rows)))
                buckets = keys[order] & (n - 1)
                for b in range(n):
                    part = order if n == 1 else order[buckets == b]
                    out.append((ident_, domain, instant, b if n > 1 else 0, keys[part], rows[part], [_clean(t) for t in titles[part]], list(versions[part]), n))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(c, _SIZED)], schema=_SIZED)

    sized = T.StructType([*COMPACT.fields, T.StructField("n_buckets", T.IntegerType())])
    return deliveries.select(F.col(ident).cast("long"), F.col(group).cast("string"), F.col(at).cast("string"), F.col(records)).mapInArrow(build, sized)


_SIZED = _COMPACT.append(pa.field("n_buckets", pa.int32()))


def _clean(text: str) -> str:
    """Lone surrogates, which JSON can hold and UTF-8 can't, as question marks."""
    return text.encode("utf-8", "replace").decode("utf-8")


def snapshots_of(compacted: DataFrame) -> DataFrame:
    """One row per snapshot: domain, instant, snap_id (its smallest delivery id)."""
    return compacted.groupBy("domain", "instant").agg(F.min("id").alias("snap_id"))


def neighbours(snaps: DataFrame) -> DataFrame:
    """Pairs of snapshots that were neighbours at some recorded time.

    Columns domain, from_id, from_instant, to_id, to_instant (null: none later), recorded_from, recorded_to (null: still).
    ``recorded_*`` are ids in order of arrival: the pair is believed from the arrival of its later-arrived side until one
    arrives between them. In the order of instants these are exactly the pairs of a snapshot and its nearest neighbour with
    a smaller id, to either side, found by a stack. The rows are range-partitioned by (domain, instant); a stack runs within
    each partition, and only snapshots whose neighbour lies in another partition meet a second, per-partition round.
    """
    ordered = snaps.select("domain", "instant", "snap_id").repartitionByRange("domain", "instant").sortWithinPartitions("domain", "instant")
    local = staged(ordered.mapInPandas(_nearest, _LOCAL_PAIRS))
    ends = local.groupBy("domain", "part").agg(F.min("snap_id").alias("lowest"))
    spans = ends.select("domain", F.col("part").alias("other"), "lowest")
    open_ = local.where("left_open or right_open")
    # for each open side: the nearest other partition of the domain that holds a smaller id
    sides = open_.where("left_open").select("domain", "snap_id", "instant", "part", F.lit("l").alias("side")).unionByName(open_.where("right_open").select("domain", "snap_id", "instant", "part", F.lit("r").alias("side")))
    reach = (
        sides.join(spans, "domain")
        .where("lowest < snap_id and ((side = 'l' and other < part) or (side = 'r' and other > part))")
        .groupBy("domain", "snap_id", "instant", "side")
        .agg(F.when(F.first("side") == "l", F.max("other")).otherwise(F.min("other")).alias("other"))
    )
    found = (
        reach.join(local.select("domain", F.col("part").alias("other"), F.col("snap_id").alias("near_id"), F.col("instant").alias("near_instant")), ["domain", "other"])
        .where("near_id < snap_id")
        .groupBy("domain", "snap_id", "instant", "side")
        .agg(F.when(F.first("side") == "l", F.max(F.struct("near_instant", "near_id"))).otherwise(F.min(F.struct("near_instant", "near_id"))).alias("near"))
        .select("domain", "snap_id", "instant", "side", "near.near_id", "near.near_instant")
    )
    inside = local.selectExpr("domain", "snap_id", "instant", "'l' as side", "left_id as near_id", "left_instant as near_instant").unionByName(
        local.selectExpr("domain", "snap_id", "instant", "'r' as side", "right_id as near_id", "right_instant as near_instant")
    ).where("near_id is not null")
    near = staged(inside.unionByName(found))
    pairs = near.selectExpr(
        "domain",
        "if(side = 'l', near_id, snap_id) as from_id",
        "if(side = 'l', near_instant, instant) as from_instant",
        "if(side = 'l', snap_id, near_id) as to_id",
        "if(side = 'l', instant, near_instant) as to_instant",
        "snap_id as recorded_from",
    )
    # a snapshot is followed by nothing while no later one has arrived
    tails = snaps.selectExpr("domain", "snap_id as from_id", "instant as from_instant", "cast(null as long) as to_id", "cast(null as long) as to_instant", "snap_id as recorded_from")
    has_right = near.where("side = 'r'").select("domain", F.col("snap_id").alias("from_id")).distinct()
    pairs = pairs.unionByName(tails.join(has_right, ["domain", "from_id"], "left_anti"))
    later = Window.partitionBy("domain", "from_id").orderBy("recorded_from")
    return staged(pairs.withColumn("recorded_to", F.lead("recorded_from").over(later)))


_LOCAL_PAIRS = "domain string, part int, snap_id long, instant long, left_id long, left_instant long, left_open boolean, right_id long, right_instant long, right_open boolean"


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nearest smaller id to either side within each domain's share of one sorted partition of compact rows."""
    from pyspark import TaskContext

    pdf = pd.concat(list(batches) or [pd.DataFrame({"domain": [], "instant": [], "snap_id": []})], ignore_index=True)
    if not len(pdf):
        return
    domains, times, ids = pdf["domain"].tolist(), pdf["instant"].tolist(), pdf["snap_id"].tolist()
    n = len(ids)
    left, right, stack = [-1] * n, [-1] * n, []
    for i in range(n):
        if i and domains[i] != domains[i - 1]:
            stack = []
        while stack and ids[stack[-1]] > ids[i]:
            right[stack.pop()] = i
        left[i] = stack[-1] if stack else -1
        stack.append(i)
    pick = lambda where, values: pd.array([values[j] if j >= 0 else None for j in where], dtype="Int64")
    yield pd.DataFrame(
        {"domain": domains, "part": TaskContext.get().partitionId(), "snap_id": ids, "instant": times, "left_id": pick(left, ids), "left_instant": pick(left, times), "left_open": [j < 0 for j in left], "right_id": pick(right, ids), "right_instant": pick(right, times), "right_open": [j < 0 for j in right]}
    )


DIFFS = T.StructType(
    [
        *[T.StructField(c, T.StringType() if c == "domain" else T.LongType()) for c in ("domain", "from_id", "to_id", "recorded_from", "recorded_to", "key")],
        T.StructField("change", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in ("old_row", "new_row", "delivery", "old_delivery")],
    ]
)
_HEAD = ["domain", "from_id", "to_id", "recorded_from", "recorded_to"]
#: Elements of a chunk of groups that are compared at once, about.
_CHUNK = 2_000_000


def _latest(pair: np.ndarray, key: np.ndarray, ident: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by (pair, key), of equal ones the last delivery."""
    order = np.lexsort((ident, key, pair))
    pair, key, ident, row = pair[order], key[order], ident[order], row[order]
    last = np.append((key[1:] != key[:-1]) | (pair[1:] != pair[:-1]), True) if len(key) else np.empty(0, bool)
    return pair[last], key[last], ident[last], row[last]


def _new_groups(t: pa.Table) -> np.ndarray:
    """Whether a row begins a new group: bucket of a pair of snapshots, told apart by the pair too where hashes are equal."""
    new = np.ones(t.num_rows, bool)
    if t.num_rows > 1:
        new[1:] = np.any([_differs(t[c].combine_chunks()) for c in ("group", "domain", "from_id", "to_id")], axis=0)
    return new


def _differs(column: pa.Array) -> np.ndarray:
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unequal | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _diff_table(t: pa.Table) -> pa.RecordBatch:
    """Differences of all whole groups in ``t`` (sorted by ``group``): set differences by binary search in sorted arrays."""
    fresh = _new_groups(t)
    starts = np.flatnonzero(fresh)
    pair = np.cumsum(fresh) - 1
    keys = t["keys"].combine_chunks()
    counts = np.diff(keys.offsets.to_numpy())
    first, last = keys.offsets[0].as_py(), keys.offsets[-1].as_py()
    flat = keys.values.to_numpy(zero_copy_only=False)[first:last]
    rows = t["rows"].combine_chunks()
    hashes = rows.values.to_numpy(zero_copy_only=False)[rows.offsets[0].as_py() : rows.offsets[-1].as_py()]
    ident, side, at = np.repeat(t["id"].to_numpy(), counts), np.repeat(t["later"].to_numpy(zero_copy_only=False).astype(bool), counts), np.repeat(pair, counts)
    _, rank = np.unique(flat, return_inverse=True)
    width = int(rank.max()) + 1 if len(rank) else 1
    pa_, ka, ia, ra = _latest(at[~side], rank[~side], ident[~side], hashes[~side])
    pb, kb, ib, rb = _latest(at[side], rank[side], ident[side], hashes[side])
    ca, cb = pa_ * width + ka, pb * width + kb

    def found(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.searchsorted(y, x)
        return where, (y[np.minimum(where, len(y) - 1)] == x) if len(y) else np.zeros(len(x), bool)

    where, common = found(cb, ca)
    _, kept = found(ca, cb)
    both = np.flatnonzero(common)
    both = both[rb[both] != ra[where[both]]]
    added, removed = np.flatnonzero(~common), np.flatnonzero(~kept)
    values = np.empty(width, np.int64)
    values[rank] = flat
    old = where[both]
    pairs = np.concatenate([pb[added], pa_[removed], pb[both]])
    key = values[np.concatenate([kb[added], ka[removed], kb[both]])]
    none = lambda n: np.ones(n, bool)
    has = np.zeros
    sizes = len(added), len(removed), len(both)
    old_missing = np.concatenate([none(sizes[0]), has(sizes[1], bool), has(sizes[2], bool)])
    new_missing = np.concatenate([has(sizes[0], bool), none(sizes[1]), has(sizes[2], bool)])
    zero = lambda n: np.zeros(n, np.int64)
    head = t.select(_HEAD).take(pa.array(starts)).combine_chunks().take(pa.array(pairs))
    return pa.RecordBatch.from_arrays(
        [
            *[head[c].combine_chunks() if isinstance(head[c], pa.ChunkedArray) else head[c] for c in _HEAD],
            pa.array(key),
            pa.array(np.repeat(np.array(["added", "removed", "changed"], dtype=object), sizes), pa.string()),
            pa.array(np.concatenate([zero(sizes[0]), ra[removed], ra[old]]), mask=old_missing),
            pa.array(np.concatenate([rb[added], zero(sizes[1]), rb[both]]), mask=new_missing),
            pa.array(np.concatenate([ib[added], ia[removed], ib[both]])),
            pa.array(np.concatenate([zero(sizes[0]), ia[removed], ia[old]]), mask=old_missing),
        ],
        names=[f.name for f in DIFFS.fields],
    )


def _diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of a partition sorted by ``group``, some at a time; the last group of a chunk waits for the next."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += len(batch.column("keys").flatten()) + batch.num_rows
        if size < _CHUNK:
            continue
        t = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(_new_groups(t))[-1])
        if cut:
            yield _diff_table(t.slice(0, cut))
            held, size = t.slice(cut).combine_chunks().to_batches(), 0
    if held:
        yield _diff_table(pa.Table.from_batches(held))


def diffs(compacted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hash-level differences of each pair of snapshots in ``pairs`` (see ``DIFFS``): only compact arrays are shuffled.

    A pair's deliveries are split into as many buckets of keys as its largest delivery has, so a task holds one bucket of
    one pair. A missing side (no earlier, or no later snapshot) counts as an empty snapshot.
    """
    pieces = compacted.select("domain", "instant", "id", "bucket", "n_buckets", "keys", "rows")
    sizes = pieces.groupBy("domain", "instant").agg(F.max("n_buckets").alias("n"))
    sided = pairs.join(sizes.select("domain", F.col("instant").alias("from_instant"), F.col("n").alias("na")), ["domain", "from_instant"], "left").join(
        sizes.select("domain", F.col("instant").alias("to_instant"), F.col("n").alias("nb")), ["domain", "to_instant"], "left"
    )
    sided = sided.withColumn("n", F.greatest(F.coalesce("na", F.lit(1)), F.coalesce("nb", F.lit(1))))
    wanted = sided.selectExpr("domain", "from_id", "to_id", "recorded_from", "recorded_to", "n", "'a' as side", "from_instant as instant").unionByName(
        sided.selectExpr("domain", "from_id", "to_id", "recorded_from", "recorded_to", "n", "'b' as side", "to_instant as instant")
    )
    met = wanted.where("instant is not null").join(pieces, ["domain", "instant"])
    # a piece of a coarser delivery is split into the finer buckets of its pair
    split = F.when(F.col("n") == F.col("n_buckets"), F.array(F.col("bucket"))).otherwise(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda b: b.bitwiseAND(F.col("n_buckets") - 1) == F.col("bucket")))
    met = met.withColumn("b", F.explode(split))
    fine = F.col("n") > F.col("n_buckets")
    of_bucket = F.filter(F.arrays_zip("keys", "rows"), lambda x: x["keys"].bitwiseAND(F.col("n").cast("long") - 1) == F.col("b"))
    met = met.withColumn("z", F.when(fine, of_bucket)).withColumns({"keys": F.when(fine, F.col("z.keys")).otherwise(F.col("keys")), "rows": F.when(fine, F.col("z.rows")).otherwise(F.col("rows"))}).drop("z")
    met = met.select(F.xxhash64("domain", "from_id", "to_id", "b").alias("group"), *_HEAD, "id", (F.col("side") == "b").alias("later"), "keys", "rows")
    return met.repartition("group").sortWithinPartitions("group", "domain", "from_id", "to_id").mapInArrow(_diff, DIFFS)


def with_texts(found: DataFrame, compacted: DataFrame, versions: bool = False) -> DataFrame:
    """``found`` with the title_key of its ``key`` (and the version of its ``row``), read only for hashes that occur in it.

    A text depends on its hash alone, so each task gives each text once before anything is shuffled, however many deliveries repeat it.
    """

    def texts(hashes: str, column: str, wanted: DataFrame) -> DataFrame:
        once = compacted.select(F.explode(F.arrays_zip(hashes, column)).alias("x")).groupBy(F.col(f"x.{hashes}").alias("hash")).agg(F.min(f"x.{column}").alias("text"))
        return wanted.distinct().join(once, "hash")

    named = texts("keys", "titles", found.select(F.col("key").alias("hash"))).withColumnsRenamed({"hash": "key", "text": "title_key"})
    found = found.join(named, "key")
    if versions:
        found = found.join(texts("rows", "versions", found.select(F.col("row").alias("hash"))).withColumnsRenamed({"hash": "row", "text": "version"}), "row")
    return found


def current_pairs(snaps: DataFrame) -> DataFrame:
    """The pairs of consecutive snapshots as known now: see ``neighbours``."""
    return neighbours(snaps).where("recorded_to is null")


def changes(deliveries: DataFrame, **names: str) -> DataFrame:
    """Domain, from_id, to_id, title_key and change (added, removed, changed) between each two consecutive snapshots.

    The first snapshot of a domain gives none, nor does one without a readable delivery; empty input gives no rows.
    """
    compacted = staged(compact(deliveries, **names))
    pairs = current_pairs(snapshots_of(compacted)).where("to_id is not null")
    found = staged(diffs(compacted, pairs))
    return with_texts(found, compacted).select("domain", "from_id", "to_id", "title_key", "change")


#: The ledger without texts: a version (``row``, a hash) of a product (``key``) valid from a snapshot on until another, as believed from an arrival on until another.
BELIEFS = "domain string, key long, row long, from_id long, from_instant long, to_id long, to_instant long, recorded_from long, recorded_to long"
_BELIEFS = pa.schema([("domain", pa.string()), *[(c, pa.int64()) for c in ("key", "row", "from_id", "from_instant", "to_id", "to_instant", "recorded_from", "recorded_to")]])


def _pairs_with_heads(snaps: DataFrame) -> DataFrame:
    """The pairs of ``neighbours`` that have a later side, and those of each snapshot with none before it, as long as none was known."""
    inner = neighbours(snaps).where("to_id is not null")
    followed = inner.groupBy("domain", "to_id").agg(F.min("recorded_from").alias("first_before"))
    heads = snaps.select("domain", F.col("snap_id").alias("to_id"), F.col("instant").alias("to_instant")).join(followed, ["domain", "to_id"], "left").where("first_before is null or first_before > to_id")
    heads = heads.selectExpr("domain", "cast(null as long) as from_id", "cast(null as long) as from_instant", "to_id", "to_instant", "to_id as recorded_from", "first_before as recorded_to")
    return staged(inner.select(heads.columns).unionByName(heads))


def _edges(compacted: DataFrame, pairs: DataFrame) -> DataFrame:
    """What the differences of ``pairs`` say of each product: at ``to_instant`` it got version ``row`` (null: it went), as believed from ``recorded_from`` until ``recorded_to``."""
    found = diffs(compacted, pairs.where("to_id is not null"))
    times = pairs.select("domain", "to_id", "to_instant").distinct()
    return found.join(times, ["domain", "to_id"]).select("domain", "key", F.col("new_row").alias("row"), "to_id", "to_instant", "recorded_from", "recorded_to")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the ledger from events sorted by product and recorded time, a product at a time.

    An event (``on``) puts an edge into the product's line of valid time or takes it out; a belief reaches from an edge with a version to the next edge. After each arrival only
    the edges touched and those before them can have another end: their beliefs are closed, and new ones opened. Beliefs known before (``since``) are already open.
    """
    out: list[tuple] = []
    product, now = None, None
    line: list[tuple[int, int]] = []  # (instant, snapshot) of the edges believed now
    rows: dict[tuple[int, int], int | None] = {}
    opened: dict[tuple[int, int], tuple] = {}  # row, end and arrival of the open beliefs
    touched: set[tuple[int, int]] = set()

    def settle() -> None:
        if not touched:
            return
        look = set()
        for edge in touched:
            i = bisect.bisect_left(line, edge)
            look |= {edge, *line[max(0, i - 1) : i]}
        for edge in sorted(look):
            i = bisect.bisect_left(line, edge)
            row = rows.get(edge)
            end = line[i + 1] if i + 1 < len(line) else (None, None)
            belief = (row, end) if row is not None else None
            before = opened.get(edge)
            if before is not None and before[:2] != belief:
                del opened[edge]
                if before[2] != now:  # never believed between two arrivals
                    close(edge, before, now)
            if belief is not None and edge not in opened:
                opened[edge] = (*belief, now)
        touched.clear()

    def close(edge: tuple[int, int], belief: tuple, until: int | None) -> None:
        row, (end_instant, end_id), since = belief
        out.append((*product, row, edge[1], edge[0], end_id, end_instant, since, until))

    def finish() -> None:
        settle()
        for edge in sorted(opened):
            close(edge, opened[edge], None)

    for batch in batches:
        for domain, key, at, on, row, ident, instant, since in zip(*(c.to_pylist() for c in batch.columns)):
            if (domain, key) != product:
                if product is not None:
                    finish()
                product, now = (domain, key), at
                line, rows, opened = [], {}, {}
            elif at != now:
                settle()
                now = at
            edge = (instant, ident)
            if on:
                if edge not in rows:
                    bisect.insort(line, edge)
                rows[edge] = row
            elif edge in rows:
                del rows[edge]
                line.pop(bisect.bisect_left(line, edge))
            if since is None:
                touched.add(edge)
                continue
            # beliefs known before come in the order of instants: the next edge is the end of the one before it
            if len(line) > 1 and (before := opened.get(line[-2])):
                opened[line[-2]] = (before[0], edge, before[2])
            if row is not None:
                opened[edge] = (row, (None, None), since)
        if len(out) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _BELIEFS)], schema=_BELIEFS)
            out.clear()
    if product is not None:
        finish()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _BELIEFS)], schema=_BELIEFS)


_EVENT = ["domain", "key", "at", "on", "row", "to_id", "to_instant", "since"]


def _swept(events: DataFrame) -> DataFrame:
    # at one arrival what goes comes before what comes
    return events.select(*_EVENT).repartition("domain", "key").sortWithinPartitions("domain", "key", "at", "on", "to_instant").mapInArrow(_sweep, BELIEFS)


def _events(edges: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long").alias("since")
    begun = edges.select("domain", "key", F.col("recorded_from").alias("at"), F.lit(True).alias("on"), "row", "to_id", "to_instant", none)
    ended = edges.where("recorded_to is not null").select("domain", "key", F.col("recorded_to").alias("at"), F.lit(False).alias("on"), "row", "to_id", "to_instant", none)
    return begun.unionByName(ended)


def beliefs(compacted: DataFrame) -> DataFrame:
    """The bitemporal ledger of all deliveries of a staged ``compact`` table, without texts: see ``BELIEFS``.

    Each row says that, from the arrival ``recorded_from`` until ``recorded_to`` (null: still), the product was believed to have version ``row`` from snapshot ``from_id`` until
    ``to_id`` (null: no later snapshot differs). A late snapshot splits the interval it falls in: the older row gets its ``recorded_to`` and new rows follow it; none is overwritten.
    Only changes make rows, however many snapshots repeat a version.
    """
    return _swept(_events(_edges(compacted, _pairs_with_heads(snapshots_of(compacted)))))


def supersede(known: DataFrame, compacted: DataFrame, arrived: int) -> DataFrame:
    """What the deliveries from id ``arrived`` on add to the ledger ``known``: rows to be appended (``known``'s columns).

    ``compacted`` has all deliveries. Only pairs of snapshots that those deliveries made or ended are compared, and only the products that differ there are swept, from the
    beliefs about them that are open. A row with the keys of a known open one and a ``recorded_to`` supersedes it (``current`` reads it so); the others are new.
    Snapshots that get a further delivery of their instant keep what was recorded of them.
    """
    snaps = snapshots_of(compacted)
    pairs = _pairs_with_heads(snaps).where((F.col("recorded_from") >= arrived) | (F.col("recorded_to") >= arrived))
    edges = staged(_edges(compacted, pairs))
    open_ = current(known).where("recorded_to is null").join(edges.select("domain", "key").distinct(), ["domain", "key"], "left_semi")
    open_ = staged(open_)
    starts = open_.select("domain", "key", F.lit(-1).cast("long").alias("at"), F.lit(True).alias("on"), "row", F.col("from_id").alias("to_id"), F.col("from_instant").alias("to_instant"), F.col("recorded_from").alias("since"))
    gone = open_.where("to_id is not null").select("domain", "key", "to_id", "to_instant").join(open_.select("domain", "key", F.col("from_id").alias("to_id")), ["domain", "key", "to_id"], "left_anti")
    ends = gone.select("domain", "key", F.lit(-1).cast("long").alias("at"), F.lit(True).alias("on"), F.lit(None).cast("long").alias("row"), "to_id", "to_instant", F.lit(0).cast("long").alias("since"))
    late = _events(edges).where(F.col("at") >= arrived)
    swept = _swept(starts.unionByName(ends).unionByName(late))
    # beliefs that stay as they were aren't written again
    same = ["domain", "key", "row", "from_id", "recorded_from"]
    ended = lambda df: df.withColumn("_to", F.coalesce("to_id", F.lit(-1)))
    still = ended(swept.where("recorded_to is null")).join(ended(open_).select(*same, "_to"), [*same, "_to"], "left_anti").drop("_to")
    return swept.where("recorded_to is not null").unionByName(still)


def current(appended: DataFrame) -> DataFrame:
    """The ledger of an append-only table of its rows: of rows that differ in ``recorded_to`` only, the closed one counts."""
    same = ["domain", "key", "row", "from_id", "from_instant", "to_id", "to_instant", "recorded_from"]
    return appended.groupBy(*same).agg(F.min("recorded_to").alias("recorded_to"))


def ledger(deliveries: DataFrame, **names: str) -> DataFrame:
    """The bitemporal ledger with its texts: domain, title_key, price, currency, vendor, in_stock, from_id, to_id (null: none yet), recorded_from, recorded_to (null: still); see ``beliefs``."""
    compacted = staged(compact(deliveries, **names))
    v = F.from_json("version", "array<string>")
    rows = with_texts(staged(beliefs(compacted)), compacted, versions=True).withColumn("v", v)
    return rows.selectExpr("domain", "title_key", "v[0] as price", "v[1] as currency", "v[2] as vendor", "v[3] = 'true' as in_stock", "from_id", "to_id", "recorded_from", "recorded_to")


def versions(deliveries: DataFrame, **names: str) -> DataFrame:
    """Unbroken runs of equal versions as known now, the open rows of the ledger: domain, title_key, from_id, to_id (0: still valid)."""
    compacted = staged(compact(deliveries, **names))
    rows = staged(beliefs(compacted).where("recorded_to is null"))
    return with_texts(rows, compacted).select("domain", "title_key", "from_id", F.coalesce("to_id", F.lit(0)).cast("long").alias("to_id"))
