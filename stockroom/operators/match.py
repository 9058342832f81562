"""Fuzzy and exact matching of products by title and identifier.

Similarity is Ratcliff/Obershelp's ratio of stripped lower-case titles; it isn't symmetric, so argument order is kept. Distinct titles are compared, not rows, in three
lossless steps. (1) At ratio t two titles of n characters in all match in t n / 2 of them, in at most n (1 - t) + 1 blocks, so they share
t n / 2 - (q - 1) (n (1 - t) + 1) of their q-grams, in the same order and with places that differ by no more than the longer title has unmatched characters: the rarest q-grams
of the two must meet. (2) What meets is bounded by the counts of characters and of pairs of them, in numpy. (3) The ratio itself is computed for the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from stockroom.functions import text as X
from stockroom.session import staged

#: Buckets of the table of how often q-grams occur (256 kB), which only orders them.
BUCKETS = 1 << 16


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


similarity = _similarity.asNondeterministic()


def title_similarity(a, b):
    """Similarity of two title columns, 0 to 1; two blank titles are equal."""
    return similarity(X.key(a), X.key(b))


def _length(threshold: float) -> int:
    """The q of the q-grams: the longer, the rarer, but the more of them each difference breaks."""
    return 3 if threshold >= 0.87 else 2 if threshold >= 0.72 else 1


def _shared(n: int, q: int, threshold: float) -> int:
    """How many q-grams a title of ``n`` characters shares with any similar one at least; not above 0 if none is sure."""
    both = 2 * n / (2 - threshold)  # with the shortest partner
    return math.ceil(both * threshold / 2 - (q - 1) * (both * (1 - threshold) + 1) - 1e-9)


def _grams(title: str, q: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(title[i : i + q]) - (1 << 63) for i in range(len(title) - q + 1)]


def _frequencies(titles: DataFrame, q: int) -> np.ndarray:
    """How many q-grams of the titles fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += np.bincount(np.array(_grams(t, q), np.int64) & (BUCKETS - 1), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    table = np.zeros(BUCKETS, np.int64)
    for r in titles.select("t").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # BUCKETS rows at most
        table[r.bucket] = r.n
    return table


def _signatures(titles: DataFrame, threshold: float) -> DataFrame:
    """``titles`` with one row per q-gram of which a similar title must have one: ``gram``, ``at`` (its place) and ``n`` (the title's length)."""
    q = _length(threshold)
    shared = titles.sparkSession.sparkContext.broadcast({k: _frequencies(titles, k) for k in {q, 1}})
    carried = [c for c in titles.columns if c != "t"]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in titles.schema if f.name != "t") + ", gram long, at int, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams, places, lengths = [], [], [], []
            for i, t in enumerate(batch.column("t").to_pylist()):
                # titles too short for sure q-grams have all of them, for longer ones, and single characters, for each other
                kinds = [(q, 0), (1, 1)] if q > 1 and _shared(len(t), q, threshold) < 1 else [(q, 0)]
                for k, mark in kinds:
                    found = _grams(t, k)
                    need = _shared(len(t), k, threshold)
                    keep = len(found) - need + 1 if need >= 1 else len(found)
                    table = shared.value[k]
                    for _, g, at in sorted((table[g & (BUCKETS - 1)], g, at) for at, g in enumerate(found))[:keep]:
                        rows.append(i)
                        grams.append(g ^ mark)
                        places.append(at)
                        lengths.append(len(t))
            taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in carried]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(grams, pa.int64()), pa.array(places, pa.int32()), pa.array(lengths, pa.int32())], names=[*carried, "gram", "at", "n"])

    return titles.select("t", *carried).mapInArrow(run, out)


def _counts(texts: list[str], q: int, size: int) -> np.ndarray:
    """How often each bucket of q-grams occurs in each text."""
    table = np.zeros((len(texts), size), np.uint16)
    for row, t in zip(table, texts):
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if len(points) >= q:
            at = points if q == 1 else points[:-1] * 31 + points[1:]
            row += np.bincount(at % size, minlength=size).astype(np.uint16)
    return table


def _ratios(pairs: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (ta, tb) with ``sim`` of those whose ratio reaches the threshold; bounds from counts come first."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            texts = sorted({*a, *b})
            place = {t: i for i, t in enumerate(texts)}
            ia, ib = np.array([place[t] for t in a], np.int64), np.array([place[t] for t in b], np.int64)
            both = np.array([len(x) + len(y) for x, y in zip(a, b)], float)
            likely = np.arange(len(a))
            for q, size, least in ((1, 96, threshold / 2 * both), (2, 384, (1.5 * threshold - 1) * both - 1)):
                table = _counts(texts, q, size)
                kept = [np.minimum(table[ia[part]], table[ib[part]]).sum(1) >= least[part] - 1e-6 for part in np.array_split(likely, max(1, len(likely) // 4096))]
                likely = likely[np.concatenate(kept)] if kept else likely
            found, sims = [], []
            matcher = SequenceMatcher(None)
            last = None
            for i in sorted(likely.tolist(), key=lambda i: b[i]):
                if b[i] != last:
                    last = b[i]
                    matcher.set_seq2(last)
                matcher.set_seq1(a[i])
                sim = matcher.ratio()
                if sim >= threshold:
                    found.append(i)
                    sims.append(sim)
            taken = batch.take(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(sims, pa.float64())], names=[*names, "sim"])

    return pairs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", sim double")


def candidates(titles: DataFrame, threshold: float, same: bool = False) -> DataFrame:
    """``x``, ``y``: ids of the titles (t, id and in_a, in_b, or with ``same`` first) that may be similar; with ``same`` the one with the lower first is x."""
    grams = staged(_signatures(titles, threshold))
    sides = ("first",) if same else ("in_a", "in_b")
    x = (grams if same else grams.where("in_a")).select("gram", F.col("id").alias("x"), F.col("at").alias("x_at"), F.col("n").alias("x_n"), *[F.col(c).alias(f"x_{c}") for c in sides])
    y = (grams if same else grams.where("in_b")).select("gram", F.col("id").alias("y"), F.col("at").alias("y_at"), F.col("n").alias("y_n"), *[F.col(c).alias(f"y_{c}") for c in sides])
    share = threshold / (2 - threshold)
    near = (F.greatest("x_n", "y_n") * share - 1e-9 <= F.least("x_n", "y_n")) & (F.abs(F.col("x_at") - F.col("y_at")) <= F.greatest("x_n", "y_n") - (F.col("x_n") + F.col("y_n")) * (threshold / 2) + 1e-9)
    pairs = x.join(y, "gram").where(near & (F.col("x_first") < F.col("y_first") if same else F.col("x") != F.col("y")))
    return pairs.select("x", "y").distinct()


def similar_titles(a: DataFrame, b: DataFrame, threshold: float, same: bool = False) -> DataFrame:
    """``ta``, ``tb``, ``sim`` of the distinct titles (columns ``t``) with sim >= threshold and > 0.

    With ``same`` both sides are one set, each title of which has a ``first``; each pair comes out once, the title with the lower first as ``ta``, and equal titles aren't paired.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and be 1 at most")
    if same:
        titles = a.groupBy("t").agg(F.min("first").alias("first"))
    else:
        titles = a.select("t", F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).unionByName(b.select("t", F.lit(False).alias("in_a"), F.lit(True).alias("in_b"))).groupBy("t").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    titles = staged(titles.where("t is not null").withColumn("id", F.monotonically_increasing_id()))
    ids = candidates(titles, threshold, same)
    named = lambda t, i: titles.select(F.col("t").alias(t), F.col("id").alias(i))
    found = _ratios(ids.join(named("ta", "x"), "x").join(named("tb", "y"), "y").select("ta", "tb"), threshold)
    return found if same else found.unionByName(titles.where("in_a and in_b").select(F.col("t").alias("ta"), F.col("t").alias("tb"), F.lit(1.0).alias("sim")))


def _parts(edges: DataFrame, titles: DataFrame) -> DataFrame:
    """``id`` and ``part``: titles that ``edges`` (``x``, ``y``) connect have the same part."""
    both = edges.where("x <> y").select("x", "y").union(edges.where("x <> y").select("y", "x"))
    parts = staged(titles.select("id", F.col("id").alias("part")))
    while True:
        near = both.join(parts, F.col("y") == F.col("id")).groupBy("x").agg(F.min("part").alias("low"))
        low = staged(parts.join(near, F.col("id") == F.col("x"), "left").select("id", F.least("part", "low").alias("low"), F.coalesce(F.col("low") < F.col("part"), F.lit(False)).alias("moved")))
        if low.where("moved").isEmpty():
            return parts
        parts = staged(low.select("id", "low").join(low.select(F.col("id").alias("low"), F.col("low").alias("part")), "low").select("id", "part"))


def _assign(rows: pa.Table) -> pa.Table:
    """The assignment within one part: rows of an ``a`` (x), rows of a ``b`` (y) and similar titles (x, y, sim). Of equal titles the lowest ``b`` goes first, so a title is a queue."""
    x, y, sim, idx = (rows.column(c) for c in ("x", "y", "sim", "idx"))
    of = lambda keep, *columns: [c.filter(keep).to_numpy() for c in columns]
    queues: dict[int, Iterator[int]] = {}
    heads: dict[int, int | None] = {}
    titles, numbers = of(pc.is_null(x), y, idx)
    order = np.lexsort((numbers, titles))
    titles, numbers = titles[order], numbers[order]
    starts = np.flatnonzero(np.r_[True, titles[1:] != titles[:-1]]) if len(titles) else []
    for start, end in zip(starts, [*starts[1:], len(titles)]):
        queues[int(titles[start])] = iter(numbers[start:end])
        heads[int(titles[start])] = int(next(queues[int(titles[start])]))
    liked: dict[int, list[tuple[float, int]]] = {}
    for s, t, r in zip(*of(pc.is_valid(sim), sim, x, y)):
        liked.setdefault(int(t), []).append((float(s), int(r)))
    for choices in liked.values():
        choices.sort(reverse=True)
    found = []
    titles, numbers = of(pc.is_null(y), x, idx)
    for i in np.argsort(numbers, kind="stable"):
        choices = liked[int(titles[i])]
        while choices and heads[choices[0][1]] is None:
            choices.pop(0)
        tied = [(heads[t], t) for s, t in takewhile(lambda c: c[0] == choices[0][0], choices) if heads[t] is not None]
        if tied:
            b, t = min(tied)
            found.append((int(numbers[i]), b, choices[0][0]))
            heads[t] = next(queues[t], None)
    columns = list(zip(*found)) or [[], [], []]
    return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64()), "sim": pa.array(columns[2], pa.float64())})


def fuzzy_match(a: DataFrame, b: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``a``, ``b``, ``sim``: one-to-one matches of two catalogues by title: in order of ``a``, each takes its best ``b`` (highest sim, then lowest b) that is still free.

    Titles that aren't connected by similar ones don't compete, so each connected part is assigned by itself, in time and memory in proportion to its rows.
    """
    kinds = a.schema["idx"].dataType, b.schema["idx"].dataType
    a, b = a.select("idx", X.key("title").alias("t")), b.select("idx", X.key("title").alias("t"))
    similar = staged(similar_titles(a, b, threshold))
    titles = staged(similar.select(F.col("ta").alias("t")).union(similar.select("tb")).distinct().select("t", F.monotonically_increasing_id().alias("id")))
    named = lambda c, to: titles.select(F.col("t").alias(c), F.col("id").alias(to))
    edges = staged(similar.join(named("ta", "x"), "ta").join(named("tb", "y"), "tb").select("x", "y", "sim"))
    parts = _parts(edges, titles)
    ends = titles.join(parts, "id")
    none = lambda kind: F.lit(None).cast(kind)
    number = F.col("idx").cast("long").alias("idx")
    mine = a.join(similar.select(F.col("ta").alias("t")).distinct(), "t").join(ends, "t").select("part", F.col("id").alias("x"), none("long").alias("y"), none("double").alias("sim"), number)
    theirs = b.join(similar.select(F.col("tb").alias("t")).distinct(), "t").join(ends, "t").select("part", none("long").alias("x"), F.col("id").alias("y"), none("double").alias("sim"), number)
    pairs = edges.join(parts, F.col("x") == F.col("id")).select("part", "x", "y", "sim", none("long").alias("idx"))
    found = mine.unionByName(theirs).unionByName(pairs).groupBy("part").applyInArrow(_assign, "a long, b long, sim double")
    return found.select(F.col("a").cast(kinds[0]).alias("a"), F.col("b").cast(kinds[1]).alias("b"), "sim")


def catalog_diff(a: DataFrame, b: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``a``, ``b``, ``side`` (only_a, only_b, both), ``price_class`` (cheaper_a, cheaper_b, equal; null unless both)."""
    m = staged(fuzzy_match(a, b, threshold))
    pa_, pb = a.select(F.col("idx").alias("a"), X.money("price").alias("pa")), b.select(F.col("idx").alias("b"), X.money("price").alias("pb"))
    both = m.join(pa_, "a").join(pb, "b").select("a", "b", F.lit("both").alias("side"), F.when(F.col("pa") < F.col("pb"), "cheaper_a").when(F.col("pb") < F.col("pa"), "cheaper_b").otherwise("equal").alias("price_class"))
    nothing = F.lit(None).cast("string").alias("price_class")
    only_a = pa_.join(m, "a", "left_anti").select("a", F.lit(None).cast(b.schema["idx"].dataType).alias("b"), F.lit("only_a").alias("side"), nothing)
    only_b = pb.join(m, "b", "left_anti").select(F.lit(None).cast(a.schema["idx"].dataType).alias("a"), "b", F.lit("only_b").alias("side"), nothing)
    return both.unionByName(only_a).unionByName(only_b)


def title_duplicates(products: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Similar titles within one catalogue, as pairs of classes: ``title_a``, ``title_b``, ``sim``, ``first_a``, ``first_b``, ``n_a``, ``n_b``.

    A class is all rows of one title (white space collapsed, lower case, blank ones skipped), named by its first idx; ``duplicate_members`` has the membership. The side
    with the earlier first row is ``a``, as in comparing every later row with every earlier one.
    """
    classes = duplicate_members(products).groupBy("t").agg(F.min("idx").alias("first"), F.count("*").alias("n"))
    found = similar_titles(classes.select("t", "first"), classes, threshold, same=True)
    ca, cb = classes.select(F.col("t").alias("ta"), F.col("first").alias("first_a"), F.col("n").alias("n_a")), classes.select(F.col("t").alias("tb"), F.col("first").alias("first_b"), F.col("n").alias("n_b"))
    return found.join(ca, "ta").join(cb, "tb").select(F.col("ta").alias("title_a"), F.col("tb").alias("title_b"), "sim", "first_a", "first_b", "n_a", "n_b")


def duplicate_members(products: DataFrame) -> DataFrame:
    """``idx`` and ``t``, the class of its title."""
    return products.select("idx", F.regexp_replace(X.key("title"), r"(?U)\s+", " ").alias("t")).where("t <> ''")


def match_identifiers(products: DataFrame, wanted: DataFrame, fields: tuple[str, ...] = ("gtin", "ean", "upc", "sku")) -> DataFrame:
    """``wanted_id``, ``idx``: products one of whose identifiers equals a wanted one (column ``wanted_id``), white space apart; blanks match nothing."""
    have = [X.stripped(f) for f in fields if f in products.columns]
    ids = products.select("idx", F.explode(F.array_distinct(F.array(*have))).alias("wanted_id")).where("wanted_id <> ''")
    return wanted.select(X.stripped("wanted_id").alias("wanted_id")).distinct().join(ids, "wanted_id").select("wanted_id", "idx")


def query_matches(products: DataFrame, queries: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Products like a query: query, idx, store, price, sim. Zero prices stay."""
    q = queries.select("query", X.key("query").alias("ta"))
    p = products.select("idx", "store", "title", X.money("price").alias("price"), X.key("title").alias("tb"))
    titles = similar_titles(q.select(F.col("ta").alias("t")), p.select(F.col("tb").alias("t")), threshold)
    return q.join(titles, "ta").join(p, "tb").select("query", "idx", "store", "title", "price", "sim")


def comparison(matches: DataFrame) -> DataFrame:
    """Per query: matches, cheapest (first of ties), most expensive (last of ties), average and spread of prices."""
    order = F.struct("price", "idx")
    return matches.groupBy("query").agg(
        F.count("*").alias("matches"), F.min_by("idx", order).alias("cheapest"), F.max_by("idx", order).alias("most_expensive"),
        F.round(F.avg(F.col("price").cast("decimal(20,6)")), 2).cast("decimal(20,2)").alias("average"), (F.max("price") - F.min("price")).cast("decimal(20,2)").alias("spread"),
    )


def best_competitors(mine: DataFrame, others: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per own product and store the most similar title's row, first of ties; a best match without a valid price drops the store: idx, store, competitor, competitor_price, sim.

    Similarity must reach the threshold; own titles that are blank match nothing.
    """
    m = mine.select("idx", X.key("title").alias("ta")).where("ta <> ''")
    o = others.select(F.col("idx").alias("competitor"), "store", X.positive("price").alias("competitor_price"), X.key("title").alias("tb"))
    # a store's rows of one title are equally similar to anything: the first stands for all, so that rows of common titles don't meet each other one by one
    early = F.coalesce(-F.col("competitor").cast("long"), F.lit(-(1 << 63)))  # one number, so that the aggregate stays hash-based
    o = staged(o.groupBy("tb", "store").agg(F.min("competitor").alias("competitor"), F.max_by("competitor_price", early).alias("competitor_price")))
    titles = similar_titles(m.select(F.col("ta").alias("t")), o.select(F.col("tb").alias("t")), threshold)
    found = F.max_by(F.struct("competitor", "competitor_price", "sim"), F.struct("sim", (-F.col("competitor")).alias("n"))).alias("x")
    likest = titles.join(o, "tb").groupBy("ta", "store").agg(found).select("ta", "store", "x.*")
    best = m.join(likest, "ta").groupBy("idx", "store").agg(found)
    return best.select("idx", "store", "x.*").where("competitor_price is not null")


