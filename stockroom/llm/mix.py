"""Mixing sources to target weights by the cube method.

A source that must give r times its tokens gives floor(r) copies of each document and one more copy of a balanced sample. The
sample is drawn by the cube method: inclusion probabilities start at the fraction of r and move along the null space of the two
balancing totals (documents and tokens), three documents at a time, until each but two is 0 or 1. This flight runs in every
partition where the documents lie, for each source by itself; the at most two undecided documents that a partition leaves of each
source meet in a second flight, and of its last two the rounding nearest to the token total lands.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stockroom.llm.bpe import TOKENIZERS, count_column
from stockroom.session import staged

#: Documents of one lane, about.
LANE_ROWS = 200_000
#: Most sources that a mixture may name; their totals come to the driver.
MAX_SOURCES = 100_000
_EPS = 1e-9


def quotas(totals: dict[str, int], targets: dict[str, tuple[float, int]], budget: float) -> dict[str, float]:
    """Tokens that each source gives: its share of ``budget``, but ``max_repeats`` times its tokens at most.

    What a source can't give goes to the others in proportion to their shares, until the budget or all sources are used up.
    """
    able = {s: totals.get(s, 0) * max(0, int(r or 0)) for s, (_, r) in targets.items()}
    given = {s: 0.0 for s in targets}
    open_ = {s for s, (share, _) in targets.items() if share and share > 0 and able[s] > 0}
    rest = float(budget)
    while open_ and rest > _EPS:
        weight = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if rest * targets[s][0] / weight >= able[s]}
        if not full:
            for s in open_:
                given[s] = rest * targets[s][0] / weight
            break
        for s in full:
            given[s] = float(able[s])
            rest -= able[s]
        open_ -= full
    return given


def _coin(ident: int, seed: int) -> float:
    """A number in [0, 1) that depends on the document and the seed only."""
    x = (ident * 0x9E3779B97F4A7C15 + (seed + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def _fly(units: list[list], decided: list[list], seed: int) -> None:
    """Moves the probabilities of three units [number, tokens, probability] until at least one is 0 or 1."""
    (a, b, c) = units
    u = (c[1] - b[1], a[1] - c[1], b[1] - a[1])
    if not any(u):
        u = (1.0, -1.0, 0.0)
    up = down = float("inf")
    for x, d in zip(units, u):
        if d > 0:
            up, down = min(up, (1 - x[2]) / d), min(down, x[2] / d)
        elif d < 0:
            up, down = min(up, x[2] / -d), min(down, (1 - x[2]) / -d)
    step = up if _coin(a[0] ^ (b[0] << 1) ^ (c[0] << 2), seed) * (up + down) < down else -down
    kept = []
    for x, d in zip(units, u):
        x[2] += step * d
        if x[2] < _EPS or x[2] > 1 - _EPS:
            x[2] = float(round(x[2]))
            decided.append(x)
        else:
            kept.append(x)
    units[:] = kept


def _land(units: list[list]) -> None:
    """Rounds the last units so that their tokens come nearest to what was due; of equals fewest documents."""
    due = sum(x[1] * x[2] for x in units)
    best = min(product((0.0, 1.0), repeat=len(units)), key=lambda p: (abs(sum(x[1] * y for x, y in zip(units, p)) - due), sum(p), p))
    for x, y in zip(units, best):
        x[2] = y


def mixture(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Documents of the mixture: ``key``, ``source``, ``tokens`` and ``copies`` (1 or more, ``max_repeats`` at most).

    The budget is the tokens of all documents. Documents without tokens, without a source or of a source that ``targets``
    (source, target_share, max_repeats) doesn't name aren't taken; rows of the same key are documents of their own. An empty
    table or no target gives no rows.
    """
    sized = staged(count_column(documents, key, text, (source,), tokenizer, folder))
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum("tokens").alias("tokens"))
    wanted = targets.where("source is not null").select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1)
    rows = wanted.join(totals.where("source is not null"), "source", "left").collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    budget = sized.agg(F.sum("tokens")).first()[0] or 0
    held = {r.source: int(r.tokens or 0) for r in rows}
    given = quotas(held, {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in rows}, budget)
    rates = {s: g / held[s] for s, g in given.items() if held[s] and g > 0}
    kind = documents.schema[key].dataType.simpleString()

    def flight(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[str, list[list]] = {}
        keys: dict[int, object] = {}
        now, last, repeated = None, None, 0

        def rows_of(s: str, units: list[list], decided: bool) -> list[tuple]:
            whole = int(rates[s] + _EPS)
            return [(keys.pop(x[0]), s, x[1], whole, x[2], decided, x[0] >> 20) for x in units]

        for pdf in batches:
            out: list[tuple] = []
            for lane, ident, h, s, tokens in zip(pdf["lane"].tolist(), pdf["key"].tolist(), pdf["h"].tolist(), pdf["source"].tolist(), pdf["tokens"].tolist()):
                if lane != now:
                    out += [r for s_, units in waiting.items() for r in rows_of(s_, units, False)]
                    waiting, now = {}, lane
                repeated = repeated + 1 if h == last else 0
                last = h
                rate = rates.get(s)
                if rate is None:
                    continue
                fraction = rate - int(rate + _EPS)
                n = h << 20 | repeated
                keys[n] = ident
                if fraction < _EPS:
                    out += rows_of(s, [[n, tokens, 0.0]], True)
                    continue
                units = waiting.setdefault(s, [])
                units.append([n, tokens, fraction])
                if len(units) == 3:
                    decided: list[list] = []
                    _fly(units, decided, seed)
                    out += rows_of(s, decided, True)
            yield pd.DataFrame(out, columns=_COLUMNS)
        yield pd.DataFrame([r for s, units in waiting.items() for r in rows_of(s, units, False)], columns=_COLUMNS)

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "tokens"], kind="stable", ignore_index=True)
        units: list[list] = []
        done: list[list] = []
        for i, (t, p) in enumerate(zip(pdf["tokens"].tolist(), pdf["probability"].tolist())):
            units.append([i, t, p])
            if len(units) == 3:
                _fly(units, done, seed + 1)
        _land(units)
        chosen = {x[0]: x[2] for x in [*done, *units]}
        return pdf.assign(probability=[chosen[i] for i in range(len(pdf))], decided=True)

    schema = f"key {kind}, source string, tokens long, whole int, probability double, decided boolean, h long"
    # documents fly in lanes told by their key, in an order told by it, so that the choice doesn't depend on how the table is laid out
    lanes = -(-sized.count() // LANE_ROWS) or 1
    usable = sized.where(F.col("tokens") > 0).select(F.col(key).alias("key"), F.col(source).alias("source"), "tokens", F.xxhash64(key, source).alias("h")).withColumn("lane", F.pmod("h", F.lit(lanes)))
    flown = staged(usable.repartition("lane").sortWithinPartitions("lane", "source", "h", "key", "tokens").mapInPandas(flight, schema))
    landed = flown.where("not decided").groupBy("source").applyInPandas(second, schema)
    taken = flown.where("decided").unionByName(landed).withColumn("copies", F.col("whole") + F.round("probability").cast("int"))
    return taken.where("copies > 0").select(F.col("key").alias(key), "source", "tokens", "copies")


_COLUMNS = ["key", "source", "tokens", "whole", "probability", "decided", "h"]


def shares(taken: DataFrame, targets: DataFrame) -> DataFrame:
    """What a mixture reached: per named source its target, documents, copies, tokens and share of the mixture's tokens (0 where it gives none)."""
    own = taken.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    total = own.agg(F.sum("tokens").alias("total"))
    found = targets.where("source is not null").join(own, "source", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select("source", "target_share", "max_repeats", zero("documents"), zero("copies"), zero("tokens"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("share"))
