"""Watching prices with Structured Streaming: change rows per product, windowed aggregates, snapshot-wise diffs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stockroom.operators import monitor

CHANGES = "domain string, title_key string, at timestamp, change string, old_price double, new_price double"


def _track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one product in order of time: new at first sight, price_change whenever the price differs from the last one."""
    rows = pd.concat(list(batches)).sort_values(["at", "idx"], kind="stable")
    last = state.get[0] if state.exists else None
    out = []
    for at, price in zip(rows["at"], rows["price"]):
        if last is None:
            out.append((*key, at, "new", None, price))
        elif price != last:
            out.append((*key, at, "price_change", last, price))
        last = price
    state.update((last,))
    yield pd.DataFrame(out, columns=["domain", "title_key", "at", "change", "old_price", "new_price"])


def price_changes(stream: DataFrame) -> DataFrame:
    """Change rows of a stream (domain, title_key, idx, at, price): the state per product is its last price. Rows that arrive in a later batch count as later."""
    return stream.groupBy("domain", "title_key").applyInPandasWithState(_track, CHANGES, "last double", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, length: str, slide: str | None = None, late: str = "1 day", by: str = "domain") -> DataFrame:
    """Count, mean, min and max price per window (tumbling, or sliding with ``slide``) and ``by``; rows later than ``late`` are dropped when run as a stream."""
    rows = stream.withWatermark("at", late)
    return rows.groupBy(F.window("at", length, slide) if slide else F.window("at", length), by).agg(F.count("*").alias("n"), F.avg("price").alias("mean"), F.min("price").alias("low"), F.max("price").alias("high")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "mean", "low", "high")


def sessions(stream: DataFrame, gap: str, late: str = "1 day", by: str = "domain") -> DataFrame:
    """Runs of activity per ``by`` that no gap longer than ``gap`` interrupts."""
    return stream.withWatermark("at", late).groupBy(F.session_window("at", gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def watch(snapshots: DataFrame, store: str, on_changes: Callable[[DataFrame, int], None], checkpoint: str, rules: list | None = None, once: bool = True):
    """Each micro-batch of exploded snapshot rows is appended to ``store`` and the two newest snapshots of its domains are compared.

    Rows are kept by domain and instant (``rows``), beside an index of the instants of each domain (``times``), so that a batch reads the index and the files of two snapshots per
    domain, not the store. ``on_changes`` gets the changes (or the alerts that ``rules`` give) and the batch number. A batch that is run again writes its own
    files again, so nothing is stored twice.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8]  # streams with states of their own may share a store
    kept_schema = T.StructType([*snapshots.schema.fields, T.StructField("at_domain", T.StringType()), T.StructField("at_time", T.StringType()), T.StructField("batch", T.StringType())])

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumns({"at_domain": F.col("domain"), "at_time": F.col("taken_at").cast("string"), "batch": F.lit(f"{stream}-{number}")}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("at_domain", "at_time", "batch").parquet(f"{store}/rows")
        batch.select("domain", "taken_at").distinct().withColumn("batch", F.lit(f"{stream}-{number}")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/times")
        touched = spark.read.parquet(f"{store}/times").join(batch.select("domain").distinct(), "domain", "left_semi").select("domain", "taken_at").distinct()
        newest = monitor.latest(touched).select(F.col("domain").alias("at_domain"), F.col("taken_at").cast("string").alias("at_time"))
        kept = spark.read.schema(kept_schema).parquet(f"{store}/rows")
        # both are partition columns: only those snapshots' files are read
        known = kept.join(newest, ["at_domain", "at_time"], "left_semi").select(*batch.columns)
        found = monitor.changes(known)
        on_changes(monitor.alerts(found, rules) if rules else found, number)

    writer = snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
