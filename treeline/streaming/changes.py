"""Structured Streaming over listings. An extension: the file-tree tools this engine stands in for have no streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeline.operators.snapshot_changes import null_safe_hash

STATE = "hash bigint, seen bigint"


def windowed_counts(stream: DataFrame, time: str, key: str, *, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each key in each window of event time; rows later than ``late`` are left out."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), F.col(key))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
    )


def changed_items(stream: DataFrame, key: str, version: str, fields: list[str]) -> DataFrame:
    """``key``, ``version``, ``change`` (added or changed) as listings of items arrive.

    One hash and the newest version of each key are kept; a listing older than that, or equal,
    changes nothing, so late and repeated listings are harmless.
    """
    rows = stream.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(version).cast("long").alias("version"), null_safe_hash(*fields).alias("hash"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept, seen = state.get if state.exists else (None, None)
        out = []
        for v, h in pd.concat(list(parts)).sort_values("version")[["version", "hash"]].itertuples(index=False):
            if seen is not None and v <= seen:
                continue
            if kept is None or h != kept:
                out.append((k[0], int(v), "added" if kept is None else "changed"))
            kept, seen = int(h), int(v)
        if kept is not None:
            state.update((kept, seen))
        yield pd.DataFrame(out, columns=["key", "version", "change"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, version bigint, change string", STATE, "append", "NoTimeout")


def sync_stream(stream: DataFrame, plan: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Give every micro-batch of new listings to a function, such as one that plans and applies a synchronization."""
    return stream.writeStream.foreachBatch(lambda df, _: plan(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(result: DataFrame) -> DataFrame:
    """Run an aggregating stream once over what its source holds, and read the final result.

    The result is written to the session's shared folder in complete mode, a batch to a folder.
    """
    import uuid

    from treeline.plans.lineage import shared_dir

    spark = result.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    keep: dict[str, int] = {}

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out-{batch}")
        keep["last"] = batch

    query = result.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out-{keep['last']}") if keep else spark.createDataFrame([], result.schema)
