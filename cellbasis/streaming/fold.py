"""The fold of returns into cells, and sorties, as Structured Streaming.

The fold's state is one row a cell, bounded by the grid, so it needs no watermark: late and reordered returns merge, as
minimum, maximum and count don't mind. Sorties are sessions and close once the watermark has passed the gap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellbasis.functions.grid import Grid
from cellbasis.operators.accumulate import cell_stats, outside_count
from cellbasis.operators.catalogue import GAP_HOURS
from cellbasis.plans.session import new_path
from cellbasis.sources.returns import checked, without_noise


def stream_fold(returns: DataFrame, grid: Grid) -> DataFrame:
    """Streaming cell statistics; write with output mode update or complete. The same plan as the batch fold."""
    return cell_stats(without_noise(returns), grid)


def outside_stream(returns: DataFrame, grid: Grid) -> DataFrame:
    """Streaming counts of the returns that the grid holds and of those that it doesn't: one row of state."""
    return outside_count(without_noise(returns), grid)


def drain(frame: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming frame over what there is into a Parquet table in the shared folder, and return that: the last micro-batch's
    result in complete mode, all that was ever emitted in append mode. State and progress are kept in the shared folder too."""
    spark = frame.sparkSession
    at = new_path(spark, name)
    schema = frame.schema

    def put(batch: DataFrame, number: int) -> None:
        # a batch that runs again overwrites what it wrote before
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}" if mode == "append" else f"{at}/rows")

    query = frame.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:  # nothing ever came: no batch ran
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*([f"{at}/rows/*"] if mode == "append" else [f"{at}/rows"]))


def guarded(boxes: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that refuses a micro-batch with returns outside their tile's box, and hands on the rest."""

    def each(batch: DataFrame, number: int) -> None:
        sink(checked(batch, boxes), number)

    return each


def stream_sorties(stamps: DataFrame, keys: list[str], stamp: str = "stamp", gap_hours: float = GAP_HOURS) -> DataFrame:
    """Sessions of stamps by `keys`: first and last stamp and number. A stamp exactly the gap after another is in its session.

    In append mode a session comes out once the watermark, which trails by the gap, has passed its end.
    """
    gap = f"{round(gap_hours * 3600)} seconds"
    marked = stamps.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, gap)
    out = marked.groupBy(*keys, F.session_window(stamp, gap).alias("w")).agg(F.min(stamp).alias("first_ts"), F.max(stamp).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return out.drop("w")
