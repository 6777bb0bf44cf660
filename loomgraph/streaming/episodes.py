"""Episodes as a stream: deduplicated ingest, and validity windows merged as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import FUTURE, PAST, IntervalMap
from ..session import delete
from ..sources.tables import SCHEMAS, new_rows


def read_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMAS["episodes"]).option("maxFilesPerTrigger", per_trigger).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each (source_type, source_ref) once within the watermark; state older than that is dropped. Rows without a reference all pass."""
    timed = stream.withColumn("_at", F.col("ingested_at").cast("timestamp")).withWatermark("_at", delay)
    keyed = timed.withColumn("_ref", F.coalesce("source_ref", "id"))
    return keyed.dropDuplicatesWithinWatermark(["source_type", "_ref"]).drop("_ref", "_at")


def ingest(stream: DataFrame, store: str, checkpoint: str):
    """Appends batches of rows whose key the store does not hold yet. A batch that is run again writes its own folder again, so each row lands once."""
    spark = stream.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        target = f"{store}/batch={number}"
        delete(spark, target)
        try:
            known = spark.read.schema(SCHEMAS["episodes"]).option("basePath", store).parquet(store)
        except Exception:
            known = spark.createDataFrame([], SCHEMAS["episodes"])
        keyed = batch.withColumn("source_ref", F.coalesce("source_ref", F.lit(None).cast("string")))
        new_rows(known.select("source_type", "source_ref"), keyed, ["source_type", "source_ref"]).write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_windows(stream: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n_periods, n_gaps, covered_from, covered_until) after each arrival; the state of a key is its map of disjoint intervals.

    stream: key columns (strings) and start_us, end_us (null: open).
    """
    shape = ", ".join(f"`{k}` string" for k in keys)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = IntervalMap()
        if state.exists:
            m.starts, m.ends = (list(x) for x in state.get)
        for pdf in batches:
            for s, e in zip(pdf["start_us"], pdf["end_us"]):
                m.add(PAST if pd.isna(s) else int(s), FUTURE if pd.isna(e) else int(e))
        state.update((m.starts, m.ends))
        yield pd.DataFrame([(*key, len(m.starts), max(0, len(m.starts) - 1), m.starts[0] if m.starts else None, m.ends[-1] if m.ends else None)], columns=[*keys, "n_periods", "n_gaps", "covered_from", "covered_until"])

    out = f"{shape}, n_periods int, n_gaps int, covered_from long, covered_until long"
    return stream.groupBy(*keys).applyInPandasWithState(fold, out, "starts array<long>, ends array<long>", "update", GroupStateTimeout.NoTimeout)
