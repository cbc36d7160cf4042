"""Streams of triples and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.runtime import new_folder, table


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as they come."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder.rstrip('/')}/{name}.parquet*")


def once_each(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Redelivered rows are dropped as long as the first is remembered: ``late`` after its time."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, late: str, window: str, *by: str) -> DataFrame:
    """Rows per window and ``by``, complete when the window can get no more."""
    w = F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All there is now, through the stream, written and read again. Can be restarted at any batch."""
    folder = new_folder(stream.sparkSession)
    if mode == "complete":

        def put(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/out")

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def triples_per_month(spark: SparkSession, folder: str) -> DataFrame:
    """Triples loaded per 30 days (from start, in seconds of Unix time) and relation, of the whole stream."""
    rows = read_stream(spark, folder, "triples").filter("loaded_at is not null")
    w = F.window("loaded_at", "30 days")
    return drained(rows.groupBy(w.alias("w"), "relation").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("start"), "relation", "n"), "complete")


def once_per_month(spark: SparkSession, folder: str) -> DataFrame:
    """The same with each triple counted once, however often it was delivered."""
    rows = read_stream(spark, folder, "triples").filter("loaded_at is not null and triple_id is not null").select("triple_id", "relation", "loaded_at")
    w = F.window("loaded_at", "30 days")
    return drained(once_each(rows, "triple_id", "loaded_at", "30 days")).groupBy(w.alias("w"), "relation").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("start"), "relation", "n")


def closed_months(spark: SparkSession, folder: str) -> DataFrame:
    """Triples per 30 days and relation of windows that are complete: 30 days late rows may still come into the others."""
    rows = read_stream(spark, folder, "triples").filter("loaded_at is not null").select("relation", "loaded_at")
    made = windowed(rows, "loaded_at", "30 days", "30 days", "relation")
    return drained(made).select(F.unix_seconds("start").alias("start"), "relation", "n")


def queries() -> dict:
    return {"stream_windows": closed_months, "stream_triples": triples_per_month, "stream_triples_once": once_per_month}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_windows": """SELECT start, relation, n FROM (SELECT epoch_us(loaded_at) // 2592000000000 * 2592000 AS start, relation, count(*) AS n FROM triples WHERE loaded_at IS NOT NULL GROUP BY ALL)
WHERE (start + 2592000) * 1000 <= (SELECT max(epoch_us(loaded_at)) // 1000 FROM triples) - 2592000000""",
        "stream_triples": "SELECT epoch_us(loaded_at) // 2592000000000 * 2592000 AS start, relation, count(*) AS n FROM triples WHERE loaded_at IS NOT NULL GROUP BY ALL",
        "stream_triples_once": "SELECT epoch_us(loaded_at) // 2592000000000 * 2592000 AS start, relation, count(DISTINCT triple_id) AS n FROM triples WHERE loaded_at IS NOT NULL AND triple_id IS NOT NULL GROUP BY ALL",
    }
