"""The rules path as a stream: documents are independent, so extraction and resolution against static key tables need no state.

Late and repeated deliveries are dropped by a watermark on the delivery time; every batch is written once through
foreachBatch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeresolve.operators import extract, resolve


def document_stream(spark: SparkSession, folder: str, schema, glob: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(folder)


def fresh(stream: DataFrame, key: list[str], time: str, delay: str = "30 days") -> DataFrame:
    """First delivery of each key; state older than the watermark is dropped."""
    timed = stream.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def mentions(docs: DataFrame, id_col: str = "documento_id", text_col: str = "text") -> DataFrame:
    """Mentions (cit, trecho, tipo, contexto) of a batch or stream of documents."""
    s = extract.extract(docs, id_col, text_col)
    cit = F.concat_ws(":", F.col(id_col), F.col("inicio").cast("string"), F.col("fim").cast("string"))
    return s.select(cit.alias("cit"), id_col, "inicio", "fim", "trecho", "tipo", F.lit(None).cast("string").alias("contexto"))


def run(stream: DataFrame, rulings: DataFrame, sumulas: DataFrame, dispositivos: DataFrame, sink, checkpoint: str):
    """Resolve each micro-batch and hand it to sink(batch, epoch); ends when the files present have been read."""

    def step(batch: DataFrame, epoch: int) -> None:
        sink(resolve.resolve(mentions(batch), rulings, sumulas, dispositivos), epoch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
