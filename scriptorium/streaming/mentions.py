"""Mentions over a growing folder of documents: the batch operators on a stream, results merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mentions import token_mentions


def document_stream(spark: SparkSession, folder: str, schema, *, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def mention_stream(docs: DataFrame, canon: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch's counts by document and label, in a folder named by the batch: a batch that runs again writes the same folder.

    A document arrives whole, in one batch, so counts are final and no state is kept.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        token_mentions(batch, canon).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_totals(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").groupBy("grp", "label").agg(F.sum("cnt").alias("mentions"), F.count_distinct("doc_id").alias("docs"))
