"""Keep an index up to date from a stream of documents. An extension, not part of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.generations import Generations
from ..operators.index import dedup


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id string, source string, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def index_stream(docs: DataFrame, out: str, checkpoint: str, compact_every: int = 0):
    """Each micro-batch is a generation of the index at out: documents of known ids are replaced, a batch that is run
    again replaces itself. With compact_every, so many batches are merged into one."""

    def write(batch: DataFrame, number: int) -> None:
        g = Generations.open(batch.sparkSession, out)
        g.append(dedup(batch), number)
        if compact_every and len(g.committed()) > compact_every:
            g.compact()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
