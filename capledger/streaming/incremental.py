"""Only what is new: files that were not processed before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unprocessed(files: DataFrame, done: DataFrame, key: str = "file_name") -> DataFrame:
    """Files whose key is not among those done."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def process_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, fmt: str = "parquet", key: list[str] | None = None) -> int:
    """Run transform over the files of source that earlier calls have not seen, append to sink, and return the new rows.

    A file stream with availableNow: the checkpoint remembers the files.  A batch is written under its number, so one
    that runs again after a failure replaces itself.  With key, rows whose key the sink has are left out.
    """
    rows = 0

    def write(batch: DataFrame, number: int) -> None:
        nonlocal rows
        out = transform(batch)
        if key:
            out = out.dropDuplicates(key)
            path = spark._jvm.org.apache.hadoop.fs.Path(sink)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                # Batches of other numbers only: one that runs again must not find itself.
                out = out.join(spark.read.parquet(sink).where(F.col("batch") != number).select(*key).distinct(), key, "left_anti")
        target = f"{sink.rstrip('/')}/batch={number}"
        out.write.mode("overwrite").parquet(target)
        rows += spark.read.parquet(target).count()

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows
