"""Cross-checks of only those companies whose records have changed, by a stream with state for each company."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import constraints as K
from ..operators import crosscheck as X
from ..plans import pipelines
from ..session import share_package, shared_folder, stored
from ..sources import readers

CHANGED = "company string, version long, part long, text string"
#: The logs of a batch; beside them are verdicts, and companies, which says in which batch each was checked.
LOGS = ("schema_log", "cross_log")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Bytes of a company's text that a task holds in memory; what is beyond goes to a temporary file of its own.
HELD = 8_000_000
#: Rows that go to a Python worker and come from it together, as a row may be a large part of a file.
AT_ONCE = 100


class Changed(StatefulProcessor):
    """Of a company's files the newest (by time, then path), if its text is not that of the company's last version.

    The state is a digest and a number, so it grows with the companies and not with their records.  A file that comes in
    parts goes on in parts, in order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        with tempfile.SpooledTemporaryFile(HELD) as held:
            newest, parts = None, {}
            for pdf in rows:
                for modified, path, part, text in zip(pdf["modified"], pdf["path"], pdf["part"], pdf["text"], strict=True):
                    if newest is None or (modified, path) > newest:
                        newest, parts = (modified, path), {}
                        held.seek(0)
                        held.truncate()
                    if (modified, path) == newest and part not in parts:
                        parts[part] = (held.tell(), held.write((text or "").encode()))

            def texts() -> Iterator[tuple[int, bytes]]:
                for part, (at, size) in sorted(parts.items()):
                    held.seek(at)
                    yield part, held.read(size)

            digest = hashlib.sha256()
            for i, (_, text) in enumerate(texts()):
                digest.update(b"\n" * (i > 0) + text)
            known = self.last.get() if self.last.exists() else ("", 0)
            if known[0] != digest.hexdigest():
                self.last.update((digest.hexdigest(), known[1] + 1))
                each = texts()
                while some := list(islice(each, AT_ONCE)):
                    yield pd.DataFrame({"company": key[0], "version": known[1] + 1, "part": [part for part, _ in some], "text": [text.decode() for _, text in some]})

    def close(self) -> None:
        pass


def company_files(spark: SparkSession, source: str) -> DataFrame:
    """A stream of company (the file's stem), path, modified and text of whole files; a file of no bytes gives no row."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(source)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("company"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def changed_companies(files: DataFrame) -> DataFrame:
    """company, version (from 1), part and text of companies whose newest file says something new; files without a company go."""
    if "part" not in files.columns:
        files = files.withColumn("part", F.lit(0).cast("long"))
    return files.where("company is not null").groupBy("company").transformWithStateInPandas(Changed(), CHANGED, "Update", "None")


def revalidate(spark: SparkSession, files: DataFrame, sink: str, checkpoint: str, mode: str = "first_any", partitions: int | None = None) -> int:
    """Check what has changed since the last call, and return how many companies that were.

    files is a stream as of company_files; a file is the whole of a company's records.  A large one comes in rows of whole
    lines each, which column part (long) puts in order, so that no row or task holds it whole; parts of some KB are best, as
    Spark reads rows by thousands.  Each batch's results go to
    folders of its number, so one that runs again after a failure replaces itself; latest() reads them.
    The stream alone has the state store that keeps typed state, no batches without data (there are no timers), and so
    many partitions of the state as its first call says (else the session's shuffle partitions).
    """
    share_package(spark)
    checked = 0

    def write(batch: DataFrame, number: int) -> None:
        nonlocal checked
        # The texts are kept once, and their records parsed once, for all checks; these run under the caller's settings and
        # not the stream's few partitions.
        path = shared_folder(spark, "changed")
        batch.write.parquet(path)
        texts = spark.read.schema(CHANGED).parquet(path)
        folder = lambda name: f"{sink}/{name}/batch={number}"
        *logs, constancy = pipelines.record_logs(stored(readers.records(readers.numbered(texts))), mode)
        for name, df in zip(LOGS, logs, strict=True):
            df.write.mode("overwrite").parquet(folder(name))
        # Verdicts come from the logs as written; a company without a record has no row there, but it passes.
        companies = texts.select("company", "version").distinct()
        written = [spark.read.schema(df.schema).parquet(folder(name)) for name, df in zip(LOGS, logs, strict=True)]
        X.file_verdict(K.record_issues(*written, constancy), companies.select("company")).write.mode("overwrite").parquet(folder("verdicts"))
        # Written last: a batch counts once its companies are there.
        companies.coalesce(1).write.mode("overwrite").parquet(folder("companies"))
        checked += companies.count()

    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(AT_ONCE)}
    if partitions is not None:
        own["spark.sql.shuffle.partitions"] = str(partitions)
    before = {key: spark.conf.get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        query = changed_companies(files).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    query.awaitTermination()
    return checked


def latest(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """Rows of a result table (or of companies) from the last batch that checked their company."""
    companies = spark.read.parquet(f"{sink}/companies")
    if name == "companies":
        return companies.withColumn("_n", F.row_number().over(W.partitionBy("company").orderBy(F.desc("batch")))).where("_n = 1").drop("_n")
    last = companies.groupBy("company").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{sink}/{name}").join(last, ["company", "batch"], "left_semi")

