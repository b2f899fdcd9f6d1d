"""The log of a run: steps, how they ended, and counts that are observed while their results are written."""

from __future__ import annotations

import time
import traceback
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUNS = "run_id string, step_no int, step string, status string, started timestamp, seconds double, counters map<string, long>, detail string, error string"


class Step:
    """What a step adds to its row of the log."""

    def __init__(self) -> None:
        self.counters: dict[str, int] = {}
        self.detail: str | None = None

    def write(self, df: DataFrame, path: str, mode: str = "overwrite", **counts: Column) -> DataFrame:
        """Write df as Parquet and read it back; rows, and each of counts (an aggregate), are taken by the same pass."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()]).write.mode(mode).parquet(path)
        for name, n in seen.get.items():
            self.counters[name] = self.counters.get(name, 0) + int(n or 0)
        return df.sparkSession.read.schema(df.schema).parquet(path)


class RunLog:
    """Rows for the run table, one for each step; save() appends them."""

    def __init__(self, spark: SparkSession, run_id: str):
        self.spark, self.run_id, self.rows = spark, run_id, []

    @contextmanager
    def step(self, name: str, stop: bool = True) -> Iterator[Step]:
        """A step; one that fails is a row with its traceback, and the run ends with it unless stop is false."""
        own, began, now = Step(), time.monotonic(), datetime.now(timezone.utc)
        status, error = "DONE", None
        try:
            yield own
        except Exception:
            status, error = "FAILED", traceback.format_exc()
            if stop:
                raise
        finally:
            self.rows.append((self.run_id, len(self.rows) + 1, name, status, now, time.monotonic() - began, own.counters, own.detail, error))

    def skip(self, name: str, status: str, detail: str | None = None) -> None:
        """A step that was not run: SKIPPED, BLOCKED."""
        self.rows.append((self.run_id, len(self.rows) + 1, name, status, datetime.now(timezone.utc), 0.0, {}, detail, None))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, RUNS)

    def save(self, path: str) -> None:
        self.table().coalesce(1).write.mode("append").parquet(path)


def run_counters(runs: DataFrame) -> DataFrame:
    """run_id, counter and total over a run's steps."""
    return runs.select("run_id", F.explode("counters").alias("counter", "n")).groupBy("run_id", "counter").agg(F.sum("n").alias("total"))


def run_report(runs: DataFrame, times: bool = True) -> DataFrame:
    """run_id and text: a Markdown report of each run, made of its rows of the run table; times=False leaves times out."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("counters")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    cells = [F.col("step_no").cast("string"), F.col("step"), F.col("status"), *([F.format_number("seconds", 2)] if times else []), shown, F.coalesce("detail", F.lit(""))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = ["step no", "step", "status", *(["seconds"] if times else []), "counts", "detail"]
    table = lambda names: F.lit(f"| {' | '.join(names)} |\n|{'---|' * len(names)}\n")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"]), "\n")
    steps = runs.groupBy("run_id").agg(joined(F.struct("step_no", line.alias("line"))).alias("steps"), F.min("started").alias("began"), F.max(F.col("started") + F.make_dt_interval(secs=F.col("seconds"))).alias("ended"), F.count_if(F.col("status") == "FAILED").alias("errors"))
    totals = run_counters(runs).groupBy("run_id").agg(joined(F.struct("counter", F.concat(F.lit("| "), "counter", F.lit(" | "), F.col("total").cast("string"), F.lit(" |")).alias("line"))).alias("totals"))
    when = [F.lit("\nBegan: "), F.col("began").cast("string"), F.lit("\nEnded: "), F.col("ended").cast("string")] if times else []
    parts = [F.lit("# Run "), F.col("run_id"), *when, F.lit("\nErrors: "), F.col("errors").cast("string"), F.lit("\n\n## Counts\n\n"), table(["count", "total"]), F.coalesce("totals", F.lit("")), F.lit("\n\n## Steps\n\n"), table(head), F.col("steps")]
    return steps.join(totals, "run_id", "left").select("run_id", F.concat(*parts).alias("text"))
