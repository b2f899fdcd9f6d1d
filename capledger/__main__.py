"""python -m capledger COMMAND INPUT OUTPUT: one command for each pipeline.

A command is a graph of steps, each a table in OUTPUT.  A step runs again only when its input files, what it needs, or its
options have changed; --dry-run tells what would run, --steps chooses some (with what they need), --force
runs them anyway.  The run table is OUTPUT/runs, the report of this run goes to the screen.
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import constraints as K
from .operators import profile as N
from .plans import pipelines
from .plans.steps import Runner, Step
from .run_log import RunLog, run_report
from .session import session
from .sources import readers, sinks


def graph(spark: SparkSession, command: str, source: str, glob: str | None = None, mode: str = "first_any") -> list[Step]:
    """The steps of a command."""
    read = lambda: readers.texts(spark, source, glob)
    with_options = {"inputs": (source,), "version": f"1 {glob} {mode}"}
    if command == "documents":
        return [
            Step("contents", lambda _: pipelines.documents(read())["contents"], **with_options),
            Step("candidates", lambda _: pipelines.documents(read())["candidates"], counts={"characters": F.sum("length")}, **with_options),
            Step("report", lambda made: sinks.candidates_report(made["candidates"]), ("candidates",)),
        ]
    if command == "batch":
        texts = lambda: readers.company_texts(read(), T.company_key_coded)
        return [
            Step("sections", lambda _: pipelines.batch_sections(texts()), counts={"fallbacks": F.count_if(F.col("method") != "title")}, **with_options),
            Step("events", lambda made: pipelines.batch_events(made["sections"])[0], ("sections",)),
            Step("timeline", lambda made: pipelines.batch_events(made["sections"])[1], ("sections",)),
            Step("statistics", lambda made: pipelines.batch_statistics(texts(), made["sections"], made["timeline"], made["events"]), ("sections", "timeline", "events"), **with_options),
            Step("report", lambda made: sinks.company_report(made["events"].withColumnRenamed("section_no", "section")), ("events",)),
        ]
    if command == "validate":
        checked = lambda name: lambda _: pipelines.validate_records(readers.records(readers.jsonl(spark, source)), mode)[name]
        schema_log = ("company", "record_type", "check_type", "status", "detail")
        return [
            Step("schema_log", checked("schema_log"), save=lambda df, path: sinks.csv(df, path, schema_log), **with_options),
            Step("cross_log", checked("cross_log"), save=sinks.cross_log, **with_options),
            Step("verdicts", checked("verdicts"), save=sinks.csv, **with_options),
        ]
    documents = lambda: readers.json_documents(spark, source)
    if command == "verify":
        return [Step("verify", lambda _: K.validate(documents()), **with_options)]
    return [
        Step("profile", lambda _: N.profile(documents()), **with_options),
        Step("index", lambda made: N.summary_index(documents(), made["profile"]), ("profile",), **with_options),
        Step("report", lambda made: sinks.anomaly_report(made["profile"]), ("profile",)),
    ]


def failures(spark: SparkSession, command: str, output: str) -> DataFrame | None:
    """Rows of the output that say that a record or document does not pass."""
    if command == "validate":
        return spark.read.option("header", True).csv(f"{output}/verdicts").where("verdict = 'FAIL'")
    return spark.read.parquet(f"{output}/verify").where("overall = 'FAIL'") if command == "verify" else None


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="capledger", description=__doc__)
    parser.add_argument("command", choices=("documents", "batch", "validate", "verify", "profile"))
    parser.add_argument("input", help="folder of texts (documents, batch), JSON lines (validate) or JSON documents (verify, profile)")
    parser.add_argument("output", help="folder to write to")
    parser.add_argument("--glob", help="names of the files to read")
    parser.add_argument("--mode", default="first_any", choices=("first_any", "period"), help="which subscription counts between two snapshots")
    parser.add_argument("--steps", default="", help="names of steps, joined by commas")
    parser.add_argument("--dry-run", action="store_true", help="tell which steps would run, and why; write nothing")
    parser.add_argument("--force", action="store_true", help="run steps although nothing has changed")
    parser.add_argument("--master", default="local[*]")
    a = parser.parse_args(args)
    spark = session(a.master)
    try:
        runner = Runner(spark, graph(spark, a.command, a.input, a.glob, a.mode), a.output, [s for s in a.steps.split(",") if s], a.force)
    except ValueError as e:
        parser.error(str(e))
    if a.dry_run:
        print("\n".join(runner.dry_run()))
        return 0
    log = RunLog(spark, f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S.%f}")
    well = runner.run(log)
    log.save(f"{a.output.rstrip('/')}/runs")
    print(run_report(log.table()).first()["text"])
    bad = failures(spark, a.command, a.output) if well and not a.steps else None
    return int(not well or (bad is not None and not bad.isEmpty()))


if __name__ == "__main__":
    raise SystemExit(main())
