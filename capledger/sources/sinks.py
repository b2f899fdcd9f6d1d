"""Writers and report texts.  Reports are tables with one text a row, made by ordered aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import crosscheck as X


def csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None) -> None:
    """A CSV with a header, in these columns; a quote in a value is doubled."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def cross_log(df: DataFrame, path: str) -> None:
    csv(df.select(*X.LOG), path)


def padded_company_list(df: DataFrame) -> DataFrame:
    """df with all columns of the company list, blank where it has none."""
    names = [f.split()[0] for f in schemas.COMPANY_LIST.split(", ")]
    return df.select(*[(F.col(n).cast("string") if n in df.columns else F.lit("")).alias(n) for n in names])


def jsonl(log: DataFrame, path: str) -> None:
    """JSON lines in a folder for each stock code, in the order of ord, nulls kept."""
    log.repartition("stock_code").sortWithinPartitions("stock_code", "ord").drop("ord", "event_no", "investor_no").write.mode("overwrite").option("ignoreNullFields", False).partitionBy("stock_code").json(path)


def json_text(df: DataFrame, key: str, pretty: bool = True) -> DataFrame:
    """key and json: each row as a JSON text."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key]), {"pretty": "true" if pretty else "false", "ignoreNullFields": "false"}).alias("json"))


def merged_json(df: DataFrame, key: str, scope: list[str] = ()) -> DataFrame:
    """One JSON map from key to row for each scope."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.struct(*[c for c in df.columns if c not in (key, *scope)]).alias("v"))))
    return df.groupBy(*scope).agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def report(df: DataFrame, keys: list[str], order: list[str], line: Column, title: Column | None = None) -> DataFrame:
    """keys and text: a line for each row, in order, under a title."""
    parts = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    body = F.array_join(F.transform(parts, lambda x: x["_line"]), "\n")
    out = df.groupBy(*keys).agg(body.alias("text"))
    return out if title is None else out.withColumn("text", F.concat(F.lit("# "), title, F.lit("\n\n"), F.col("text")))


def candidates_report(candidates: DataFrame) -> DataFrame:
    return report(candidates, ["company"], ["line_idx"], F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("content"), F.lit("\n")), F.col("company"))


def contents_report(entries: DataFrame) -> DataFrame:
    return report(entries, ["company"], ["entry_no"], F.concat(F.lit("- "), F.col("entry")), F.col("company"))


def company_report(events: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- "), F.coalesce("date", F.lit("?")), F.lit(" "), F.col("event_type"), F.coalesce(F.concat(F.lit(" "), F.col("amount")), F.lit("")), F.lit(": "), F.left("description", F.lit(120)))
    return report(events, ["company"], ["event_no"], line, F.col("company"))


def anomaly_report(anomalies: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low")]), F.col("severity"))
    line = F.concat(F.lit("- ["), F.col("severity"), F.lit("] "), F.col("path"), F.lit(" "), F.col("type"), F.lit(": "), F.col("detail"))
    return report(anomalies.withColumn("rank", rank), ["company"], ["rank", "path", "type"], line, F.col("company"))


def field_dictionary(dictionary: tuple) -> str:
    """Markdown table of a profiler dictionary."""
    rows = [f"| {n} | {t} | {'yes' if r else 'no'} | {', '.join(e)} |" for n, t, r, e in dictionary]
    return "\n".join(["| field | type | required | values |", "|---|---|---|---|", *rows])


def workbook(flows: DataFrame, snapshots: DataFrame, cross: DataFrame, company: str) -> dict[str, DataFrame]:
    """Three sheets of a company: evidence is cut to 500 characters, and an order is shown as tN."""
    cut = F.left("evidence_text", F.lit(500))
    mine = F.col("company") == company
    return {
        "flows": flows.where(mine).withColumn("evidence_text", cut),
        "snapshots": snapshots.where(mine).withColumn("evidence_text", cut).withColumn("snapshot_order", F.concat(F.lit("t"), F.col("snapshot_order").cast("string"))),
        "cross_check": cross.where(mine),
    }


def manifest(companies: DataFrame, downloads: DataFrame, exclusions: tuple[str, ...]) -> DataFrame:
    """One JSON text with the companies, the downloads and the words that exclude a title."""
    # Both sides are one row.
    some = companies.agg(F.lit(1).alias("_k"), F.array_sort(F.collect_list(F.struct(*companies.columns))).alias("companies"))
    got = downloads.agg(F.lit(1).alias("_k"), F.array_sort(F.collect_list(F.struct(*downloads.columns))).alias("downloads"))
    return some.join(got, "_k").select(F.to_json(F.struct("companies", "downloads", F.array(*[F.lit(x) for x in exclusions]).alias("exclusions"))).alias("json"))
