"""The three pipelines, as lazy plans: documents, market batch, records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import constraints as K
from ..operators import crosscheck as X
from ..operators import extract as E
from ..operators import records as R
from ..operators import segment as G
from ..operators import select as S
from .. import schemas
from ..sources import readers


def documents(files: DataFrame, prefix: str = "", toc_lines: int = 300) -> dict[str, DataFrame]:
    """Document pipeline over (file_name, text): contents and candidate sections of each company."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    keyed = files.withColumn("company", T.company_key(stem, prefix)).where("company is not null")
    contents = G.contents(G.lines(keyed, ["company", "file_name"], most=toc_lines), ["company"])
    texts = readers.company_texts(files, lambda s: T.company_key(s, prefix))
    marked = G.lines(texts).withColumn("title", T.found(F.col("line"), P.HEADING))
    return {"contents": contents, "candidates": G.locate(G.sections(marked))}


def batch_sections(texts: DataFrame) -> DataFrame:
    """Sections of (company, text), with fallbacks, numbered within their company."""
    return G.locate_all(texts).withColumn("section_no", F.row_number().over(W.partitionBy("company").orderBy("line_idx", "title")).cast("long"))


def batch_events(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and timeline of numbered sections."""
    keys = ["company", "section_no"]
    return E.assemble(sections, E.events_batch(sections, keys, "content"), E.timeline_batch(sections, keys, "content"))


def batch_statistics(texts: DataFrame, sections: DataFrame, timeline: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of each company."""
    statistics = G.tiered_lines(texts).groupBy("company").agg(F.count("title").alias("total_chapters"))
    for d, n in ((sections, "financing_chapters_found"), (timeline, "timeline_entries"), (events, "financing_events")):
        statistics = statistics.join(d.groupBy("company").agg(F.count(F.lit(1)).alias(n)), "company", "left")
    return statistics.na.fill(0)


def market_batch(files: DataFrame) -> dict[str, DataFrame]:
    """Market batch over (file_name, text): sections with fallbacks, events, timeline and statistics of each company."""
    texts = readers.company_texts(files, T.company_key_coded)
    sections = batch_sections(texts)
    events, timeline = batch_events(sections)
    return {"sections": sections, "events": events, "timeline": timeline, "statistics": batch_statistics(texts, sections, timeline, events)}


def build_records(manual: DataFrame, docs: DataFrame) -> DataFrame:
    """Flows and snapshots of each company: from its hand-made events, or else from its text; neither gives no row."""
    auto = R.auto_flows(docs)
    events = E.context_events(docs)
    flows = S.precedence(R.flows(manual), auto, ["stock_code"])
    snapshots = S.precedence(R.snapshots(manual), R.auto_snapshots(docs, events), ["stock_code"])
    return R.flow_log(flows, snapshots)


def record_logs(records: DataFrame, mode: str = "first_any") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Schema log, cross-check log, and issues of constancy of records (company, line, and every field as text)."""
    flows, snapshots = (K.typed(records, kind, ddl) for kind, ddl in (("subscription_flow", schemas.FLOW), ("equity_snapshot", schemas.SNAPSHOT)))
    return K.schema_log(records), X.cross_check(flows, snapshots, mode), X.check_constancy(X.snapshot_groups(snapshots))


def validate_records(records: DataFrame, mode: str = "first_any") -> dict[str, DataFrame]:
    """Both logs and the verdicts of records."""
    log, cross, constancy = record_logs(records, mode)
    return {"schema_log": log, "cross_log": cross, "verdicts": X.file_verdict(K.record_issues(log, cross, constancy), records.select("company").distinct())}
