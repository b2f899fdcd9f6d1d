"""Flow and snapshot records from nested events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from . import extract as E
from . import segment as G
from . import select as S
from . import tables as B

#: Name of a subscriber where a text names none; a fixed value.
PLACEHOLDER = "待人工确认"


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def fill_single(amount: Column, total: Column, parties: Column) -> Column:
    """A party's amount; where it is null and the party is the only one, the event's total unless that is 0."""
    return F.when(amount.isNull() & (parties == 1) & (total != 0), total).otherwise(amount)


def flows(events: DataFrame) -> DataFrame:
    """One flow for each investor of each event.

    events: company_name, stock_code, event_no (order), and the event's fields with investors as an array of
    structs.  Events without investors give none.  Quantities that are not disclosed stay null.
    """
    each = events.select("*", F.size("investors").alias("_n"), F.posexplode("investors").alias("investor_no", "_i"))
    name = F.coalesce("_i.investor_original_name", "_i.investor_short_name", F.lit("未知"))
    evidence = F.coalesce("evidence_text", F.lit(""))
    return each.select(
        F.lit("subscription_flow").alias("record_type"), "company_name", "stock_code", F.coalesce("source_page", F.lit("待补充")).alias("source_page"), F.coalesce("event_date", F.lit("")).alias("subscription_date"), name.alias("subscriber_name"),
        F.col("_i.shares_acquired").alias("shares_subscribed"), fill_single(F.col("_i.investment_amount"), F.col("total_investment_amount"), F.col("_n")).alias("amount_subscribed"), F.col("share_price").alias("price_per_share"), F.col("event_type").alias("event_context"),
        F.lit(None).cast("double").alias("post_event_total_shares"), T.number(T.found(evidence, P.POST_CAPITAL)).alias("post_event_total_capital"), F.lit(None).cast("string").alias("payment_method"), F.col("_i.shareholding_ratio_after_event").alias("subscription_ratio"),
        F.left(evidence, F.lit(800)).alias("evidence_text"), F.coalesce("notes", F.lit("")).alias("notes"), F.col("event_no").cast("long").alias("event_no"), F.col("investor_no").cast("long").alias("investor_no"),
    )


def snapshots(events: DataFrame, first_order: int = 0) -> DataFrame:
    """One row for each investor with a ratio, of events of which any has one.

    Of events of one company, date and label the first stays.  snapshot_order counts a company's snapshots from
    first_order in the order of the events.
    """
    has = F.filter("investors", lambda i: ~_blank(i["shareholding_ratio_after_event"]))
    kept = events.withColumn("_held", has).where(F.size("_held") > 0)
    kept = kept.withColumn("snapshot_type", T.snapshot_label(F.coalesce("event_type", F.lit("")), F.col("inferred_round"))).withColumn("snapshot_date", F.coalesce("event_date", F.lit("")))
    kept = S.keep_first(kept, ["stock_code", "company_name", "snapshot_date", "snapshot_type"], ["event_no"])
    kept = kept.withColumn("snapshot_order", (F.row_number().over(W.partitionBy("stock_code", "company_name").orderBy("event_no")) - 1 + first_order).cast("int"))
    each = kept.select("*", F.posexplode("_held").alias("investor_no", "_i"))
    evidence = F.coalesce("evidence_text", F.lit(""))
    valued = F.col("post_money_valuation").isNotNull() & (F.col("post_money_valuation") != 0)
    return each.select(
        F.lit("equity_snapshot").alias("record_type"), "company_name", "stock_code", F.coalesce("source_page", F.lit("待补充")).alias("source_page"), "snapshot_date", "snapshot_type", F.lit(None).cast("double").alias("total_shares"),
        F.when(valued, T.number(T.found(evidence, P.POST_CAPITAL_VALUED))).alias("total_capital"), F.coalesce("_i.investor_original_name", "_i.investor_short_name", F.lit("未知")).alias("shareholder_name"), F.col("_i.shares_acquired").alias("shares_held"),
        F.col("_i.investment_amount").alias("capital_contribution"), F.col("_i.shareholding_ratio_after_event").alias("shareholding_ratio"), "snapshot_order", T.holder_type(F.coalesce("_i.investor_original_name", F.lit("")), F.col("_i.investor_type")).alias("shareholder_type_detail"),
        T.founder(F.col("snapshot_order")).alias("is_original_founder"), F.left(evidence, F.lit(800)).alias("evidence_text"), F.coalesce("notes", F.lit("")).alias("notes"), F.col("event_no").cast("long").alias("event_no"), F.col("investor_no").cast("long").alias("investor_no"),
    )


def auto_flows(docs: DataFrame, most: int = 5, least_length: int = 4, most_text: int | None = None) -> DataFrame:
    """Flows from running text: docs have company_name, stock_code, company and text.

    Events come from the snippets of a document (without one from its text, or the first most_text characters of it); the j-th name of an
    event's evidence is paired with its j-th amount; an event without a name gives one row with a placeholder.
    """
    pieces = G.snippets(docs, most=5)
    texts = pieces.groupBy("company").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "snippet"))), lambda x: x["snippet"]), "\n").alias("_all"))
    whole = docs.join(texts, "company", "left").withColumn("_text", F.coalesce(F.nullif("_all", F.lit("")), "text" if most_text is None else F.left("text", F.lit(most_text))))
    events = E.context_events(whole, ["company_name", "stock_code", "company"], "_text")
    paired = events.select("*", T.participants(F.col("evidence_text"), P.PARTY_AUTO, most, least_length).alias("_names"), T.amounts(F.col("evidence_text")).alias("_amounts"), T.unit_price(F.col("evidence_text")).alias("price_per_share"))
    each = paired.select("*", F.posexplode_outer("_names").alias("_j", "_name")).withColumn("_j", F.coalesce("_j", F.lit(0)))
    return each.select(
        F.lit("subscription_flow").alias("record_type"), "company_name", "stock_code", F.concat(F.lit("auto_extract:"), F.col("company")).alias("source_page"), F.col("event_date").alias("subscription_date"), F.coalesce("_name", F.lit(PLACEHOLDER)).alias("subscriber_name"),
        F.lit(None).cast("double").alias("shares_subscribed"), F.get("_amounts", F.col("_j")).alias("amount_subscribed"), "price_per_share", F.col("event_type").alias("event_context"), "evidence_text",
        F.concat(F.lit("自动提取 ("), F.col("event_type"), F.when(F.col("_name").isNull(), F.lit(") - 投资人名待确认")).otherwise(F.lit(")"))).alias("notes"), "event_no", F.col("_j").cast("long").alias("investor_no"),
    )


def auto_snapshots(docs: DataFrame, events: DataFrame, default_date: str = "2020-01") -> DataFrame:
    """Snapshots from holder tables, dated by the last event of the company (events: company, event_no, event_date)."""
    last = events.groupBy("company").agg(F.max_by("event_date", "event_no").alias("_date"))
    held = B.holders(docs, ["company_name", "stock_code", "company"], "text").join(last, "company", "left")
    return held.select(
        F.lit("equity_snapshot").alias("record_type"), "company_name", "stock_code", F.concat(F.lit("auto_extract:"), F.col("company")).alias("source_page"), F.coalesce("_date", F.lit(default_date)).alias("snapshot_date"), F.lit("自动提取").alias("snapshot_type"),
        "total_shares", F.lit(None).cast("double").alias("total_capital"), "shareholder_name", "shares_held", "capital_contribution", "shareholding_ratio", F.lit(0).alias("snapshot_order"), F.col("row_no").alias("investor_no"),
    )


def flow_log(flow_rows: DataFrame, snapshot_rows: DataFrame) -> DataFrame:
    """Flows, then snapshots, in one table: ord is the place in a company's file."""
    both = flow_rows.withColumn("_part", F.lit(0)).unionByName(snapshot_rows.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("ord", F.row_number().over(W.partitionBy("stock_code").orderBy("_part", "event_no", "investor_no")).cast("long")).drop("_part")
