"""Cross-checks of flows and snapshots.  Every check returns rows of one log (LOG); REVIEW is 待复核."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import select as S

REVIEW, PASS = "待复核", "PASS"
LOG = ("company", "snapshot_date_from", "snapshot_date_to", "shareholder_name", "previous_shares", "previous_capital", "subscription_change", "expected_shares", "pdf_disclosed_shares", "difference", "status", "detail")
_NUMBERS = LOG[4:10]


def nonzero(c: Column) -> Column:
    """Neither null nor 0."""
    return c.isNotNull() & (c != 0)


def status(bad: Column) -> Column:
    return F.when(bad, REVIEW).otherwise(PASS)


def detailed(text: str, *numbers: Column, bad: Column | None = None) -> Column:
    """A detail: text with each {} replaced by a number of one decimal, and a mark where the row is bad."""
    parts = text.split("{}")
    shown = [F.call_function("format_number", n.cast("double"), F.lit("0.0")) for n in numbers]
    out = F.concat(*[x for pair in zip(map(F.lit, parts), [*shown, F.lit("")], strict=True) for x in pair])
    return out if bad is None else F.concat(out, mark(bad))


def mark(bad: Column) -> Column:
    return F.when(bad, P.CHECK["review"]).otherwise("")


def _row(df: DataFrame, **columns: Column) -> DataFrame:
    """A log row from those columns that are given; the others are null."""
    return df.select(*[(columns.get(c, F.lit(None))).cast("double" if c in _NUMBERS else "string").alias(c) for c in LOG])


def price_quantity(price: Column, quantity: Column, amount: Column, most: float = 1.0, most_share: float = 0.01) -> tuple[Column, Column, Column]:
    """Expected amount, its difference, and the status; null where one of the three is null or 0, or the amount not above 0."""
    able = nonzero(price) & nonzero(quantity) & nonzero(amount) & (amount > 0)
    expected = F.when(able, price * quantity)
    difference = expected - amount
    return expected, difference, F.when(able, status((F.abs(difference) > most) | (F.abs(difference) / amount > most_share)))


def check_price(flows: DataFrame) -> DataFrame:
    """Price times shares against the amount of each flow."""
    expected, difference, st = price_quantity(F.col("price_per_share"), F.col("shares_subscribed"), F.col("amount_subscribed"))
    return _row(
        flows.withColumn("_e", expected).withColumn("_d", difference).withColumn("_s", st).where("_s is not null"),
        company=F.col("company"), snapshot_date_from=F.lit(""), snapshot_date_to=F.col("subscription_date"), shareholder_name=F.col("subscriber_name"), subscription_change=F.col("shares_subscribed"), expected_shares=F.col("_e"),
        pdf_disclosed_shares=F.col("amount_subscribed"), difference=F.col("_d"), status=F.col("_s"), detail=detailed(P.CHECK["price"], F.abs(F.col("_d")) / F.col("amount_subscribed") * 100),
    )


def snapshot_groups(snapshots: DataFrame) -> DataFrame:
    """A row for each snapshot of a company: step in time order, first total and capital, sum of holdings, counts.

    A snapshot is a (date, type); snapshots are ordered by month key, then by their first row (column ord).
    """
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord")))
    groups = snapshots.groupBy("company", "snapshot_date", "snapshot_type").agg(
        F.min("ord").alias("ord"), first("total_shares").alias("total_shares"), first("total_capital").alias("total_capital"), F.sum("shares_held").alias("held"), F.count(F.lit(1)).alias("holders"),
        F.count_distinct("total_shares").alias("share_totals"), F.count_distinct("total_capital").alias("capital_totals"),
    )
    key = F.coalesce(F.when(F.col("snapshot_date").rlike(r"^\d{4}-\d{2}"), F.left("snapshot_date", F.lit(7))), F.col("snapshot_date"))
    return S.consecutive(groups.withColumn("ym", key), ["company"], ["ym", "ord"])


def check_totals(groups: DataFrame, most: float = 0.01) -> DataFrame:
    """Sum of holdings against the total of each snapshot."""
    able = (F.col("held") > 0) & (F.col("total_shares") > 0)
    difference = F.col("held") - F.col("total_shares")
    return _row(
        groups.where(able), company=F.col("company"), snapshot_date_from=F.lit(""), snapshot_date_to=F.col("snapshot_date"), shareholder_name=F.concat(F.lit("[合计 "), F.col("holders"), F.lit("股东]")), expected_shares=F.col("held"),
        pdf_disclosed_shares=F.col("total_shares"), difference=difference, status=status(F.abs(difference) > most), detail=detailed(P.CHECK["totals"], F.col("held"), F.col("total_shares"), bad=F.abs(difference) > most),
    )


def check_constancy(groups: DataFrame) -> DataFrame:
    """Snapshots that give more than one total or capital: company, snapshot_date, snapshot_type, issue."""
    issues = F.array_compact(F.array(F.when(F.col("share_totals") > 1, F.lit(P.CHECK["share_totals"])), F.when(F.col("capital_totals") > 1, F.lit(P.CHECK["capital_totals"]))))
    return groups.select("company", "snapshot_date", "snapshot_type", F.explode(issues).alias("issue"))


def change_status(previous: Column, current: Column, was: Column, is_: Column) -> Column:
    """退出, 新增, 稀释, 保持, 增持, or empty where a holding is not disclosed; a holding of 0 compares as 0."""
    return (
        F.when(was & ~is_, "退出").when(is_ & ~was, "新增").when(previous.isNull() | current.isNull(), "").when(current < previous, "稀释").when(current == previous, "保持").otherwise("增持")
    )


def diff_snapshots(holdings: DataFrame, scope: list[str], holder: str, value: str, others: list[str] = ()) -> DataFrame:
    """Each holder of two consecutive snapshots (column step): previous and current value, was, is, step of the later.

    A full outer join of the snapshots with themselves one step on.  The first snapshot has no earlier one and
    the last no later one, so those sides are left out.
    """
    last = holdings.groupBy(*scope).agg(F.max("step").alias("_last"))
    keep = [*scope, holder, "step"]
    before = holdings.join(last, scope).where(F.col("step") < F.col("_last")).select(*scope, holder, (F.col("step") + 1).alias("step"), F.col(value).alias("previous"), *[F.col(c).alias(f"previous_{c}") for c in others], F.lit(True).alias("was"))
    after = holdings.where("step > 1").select(*keep, F.col(value).alias("current"), F.lit(True).alias("is"))
    return before.join(after, keep, "full_outer").withColumns({"was": F.coalesce("was", F.lit(False)), "is": F.coalesce("is", F.lit(False))})


def check_adjacent(flows: DataFrame, snapshots: DataFrame, groups: DataFrame, mode: str = "first_any", most: float = 0.001) -> DataFrame:
    """Each holder of adjacent snapshots: expected holding (previous + subscription) against the disclosed one.

    mode first_any: the subscription is the holder's first flow with shares, of any date; period: the sum of the
    holder's flows after the earlier snapshot's month and up to the later one's.
    """
    # Of rows of one holder in a snapshot the last counts.
    held = snapshots.groupBy("company", "snapshot_date", "snapshot_type", "shareholder_name").agg(F.max_by(F.struct("shares_held", "capital_contribution"), "ord").alias("h")).select("company", "snapshot_date", "snapshot_type", "shareholder_name", "h.*")
    steps = groups.select("company", "snapshot_date", "snapshot_type", "step")
    pairs = diff_snapshots(held.join(steps, ["company", "snapshot_date", "snapshot_type"]), ["company"], "shareholder_name", "shares_held", ["capital_contribution"])
    months = groups.select("company", "step", "snapshot_date", "ym")
    pairs = pairs.join(months.select("company", "step", F.col("snapshot_date").alias("date_to"), F.col("ym").alias("ym_to")), ["company", "step"]).join(months.select("company", (F.col("step") + 1).alias("step"), F.col("snapshot_date").alias("date_from"), F.col("ym").alias("ym_from")), ["company", "step"])
    moved = flows.where(nonzero(F.col("shares_subscribed"))).withColumn("shareholder_name", F.col("subscriber_name"))
    if mode == "first_any":
        pairs = S.first_match(pairs, moved, ["company", "shareholder_name"], "shares_subscribed", ["ord"], "change")
    else:
        holder = ["company", "shareholder_name"]
        by_month = S.month_sum(moved, holder, F.col("subscription_date"), "shares_subscribed", "month_shares")
        upto = W.partitionBy(*holder).orderBy("ym")
        running = by_month.select(*holder, "ym", F.struct(F.sum("month_shares").over(upto).alias("sum"), F.count(F.lit(1)).over(upto).alias("n")).alias("upto"))
        # A period's sum is the difference of the running sums at its ends.
        for end in ("from", "to"):
            pairs = S.as_of(pairs.withColumnRenamed(f"ym_{end}", "ym"), running, holder, "ym", "upto", f"upto_{end}").withColumnRenamed("ym", f"ym_{end}")
        before = lambda c, zero: F.coalesce(F.col("upto_from")[c], F.lit(zero))
        pairs = pairs.withColumn("change", F.when(F.col("upto_to")["n"] > before("n", 0), F.col("upto_to")["sum"] - before("sum", 0.0)))
    expected = F.col("previous") + F.col("change")
    difference = F.col("current") - expected
    bad = F.coalesce(F.abs(difference) > most, F.lit(False))
    told = change_status(F.col("previous"), F.col("current"), F.col("was"), F.col("is"))
    return _row(
        pairs, company=F.col("company"), snapshot_date_from=F.col("date_from"), snapshot_date_to=F.col("date_to"), shareholder_name=F.col("shareholder_name"), previous_shares=F.col("previous"), previous_capital=F.col("previous_capital_contribution"),
        subscription_change=F.col("change"), expected_shares=expected, pdf_disclosed_shares=F.col("current"), difference=difference, status=status(bad), detail=F.concat(told, mark(bad)),
    )


def check_deltas(flows: DataFrame, groups: DataFrame, most: float = 0.01) -> DataFrame:
    """Change of total shares, and of total capital, between adjacent snapshots against the flows of the latest month up to the later."""
    months = S.month_sum(flows, ["company"], F.col("subscription_date"), "shares_subscribed", "subscribed")
    over = W.partitionBy("company").orderBy("step")
    steps = groups.select("company", "step", "ym", F.col("snapshot_date").alias("date_to"), F.lag("snapshot_date").over(over).alias("date_from"), "total_shares", "total_capital", F.lag("total_shares").over(over).alias("shares_before"), F.lag("total_capital").over(over).alias("capital_before"))
    steps = S.as_of(steps.where("step > 1"), months, ["company"], "ym", "subscribed", "subscribed")
    logs = []
    # Of the two only the row of shares is marked in its detail.
    for before, after, name, detail, marked in (("shares_before", "total_shares", P.CHECK["shares_row"], P.CHECK["shares"], True), ("capital_before", "total_capital", P.CHECK["capital_row"], P.CHECK["capital"], False)):
        change = F.col(after) - F.col(before)
        difference = F.col("subscribed") - change
        bad = F.abs(difference) > most
        able = steps.where((F.col(after) != F.col(before)) & (F.col("subscribed") > 0))
        logs.append(_row(
            able, company=F.col("company"), snapshot_date_from=F.col("date_from"), snapshot_date_to=F.col("date_to"), shareholder_name=F.lit(name), previous_shares=F.col(before), subscription_change=F.col("subscribed"),
            expected_shares=F.col(before) + F.col("subscribed"), pdf_disclosed_shares=F.col(after), difference=difference, status=status(bad), detail=detailed(detail, F.col("subscribed"), change, bad=bad if marked else None),
        ))
    return logs[0].unionByName(logs[1])


def check_correspondence(flows: DataFrame, snapshots: DataFrame, groups: DataFrame, most: float = 0.01) -> DataFrame:
    """Shares of a flow against the holder's holding in the first snapshot (as first seen) not before the flow's month."""
    firsts = groups.select("company", "snapshot_date", "snapshot_type", F.col("ord").alias("group_ord"))
    held = snapshots.join(firsts, ["company", "snapshot_date", "snapshot_type"]).select("company", F.col("shareholder_name").alias("subscriber_name"), F.col("snapshot_date").alias("at"), "group_ord", "ord", F.struct("shares_held").alias("held"))
    asked = flows.withColumn("month", F.left("subscription_date", F.lit(7)))
    met = S.first_later(asked, held, ["company", "subscriber_name"], "month", "at", ["group_ord", "ord"], "held", "met").withColumn("shares_held", F.col("met")["shares_held"])
    difference = F.col("shares_held") - F.col("shares_subscribed")
    able = met.where(nonzero(F.col("shares_held")) & nonzero(F.col("shares_subscribed")))
    return _row(
        able, company=F.col("company"), snapshot_date_from=F.lit(""), snapshot_date_to=F.col("subscription_date"), shareholder_name=F.concat("subscriber_name", F.lit(P.CHECK["held_row"])), subscription_change=F.col("shares_subscribed"),
        expected_shares=F.col("shares_subscribed"), pdf_disclosed_shares=F.col("shares_held"), difference=difference, status=status(F.abs(difference) > most), detail=detailed(P.CHECK["held"], bad=F.abs(difference) > most),
    )


def cross_check(flows: DataFrame, snapshots: DataFrame, mode: str = "first_any") -> DataFrame:
    """The whole log: flows and snapshots have company and ord (their order in the file) beside their record's columns."""
    groups = snapshot_groups(snapshots)
    parts = [check_price(flows), check_totals(groups), check_adjacent(flows, snapshots, groups, mode), check_deltas(flows, groups), check_correspondence(flows, snapshots, groups)]
    return reduce(DataFrame.unionByName, parts)


def verdict(critical: Column, issues: Column) -> Column:
    """FAIL with a critical issue, WARN with any, else PASS."""
    return F.when(critical, "FAIL").when(issues > 0, "WARN").otherwise("PASS")


def file_verdict(issues: DataFrame, files: DataFrame, key: str = "company") -> DataFrame:
    """FAIL for files with a critical issue (column critical), WARN for those with any, else PASS."""
    told = issues.groupBy(key).agg(F.bool_or("critical").alias("_critical"), F.count(F.lit(1)).alias("issues"))
    return files.join(told, key, "left").select(*files.columns, F.coalesce("issues", F.lit(0)).cast("long").alias("issues"), verdict(F.col("_critical"), F.col("issues")).alias("verdict"))


def differences(log: DataFrame, most: int = 5) -> DataFrame:
    """The first rows of a log, by company and size of the difference, whose difference is not 0."""
    return log.where(nonzero(F.col("difference"))).orderBy("company", F.abs("difference").desc(), "shareholder_name", "snapshot_date_to").limit(most)
