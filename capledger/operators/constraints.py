"""Constraints of records and of structured documents, as rules that are data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import crosscheck as X

RECORD_TYPES = ("subscription_flow", "equity_snapshot")
REQUIRED = {"subscription_flow": ("source_page", "subscription_date", "subscriber_name", "evidence_text"), "equity_snapshot": ("source_page", "snapshot_date", "snapshot_type", "shareholder_name", "evidence_text")}
NUMERIC = {"subscription_flow": ("shares_subscribed", "amount_subscribed", "price_per_share"), "equity_snapshot": ("total_shares", "total_capital", "shares_held", "capital_contribution")}
DATE = r"^\d{4}-\d{2}(-\d{2})?$"


@dataclass(frozen=True)
class Rule:
    """A check of one column: kind is required, length, pattern, not_prefix, member or least."""

    column: str
    kind: str
    value: object = None

    def broken(self) -> Column:
        """True where the rule is broken.  Only required and length look at null."""
        c = F.col(self.column)
        if self.kind == "required":
            return c.isNull()
        if self.kind == "length":
            return F.coalesce(F.length(c) < self.value, F.lit(False))
        if self.kind == "pattern":
            return F.coalesce(~c.rlike(self.value), F.lit(False))
        if self.kind == "not_prefix":
            return F.coalesce(F.trim(c).rlike("^(?:" + "|".join(self.value) + ")"), F.lit(False))
        if self.kind == "member":
            return F.coalesce(~c.isin(*self.value), F.lit(False))
        if self.kind == "least":
            number = c.try_cast("double")
            return c.isNotNull() & (number.isNull() | (number < self.value))
        raise ValueError(self.kind)

    def name(self) -> str:
        return f"{self.column}:{self.kind}"


def _text(column: str, length: int = 1) -> list[Rule]:
    return [Rule(column, "required"), Rule(column, "length", length)]


_BOTH = [Rule("record_type", "member", RECORD_TYPES), *_text("company_name"), Rule("stock_code", "required"), Rule("stock_code", "pattern", r"^\d{6}$"), *_text("source_page"), *_text("evidence_text", 20), Rule("evidence_text", "not_prefix", P.SUMMARY_PREFIXES)]
MODEL = {
    "subscription_flow": [
        *_BOTH, *_text("subscription_date", 7), Rule("subscription_date", "pattern", DATE), *_text("subscriber_name"), *[Rule(c, "least", 0) for c in (*NUMERIC["subscription_flow"], "post_event_total_shares", "post_event_total_capital")],
        Rule("event_context", "member", P.EVENT_CONTEXTS), Rule("payment_method", "member", P.PAYMENT_METHODS),
    ],
    "equity_snapshot": [
        *_BOTH, *_text("snapshot_date", 7), Rule("snapshot_date", "pattern", DATE), *_text("snapshot_type"), *_text("shareholder_name"), *[Rule(c, "least", 0) for c in (*NUMERIC["equity_snapshot"], "snapshot_order")],
        Rule("shareholder_type_detail", "member", P.HOLDER_TYPES), Rule("is_original_founder", "member", ("yes", "no", "unknown")),
    ],
}


def required(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and field for each of the columns that is null or empty."""
    blank = [F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(c)) for c in columns]
    return df.select(*keys, F.explode(F.array_compact(F.array(*blank))).alias("field"))


def numeric(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, field and value for each of the columns that is not null and is no number."""
    bad = [F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))) for c in columns]
    return df.select(*keys, F.explode(F.array_compact(F.array(*bad))).alias("x")).select(*keys, "x.*")


def errors(rules: list[Rule]) -> Column:
    """Names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name())) for r in rules]))


def _blank(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")


def schema_log(records: DataFrame) -> DataFrame:
    """company, record_type, check_type, status, detail, critical for each check of each line.

    records: company, line, and every field as text.  A line of unknown type gives one FAIL and is left out of
    the rest.  A row for each company tells its earliest snapshot, in file order.
    """
    known = F.col("record_type").isin(*RECORD_TYPES)
    line = F.concat(F.lit("line="), F.col("line"))
    row = lambda check, status, detail, critical: F.struct(F.lit(check).alias("check_type"), F.lit(status).alias("status"), detail.alias("detail"), F.lit(critical).alias("critical"))
    checks = [F.when(~F.coalesce(known, F.lit(False)), row("record_type", "FAIL", line, True))]
    for kind in RECORD_TYPES:
        is_kind = F.col("record_type") == kind
        checks += [F.when(is_kind & _blank(c), row(f"required_{c}", "FAIL", line, True)) for c in REQUIRED[kind]]
        checks += [F.when(is_kind & F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), row(f"numeric_{c}", "FAIL", line, False)) for c in NUMERIC[kind]]
        n = F.size(errors(MODEL[kind]))
        checks += [F.when(is_kind & (n == 0), row("schema", "PASS", line, False)), F.when(is_kind & (n > 0), row("schema", "FAIL", F.concat(line, F.lit(", errors="), n.cast("string")), False))]
    told = records.select("company", F.coalesce(F.nullif("record_type", F.lit("")), F.lit("unknown")).alias("record_type"), F.explode(F.array_compact(F.array(*checks))).alias("x")).select("company", "record_type", "x.*")
    valid = (F.col("record_type") == "equity_snapshot") & (F.size(errors(MODEL["equity_snapshot"])) == 0)
    first = records.groupBy("company").agg(F.min_by("snapshot_date", F.when(valid, F.col("line"))).alias("d"), F.count_if(valid).alias("n"))
    t0 = first.select("company", F.lit("equity_snapshot").alias("record_type"), F.lit("t0_check").alias("check_type"), F.when(F.col("n") > 0, "PASS").otherwise("WARN").alias("status"), F.when(F.col("n") > 0, F.concat(F.lit(P.ISSUE["first_snapshot"]), F.col("d"))).otherwise(P.ISSUE["no_snapshot"]).alias("detail"), F.lit(False).alias("critical"))
    return told.unionByName(t0)


def typed(records: DataFrame, kind: str, ddl: str) -> DataFrame:
    """Records of one kind that keep all its constraints, with their types; ord is the line."""
    fields = [f.split() for f in ddl.split(", ")]
    ok = records.where((F.col("record_type") == kind) & (F.size(errors(MODEL[kind])) == 0))
    return ok.select("company", F.col("line").alias("ord"), *[F.col(n).try_cast(t).alias(n) for n, t in fields])


def record_issues(log: DataFrame, cross: DataFrame, constancy: DataFrame | None = None) -> DataFrame:
    """company, issue, critical from both logs.  A broken schema is critical by its check, not by words in a message."""
    bad = log.where("status = 'FAIL'").select("company", F.col("check_type").alias("issue"), F.col("critical") | (F.col("check_type") == "schema"))
    out = bad.toDF("company", "issue", "critical").unionByName(cross.where(F.col("status") == X.REVIEW).select("company", F.col("detail").alias("issue"), F.lit(False).alias("critical")))
    return out if constancy is None else out.unionByName(constancy.select("company", "issue", F.lit(False).alias("critical")))


# ---------------------------------------------------------------- structured documents


def presence(json: Column) -> Column:
    """Keys and raw values of a JSON object; a key with null has the text null, a missing key is not there."""
    return F.from_json(json, "map<string,string>")


def structured(docs: DataFrame) -> DataFrame:
    """company, raw, doc (map), shape and events (array of raw JSON objects) of JSON documents (company, raw).

    shape: structured_nested, structured_flat, basic, or invalid.  Events at the top count first, then those inside
    company.
    """
    parsed = docs.withColumn("doc", presence(F.col("raw"))).withColumn("inner", presence(F.col("doc")["company"]))
    array = lambda c: F.from_json(c, "array<string>")
    top, nested = array(F.col("doc")["financing_events"]), array(F.col("inner")["financing_events"])
    first = presence(F.get(top, F.lit(0)))
    shape = F.when(F.col("doc").isNull(), "invalid").when(F.coalesce(F.map_contains_key("inner", F.lit("financing_events")), F.lit(False)), "structured_nested").when(F.coalesce(F.map_contains_key(first, F.lit("event_order")), F.lit(False)), "structured_flat").otherwise("basic")
    return parsed.select("company", "raw", "doc", "inner", shape.alias("shape"), F.when(F.size(top) > 0, top).otherwise(F.coalesce(nested, top, F.array().cast("array<string>"))).alias("events"), (~(F.coalesce(F.size(top), F.lit(0)) > 0) & (F.size(nested) > 0)).alias("old_form"))


def _missing(m: Column, keys: tuple[str, ...], null_counts: bool) -> Column:
    """Keys that the map lacks; with null_counts, or whose value is null."""
    absent = lambda k: ~F.map_contains_key(m, F.lit(k)) | (m[k].isNull() if null_counts else F.lit(False))
    return F.array_compact(F.array(*[F.when(F.coalesce(absent(k), F.lit(True)), F.lit(k)) for k in keys]))


def _issues_of(events: DataFrame, checks: list[tuple[Column, Column, bool]]) -> DataFrame:
    items = [F.when(cond, F.struct(text.alias("issue"), F.lit(critical).alias("critical"))) for cond, text, critical in checks]
    return events.select("company", F.explode(F.array_compact(F.array(*items))).alias("x")).select("company", "x.*")


def verify_keys(docs: DataFrame) -> DataFrame:
    """company, status (PASS, FAIL, JSON_INVALID), events, issues: presence of keys and no summary at the head of evidence."""
    s = structured(docs)
    events = s.select("company", F.posexplode("events").alias("i", "e")).withColumn("m", presence(F.col("e"))).withColumn("no", (F.col("i") + 1).cast("string"))
    lacks = _missing(F.col("m"), P.EVENT_KEYS, False)
    head = F.left(F.coalesce(F.col("m")["evidence_text"], F.lit("")), F.lit(30)).rlike("|".join(P.SUMMARY_PREFIXES[:3]))
    first = _issues_of(events, [(F.size(lacks) > 0, F.concat(F.lit(P.ISSUE["event"]), F.col("no"), F.lit(P.ISSUE["lacks"]), F.array_join(lacks, ",")), True), (head, F.concat(F.lit(P.ISSUE["event"]), F.col("no"), F.lit(P.ISSUE["summary"])), True)])
    parties = events.select("company", "no", F.posexplode(F.from_json(F.col("m")["investors"], "array<string>")).alias("j", "p")).withColumn("pm", presence(F.col("p")))
    lacks_p = _missing(F.col("pm"), P.INVESTOR_KEYS, False)
    second = _issues_of(parties, [(F.size(lacks_p) > 0, F.concat(F.lit(P.ISSUE["event"]), F.col("no"), F.lit(P.ISSUE["party"]), (F.col("j") + 1).cast("string"), F.lit(P.ISSUE["lacks"]), F.array_join(lacks_p, ",")), True)])
    told = first.unionByName(second).groupBy("company").agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    out = s.join(told, "company", "left")
    return out.select("company", F.when(F.col("shape") == "invalid", "JSON_INVALID").when(F.size("issues") > 0, "FAIL").otherwise("PASS").alias("status"), F.size("events").cast("long").alias("events"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


def validate(docs: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """company, overall (PASS, WARN, FAIL), issues and details of structured documents; expected companies without one FAIL.

    Missing keys, bad dates and long spans are critical; lacking investor keys are not.
    """
    s = structured(docs)
    top = _missing(F.col("doc"), ("company", "financing_events"), False)
    company = _issues_of(s, [(F.col("doc").isNull(), F.lit(P.ISSUE["bad_json"]), True), (F.col("doc").isNotNull() & (F.size(top) > 0), F.concat(F.lit(P.ISSUE["lacks_top"]), F.array_join(top, ",")), True), (F.col("old_form"), F.lit(P.ISSUE["old_form"]), False)])
    events = s.select("company", F.posexplode("events").alias("i", "e")).withColumn("m", presence(F.col("e")))
    tag = F.concat(F.lit("event["), F.col("i").cast("string"), F.lit("]"))
    kind, date, evidence = (F.coalesce(F.col("m")[k], F.lit("")) for k in ("event_type", "event_date", "evidence_text"))
    year, month = F.left(date, F.lit(4)).try_cast("int"), F.substring(date, 6, 2).try_cast("int")
    dated = F.length(date) >= 7
    lacks = _missing(F.col("m"), P.CRITICAL_KEYS, True)
    phrase = F.regexp_extract(F.left(evidence, F.lit(50)), "|".join(P.SUMMARY_PHRASES), 0)
    checks = [
        (F.size(lacks) > 0, F.concat(tag, F.lit(P.ISSUE["lacks_critical"]), F.array_join(lacks, ",")), True), ((kind != "") & ~kind.isin(*P.EVENT_CONTEXTS), F.concat(tag, F.lit(P.ISSUE["odd_type"]), kind), False),
        (dated & (year.isNull() | month.isNull()), F.concat(tag, F.lit(P.ISSUE["bad_date"]), date), True), (dated & ~(year.between(1990, 2030) & month.between(1, 12)), F.concat(tag, F.lit(P.ISSUE["odd_date"]), date), True),
        (phrase != "", F.concat(tag, F.lit(P.ISSUE["phrase"]), phrase), False), ((evidence != "") & (F.length(evidence) < 30), F.concat(tag, F.lit(P.ISSUE["short"])), False),
    ]
    per_event = _issues_of(events, [(F.coalesce(c, F.lit(False)), t, k) for c, t, k in checks])
    parties = events.select("company", "i", F.posexplode(F.from_json(F.col("m")["investors"], "array<string>")).alias("j", "p")).withColumn("pm", presence(F.col("p")))
    who = F.concat(F.lit("event["), F.col("i").cast("string"), F.lit("]" + P.ISSUE["party"] + "["), F.col("j").cast("string"), F.lit("]"))
    lacks_p, flag = _missing(F.col("pm"), P.INVESTOR_KEYS, False), F.coalesce(F.col("pm")["is_pevc"], F.lit(""))
    per_party = _issues_of(parties, [(F.size(lacks_p) > 0, F.concat(who, F.lit(P.ISSUE["lacks"]), F.array_join(lacks_p, ",")), False), ((flag != "") & ~flag.isin("yes", "no", "uncertain"), F.concat(who, F.lit(P.ISSUE["bad_flag"]), flag), False)])
    span = events.where(date != "").groupBy("company").agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.bool_or(kind.isin("设立", "VIE搭建")).alias("has_setup_event"), F.bool_or(kind == "整体变更").alias("has_change_event"))
    years = F.left("last_date", F.lit(4)).try_cast("int") - F.left("first_date", F.lit(4)).try_cast("int")
    wide = _issues_of(span, [(F.coalesce(years > 40, F.lit(False)), F.concat(F.lit(P.ISSUE["span"]), F.col("first_date"), F.lit(" → "), F.col("last_date")), True)])
    told = company.unionByName(per_event).unionByName(per_party).unionByName(wide).groupBy("company").agg(F.array_sort(F.collect_list("issue")).alias("issues"), F.bool_or("critical").alias("critical"))
    details = F.struct(F.size("events").cast("long").alias("event_count"), F.coalesce("has_setup_event", F.lit(False)).alias("has_setup_event"), F.coalesce("has_change_event", F.lit(False)).alias("has_change_event"), "first_date", "last_date")
    out = s.join(told, "company", "left").join(span, "company", "left").select("company", F.when(F.col("critical"), "FAIL").when(F.size("issues") > 0, "WARN").otherwise("PASS").alias("overall"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"), details.alias("details"))
    if expected is None:
        return out
    gone = expected.select("company").join(s.select("company"), "company", "left_anti")
    return out.unionByName(gone.select("company", F.lit("FAIL").alias("overall"), F.array(F.lit(P.ISSUE["no_file"])).alias("issues"), F.lit(None).cast(out.schema["details"].dataType).alias("details")))
