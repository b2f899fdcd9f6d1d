"""Profiles of structured documents: anomalies with path and severity, completeness and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import stored
from . import constraints as K

SEVERITIES = ("critical", "high", "medium", "low")
_ROW = "path string, field string, type string, detail string, severity string"


def _row(path: Column, field: str, kind: str, detail: Column | str, severity: str) -> Column:
    return F.struct(path.alias("path"), F.lit(field).alias("field"), F.lit(kind).alias("type"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"), F.lit(severity).alias("severity"))


def raw_type(raw: Column) -> Column:
    """JSON type of a raw value: null, string, integer, number, boolean, array or object."""
    t = F.trim(raw)
    return F.when(t.isNull() | (t == "null"), "null").when(t.startswith('"'), "string").when(t.startswith("["), "array").when(t.startswith("{"), "object").when(t.isin("true", "false"), "boolean").when(t.rlike(r"^-?\d+$"), "integer").when(t.rlike(r"^-?[\d.eE+-]+$"), "number").otherwise("string")


def field_checks(value: Column, kind: Column, path: Column, fields: tuple) -> list[Column]:
    """Anomalies of each field of a dictionary.  value and kind map a name to its text and JSON type; both are null without it."""
    out = []
    for name, expected, required, allowed in fields:
        v, k = value[name], F.coalesce(kind[name], F.lit("null"))
        at = F.concat(path, F.lit("." + name))
        types = set(expected.split("|")) | ({"integer"} if "number" in expected else set())
        absent = k == "null"
        if required:
            out.append(F.when(absent, _row(at, name, P.ANOMALY["missing"], f"{name} is required and null", "high")))
        out.append(F.when(~absent & ~k.isin(*types), _row(at, name, P.ANOMALY["type"], F.concat(F.lit(f"{expected} was expected, found "), k), "high")))
        if allowed:
            out.append(F.when(~absent & ~v.isin(*allowed), _row(at, name, P.ANOMALY["value"], F.concat(v, F.lit(" is none of the values there are")), "medium")))
        if required:
            out.append(F.when((k == "string") & (F.trim(v) == ""), _row(at, name, P.ANOMALY["blank"], f"{name} is required and empty", "high")))
    return out


def _typed(df: DataFrame, raw: Column, names: list[str]) -> DataFrame:
    """df with kinds, a map of name to JSON type of an object's fields, from its variant: a string of digits stays a string.

    The variant is a column of its own, as an expression within others would be parsed again for each field and each type.
    """
    kind = lambda s: F.when(s.isNull() | (s == "VOID"), "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "BIGINT", "integer").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("number")
    shown = F.array(*[F.schema_of_variant(F.try_variant_get("_v", f"$.{n}", "variant")) for n in names])
    parsed = df.withColumn("_v", F.try_parse_json(raw)).withColumn("_shown", shown)
    return parsed.withColumn("kinds", F.map_from_arrays(F.array(*map(F.lit, names)), F.transform("_shown", kind))).drop("_v", "_shown")


def parsed(docs: DataFrame) -> DataFrame:
    """Documents (company, raw) as of constraints.structured, parsed once and kept; those that are, as they are.

    Kept as a table, as filters on shape and events of a mere plan are pushed below the parsing and parse again for each
    mention, and each part of a profile would do so.
    """
    return docs if "shape" in docs.columns else stored(K.structured(docs).drop("raw"))


def _names(fields: tuple) -> list[str]:
    return [f[0] for f in fields]


def _explode(df: DataFrame, keys: list[str], checks: list[Column]) -> DataFrame:
    return df.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("x")).select(*keys, "x.*")


def profile_structured(docs: DataFrame) -> DataFrame:
    """company, path, field, type, detail, severity of structured documents (company, raw), of either form."""
    s = parsed(docs).where("shape in ('structured_nested', 'structured_flat')")
    info = _typed(s, F.col("doc")["company"], _names(P.COMPANY_FIELDS)).withColumn("root", F.lit("$.company"))
    value = F.col("inner")
    checks = field_checks(value, F.col("kinds"), F.col("root"), P.COMPANY_FIELDS)
    for name in ("listing_date", "prospectus_date"):
        v = value[name]
        bad = (v != "") & ((F.length(v) != 10) | (F.substring(v, 5, 1) != "-") | (F.substring(v, 8, 1) != "-"))
        checks.append(F.when(bad, _row(F.concat(F.col("root"), F.lit("." + name)), name, P.ANOMALY["bad_date"], F.concat(v, F.lit(" is no day")), "high")))
    checks.append(F.when(F.size("events") == 0, _row(F.lit("$.company.financing_events"), "financing_events", P.ANOMALY["no_data"], "there are no events", "critical")))
    top = _explode(info, ["company"], checks)
    processing = _typed(s.withColumn("m", K.presence(F.col("inner")["processing"])), F.col("inner")["processing"], _names(P.PROCESSING_FIELDS)).withColumn("root", F.lit("$.company.processing"))
    checks = field_checks(F.col("m"), F.col("kinds"), F.col("root"), P.PROCESSING_FIELDS)
    for name in ("download_status", "parse_status", "locate_status", "extract_status"):
        checks.append(F.when(~F.coalesce(F.col("m")[name] == "success", F.lit(False)), _row(F.lit(f"$.company.processing.{name}"), name, P.ANOMALY["step"], F.concat(F.lit(f"{name} = "), F.coalesce(F.col("m")[name], F.lit("None"))), "medium")))
    checks.append(F.when(~F.coalesce(F.col("m")["review_status"] == "checked", F.lit(False)), _row(F.lit("$.company.processing.review_status"), "review_status", P.ANOMALY["unreviewed"], "nobody has checked it", "low")))
    steps = _explode(processing, ["company"], checks)
    prefix = F.when(F.col("shape") == "structured_nested", F.lit("$.company.financing_events[")).otherwise(F.lit("$.financing_events["))
    events = s.select("company", prefix.alias("prefix"), F.posexplode("events").alias("i", "e")).select("company", F.concat("prefix", F.col("i").cast("string"), F.lit("]")).alias("root"), "e", K.presence(F.col("e")).alias("m"))
    events = _typed(events, F.col("e"), _names(P.EVENT_FIELDS)).withColumn("parties", F.from_json(F.col("m")["investors"], "array<string>"))
    m, root = F.col("m"), F.col("root")
    date, total = m["event_date"], m["total_investment_amount"].try_cast("double")
    amounts = F.transform("parties", lambda p: F.coalesce(F.get_json_object(p, "$.investment_amount").try_cast("double"), F.lit(0.0)))
    paid = F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x)
    parts = F.split(date, "-")
    checks = field_checks(m, F.col("kinds"), root, P.EVENT_FIELDS) + [
        F.when((F.size(parts) == 3) & (F.length(date) != 10), _row(F.concat(root, F.lit(".event_date")), "event_date", P.ANOMALY["odd_date"], F.concat(date, F.lit(" has three parts but is no day")), "low")),
        F.when(m["inferred_round"].contains("轮轮"), _row(F.concat(root, F.lit(".inferred_round")), "inferred_round", P.ANOMALY["typo"], F.concat(F.lit("a character stands twice: "), m["inferred_round"]), "high")),
        F.when(date.rlike(r"^.{4}-.{4}$") & (F.size(parts) == 2), _row(F.concat(root, F.lit(".event_date")), "event_date", P.ANOMALY["span"], F.concat(date, F.lit(" is more than one year")), "high")),
        F.when(F.coalesce(F.size("parties"), F.lit(0)) <= 0, _row(F.concat(root, F.lit(".investors")), "investors", P.ANOMALY["no_data"], "there are no investors", "high")),
        F.when((total > 0) & (paid > 0) & (F.abs(total - paid) > 1), _row(root, "total_investment_amount", P.ANOMALY["amounts"], F.concat(F.lit("the total is "), total.cast("string"), F.lit(", investors paid "), paid.cast("string")), "high")),
        F.when((m["event_type"] == "增资") & m["total_investment_amount"].isNull(), _row(root, "total_investment_amount", P.ANOMALY["no_data"], "capital was raised, but the total is null", "medium")),
        F.when(m["confidence"] == "low", _row(root, "confidence", P.ANOMALY["unsure"], "its confidence is low", "medium")),
    ]
    per_event = _explode(events, ["company"], checks)
    parties = events.select("company", "root", F.posexplode("parties").alias("j", "p")).select("company", F.concat("root", F.lit(".investors["), F.col("j").cast("string"), F.lit("]")).alias("root"), "p", K.presence(F.col("p")).alias("m"))
    parties = _typed(parties, F.col("p"), _names(P.INVESTOR_FIELDS))
    per_party = _explode(parties, ["company"], field_checks(F.col("m"), F.col("kinds"), F.col("root"), P.INVESTOR_FIELDS))
    return top.unionByName(steps).unionByName(per_event).unionByName(per_party)


def profile_basic(docs: DataFrame) -> DataFrame:
    """The same columns for documents without the structure."""
    s = parsed(docs).where("shape = 'basic'")
    top = _explode(s, ["company"], [
        F.when(~F.map_contains_key("doc", F.lit("company")), _row(F.lit("$"), "structure", P.ANOMALY["no_structure"], "there is no company object", "critical")),
        F.when(F.size("events") == 0, _row(F.lit("$.financing_events"), "financing_events", P.ANOMALY["no_events"], "there are no events", "critical")),
    ])
    events = s.select("company", F.posexplode("events").alias("i", "e")).withColumn("m", K.presence(F.col("e"))).where("m is not null")
    at = F.concat(F.lit("$.financing_events["), F.col("i").cast("string"), F.lit("]"))
    none = F.coalesce(F.size(F.from_json(F.col("m")["participants"], "array<string>")), F.lit(0)) <= 0
    return top.unionByName(_explode(events, ["company"], [F.when(F.col("m")["date"].isNull(), _row(F.concat(at, F.lit(".date")), "date", P.ANOMALY["no_date"], "the date is null", "high")), F.when(none, _row(F.concat(at, F.lit(".participants")), "participants", P.ANOMALY["no_parties"], "nobody is named", "medium"))]))


def profile(docs: DataFrame) -> DataFrame:
    """Anomalies of all documents of whatever shape."""
    docs = parsed(docs)
    return profile_structured(docs).unionByName(profile_basic(docs))


def severities(anomalies: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by severity, a column for each."""
    return anomalies.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def summary_index(docs: DataFrame, anomalies: DataFrame) -> DataFrame:
    """company, shape, events, investors, high_confidence and counts of anomalies by severity of each document."""
    s = parsed(docs)
    parties = F.aggregate(F.transform("events", lambda e: F.greatest(F.coalesce(F.size(F.from_json(F.get_json_object(e, "$.investors"), "array<string>")), F.lit(0)), F.lit(0))), F.lit(0), lambda a, x: a + x)
    sure = F.size(F.filter("events", lambda e: F.coalesce(F.get_json_object(e, "$.confidence") == "high", F.lit(False))))
    counts = severities(anomalies, ["company"])
    told = s.select("company", "shape", F.size("events").cast("long").alias("events"), parties.cast("long").alias("investors"), sure.cast("long").alias("high_confidence"))
    return told.join(counts, "company", "left").na.fill(0, list(SEVERITIES))


def review(docs: DataFrame) -> DataFrame:
    """company, i (event, from 0), rule: the reviewer's rules that need no reader.

    sum: investors' amounts against the total; price: price times shares against the amount; order: an event_order
    not above the one before; uncertain: an investor of unclear kind; peers: an amount missing among disclosed ones.
    """
    s = K.structured(docs)
    events = s.select("company", F.posexplode("events").alias("i", "e"))
    number = lambda c, k: F.get_json_object(c, f"$.{k}").try_cast("double")
    parties = F.coalesce(F.from_json(F.get_json_object("e", "$.investors"), "array<string>"), F.array().cast("array<string>"))
    events = events.select("company", F.col("i").cast("long").alias("i"), parties.alias("p"), number(F.col("e"), "total_investment_amount").alias("total"), number(F.col("e"), "share_price").alias("price"), number(F.col("e"), "event_order").alias("order"))
    events = events.withColumn("before", F.lag("order").over(W.partitionBy("company").orderBy("i")))
    amounts = F.transform("p", lambda x: number(x, "investment_amount"))
    paid = F.aggregate(F.array_compact(amounts), F.lit(0.0), lambda a, x: a + x)
    off = F.exists("p", lambda x: F.coalesce(F.abs(F.col("price") * number(x, "shares_acquired") - number(x, "investment_amount")) > F.greatest(F.lit(1.0), number(x, "investment_amount") * 0.01), F.lit(False)))
    rules = {
        "sum": (F.col("total") > 0) & (paid > 0) & (F.abs(F.col("total") - paid) > 1), "price": off, "order": F.col("order") <= F.col("before"), "uncertain": F.exists("p", lambda x: F.coalesce(F.get_json_object(x, "$.is_pevc") == "uncertain", F.lit(False))),
        "peers": F.exists(amounts, lambda x: x.isNull()) & F.exists(amounts, lambda x: x.isNotNull()),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return events.select("company", "i", F.explode(found).alias("rule"))


def spread(df: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, least, median and most of each column, from one aggregate."""
    parts = [F.struct(F.lit(m).alias("metric"), F.min(m).cast("double").alias("least"), F.median(m).cast("double").alias("median"), F.max(m).cast("double").alias("most")) for m in metrics]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))
