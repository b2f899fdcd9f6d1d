"""Events and timelines from candidate texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from . import segment as G
from . import select as S


def _events(docs: DataFrame, keys: Sequence[str], pieces: Column, rules: Sequence[tuple[str, str]], amount, party: str, parties: int, describe, most: int | None) -> DataFrame:
    """One row for each event: keys, event_no, event_type, date, amount, participants, description.

    Pieces of 30 characters or more with a type are events; of those of one month in a text the first stays, those
    without a date all stay.
    """
    each = docs.select(*keys, F.posexplode(pieces).alias("event_no", "piece")).where(F.length("piece") >= 30)
    typed = each.withColumn("event_type", T.event_type(F.col("piece"), rules)).where("event_type is not null").withColumn("date", T.year_month(F.col("piece")))
    once = S.keep_first_or_null(typed, "date", ["event_no"], keys)
    if most:
        once = S.first_k(once, keys, ["event_no"], most)
    return once.select(*keys, F.col("event_no").cast("long").alias("event_no"), "event_type", "date", amount(F.col("piece")).alias("amount"), T.participants(F.col("piece"), party, parties).alias("participants"), describe(F.col("piece")).alias("description"))


def events(docs: DataFrame, keys: Sequence[str] = ("company",), text: str = "text") -> DataFrame:
    """Events of the document pipeline."""
    return _events(docs, keys, G.event_paragraphs(F.col(text)), P.EVENT_RULES, T.amount, P.PARTY, 8, lambda c: F.left(T.clean(c), F.lit(300)), None)


def events_batch(docs: DataFrame, keys: Sequence[str] = ("company",), text: str = "text", most: int = 30, ordinals: bool = True) -> DataFrame:
    """Events of the market batch; without ordinals texts of few years are not cut before ordinals as well."""
    return _events(docs, keys, G.event_segments(F.col(text), ordinals), P.EVENT_RULES_BATCH, T.amount_batch, P.PARTY_BATCH, 10, lambda c: F.left(T.strip(c), F.lit(500)), most)


def short_facts(docs: DataFrame, keys: Sequence[str] = ("company",), text: str = "text", most: int = 20) -> DataFrame:
    """Date tokens (kind by kind), then contexts of lines with a keyword, the first most of both: keys, kind, nth, value."""
    tokens = docs.select(*keys, F.posexplode(T.date_tokens(F.col(text))).alias("nth", "value")).withColumn("kind", F.lit("date_pattern"))
    rows = G.lines(docs, keys, text)
    contexts = G.line_context(rows, keys, "line_no", "line", F.col("line").rlike(P.EVENT_SHORT_FACTS)).select(*keys, F.col("line_no").alias("nth"), F.col("context").alias("value"), F.lit("financing_event").alias("kind"))
    both = tokens.select(*keys, F.col("nth").cast("long").alias("nth"), "value", "kind").unionByName(contexts)
    return S.first_k(both, keys, [F.col("kind") == "financing_event", "nth"], most)


def timeline(docs: DataFrame, keys: Sequence[str] = ("company",), text: str = "text", most: int = 30) -> DataFrame:
    """Lines that begin with a date; for texts without one, lines with a keyword and a date: keys, line_no, date, section, event."""
    rows = G.lines(docs, keys, text)
    strict = G.carry_heading(rows, keys).where(F.col("line").rlike(P.TIMELINE_LINE) & (F.length("line") > 30)).select(*keys, "line_no", T.year_month(F.col("line"), P.TIMELINE_LINE).alias("date"), "section", F.left(T.strip(F.regexp_extract("line", P.TIMELINE_LINE, 4)), F.lit(200)).alias("event"))
    loose = rows.where(F.col("line").rlike(P.TIMELINE_WORDS) & F.col("line").rlike(P.TIMELINE_LOOSE_DATE))
    loose = S.missing(loose, strict, keys).select(*keys, "line_no", T.year_month(F.col("line"), P.TIMELINE_LOOSE_DATE).alias("date"), F.lit(None).cast("string").alias("section"), F.left(T.clean(F.col("line")), F.lit(200)).alias("event"))
    return S.first_k(strict.unionByName(loose), keys, ["line_no"], most)


def timeline_batch(docs: DataFrame, keys: Sequence[str] = ("company",), text: str = "text", most: int = 40) -> DataFrame:
    """Lines that begin with a date, or hold a keyword and a date; the first of each month in a text.

    A line whose strict month was seen is tried again loosely, where its first date may be another.
    """
    rows = G.lines(docs, keys, text)
    is_strict = F.col("line").rlike(P.TIMELINE_LINE) & (F.length("line") > 30)
    is_loose = F.col("line").rlike(P.TIMELINE_WORDS_BATCH) & F.col("line").rlike(P.TIMELINE_LOOSE_DATE) & (F.length("line") > 20)
    strict = F.when(is_strict, F.struct(T.year_month(F.col("line"), P.TIMELINE_LINE).alias("date"), F.left(T.strip(F.regexp_extract("line", P.TIMELINE_LINE, 4)), F.lit(300)).alias("event")))
    loose = F.when(is_loose, F.struct(T.year_month(F.col("line"), P.TIMELINE_LOOSE_DATE).alias("date"), F.left(T.strip(F.col("line")), F.lit(300)).alias("event")))
    each = rows.select(*keys, "line_no", F.posexplode(F.array_compact(F.array(strict, loose))).alias("tier", "x")).select(*keys, "line_no", "tier", "x.*")
    # Of both readings of a line only the first whose month is new counts; it is the strict one where both are of one month.
    once = S.keep_first(each, [*keys, "date"], ["line_no", "tier"])
    once = S.keep_first(once, [*keys, "line_no"], ["tier"])
    return S.first_k(once, keys, ["line_no"], most).select(*keys, "line_no", "date", "event")


def assemble(sections: DataFrame, event_rows: DataFrame, timeline_rows: DataFrame, most_events: int = 30, most_timeline: int = 25, prefix: int = 60) -> tuple[DataFrame, DataFrame]:
    """A company's events and timeline over all its sections (column section_no orders them).

    Timeline entries of one date and beginning are one; both are cut to their caps.
    """
    titles = sections.select("company", "section_no", F.col("title").alias("source_chapter"))
    ev = S.first_k(event_rows.join(titles, ["company", "section_no"]), ["company"], ["section_no", "event_no"], most_events)
    tl = timeline_rows.withColumn("_begin", F.left("event", F.lit(prefix)))
    tl = S.first_k(S.keep_first(tl, ["company", "date", "_begin"], ["section_no", "line_no"]).drop("_begin"), ["company"], ["section_no", "line_no"], most_timeline)
    return ev, tl


def context_events(docs: DataFrame, keys: Sequence[str] = ("company",), text: str = "text", rules: Sequence[tuple] = P.CONTEXT_EVENTS, most: int = 500) -> DataFrame:
    """Events by contextual patterns, with the text around each match as evidence: keys, event_no, event_type, event_date, evidence_text, notes.

    Rules are (type, pattern, characters before, characters after, note, first only); a pattern's groups 1 and 2 are year and
    month.  Events come rule by rule, in each by place.  A null text gives none.
    """
    c = F.col(text)

    def of_rule(name: str, pattern: str, before: int, after: int, note: str | None, first: bool) -> Column:
        spans = T.match_spans(c, pattern, (1, 2))
        spans = F.slice(spans, 1, 1) if first else spans

        def event(s: Column) -> Column:
            begin = F.greatest(s["start"] - before, F.lit(0)).cast("int")
            evidence = F.left(T.strip(F.substring(c, begin + 1, (s["stop"] + after).cast("int") - begin)), F.lit(most))
            return F.struct(F.lit(name).alias("event_type"), F.concat_ws("-", s["values"][0], F.lpad(s["values"][1], 2, "0")).alias("event_date"), evidence.alias("evidence_text"), F.lit(note).cast("string").alias("notes"))

        return F.transform(spans, event)

    found = docs.select(*keys, F.posexplode(F.concat(*[of_rule(*r) for r in rules])).alias("n", "x"))
    return found.select(*keys, (F.col("n") + 1).cast("long").alias("event_no"), "x.*")
