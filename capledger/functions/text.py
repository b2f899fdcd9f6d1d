"""Column functions over text: every one maps columns to a column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of the group, or null (regexp_extract alone gives an empty string)."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def every(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


#: Matches whose positions are added up together; a text's are added up in blocks of so many.
_SPANS_IN_ORDER = 256


def match_spans(c: Column, pattern: str, groups: Sequence[int] = (0,)) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, stop, values>>: code points from 0, and the groups' texts.

    split gives the gaps between the matches that regexp_extract_all gives, by the same engine, so running sums of their
    lengths are the positions.  Sums are made block by block, so the work is in proportion to the matches.  A null text gives
    null; a pattern that matches nothing in length is not for this.
    """
    kind = "array<struct<start:long,stop:long,values:array<string>>>"
    found_ = every(c, pattern)
    gaps = F.slice(F.split(c, pattern, -1), F.lit(1), F.size(found_))
    values = [every(c, pattern, g).alias(f"g{g}") for g in groups]
    pieces = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found_, F.length).alias("size"), *values)

    def positions(p: Column) -> Column:
        block = lambda b: F.slice(p, b * _SPANS_IN_ORDER + 1, F.lit(_SPANS_IN_ORDER))
        blocks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _SPANS_IN_ORDER).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0).cast("long"), lambda acc, x: acc + x["gap"] + x["size"]))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        starts = F.aggregate(sums, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            one = F.struct(start.alias("start"), (start + x["size"]).alias("stop"), F.array(*[x[f"g{g}"] for g in groups]).alias("values"))
            return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        inside = lambda z: F.aggregate(block(z["b"]), F.struct(z["at"].alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("at")), inside))

    # pieces is named by a lambda, so that it is made once; a cheap test first, as most texts have no match.
    return F.when(c.rlike(pattern), F.transform(F.array(pieces), positions)[0]).when(c.isNotNull(), F.array().cast(kind))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def number(c: Column) -> Column:
    """Text with thousands separators as a double; null if it is none."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def company_key(stem: Column, prefix: str = "") -> Column:
    """Company of a file stem: without prefix, a final md and final digits; null if nothing is left."""
    key = F.replace(stem, F.lit(prefix), F.lit("")) if prefix else stem
    return F.nullif(F.regexp_replace(F.regexp_replace(key, "md$", ""), r"(?U)\d+$", ""), F.lit(""))


def company_key_coded(stem: Column) -> Column:
    """code_name of a stem like 688001_name_招股书_...; else the stem without final digits and outer underscores."""
    coded = r"^(688\d{3})_(.+?)_招股书"
    plain = F.btrim(F.regexp_replace(stem, r"(?U)\d+$", ""), F.lit("_"))
    return F.nullif(F.when(stem.rlike(coded), F.concat_ws("_", F.regexp_extract(stem, coded, 1), F.regexp_extract(stem, coded, 2))).otherwise(plain), F.lit(""))


def clean(c: Column) -> Column:
    """Without image links, tags, fenced code and heading marks, in this order."""
    for pattern in (r"!\[.*?\]\(.*?\)", r"<[^>]+>", r"(?s)```.*?```", r"(?U)#+\s*"):
        c = F.regexp_replace(c, pattern, "")
    return strip(c)


def join_lines(c: Column) -> Column:
    """Single line breaks go; empty lines stay."""
    return F.regexp_replace(c, r"(?<!\n)\n(?!\n)", "")


def year_month(c: Column, pattern: str = P.YEAR_MONTH) -> Column:
    """First year and month as YYYY-MM, or null."""
    return F.when(c.rlike(pattern), F.concat_ws("-", F.regexp_extract(c, pattern, 1), F.lpad(F.regexp_extract(c, pattern, 2), 2, "0")))


def date_tokens(c: Column, kinds: Sequence[str] = P.DATE_TOKENS) -> Column:
    """All date tokens, kind by kind."""
    return F.concat(*[every(c, k) for k in kinds])


def first_of(c: Column, kinds: Sequence[str], group: int = 1) -> Column:
    """First match of the first pattern that has one."""
    return F.coalesce(*[found(c, k, group) for k in kinds])


def amount(c: Column) -> Column:
    return found(c, P.AMOUNT)


def amount_batch(c: Column) -> Column:
    return first_of(c, P.AMOUNTS_BATCH)


def amounts(c: Column) -> Column:
    """All amounts in ten thousands of yuan, as doubles."""
    return F.transform(every(c, P.AMOUNT_TEN_THOUSAND, 1), number)


def unit_price(c: Column) -> Column:
    return found(c, P.UNIT_PRICE).try_cast("double")


def post_capital(c: Column, pattern: str = P.POST_CAPITAL) -> Column:
    return number(found(c, pattern))


def participants(c: Column, pattern: str = P.PARTY, most: int = 8, least_length: int = 0) -> Column:
    """Names by their endings, each once, in the order of first mention."""
    names = every(c, pattern, 1)
    if least_length:
        names = F.filter(names, lambda n: F.length(n) >= least_length)
    return F.slice(F.array_distinct(names), 1, most)


def window_around(c: Column, pattern: str, before: int, after: int, most: int) -> Column:
    """Text around the first match: so many characters before its start and after its end, stripped and cut."""
    at = F.regexp_instr(c, F.lit(pattern))
    start = F.greatest(at - before, F.lit(1))
    stop = at + F.length(F.regexp_extract(c, pattern, 0)) + after
    return F.when(at > 0, F.left(strip(F.substring(c, start, stop - start)), F.lit(most)))


def file_date(c: Column) -> Column:
    """YYYYMMDD of a date with /, . or - between its parts (day 1 if there is none); else the text without /."""
    parts = F.split(F.translate(F.trim(c), "/.", "--"), "-")
    piece = lambda i, d: F.coalesce(F.get(parts, F.lit(i)), F.lit(d)).try_cast("int")
    y, m, d = piece(0, ""), piece(1, ""), piece(2, "1")
    made = F.concat(F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.coalesce(made, F.replace(F.trim(c), F.lit("/"), F.lit("")))


def file_name(code: Column, name: Column, version: Column, date: Column, most: int = 200) -> Column:
    """File name of a prospectus; characters that files cannot have become _."""
    whole = F.concat(F.concat_ws("_", F.coalesce(code, F.lit("unknown")), F.coalesce(name, F.lit("unknown")), F.lit("招股书"), F.coalesce(F.nullif(version, F.lit("")), F.lit("正式稿")), file_date(F.coalesce(date, F.lit("")))), F.lit(".pdf"))
    return F.left(F.regexp_replace(whole, r'[\\/:*?"<>|]', "_"), F.lit(most))


def absolute_url(c: Column, base: str) -> Column:
    return F.when((c == "") | c.isNull() | c.startswith("http"), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(c, F.lit("/"))))


def clean_number(c: Column) -> Column:
    """Digits and dots of a cell as a double; 0 and what is no number are null."""
    return F.nullif(F.regexp_replace(c, r"[^0-9.]", "").try_cast("double"), F.lit(0.0))


def ratio(c: Column) -> Column:
    return F.concat(found(c, r"(?U)(\d+\.?\d*)\s*%"), F.lit("%"))


def shown(c: Column, digits: int = 4) -> Column:
    return F.round(c, digits)


def month_key(c: Column) -> Column:
    """YYYY-MM at the start, else the whole text."""
    return F.coalesce(found(c, r"^(\d{4}-\d{2})"), c)


def ladder(steps: Sequence[tuple[Column, str]], default: str) -> Column:
    """Value of the first condition that holds, else default."""
    out = F.lit(default)
    for condition, value in reversed(steps):
        out = F.when(condition, value).otherwise(out)
    return out


def holder_type(name: Column, declared: Column) -> Column:
    """Words of the name win over the declared type."""
    by_name = [(name.rlike("有限合伙|基金|创投|投资"), "外部PE"), (name.rlike("员工|持股平台"), "员工持股平台")]
    by_declared = [(declared == d, v) for d, v in (("自然人", "自然人"), ("PE", "外部PE"), ("VC", "外部VC"), ("产业资本", "产业资本"), ("政府基金", "政府基金"))]
    return ladder(by_name + by_declared, "其他")


def founder(order: Column) -> Column:
    return F.when(order == 0, "yes").otherwise("unknown")


def snapshot_label(event_type: Column, inferred: Column) -> Column:
    named = inferred.isNotNull() & (inferred != "") & (inferred != "未披露")
    return F.when(named, F.concat(event_type, F.lit("后（"), inferred, F.lit("）"))).otherwise(F.concat(event_type, F.lit("后")))


def reply_json(c: Column, schema: str) -> Column:
    """A model's reply as a struct: a code fence around it goes, then it is parsed."""
    return F.from_json(F.regexp_replace(strip(c), r"^```(?:json)?\s*|\s*```$", ""), schema)


def or_default(c: Column, default: object) -> Column:
    return F.coalesce(c, F.lit(default))


def rule_index(c: Column, words: Sequence[str]) -> Column:
    """Number (from 1) of the first pattern that matches; null if none does."""
    out = F.lit(None).cast("long")
    for i, w in reversed(list(enumerate(words, 1))):
        out = F.when(c.rlike(w), F.lit(i).cast("long")).otherwise(out)
    return out


def event_type(c: Column, rules: Sequence[tuple[str, str]] = P.EVENT_RULES) -> Column:
    """Type of the first rule that matches; null if none does."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out
