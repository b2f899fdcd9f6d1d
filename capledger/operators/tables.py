"""Tables inside HTML, by expressions over strings and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

TABLE, ROW, CELL = r"(?s)<table>(.*?)</table>", r"(?s)<tr>(.*?)</tr>", r"(?s)<td[^>]*>(.*?)</td>"


def cells(row: Column, pattern: str = CELL) -> Column:
    """Texts of a row's cells, without inner tags."""
    return F.transform(F.regexp_extract_all(row, F.lit(pattern), F.lit(1)), lambda c: T.strip(F.regexp_replace(c, r"<[^>]+>", "")))


def rows(table: Column) -> Column:
    """Rows of a table as arrays of cells; rows whose cells are all empty go."""
    every = F.transform(F.regexp_extract_all(table, F.lit(ROW), F.lit(1)), lambda r: cells(r))
    return F.filter(every, lambda r: F.exists(r, lambda c: c != ""))


def tables(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TABLE), F.lit(1))


def holder_table(html: Column, headers: Sequence[Sequence[str]] = P.HOLDER_HEADERS) -> Column:
    """Rows of the first table whose first row holds all words of a set; sets are tried in order until one has two rows."""
    every = F.transform(tables(html), lambda t: F.struct(F.lower(F.regexp_extract(t, ROW, 1)).alias("head"), rows(t).alias("rows")))
    out = F.lit(None).cast("array<array<string>>")
    for words in reversed(headers):
        first = F.get(F.filter(every, _head_holds(words)), F.lit(0))["rows"]
        out = F.when(F.size(first) > 1, first).otherwise(out)
    return out


def _head_holds(words: Sequence[str]):
    return lambda t: _holds(t["head"], words)


def _holds(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & c.contains(w)
    return out


def column_of(header: Column, words: Sequence[str], default: int, without: Column | None = None) -> Column:
    """Index (from 0) of the first cell that holds a word, leaving out the index without; else default."""
    numbered = F.transform(header, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    hits = F.filter(numbered, lambda x: F.coalesce(x["c"].rlike("|".join(words)), F.lit(False)) & (F.lit(True) if without is None else x["i"] != without))
    return F.coalesce(F.get(hits, F.lit(0))["i"], F.lit(default))


def holders(docs: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """Holders of each document's first holder table: keys, row_no, shareholder_name, shares_held, ratio, capital, total_shares.

    Columns are bound by words of the header; the shares column is not the name column.  A total row gives
    total_shares to the rows after it; rows with a name shorter than two characters go.
    """
    bound = docs.select(*keys, holder_table(F.col(html)).alias("rows")).where("rows is not null").withColumn("header", F.get("rows", F.lit(0)))
    bound = bound.withColumn("name_at", column_of(F.col("header"), ("股东", "名称"), 0))
    bound = bound.withColumns({"shares_at": column_of(F.col("header"), ("持股", "股份", "股"), 1, F.col("name_at")), "ratio_at": column_of(F.col("header"), ("比例", "%"), 2), "capital_at": column_of(F.col("header"), ("出资额", "注册资本"), -1)})
    each = bound.select(*keys, "name_at", "shares_at", "ratio_at", "capital_at", F.posexplode("rows").alias("row_no", "cells")).where("row_no > 0")
    cell = lambda at: F.get("cells", F.col(at))
    total = F.coalesce(F.get("cells", F.lit(0)).rlike("合计|总计"), F.lit(False))
    over = W.partitionBy(*keys).orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("is_total", total).withColumn("total_shares", F.last(F.when(F.col("is_total"), T.clean_number(cell("shares_at"))), ignorenulls=True).over(over))
    named = each.where(~F.col("is_total") & (F.length(cell("name_at")) >= 2))
    return named.select(*keys, F.col("row_no").cast("long").alias("row_no"), cell("name_at").alias("shareholder_name"), T.clean_number(cell("shares_at")).alias("shares_held"), T.ratio(cell("ratio_at")).alias("shareholding_ratio"), F.when(F.col("capital_at") >= 0, T.clean_number(cell("capital_at"))).alias("capital_contribution"), "total_shares")


def holder_rows(c: Column, most: int = 10) -> Column:
    """Rows of four cells (rank, name, shares, ratio) by one pattern, as structs."""
    part = lambda g: F.regexp_extract_all(c, F.lit(P.HOLDER_ROW), F.lit(g))
    return F.slice(F.arrays_zip(part(1).alias("rank"), part(2).alias("name"), part(3).alias("shares"), part(4).alias("ratio")), 1, most)
