"""Keep-first, caps, groups and look-ups over explicit keys and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Order = Sequence[Column | str]


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def first_k(df: DataFrame, keys: Sequence[str], order: Order, k: int) -> DataFrame:
    """The first k rows of each key.  Ties are open unless order is total.

    The filter on row_number becomes a group limit before the shuffle, so a large group sends k rows a task.
    """
    n = _free(df, "_n")
    return df.withColumn(n, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(n) <= k).drop(n)


def keep_first(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """One row of each key: the first in order.  Null keys are a key of their own."""
    return first_k(df, keys, order, 1)


def keep_first_or_null(df: DataFrame, key: str, order: Order, scope: Sequence[str] = ()) -> DataFrame:
    """keep_first by scope and key, but rows whose key is null all stay; those do not shuffle."""
    return keep_first(df.where(F.col(key).isNotNull()), [*scope, key], order).unionByName(df.where(F.col(key).isNull()))


def group_list(df: DataFrame, keys: Sequence[str], order: Order, value: str, name: str) -> DataFrame:
    """Values of each key as an array in order."""
    items = F.array_sort(F.collect_list(F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order], F.col(value).alias("_value"))))
    return df.groupBy(*keys).agg(F.transform(items, lambda x: x["_value"]).alias(name))


def month_sum(df: DataFrame, keys: Sequence[str], date: Column, value: str, name: str) -> DataFrame:
    """Sum by month of values that are neither null nor 0."""
    return df.where(F.col(value).isNotNull() & (F.col(value) != 0)).groupBy(*keys, F.left(date, F.lit(7)).alias("ym")).agg(F.sum(value).alias(name))


def sum_in_order(value: str, order: Sequence[str]) -> Column:
    """An aggregate: a key's values added one after the other in a total order; null without values.

    A sum of doubles depends on the order, and that of sum() on how rows fall to tasks.  A key's values meet in one array.
    """
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_value")))))
    return F.aggregate(rows, F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x["_value"], x["_value"]))


def distribution(df: DataFrame, keys: Sequence[str], category: str, name: str) -> DataFrame:
    """Counts by category as one text, k:n joined by commas, most frequent first, then by name."""
    counts = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_n"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(category).alias("c"))))
    return counts.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: F.concat(x["c"], F.lit(":"), (-x["n"]).cast("string"))), ", ").alias(name))


def best(df: DataFrame, keys: Sequence[str], priority: Order) -> DataFrame:
    """The row of best priority of each key."""
    return keep_first(df, keys, priority)


def precedence(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """first, and the rows of second whose key first has not."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def missing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left without a partner in right."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def has_partner(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """left with a flag that says whether right has the key."""
    return left.join(right.select(*keys).distinct().withColumn(name, F.lit(True)), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def first_match(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, order: Order, name: str, where: Column | None = None) -> DataFrame:
    """left with the value of the first row of right (in order, after where) of the same key, or null.

    right is reduced to a row for each key before the join, by a pre-aggregated minimum.
    """
    some = right if where is None else right.where(where)
    firsts = some.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(*order)).alias(name))
    return left.join(firsts, list(keys), "left")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, name: str) -> DataFrame:
    """left with the value of the latest row of right of the same key whose `at` is not after left's, or null.

    Both sides are put in one order by key and time and the last value is carried on: one shuffle, no pairs.
    right has at most one row for a key and time.
    """
    side, carried = _free(left, "_side"), _free(left, "_carried")
    columns = left.columns
    marks = right.select(*keys, at, F.col(value).alias(carried)).where(F.col(carried).isNotNull())
    both = left.withColumn(side, F.lit(1)).withColumn(carried, F.lit(None).cast(marks.schema[carried].dataType)).unionByName(marks.withColumn(side, F.lit(0)), allowMissingColumns=True)
    over = W.partitionBy(*keys).orderBy(at, side).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(name, F.last(carried, ignorenulls=True).over(over)).where(F.col(side) == 1).select(*columns, name)


def first_later(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, right_order: Order, value: str, name: str) -> DataFrame:
    """left with the value of the first row of right, in right_order, of the same key at or after left's time.

    Both sides are put in one order by key and falling time, and the least right row so far is carried on: one
    shuffle, no pairs, whatever right_order is.  Ties of right_order go to the least value; a null time meets nothing.
    """
    side, carried, at = _free(left, "_side"), _free(left, "_carried"), _free(left, "_at")
    columns = left.columns
    order = [(c if isinstance(c, Column) else F.col(c)).alias(f"o{i}") for i, c in enumerate(right_order)]
    marks = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias(at), F.struct(*order, F.col(value).alias("v")).alias(carried), F.lit(1).alias(side))
    both = left.withColumn(at, F.col(left_at)).withColumn(side, F.lit(0)).unionByName(marks, allowMissingColumns=True)
    over = W.partitionBy(*keys).orderBy(F.col(at).desc_nulls_first(), F.col(side).desc()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(name, F.min(carried).over(over)["v"]).where(F.col(side) == 0).select(*columns, name)


def two_step_match(left: DataFrame, right: DataFrame, exact: tuple[Column, str], relaxed: tuple[Column, str], value: str, name: str) -> DataFrame:
    """left with right's value by the exact key, and where that has none by the relaxed one.

    exact and relaxed: a column over left and the name of right's key.  right's values of a key are reduced to
    the least.
    """
    out = left
    for i, (key, theirs) in enumerate((exact, relaxed)):
        firsts = right.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        out = out.withColumn(f"_l{i}", key).join(firsts, F.col(f"_l{i}") == F.col(f"_k{i}"), "left").drop(f"_l{i}", f"_k{i}")
    return out.withColumn(name, F.coalesce("_v0", "_v1")).drop("_v0", "_v1")


def patch_blank(left: DataFrame, patch: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """left, with patch's values where left's are null or blank."""
    renamed = patch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = left.join(renamed, list(keys), "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.col(f"_new_{c}")).otherwise(F.col(c)))
    return out.select(*left.columns)


def consecutive(df: DataFrame, scope: Sequence[str], order: Order) -> DataFrame:
    """df with step: the rank, from 1, of the row's group among its scope's groups in order."""
    return df.withColumn("step", F.dense_rank().over(W.partitionBy(*scope).orderBy(*order)).cast("long"))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, total, present, null and rate (per cent; null without rows), from one aggregate over all columns."""
    counts = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count(c).alias(c) for c in columns])
    rows = counts.select("_total", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in columns])).alias("x"))
    return rows.select("x.field", F.col("_total").alias("total"), "x.present", (F.col("_total") - F.col("x.present")).alias("null"), F.round(F.try_divide(F.col("x.present") * 100.0, F.col("_total")), 1).alias("rate"))


def verdicts(df: DataFrame, keys: Sequence[str], status: str, values: Sequence[str]) -> DataFrame:
    """Counts of each status by key, a column for each."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values])
