"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as C

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Most times that a document is taken.
EPOCHS = 3
#: Rows of a source that one task puts in order, and of the range that the budget cuts.
ROWS_IN_ORDER = 4_000
#: Ranges whose sums are added up together; their totals are added up next.
RANGES_IN_ORDER = 4_096
#: Hexadecimal digits of the place that a range is cut by.
DIGITS = 15


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target: each source's share of all words, by weight, at most epochs times its size.

    What a capped source leaves is shared by weight among the others until none is above its cap.  Each round
    caps the sources that the common level lifts above their caps, and raises the level for the rest, until none is
    new; a round is one pre-aggregated sum.  Sources are numbered by ranges, each with the rows of those before it.
    Without words, or sources, nothing is shared: targets are 0.
    """
    by_name = F.col("source").asc_nulls_last()
    ranged = sized.groupBy("source").agg(F.sum("size").alias("source_size")).repartitionByRange(by_name).withColumn("range", F.spark_partition_id())
    ranged = C.materialize(ranged)
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    # A row for each partition of the shuffle.
    before = counts.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    number = F.col("before") + F.row_number().over(W.partitionBy("range").orderBy(by_name)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    s = C.materialize(ranged.join(before, "range").select("source", "source_size", weight.alias("w"), (F.col("source_size") * epochs).cast("double").alias("cap")))
    total, rest, capped, level = float(s.agg(F.sum("source_size")).first()[0] or 0), s.agg(F.sum("w")).first()[0], -1, 0.0
    caps = 0.0
    while rest:
        level = (total - caps) / rest
        above = F.col("w") * level > F.col("cap")
        now = s.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("cap"))).alias("caps"), F.sum(F.when(~above, F.col("w"))).alias("rest")).first()
        if now["n"] == capped:
            break
        capped, caps, rest = now["n"], now["caps"] or 0.0, now["rest"]
    return s.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def _source_key(c: Column) -> Column:
    """A source as text that is never null, so that null is a source like others in joins."""
    return F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))


def _place(c: Column, text: Column) -> Column:
    """A document's place in its source: a hash of its id and text, so that rows without an id are spread as well."""
    return F.md5(F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit(":"), F.md5(text)))


def _fair_queue(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], epochs: int) -> tuple[DataFrame, int]:
    """The documents with their source's size and target and the source's words up to their end; their number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(C.WORD)).cast("long")
    sized = C.materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("digest"), _place(F.col(id_col), text).alias("place")), scan=True)
    n = sized.count()
    targets = source_targets(sized, weights, epochs).select(_source_key(F.col("source")).alias("key"), "source_size", "target")
    parts = max(1, -(-n // ROWS_IN_ORDER))
    # Ranges of the place are put in order apart and joined by their sums; these are added up in two levels.
    rows = sized.select("doc_id", "size", "digest", _source_key(F.col("source")).alias("key"), "place")
    share = F.conv(F.substring("place", 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)
    rows = rows.withColumn("part", F.least(F.floor(share * parts), F.lit(parts - 1)).cast("int"))
    sums = rows.groupBy("key", "part").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("part") / RANGES_IN_ORDER))
    groups = sums.groupBy("key", "group").agg(F.sum("words").alias("all"))
    groups = groups.select("key", "group", (F.sum("all").over(W.partitionBy("key").orderBy("group")) - F.col("all")).alias("groups_before"))
    own = (F.sum("words").over(W.partitionBy("key", "group").orderBy("part")) - F.col("words")).alias("own")
    before = sums.select("key", "part", "group", own).join(groups, ["key", "group"]).select("key", "part", (F.col("own") + F.col("groups_before")).alias("before")).join(targets, "key")
    inside = W.partitionBy("key", "part").orderBy("place", "doc_id", "size", "digest").rowsBetween(W.unboundedPreceding, 0)
    queued = rows.withColumn("inside", F.sum("size").over(inside)).join(before, ["key", "part"])
    return C.materialize(queued.select("doc_id", "key", "size", "digest", "place", "source_size", "target", (F.col("before") + F.col("inside")).alias("upto"))), n


def _taken(queued: DataFrame, n: int, epochs: int) -> DataFrame:
    """queued with times: how often the mix takes each row."""
    # Finish times of a source are spread evenly from 0 to epochs * size / target, so equal spans of time are even ranges.
    spans = max(1, -(-n * epochs // ROWS_IN_ORDER)) * 4
    live = (F.col("size") > 0) & (F.col("target") > 0)
    finish = lambda e: (F.col("source_size") * e + F.col("upto")) / F.col("target")
    span = lambda t: F.least(F.floor(t * spans), F.lit(1 << 62)).cast("long")
    order = ("finish", "key", "epoch", "place", "doc_id")
    items = F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), finish(e).alias("finish")) for e in range(epochs)])).alias("x")
    times = queued.where(live).select("doc_id", "key", "size", "place", items).select("doc_id", "key", "size", "place", "x.*").withColumn("span", span(F.col("finish")))
    total = queued.agg(F.sum("size")).first()[0] or 0
    words = C.materialize(times.groupBy("span").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("span") / RANGES_IN_ORDER)))

    def cut(sums: DataFrame, by: str, before: int):
        """The first value of by up to which the words exceed the budget, and the words before it."""
        upto = sums.withColumn("upto", F.lit(before) + F.sum("words").over(W.orderBy(by)))
        return upto.where(F.col("upto") > total).agg(F.min(F.struct(by, (F.col("upto") - F.col("words")).alias("before")))).first()[0]

    # First among groups of spans, then among the spans of that group, so that few rows are in one order.
    at = cut(words.groupBy("group").agg(F.sum("words").alias("words")), "group", 0)
    at = at and cut(words.where(F.col("group") == at["group"]), "span", at["before"])
    if at is None:
        return queued.withColumn("times", F.when(live, epochs).otherwise(0))
    running = F.lit(at["before"]) + F.sum("size").over(W.partitionBy("span").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    in_cut = times.where(F.col("span") == at["span"]).select(F.struct(*order).alias("at"), running.alias("running"))
    last = in_cut.where(F.col("running") <= total).agg(F.max("at").alias("last")).first()["last"]
    kinds = ("double", "string", "int", "string", dict(queued.dtypes)["doc_id"])
    taken = F.lit(0)
    for e in range(epochs):
        fits = F.lit(False)
        if last is not None:
            own = F.struct(finish(e).alias("finish"), F.col("key"), F.lit(e).alias("epoch"), F.col("place"), F.col("doc_id"))
            fits = own <= F.struct(*[F.lit(last[c]).cast(kind).alias(c) for c, kind in zip(order, kinds, strict=True)])
        taken = taken + F.when((span(finish(e)) < at["span"]) | ((span(finish(e)) == at["span"]) & fits), 1).otherwise(0)
    return queued.withColumn("times", F.when(live, taken).otherwise(0))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Return doc_id, size, source_size, target and taken (words that the mix takes) for each row.

    Each source's documents stand in the order of a hash of their id and text, and queue again for each epoch.  A
    document's virtual finish time is the source's words up to its end over the source's target.  All are
    put in one global order of finish time (then source, epoch, hash, id) and taken until the next would
    exceed the budget, which is the sum of all sizes.  The order is by ranges of finish time: ranges before
    the one that the budget cuts are taken whole, ranges after it are left, and only the cut range is sorted
    row by row.  Reruns agree.

    A null text has size 0 and taken 0; null is a source of its own; without words all targets are 0.
    Repeated rows each have their own place and result; an empty table gives an empty result.  Other columns are not read.
    """
    queued, n = _fair_queue(docs, id_col, text_col, source_col, weights, epochs)
    return _taken(queued, n, epochs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with their columns.

    Texts without words (or null) go; null is a source; an empty table stays empty.  A row goes by its id, source and text.  Rows
    repeated with the same three come as often as the mix takes them together, as evenly as can be.
    """
    queued, n = _fair_queue(docs, id_col, text_col, source_col, WEIGHTS, EPOCHS)
    mix = _taken(queued, n, EPOCHS).groupBy(F.col("doc_id").alias("_mix_id"), F.col("key").alias("_mix_key"), F.col("digest").alias("_mix_digest"))
    mix = mix.agg(F.sum("times").cast("int").alias("_mix_times"), F.count(F.lit(1)).cast("int").alias("_mix_rows")).where("_mix_times > 0")
    names = {c: C.free_name(docs, c) for c in (*mix.columns, "_mix_own_key", "_mix_own_digest", "_mix_n")}
    mix = mix.withColumnsRenamed(names)
    key, digest, times, rows, n_ = (names[c] for c in ("_mix_own_key", "_mix_own_digest", "_mix_times", "_mix_rows", "_mix_n"))
    own = docs.withColumns({key: _source_key(F.col(source_col).cast("string")), digest: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    same = own[id_col].eqNullSafe(mix[names["_mix_id"]]) & (own[key] == mix[names["_mix_key"]]) & (own[digest] == mix[names["_mix_digest"]])
    met = own.join(mix, same)
    number = F.row_number().over(W.partitionBy(id_col, key, digest).orderBy(times))
    several = met.where(F.col(rows) > 1).withColumn(n_, number).withColumn(times, (F.col(times) / F.col(rows)).cast("int") + (F.col(n_) <= F.col(times) % F.col(rows)).cast("int"))
    out = met.where(F.col(rows) == 1).unionByName(several.drop(n_)).where(F.col(times) > 0)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(n_)).drop(n_)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_sources over documents: nulls, ties, repeated rows and empty tables as there."""
    return mix_sources(C.table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, coalesce('s' || source, 'n') AS key, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place FROM documents
), s AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size, CAST({list(WEIGHTS)}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS INT) + 1] AS DOUBLE) AS w FROM d GROUP BY key, source
), c AS (
  SELECT *, CAST({EPOCHS} * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s
), o AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), t AS (
  SELECT key, source_size, least(cap, w * (SELECT arg_min(level, cap / w) FROM o WHERE level * w <= cap)) AS target FROM o
), q AS (
  SELECT doc_id, size, key, place, source_size, target, sum(size) OVER (PARTITION BY key ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t USING (key)
), e AS (
  SELECT *, CAST(source_size * epoch + upto AS DOUBLE) / target AS finish FROM q CROSS JOIN (SELECT unnest(range({EPOCHS})) AS epoch) WHERE size > 0 AND target > 0
), r AS (
  SELECT doc_id, sum(size) OVER (ORDER BY finish, key, epoch, place, doc_id ROWS UNBOUNDED PRECEDING) <= (SELECT sum(size) FROM d) AS fits FROM e
), k AS (
  SELECT doc_id, count(*) FILTER (fits) AS times FROM r GROUP BY doc_id
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * coalesce(times, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (doc_id)
"""
