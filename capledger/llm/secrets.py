"""Secret scans with corpus-wide ownership frequency; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import _common as C

#: Base kinds: name, pattern, group of the value, least characters of the value.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    # A run shorter than 24 fails as a whole, so the length stands in the pattern.
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
#: The method's kind: a token with a lower-case and an upper-case letter and a digit.
EXTRA = ("key", r"([A-Za-z0-9+/_=-]{20,})", 1, 20)
#: A value seen with at least so many owners, or in so many repositories, is a widely copied example.
WIDE_OWNERS, WIDE_REPOS = 3, 6


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches, in code points, whose value has at least the least length."""
    long_ = F.filter(T.match_spans(text, pattern, (group,)), lambda s: F.length(s["values"][0]) >= least)
    return F.transform(long_, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), s["values"][0].alias("value")))


def _show(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """Return doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example for each row.

    Base spans come from KINDS and always stay.  The method adds spans of kind key: tokens of mixed letters
    and digits outside the base spans whose value looks live.  To tell, the hashes of all values (base and
    key) are aggregated over the corpus by distinct owner (owner_col) and repository (repo_cols): a value
    with wide_owners owners or wide_repos repositories or more is a widely copied example, the others belong
    to few owners and look live.  n_live and n_example count a document's values of either sort.

    A null text counts as empty; a null owner is one owner.  Texts without a candidate, nearly all, meet no
    shuffle.  Value hashes are pre-aggregated to distinct (hash, owner, repository) before they shuffle, so
    a value copied into a third of all rows is a few rows; where they learn how widely a value is spread, values
    of many rows meet them by broadcast.  Repeated rows each give a row of the result; an empty table gives an empty result; other columns
    are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = [_spans(text, i, *k) for i, k in enumerate(KINDS)]
    covered = lambda s, by: F.exists(by, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    repo = F.xxhash64(*[F.coalesce(F.col(c), F.lit("\0")) for c in repo_cols])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(owner_col), F.lit("\0"))).alias("owner"), repo.alias("repo"), F.xxhash64(text).alias("digest"), F.array_sort(F.concat(*base)).alias("base"), _spans(text, len(KINDS), *EXTRA).alias("more"))
    rows = rows.withColumn("more", F.filter("more", lambda s: mixed(s["value"]) & ~covered(s, F.col("base"))))
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long")
    # One pass over the texts; from here on rows hold spans in place of texts.
    rows = C.materialize(rows.select("doc_id", "owner", "repo", "digest", *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)], "base", "more"), scan=True)
    has = (F.size("base") > 0) | (F.size("more") > 0)
    digest = lambda base: F.sha2(_show(base), 256).alias("base_sha256")
    empty = rows.where(~has).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    each = rows.where(has).select("*", F.explode(F.concat("base", "more")).alias("span")).withColumn("value", F.sha2(F.col("span")["value"], 256))
    # Distinct (value, owner, repository) is made before each shuffle; then each value is one row.
    seen = each.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("rows")).groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count(F.lit(1)).alias("repos"), F.sum("rows").alias("rows"))
    is_wide = (F.col("owners") >= wide_owners) | (F.col("repos") >= wide_repos)
    wide = C.materialize(seen.select("value", "rows", is_wide.alias("wide")).where(F.col("wide") | (F.col("rows") >= C.HOT_ROWS)))
    # A value may be in a third of all rows: values of many rows, wide or not, are few and meet theirs by broadcast.
    told = C.join_skewed(each, wide, "value", F.col("rows"), max(1, rows.count()), "left").withColumn("live", ~F.coalesce("wide", F.lit(False)))
    key = ["doc_id", "owner", "repo", "digest", "n_assign", "n_access", "n_hex"]
    kept = F.col("live") | (F.col("span")["rank"] < len(KINDS))
    mark = F.struct(F.col("span")["start"].alias("start"), F.col("span")["rank"].alias("rank"), F.col("span")["kind"].alias("kind"), F.col("span")["stop"].alias("stop"))
    # Rows repeated as a whole fall into one group; its size over its distinct spans is how many they were.
    by_row = told.groupBy(*key).agg(F.collect_set(F.when(kept, mark)).alias("all"), F.collect_set(F.when(F.col("live"), mark)).alias("live"), F.collect_set(F.when(~F.col("live"), mark)).alias("example"), F.count(F.lit(1)).alias("n"))
    one = by_row.withColumn("times", F.col("n") / (F.size("live") + F.size("example"))).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    found = one.select("doc_id", "n_assign", "n_access", "n_hex", digest(F.filter("all", lambda s: s["rank"] < len(KINDS))), _show(F.col("all")).alias("spans"), F.size("live").cast("long").alias("n_live"), F.size("example").cast("long").alias("n_example"))
    return empty.unionByName(found)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secret_scan over documents: nulls, ties, repeated rows and empty tables as there."""
    return secret_scan(C.table(spark, sf_dir, "documents"))
