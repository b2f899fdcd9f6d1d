"""URL filters: path rules, and a cascade of Bloom filters over the corpus's hosts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: (host, path, verdict); the longest rule that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A url with a tracking parameter, and the share of a host's urls from which the host is listed, in per cent.
TRACKED, TRACKED_PERCENT = r"[?&](utm_[a-z]+|ref)=", 50
#: Slots for each key of a level (at least) and hash functions, and the share of other keys that a level passes at most.
BITS_PER_KEY, HASHES, PASSED = 8, 3, 0.04


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    url = F.coalesce(url, F.lit(""))
    part = lambda i: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return C.lower_ascii(part(1)), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def tracking_hosts(pages: DataFrame, url_col: str = "url", percent: int = TRACKED_PERCENT) -> DataFrame:
    """host: those of whose urls at least percent carry a tracking parameter.

    Counts cover all rows, repeated ones as often; null urls and urls without a host list nothing.
    """
    host, _ = host_and_path(F.col(url_col))
    counts = pages.select(host.alias("host"), F.coalesce(F.col(url_col).rlike(TRACKED), F.lit(False)).alias("tracked")).where("host <> ''")
    return counts.groupBy("host").agg(F.count_if("tracked").alias("t"), F.count(F.lit(1)).alias("n")).where(F.col("t") * 100 >= F.col("n") * percent).select("host")


class Cascade:
    """Filters of alternate levels: the listed keys, the universe's false positives, theirs, and so on.

    A key of the universe is listed if the first level that lacks it has an odd index (from 0), or if it
    passes all of an odd number of levels.  For keys of the universe that is exact.
    """

    def __init__(self, levels: list[tuple[int, bytes]]):
        self.levels = levels

    def listed(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), len(self.levels) % 2 == 1)
        live = np.ones(len(h), bool)
        for i, (log2, bits) in enumerate(self.levels):
            found = np.zeros(len(h), bool)
            found[live] = C.holds(np.frombuffer(bits, np.uint8), h[live], HASHES, log2, seed=i)
            out[live & ~found] = i % 2 == 1
            live &= found
        return out


def build_cascade(inside: DataFrame, outside: DataFrame) -> Cascade:
    """Cascade for the distinct 64-bit hashes (column h) of the listed keys (inside) and the universe's others.

    Each level is built by a distributed pass and is sized by its keys; what comes to the driver is its filter.  Levels
    alternate between the listed keys that passed so far and the others that did.  A level passes a small share of the other
    side, so the sides get smaller until no key passes wrongly.  Without listed keys one level passes nothing.
    """
    spark = inside.sparkSession
    levels: list[tuple[int, bytes]] = []
    side, other = inside, outside
    while (n := side.count()) or not levels:
        log2, seed = C.filter_log2(n, BITS_PER_KEY), len(levels)
        bits = C.build_filter(side, HASHES, log2, seed=seed)
        levels.append((log2, bits))
        shared = spark.sparkContext.broadcast(bits)
        side, other = C.materialize(other.where(C.held_by(shared, HASHES, log2, seed)("h"))), side
        shared.unpersist()
    return Cascade(levels)


def _suffixes(host: Column) -> Column:
    """The host and the domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _is_listed(cascade: Broadcast, i: int, ranges: int):
    """Pandas UDF: whether one of a row's hashes (an array) is in the i-th range and listed by its cascade."""

    @F.pandas_udf("boolean")
    def listed(keys: pd.Series) -> pd.Series:
        if not len(keys):
            return pd.Series([], dtype=bool)
        flat = np.concatenate(keys.to_list())
        sizes = np.array([len(k) for k in keys])
        ends = np.cumsum(sizes)
        mine = (flat >= -(1 << 63) + (i << 64) // ranges) & (flat <= -(1 << 63) + (i + 1 << 64) // ranges - 1)
        mine[mine] = cascade.value.listed(flat[mine])
        hits = np.concatenate([[0], np.cumsum(mine)])
        return pd.Series(hits[ends] > hits[ends - sizes])

    return listed


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, listed: DataFrame | tuple[str, ...] = ()) -> DataFrame:
    """Return page_id, host, path, rule and verdict (allow or block) for each row of pages.

    The rule's verdict holds where one fits; else a url is blocked if its host or a domain above it is
    listed (listed: hosts, or a DataFrame of one column of hosts).  Membership comes from a cascade of Bloom
    filters over all hosts of the table and the domains above them, which is exact for them, so rows meet no
    join and no shuffle.  Hosts are keyed by a 64-bit hash.  Keys that are too many for filters of bounded size are cut
    into ranges of the hash, each with its own cascade, which the rows meet one after the other.

    A null or malformed url has an empty host and path and is allowed.  Repeated rows each give a row; an empty table gives
    an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    C.prepare(spark)
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(h,) for h in listed], "host string")
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.lit(False).alias("hit"))
    universe = rows.select("host").distinct().select(F.explode(_suffixes(F.col("host"))).alias("host")).select(F.xxhash64("host").alias("h")).distinct()
    named = listed.select(F.xxhash64(C.lower_ascii(F.col(listed.columns[0]))).alias("h")).distinct()
    # The two sides are kept apart; each level's false positives come from the side that was not encoded last.
    inside = C.materialize(universe.join(named, "h", "left_semi"))
    outside = C.materialize(universe.join(named, "h", "left_anti"))
    ranges = C.n_ranges(max(inside.count(), int(PASSED * outside.count())), BITS_PER_KEY)
    keys = F.transform(_suffixes(F.col("host")), lambda h: F.xxhash64(h))
    for i in range(ranges):
        own = lambda df, i=i: df.where(C.in_range(F.col("h"), i, ranges))
        cascade = spark.sparkContext.broadcast(build_cascade(own(inside), own(outside)))
        rows = rows.withColumn("hit", F.col("hit") | _is_listed(cascade, i, ranges)(keys))
        if i + 1 < ranges:
            rows = C.materialize(rows)
            cascade.unpersist()
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url_filter over pages, with the pages' own tracking_hosts as the listed ones; odd rows as there."""
    pages = C.table(spark, sf_dir, "pages")
    return url_filter(pages, listed=tracking_hosts(pages))


_FITS = [(h + p, v, f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')") for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
SQL = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), hosts AS (
  SELECT page_id, url, translate(raw, '{C.UPPER}', '{C.LOWER}') AS host, path FROM parts
), listed AS (
  SELECT host AS l FROM hosts WHERE host <> '' GROUP BY host HAVING 100 * count(*) FILTER (regexp_matches(url, '{TRACKED}')) >= {TRACKED_PERCENT} * count(*)
), blocked AS (
  SELECT DISTINCT host AS b FROM (SELECT DISTINCT host FROM hosts) JOIN listed ON host = l OR ends_with(host, '.' || l)
)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{t}'" for t, _, f in _FITS)} END AS rule,
       CASE {" ".join(f"WHEN {f} THEN '{v}'" for _, v, f in _FITS)} WHEN b IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM hosts LEFT JOIN blocked ON host = b
"""
