"""Importance resampling towards a target distribution: weights from hashed word counts, a weighted draw without replacement."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Words of a feature at most, and buckets of features.
NGRAM, BUCKETS = 1, 10_000
#: Least words of a document that may be drawn, the share drawn in per cent, and the seed.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Rows of a sorted run at most, of a range that is merged by one task on average, and the least of such a range.
RUN_ROWS, RANGE_ROWS, LEAST_RANGE = 100_000, 100_000, 500
#: Keys of a range that its bounds are estimated from, on average.
SAMPLED = 16
#: Runs that one tournament merges; more runs make a tree of tournaments.
FAN_IN = 64
#: Words whose codes a worker remembers.
REMEMBERED = 200_000
#: ASCII that is no letter or digit ends a word; everything else belongs to one.
_ENDS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
SCORED = "doc_id, n_words, n_features, weight, score, tie"


class _Codes(C.Memory):
    def __missing__(self, word: bytes) -> int:
        code = zlib.crc32(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = code
        return code


_CODES = _Codes()


def features(text: bytes, ngram: int = NGRAM, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """A text's number of words, and the buckets of its runs of up to ngram words, repeats included."""
    _CODES.claim()
    words = text.lower().translate(_ENDS).split(b" ")
    words = [w for w in words if w]
    codes = [np.fromiter(map(_CODES.__getitem__, words), np.int64, len(words))]
    for k in range(2, ngram + 1):
        codes.append(np.array([zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)], np.int64))
    return len(words), np.concatenate(codes) % buckets


def bucket_counts(docs: DataFrame, text_col: str, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task adds up its own, buckets come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in C.texts(batch.column(0)):
                own += np.bincount(features(text, ngram, buckets)[1], minlength=buckets)
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(own[some])], ["bucket", "n"])
        C.release()

    rows = docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over that in the source, one added to each, floored."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate that the id and the seed decide, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _weigh(docs: DataFrame, id_col: str, text_col: str, gains: np.ndarray, ngram: int, seed: int) -> DataFrame:
    """n_words, n_features, weight, score and a number (tie) of each row, as a table."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    kind = docs.schema[id_col].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            words, sizes, weights = [], [], []
            for text in C.texts(batch.column(1)):
                n, at = features(text, ngram, len(own))
                words.append(n)
                sizes.append(len(at))
                weights.append(int(own[at].sum()) // len(at) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, sizes, weights))], ["doc_id", "n_words", "n_features", "weight"])
        C.release()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    rows = rows.select("*", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("tie"))
    return C.materialize(rows, scan=True)


# ---------------------------------------------------------------- the draw


def _keys(t: pa.Table | pa.RecordBatch) -> list[tuple]:
    """The order of the draw: highest scores, smallest ids (null first); weight, size and number settle what is left."""
    return [(-s, i is not None, 0 if i is None else i, w, n, x) for s, i, w, n, x in zip(*(t.column(c).to_pylist() for c in ("score", "doc_id", "weight", "n_features", "tie")), strict=True)]


class Tournament:
    """Merge of sorted runs: each inner node keeps the loser of its match, so the next winner replays one path to the root."""

    _LAST = (math.inf,)

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(run, self._LAST) for run in runs]
        k = len(runs)
        self.losers = [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self.heads[b] < self.heads[a]:
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.winner = winners[1] if k > 1 else 0

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and self.heads[self.winner] != self._LAST:
            yield self.heads[self.winner]
            now = self.winner
            self.heads[now] = next(self.runs[now], self._LAST)
            node = (now + k) // 2
            while node:
                if self.heads[self.losers[node]] < self.heads[now]:
                    now, self.losers[node] = self.losers[node], now
                node //= 2
            self.winner = now


def merged(runs: list[Iterator[tuple]], fan_in: int = FAN_IN) -> Iterator[tuple]:
    """All runs in one order, by a tree of tournaments of at most fan_in runs each; nothing is taken before it is asked for."""
    while len(runs) > fan_in:
        runs = [iter(Tournament(runs[i : i + fan_in])) for i in range(0, len(runs), fan_in)]
    return iter(Tournament(runs))


def _runs(rows: DataFrame, bounds: list[tuple], run_rows: int) -> DataFrame:
    """Sorted runs of each partition, as a table: rows with the range of the whole order (cut by bounds), run, and place in it."""
    kind = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = TaskContext.get().partitionId() << 32

        def run() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = _keys(t)
            order = sorted(range(len(keys)), key=keys.__getitem__)
            ranges, r = [], 0
            for i in order:
                while r < len(bounds) and bounds[r] <= keys[i]:
                    r += 1
                ranges.append(r)
            t = t.take(pa.array(order)).append_column("range", pa.array(ranges, pa.int32())).append_column("run", pa.array([number] * len(order), pa.int64()))
            return t.append_column("place", pa.array(range(len(order)), pa.int32())).to_batches()[0]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= run_rows:
                yield run()
                held.clear()
                number += 1
        if held:
            yield run()

    return C.materialize(rows.mapInArrow(sort, f"{kind}, range int, run long, place int"))


def draw(scored: DataFrame, draws: int, n_ranges: int | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """scored (doc_id, n_features, weight, score, tie, and eligible) with rank: 1, 2, 3, ... for the draws first in order, else null.

    A count of rows for each score, which is an integer, tells from which score rows can be drawn; no other row is
    sorted or shuffled.  Each partition sorts its own into runs, cut at common bounds.  The runs are a table, and a
    task for each range merges its parts of all runs by tournaments, beginning with the rank that the ranges before
    it end with, and stops at the last draw.  Bounds come from a sample of keys and only balance the ranges.
    """
    spark = scored.sparkSession
    none = F.lit(None).cast("long").alias("rank")
    names = ["doc_id", "n_features", "weight", "score"]
    rest, cut, n = draws, None, 0
    if draws > 0:
        # One row for each integer from the least to the greatest score, whatever the number of rows.
        for score, rows in scored.where("eligible").groupBy("score").agg(F.count(F.lit(1))).orderBy(F.desc("score")).collect():
            cut, rest, n = score, rest - rows, n + rows
            if rest <= 0:
                break
    if cut is None:
        return scored.select(*names, none)
    above = F.col("eligible") & (F.col("score") >= cut)
    some = scored.where(above).select(*names, "tie")
    if n_ranges is None:
        n_ranges = max(1, -(-n // RANGE_ROWS), min(4 * spark.sparkContext.defaultParallelism, n // LEAST_RANGE))
    bounds: list[tuple] = []
    if n_ranges > 1:
        keys = sorted(_keys(some.sample(min(1.0, SAMPLED * n_ranges / n), seed=SEED).toArrow()))
        bounds = keys[:: max(1, len(keys) // n_ranges)][1:]
    runs = _runs(some, bounds, run_rows)
    before, first = {}, 0
    for r, rows in runs.groupBy("range").agg(F.count(F.lit(1))).orderBy("range").collect():
        before[r], first = first, first + rows

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by([("run", "ascending"), ("place", "ascending")])
        starts = np.flatnonzero(np.diff(t["run"].to_numpy(), prepend=-1))
        keys = [(*key, i) for i, key in enumerate(_keys(t))]
        parts = [iter(keys[a:b]) for a, b in zip(starts, np.append(starts, len(keys))[1:], strict=True)]
        ranks: list[int | None] = [None] * len(keys)
        rank = before[t["range"][0].as_py()]
        if rank < draws:
            for rank, key in enumerate(merged(parts), rank + 1):
                ranks[key[-1]] = rank
                if rank == draws:
                    break
        return t.select(names).append_column("rank", pa.array(ranks, pa.int64()))

    kind = scored.schema["doc_id"].dataType.simpleString()
    ranked = runs.groupBy("range").applyInArrow(merge, f"doc_id {kind}, n_features long, weight long, score long, rank long")
    return ranked.unionByName(scored.where(~above).select(*names, none))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Return doc_id, n_features, weight, score and rank for each row of docs.

    Features are the runs of up to ngram words of A-Z lower-cased texts, hashed to buckets.  A bucket's gain is the
    logarithm (in thousandths, floored) of its share among the target's features over that among docs'; a weight is
    the floored mean of a document's gains.  The score adds a Gumbel variate that id and seed decide, so the highest scores
    are a draw without replacement by weight.  Of the documents with least_words words, percent are drawn.

    A null or empty text has no words: weight 0, never drawn.  Ties go to the smaller id, a null id before all others;
    rows of one id and score by weight, then number of features.  Repeated rows each count and have a rank of their own.  Without targets
    every bucket has its one.  An empty table gives an empty result.  Columns not named are not read.
    """
    C.prepare(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, text_col, ngram, buckets), bucket_counts(target, target_col, ngram, buckets))
    scored = _weigh(docs, id_col, text_col, gains, ngram, seed).withColumn("eligible", F.col("n_words") >= least_words)
    return draw(scored, scored.where("eligible").count() * percent // 100)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resample of documents towards benchmark: nulls, ties, repeated rows and empty tables as there."""
    return resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


_WORDS = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{C.UPPER}', '{C.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, {_WORDS("text")} AS words FROM documents
), s_words AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM d) GROUP BY word
), t_words AS (
  SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS("text")}) AS word FROM benchmark) GROUP BY word
), codes AS (
  SELECT word, {C.sql_crc32("word")} % {BUCKETS} AS bucket
  FROM (SELECT word FROM s_words UNION SELECT word FROM t_words), (SELECT {C.SQL_CRC_TABLE} AS crc_table)
), counts AS (
  SELECT bucket, coalesce(sum(s.n), 0) AS s, coalesce(sum(t.n), 0) AS t
  FROM codes LEFT JOIN s_words s USING (word) LEFT JOIN t_words t USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM counts
), w AS (
  SELECT row, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM (SELECT row, unnest(words) AS word FROM d) JOIN codes USING (word) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (row)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= (SELECT count(*) FROM scored WHERE n_features >= {LEAST_WORDS}) * {PERCENT} // 100 THEN place END AS rank
FROM placed
"""
