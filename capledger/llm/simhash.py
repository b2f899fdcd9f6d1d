"""Near-copies by SimHash fingerprints: a join of all fingerprints within a Hamming distance, pruned by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .components import components

#: Words of a shingle, the seed of its hash, and the most bits by which linked fingerprints differ.
WORDS, SEED, DISTANCE = 3, 42, 3
BITS = 64
#: Reference fingerprints of a distance table.
PIVOTS = 32
#: Rows of a bucket of keys, which one task searches at a time, on average.
BUCKET_ROWS = 4096
#: Fingerprints of a key at most; those of a key with more are dealt anew by more bits.
KEY_ROWS = 8192
#: Fingerprints that share a key by chance, on average, at most.
BY_CHANCE = 16
#: Runs up to this length are compared by shifts, longer ones by blocks of so many rows.
SHIFTS, BLOCK_ROWS = 32, 64
#: Shingles that are counted at a time.
COUNTED = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bits that are set in over half of the hashes of a text's shingles; 0 without words."""
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(w))
    n = len(w) - k + 1
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, COUNTED):
        spans = zip(starts[i : min(n, i + COUNTED)].tolist(), ends[i + k - 1 : min(n, i + COUNTED) + k - 1].tolist(), strict=True)
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row, as a table."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in C.texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
        C.release()

    return C.materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(make, f"doc_id {kind}, fp long"), scan=True)


# ---------------------------------------------------------------- search within a bucket


def references(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, spread evenly by a hash of their number."""
    return C.mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distance_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances to each pivot (pivots x fingerprints)."""
    return np.stack([np.bitwise_count(fps ^ p) for p in pivots]) if len(fps) else np.zeros((len(pivots), 0), np.uint8)


def survivors(table: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose distances to no pivot differ by more than most; the others cannot be within most of one another."""
    for row in table:
        near = np.abs(row[a].astype(np.int16) - row[b]) <= most
        a, b = a[near], b[near]
        if not len(a):
            break
    return a, b


class _Forest:
    """Components of rows, each known by its smallest row."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(self.of, up := self.of[self.of]):
                self.of = up


def _search_run(fps: np.ndarray, table: np.ndarray, most: int, at: np.ndarray, found: _Forest) -> None:
    """Join the rows (at) of one long run: in order of the distance to the first pivot, a row meets those up to most further on."""
    order = at[np.argsort(table[0, at], kind="stable")]
    first = table[0, order].astype(np.int16)
    ends = np.searchsorted(first, first + most, side="right")
    for i in range(0, len(order), BLOCK_ROWS):
        block, window = order[i : i + BLOCK_ROWS], order[i : ends[min(len(order), i + BLOCK_ROWS) - 1]]
        near = np.ones((len(block), len(window)), bool)
        # The first pivots prune whole blocks of pairs, the others the pairs that are left.
        for row in table[:8]:
            near &= np.abs(row[block].astype(np.int16)[:, None] - row[window]) <= most
        x, y = np.nonzero(np.triu(near, 1))
        x, y = survivors(table[8:], block[x], window[y], most)
        same = np.bitwise_count(fps[x] ^ fps[y]) <= most
        found.join(x[same], y[same])


def search(mask: np.ndarray, fps: np.ndarray, most: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints that agree in the bits of their mask: enough of them to connect all within most bits.

    Rows of one mask and value are a run.  Pairs of a run are dropped by the greatest difference of their distances to the pivots,
    those left are compared bit by bit, and a forest keeps of their links what connects something new.
    """
    value = fps & mask
    order = np.lexsort((fps, value, mask))
    mask, value, fps = mask[order], value[order], fps[order]
    # Keys that are dealt anew can send a fingerprint to one finer key twice.
    once = np.ones(len(fps), bool)
    once[1:] = (mask[1:] != mask[:-1]) | (fps[1:] != fps[:-1])
    mask, value, fps = mask[once], value[once], fps[once]
    new = np.ones(len(fps), bool)
    new[1:] = (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])
    # Rows alone with their key are left out before the distances are taken.
    alone = new & np.append(new[1:], True)
    fps, new = fps[~alone], new[~alone]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fps)))
    table, found = distance_table(fps, pivots), _Forest(len(fps))
    size_at = np.repeat(sizes, sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)
    short = np.flatnonzero(size_at <= SHIFTS)
    for shift in range(1, int(size_at[short].max(initial=1))):
        a = short[short + shift < len(fps)]
        a = a[run[a] == run[a + shift]]
        a, b = survivors(table, a, a + shift, most)
        same = np.bitwise_count(fps[a] ^ fps[b]) <= most
        found.join(a[same], b[same])
    for start, size in zip(starts[sizes > SHIFTS].tolist(), sizes[sizes > SHIFTS].tolist(), strict=True):
        _search_run(fps, table, most, np.arange(start, start + size), found)
    linked = found.of != np.arange(len(fps))
    return fps[linked], fps[found.of[linked]]


# ---------------------------------------------------------------- dealing fingerprints to tasks


def key_masks(fixed: int, chosen: int, most: int = DISTANCE) -> list[int]:
    """Masks that add chosen of chosen + most segments of the other bits to fixed.

    Fingerprints that agree in fixed and differ in most bits or fewer agree in at least chosen segments, so
    in one of the masks.  Where fewer bits than segments are left, they agree in all that any mask adds or are told apart by none.
    """
    bits = [b for b in range(BITS) if not fixed >> b & 1]
    segments = [sum(1 << int(b) for b in part) for part in np.array_split(bits, chosen + most) if len(part)]
    if len(segments) < chosen + most:
        return [fixed]
    return [fixed | sum(some) for some in combinations(segments, chosen)]


def segments_chosen(n: int, most: int = DISTANCE) -> int:
    """How many segments make a key, so that n even fingerprints share keys with BY_CHANCE others or fewer; most at most."""
    return next((r for r in range(1, most) if n / 2 ** (BITS * r / (r + most)) <= BY_CHANCE), max(1, most))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, most: int = DISTANCE, key_rows: int = KEY_ROWS, n_pivots: int = PIVOTS) -> DataFrame:
    """Pairs a, b of the column fp of distinct (no fingerprint twice) that connect all those within most bits of one another.

    Each fingerprint goes to a key for each mask.  Keys are counted first; fingerprints of a key with more than key_rows are
    dealt anew by masks with more bits, round by round, until their keys are small: masks of a round leave half the other bits, and
    so few bits have no more values than key_rows.  So no task holds more than a bucket of small keys, and no pair
    leaves a task but the links that connect something new.
    """
    spark = distinct.sparkSession
    pivots = references(n_pivots)
    keyed, n, masks, chosen, out = distinct.select("fp", F.lit(0).cast("long").alias("mask")), distinct.count(), [0], segments_chosen(distinct.count(), most), None

    def pairs(t: pa.Table) -> pa.Table:
        a, b = search(*(t[c].to_numpy().view(np.uint64) for c in ("mask", "fp")), most, pivots)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    while True:
        # At most as many masks as the rounds make of 64 bits, whatever the table: 20 in the first round, 20 for each of them in the next.
        finer = {m: key_masks(m, chosen, most) for m in masks}
        of = spark.createDataFrame([(_signed(m), [_signed(x) for x in more]) for m, more in finer.items()], "mask long, more array<long>")
        dealt = keyed.join(F.broadcast(of), "mask").select("fp", F.explode("more").alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        hot = C.materialize(dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > key_rows).select("mask", "value"))
        again = any(m != more[0] for m, more in finer.items()) and not hot.isEmpty()
        cold = dealt.join(hot, ["mask", "value"], "left_anti") if again else dealt
        buckets = max(1, -(-n * max(map(len, finer.values())) // BUCKET_ROWS))
        found = cold.groupBy(F.pmod(F.xxhash64("mask", "value"), F.lit(buckets)).alias("bucket")).applyInArrow(pairs, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if not again:
            return out
        masks = [m & (1 << 64) - 1 for (m,) in hot.select("mask").distinct().collect()]
        keyed = C.materialize(dealt.join(hot, ["mask", "value"], "left_semi").select("fp", "mask"))
        chosen, n = max(1, most), keyed.count()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most: int = DISTANCE) -> DataFrame:
    """Return doc_id, fingerprint (16 hex digits) and component_id for each row of docs.

    The fingerprint of an A-Z lower-cased text has the bits that are set in over half of its shingles' hashes (XXH64,
    shingles of words words, repeats included).  A text of fewer words is one shingle; one without words, empty or
    null, has fingerprint zero, which links like any other.  Fingerprints link at most or fewer differing bits;
    component_id is the smallest id that links reach, null ids aside; a row that reaches null ids only has null.
    Repeated rows each give a row; an empty table gives an empty result; other columns are not read.

    Rows are pre-aggregated to distinct fingerprints; only these are joined, so copies make no pairs.  Fingerprints of
    many rows meet their component by broadcast (join_skewed).
    """
    C.prepare(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col, words)
    distinct = C.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    linked = components(links(distinct, most)).withColumnRenamed("node", "fp")
    met = C.materialize(distinct.join(linked, "fp", "left"))
    best = C.materialize(met.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps")))
    joined = C.join_skewed(met.where("component is not null"), best, "component", F.col("fps"), max(1, rows.count()))
    facts = met.where("component is null").select("fp", F.col("least").alias("component_id"), "rows").unionByName(joined.select("fp", "component_id", "rows"))
    out = C.join_skewed(rows, C.materialize(facts), "fp", F.col("rows"), max(1, rows.count()))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_components over documents: nulls, ties, repeated rows and empty tables as there."""
    return simhash_components(C.table(spark, sf_dir, "documents"))
