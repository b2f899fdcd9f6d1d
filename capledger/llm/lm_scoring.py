"""Scoring by a hierarchical Pitman-Yor language model."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Folds (fold 0 is held out) and the base model's added count.
FOLDS, ADDED = 10, 0.1
#: Context restaurants: one for each hash class of the word before.  They share one parent, the unigram restaurant.
CONTEXTS = 1 << 16
#: Discount and strength of the context restaurants and of their parent.
LEAF, ROOT = (0.75, 2.0), (0.6, 50.0)
#: Sweeps before the first sample, and samples that are averaged.
BURN, SAMPLES, SEED = 3, 4, 1_729
#: Bytes of input for each shard of the words.
SHARD_BYTES = 16 << 20
#: Up to this many customers the number of tables of a dish is drawn exactly; beyond, from so many seatings.
EXACT, SEATINGS = 512, 8
#: Tokens of a chunk of documents, and words whose hashes a worker remembers.
CHUNK_TOKENS, REMEMBERED = 1_000_000, 400_000
#: Cells that a shard gathers at least before it adds them up, cells that are scored at a time, and bytes of an Arrow batch.
GATHERED, SLICE, BATCH_BYTES = 1 << 18, 1 << 17, 4 << 20
#: Hashes of the end of a text and of the place before it; no word has white space.
END, BEFORE = (xxhash.xxh3_64_intdigest(b" end"), xxhash.xxh3_64_intdigest(b" before"))


class _Hashes(C.Memory):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_HASHES = _Hashes()


def tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's words (A-Z lower-cased) and of its end."""
    _HASHES.claim()
    w = text.lower().split()
    a = np.empty(len(w) + 1, np.uint64)
    a[:-1] = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    a[-1] = END
    return a


def contexts(a: np.ndarray) -> np.ndarray:
    """Context class of each token: a hash of the token before."""
    before = np.empty_like(a)
    before[0] = BEFORE
    before[1:] = a[:-1]
    return (C.mix64(before) >> np.uint64(20)) % np.uint64(CONTEXTS)


# ---------------------------------------------------------------- chunks


def _chunk(docs: list[tuple], shard_bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Rows (shard, cells, uses) of a chunk of (tokens, is training) documents.

    A cell is a (word, context) pair.  cells: the steps between the shard's words in order, the cells of each, their contexts and
    training counts.  uses: the documents with tokens in the shard, how many cells each has, those cells as
    steps from one to the next, and how often each occurs.
    """
    word = np.concatenate([a for a, _ in docs])
    context = np.concatenate([contexts(a) for a, _ in docs]).astype(np.int64)
    sizes = [len(a) for a, _ in docs]
    doc = np.repeat(np.arange(len(docs)), sizes)
    training = np.repeat(np.array([t for _, t in docs], bool), sizes)
    words, word_at = np.unique(word, return_inverse=True)
    cells, cell_at = np.unique(word_at * CONTEXTS + context, return_inverse=True)
    count = np.bincount(cell_at[training], minlength=len(cells))
    shard_of = (words >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(words), np.int64)
    cell_word = cells // CONTEXTS
    uses, times = np.unique((doc << 32) | cell_at, return_counts=True)
    use_shard = shard_of[cell_word][uses & 0xFFFFFFFF]
    by_shard = np.argsort(use_shard, kind="stable")
    uses, times, use_shard = uses[by_shard], times[by_shard], use_shard[by_shard]
    shards = np.unique(shard_of)
    word_cut = np.searchsorted(shard_of, shards)
    cell_cut = np.searchsorted(cell_word, word_cut)
    use_cut = np.searchsorted(use_shard, shards)
    for i, s in enumerate(shards):
        of = lambda cut, size: slice(cut[i], cut[i + 1] if i + 1 < len(cut) else size)
        w, c, u = of(word_cut, len(words)), of(cell_cut, len(cells)), of(use_cut, len(uses))
        per_word = np.bincount(cell_word[c] - w.start, minlength=w.stop - w.start)
        use_doc = uses[u] >> 32
        use_cell = (uses[u] & 0xFFFFFFFF) - c.start
        some, first, per_doc = np.unique(use_doc, return_index=True, return_counts=True)
        step = np.diff(use_cell, prepend=0)
        step[first] = use_cell[first]
        yield int(s), C.pack(np.diff(words[w], prepend=np.uint64(0)).astype("<u8"), per_word.astype("<u2"), (cells[c] % CONTEXTS).astype("<u2"), count[c].astype("<u4")), C.pack(some.astype("<u4"), per_doc.astype("<u4"), step.astype("<u4"), times[u].astype("<u4"))


def _chunks(docs: DataFrame, id_col: str, text_col: str, folds: int, shard_bits: int) -> DataFrame:
    """Rows of chunks: for shard -1 a chunk's documents, for the others cells and uses."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() << 32) - 1
        held: list[tuple] = []
        about: list[tuple] = []
        size = 0
        id_type = pa.int64()

        def rows() -> pa.RecordBatch:
            nonlocal chunk, size
            chunk += 1
            out = list(_chunk(held, shard_bits))
            ids = pa.array([[a[0] for a in about]] + [None] * len(out), pa.list_(id_type))
            meta = [C.pack(np.array([a[1] for a in about], "?"), np.array([a[2] for a in about], "<i8"))]
            batch = pa.RecordBatch.from_arrays([pa.array([chunk] * (1 + len(out))), pa.array([-1] + [s for s, _, _ in out], pa.int32()), ids, pa.array(meta + [c for _, c, _ in out], pa.binary()), pa.array([None] + [u for _, _, u in out], pa.binary())], ["chunk", "shard", "ids", "cells", "uses"])
            held.clear()
            about.clear()
            size = 0
            return batch

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), C.texts(batch.column(2)), strict=True):
                a = tokens(text)
                held.append((a, fold != 0))
                about.append((doc_id, fold == 0, len(a)))
                size += len(a)
                if size >= CHUNK_TOKENS or len(held) == 1 << 19:
                    yield rows()
        if held:
            yield rows()
        C.release()

    return docs.select(F.col(id_col).alias("id"), C.crc_fold(F.col(id_col), folds).alias("fold"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"chunk long, shard int, ids array<{kind}>, cells binary, uses binary")


# ---------------------------------------------------------------- restaurants


@functools.lru_cache
def log_stirling(d: float, most: int) -> np.ndarray:
    """log of the generalised Stirling numbers: weight of all seatings of c customers at t tables, at [c, t]."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, t - 1], np.log(np.maximum(c - d * t, 1e-300)) + s[c, t])
    return s


class Seating:
    """Tables of the customers of one level's (restaurant, dish) cells."""

    def __init__(self, customers: np.ndarray, restaurant: np.ndarray, discount: float, strength: float):
        self.d, self.strength = discount, strength
        self.restaurant = restaurant
        self.set(customers)
        self.tables = np.minimum(customers, 1)
        self.stirling = log_stirling(discount, EXACT)

    def set(self, customers: np.ndarray) -> None:
        self.customers = customers
        some = np.flatnonzero(customers > 1)
        some = some[np.argsort(-customers[some], kind="stable")]
        large = int((customers[some] > EXACT).sum())
        self.large, self.small = some[:large], some[large:]

    def sweep(self, rng: np.random.Generator, parent: np.ndarray, tables: np.ndarray) -> None:
        """Draw each cell's tables anew, given the other cells' tables and the parent's probability of each dish.

        tables: for each restaurant its tables in all.  A cell of up to EXACT customers is drawn from its exact
        conditional, in which seatings of as many tables are summed.  For a larger one, SEATINGS seatings are
        made customer by customer and one is chosen by its weight (sampling-importance-resampling, exact in the
        limit of many seatings).
        """
        t = np.minimum(self.customers, 1)
        others = np.maximum(tables[self.restaurant] - self.tables, 0)
        i = 0
        while i < len(self.small):
            # Cells come by falling customers, so a chunk's matrix has few columns in vain.
            most = int(self.customers[self.small[i]])
            at = self.small[i : i + max(1, (1 << 20) // most)]
            i += len(at)
            c = self.customers[at]
            j = np.arange(most)
            steps = np.log((self.strength + self.d * (others[at, None] + j)) * parent[at, None])
            logs = self.stirling[c, 1 : most + 1] + np.cumsum(steps, 1)
            p = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
            t[at] = 1 + (p < rng.random((len(at), 1)) * p[:, -1:]).sum(1)
        if len(self.large):
            t[self.large] = self._seat(rng, self.customers[self.large], others[self.large], parent[self.large])
        self.tables = t

    def _seat(self, rng: np.random.Generator, customers: np.ndarray, others: np.ndarray, parent: np.ndarray) -> np.ndarray:
        c = np.repeat(customers, SEATINGS)
        o, h = np.repeat(others, SEATINGS).astype(float), np.repeat(parent, SEATINGS)
        t, weight = np.ones(len(c)), np.zeros(len(c))
        i = 1
        while i < c[0]:
            # Where many sit already, a sixty-fourth as many enter at a time.
            b = max(1, i // 64) if i >= 1024 else 1
            m = int(np.searchsorted(-c, -i, "left"))
            new = (self.strength + self.d * (o[:m] + t[:m])) * h[:m]
            all_ = new + i - self.d * t[:m]
            enter = np.minimum(b, c[:m] - i)
            t[:m] += (rng.random(m) * all_ < new) if b == 1 else rng.binomial(enter, np.minimum(new / all_, 1))
            weight[:m] += enter * np.log(all_)
            i += b
        weight = weight.reshape(-1, SEATINGS)
        p = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
        pick = (p < rng.random((len(p), 1)) * p[:, -1:]).sum(1)
        return t.reshape(-1, SEATINGS)[np.arange(len(p)), pick].astype(np.int64)


class Sampler:
    """State of a shard's Gibbs sweeps: tables of its cells and of its words at the parent.

    A cell of one customer has one table, so only cells of more are held; ones counts the others of each word.
    """

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, ones: np.ndarray, tables: np.ndarray | None = None, top: np.ndarray | None = None):
        self.word, self.ones = word, ones
        self.leaf = Seating(count, context, *LEAF)
        if tables is not None:
            self.leaf.tables = tables
        self.top = Seating(self._customers(), np.zeros(len(ones), np.int64), *ROOT)
        if top is not None:
            self.top.tables = top

    def _customers(self) -> np.ndarray:
        return self.ones + np.bincount(self.word, self.leaf.tables, len(self.ones)).astype(np.int64)

    def sums(self) -> np.ndarray:
        """Customers and tables of the words at the parent, and the tables of each context, but for those of ones."""
        return np.concatenate([[self.top.customers.sum(), self.top.tables.sum()], np.bincount(self.leaf.restaurant, self.leaf.tables, CONTEXTS)])

    def sweep(self, seed: list[int], base: float, totals: np.ndarray) -> None:
        """Draw all tables anew, given what the whole corpus held after the sweep before.

        totals: sums over all shards, with the tables of ones.
        """
        rng = np.random.default_rng(seed)
        (d0, s0), top = ROOT, self.top
        parent = (top.customers - d0 * top.tables + (s0 + d0 * totals[1]) * base) / (s0 + totals[0])
        self.leaf.sweep(rng, parent[self.word], totals[2:])
        top.set(self._customers())
        # From here on the parent's tables are of the customers that it has now.
        top.tables = np.minimum(top.tables, top.customers)
        top.sweep(rng, np.full(len(self.ones), base), totals[1:2])


class Shard:
    """The cells of a shard's words: all contexts of a word are in one shard, and so is its dish at the parent."""

    def __init__(self, cells: Iterable[bytes]):
        """cells: those of each chunk.  They are read one chunk at a time and added up as they come, so memory follows the shard's own cells."""
        self.words, self.key, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0
        for raw in cells:
            held.append(self._of_chunk(raw))
            size += len(held[-1][1])
            if size >= max(GATHERED, len(self.key) // 2):
                self._add(held)
                size = 0
        if held:
            self._add(held)
        self.word, self.context = (self.key // CONTEXTS).astype(np.int32), (self.key % CONTEXTS).astype(np.uint16)
        self.word_count = np.bincount(self.word, self.count, len(self.words)).astype(np.int64)

    @staticmethod
    def _of_chunk(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, keys (a word's number, times CONTEXTS, and the context) and counts of a chunk's cells, all in order."""
        steps, per_word, context, count = C.unpack(raw, "<u8", "<u2", "<u2", "<u4")
        return np.cumsum(steps, dtype=np.uint64), np.repeat(np.arange(len(steps)) * CONTEXTS, per_word) + context, count

    def _keys(self, words: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Keys by other words' numbers as keys by this shard's."""
        return np.searchsorted(self.words, words)[key // CONTEXTS] * CONTEXTS + key % CONTEXTS

    def _add(self, held: list[tuple]) -> None:
        """Add what is held to the shard's cells; held is empty then."""
        held.append((self.words, self.key, self.count))
        self.words = np.unique(np.concatenate([p[0] for p in held]))
        key = np.concatenate([self._keys(*p[:2]) for p in held])
        count = np.concatenate([p[2] for p in held])
        held.clear()
        # Runs that are in order by themselves, which a stable sort merges.
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.key, self.count = key[first], np.add.reduceat(count, first)

    def where(self, raw: bytes) -> np.ndarray:
        """The numbers that a chunk's cells have here."""
        return np.searchsorted(self.key, self._keys(*self._of_chunk(raw)[:2]))

    def parts(self) -> list[np.ndarray]:
        """What a Sampler is made of."""
        many = self.count > 1
        return [self.word[many].astype(np.int64), self.context[many].astype(np.int64), self.count[many], np.bincount(self.word[self.count == 1], minlength=len(self.words))]

    def head(self) -> np.ndarray:
        """Words, tokens, customers of each context."""
        return np.concatenate([[(self.word_count > 0).sum(), self.word_count.sum()], np.bincount(self.context, self.count, CONTEXTS)])

    def ones(self) -> np.ndarray:
        """Tables of cells of one customer, as they add to a Sampler's sums."""
        return np.concatenate([[0, 0], np.bincount(self.context[self.count == 1], minlength=CONTEXTS)])

    def states(self, number: int, shards: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each sample of a shard that is by itself: the tables of the cells of more customers than one, and each word's
        customers and tables at the parent.  The same call makes the same states.  Where there are others, see _sweeps."""
        sampler, ones = Sampler(*self.parts()), self.ones()
        for i in range(BURN + SAMPLES):
            sampler.sweep([SEED, number, shards, i], 1 / (self.head()[0] + 1), sampler.sums() + ones)
            if i >= BURN:
                yield sampler.leaf.tables, sampler.top.customers, sampler.top.tables

    def totals(self, number: int, shards: int) -> np.ndarray:
        """The head; then of each sample of states the parent's customers and tables, and the tables of each context."""
        many, out, ones = self.count > 1, [self.head()], self.ones()
        for tables, customers, top in self.states(number, shards):
            out.append(ones + np.concatenate([[customers.sum(), top.sum()], np.bincount(self.context[many], tables, CONTEXTS)]))
        return np.concatenate(out).astype("<f8")

    def probabilities(self, number: int, shards: int, totals: np.ndarray, states: Iterable[tuple] | None = None) -> np.ndarray:
        """Predictive probability of each cell, averaged over the samples, given the totals over all shards.

        states: those that the totals are of; without, the shard's own.  Each sample's probabilities use the totals of
        that sample, so those of a context's words, and of one unknown word, add up to one.
        """
        (d, s), (d0, s0), k = LEAF, ROOT, self.context
        head, rest = totals[: 2 + CONTEXTS], totals[2 + CONTEXTS :].reshape(SAMPLES, 2 + CONTEXTS)
        base, context_customers = 1 / (head[0] + 1), head[2:]
        mean, tables, several = np.zeros(len(self.count)), np.minimum(self.count, 1), self.count > 1
        for (many, customers, top), of in zip(self.states(number, shards) if states is None else states, rest, strict=True):
            tables[several] = many
            parent = (customers - d0 * top + (s0 + d0 * of[1]) * base) / (s0 + of[0])
            for i in range(0, len(mean), SLICE):
                at = slice(i, i + SLICE)
                mean[at] += (self.count[at] - d * tables[at] + (s + d * of[2:][k[at]]) * parent[self.word[at]]) / (s + context_customers[k[at]]) / SAMPLES
        return mean


# ---------------------------------------------------------------- shards of a table

_VECTOR = "<i8"
#: Kinds of a shard's rows, in the order in which they are read.
_CELLS, _SAMPLES, _USES = range(3)


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt by their first column, the shard, and in order of all columns but the last, the bytes."""
    return rows.repartition("shard").sortWithinPartitions(*rows.columns[:-1])


def _by_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Each shard with its rows, which are read as they are asked for."""
    rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
    return groupby(rows, itemgetter(0))


def _scores(batches: Iterable[pa.RecordBatch], shards: int, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, sums) of rows (shard, kind, chunk, raw) in order: of each document its parts of the scores.

    A shard's cells stay as bytes until their chunk's uses come, and uses are read one chunk at a time.
    """
    for number, rows in _by_shard(batches):
        kinds = groupby(rows, itemgetter(1))
        cells = {chunk: raw for _, _, chunk, raw in next(kinds)[1]}
        shard = Shard(cells.values())
        states = (C.unpack(raw, *[_VECTOR] * 3) for *_, raw in next(kinds)[1]) if shards > 1 else None
        logs = shard.probabilities(number, shards, totals, states)
        np.log10(logs, out=logs)
        base, known = np.log10(shard.word_count + ADDED), (shard.word_count > 0).astype(float)
        for _, _, chunk, raw in next(kinds)[1]:
            doc, per_doc, step, times = C.unpack(raw, "<u4", "<u4", "<u4", "<u4")
            ends = np.cumsum(per_doc, dtype=np.int64)
            at = np.cumsum(step, dtype=np.int64)
            # Steps start anew at each document.
            at -= np.repeat(np.concatenate([[0], at[ends[:-1] - 1]]), per_doc)
            cell = shard.where(cells.pop(chunk))[at]
            word = shard.word[cell]
            sums = [np.add.reduceat(v * times, ends - per_doc) for v in (logs[cell], base[word], known[word])]
            packed = C.pack(doc, *[s.astype(k) for s, k in zip(sums, ("<f4", "<f8", "<u4"), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([packed], pa.binary())], ["chunk", "sums"])
        del shard, logs, base, known
        C.release()


# ---------------------------------------------------------------- sweeps over all shards


def _added_up(rows: DataFrame, shards: int) -> np.ndarray | None:
    """Sum of the vectors of (shard, sums): added up in bundles of shards; the driver gets one for each bundle."""
    bundles = 1 << shards.bit_length() // 2

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([C.unpack(s, _VECTOR)[0] for s in pdf["sums"]], 0)
        return pd.DataFrame({"bundle": pdf["bundle"].iloc[:1], "sums": [C.pack(total)]})

    found = rows.select((F.col("shard") % bundles).alias("bundle"), "sums").groupBy("bundle").applyInPandas(add_up, "bundle int, sums binary").collect()
    return np.sum([C.unpack(r["sums"], _VECTOR)[0] for r in found], 0) if found else None


def _sweeps(dealt: DataFrame, shards: int) -> tuple[np.ndarray, DataFrame]:
    """Totals as of Shard.totals, and for each shard its samples as bytes, by sweeps that all shards make together.

    A table holds a row for each shard with its Sampler.  In a sweep each shard draws its tables given the totals over
    all shards after the sweep before; then the new ones are added up.
    """
    spark = dealt.sparkSession
    schema = "shard int, fixed binary, moving binary, samples array<binary>, sums binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _by_shard(batches):
            shard = Shard(raw for _, raw in rows)
            sampler = Sampler(*(parts := shard.parts()))
            sums = np.concatenate([shard.head(), shard.ones(), sampler.sums()])
            fixed = C.pack(*[a.astype(_VECTOR) for a in (np.diff(parts[0], prepend=0), *parts[1:])])
            moving = C.pack(*[a.astype(_VECTOR) for a in (sampler.leaf.tables, sampler.top.tables)])
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([fixed]), pa.array([moving]), pa.array([[]], pa.list_(pa.binary())), pa.array([C.pack(sums.astype(_VECTOR))])], ["shard", "fixed", "moving", "samples", "sums"])
            del shard, sampler, parts
            C.release()

    def sweep(i: int, base: float, totals: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast(totals)

        def one(number: int, fixed: bytes, moving: bytes, samples: list[bytes], _: bytes) -> dict:
            word, context, count, ones = C.unpack(fixed, *[_VECTOR] * 4)
            sampler = Sampler(np.cumsum(word), context, count, ones, *C.unpack(moving, _VECTOR, _VECTOR))
            sampler.sweep([SEED, number, shards, i], base, shared.value)
            leaf, top = sampler.leaf.tables.astype(_VECTOR), sampler.top.tables.astype(_VECTOR)
            if i >= BURN:
                samples.append(C.pack(leaf, sampler.top.customers.astype(_VECTOR), top))
            return {"shard": number, "fixed": fixed, "moving": C.pack(leaf, top), "samples": samples, "sums": C.pack(sampler.sums().astype(_VECTOR))}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for j in range(batch.num_rows):
                    yield pa.RecordBatch.from_pylist([one(*(c[j].as_py() for c in batch.columns))], batch.schema)
            C.release()

        return C.materialize(state.mapInArrow(run, schema))

    state = C.materialize(_in_order(dealt.select("shard", "cells")).mapInArrow(build, schema))
    # The cells' shuffle has done its work.
    C.tidy(spark)
    size = 2 + CONTEXTS
    head, ones, sums = np.zeros((3, size)) if (first := _added_up(state, shards)) is None else first.reshape(3, size)
    out = [head]
    for i in range(BURN + SAMPLES):
        before, state = state, sweep(i, 1 / (head[0] + 1), ones + sums)
        C.discard(before)
        sums = 0 * head if (found := _added_up(state, shards)) is None else found
        if i >= BURN:
            out.append(ones + sums)
    return np.concatenate(out).astype("<f8"), state.select("shard", "samples")


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """Return doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row.

    Tokens are a text's words (A-Z lower-cased) and one end.  The model learns from all rows outside fold 0 (crc32
    of the id as text, modulo folds).  base_score adds log10((c + 0.1) / (N + 0.1 (V + 1))) over tokens; score is
    the log10 probability of the text by a hierarchical Pitman-Yor model: a restaurant for each context (a hash
    class of the word before), one parent for all of them, and the uniform distribution over V + 1 words below.
    Tables are sampled by Gibbs sweeps, and predictive probabilities are averaged over SAMPLES sweeps.
    perplexity is 10 ** (-score / n_tokens).

    1. One pass over the texts cuts them into chunks; a chunk's (word, context) cells are counted and dealt to shards
       by the word's hash.  The counts of a word that makes a third of all tokens are CONTEXTS numbers a chunk.
    2. Each shard adds up its cells.  All shards make each sweep together: a shard draws its tables given those that the whole
       corpus had after the sweep before, and the new ones of each context are added up over all shards.
    3. Each sample's probabilities use that sample's totals, so they add up to one, and each document's part of the
       scores is added up for a chunk.
    4. A chunk's parts are added up.

    There is a shard for each SHARD_BYTES of input, so memory stays bounded as the corpus grows, and results do not depend on
    the session's settings.  How the words are dealt to shards changes the random numbers only.  A null text counts as empty: its
    end is one token.  Repeated rows each give a row, and count as often in learning; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    # A shard's rows are read one by one; batches that are small keep its whole from being held at once.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    bits = (max(1, -(-C.input_bytes(docs, text_col) // SHARD_BYTES)) - 1).bit_length()
    shards = 1 << bits
    # Not with scan: chunks are numbered by their task, and joined splits would share one.
    chunks = C.materialize(_chunks(docs, id_col, text_col, folds, bits))
    dealt = chunks.where("shard >= 0")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches):
            yield pa.RecordBatch.from_arrays([pa.array([Shard(raw for _, raw in rows).totals(0, 1).tobytes()])], ["sums"])

    rows = dealt.select("shard", F.lit(_CELLS).alias("kind"), "chunk", F.col("cells").alias("raw")).unionByName(dealt.select("shard", F.lit(_USES).alias("kind"), "chunk", F.col("uses").alias("raw")))
    if shards > 1:
        totals, samples = _sweeps(dealt, shards)
        rows = rows.unionByName(samples.select("shard", F.lit(_SAMPLES).alias("kind"), F.posexplode("samples").alias("chunk", "raw")))
    else:
        found = _in_order(dealt.select("shard", "cells")).mapInArrow(alone, "sums binary").collect()
        totals = np.frombuffer(found[0]["sums"]) if found else np.zeros((1 + SAMPLES) * (2 + CONTEXTS))
    vocabulary, train_tokens = int(totals[0]), int(totals[1])
    shared = spark.sparkContext.broadcast(totals)

    parts = _in_order(rows).mapInArrow(lambda batches: _scores(batches, shards, shared.value), "chunk long, sums binary")
    heads = chunks.where("shard < 0").select("chunk", "ids", "cells")
    n_base = np.log10(train_tokens + ADDED * (vocabulary + 1))

    def add(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        held, size = C.unpack(left.column("cells")[0].as_py(), "?", "<i8")
        sums = np.zeros((3, len(size)))
        for raw in right.column("sums").to_pylist():
            doc, *more = C.unpack(raw, "<u4", "<f4", "<f8", "<u4")
            for s, m in zip(sums, more, strict=True):
                s[doc] += m
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": size, "n_known": np.rint(sums[2]).astype(np.int64), "train_tokens": np.full(len(size), train_tokens), "base_score": sums[1] - size * n_base, "score": sums[0], "perplexity": 10 ** (-sums[0] / size)})

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return heads.groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(add, schema)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lm_score over documents: nulls, ties, repeated rows and empty tables as there."""
    return lm_score(C.table(spark, sf_dir, "documents"))
