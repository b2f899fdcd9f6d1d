"""N-gram Jaccard join through prefix trees."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as C
from .components import components

#: Words of a shingle, and the similarity from which two documents link, in per cent.
WORDS, PERCENT = 3, 90
#: Shingles of a chunk of documents, and bytes of input for each shard of shingles that is counted at a time.
CHUNK_SHINGLES, SHARD_BYTES = 400_000, 16 << 20
#: Shingles of a shard that are added up at a time.
RANGE_SHINGLES = 400_000
#: Shared prefix elements by which a set goes to trees in the first round.
HOMES = 3
#: Shingles of the sets that one tree holds, on average.
BLOCK_SHINGLES = 1_000_000
#: Columns of a digest of a token's sets.
MEMBERS = ("members_a", "members_b")
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
#: Bits of a shingle's hash in a tree; the bits above them are its frequency's.
HASH_BITS = 48


class _Hashes(C.Memory):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_HASHES = _Hashes()
_K = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words are one shingle, none is none."""
    _HASHES.claim()
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = C.mix64(h * _K + a[i : len(w) - n + 1 + i])
    return np.unique(h)


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def prefix_length(n: int, percent: int) -> int:
    """Elements of a set of n, rarest first, of which it shares one with each set that links to it.

    A linked set has at least percent of the n in common with it; were none of the first n - that + 1 among them, the
    rest would be too few.  This holds in any order that is the same for all sets.
    """
    return n - -(-n * percent // 100) + 1


# ---------------------------------------------------------------- the tree


class PrefixTree:
    """A compressed trie of sets, each as its elements in the one global order, most frequent first.

    Sets are given as falling codes: an element's code is its frequency class above its hash, so that the order of
    codes is the global order.  They must be distinct.  Nodes are numbered level by level, so a node's children, and
    their elements, stand in a row.  For each node: the elements of its edge are flat[start:end] (as numbers of
    the tree's vocabulary), depth the elements down to its end, last the code of the last of them, least and most the
    sizes of the sets below, lo:hi those sets in the tree's order, and leaf the set that ends there, or -1.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        #: order[k] is the number of the k-th set of the tree.
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        sets = [sets[i] for i in self.order]
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        vocabulary, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = np.split(at.astype(np.int32), np.cumsum(self.sizes)[:-1])
        self.has = np.zeros(len(vocabulary), np.int32)
        depth, lo, hi, parent, leaf = [0], [0], [len(sets)], [-1], [-1]
        path = [0]

        def node(*of: int) -> int:
            for column, v in zip((depth, lo, hi, parent, leaf), of, strict=True):
                column.append(v)
            return len(depth) - 1

        for k, mine in enumerate(self.at):
            shared = 0
            if k:
                m = min(len(mine), len(self.at[k - 1]))
                off = np.flatnonzero(mine[:m] != self.at[k - 1][:m])
                shared = int(off[0]) if len(off) else m
            while depth[path[-1]] > shared:
                done = path.pop()
                hi[done] = k
                if depth[path[-1]] < shared:
                    # The common prefix ends inside the edge: a node there gets the closed one as its child.
                    path.append(node(shared, lo[done], -1, path[-1], -1))
                parent[done] = path[-1]
            path.append(node(len(mine), k, -1, path[-1], k))
        for v in path[1:]:
            hi[v] = len(sets)
        self._layout(np.array(depth), np.array(lo), np.array(hi), np.array(parent), np.array(leaf))

    def _layout(self, depth, lo, hi, parent, leaf) -> None:
        n = len(depth)
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            children[parent[i]].append(i)
        order = [0]
        first, end_ = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(n):
            first[k] = len(order)
            order += sorted(children[order[k]], key=lo.__getitem__)
            end_[k] = len(order)
        up = depth[parent[order]]
        up[0] = 0
        order = np.array(order)
        self.first, self.stop = first, end_
        self.depth, self.lo, self.hi, self.leaf = depth[order], lo[order], hi[order], leaf[order]
        self.start = np.concatenate([[0], np.cumsum(self.depth - up)])
        self.flat = np.concatenate([self.at[a][b:c] for a, b, c in zip(self.lo, up, self.depth, strict=True)])
        self.last = np.array([self.sets[a][c - 1] if c else np.iinfo(np.uint64).max for a, c in zip(self.lo, self.depth, strict=True)], np.uint64)
        self.least = np.array([self.sizes[a:b].min() for a, b in zip(self.lo, self.hi, strict=True)])
        self.most = np.array([self.sizes[a:b].max() for a, b in zip(self.lo, self.hi, strict=True)])

    def connect(self, label: np.ndarray) -> tuple[list[tuple[int, int]], int]:
        """Links (in numbers of sets) that join what label (a number for each set) had apart; and the nodes visited.

        A subtree is left out when all its sets are joined with the walking one already.
        """
        links, visited = [], 0
        label = label[self.order]
        self.change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        for k in range(len(self.sets)):
            if self.change[-1] == 0:
                break
            for hits, nodes in self._walk(k, label):
                visited += nodes
                for hit in hits.tolist():
                    if label[hit] != label[k]:
                        links.append((self.order[k], self.order[hit]))
                        label[label == label[hit]] = label[k]
                        self.change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        return links, visited

    def links(self) -> list[tuple[int, int]]:
        """All links, each once, in numbers of sets."""
        return [(self.order[k], self.order[hit]) for k in range(len(self.sets)) for hits, _ in self._walk(k) for hit in hits.tolist() if hit > k]

    def _walk(self, k: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int]]:
        """The k-th set walks down the tree: the sets that it meets and links to, and the nodes looked at, step by step.

        All children of a node are looked at together.  The overlap down to a node is its parent's and that of its own edge, so
        sets that share a prefix share the work.  A subtree is left when none of its sets can reach the similarity: by
        their sizes, with all that is left of the largest of them, or with all that is left of the walking set for the
        smallest.
        """
        percent, n, codes = self.percent, len(self.sets[k]), self.sets[k][::-1]
        walk = [(0, 0)]
        while walk:
            v, overlap = walk.pop()
            a, b = self.first[v], self.stop[v]
            if a == b or (label is not None and self.change[self.hi[v] - 1] == self.change[self.lo[v]] and label[self.lo[v]] == label[k]):
                continue
            of = slice(a, b)
            depth, most, least = self.depth[of], self.most[of], self.least[of]
            self.has[self.at[k]] = 1
            edge = self.has[self.flat[self.start[a] : self.start[b]]]
            self.has[self.at[k]] = 0
            both = overlap + np.add.reduceat(edge, self.start[of] - self.start[a])
            left = np.searchsorted(codes, self.last[of])
            ok = (most * 100 >= n * percent) & (least * percent <= n * 100)
            ok &= (both + most - depth) * (100 + percent) >= percent * (n + most)
            ok &= (both + left) * (100 + percent) >= percent * (n + least)
            hits = self.leaf[of]
            yield hits[(hits >= 0) & ok & (both * (100 + percent) >= percent * (n + depth))], b - a
            walk += [(a + i, both[i]) for i in np.flatnonzero(ok).tolist()]


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links of each number with the least that links reach from it, in place of links that reach the same."""
    up: dict[int, int] = {}

    def least(i: int) -> int:
        while (j := up.setdefault(i, i)) != i:
            up[i], i = up[j], up[j]
        return i

    for a, b in links:
        a, b = least(a), least(b)
        up[max(a, b)] = min(a, b)
    return [(i, least(i)) for i in sorted(up) if least(i) != i]


def _pack_codes(codes: np.ndarray) -> bytes:
    """Codes as seven bytes each."""
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack_codes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8").astype(np.uint64)


# ---------------------------------------------------------------- frequencies


def _chunks(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int) -> DataFrame:
    """Rows of chunks of documents.

    Shard -1: ids, set sizes and set ids of a chunk's documents, the distinct sets' ids, and for each (shingle, set) of
    the chunk in order of the shingle, the set.  Other shards: the chunk's shingles with such first bits (as
    steps from one to the next), and in how many of the chunk's sets each is.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}
        about: list[tuple] = []
        size = 0
        id_type = pa.int64()

        def rows() -> pa.RecordBatch:
            # A random number: a task may run this for several splits, which it joined.
            chunk = int.from_bytes(os.urandom(8), "little") >> 1
            every = list(sets.values()) or [np.zeros(0, np.uint64)]
            value = np.concatenate(every)
            order = np.argsort(value, kind="stable")
            value, of = value[order], np.repeat(np.arange(len(every)), [len(s) for s in every])[order]
            first = np.flatnonzero(np.concatenate([[len(value) > 0], value[1:] != value[:-1]]))
            distinct, count = value[first], np.diff(np.append(first, len(value)))
            cut = np.searchsorted(distinct >> np.uint64(HASH_BITS - bits), np.arange((1 << bits) + 1))
            some = np.flatnonzero(np.diff(cut)).tolist()
            parts = [C.pack(np.diff(distinct[cut[s] : cut[s + 1]], prepend=np.uint64(0)).astype("<u8"), count[cut[s] : cut[s + 1]].astype("<u4")) for s in some]
            more = [None] * len(some)
            ids, ns, sids = (list(c) for c in zip(*about, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk] * (1 + len(some))), pa.array([-1, *some], pa.int32()), pa.array([ids, *more], pa.list_(id_type)), pa.array([ns, *more], pa.list_(pa.int64())), pa.array([sids, *more], pa.list_(pa.binary())), pa.array([list(sets), *more], pa.list_(pa.binary())), pa.array([C.pack(of.astype("<u4")), *parts], pa.binary())],
                ["chunk", "shard", "ids", "ns", "sids", "sets", "part"],
            )

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), C.texts(batch.column(1)), strict=True):
                s = shingles(text, words)
                sid = set_id(s)
                about.append((doc_id, len(s), sid))
                # Equal sets of a chunk are one.
                if len(s) and sid not in sets:
                    sets[sid] = np.unique(s >> np.uint64(64 - HASH_BITS))
                    size += len(s)
                if size >= CHUNK_SHINGLES or len(about) == 1 << 17:
                    yield rows()
                    sets.clear(), about.clear()
                    size = 0
        if about:
            yield rows()
        sets.clear(), about.clear()
        C.release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"chunk long, shard int, ids array<{kind}>, ns array<long>, sids array<binary>, sets array<binary>, part binary")


def _frequency(pdf: pd.DataFrame) -> pd.DataFrame:
    """The frequency classes of a shard's shingles, for each chunk in the order of its own.

    The shard is added up range by range of the hash, about RANGE_SHINGLES at a time, so that little is held beside it.
    """
    parts = [C.unpack(raw, "<u8", "<u4") for raw in pdf["part"]]
    values = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    levels = [np.zeros(len(v), np.uint8) for v in values]
    least, most = min(int(v[0]) for v in values), max(int(v[-1]) for v in values)
    ranges = -(-sum(map(len, values)) // RANGE_SHINGLES)
    begins = [0] * len(values)
    for r in range(1, ranges + 1):
        ends = [int(np.searchsorted(v, np.uint64(least + (most - least) * r // ranges), "right")) for v in values]
        some = [(k, slice(b, e)) for k, (b, e) in enumerate(zip(begins, ends, strict=True)) if e > b]
        begins = ends
        if some:
            distinct, at = np.unique(np.concatenate([values[k][of] for k, of in some]), return_inverse=True)
            n = np.bincount(at, np.concatenate([parts[k][1][of] for k, of in some]), len(distinct))
            level = np.floor(np.log2(n)).astype(np.uint8)[at]
            for (k, of), v in zip(some, np.split(level, np.cumsum([of.stop - of.start for _, of in some])[:-1]), strict=True):
                levels[k][of] = v
    out = pd.DataFrame({"chunk": pdf["chunk"], "shard": pdf["shard"], "level": [C.pack(v) for v in levels]})
    del parts, values, levels
    C.release()
    return out


def _candidates(percent: int):
    """For a chunk's rows and levels, the sets that may link: sid, n, lone, their tokens and codes.

    tokens: the elements of the prefix, rarest first, that more sets than one have; the lone ones stand before them.
    codes: all elements, most frequent first.  A set without such tokens links with nothing.
    """

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        shard = left.column("shard").to_numpy()
        parts = dict(zip(shard.tolist(), left.column("part").to_pylist(), strict=True))
        sets = left.column("sets")[int(np.flatnonzero(shard < 0)[0])].as_py()
        (of,) = C.unpack(parts.pop(-1), "<u4")
        levels = dict(zip(right.column("shard").to_pylist(), right.column("level").to_pylist(), strict=True))
        codes, count = [], []
        for s in sorted(parts):
            step, n = C.unpack(parts[s], "<u8", "<u4")
            (level,) = C.unpack(levels[s], "u1")
            codes.append(np.cumsum(step, dtype=np.uint64) | level.astype(np.uint64) << np.uint64(HASH_BITS))
            count.append(n)
        out: list[tuple] = []
        if codes:
            code = np.repeat(np.concatenate(codes), np.concatenate(count))
            order = np.lexsort((code, of))
            for sid, mine in zip(sets, np.split(code[order], np.cumsum(np.bincount(of, minlength=len(sets)))[:-1]), strict=True):
                prefix = mine[: prefix_length(len(mine), percent)]
                tokens = prefix[prefix >> np.uint64(HASH_BITS) > 0]
                if len(tokens):
                    out.append((sid, len(mine), len(prefix) - len(tokens), tokens.view(np.int64), _pack_codes(mine[::-1])))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("sid", "n", "lone", "tokens", "codes"), columns, kinds, strict=True)})

    return run


# ---------------------------------------------------------------- the join


def _trees(rows: DataFrame, percent: int, all_links: bool = False) -> DataFrame:
    """Sets (a) and the least (b) that they reach by the links which trees find: a tree for each (token, i, j) of rows.

    With all_links, all pairs that link.  Rows have sid, label and codes; trees link only what their labels have apart.  Rows come sorted by tree, and a task holds one tree's at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, bytes]] = {}
        links: list[tuple[bytes, bytes]] = []
        tree = None

        def close() -> None:
            if len({label for label, _ in held.values()}) > 1:
                sids = sorted(held)
                label = np.unique([held[s][0] for s in sids], return_inverse=True)[1]
                tree_ = PrefixTree([_unpack_codes(held[s][1]) for s in sids], percent)
                links.extend((sids[max(x)], sids[min(x)]) for x in (tree_.links() if all_links else stars(tree_.connect(label)[0])))
            held.clear()

        def batch_of() -> pa.RecordBatch:
            a, b = zip(*links, strict=True) if links else ((), ())
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            for token, i, j, sid, label, codes in zip(*[batch.column(c).to_pylist() for c in range(6)], strict=True):
                if (token, i, j) != tree:
                    close()
                    tree = token, i, j
                held[sid] = label, codes
            if len(links) > 10_000:
                yield batch_of()
        close()
        yield batch_of()
        C.release()

    tree = ["token", "i", "j"]
    return rows.select(*tree, "sid", "label", "codes").repartition(*tree).sortWithinPartitions(*tree).mapInArrow(join, "a binary, b binary")


def _block(blocks: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("sid", F.lit(salt)), blocks).cast("int")


def _members() -> list[Column]:
    """A digest of 128 bits, in two columns, of which sets a group has."""
    return [F.bit_xor(F.xxhash64("sid", F.lit(salt))).alias(m) for salt, m in enumerate(MEMBERS)]


def _once(tokens: DataFrame) -> DataFrame:
    """Of tokens that the same sets have, which would make equal trees, only one."""
    rest = [c for c in tokens.columns if c not in MEMBERS and c != "sets"]
    return tokens.groupBy("sets", *MEMBERS).agg(F.min_by(F.struct(*rest), "token").alias("x")).select("sets", "x.*")


def _first_round(shared: DataFrame) -> DataFrame:
    """(token, i, j, sid): each set goes to the trees of its HOMES rarest shared tokens.

    Too many sets for one tree are dealt to several, with another tree over a part of each, which joins what they find.
    """
    rank = F.row_number().over(W.partitionBy("sid").orderBy("token"))
    homes = shared.withColumn("rank", rank).where(F.col("rank") <= HOMES)
    blocks = homes.groupBy("token").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.count(F.lit(1)).alias("sets"), *_members())
    dealt = homes.join(_once(blocks.where("sets > 1")), "token")
    places = F.array(_block(F.col("blocks"), 1), F.when((F.col("blocks") > 1) & (_block(F.col("blocks"), 2) == 0), F.lit(-1)))
    return dealt.select("token", F.explode(F.array_compact(places)).alias("i"), F.lit(0).alias("j"), "sid")


def _last_round(shared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(token, i, j, sid, label): all sets of each token whose sets are not all joined yet.

    A pair has to meet at one token only, its first.  There they have no more in common than the rest of either, so
    a token keeps the sets whose rest is enough for a link with the smallest of its sets that may link.
    Of a token, the sets of the label with most shingles need to meet only the others.  Where they are too many for
    one tree, they are dealt to rows of a grid and the others to columns; a tree holds a row's and a column's sets,
    and others of two columns meet in a tree of their own.
    """
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    enough = shared.join(shared.groupBy("token").agg(F.min("n").alias("least")), "token").where(F.col("rest") * (100 + percent) >= (F.col("n") + smallest) * percent)
    labelled = enough.join(labels, "sid", "left").select("sid", "n", "token", F.xxhash64(F.coalesce("component", "sid")).alias("label"))
    sizes = labelled.groupBy("token", "label").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("sets"), *_members())
    tokens = sizes.groupBy("token").agg(F.max(F.struct("size", "label")).alias("most"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("labels"), F.sum("sets").alias("sets"), *[F.bit_xor(m).alias(m) for m in MEMBERS]).where("labels > 1")
    tokens = _once(tokens).select("token", F.col("most.label").alias("main"), F.greatest(F.lit(1), F.ceil(F.col("most.size") / BLOCK_SHINGLES)).cast("int").alias("rows"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most.size")) / BLOCK_SHINGLES)).cast("int").alias("columns"))
    met = labelled.join(tokens, "token")
    spot = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own_row, own_column = _block(F.col("rows"), 1), _block(F.col("columns"), 1)
    of_main = F.transform(upto(F.col("columns")), lambda j: spot(own_row, j))
    of_others = F.transform(upto(F.col("rows")), lambda i: spot(i, own_column))
    # Trees of two columns have numbers below 0.
    pairs = F.transform(F.filter(upto(F.col("columns")), lambda j: j != own_column), lambda j: spot(-1 - F.least(j, own_column), F.greatest(j, own_column)))
    return met.select("token", F.explode(F.when(F.col("label") == F.col("main"), of_main).otherwise(F.concat(of_others, pairs))).alias("at"), "sid", "label").select("token", "at.i", "at.j", "sid", "label")


def _prefixes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, sid); sid, n, token of each set and prefix element that it shares, and rest, the elements from there on; those sets' codes."""
    C.prepare(docs.sparkSession)
    if not 0 < percent <= 100 or words < 1:
        raise ValueError("percent must be above 0 and at most 100, and words at least 1")
    bits = max(1, -(-C.input_bytes(docs, text_col) // SHARD_BYTES)).bit_length() + 1
    chunks = C.materialize(_chunks(docs, id_col, text_col, words, bits), scan=True)
    heads = chunks.where("shard < 0")
    rows = C.materialize(heads.select(F.explode(F.arrays_zip("ids", "ns", "sids")).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.ns").alias("n"), F.col("x.sids").alias("sid")))
    levels = C.materialize(chunks.where("shard >= 0").select("chunk", "shard", "part").groupBy("shard").applyInPandas(_frequency, "chunk long, shard int, level binary"))
    found = chunks.select("chunk", "shard", "sets", "part").groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(_candidates(percent), "sid binary, n long, lone long, tokens array<long>, codes binary")
    # A set of several chunks is the same in all of them.
    sets = C.materialize(found.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "lone", "tokens", "codes")]))
    C.discard(chunks, levels)
    del chunks, heads, levels, found
    C.tidy(docs.sparkSession)
    each = sets.select("sid", "n", "lone", F.posexplode("tokens").alias("at", "token")).select("sid", "n", (F.col("n") - F.col("lone") - F.col("at")).alias("rest"), "token")
    several = each.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("token")
    shared = C.materialize(each.join(several, "token"))
    return rows, shared, sets.select("sid", "codes")


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, n, sid), and of each set of several rows or with links sid, members, component_id and keep_sid.

    keep_sid is the set, in the component, of the row with the component's smallest id (null last), then the smallest sid.
    The last is the number of rows.  See jaccard_components.
    """
    rows, shared, codes = _prefixes(docs, id_col, text_col, words, percent)
    total = rows.count()
    links = C.materialize(_trees(_first_round(shared).withColumn("label", F.xxhash64("sid")).join(codes, "sid"), percent))
    labels = components(links).withColumnRenamed("node", "sid")
    C.tidy(docs.sparkSession)
    more = C.materialize(_trees(_last_round(shared, labels, percent).join(codes, "sid"), percent))
    if not more.isEmpty():
        labels = components(more.unionByName(labels.select(F.col("sid").alias("a"), F.col("component").alias("b")))).withColumnRenamed("node", "sid")
    classes = C.materialize(rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("members")))
    least = C.materialize(labels.join(classes, "sid").groupBy("component").agg(F.min("first_id").alias("component_id"), F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "sid"))["sid"].alias("keep_sid"), F.count(F.lit(1)).alias("sets")))
    linked = C.join_skewed(labels, least, "component", F.col("sets"), total).select("sid", "component_id", "keep_sid", F.lit(True).alias("linked"))
    C.tidy(docs.sparkSession)
    # Only classes of several rows, or with links, have anything to tell their rows.
    told = classes.join(linked, "sid", "left").where(F.col("linked") | (F.col("members") > 1))
    told = C.materialize(told.select("sid", "members", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"), F.coalesce("keep_sid", "sid").alias("keep_sid")))
    return rows, told, total


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Return doc_id, n_shingles, component_id for each row of docs.

    A document's set is its distinct shingles of so many words (A-Z lower-cased); two documents link when
    the Jaccard similarity of their sets is at least percent.  component_id is the smallest id that links
    reach.  Without words (or text) the set is empty and links with nothing.  Null ids take part; their component's id
    is the smallest that is not null.  Repeated rows each give a row and link with one another; an empty table gives
    an empty result; other columns are not read.

    1. One pass cuts the texts into chunks of sets; a shingle's frequency, the number of chunks' sets that hold it, is
       added up by shards of the shingle's hash, and goes back to the chunks.  The global order of shingles is by
       frequency (its power of two), then by hash.
    2. A set's prefix, rarest first, has an element in common with each set that it links to (prefix_length).  Most sets
       have no prefix element that another has: they are done.  Equal sets are one.
    3. The others go to prefix trees by their prefix elements, and the trees find the links: first to those of
       their HOMES rarest shared elements, then, where an element's sets are not all connected yet, to all.
       A tree holds about BLOCK_SHINGLES; sets that are too many are split, those already connected among
       themselves without pairing their parts.  Trees emit links only where they join two components.

    In the trees a shingle is a hash of HASH_BITS bits; n_shingles counts 64-bit hashes.
    """
    rows, told, total = _classes(docs, id_col, text_col, words, percent)
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    met = C.join_skewed(rows.where("n > 0"), told, "sid", F.col("members"), total, "left")
    known = F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return met.select("doc_id", F.col("n").alias("n_shingles"), known.alias("component_id")).unionByName(alone)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Return a, b: the set ids of each two different sets that link, a above b.  class_members tells each row's set id.

    The join itself.  Its result, unlike that of jaccard_components, may be as large as the square of a group.  Documents
    with equal sets are one class; empty sets, empty tables and odd rows are as there.
    """
    _, shared, codes = _prefixes(docs, id_col, text_col, words, percent)
    apart = shared.select("sid", F.col("sid").alias("component")).distinct()
    return _trees(_last_round(shared, apart, percent).join(codes, "sid"), percent, all_links=True).distinct()


def class_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Return doc_id, n_shingles and sid, the id of its set, for each row."""
    C.prepare(docs.sparkSession)

    @F.pandas_udf("n_shingles long, sid binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(bytes(t or b""), words) for t in texts]
        return pd.DataFrame({"n_shingles": [len(s) for s in sets], "sid": [set_id(s) for s in sets]})

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col).cast("binary")).alias("x")).select("doc_id", "x.*")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all columns, but of each component of links only one row.

    It is the row of the smallest id (null last), then of the smallest hash of its set; which one is open if several
    rows have both the id and the set.  Rows go by id and set, so another text under the id of a copy (null, or repeated) stays.
    Rows without words (or text) stay; an empty table stays empty.  Texts shuffle only where a Bloom filter of bounded
    size says that their id may be one to drop.
    """
    rows, told, total = _classes(docs, id_col, text_col, words, percent)
    stays = (F.col("sid") == F.col("keep_sid")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    met = C.join_skewed(rows.where("n > 0"), told, "sid", F.col("members"), total)
    met = met.groupBy(F.col("doc_id").alias("_met_id"), F.col("sid").alias("_met_digest"), stays.alias("_stays")).agg(F.count(F.lit(1)).alias("_rows"))

    @F.pandas_udf("binary")
    def sid(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([set_id(shingles(bytes(t or b""), words)) for t in texts])
        C.release()

    return C.without(docs, id_col, lambda d: sid(d[text_col].cast("binary")), met.where("not _stays or _rows > 1"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_components over documents: nulls, ties, repeated rows and empty tables as there."""
    return jaccard_components(C.table(spark, sf_dir, "documents"))


#: Shingles are joined as lists of words by list functions; links are closed by a recursive query.
SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.b, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = s.doc_id
"""
