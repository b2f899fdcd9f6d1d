"""Merkle manifest of a dataset: ternary hash trees per source, with authentication paths by fractal traversal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import _common as C

#: Consecutive nodes that make a node of the next level.
ARITY = 3
#: Levels of a stacked subtree, and of a block, which one task traverses at a time.
SUBTREE, BLOCK_LEVELS = 2, 6
#: Leaves of a range that one task puts in order, unless there are cores for more ranges.
RANGE_LEAVES = 200_000
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<at: int, others: array<string>>>"


def node_hash(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Subtree:
    """Nodes of the heights from low up to (not with) top, made leaf by leaf.

    Below low only the nodes that wait for their run to be full are held, fewer than ARITY a height.
    """

    def __init__(self, low: int, top: int):
        self.low, self.top = low, top
        self.nodes: list[list[str]] = [[] for _ in range(low, top)]
        self.waiting: list[list[str]] = [[] for _ in range(top)]
        self.root: str | None = None

    def add(self, node: str, height: int = 0) -> None:
        while height < self.top:
            if height >= self.low:
                self.nodes[height - self.low].append(node)
            run = self.waiting[height]
            run.append(node)
            if len(run) < ARITY:
                return
            node = node_hash(run)
            run.clear()
            height += 1
        self.root = node

    def finish(self) -> Subtree:
        """The leaves have ended: each height's last run becomes a node as it is."""
        for height in range(self.top):
            if run := self.waiting[height]:
                node = node_hash(run)
                run.clear()
                self.add(node, height + 1)
        return self


def height_of(block: int, leaves: int, levels: int = BLOCK_LEVELS) -> int:
    """Levels above the leaves of a block: all of a block's, but for a tree that is a single block, which ends at one node."""
    height = levels
    if not block:
        height = 0
        while ARITY**height < leaves:
            height += 1
    return height


def root_of(leaves: list[str], height: int) -> str:
    tree = Subtree(height, height)
    for leaf in leaves:
        tree.add(leaf)
    return tree.finish().root


def paths(leaves: list[str], height: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf in turn, from the lowest level up, its place in its run and the run's other nodes.

    Fractal traversal (Jakobsson et al., 2003): the tree is cut into stacked subtrees of SUBTREE levels.  Of each
    stage one existing subtree is held, which has the siblings of the present leaf, and one desired subtree is made
    for the leaves that follow, a leaf a step, so that it is whole when the existing one has served.
    """
    stages = [(low, min(low + SUBTREE, height)) for low in range(0, height, SUBTREE)]
    spans = [ARITY**top for _, top in stages]
    existing, desired = [], [Subtree(*stage) for stage in stages]
    for stage, span in zip(stages, spans, strict=True):
        first = Subtree(*stage)
        for leaf in leaves[:span]:
            first.add(leaf)
        existing.append(first.finish())
    for i in range(len(leaves)):
        path = []
        for j, ((low, top), span) in enumerate(zip(stages, spans, strict=True)):
            if i and not i % span:
                existing[j], desired[j] = desired[j].finish(), Subtree(low, top)
            if i + span < len(leaves):
                desired[j].add(leaves[i + span])
            for height in range(low, top):
                at = i % span // ARITY**height
                first = at - at % ARITY
                run = existing[j].nodes[height - low][first : first + ARITY]
                path.append((at - first, run[: at - first] + run[at - first + 1 :]))
        yield path


# ---------------------------------------------------------------- distributed trees


def _in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (with key) with pos: the place among those of the same key, from 0, in the given order.

    Rows are sorted by ranges; a range is a file, where the reader numbers the rows.  Only counts of ranges are summed up.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // RANGE_LEAVES))
    by = [F.col("key"), *order]
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    ranged = C.materialize(ranged).select("*", F.col("_metadata.row_index").alias("row"))
    counts = ranged.groupBy("key", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = counts.select("key", "part", (F.sum("n").over(W.partitionBy("key").orderBy("part")) - F.col("n") - F.col("first")).alias("before"))
    return C.materialize(ranged.join(before, ["key", "part"]).withColumn("pos", F.col("before") + F.col("row")).drop("before", "row", "part"))


def _blocks(nodes: DataFrame, levels: int):
    return nodes.groupBy("key", F.floor(F.col("pos") / ARITY**levels).alias("block"))


def _digests(t: pa.Table, levels: int) -> tuple[pa.Table, list[str], int, int]:
    """A block's rows in order, their digests as hex text, the block's number and its height."""
    t = t.sort_by("pos")
    block = t["pos"][0].as_py() // ARITY**levels
    return t, [d.hex() for d in t["digest"].to_pylist()], block, height_of(block, len(t), levels)


def _root(levels: int):
    def root(t: pa.Table) -> pa.Table:
        t, leaves, block, height = _digests(t, levels)
        return pa.table({"key": t["key"][:1], "pos": pa.array([block], pa.int64()), "digest": pa.array([bytes.fromhex(root_of(leaves, height))], pa.binary())})

    return root


def climb(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """nodes (key, pos, digest), then the roots of their aligned blocks, of those roots' blocks, and so on to one root a key."""
    rounds = [nodes]
    while True:
        rounds.append(C.materialize(_blocks(rounds[-1], levels).applyInArrow(_root(levels), "key string, pos long, digest binary")))
        if rounds[-1].where("pos > 0").isEmpty():
            return rounds


def _traverse(kept: list[str], extra: list[str], levels: int):
    def traverse(nodes: pa.Table, above: pa.Table) -> pa.Table:
        t, leaves, _, height = _digests(nodes, levels)
        upper = above["proof"][0].as_py()
        proof = [[*({"at": at, "others": others} for at, others in path), *upper] for path in paths(leaves, height)]
        out = t.select(kept)
        for name in extra:
            out = out.append_column(name, pa.repeat(above[name][0], len(t)))
        return out.append_column("proof", pa.array(proof, pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))))

    return traverse


def descend(rounds: list[DataFrame], above: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """rounds[0] with proof, and what above tells of its key.

    above has key, pos (0), proof (of the key's root in what stands above it) and other columns, which all nodes
    get.  Each block is traversed by itself and meets one row: the proof of its root.
    """
    extra = [f for f in above.schema if f.name not in ("key", "pos", "proof")]
    for nodes in reversed(rounds[:-1]):
        kept = [f for f in nodes.schema if nodes is rounds[0] or f.name in ("key", "pos")]
        schema = T.StructType([*kept, *extra, above.schema["proof"]])
        own = _traverse([f.name for f in kept], [f.name for f in extra], levels)
        above = _blocks(nodes, levels).cogroup(above.groupBy("key", F.col("pos").alias("block"))).applyInArrow(own, schema)
        if nodes is not rounds[0]:
            above = C.materialize(above)
    return above


def leaf_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 of columns: each is its length in bytes, a colon and its value, or - for null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(F.array_join(F.slice(p.others, F.lit(1), p.at), ""), h, F.array_join(F.slice(p.others, p.at + 1, F.lit(ARITY)), "")), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", read: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Return doc_id, source, leaf, subroot, root and proof for each row of docs (and read, where it is given).

    A leaf is the hash of a row's fields.  The leaves of a source, in order of id, make its tree: every ARITY consecutive
    nodes, or what is left at the end, make a node, until one remains, the subroot; a lone leaf is its own.
    The subroots, in order of source, make the root in the same way.  proof lists, from the leaf up through the
    subroot, the leaf's place in its run and the run's other nodes (hex text).

    Null fields count as -; null is a source of its own, before the others; null ids come first.  Rows of
    one id stand in order of leaf; repeated rows each are a leaf.  A null or empty text is a leaf like others.  An empty
    table gives an empty result.  Columns not named are not read.

    Texts are read once, where they are hashed; what shuffles is digests and ids.  Leaves are put in order by ranges, then
    each aligned block of ARITY ** levels leaves is a group of its own, so a source of any size is spread; block roots are leaves
    of the next round, until one is left.
    """
    C.prepare(docs.sparkSession)
    source = F.col(source_col).cast("string")
    columns = [F.unhex(leaf_digest([F.col(c) for c in fields])).alias("digest"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"), F.col(id_col).alias("doc_id")]
    if read is not None:
        columns.append(read.alias("read"))
    leaves = _in_order(C.materialize(docs.select(columns), scan=True), [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    rounds = climb(leaves, levels)
    # The subroots are the leaves of one more tree, whose key is the same for all.
    subroots = _in_order(rounds[-1].select(F.lit("").alias("key"), F.col("key").alias("own"), "digest"), [F.col("own")])
    over = climb(subroots, levels)
    top = over[-1].select("key", "pos", F.array().cast(PROOF).alias("proof"), F.lower(F.hex("digest")).alias("root"))
    above = descend(over, top, levels).select(F.col("own").alias("key"), F.lit(0).cast("long").alias("pos"), "proof", F.lower(F.hex("digest")).alias("subroot"), "root")
    out = descend(rounds, C.materialize(above), levels)
    name = F.when(F.col("key") != "n", F.expr("substr(key, 2)")).alias("source")
    return out.select("doc_id", name, F.lower(F.hex("digest")).alias("leaf"), "subroot", "root", "proof", *(["read"] if read is not None else []))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manifest of documents, each proof held against the text as read back: of even crc32 of the id, without its line ends.

    Nulls, ties, repeated rows and empty tables as there; a null id has the crc of the empty text, 0, so it is tampered with.
    """
    docs = C.table(spark, sf_dir, "documents")
    changed = F.replace("text", F.lit("\n"), F.lit(""))
    # Only a leaf that differs is carried along.
    differs = (C.crc_fold(F.col("doc_id"), 2) == 0) & F.col("text").contains("\n")
    read = F.when(differs, F.unhex(leaf_digest([changed if c == "text" else F.col(c) for c in FIELDS])))
    proved = manifest(docs, read=read)
    back = folded(F.coalesce(F.lower(F.hex("read")), F.col("leaf")), F.col("proof"))
    others = F.sha2(F.array_join(F.flatten(F.transform("proof", lambda p: p.others)), ""), 256)
    proved = proved.select("doc_id", "leaf", "subroot", "root", others.alias("proof_sha256"), back.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


_ENC = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_ENC(text if c == "text" else c) for c in FIELDS) + ")"
#: Levels of a source's tree are levels 0 and up; those of the tree of subroots follow from 1000.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS key, {_LEAF("text")} AS leaf,
         CASE WHEN {C.sql_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF("text")} END AS read
  FROM documents, (SELECT {C.SQL_CRC_TABLE} AS crc_table)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM d
), t(level, key, pos, h, n) AS (
  SELECT 0, key, pos, leaf, n FROM leaves
  UNION ALL
  SELECT level + 1, key, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY level, key, pos // 3, n
), subroots AS (
  SELECT key AS own, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
), u(level, pos, h, n) AS (
  SELECT 1000, pos, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, pos // 3, n
), runs AS (
  SELECT level, key, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM t WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT level, own, run, hs FROM (SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM u WHERE n > 1 GROUP BY ALL) JOIN (SELECT DISTINCT own FROM subroots) ON true
), path AS (
  SELECT key, pos AS leaf_pos, level, pos // CAST(pow(3, level) AS BIGINT) AS spot FROM leaves, (SELECT DISTINCT level FROM t WHERE n > 1)
  UNION ALL SELECT l.key, l.pos, level, s.pos // CAST(pow(3, level - 1000) AS BIGINT) FROM leaves l JOIN subroots s ON own = l.key, (SELECT DISTINCT level FROM u WHERE n > 1)
), proofs AS (
  SELECT key, leaf_pos, list(struct_pack(lo := array_to_string(hs[: spot % 3], ''), hi := array_to_string(hs[spot % 3 + 2 :], '')) ORDER BY level) AS proof
  FROM path JOIN runs USING (key, level) WHERE run = spot // 3 GROUP BY ALL
), done AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(proof, lambda p: p.lo || p.hi), ''), '')) AS proof_sha256,
         coalesce(list_reduce(list_transform(proof, lambda p: struct_pack(lo := p.lo, h := '', hi := p.hi)), lambda a, p: struct_pack(lo := '', h := sha256(p.lo || a.h || p.hi), hi := ''), struct_pack(lo := '', h := read, hi := '')).h, read) AS folded_root
  FROM leaves JOIN subroots ON own = key LEFT JOIN proofs ON proofs.key = leaves.key AND leaf_pos = leaves.pos
)
SELECT *, folded_root = root AS verified FROM done
"""
