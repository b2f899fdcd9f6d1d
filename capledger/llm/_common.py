"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch.  Texts can be long, so a batch is kept well below Spark's default.
BATCH_ROWS = 1000
_MASK = (1 << 64) - 1
#: A scan that writes a narrow table joins its splits only while a task reads no more than so many stored bytes, and
#: makes so many tasks a core at least.
TASK_BYTES, TASKS_A_CORE = 32 << 20, 4
#: A key of at least so many rows is hot; there are at most rows / HOT_GROUPS such keys, a size that is broadcast.
HOT_ROWS, HOT_GROUPS = 2_000, 100_000


class Memory(dict):
    """What a worker remembers from task to task about words.  Only one operator's is kept at a time."""

    _all: list[Memory] = []

    def __init__(self) -> None:
        super().__init__()
        Memory._all.append(self)

    def claim(self) -> None:
        """Clear the others, as a worker may serve several operators in a row."""
        for other in Memory._all:
            if other is not self and other:
                other.clear()


def release() -> None:
    """Forget what was remembered and give it back to the system at a task's end: workers idle on beside the next stage's."""
    for memory in Memory._all:
        memory.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def prepare(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch, so that a batch of long texts fits a worker, and let workers find the package."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on a single machine without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = os.path.join(tempfile.gettempdir(), "capledger-shared")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def input_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes that df reads: of its files, by the plan, or of its texts where the plan does not know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return size


def new_path(spark: SparkSession) -> str:
    """Path of a new table in the shared folder; what the application leaves there goes when it ends."""
    root = f"{shared_folder(spark).rstrip('/')}/capledger/{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{root}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, scan: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    It cuts the lineage, survives the loss of executors, and keeps later reads columnar.  With scan, df is made of
    one scan without a shuffle and is narrower than what it reads: small splits are joined to tasks of up to
    TASK_BYTES, but for TASKS_A_CORE tasks a core, so that many small files do not make as many others.
    """
    spark = df.sparkSession
    if scan:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        df = df.coalesce(min((1 << 31) - 1, max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once all that is made of them is a table itself."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver drop shuffles, broadcasts and plans that nothing refers to any more.

    Spark deletes a shuffle's files once the driver's collector has seen that it is unreachable, which may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    release()


def join_skewed(rows: DataFrame, facts: DataFrame, on: str, size: Column, n: int, how: str = "inner") -> DataFrame:
    """rows joined with facts, which has one row for each key; size (over facts) tells how many rows share the key.

    Keys of HOT_ROWS rows, and of a HOT_GROUPS-th of all n rows, meet their facts by broadcast: there are at most
    HOT_GROUPS of them, whatever the input.  So no task of the other join gets more rows of a key than that.
    """
    least = max(HOT_ROWS, n // HOT_GROUPS)
    hot = F.broadcast(facts.where(size >= least))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(facts.where(size < least), on, how))


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that this application wrote with materialize() now, and not at its end."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/capledger/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


#: DuckDB's SQL has no CRC-32: the 256 values of a byte, and the code of a text by them, from a column crc_table.
SQL_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def sql_crc32(text: str) -> str:
    """SQL (of DuckDB) for the unsigned CRC-32 of a text's UTF-8 bytes; the query has a column crc_table."""
    octets = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce([4294967295] || {octets}, lambda c, b: xor(c >> 8, crc_table[CAST((xor(c, b) & 255) + 1 AS INT)])), 4294967295)"


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---------------------------------------------------------------- Bloom filters

#: Slots of a block of a filter, the unit in which partial filters are merged.
BLOCK = 1 << 16
#: log2 of the most slots of a filter (32 MB).  More keys are cut into ranges of the hash, each with its own filter.
RANGE_LOG2 = 28
#: Slots that a task gathers before it sorts them together.
GATHERED = 1 << 22


def filter_log2(n: int, bits_per_key: float) -> int:
    """log2 of the slots of a filter for n keys, between 2**13 and 2**RANGE_LOG2."""
    return int(min(RANGE_LOG2, max(13, np.ceil(np.log2(max(1, n * bits_per_key))))))


def n_ranges(n: int, bits_per_key: float) -> int:
    """Ranges of the hash in which n keys have bits_per_key slots each in a filter of at most 2**RANGE_LOG2."""
    return max(1, int(np.ceil(n * bits_per_key / (1 << RANGE_LOG2))))


def in_range(h: Column, i: int, ranges: int) -> Column:
    """Whether a 64-bit hash lies in the i-th of equal ranges."""
    return h.between(-(1 << 63) + (i << 64) // ranges, -(1 << 63) + (i + 1 << 64) // ranges - 1)


def slots(h: np.ndarray, hashes: int, log2: int, seed: int = 0) -> np.ndarray:
    """Slots (hashes x len(h)) of 64-bit keys, by double hashing."""
    a = mix64(h.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & _MASK))
    b = mix64(a) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64((1 << log2) - 1) for i in range(hashes)])


def bits_at(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def holds(bits: np.ndarray, h: np.ndarray, hashes: int, log2: int, seed: int = 0) -> np.ndarray:
    """For each key, whether all its slots are set in the filter."""
    found = np.ones(len(h), bool)
    for at in slots(h, hashes, log2, seed):
        found &= bits_at(bits, at)
    return found


def _gather(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and whether each was set twice (2) or once (1), of several such pairs."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return u, np.minimum(np.bincount(at, np.concatenate([p[1] for p in parts]), len(u)), 2).astype(np.uint8)


def build_filter(keys: DataFrame, hashes: int, log2: int, twice: bool = False, seed: int = 0) -> bytes:
    """Bloom filter over the only column of keys (long); with twice, of slots that two rows or more set.

    Each task gathers the slots of its own keys and emits the blocks that have some; blocks are merged by a
    shuffle on the block number.  The result has 2**log2 bits, whatever the number of keys is.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            h = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            at = slots(h, hashes, log2, seed).ravel()
            held.append((at, np.ones(len(at), np.uint8)))
            size += len(at)
            if size > GATHERED:
                held = [_gather(held)]
                size = 0
        u, c = _gather(held)
        blocks, first = np.unique(u // np.uint64(BLOCK), return_index=True)
        for block, a, b in zip(blocks.tolist(), first, np.append(first, len(u))[1:], strict=True):
            part = np.zeros(BLOCK, np.uint8)
            part[(u[a:b] % np.uint64(BLOCK)).astype(np.int64)] = c[a:b]
            ones, twos = (np.packbits(part >= k, bitorder="little").tobytes() for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(ones + twos, 1)], pa.binary())], ["block", "part"])
        del held, u, c
        release()

    def merge(pdf):
        ones = twos = None
        for raw in pdf["part"]:
            both = np.frombuffer(zlib.decompress(raw), np.uint8)
            one, two = both[: len(both) // 2], both[len(both) // 2 :]
            if ones is None:
                ones, twos = one.copy(), two.copy()
            else:
                twos |= two | (ones & one)
                ones |= one
        return pdf.iloc[:1].assign(part=[(twos if twice else ones).tobytes()])

    merged = keys.mapInArrow(fill, "block int, part binary").groupBy("block").applyInPandas(merge, "block int, part binary")
    out = bytearray(max(1 << log2, BLOCK) // 8)
    for block, part in merged.collect():
        out[block * BLOCK // 8 : block * BLOCK // 8 + len(part)] = part
    return bytes(out)


def held_by(bits: Broadcast, hashes: int, log2: int, seed: int = 0):
    """Pandas UDF: whether a filter holds a 64-bit hash."""

    @F.pandas_udf("boolean")
    def found(h: pd.Series) -> pd.Series:
        return pd.Series(holds(np.frombuffer(bits.value, np.uint8), h.to_numpy(), hashes, log2, seed))

    return found


def without(docs: DataFrame, id_col: str, digest: Callable[[DataFrame], Column], met: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, but for those that met tells to go.

    met has _met_id, _met_digest, _stays and _rows: rows of that id and digest go, or stay as one if they are several.
    Rows whose id a Bloom filter of met's ids lacks, nearly all that stay, pass straight through; the texts of the
    others shuffle.  Beyond the filter's 2**RANGE_LOG2 slots more rows do; the join that follows is exact.
    """
    spark = docs.sparkSession
    met = materialize(met)
    n = met.count()
    log2 = filter_log2(n, 12)
    maybe = held_by(spark.sparkContext.broadcast(build_filter(met.select(F.xxhash64("_met_id")), 4, log2)), 4, log2)
    own = free_name(docs, "_digest_of_text")
    rest = docs.where(maybe(F.xxhash64(id_col)))
    rest = rest.withColumn(own, digest(rest))
    same = rest[id_col].eqNullSafe(met["_met_id"]) & (rest[own] == met["_met_digest"])
    out = docs.where(~maybe(F.xxhash64(id_col))).unionByName(rest.join(met, same, "left_anti").drop(own))
    again = met.where("_stays")
    if not again.isEmpty():
        out = out.unionByName(rest.join(again, same, "left_semi").dropDuplicates([id_col, own]).drop(own))
    return out


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


# ---------------------------------------------------------------- arrays as bytes


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: byte planes of each, as high bytes are mostly equal, under a light compression."""
    planes = (np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in map(np.ascontiguousarray, arrays))
    return b"".join(len(z).to_bytes(4, "little") + z for z in (zlib.compress(p, 1) for p in planes))


def unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 4], "little")
        planes = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + n]), np.uint8).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 4 + n
    return out
