"""Packing documents into sequences along a space-filling curve."""

from __future__ import annotations

import functools
import gc
import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import _common as C

#: Tokens of a sequence, the id that ends a document, and the tokenizer's file.
LENGTH, END_ID, VOCABULARY = 4096, 2, "word_bpe_49k.json"
#: Dimensions of the projection and bits of each in the Hilbert key.
DIMS, BITS = 4, 12
#: Bits of a lane, of which DIMS make 64, and the most that one holds.
LANE = 64 // DIMS
MOST = (1 << LANE) - 1
#: Words whose ids a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 80_000, 64
#: Bytes of texts that are split into words at a time.
AT_A_TIME = 1 << 18
#: A comma or full stop after a letter, at a word's end.  The mark comes first, as a literal is found faster.
_COMMA, _STOP = (re.compile(rb"%s(?<=[a-z]%s)(?=[\x20\x09-\x0D]|\Z)" % (m, m)) for m in (rb",", rb"\."))
#: Bytes of ids of a range, their number up to which it is so, and the most bytes of a range beyond.
RANGE_BYTES, MOST_RANGES, LARGE_RANGE = 8 << 20, 10_000, 256 << 20


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows), each coordinate below 2**bits.

    A point is read from its highest bit plane down; each plane names a cell of the current cube, and the
    cube's axes are exchanged or mirrored as the curve turns there (Skilling, 2004).
    """
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for q in range(bits - 1, 0, -1):
        low = (one << np.uint64(q)) - one
        for d in range(dims):
            is_set = (x[d] >> np.uint64(q)) & one > 0
            swap = np.where(is_set, 0, (x[0] ^ x[d]) & low).astype(np.uint64)
            x[0] ^= np.where(is_set, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for q in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(q)) & one > 0, (one << np.uint64(q)) - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for q in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << one) | ((x[d] >> np.uint64(q)) & one)
    return key.astype(np.int64)


#: Ends a word in the short way; no UTF-8 text holds this byte.
_END = b"\xff"


def short_way(tokenizer: Tokenizer) -> Callable[[bytes], list[int]] | None:
    """Ids of one piece by a faster merge of the same vocabulary, or None where the vocabulary is not of that kind.

    It is for byte-level pair encodings with word ends whose tokens' ids rise in the order of the merges.  Then a
    token is named by its bytes, its word end by _END, and the pair that merges next is the one of least id.
    """
    told = json.loads(tokenizer.to_str())
    model, added = told["model"], {t["content"] for t in told["added_tokens"]}
    suffix, vocab = model.get("end_of_word_suffix"), model.get("vocab")
    if model.get("type") != "BPE" or not suffix:
        return None
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    # Byte-level vocabularies write printable bytes as themselves and the others, in order, from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    try:
        ranks = {bytes(byte_of[c] for c in t.removesuffix(suffix)) + _END * t.endswith(suffix): i for t, i in vocab.items() if t not in added}
    except KeyError:
        return None
    ends = max(ranks.get(bytes([b]) + _END, 1 << 62) for b in range(255))
    if any(a >= b for a, b in zip([ends, *merged], merged, strict=False)) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("words", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


@functools.lru_cache(2)
def encoder_of(path: str, end_id: int) -> Encoder:
    """A worker's encoder, which later tasks of the worker find; what reading the vocabulary took is given back."""
    encoder = Encoder(path, end_id)
    gc.collect()
    C.release()
    return encoder


class Encoder:
    """Token ids of texts, end id included, as little-endian bytes of width bytes an id.

    The tokenizer drops white space, never joins over it, and parts letters from what follows them, so a text's ids
    are those of its words in a row, and a comma or full stop after a letter is a word of its own.  It ignores case,
    but for its special tokens.  Words are encoded once and remembered.
    """

    def __init__(self, path: str, end_id: int):
        # A task has one core; the tokenizer's own threads would take those of others.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind, self.code = f"<u{self.width}", {2: "H", 4: "I"}[self.width]
        self.packs = [struct.Struct(f"<{n}{self.code}").pack for n in range(32)]
        self.end = np.array([end_id], self.kind).tobytes()
        self.known = C.Memory()
        self.short, self.tried = short_way(self.tokenizer), False
        # A token's direction in the projection comes from a hash of its id.
        h = C.mix64(np.arange(size, dtype=np.uint64)[:, None] * np.uint64(DIMS) + np.arange(DIMS, dtype=np.uint64))
        # The signs that are positive are ones, each in LANE bits of a number.
        self.direction = ((h >> np.uint64(63)) << np.arange(0, DIMS * LANE, LANE, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; texts are taken some at a time, as a text's words take ten times its room."""
        out: list[bytes] = []
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > AT_A_TIME:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        split = [(t if b"<|" in t else _STOP.sub(b" .", _COMMA.sub(b" ,", t.lower()))).split() for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            # The words of these texts stay, and frequent ones are among them.
            kept = {w: ids for words in split for w in words if (ids := known.get(w))}
            known.clear()
            known.update(kept)
        missing = list(set(chain.from_iterable(split)).difference(known))
        for i in range(0, len(missing), 8192):
            known.update(self._encode_words(missing[i : i + 8192]))
        out = [b"".join(map(known.__getitem__, words)) + self.end for words in split]
        for w in missing:
            if len(w) > LONGEST:
                del known[w]
        return out

    def _encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of each word.

        Lower-case words of letters only need no normalising and are one piece each: they take the short way, if
        there is one.  The first words that do are held against the whole tokenizer.
        """
        rest = []
        short = self.short
        if short is not None:
            plain = []
            for w in words:
                # Letters of ASCII are lower-case here, but where the text may hold a special token.
                if w.isalpha() and w.islower():
                    plain.append(w)
                    continue
                t = w.decode("utf-8", "replace")
                (plain if t.isalpha() and t == t.lower() and unicodedata.is_normalized("NFC", t) else rest).append(w)
            if plain and not self.tried:
                self.tried = True
                some = plain[:2048]
                whole = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
                if any(short(w + _END) != e.ids for w, e in zip(some, whole, strict=True)):
                    short = self.short = None
        if short is None:
            rest = words
        else:
            packs, most = self.packs, len(self.packs)
            for w in plain:
                ids = short(w + _END)
                yield w, packs[n](*ids) if (n := len(ids)) < most else self.packed(ids)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False), strict=True):
            yield w, self.packed(e.ids)

    def packed(self, ids: list[int]) -> bytes:
        return self.packs[len(ids)](*ids) if len(ids) < len(self.packs) else np.array(ids, self.kind).tobytes()

    def points(self, ids: list[bytes]) -> np.ndarray:
        """Each document's hashed vector, projected, as a point with BITS bits a coordinate."""
        sums = np.empty((len(ids), DIMS))
        for i, raw in enumerate(ids):
            a = np.frombuffer(raw, self.kind)
            # A lane holds the ones of fewer than 1 << LANE tokens.
            parts = [int(self.direction[a[j : j + MOST]].sum()) for j in range(0, len(a), MOST)]
            sums[i] = [(2 * sum(p >> at & MOST for p in parts) - len(a)) / len(a) for at in range(0, DIMS * LANE, LANE)]
        # Means of signs lie between -1 and 1; the square root spreads the many that are near 0.
        spread = np.sign(sums) * np.sqrt(np.abs(sums))
        return np.clip((spread + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def n_ranges(size: int) -> int:
    """Ranges for so many bytes of ids: RANGE_BYTES each, larger ones once there are MOST_RANGES, but of LARGE_RANGE at most.

    A range is streamed, so its size is no matter of memory; the session's settings have no part in it.
    """
    return max(1, min(-(-size // RANGE_BYTES), max(MOST_RANGES, -(-size // LARGE_RANGE))))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Return a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each text is encoded (null: empty) and ended by end_id.  Its token counts, as a hashed vector, are
    projected to DIMS dimensions by hashed signs; documents are range-sorted by the Hilbert key of that
    point (then by id) and laid end to end, so neighbours along the curve share sequences.  Each range
    fills its own sequences of length tokens, cutting documents where one is full; what is left at its end is
    cut into sequences of powers of two, which need no padding.  sequence_id is unique and offset has no gaps.

    Repeated rows are documents of their own.  A document of any length is cut into as many pieces as it
    needs.  An empty table gives no piece; other columns are not read.
    """
    C.prepare(docs.sparkSession)
    path = path or str(public_tokenizers.path(VOCABULARY))
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, end_id)
        encoder.known.claim()
        for batch in batches:
            ids = encoder.encode(C.texts(batch.column(1)))
            keys = hilbert_key(encoder.points(ids)) if ids else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array([encoder.width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "key", "width", "ids"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = None
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        done: list[tuple] = []
        # Pieces of the open sequence: document, start, ids, tokens of the document.
        open_: list[tuple] = []
        held = 0

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            sequence += 1
            offset = 0
            for doc, start, ids, total in pieces:
                done.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))
                offset += len(ids)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            kinds = [doc_kind, *[pa.int64()] * 6]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        doc_kind = pa.int64()
        for batch in batches:
            doc_kind = batch.column(0).type
            if sequence is None and batch.num_rows:
                sequence = (batch.column(3)[0].as_py() << 32) - 1
            for doc, width, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(raw, f"<u{width}")
                at = 0
                while at < len(ids):
                    part = ids[at : at + length - held]
                    open_.append((doc, at, part, len(ids)))
                    at += len(part)
                    held += len(part)
                    if held == length:
                        close(open_)
                        open_.clear()
                        held = 0
                if len(done) > 10_000:
                    yield rows()
        while held:
            size = 1 << (held.bit_length() - 1)
            held -= size
            pieces = []
            while size:
                doc, start, ids, total = open_.pop(0)
                pieces.append((doc, start, ids[:size], total))
                if len(ids) > size:
                    open_.insert(0, (doc, start + size, ids[size:], total))
                size -= min(size, len(ids))
            close(pieces)
        yield rows()

    encoded = C.materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(encode, f"doc_id {kind}, key long, width int, ids binary"), scan=True)
    tie = F.xxhash64("ids")
    parts = n_ranges(encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0)
    ranged = encoded.withColumn("tie", tie).repartitionByRange(parts, "key", "doc_id", "tie").sortWithinPartitions("key", "doc_id", "tie")
    # Sequences are numbered by the range's own number, not by the task's: a caller may join partitions.
    return ranged.select("doc_id", "width", "ids", F.spark_partition_id().alias("range")).mapInArrow(fill, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack over documents: nulls, ties, repeated rows and empty tables as there."""
    return pack(C.table(spark, sf_dir, "documents"))
