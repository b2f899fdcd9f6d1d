"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .text_stats import NAMES, with_stats

#: Documents that the scorer is trained on, at most (those with the smallest hash of their text).
MOST_TRAINING = 12_000
#: Hashed features, passes of training, step, ridge, and the score below which a document is rejected.
DIMS, EPOCHS, STEP, RIDGE, THRESHOLD = 1 << 14, 80, 4.0, 1e-5, 0.22
#: Features (two a word) from which a text counts in full.
LEAST_EVIDENCE = 80
EM_ROUNDS, EM_PRIOR = 100, 1.0


LABELLERS = ("symbols", "marks", "case", "bangs", "repeats", "distinct", "stops", "sentences", "length", "size")


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 1).when(good, 2).otherwise(0)


def labellers() -> list[Column]:
    """Votes over the counts of text_stats: 1 bad, 2 good, 0 none.  They overlap: each fault meets two or more."""
    many = F.col("n_words") >= 20
    return [
        _vote(_per("n_symbols", "n_words") > 0.5, _per("n_symbols", "n_words") < 0.05).alias("symbols"),
        _vote(_per("n_marked", "n_words") > 0.3, (_per("n_marked", "n_words") < 0.02) & (_per("n_stop", "n_words") > 0.1)).alias("marks"),
        _vote(_per("n_upper", "word_chars") > 0.4, _per("n_lower", "word_chars") > 0.7).alias("case"),
        _vote(_per("n_bangs", "n_words") > 0.3, (_per("n_bangs", "n_words") < 0.02) & (F.col("n_stops") > 0)).alias("bangs"),
        _vote(_per("n_repeat_words", "n_words") > 0.5, many & (_per("n_repeat_words", "n_words") < 0.2)).alias("repeats"),
        _vote(many & (_per("n_distinct", "n_words") < 0.2) & (F.col("n_words") < 2000), many & (_per("n_distinct", "n_words") > 0.4)).alias("distinct"),
        _vote(many & (_per("n_stop", "n_words") < 0.02), _per("n_stop", "n_words") > 0.12).alias("stops"),
        _vote(many & (_per("n_words", "n_stops") > 60), many & (_per("n_words", "n_stops") < 25) & (_per("n_upper", "word_chars") < 0.2)).alias("sentences"),
        _vote(_per("word_chars", "n_words") > 12, (_per("word_chars", "n_words") > 3) & (_per("word_chars", "n_words") < 8)).alias("length"),
        _vote(F.col("n_words") < 1, F.col("n_words") >= 50).alias("size"),
    ]


def fit_labellers(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over the distinct vote patterns and how often each occurs.

    Returns P(good | pattern), P(vote | class, labeller, voted) as (2, labellers, 2), and the class shares.
    A labeller that gives no vote is no evidence.  A prior of EM_PRIOR votes keeps shares from 0.
    """
    bad, good = (votes == 1).sum(1), (votes == 2).sum(1)
    # Faults are rare and each shows in a few labellers only, so two votes of bad open as bad.
    post = np.clip(1 - 0.45 * bad + 0.02 * good, 0.05, 0.95)
    shown = np.stack([votes == v for v in (1, 2)], 2).astype(float)
    for _ in range(EM_ROUNDS):
        w = np.stack([(1 - post) * counts, post * counts])
        share = (w.sum(1) + EM_PRIOR) / (counts.sum() + 2 * EM_PRIOR)
        p = np.einsum("cn,nlv->clv", w, shown) + EM_PRIOR
        p /= p.sum(2, keepdims=True)
        logs = np.log(share)[:, None] + np.einsum("nlv,clv->cn", shown, np.log(p))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, p, share


_SHAPE = bytes.maketrans(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(48, 58)), b"A" * 26 + b"a" * 26 + b"0" * 10)


class _Slots(C.Memory):
    """Slots of a word: of its shape (letters and digits folded, runs cut to two) and of its lower-cased form."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = bytearray()
        for c in word[:64].translate(_SHAPE):
            c = 97 if c >= 128 else c
            if len(shape) < 2 or shape[-1] != c or shape[-2] != c:
                shape.append(c)
        found = (xxhash.xxh3_64_intdigest(b"s" + bytes(shape)) % DIMS, xxhash.xxh3_64_intdigest(b"w" + word.lower()) % DIMS)
        if len(self) < 200_000 and len(word) <= 64:
            self[word] = found
        return found


_SLOTS = _Slots()
_AGAIN = xxhash.xxh3_64_intdigest(b"word again") % DIMS


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text and how often it has each: word shapes and words, and words equal to the one before."""
    _SLOTS.claim()
    words = text.split()
    if not words:
        return np.zeros(0, np.uint16), np.zeros(0, np.uint32)
    flat = np.array([_SLOTS[w] for w in words], np.int32)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    slot, n = np.unique(np.concatenate([flat.ravel(), np.full(again, _AGAIN, np.int32)]), return_counts=True)
    return slot.astype(np.uint16), n.astype(np.uint32)


def values(n: np.ndarray) -> np.ndarray:
    """Values of a text's slots: of unit length, or less for texts of few words, whose scores so stay near the middle."""
    return (np.sqrt(n) / np.sqrt(max(n.sum(), LEAST_EVIDENCE))).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> np.ndarray:
    """Logistic regression on soft targets by accelerated gradient steps; the last weight is the bias."""
    weights = np.zeros(DIMS + 1)
    if not len(target):
        weights[-1] = 1.0
        return weights
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(s) for s, _ in rows])
    slot, value = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
    # Both classes count alike, whatever their shares.
    share = np.clip(target.mean(), 0.02, 0.98)
    scale = target / share * 0.5 + (1 - target) / (1 - share) * 0.5
    last = weights.copy()
    for i in range(EPOCHS):
        ahead = weights + i / (i + 3) * (weights - last)
        z = np.bincount(at, ahead[slot] * value, len(rows)) + ahead[-1]
        off = scale * (1 / (1 + np.exp(-z)) - target)
        grad = np.append(np.bincount(slot, off[at] * value, DIMS), off.sum()) / scale.sum() + RIDGE * ahead
        last, weights = weights, ahead - STEP * grad
    return weights


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_training: int = MOST_TRAINING) -> tuple[np.ndarray, dict[tuple[int, ...], float], DataFrame]:
    """Fit to docs: the scorer's weights, P(good) by vote pattern, and the votes of all rows (doc_id and labellers).

    Vote patterns are counted over all rows; there are at most 3 ** labellers of them.  The scorer is trained on
    the posteriors of at most most_training texts, those with the smallest hash.
    """
    votes = C.materialize(with_stats(docs, id_col, text_col).select("doc_id", *NAMES).select("doc_id", *labellers()), scan=True)
    patterns = votes.groupBy(*LABELLERS).count().collect()
    seen = np.array([tuple(r)[:-1] for r in patterns], int).reshape(-1, len(LABELLERS))
    posterior = fit_labellers(seen, np.array([r["count"] for r in patterns], float))[0] if len(seen) else np.zeros(0)
    by_pattern = {tuple(map(int, v)): float(p) for v, p in zip(seen, posterior, strict=True)}
    n = votes.count()
    # Texts below a quantile of the hash are a little more than the bound; the bound itself is cut by order.
    limit = min((1 << 63) - 1, int(1.2 * most_training / max(1, n) * (1 << 64)) - (1 << 63))
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).where(F.col("h") <= limit)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed(t) for t in C.texts(batch.column(1))]
            # Counts in as few bytes as they need: the driver gets them all.
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s, _ in found], pa.binary()), pa.array([C.pack(n) for _, n in found], pa.binary())], ["h", "slot", "value"])
        C.release()

    # Equal texts fall together by hash: the sample has distinct texts, each with the votes of its own statistics.
    distinct = some.groupBy("h").agg(F.min("text").alias("text"))
    stats = with_stats(distinct, "h", "text").select("doc_id", *labellers()).withColumnRenamed("doc_id", "h")
    rows = distinct.mapInArrow(features, "h long, slot binary, value binary").join(stats, "h").orderBy("h").limit(most_training).toArrow()
    data = [(np.frombuffer(s, np.uint16), values(C.unpack(v, "<u4")[0])) for s, v in zip(rows.column("slot").to_pylist(), rows.column("value").to_pylist(), strict=True)]
    target = np.array([by_pattern[v] for v in zip(*[rows.column(n).to_pylist() for n in LABELLERS], strict=True)])
    del rows
    weights = train(data, target)
    del data, target
    C.tidy(docs.sparkSession)
    return weights, by_pattern, votes


def scorer(spark: SparkSession, weights: np.ndarray):
    """Pandas UDF: P(good) of a text (binary); an empty text scores by the bias alone."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for text in batches:
            z = [float(w[s] @ values(n)) + w[-1] for s, n in map(hashed, text)]
            yield pd.Series(1 / (1 + np.exp(-np.array(z, float))))
        C.release()

    return score


def quality_classifier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, most_training: int = MOST_TRAINING) -> DataFrame:
    """Return doc_id, score (P(good) by the hashed linear scorer) and kept (score >= threshold) for each row.

    Heuristic labellers vote on statistics of each text; expectation-maximisation over the vote patterns of
    all rows gives each labeller's accuracy and each pattern's posterior; the posteriors train the scorer, on
    a bounded sample; the scorer judges every whole text.  No labels are read.  A null text counts as empty,
    equal texts score alike, repeated rows each give a row, an empty table gives an empty result, and other columns are not read.
    """
    C.prepare(docs.sparkSession)
    weights, _, _ = fit(docs, id_col, text_col, most_training)
    score = scorer(docs.sparkSession, weights)(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return docs.select(F.col(id_col).alias("doc_id"), score.alias("score")).withColumn("kept", F.col("score") >= threshold)


def drop_low_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, that quality_classifier keeps.

    A null text is judged as an empty one; null or repeated ids make no difference; repeated rows stay or go together; an empty
    table stays empty.
    """
    C.prepare(docs.sparkSession)
    weights, _, _ = fit(docs, id_col, text_col)
    return docs.where(scorer(docs.sparkSession, weights)(F.coalesce(F.col(text_col), F.lit("")).cast("binary")) >= threshold)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_classifier over documents: nulls, ties, repeated rows and empty tables as there."""
    return quality_classifier(C.table(spark, sf_dir, "documents"))
