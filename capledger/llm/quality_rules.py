"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .text_stats import BASE, NAMES, with_stats

#: Labelled documents that the list is learned from, at most (those with the smallest hash of their id).
MOST_TRAINING = 50_000
#: Shares of the learning sample to grow rules on (the rest prunes them); thresholds tried for a feature.
GROW_SHARE, CUTS = 2 / 3, 48
#: A rule needs this precision and this many rejected documents on the pruning sample, or the list ends.
LEAST_PRECISION, LEAST_COVER, MOST_CONDITIONS, MOST_RULES = 0.95, 3, 4, 24

#: Features of the rules: name, numerator, denominator.
RATIOS = (
    ("words", "n_words", None), ("chars_per_word", "word_chars", "n_words"), ("symbols_per_word", "n_symbols", "n_words"), ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"), ("distinct_share", "n_distinct", "n_words"), ("stop_share", "n_stop", "n_words"), ("upper_share", "n_upper", "word_chars"),
    ("bangs_per_word", "n_bangs", "n_words"), ("marked_share", "n_marked", "n_words"), ("words_per_stop", "n_words", "n_stops"), ("words_per_line", "n_words", "n_lines"),
)


def features() -> list[Column]:
    """Each ratio as a double; a zero denominator counts as one."""
    return [(F.col(a).cast("double") if b is None else F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(n) for n, a, b in RATIOS]


def learn(x: np.ndarray, bad: np.ndarray) -> list[list[tuple[int, bool, float]]]:
    """Rules that reject: each a list of (feature, above, threshold), all of which must hold.

    Sequential covering: grow a rule on the growing sample by the condition of most information gain until
    it covers no good document, prune its last conditions while (p - n) / (p + n) on the pruning sample does
    not fall, keep it if it is precise there, take away what it covers, and go on.  Rows come in the order of
    a hash, so their first GROW_SHARE is a random part.
    """
    cut_at = int(len(bad) * GROW_SHARE)
    gx, gb, px, pb = x[:cut_at], bad[:cut_at], x[cut_at:], bad[cut_at:]
    rules: list[list[tuple[int, bool, float]]] = []
    covers = lambda rule, v: np.logical_and.reduce([(v[:, f] > t) if up else (v[:, f] <= t) for f, up, t in rule], initial=True) & np.ones(len(v), bool)
    while gb.any() and len(rules) < MOST_RULES:
        rule: list[tuple[int, bool, float]] = []
        v, b = gx, gb
        while len(rule) < MOST_CONDITIONS and not b.all():
            p, n = b.sum(), (~b).sum()
            best = (0.0, None)
            for f in range(x.shape[1]):
                for t in np.unique(np.quantile(v[b][:, f], np.linspace(0, 1, CUTS))):
                    for up in (True, False):
                        hit = v[:, f] > t if up else v[:, f] <= t
                        hp = (hit & b).sum()
                        hn = hit.sum() - hp
                        if hp and (gain := hp * (np.log2(hp / (hp + hn)) - np.log2(p / (p + n)))) > best[0]:
                            best = (gain, (f, up, float(t)))
            if best[1] is None:
                break
            rule.append(best[1])
            hit = covers(rule[-1:], v)
            v, b = v[hit], b[hit]
        if not rule:
            break

        def worth(r: list) -> float:
            hit = covers(r, px)
            p = (hit & pb).sum()
            return (2 * p - hit.sum()) / max(1, hit.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = covers(rule, px)
        if hit.sum() < LEAST_COVER or (hit & pb).sum() < LEAST_PRECISION * hit.sum():
            break
        rules.append(rule)
        left, pleft = ~covers(rule, gx), ~hit
        gx, gb, px, pb = gx[left], gb[left], px[pleft], pb[pleft]
    return rules


def verdict(rules: list[list[tuple[int, bool, float]]]) -> tuple[Column, Column]:
    """Ordered conditions over the feature columns: number of the first rule that fits (from 1; else 0), and its text."""
    number, told = F.lit(0), F.lit("keep")
    for i, rule in reversed(list(enumerate(rules, 1))):
        names = [(RATIOS[f][0], up, t) for f, up, t in rule]
        holds = F.lit(True)
        for n, up, t in names:
            holds = holds & (F.col(n) > t if up else F.col(n) <= t)
        number, told = F.when(holds, i).otherwise(number), F.when(holds, " and ".join(f"{n} {'>' if up else '<='} {t:.6g}" for n, up, t in names)).otherwise(told)
    return number, told


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_training: int = MOST_TRAINING) -> DataFrame:
    """Return doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule, reason.

    base_failed: fewer than 50 words, or over half of them in repeated three-word windows.  kept is false for
    those and for documents that a learned rule rejects; rule is the number of the first that fits (0: none)
    and reason its text.  The list is learned from at most most_training labelled documents that pass the
    base rule (labels: doc_id, quality; 0 is bad, null labels are left out); without labels it is empty.
    A null text counts as empty.  Repeated rows each give a row; of several labels of one id the least counts; a null id meets no label;
    an empty table gives an empty result; other columns are not read.
    """
    stats = C.materialize(with_stats(docs, id_col, text_col), scan=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = stats.where(~failed).join(told, "doc_id").select(F.xxhash64("doc_id").alias("h"), (F.col("quality") == 0).alias("bad"), *features())
    rows = sample.orderBy("h", *sample.columns[1:]).limit(most_training).drop("h").toArrow()
    rows = np.stack([c.to_numpy().astype(float) for c in rows.columns], 1)
    rules = learn(rows[:, 1:], rows[:, 0] > 0)
    number, reason = verdict(rules)
    judged = stats.select("doc_id", *NAMES, *features()).select("doc_id", *BASE, failed.alias("base_failed"), number.cast("long").alias("rule"), reason.alias("reason"))
    return judged.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule", "reason")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality_rules over documents and labels: nulls, ties, repeated rows and empty tables as there."""
    return quality_rules(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
