"""Importance resampling against a plain draw."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from capledger.llm import _common as C
from capledger.llm import resampling

WORDS = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
RUNS = lambda t, k=1: [" ".join(w[i : i + n]) for w in [WORDS(t)] for n in range(1, k + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, k=1, buckets=10_000):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(at(f) for _, x in rows for f in RUNS(x, k)), Counter(at(f) for x in target for f in RUNS(x, k))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in rows:
        gains = [gain(at(f)) for f in RUNS(x, k)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(WORDS(x))])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for rank, r in enumerate(may[: len(may) * 10 // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("k", [1, 2])
@pytest.mark.parametrize("which", ["documents", "odd", "none"])
def test_resample(which, k, request, spark, sf):
    df, target = request.getfixturevalue(which), C.table(spark, sf, "benchmark")
    got = resampling.resample(df, target, ngram=k)
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()], [r["text"] for r in target.collect()], k)


def test_without_targets_and_with_null_ones(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for target in ([], [None, ""]):
        t = spark.createDataFrame([(x,) for x in target], "text string")
        assert sorted(map(tuple, resampling.resample(odd, t).collect()), key=str) == brute(rows, target)


def test_runs_merge_to_one_order():
    random.seed(3)
    for k in (0, 1, 2, 3, 7, 200):
        runs = [sorted((random.randrange(50), i) for _ in range(random.randrange(9))) for i in range(k)]
        assert list(resampling.merged([iter(r) for r in runs], fan_in=4)) == sorted(x for r in runs for x in r)


def test_a_merge_takes_no_more_than_it_is_asked_for():
    taken = []

    def run(i):
        for x in range(i, 1000, 10):
            taken.append(x)
            yield (x,)

    tree = resampling.merged([run(i) for i in range(10)], fan_in=3)
    assert [next(tree)[0] for _ in range(20)] == list(range(20)) and len(taken) <= 20 + 10 + 10


@pytest.mark.parametrize("draws", [0, 1, 777, 2999, 3000, 5000])
def test_draw_by_ranges_with_ties(spark, draws):
    """A third of the rows have one score and one id; runs are short and ranges many; ranks are as of one sort."""
    random.seed(draws)
    rows = [(7 if i % 3 == 0 else None if i % 50 == 1 else i, 20, 5, 100 if i % 3 == 0 else random.randrange(300), i, i % 10 > 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, tie long, eligible boolean").repartition(6)
    got = resampling.draw(df, draws, n_ranges=23, run_rows=100).collect()
    want = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    assert [(r["score"], r["doc_id"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(r[3], r[0]) for r in want[:draws]]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, min(draws, len(want)) + 1)) and len(got) == 3000


def test_string_ids(spark):
    rows = [(f"d{i}", " ".join(f"w{(i * k) % 31}" for k in range(30))) for i in range(200)]
    got = resampling.resample(spark.createDataFrame(rows, "name string, body string"), spark.createDataFrame([("w1 w2",)], "text string"), id_col="name", text_col="body")
    assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 21))
