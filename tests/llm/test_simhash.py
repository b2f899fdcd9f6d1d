"""SimHash near-copies against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from capledger.llm import simhash


def brute_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, most=3):
    fps = sorted(set(fps))
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= most:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {f: top(f) for f in fps}


def brute(rows, most=3):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    of = brute_components([f for _, f in fps], most)
    least = {}
    for i, f in fps:
        least.setdefault(of[f], []).append(i)
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in least.items()}
    return sorted(((i, f"{f:016x}", least[of[f]]) for i, f in fps), key=str)


def balls(n, seed, spread=4):
    """Fingerprints around a few centres, and as many anywhere."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 100))]
    near = [rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(spread + 1))) for _ in range(n // 2)]
    return sorted({*near, *(rng.getrandbits(64) for _ in range(n // 2))})


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One tWo", "a b c", "a b c d a b c d", "É \x0b x\x1cy é", "w " * 70_000 + "end", " ".join(f"w{i}" for i in range(140_000))])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_masks_meet_every_pair():
    rng = random.Random(5)
    for chosen in (1, 2, 3):
        masks = simhash.key_masks(0, chosen)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not diff & m for m in masks)
            outer = next(m for m in masks if not diff & m)
            assert any(not diff & m for m in simhash.key_masks(outer, 3))


@pytest.mark.parametrize("n", [0, 1, 40, 3000])
def test_search_connects_as_all_pairs_do(n):
    fps = balls(n, n)
    pivots = simhash.references()
    a, b = simhash.search(np.zeros(len(fps), np.uint64), np.array(fps, np.uint64), 3, pivots)
    up = brute_components(fps)
    got = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        got.setdefault(y, {y}).add(x)
    assert sorted(map(sorted, got.values())) == sorted(sorted(f for f in fps if up[f] == c) for c in {c for f, c in up.items() if f != c})


def test_pivots_drop_only_pairs_that_are_apart():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    fps[200:] = fps[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    table = simhash.distance_table(fps, simhash.references())
    a, b = np.triu_indices(400, 1)
    x, y = simhash.survivors(table, a, b, 3)
    near = {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    assert near and near <= set(zip(x.tolist(), y.tolist(), strict=True)) and len(x) < len(near) + 0.001 * len(a)


@pytest.mark.parametrize("which", ["documents", "odd", "none"])
def test_components(which, request):
    df = request.getfixturevalue(which)
    assert sorted(map(tuple, simhash.simhash_components(df).collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("key_rows", [8192, 20, 3])
def test_keys_of_many_rows_are_dealt_anew(spark, key_rows):
    """Balls of fingerprints that share keys, at limits that need one round and up to all of them."""
    fps = balls(1200, 9, spread=6)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = simhash.components(simhash.links(df, key_rows=key_rows)).collect()
    up = brute_components(fps)
    groups = {}
    for r in got:
        groups.setdefault(r["component"], set()).add(r["node"] & (1 << 64) - 1)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(f for f in fps if up[f] == c) for c in {c for f, c in up.items() if f != c})


def test_many_rows_of_one_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(simhash.C, "HOT_ROWS", 5)
    texts = ["a b c d e f g"] * 400 + [f"x{i} y z{i} q" for i in range(100)] + ["", None] * 20
    rows = [(None if i % 7 == 0 else 1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.simhash_components(df).collect()), key=str) == brute(rows)
