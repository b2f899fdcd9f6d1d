"""The manifest of a dataset against plain trees."""

import hashlib
import random
import zlib

import pytest

from capledger.llm import manifest

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append((i % 3, [x for k, x in enumerate(level[first : first + 3], first) if k != i]))
        i //= 3
    return out


def fold(h, proof):
    for at, others in proof:
        h = H("".join([*others[:at], h, *others[at:]]))
    return h


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    top = tree([own[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, h, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            proof = path(own[s], i) + path(top, k)
            odd = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 2
            read = h if odd or r["text"] is None else leaf(r, r["text"].replace("\n", ""))
            back = fold(read, proof)
            out.append((r["doc_id"], h, own[s][-1][0], top[-1][0], H("".join(x for _, others in proof for x in others)), back, back == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 82, 243, 700, 729])
def test_paths_of_one_block(n):
    leaves = [H(str(i)) for i in range(n)]
    levels = tree(leaves)
    height = manifest.height_of(0, n)
    assert height == len(levels) - 1 and manifest.root_of(leaves, height) == levels[-1][0]
    assert list(manifest.paths(leaves, height)) == [path(levels, i) for i in range(n)]


def test_a_traversal_holds_few_nodes(monkeypatch):
    made = []
    init = manifest.Subtree.__init__
    monkeypatch.setattr(manifest.Subtree, "__init__", lambda self, *a: (made.append(self), init(self, *a))[1])
    leaves, most = [H(str(i)) for i in range(729)], 0
    for _ in manifest.paths(leaves, 6):
        live = made[-1:] if len(made) < 6 else made
        most = max(most, max(sum(map(len, t.nodes)) + sum(map(len, t.waiting)) for t in live))
    assert most <= 9 + 3 + 2 * 6


@pytest.mark.parametrize("which", ["documents", "odd", "none"])
def test_manifest(which, request, spark, monkeypatch):
    df = request.getfixturevalue(which)
    monkeypatch.setattr(manifest.C, "table", lambda *a: df)
    got = manifest.op11_manifest(spark, "")
    assert sorted(map(tuple, got.collect()), key=str) == brute(df.collect())


def test_several_rounds_of_blocks_and_a_hot_source(spark):
    random.seed(1)
    rows = [(i // 2 if i % 9 == 0 else i, "a\nb" * (i % 3), None, None if i % 50 == 1 else "hot" if i % 3 else f"s{i % 40}", i, "", "") for i in range(2500)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, sha string").repartition(7)
    got = manifest.manifest(df, levels=2).collect()
    want = {(x[0], x[1]): x for x in brute(df.collect())}
    assert len(got) == 2505
    assert all((r["subroot"], r["root"]) == want[r["doc_id"], r["leaf"]][2:4] and fold(r["leaf"], [(p["at"], p["others"]) for p in r["proof"]]) == r["root"] for r in got)
    assert sorted((r["doc_id"], H("".join(x for p in r["proof"] for x in p["others"]))) for r in got) == sorted((x[0], x[4]) for x in brute(df.collect()))


def test_sources_of_every_kind_stay_apart(spark):
    """Empty, null and names that begin alike are sources of their own; other columns may have any name."""
    rows = [(i, "t", None, s, 1, 2, 3, 4) for i, s in enumerate([None, "", "n", "s", "sn", "", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, pos int, digest int")
    got = manifest.manifest(df)
    assert sorted((r["doc_id"], r["source"], r["subroot"]) for r in got.collect()) == sorted((x[0], rows[x[0]][3], x[2]) for x in brute(df.collect()))
