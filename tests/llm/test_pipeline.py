"""The pipeline's stages, each against what its operator says of the same rows, and against a plain script."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import tokenizers

from capledger.llm import _common as C
from capledger.llm import exact_dedup, jaccard_join, mixing, packing


def test_stages_take_effect_in_order(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = first = C.table(spark, folder, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, C.materialize(stage(spark, docs, folder))
        seen[name] = before, docs
        if name != "packing":
            assert docs.columns == first.columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    before, after = seen["quality classifier"]
    labels = C.table(spark, folder, "labels")
    good = set(ids(labels.where("quality = 1").join(before, "doc_id", "left_semi")))
    assert len(good - set(ids(after))) <= 0.03 * len(good) and after.count() < before.count()
    before, after = seen["exact dedup"]
    assert ids(after) == ids(exact_dedup.exact_dedup(before).where("kept"))
    before, after = seen["n-gram Jaccard join"]
    assert ids(after) == ids(jaccard_join.jaccard_components(before, words=5, percent=80).where("doc_id = component_id"))
    before, after = seen["mixing"]
    mix = mixing.mix_sources(before).where("taken > 0").collect()
    assert ids(after) == sorted(r["doc_id"] for r in mix for _ in range(r["taken"] // r["size"]))
    before, after = seen["packing"]
    assert after.agg({"length": "sum"}).first()[0] == packing.pack(before).agg({"length": "sum"}).first()[0]
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, after.collect()))


def test_registered_queries(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_against_a_plain_script(spark):
    """What stays of documents, and how often, worked out here from the texts; the classifier's verdicts are taken as they are."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = C.table(spark, folder, "documents")
    docs = C.materialize(corpus_pipeline.classify(spark, docs, folder))
    rows = {r["doc_id"]: r for r in docs.collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", r["text"].encode().lower().decode()) for i, r in rows.items()}
    last = {}
    for i in sorted(rows):
        last[rows[i]["text"]] = i
    left = set(last.values())
    docs = C.materialize(corpus_pipeline.drop_exact_copies(spark, docs, folder))
    assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(left)
    sets = {i: {tuple(words[i][k : k + 5]) for k in range(max(1, len(words[i]) - 4))} if words[i] else set() for i in left}
    up = {i: i for i in left}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(left), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    left = {i for i in left if up[i] == i}
    docs = C.materialize(corpus_pipeline.drop_near_copies(spark, docs, folder))
    assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(left)
    # Targets by water-filling, then one queue by virtual finish time up to the budget.
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i]["text"])) for i in left}
    source = Counter()
    for i in left:
        source[rows[i]["source"]] += size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(source))}
    target, open_, rest = {}, set(source), float(sum(source.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * source[s]}
        for s in over or open_:
            target[s] = 3.0 * source[s] if over else level * weight[s]
        rest -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    place = {i: hashlib.md5(f"{i}:{hashlib.md5(rows[i]['text'].encode()).hexdigest()}".encode()).hexdigest() for i in left}
    upto, queue = Counter(), []
    for i in sorted(left, key=place.get):
        s = rows[i]["source"]
        upto[s] += size[i]
        queue += [((source[s] * e + upto[s]) / target[s], "s" + s, e, place[i], i) for e in range(3) if size[i]]
    budget, taken = sum(size.values()), Counter()
    for item in sorted(queue):
        budget -= size[item[-1]]
        if budget < 0:
            break
        taken[item[-1]] += 1
    docs = C.materialize(corpus_pipeline.mix(spark, docs, folder))
    assert Counter(r["doc_id"] for r in docs.select("doc_id").collect()) == taken
    # Every id of every copy lies in one piece, each sequence is full or a power of two long, and its pieces leave no gap.
    tokenizer = tokenizers.Tokenizer.from_file(str(packing.public_tokenizers.path("word_bpe_49k.json")))
    tokens = {i: len(tokenizer.encode(rows[i]["text"], add_special_tokens=False).ids) + 1 for i in taken}
    pieces = corpus_pipeline.pack(spark, docs, folder).collect()
    spans, sequences = Counter(), {}
    for p in pieces:
        spans.update((p["doc_id"], k) for k in range(p["start"], p["start"] + p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert spans == Counter({(i, k): n for i, n in taken.items() for k in range(tokens[i])})
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0
