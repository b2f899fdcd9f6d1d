"""Aliases and the log of a run."""

import random

import pytest
from pyspark.sql import functions as F

from capledger.operators import aliases as I
from capledger.run_log import RunLog, run_counters, run_report


def brute(pairs):
    to = {}
    for a, t in pairs:
        if a is not None and t is not None:
            to[a] = min(t, to.get(a, t))
    out = []
    for a in to:
        at, hops, seen = a, 0, []
        while at in to and to[at] != at and at not in seen:
            seen.append(at)
            at, hops = to[at], hops + 1
        if at in seen:
            out.append((a, None, None, "cycle", min(seen[seen.index(at) :])))
        else:
            out.append((a, at, hops, "resolved", None))
    return sorted(out)


@pytest.mark.parametrize("pairs", [
    [], [("a", "b")], [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], [("a", "a"), ("b", "a")], [("a", "b"), ("b", "a")],
    [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "a"), ("y", "x")], [("a", "z"), ("a", "b"), ("b", "c"), (None, "q"), ("q", None)],
    [(f"n{i:03}", f"n{i + 1:03}") for i in range(100)] + [(f"m{i:02}", f"m{(i + 1) % 37:02}") for i in range(37)] + [(f"t{i:02}", f"t{i + 1:02}" if i < 39 else "m05") for i in range(40)],
])
def test_aliases(spark, pairs):
    got = I.resolve_aliases(spark.createDataFrame(pairs, "alias string, target string"))
    assert sorted(map(tuple, got.collect())) == brute(pairs)


def test_random_alias_graphs(spark):
    rng = random.Random(4)
    pairs = [(f"k{i:03}", f"k{rng.randrange(400):03}") for i in range(300)]
    assert sorted(map(tuple, I.resolve_aliases(spark.createDataFrame(pairs, "alias string, target string")).collect())) == brute(pairs)


def test_look_up(spark):
    resolved = I.resolve_aliases(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "alias string, target string"))
    facts = spark.createDataFrame([("c", "1", 1), ("c", "0", 2), ("d", "3", 3)], "company string, code string, n int")
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("x",), ("none",), (None,)], "who string")
    got = I.look_up(names, "who", resolved, facts, "company", ["code", "n"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "c", "0", 2), ("b", "c", "0", 2), ("c", "c", "0", 2), ("d", "d", "3", 3), ("x", None, None, None), ("none", "none", None, None), (None, None, None, None)], key=str)


def test_counts_are_taken_while_writing(spark, tmp_path):
    log = RunLog(spark, "r")
    passes = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    with log.step("one") as step:
        out = step.write(spark.range(100).mapInArrow(once, "id long"), str(tmp_path / "one"), even=F.count_if(F.col("id") % 2 == 0))
        step.detail = "numbers"
    with log.step("two") as step:
        step.write(out.where("id < 10"), str(tmp_path / "two"))
    with log.step("bad", stop=False):
        raise ValueError("broken")
    log.skip("late", "BLOCKED")
    assert passes.value == 100
    log.save(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert {r["counter"]: r["total"] for r in run_counters(runs).collect()} == {"rows": 110, "even": 50}
    rows = {r["step"]: r for r in runs.collect()}
    assert rows["bad"]["status"] == "FAILED" and "ValueError: broken" in rows["bad"]["error"] and rows["one"]["seconds"] > 0
    text = run_report(runs).first()["text"]
    assert text.startswith("# Run r\nBegan: ") and "| even | 50 |\n| rows | 110 |" in text and "| 1 | one | DONE | " in text and text.endswith("| 4 | late | BLOCKED | 0.00 |  |  |")


def test_a_failing_step_ends_the_run_but_stays_in_the_log(spark):
    log = RunLog(spark, "r")
    with pytest.raises(ValueError), log.step("bad"):
        raise ValueError
    assert [(r[2], r[3]) for r in log.rows] == [("bad", "FAILED")]
