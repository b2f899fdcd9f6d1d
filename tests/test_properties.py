"""Properties over random rows, many cases in one DataFrame."""

import random

from pyspark.sql import functions as F

from capledger.operators import crosscheck as X
from capledger.operators import records as R
from capledger.operators import select as S


def test_a_diff_has_a_row_for_each_holder_of_either_snapshot(spark):
    random.seed(1)
    held = {(c, s, h): random.choice([None, 0.0, 1.0, 2.0]) for c in range(40) for s in range(1, random.randint(2, 5)) for h in random.sample("abcdef", random.randint(1, 5))}
    df = spark.createDataFrame([(c, s, h, v) for (c, s, h), v in held.items()], "company int, step int, holder string, held double")
    got = X.diff_snapshots(df, ["company"], "holder", "held").withColumn("change", X.change_status(F.col("previous"), F.col("current"), F.col("was"), F.col("is"))).collect()
    steps = {(c, s) for c, s, _ in held}
    want = {(c, s, h) for c, s in steps if (c, s - 1) in steps for h in "abcdef" if (c, s, h) in held or (c, s - 1, h) in held}
    assert {(r["company"], r["step"], r["holder"]) for r in got} == want and len(got) == len(want)
    for r in got:
        was, is_ = (r["company"], r["step"] - 1, r["holder"]), (r["company"], r["step"], r["holder"])
        a, b = held.get(was), held.get(is_)
        told = "退出" if is_ not in held else "新增" if was not in held else "" if a is None or b is None else "稀释" if b < a else "保持" if b == a else "增持"
        assert r["change"] == told


def test_filling_adds_only_the_total_of_single_parties(spark):
    random.seed(2)
    events = [(i, random.choice([None, 0.0, 7.0]), [random.choice([None, 1.5, 2.0]) for _ in range(random.randint(1, 3))]) for i in range(300)]
    df = spark.createDataFrame(events, "i int, total double, amounts array<double>")
    each = df.select("i", "total", F.size("amounts").alias("n"), F.explode("amounts").alias("a")).select("i", R.fill_single(F.col("a"), F.col("total"), F.col("n")).alias("a"))
    got = {r["i"]: r["s"] for r in each.groupBy("i").agg(F.sum("a").alias("s")).collect()}
    for i, total, amounts in events:
        some = [a for a in amounts if a is not None] or ([total] if len(amounts) == 1 and total else [])
        assert got[i] == (sum(some) if some else None)


def test_keep_first_is_the_least_of_each_key_and_idempotent(spark):
    random.seed(3)
    rows = [(random.choice(["a", "b", None]), random.randint(0, 5), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, i int")
    once = S.keep_first(df, ["k"], ["o", "i"])
    want = {k: min((o, i) for kk, o, i in rows if kk == k) for k in {r[0] for r in rows}}
    assert {r["k"]: (r["o"], r["i"]) for r in once.collect()} == want
    assert sorted(map(tuple, S.keep_first(once, ["k"], ["o", "i"]).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_as_of_and_first_later_are_mirror_images(spark):
    random.seed(4)
    left = [(i, random.choice("ab"), random.randint(0, 50)) for i in range(200)]
    right = [(k, t, float(t * 10 + (k == "b"))) for k in "ab" for t in random.sample(range(50), 12)]
    ldf, rdf = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v double")
    before = {r["i"]: r["v"] for r in S.as_of(ldf, rdf, ["k"], "t", "v", "v").collect()}
    after = {r["i"]: r["v"] for r in S.first_later(ldf, rdf.withColumnRenamed("t", "u"), ["k"], "t", "u", ["u"], "v", "v").collect()}
    for i, k, t in left:
        assert before[i] == max(((u, v) for kk, u, v in right if kk == k and u <= t), default=(0, None))[1]
        assert after[i] == min(((u, v) for kk, u, v in right if kk == k and u >= t), default=(0, None))[1]
