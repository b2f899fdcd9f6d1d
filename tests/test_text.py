"""Column functions against hand-computed answers."""

import pytest
from pyspark.sql import functions as F

from capledger.functions import patterns as P
from capledger.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


CASES = [
    ("于2015年3月增资", T.year_month, "2015-03"),
    ("２０１５年　３月", T.year_month, "２０１５-0３"),
    ("无日期", T.year_month, None),
    ("注册资本增加至1,234.5万元", T.amount, "1,234.5万元"),
    ("无", T.amount, None),
    ("估值约 3,000 万美元及 500万元", T.amount_batch, "3,000 万美元"),
    ("价格为8.33元/股", T.unit_price, 8.33),
    ("12 万元和 1,234.5 万 元", T.amounts, [12.0, 1234.5]),
    ("甲乙有限公司、丙丁资本，甲乙有限公司", lambda c: T.participants(c, P.PARTY, 8), ["甲乙有限公司", "丙丁资本"]),
    ("![i](u)<b>a</b>```x\ny```## 标题 ", T.clean, "a标题"),
    ("a\nb\n\nc", T.join_lines, "ab\n\nc"),
    ("2025/1/6", T.file_date, "20250106"),
    ("2025-11", T.file_date, "20251101"),
    ("待定/x", T.file_date, "待定x"),
    ("1,234.5万", T.clean_number, 1234.5),
    ("0", T.clean_number, None),
    ("约 6.28 %", T.ratio, "6.28%"),
    ("2015-03-01", T.month_key, "2015-03"),
    ("early", T.month_key, "early"),
    ("688001_某某_招股书_正式稿_20250106", T.company_key_coded, "688001_某某"),
    ("某某_12", T.company_key_coded, "某某"),
    ("招股书某某2md", lambda c: T.company_key(c, "招股书"), "某某"),
    ("123", T.company_key, None),
    ("/a/b.pdf", lambda c: T.absolute_url(c, "https://x.org/"), "https://x.org/a/b.pdf"),
    ("增资并吸收合并", T.event_type, "增资"),
    ("股份转让", lambda c: T.event_type(c, P.EVENT_RULES_BATCH), "股权转让"),
    ("2015年1月 2016.2 2017/3", T.date_tokens, ["2015年1月", "2016.2", "2017/3"]),
    ("abcdefghij 42 klmnopqrst", lambda c: T.window_around(c, "[0-9]+", 3, 4, 100), "ij 42 klm"),
]


@pytest.mark.parametrize(("value", "f", "want"), CASES, ids=range(len(CASES)))
def test_function(spark, value, f, want):
    assert one(spark, value, f) == want


def test_holder_type_words_of_the_name_win(spark):
    rows = [("某员工持股平台", "PE"), ("张三", "自然人"), ("某投资(员工)", "VC"), ("某某", None)]
    got = spark.createDataFrame(rows, "n string, d string").select(T.holder_type(F.col("n"), F.col("d")).alias("t")).collect()
    assert [r["t"] for r in got] == ["员工持股平台", "自然人", "外部PE", "其他"]


def test_reply_json_drops_the_fence(spark):
    assert one(spark, '```json\n{"a": 1}\n```', lambda c: T.reply_json(c, "a int"))["a"] == 1


def test_snapshot_label_and_founder(spark):
    got = spark.createDataFrame([("增资", "A轮", 0), ("增资", "未披露", 1), ("增资", None, 2)], "e string, r string, o int").select(T.snapshot_label(F.col("e"), F.col("r")), T.founder(F.col("o"))).collect()
    assert [tuple(r) for r in got] == [("增资后（A轮）", "yes"), ("增资后", "unknown"), ("增资后", "unknown")]
