"""Queries over tables that come in several files and many groups, where small tables don't show a difference."""

import datetime
import json
import random
import re
import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from capledger.operators import profile as N
from capledger.operators import segment as G
from capledger.plans import pipelines, registry
from capledger.sources import hooks, readers
from capledger.streaming import revalidate as V


@pytest.fixture(scope="module")
def scattered_lines(tmp_path_factory):
    """Lines of 3000 orders, dealt over eight files, and half of the orders' totals end in .x1 or .x9."""
    random.seed(7)
    root = tmp_path_factory.mktemp("lines")
    (root / "lineitem.parquet").mkdir()
    lines = []
    for order in range(3000):
        cents = [random.randint(100_000, 9_000_000) for _ in range(random.randint(2, 7))]
        if order % 2:
            cents[-1] += random.choice((1, 9)) - sum(cents) % 10
        lines += [(order, c / 100, random.randint(1, 50), random.choice("ANR")) for c in cents]
    random.shuffle(lines)
    for i in range(8):
        key, price, quantity, flag = zip(*lines[i::8], strict=True)
        pq.write_table(pa.table({"l_orderkey": key, "l_extendedprice": price, "l_quantity": [float(q) for q in quantity], "l_returnflag": flag}), root / "lineitem.parquet" / f"part-{i}.parquet")
    return str(root)


def one_thread(root, name):
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{root}/lineitem.parquet/*.parquet'")
    return con.sql(registry.oracle_sql()[name]).fetchall()


def test_f5_totals_are_added_in_the_order_of_rows(spark, scattered_lines):
    got = registry.queries()["q10_total_check"](spark, scattered_lines).collect()
    assert sorted((r["l_orderkey"], r["held"], r["status"]) for r in got) == sorted(one_thread(scattered_lines, "q10_total_check"))


def test_f6_verdicts_come_from_the_same_totals(spark, scattered_lines):
    got = registry.queries()["q18_verdict_rollup"](spark, scattered_lines).collect()
    assert sorted((r["l_orderkey"], r["issues"], r["verdict"]) for r in got) == sorted(one_thread(scattered_lines, "q18_verdict_rollup"))


def test_f7_events_of_customers_with_few_orders(spark, tmp_path):
    """An order of remainder 0 by itself has one year and an ordinal in its line."""
    keys = list(range(0, 120, 6)) + [1000, 1001, 1002, 1003, 1004]
    customers = [k // 6 if k < 1000 else 777 for k in keys]
    pq.write_table(pa.table({"o_orderkey": keys, "o_custkey": customers, "o_orderdate": [datetime.datetime(1995, 1 + k % 12, 3) for k in keys]}), tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    found = con.sql(registry.oracle_sql()["q71_events_batch"])
    got = registry.queries()["q71_events_batch"](spark, str(tmp_path)).select(*found.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall())) and got


def test_f7_the_operator_keeps_its_cut_before_ordinals(spark):
    year, both = r"(?=\d{4}\s*[年.])", r"(?=(?:\d{4}\s*[年.]|(?:第[一二三四五六七八九十\d]+次)))"
    texts = ["1995年1月第一次增资。第二次增资。", "头。1995年1月，第二次增资", "1995年。1996年。1997年第三次", "第一次第2次", "x1995年y1996年第一次", "没有"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("text", G.event_segments(F.col("text")).alias("all"), G.event_segments(F.col("text"), ordinals=False).alias("years")).collect():
        pieces = re.split(year, r["text"])
        assert [p for p in r["years"] if p] == [p for p in pieces if p]
        want = pieces if len(pieces) >= 3 else re.split(both, r["text"])
        assert [p for p in r["all"] if p] == [p for p in want if p]


def test_f4_hanging_parsers_of_a_task_wait_side_by_side(spark):
    def parser(content):
        if int(content) % 2:
            time.sleep(600)
        return [content.decode()]

    files = spark.range(60).selectExpr("cast(id AS string) AS path", "cast(cast(id AS string) AS binary) AS content").coalesce(1)
    began = time.time()
    got = {int(r["path"]): r["status"] for r in hooks.pdf_pages(files, parser, timeout=1).collect()}
    assert time.time() - began < 20 and got == {i: "timeout" if i % 2 else "parsed" for i in range(60)}


def test_f4_parsers_that_use_their_cpu_run_one_at_a_time(spark):
    def parser(content):
        began = time.time()
        while time.time() < began + 0.8:
            sum(range(1000))
        return [f"{began} {time.time()}"]

    files = spark.range(4).selectExpr("cast(id AS string) AS path", "cast(cast(id AS string) AS binary) AS content").coalesce(1)
    spans = sorted(tuple(map(float, r["text"].split("\n\n")[1].split())) for r in hooks.pdf_pages(files, parser, timeout=5).collect())
    assert len(spans) == 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_f1_a_file_in_parts_is_checked_as_the_whole(spark, tmp_path):
    flow = {"record_type": "subscription_flow", "company_name": "公司", "stock_code": "688001", "source_page": "1", "subscription_date": "2020-01", "price_per_share": "2", "shares_subscribed": "100", "evidence_text": "原文" * 12}
    lines = [json.dumps(flow | {"subscriber_name": f"h{i}", "amount_subscribed": str(150 + i)}, ensure_ascii=False) if i % 7 else "" for i in range(90)]
    parts = [(c, d, n, "\n".join(lines[i : i + 4])) for c, d in (("a", 1), ("b", 0), ("b", 1)) for n, i in enumerate(range(0, 90, 4))]
    random.shuffle(parts)

    def deliver(n, rows):
        spark.createDataFrame(rows, "company string, day int, part long, text string").repartition(3).write.parquet(f"{tmp_path}/in/{n}")
        files = spark.readStream.schema("company string, day int, part long, text string").parquet(f"{tmp_path}/in/*")
        return V.revalidate(spark, files.select("company", F.col("day").cast("string").alias("path"), F.timestamp_seconds("day").alias("modified"), "part", "text"), f"{tmp_path}/out", f"{tmp_path}/state", partitions=2)

    assert deliver(1, parts) == 2
    want = pipelines.validate_records(readers.records(readers.numbered(spark.createDataFrame([("a", "\n".join(lines)), ("b", "\n".join(lines))], "company string, text string"))))
    for name in ("schema_log", "cross_log"):
        columns = want[name].columns
        assert sorted(map(str, V.latest(spark, f"{tmp_path}/out", name).select(columns).collect())) == sorted(map(str, want[name].collect())), name
    # The same text as one row, and cut elsewhere, is nothing new.
    assert deliver(2, [("a", 2, 0, "\n".join(lines)), ("b", 2, 1, "\n".join(lines[10:])), ("b", 2, 0, "\n".join(lines[:10]))]) == 0


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_f3_documents_are_parsed_once_for_all_parts_of_a_profile(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    docs = spark.createDataFrame([("a", '{"financing_events": []}'), ("b", '{"financing_events": [{"date": null, "participants": []}]}'), ("c", "{")], "company string, raw string")
    found = N.profile(docs)
    assert parses(found) < 20
    assert sorted((r["company"], r["path"]) for r in found.collect()) == [("a", "$"), ("a", "$.financing_events"), ("b", "$"), ("b", "$.financing_events[0].date"), ("b", "$.financing_events[0].participants")]


def test_f9_an_index_reads_the_profile_s_documents(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    docs = N.parsed(spark.createDataFrame([("a", '{"financing_events": []}'), ("c", "{")], "company string, raw string"))
    index = N.summary_index(docs, N.profile(docs))
    assert "Relation" in index._jdf.queryExecution().optimizedPlan().toString() and parses(index) < 25
    assert sorted((r["company"], r["shape"], r["events"], r["critical"]) for r in index.collect()) == [("a", "basic", 0, 2), ("c", "invalid", 0, 0)]
