"""Readers, sinks, hooks and incremental runs on files in a temporary folder."""

import json

from pyspark.sql import functions as F

from capledger.functions import text as T
from capledger.plans import pipelines, registry
from capledger.sources import hooks, readers, sinks
from capledger.streaming import incremental


def test_csv_by_name_with_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿stock_code,company_short_name,ipo_year\n000001,甲,2025\n000002, ,x\n", encoding="utf-8")
    got = readers.company_list(spark, str(tmp_path / "a.csv"))
    assert [(r["stock_code"], r["company_short_name"], r["ipo_year"], r["notes"]) for r in got.collect()] == [("000001", "甲", 2025, None)]


def test_jsonl_numbers_lines_that_are_not_blank(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"record_type": "a"}\n\n{"record_type": "b"}\nbroken\n')
    got = readers.records(readers.jsonl(spark, str(tmp_path)))
    assert sorted((r["company"], r["line"], r["record_type"]) for r in got.collect() if r["line"] < 3) == [("c", 1, "a"), ("c", 2, "b")]


def test_texts_of_a_company_in_order(spark, tmp_path):
    for name, body in (("甲2.md", "二"), ("甲1.md", "一"), (".x.md", "no"), ("12.md", "no key")):
        (tmp_path / name).write_text(body, encoding="utf-8")
    got = readers.company_texts(readers.texts(spark, str(tmp_path)), T.company_key).collect()
    assert [tuple(r) for r in got] == [("甲", "一\n\n二\n\n")]


def test_tolerant_texts_and_listing(spark, tmp_path):
    (tmp_path / "688001.txt").write_bytes("好".encode() + b"\xff" + b"x")
    (tmp_path / "other.txt").write_bytes(b"y")
    assert {r["file_name"]: r["text"] for r in readers.tolerant_texts(spark, str(tmp_path)).collect()}["688001.txt"] == "好x"
    assert [r["file_name"] for r in readers.listing(spark, str(tmp_path), "688").collect()] == ["688001.txt"]


def test_preferred_files(spark, tmp_path):
    for folder, name in (("a", "x_structured.json"), ("a", "x_basic.json"), ("b", "y_basic.json"), ("week2", "z_basic.json")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("{}")
    got = readers.preferred_files(readers.listing(spark, str(tmp_path)), ("structured", "basic"))
    assert sorted((r["company"], r["file_name"]) for r in got.collect()) == [("a", "x_structured.json"), ("b", "y_basic.json")]


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([("1", 2, "b", None), ("1", 1, "a", "x")], "stock_code string, ord long, v string, n string")
    sinks.jsonl(log, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").rglob("*.json") for x in p.read_text().splitlines()]
    assert lines == [{"v": "a", "n": "x"}, {"v": "b", "n": None}]
    assert json.loads(sinks.merged_json(log.select("v", "n"), "v").first()["json"])["a"] == {"n": "x"}
    entries = spark.createDataFrame([("c", 2, "二"), ("c", 1, "一")], "company string, entry_no int, entry string")
    assert sinks.contents_report(entries).first()["text"] == "# c\n\n- 一\n- 二"
    assert len(sinks.padded_company_list(spark.createDataFrame([("1",)], "stock_code string")).columns) == 20


def test_manifest_holds_both_sides(spark):
    companies, downloads = (spark.createDataFrame([(c,)], f"{n} string") for n, c in (("stock_code", "1"), ("path", "x")))
    assert json.loads(sinks.manifest(companies, downloads, ("a", "b")).first()["json"]) == {"companies": [{"stock_code": "1"}], "downloads": [{"path": "x"}], "exclusions": ["a", "b"]}


def test_pdf_hook_falls_back_and_reports(spark):
    files = spark.createDataFrame([("a", b"x"), ("b", b"y"), ("c", b"z")], "path string, content binary")

    def parser(content):
        if content != b"x":
            raise ValueError
        return ["one", " ", "three"]

    def fallback(content):
        return ["rescued"] if content == b"y" else [][1]

    got = {r["path"]: (r["status"], r["text"]) for r in hooks.pdf_pages(files, parser, fallback).collect()}
    assert got == {"a": ("parsed", "## 第1页\n\none\n\n## 第3页\n\nthree"), "b": ("fallback", "## 第1页\n\nrescued"), "c": ("failed", None)}


def test_prompt_keeps_braces(spark):
    docs = spark.createDataFrame([("c", "body {x}")], "company string, text string")
    prompts = hooks.render_prompt(docs, 'reply {"a": 1} for {text}')
    assert prompts.first()["prompt"] == 'reply {"a": 1} for body {x}'
    assert hooks.ask(prompts, lambda p: str(len(p))).first()["reply"] == str(len('reply {"a": 1} for body {x}'))


def test_announcement_source_pages_until_all_are_seen(spark):
    spark.dataSource.register(hooks.Announcements)
    got = spark.read.format("announcements").option("codes", "1,2").option("client", "fake_search:search").option("size", "2").load()
    assert sorted((r["stock_code"], r["ord"]) for r in got.collect()) == [("1", 1), ("1", 2), ("1", 3), ("2", 1)]


def test_incremental_runs_see_new_files_only(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    run = lambda: incremental.process_new(spark, source, "k int, v string", lambda d: d, sink, checkpoint, key=["k"])
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(source)
    assert run() == 2 and run() == 0
    spark.createDataFrame([(2, "again"), (3, "c")], "k int, v string").write.mode("append").parquet(source)
    assert run() == 1
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(sink).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_document_pipelines(spark, tmp_path):
    body = "# 第一节 概览\n" + "x" * 150 + "\n# 第二节 历史沿革\n于2015年3月完成增资，" + "各方签署了协议并办理完成了工商变更登记手续。" * 6 + "\n# 第三节 其他\n" + "y" * 150
    (tmp_path / "688001_某某_招股书_正式稿.md").write_text(body, encoding="utf-8")
    files = readers.texts(spark, str(tmp_path))
    first = pipelines.documents(files)
    assert first["contents"].count() == 3 and [r["title"] for r in first["candidates"].collect()] == ["第二节 历史沿革"]
    batch = pipelines.market_batch(files)
    assert [(r["company"], r["total_chapters"], r["financing_chapters_found"], r["financing_events"]) for r in batch["statistics"].collect()] == [("688001_某某", 3, 1, 1)]
    assert [(r["date"], r["event_type"], r["source_chapter"]) for r in batch["events"].collect()] == [("2015-03", "增资", "第二节 历史沿革")]


def test_every_query_has_sql_of_its_name():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 45


def test_results_do_not_depend_on_partitions(spark):
    from capledger.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    for name in ("q01_keep_first_by_key", "q13_snapshot_diff", "q15_asof_month", "q16_first_later_match", "q26_sections"):
        seen = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = Q.QUERIES[name](spark, sf)
            seen.append(df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.count(F.lit(1))).first())
        assert seen[0] == seen[1], name


def test_command_line(spark, tmp_path):
    from capledger.__main__ import main

    (tmp_path / "in").mkdir()
    record = {"record_type": "subscription_flow", "company_name": "公司", "stock_code": "688001", "source_page": "1", "subscription_date": "2020-01", "subscriber_name": "甲", "evidence_text": "原文" * 12}
    (tmp_path / "in" / "c.jsonl").write_text(json.dumps(record, ensure_ascii=False), encoding="utf-8")
    assert main(["validate", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    (tmp_path / "in" / "d.jsonl").write_text(json.dumps(record | {"source_page": ""}, ensure_ascii=False), encoding="utf-8")
    assert main(["validate", str(tmp_path / "in"), str(tmp_path / "out")]) == 1
    log = spark.read.option("header", True).csv(str(tmp_path / "out" / "schema_log"))
    assert log.where("company = 'd' and check_type = 'required_source_page'").count() == 1
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "甲.md").write_text("# 历史沿革\n" + "x" * 150, encoding="utf-8")
    assert main(["documents", str(tmp_path / "texts"), str(tmp_path / "d")]) == 0 and main(["batch", str(tmp_path / "texts"), str(tmp_path / "b")]) == 0
    (tmp_path / "json" / "k").mkdir(parents=True)
    (tmp_path / "json" / "k" / "x.json").write_text('{"company": {}, "financing_events": []}')
    assert main(["verify", str(tmp_path / "json" / "*"), str(tmp_path / "v")]) == 0 and main(["profile", str(tmp_path / "json" / "*"), str(tmp_path / "p")]) == 0
