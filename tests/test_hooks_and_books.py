"""Parsers under a deadline, workbooks, and word lists in one pass."""

import os
import time
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from capledger.operators import words as H
from capledger.sources import hooks, workbook


def test_a_hanging_parser_costs_its_file_and_not_the_task(spark):
    def parser(content):
        if content == b"hang":
            time.sleep(600)
        if content == b"die":
            os._exit(3)
        if content == b"bad":
            raise ValueError("odd")
        return [str(len(content))]

    files = spark.createDataFrame([(f"{i}{c[:4].decode()}", c) for i in range(2) for c in (b"hang", b"good", b"die", b"good2", b"bad", b"x" * 5_000_000)], "path string, content binary").coalesce(1)
    began = time.time()
    got = {r["path"]: (r["status"], r["text"], r["error"]) for r in hooks.pdf_pages(files, parser, timeout=1).collect()}
    assert time.time() - began < 60
    assert got["0hang"] == got["1hang"] == ("timeout", None, "TimeoutError: longer than 1 s") and got["0die"] == ("failed", None, "RuntimeError: the parser died")
    assert got["1bad"] == ("failed", None, "RuntimeError: ValueError: odd") and got["1xxxx"] == ("parsed", "## 第1页\n\n5000000", None) and got["0good"][0] == "parsed"
    got = {r["path"]: (r["status"], r["error"]) for r in hooks.pdf_pages(files, parser, lambda c: ["y"], timeout=1).collect()}
    assert got["0hang"] == ("fallback", "TimeoutError: longer than 1 s") and got["0xxxx"] == ("parsed", None)


def test_a_child_that_does_not_read_is_killed_too():
    d = hooks.Deadline(lambda c: [], 0.5)
    d._serve = lambda pipe: time.sleep(600)
    with pytest.raises(TimeoutError):
        d(b"x" * 50_000_000)
    assert d.child is None


ODD = ["a<b>&\"'", " lead and trail ", "line\nbreak\ttab\rreturn", "\x00\x0b￿ control", "_x0041_ looks like an escape", "日本 😀", "", None]


def test_workbooks_read_back_as_they_were(spark, tmp_path):
    path = str(tmp_path / "books")
    flows = spark.createDataFrame([("甲", i, t, float(i) / 3 if i % 2 else None) for i, t in enumerate(ODD)] + [("乙/丙", 1, "x", 1.5), (None, 1, "gone", 0.0)], "company string, ord long, name string, amount double")
    log = spark.createDataFrame([("乙/丙", "s", 7), ("丁", "only here", 8)], "company string, status string, n int")
    wrote = workbook.write_workbooks({"flows": (flows, ["ord"]), "log & more": (log, ["n"])}, path).collect()
    assert sorted(map(tuple, wrote)) == [("丁", "丁.xlsx", 1), ("乙/丙", "乙_丙.xlsx", 2), ("甲", "甲.xlsx", len(ODD))]
    assert sorted(os.listdir(path)) == sorted(["_staging", "丁.xlsx", "乙_丙.xlsx", "甲.xlsx"]) and not os.listdir(f"{path}/_staging")
    got = workbook.read_workbooks(spark, path)
    mine = {r["number"]: r["cells"] for r in got.where("company = '甲'").collect()}
    for i, text in enumerate(ODD):
        want = {"ord": str(i)} | ({} if text is None else {"name": text}) | ({"amount": str(i / 3)} if i % 2 else {})
        assert mine[i + 1] == want
    assert {(r["sheet"], r["number"], tuple(sorted(r["cells"].items()))) for r in got.where("company = '丁'").collect()} == {("log & more", 1, (("n", "8"), ("status", "only here")))}
    for name in ("丁.xlsx", "甲.xlsx"):
        with zipfile.ZipFile(f"{path}/{name}") as z:
            assert z.testzip() is None and {"[Content_Types].xml", "_rels/.rels", "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml"} == set(z.namelist())
            for part in z.namelist():
                ElementTree.fromstring(z.read(part))


def test_a_full_sheet_goes_on_in_another(spark, tmp_path):
    df = spark.range(25).select(F.lit("c").alias("company"), "id")
    workbook.write_workbooks({"s": (df, ["id"]), "t": (df.where("id < 2"), ["id"])}, str(tmp_path / "b"), most_rows=11).collect()
    got = workbook.read_workbooks(spark, str(tmp_path / "b")).collect()
    assert sorted((r["sheet"], r["number"], int(r["cells"]["id"])) for r in got) == sorted([*((f"s ({i // 10 + 1})" if i >= 10 else "s", i % 10 + 1, i) for i in range(25)), ("t", 1, 0), ("t", 2, 1)])


def test_columns_are_named_as_sheets_do():
    assert [workbook._letters(i) for i in (0, 25, 26, 51, 52, 701, 702)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]
    assert all(workbook._column(f"{workbook._letters(i)}12") == i for i in range(1000))


def test_record_sheets_cut_evidence_and_show_orders(spark):
    flows = spark.createDataFrame([("c", 1, "e" * 900)], "company string, ord int, evidence_text string")
    snapshots = spark.createDataFrame([("c", 1, 3, "x")], "company string, ord int, snapshot_order int, evidence_text string")
    sheets = workbook.record_sheets(flows, snapshots, flows.drop("evidence_text"))
    assert sheets["flows"][0].first()["evidence_text"] == "e" * 500 and sheets["snapshots"][0].first()["snapshot_order"] == "t3"


@pytest.mark.parametrize("text", [None, "", "abc", "xabcab", "bcab", "😀ab😀abc", "aab"])
def test_word_hits(spark, text):
    lists = {"first": ("abc", "ab", "b"), "second": ("zz", "b", "ab", "ab"), "none": ("q",)}
    got = H.word_hits(spark.createDataFrame([(text, 1)], "text string, k int"), "text", lists).first()
    for name, words in lists.items():
        held = [(n, text.find(w) + 1) for n, w in enumerate(words, 1) if w in (text or "")]
        want = None if not held else (held[0][0], held[0][1], min(p for _, p in held), len(held))
        assert (None if got[name] is None else tuple(got[name])) == want
    assert got["k"] == 1


def test_empty_words_are_refused(spark):
    with pytest.raises(ValueError, match="everywhere"):
        H.word_hits(spark.range(1), "id", {"a": ("",)})
