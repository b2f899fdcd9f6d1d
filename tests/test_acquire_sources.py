"""The announcement source and the download sink over services that note what they are asked for."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from capledger.sources import announcements as N
from capledger.sources import download as D

DAYS = ["2025-01-01", "2025-01-02", "2025-01-02", "2025-02-01", "2025-03-01"]


@pytest.fixture
def notes(tmp_path):
    (tmp_path / "days").write_text("\n".join(DAYS))
    return tmp_path


def asked(notes):
    path = notes / "asked"
    out = sorted(tuple(x.split()) for x in path.read_text().splitlines()) if path.exists() else []
    path.unlink(missing_ok=True)
    return out


def options(notes, **more):
    return {"service": "fake_services:Noting", "notes": str(notes), "size": "2", "wait": "0"} | more


def test_only_asked_codes_days_and_pages_are_read(spark, notes):
    df = N.announcements(spark, ["1", "2", "3"], **options(notes)).where("stock_code IN ('1', '2') AND announcementDate >= '2025-01-02'").where(F.col("stock_code") != "2")
    assert [(r["stock_code"], r["announcementDate"], r["ord"]) for r in df.orderBy("ord").collect()] == [("1", "2025-01-02", 1), ("1", "2025-01-02", 2), ("1", "2025-02-01", 3), ("1", "2025-03-01", 4)]
    assert {x[0] for x in asked(notes)} <= {"1", "2"}
    df = N.announcements(spark, ["1", "2"], **options(notes)).where("stock_code = '1' AND announcementDate > '2025-01-01' AND announcementDate < '2025-03-01'")
    assert df.count() == 3
    # Strict bounds are asked for with the day itself; the fifth hit is on the third page, and there is no fourth.
    assert asked(notes) == [("1", str(p), "2025-01-01", "2025-03-01") for p in (1, 2, 3)]
    assert N.announcements(spark, ["1"], **options(notes)).where("stock_code = '7'").count() == 0 and asked(notes) == []


def test_a_codes_pages_are_dealt_to_tasks(spark, notes):
    df = N.announcements(spark, ["1"], **options(notes, pagesPerTask="1", pages="4"))
    assert df.rdd.getNumPartitions() == 4 and sorted(r["ord"] for r in df.collect()) == [1, 2, 3, 4, 5]
    assert N.announcements(spark, ["1", "2", "3"], **options(notes, rangesPerTask="2")).rdd.getNumPartitions() == 2


def test_a_page_that_fails_is_tried_again_then_reported_or_raised(spark, notes):
    got = N.announcements(spark, ["9"], **options(notes, attempts="3", pages="2", onError="report")).collect()
    assert [(r["ord"], r["announcementTitle"], r["error"]) for r in got] == [(1, None, "ConnectionError: down"), (3, None, "ConnectionError: down")]
    assert len(asked(notes)) == 6
    with pytest.raises(Exception, match="down"):
        N.announcements(spark, ["9"], **options(notes, attempts="1")).collect()


def test_waits_double(monkeypatch):
    waits = []
    monkeypatch.setattr(N.time, "sleep", waits.append)
    s = N._Search({"attempts": "9", "wait": "1"})
    with pytest.raises(ZeroDivisionError):
        s.ask(lambda *a: 1 / 0, "1", 1, None, None)
    assert waits == [1, 2, 4, 8, 16, 32, 60, 60]


def test_a_stream_resumes_after_the_last_day(spark, notes):
    seen = []

    def run():
        stream = N.new_announcements(spark, ["1"], **options(notes, since="2025-01-02"))
        query = stream.writeStream.foreachBatch(lambda df, n: seen.append(sorted(r["announcementDate"] for r in df.collect()))).option("checkpointLocation", str(notes / "ck")).trigger(once=True).start()
        query.awaitTermination()

    run()
    assert seen == [DAYS[1:]] and {x[2:] for x in asked(notes)} == {("2025-01-02", "2025-03-01")}
    run()
    assert len(seen) == 1 or seen[1:] == [[]]
    (notes / "days").write_text("\n".join([*DAYS, "2025-03-05", "2025-04-01"]))
    asked(notes)
    run()
    assert seen[-1] == ["2025-03-05", "2025-04-01"] and {x[2:] for x in asked(notes)} == {("2025-03-02", "2025-04-01")}


# ---------------------------------------------------------------- downloads


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file() and "_log" not in p.parts and not p.name.endswith(".crc")}


def test_download_statuses_and_reruns(spark, tmp_path):
    rows = spark.createDataFrame([(f"http://h/{k}", f"{k}.pdf") for k in (1, 5, 7, 11)] + [("x", "a/b"), ("x", None)], "url string, file_name string")
    go = lambda mode: {(r["file_name"], r["status"], r["attempts"], r["error"]) for r in D.download(rows, str(tmp_path / "d"), "capledger.plans.stand_ins:SupplierFiles", mode=mode, table="/root/testdata/sf0.001/supplier.parquet", attempts="3", wait="0").collect()}
    first = {("1.pdf", "success", 1), ("5.pdf", "success", 3), ("7.pdf", "not_found", 1), ("11.pdf", "failed", 3), ("a/b", "failed", 0), (None, "failed", 0)}
    assert {x[:3] for x in go("append")} == first and set(files(tmp_path / "d")) == {"1.pdf", "5.pdf"}
    assert {x[:2] for x in go("append")} >= {("1.pdf", "exists"), ("5.pdf", "exists")}
    assert len(D.download_log(spark, str(tmp_path / "d")).collect()) == 12


def test_back_off_ends_at_404(monkeypatch):
    waits = []
    monkeypatch.setattr(D.time, "sleep", waits.append)
    monkeypatch.setattr(D.random, "random", lambda: 0.5)
    w = D._Writer({"path": "/tmp", "wait": "1"}, True)
    assert w._one(None, "", "", lambda u: (403, []), "u", "n")["error"] == "code 403" and waits == [1.5, 2.5, 4.5, 8.5]
    assert w._one(None, "", "", lambda u: (404, []), "u", "n")["status"] == "not_found" and len(waits) == 4


def run_apart(tmp_path, fetch, master):
    """In a session of its own, as a master with retries is needed."""
    script = f"""
import sys
from capledger.session import session
from capledger.sources import download as D
spark = session("{master}", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
spark.sparkContext.setLogLevel("OFF")
rows = spark.createDataFrame([(str(i), f"{{i}}.pdf") for i in range(4)], "url string, file_name string").coalesce(1)
print(sorted((r["file_name"], r["status"]) for r in D.download(rows, {str(tmp_path / "d")!r}, "fake_services:{fetch}", notes={str(tmp_path)!r}).collect()))
"""
    here = Path(__file__).resolve().parent
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(here.parent), str(here)])}
    return subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=300)


def test_a_task_killed_mid_way_leaves_no_half_file(tmp_path):
    out = run_apart(tmp_path, "dying", "local[2,3]")
    assert (tmp_path / "died").exists() and "('2.pdf', 'success')" in out.stdout, out.stderr[-2000:]
    assert files(tmp_path / "d") == {f"{i}.pdf": b"%PDF-" + b"x" * 1000 + str(i).encode() for i in range(4)}


def test_a_job_that_fails_leaves_no_file(tmp_path):
    out = run_apart(tmp_path, "failing", "local[2]")
    assert out.returncode and files(tmp_path / "d") == {}
