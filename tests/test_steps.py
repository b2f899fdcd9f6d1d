"""Graphs of steps: what runs, what is skipped, and what a failure blocks; the command line over them."""

import time

import pytest
from pyspark.sql import functions as F

from capledger.__main__ import main
from capledger.plans.steps import Runner, Step, in_order
from capledger.run_log import RunLog


@pytest.fixture
def steps(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).write.parquet(source)
    return [
        Step("sums", lambda made: made["even"].agg(F.sum("id").alias("s")), ("even",)),
        Step("even", lambda _: spark.read.parquet(source).where("id % 2 = 0"), inputs=(source,), counts={"most": F.max("id")}),
        Step("odd", lambda _: spark.read.parquet(source).where("id % 2 = 1"), inputs=(source,)),
    ]


def go(spark, steps, folder, **more):
    log = RunLog(spark, "r")
    ok = Runner(spark, steps, str(folder), **more).run(log)
    return ok, {r[2]: (r[3], r[7], r[6]) for r in log.rows}


def test_a_second_run_does_nothing(spark, steps, tmp_path):
    out = tmp_path / "out"
    assert Runner(spark, steps, str(out)).dry_run() == ["even: run (new)", "sums: run (new)", "odd: run (new)"] and not out.exists()
    assert go(spark, steps, out) == (True, {"even": ("DONE", "new", {"rows": 5, "most": 8}), "sums": ("DONE", "new", {"rows": 1}), "odd": ("DONE", "new", {"rows": 5})})
    assert spark.read.parquet(str(out / "sums")).first()["s"] == 20
    before = {p: p.stat().st_mtime_ns for p in out.rglob("*") if p.is_file()}
    assert go(spark, steps, out) == (True, {n: ("SKIPPED", "unchanged", {}) for n in ("even", "sums", "odd")})
    assert before == {p: p.stat().st_mtime_ns for p in out.rglob("*") if p.is_file()}


def test_changed_inputs_versions_and_lost_tables_run_again_with_what_needs_them(spark, steps, tmp_path):
    out = tmp_path / "out"
    go(spark, steps, out)
    spark.range(10, 13).write.mode("append").parquet(str(tmp_path / "in"))
    assert Runner(spark, steps, str(out)).dry_run() == ["even: run (changed)", "sums: run (after even)", "odd: run (changed)"]
    go(spark, steps, out)
    assert spark.read.parquet(str(out / "sums")).first()["s"] == 42
    newer = [Step(s.name, s.make, s.needs, s.inputs, "2" if s.name == "sums" else "1") for s in steps]
    assert Runner(spark, newer, str(out)).dry_run() == ["even: skip (unchanged)", "sums: run (changed)", "odd: skip (unchanged)"]
    (out / "odd" / "_SUCCESS").unlink()
    assert Runner(spark, steps, str(out)).dry_run() == ["even: skip (unchanged)", "sums: skip (unchanged)", "odd: run (new)"]


def test_chosen_steps_bring_what_they_need(spark, steps, tmp_path):
    assert Runner(spark, steps, str(tmp_path / "o"), ["sums"]).dry_run() == ["even: run (new)", "sums: run (new)"]
    assert Runner(spark, steps, str(tmp_path / "o"), ["odd"], force=True).dry_run() == ["odd: run (forced)"]
    with pytest.raises(ValueError, match="no step x; there are sums, even, odd"):
        Runner(spark, steps, str(tmp_path / "o"), ["x"])


def test_a_failure_blocks_what_needs_it_and_is_tried_again(spark, steps, tmp_path):
    broken = [Step("even", lambda _: spark.range(3).withColumn("x", F.raise_error(F.lit("no"))), inputs=steps[1].inputs), steps[0], steps[2]]
    ok, got = go(spark, broken, tmp_path / "out")
    assert not ok and {n: x[0] for n, x in got.items()} == {"even": "FAILED", "sums": "BLOCKED", "odd": "DONE"} and got["sums"][1] == "even failed"
    assert go(spark, steps, tmp_path / "out")[1] == {"even": ("DONE", "new", {"rows": 5, "most": 8}), "sums": ("DONE", "new", {"rows": 1}), "odd": ("SKIPPED", "unchanged", {})}


def test_circles_are_refused():
    with pytest.raises(ValueError, match="a > b > a"):
        in_order([Step("a", None, ("b",)), Step("b", None, ("a",))])


def test_command_line(spark, tmp_path, capsys):
    source, out = tmp_path / "texts", str(tmp_path / "out")
    source.mkdir()
    (source / "688001_某某_招股书_正式稿.md").write_text("# 第一节 概览\n" + "x" * 150 + "\n# 第二节 历史沿革\n于2015年3月完成增资，" + "各方签署了协议并办理完成了工商变更登记手续。" * 6, encoding="utf-8")
    run = lambda *more: (main(["batch", str(source), out, *more]), capsys.readouterr().out)
    code, said = run("--dry-run")
    assert code == 0 and said.splitlines() == [f"{n}: run (new)" for n in ("sections", "events", "timeline", "statistics", "report")] and not (tmp_path / "out").exists()
    code, said = run("--steps", "events")
    assert code == 0 and "| 2 | events | DONE |" in said and not (tmp_path / "out" / "report").exists()
    code, said = run()
    assert "| 1 | sections | SKIPPED |" in said and "| 5 | report | DONE |" in said
    assert spark.read.parquet(f"{out}/statistics").first()["financing_events"] == 1
    code, said = run("--dry-run")
    assert {x.split(": ")[1] for x in said.splitlines()} == {"skip (unchanged)"}
    time.sleep(0.01)
    (source / "688002_甲乙_招股书_正式稿.md").write_text("# 第一节 历史沿革\n" + "x" * 150, encoding="utf-8")
    code, said = run()
    assert said.count("DONE") == 5 and spark.read.parquet(f"{out}/statistics").count() == 2 and spark.read.parquet(f"{out}/runs").select("run_id").distinct().count() == 3
    with pytest.raises(SystemExit):
        main(["batch", str(source), out, "--steps", "nothing"])
