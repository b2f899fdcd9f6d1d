"""Cross-checks of changed companies only, against checking all of them anew."""

import json
import os

from capledger.plans import pipelines
from capledger.sources import readers
from capledger.streaming import revalidate as V

FLOW = {"record_type": "subscription_flow", "company_name": "公司", "stock_code": "688001", "source_page": "1", "subscription_date": "2020-01", "subscriber_name": "甲", "price_per_share": "2", "shares_subscribed": "100", "amount_subscribed": "200", "evidence_text": "原文" * 12}


def put(folder, company, stamp, *records):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{company}.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in records) or "\n", encoding="utf-8")
    os.utime(path, (stamp, stamp))


def test_only_changed_companies_are_checked_again(spark, tmp_path):
    source, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    go = lambda: V.revalidate(spark, V.company_files(spark, str(source)), sink, state)
    put(source / "1", "a", 1000, FLOW, FLOW | {"amount_subscribed": "900"})
    put(source / "1", "b", 1000, FLOW)
    put(source / "1", "c", 1000)
    assert go() == 3 and go() == 0
    # a is mended, b comes again as it was, d is new; of two versions of e in one delivery the newer counts.
    put(source / "2", "a", 2000, FLOW, FLOW | {"subscriber_name": "乙"})
    put(source / "2", "b", 2000, FLOW)
    put(source / "2", "d", 2000, FLOW | {"source_page": ""})
    put(source / "3", "e", 2500, FLOW)
    put(source / "2", "e", 2000, FLOW | {"amount_subscribed": "900"})
    assert go() == 3
    assert sorted((r["company"], r["version"], r["batch"]) for r in V.latest(spark, sink, "companies").collect()) == [("a", 2, 1), ("b", 1, 0), ("c", 1, 0), ("d", 1, 1), ("e", 1, 1)]
    whole = tmp_path / "whole"
    for company, *records in (("a", FLOW, FLOW | {"subscriber_name": "乙"}), ("b", FLOW), ("c",), ("d", FLOW | {"source_page": ""}), ("e", FLOW)):
        put(whole, company, 1, *records)
    want = pipelines.validate_records(readers.records(readers.jsonl(spark, str(whole))))
    for name in ("schema_log", "cross_log"):
        columns = want[name].columns
        assert sorted(map(str, V.latest(spark, sink, name).select(columns).collect())) == sorted(map(str, want[name].collect())), name
    assert sorted((r["company"], r["issues"], r["verdict"]) for r in V.latest(spark, sink, "verdicts").collect()) == sorted([*((r["company"], r["issues"], r["verdict"]) for r in want["verdicts"].collect()), ("c", 0, "PASS")])
    assert {r["verdict"] for r in V.latest(spark, sink, "verdicts").where("company = 'd'").collect()} == {"FAIL"}
