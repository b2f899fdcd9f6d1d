"""Operators on small fixtures with hand-computed answers."""

import json

from pyspark.sql import functions as F

from capledger import schemas
from capledger.functions import patterns as P
from capledger.operators import acquire as A
from capledger.operators import constraints as K
from capledger.operators import crosscheck as X
from capledger.operators import extract as E
from capledger.operators import profile as N
from capledger.operators import records as R
from capledger.operators import segment as G
from capledger.operators import select as S
from capledger.operators import tables as B
from capledger.plans import pipelines


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def frame(spark, ddl, *values):
    return spark.createDataFrame(list(values), ddl)


# ---------------------------------------------------------------- selection


def test_keep_first_is_idempotent_and_null_exempt(spark):
    df = frame(spark, "k string, o int", ("a", 2), ("a", 1), (None, 5), (None, 4))
    once = S.keep_first(df, ["k"], ["o"])
    assert rows(once) == rows(S.keep_first(once, ["k"], ["o"])) == [("a", 1), (None, 4)]
    assert rows(S.keep_first_or_null(df, "k", ["o"])) == [("a", 1), (None, 4), (None, 5)]


def test_as_of_takes_latest_not_after(spark):
    left = frame(spark, "c string, m string", ("a", "2020-01"), ("a", "2020-03"), ("b", "2020-03"), ("a", None))
    right = frame(spark, "c string, m string, v double", ("a", "2020-02", 1.0), ("a", "2020-03", 2.0), ("a", "2020-04", 3.0))
    assert rows(S.as_of(left, right, ["c"], "m", "v", "v")) == [("a", "2020-01", None), ("a", "2020-03", 2.0), ("a", None, None), ("b", "2020-03", None)]


def test_first_later_by_time_and_by_insertion(spark):
    left = frame(spark, "id int, c string, t int", (1, "a", 5), (2, "a", 9), (3, "b", 1))
    right = frame(spark, "c string, u int, o int, v string", ("a", 7, 1, "x"), ("a", 6, 2, "y"), ("a", 5, 3, "z"))
    assert rows(S.first_later(left, right, ["c"], "t", "u", ["u", "o"], "v", "v"), "id", "v") == [(1, "z"), (2, None), (3, None)]
    assert rows(S.first_later(left, right, ["c"], "t", "u", ["o"], "v", "v"), "id", "v") == [(1, "x"), (2, None), (3, None)]


def test_completeness_of_no_rows(spark):
    assert rows(S.completeness(frame(spark, "a string"), ["a"])) == [("a", 0, 0, 0, None)]


# ---------------------------------------------------------------- cross-checks


FLOW = "company string, ord long, subscription_date string, subscriber_name string, shares_subscribed double, amount_subscribed double, price_per_share double"
SNAP = "company string, ord long, snapshot_date string, snapshot_type string, total_shares double, total_capital double, shareholder_name string, shares_held double, capital_contribution double"


def test_price_check_of_known_values(spark):
    flows = frame(spark, FLOW, ("c", 1, "2020-01", "甲", 840.0, 7000.0, 8.3333), ("c", 2, "2020-01", "乙", 321.5, 1723.09, 5.41), ("c", 3, "2020-01", "丙", None, 5.0, 1.0), ("c", 4, "2020-01", "丁", 2.0, 0.0, 1.0))
    got = {r["shareholder_name"]: (round(r["difference"], 3), r["status"]) for r in X.check_price(flows).collect()}
    assert got == {"甲": (-0.028, "PASS"), "乙": (16.225, X.REVIEW)}


def test_differences_are_the_largest_first(spark):
    flows = frame(spark, FLOW, ("c", 1, "2020-01", "甲", 840.0, 7000.0, 8.3333), ("c", 2, "2020-01", "乙", 321.5, 1723.09, 5.41), ("c", 3, "2020-01", "丙", 2.0, 4.0, 2.0))
    assert [r["shareholder_name"] for r in X.differences(X.check_price(flows)).collect()] == ["乙", "甲"]


def snapshots(spark):
    return frame(
        spark, SNAP, ("c", 1, "2020-01", "设立后", 100.0, 10.0, "甲", 60.0, 6.0), ("c", 2, "2020-01", "设立后", 100.0, 10.0, "乙", 40.0, 4.0), ("c", 3, "2021-01", "增资后", 150.0, 15.0, "甲", 60.0, 6.0),
        ("c", 4, "2021-01", "增资后", 150.0, 15.0, "丙", 50.0, 5.0), ("c", 5, "2021-01", "增资后", 151.0, 15.0, "乙", 39.98, 4.0), ("c", 6, "2022-01", "增资后", 150.0, 15.0, "丙", 0.0, 5.0),
    )


def test_adjacent_snapshots(spark):
    snaps = snapshots(spark)
    groups = X.snapshot_groups(snaps)
    flows = frame(spark, FLOW, ("c", 1, "2020-06", "丙", 50.0, None, None), ("c", 2, "2019-06", "甲", 1.0, None, None), ("c", 3, "2020-06", "甲", 2.0, None, None))
    got = {(r["snapshot_date_to"], r["shareholder_name"]): (r["subscription_change"], r["difference"], r["status"], r["detail"]) for r in X.check_adjacent(flows, snaps, groups).collect()}
    assert got["2021-01", "甲"] == (1.0, -1.0, X.REVIEW, "保持 ←待复核")
    assert got["2021-01", "乙"] == (None, None, "PASS", "稀释")
    assert got["2021-01", "丙"] == (50.0, None, "PASS", "新增")
    assert got["2022-01", "丙"] == (50.0, -100.0, X.REVIEW, "稀释 ←待复核")
    assert got["2022-01", "甲"][3] == got["2022-01", "乙"][3] == "退出"
    assert len(got) == 6
    period = {(r["snapshot_date_to"], r["shareholder_name"]): r["subscription_change"] for r in X.check_adjacent(flows, snaps, groups, "period").collect()}
    assert period["2021-01", "甲"] == 2.0 and period["2022-01", "丙"] is None


def test_totals_constancy_and_deltas(spark):
    groups = X.snapshot_groups(snapshots(spark))
    got = {r["snapshot_date_to"]: (round(r["difference"], 2), r["status"]) for r in X.check_totals(groups).collect()}
    assert got == {"2020-01": (0.0, "PASS"), "2021-01": (-0.02, X.REVIEW)}
    assert rows(X.check_constancy(groups), "snapshot_date", "issue") == [("2021-01", "总股本不一致")]
    flows = frame(spark, FLOW, ("c", 1, "2020-06", "丙", 50.0, None, None), ("c", 2, "2020-07", "丙", 0.0, None, None))
    deltas = [(r["snapshot_date_from"], r["snapshot_date_to"], r["shareholder_name"], r["difference"], r["status"]) for r in X.check_deltas(flows, groups).collect()]
    assert sorted(deltas) == [("2020-01", "2021-01", "[出资额变化合计]", 45.0, X.REVIEW), ("2020-01", "2021-01", "[股本变化合计]", 0.0, "PASS")]


def test_correspondence_scans_snapshots_as_first_seen(spark):
    snaps = frame(spark, SNAP, ("c", 1, "2022-01", "b", None, None, "甲", 7.0, None), ("c", 2, "2021-01", "a", None, None, "甲", 5.0, None))
    flows = frame(spark, FLOW, ("c", 1, "2020-06-01", "甲", 5.0, None, None), ("c", 2, "2023-01", "甲", 5.0, None, None))
    got = X.check_correspondence(flows, snaps, X.snapshot_groups(snaps)).collect()
    assert [(r["pdf_disclosed_shares"], r["status"]) for r in got] == [(7.0, X.REVIEW)]


# ---------------------------------------------------------------- segments


def test_contents_once_in_order(spark):
    docs = frame(spark, "company string, text string", ("c", "# 第一节 概览\nx\n# 一、背景\n# 第一节 概览\n# 第二节 风险"))
    assert rows(G.contents(G.lines(docs)), "entry_no", "entry") == [(1, "第一节 概览"), (2, "  # 一、背景"), (3, "第二节 风险")]


def test_heading_tiers(spark):
    docs = frame(spark, "company string, text string", ("a", "# 一\nx\n# 二\ny\n# 三"), ("b", "# 一\n 第一节 甲\nx\n第二章 乙"), ("c", "## 第1页\nx\n## 第2页"), ("d", "x"))
    got = G.sections(G.heading_tiers(G.lines(docs)))
    assert rows(got, "company", "title") == [("a", "一"), ("a", "三"), ("a", "二"), ("b", "第一节 甲"), ("b", "第二章 乙"), ("c", "## 第1页"), ("c", "## 第2页")]
    assert rows(got.where("company = 'b'"), "line_idx", "content") == [(1, "第一节 甲\nx"), (3, "第二章 乙")]


def test_locate_falls_back_by_company(spark):
    long = "某" * 120
    docs = frame(
        spark, "company string, text string", ("title", f"# 一\n{long}\n# 历史沿革\n{long}\n# 三\n{long}"), ("core", f"前言{long}\n第四节 发行人基本情况{long}{long}\n第五节 业务{long}"), ("word", "序" * 300 + "增资" + "尾" * 2500), ("none", long),
    )
    got = {r["company"]: r for r in G.locate_all(docs, ("历史沿革",)).collect()}
    assert {k: r["method"] for k, r in got.items()} == {"title": "title", "core": "core", "word": "word"}
    assert got["core"]["content"].startswith("第四节") is False and got["core"]["content"].endswith(long) and "第五节" not in got["core"]["content"]
    assert got["word"]["length"] == 2200 and got["word"]["content"].startswith("序" * 200 + "增资")


def test_locating_needs_no_exchange_and_sections_agree_with_lines(spark):
    docs = frame(spark, "company string, text string", ("a", "x\n# 一\nx\n# 二\ny\n# 三"), ("b", "# 一\n 第一节 甲\nx\n第二章 乙"), ("c", "## 第1页\nx\n## 第2页\n"), ("d", "x"), ("e", None), ("f", ""))
    assert "Exchange" not in G.locate_all(docs)._jdf.queryExecution().executedPlan().toString()
    inside = G.sections_of(docs).selectExpr("company", "inline(_sections)")
    assert rows(inside, "company", "line_idx", "title", "content", "length") == rows(G.sections(G.tiered_lines(docs)), "company", "line_idx", "title", "content", "length")
    assert G.locate_all(docs.where("company > 'c'")).count() == 0


def test_snippets_of_the_first_word(spark):
    docs = frame(spark, "company string, text string", ("c", "a\nb 股本演变 x\n股本演变 y\n历次增资"))
    assert rows(G.snippets(docs, most=5), "nth", "pos", "snippet") == [(1, 4, "\nb 股本演变 x\n股本演变 y\n历次增资"), (2, 11, "\n股本演变 y\n历次增资")]


def test_sections_join_to_the_text(spark):
    text = "# a\n1\n2\n# b\n3"
    got = G.sections(G.lines(frame(spark, "company string, text string", ("c", text))).withColumn("title", F.when(F.col("line").startswith("# "), F.col("line"))))
    assert "\n".join(r["content"] for r in sorted(got.collect(), key=lambda r: r["section_id"])) == text


# ---------------------------------------------------------------- tables


HTML = """<table><tr><td>序号</td><td>x</td></tr></table><table><tr><td>股东名称</td><td colspan=2>持股数量（万股）</td><td>比例</td></tr><tr><td>甲<b>公司</b></td><td>1,234.5</td><td>60 %</td></tr><tr><td> </td><td></td></tr>
<tr><td>合计</td><td>2,000</td><td>100%</td></tr><tr><td>乙公司</td><td>n/a</td></tr></table>"""


def test_holder_table(spark):
    docs = frame(spark, "company string, html string", ("c", HTML), ("d", "none"))
    got = rows(B.holders(docs, ["company"], "html"), "shareholder_name", "shares_held", "shareholding_ratio", "total_shares")
    assert got == [("乙公司", None, None, 2000.0), ("甲公司", 1234.5, "60%", None)]


def test_holder_rows(spark):
    html = "<tr><td>1</td><td>甲公司</td><td>100万股</td><td>60%</td></tr><tr><td></td><td>乙</td><td>1,0</td><td>4.5</td></tr>"
    got = frame(spark, "h string", (html,)).select(B.holder_rows(F.col("h")).alias("r")).first()["r"]
    assert [tuple(r) for r in got] == [("1", "甲公司", "100万股", "60%"), ("", "乙", "1,0", "4.5")]


# ---------------------------------------------------------------- events


def test_events_keep_first_of_month(spark):
    tail = "，各方签署了协议并办理完成了工商变更登记手续。" * 2
    text = f"序\n2015年3月第一次增资，注册资本增至500万元，甲乙有限公司认购{tail}\n2015年3月股权转让{tail}\n2016年1月整体变更为股份有限公司{tail}\n2017年增资"
    got = E.events(frame(spark, "company string, text string", ("c", text)))
    assert rows(got, "date", "event_type", "amount") == [("2015-03", "增资", "500万元"), ("2016-01", "整体变更", None)]


def test_timeline_strict_then_loose(spark):
    line = "2015年3月5日，公司完成第一次增资，注册资本由一百万元增加至五百万元整"
    docs = frame(spark, "company string, text string", ("a", f"# 沿革\n{line}\n2016年1月增资"), ("b", "于2016年1月增资"))
    assert rows(E.timeline(docs), "company", "date", "section") == [("a", "2015-03", "沿革"), ("b", "2016-01", None)]
    twice = frame(spark, "company string, text string", ("a", f"{line}\n{line}\n经审议于 2016年1月完成了增资事宜并办理工商登记"))
    assert rows(E.timeline_batch(twice), "line_no", "date") == [(0, "2015-03"), (2, "2016-01")]


def test_context_events_have_their_surroundings(spark):
    text = "甲" * 300 + "2015年3月公司增资" + "乙" * 400 + "。2016年4月新增注册资本"
    got = rows(E.context_events(frame(spark, "company string, text string", ("c", text), ("d", None))), "event_no", "event_type", "event_date", F.length("evidence_text"))
    assert got == [(1, "增资", "2015-03", 411), (2, "增资", "2016-04", 113)]


# ---------------------------------------------------------------- records


def nested(spark):
    inv = lambda name, amount=None, ratio=None: {"investor_original_name": name, "investor_type": "PE", "investment_amount": amount, "shareholding_ratio_after_event": ratio}
    events = [
        {"event_date": "2015-03", "event_type": "增资", "total_investment_amount": 100.0, "share_price": 2.0, "evidence_text": "增资后总股本为1,500万股", "investors": [inv("甲")]},
        {"event_date": "2016-03", "event_type": "增资", "total_investment_amount": 100.0, "inferred_round": "A轮", "evidence_text": "x", "investors": [inv("乙"), inv("丙", 5.0, "6%")]},
        {"event_date": "2016-03", "event_type": "增资", "inferred_round": "A轮", "evidence_text": "again", "investors": [inv("丁", 1.0, "1%")]},
        {"event_date": "2017-03", "event_type": "增资", "investors": []},
    ]
    df = spark.createDataFrame([(json.dumps(e),) for e in events], "j string").select(F.from_json("j", schemas.EVENT).alias("e"), F.monotonically_increasing_id().alias("i"))
    return df.select("e.*", F.lit("c").alias("company_name"), F.lit("688001").alias("stock_code"), F.array_position(F.array(*[F.lit(x) for x in ("2015-03", "2016-03", "2017-03")]), F.col("e.event_date")).alias("n"), "i").withColumn("event_no", F.col("n") * 10 + F.when(F.col("evidence_text") == "again", 1).otherwise(0)).drop("n", "i")


def test_flows_fill_a_single_investor_only(spark):
    got = rows(R.flows(nested(spark)), "subscriber_name", "amount_subscribed", "post_event_total_capital")
    assert got == [("丁", 1.0, None), ("丙", 5.0, None), ("乙", None, None), ("甲", 100.0, 1500.0)]


def test_snapshots_keep_first_and_count_from_zero(spark):
    got = rows(R.snapshots(nested(spark)), "shareholder_name", "snapshot_type", "snapshot_order", "is_original_founder")
    assert got == [("丙", "增资后（A轮）", 0, "yes")]


def test_auto_records_from_text(spark):
    text = "发行人基本情况\n2015年3月，甲乙创业投资企业、丙丁戊基金认缴，分别出资 1,200 万元、300 万元，价格 2.5 元/股，完成增资。" + HTML
    docs = frame(spark, "company string, company_name string, stock_code string, text string", ("k", "公司", "688001", text))
    flows = R.auto_flows(docs).collect()
    assert len(flows) == 2 and [r["amount_subscribed"] for r in flows] == [1200.0, 300.0] and flows[0]["price_per_share"] == 2.5
    snaps = R.auto_snapshots(docs, E.context_events(docs)).collect()
    assert {(r["shareholder_name"], r["snapshot_date"]) for r in snaps} == {("甲公司", "2015-03"), ("乙公司", "2015-03")}
    log = pipelines.build_records(nested(spark).where("stock_code = 'x'"), docs)
    assert log.count() == 4 and rows(pipelines.build_records(nested(spark), docs).where("notes like '自动%'")) == []


# ---------------------------------------------------------------- constraints, profiles


def record(**more):
    return {"record_type": "subscription_flow", "company_name": "公司", "stock_code": "688001", "source_page": "1", "subscription_date": "2020-01", "subscriber_name": "甲", "evidence_text": "原文" * 12} | more


def log_of(spark, *lines):
    raw = spark.createDataFrame([("c", i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(lines, 1)], "company string, line long, raw string")
    from capledger.sources import readers

    return readers.records(raw)


def test_schema_log(spark):
    got = rows(K.schema_log(log_of(spark, record(), record(subscriber_name=""), record(price_per_share="x"), {"record_type": "other"}, record(evidence_text="招股书显示" + "长" * 30))), "check_type", "status", "detail")
    assert ("schema", "PASS", "line=1") in got and ("required_subscriber_name", "FAIL", "line=2") in got and ("numeric_price_per_share", "FAIL", "line=3") in got
    assert ("record_type", "FAIL", "line=4") in got and ("schema", "FAIL", "line=5, errors=1") in got and ("t0_check", "WARN", "无股权存量记录") in got


def test_each_constraint_is_found_once(spark):
    bad = [dict(stock_code="68800"), dict(subscription_date="2020-1"), dict(event_context="x"), dict(payment_method="x"), dict(amount_subscribed=-1), dict(evidence_text="短"), dict(source_page="")]
    got = [r["n"] for r in log_of(spark, *[record(**b) for b in bad]).select(F.size(K.errors(K.MODEL["subscription_flow"])).alias("n")).collect()]
    # A date that is too short breaks its length and its pattern.
    assert got == [1, 2, 1, 1, 1, 1, 1]


def test_verdicts_of_files(spark):
    got = pipelines.validate_records(log_of(spark, record(price_per_share=5.41, shares_subscribed=321.5, amount_subscribed=1723.09)))
    assert rows(got["verdicts"]) == [("c", 1, "WARN")]
    assert rows(pipelines.validate_records(log_of(spark, record(source_page="")))["verdicts"], "verdict") == [("FAIL",)]


def document(**event):
    investor = dict.fromkeys(P.INVESTOR_KEYS, "x") | {"is_pevc": "yes", "investment_amount": 10.0, "shares_acquired": None, "investor_type": "PE", "exit_status_before_ipo": "未退出"}
    base = dict.fromkeys(P.EVENT_KEYS, "x") | {"event_order": 1, "event_date": "2015-03", "date_type": "签约日", "event_type": "增资", "total_investment_amount": 10.0, "currency": "CNY", "share_price": None, "pre_money_valuation": None, "post_money_valuation": None, "evidence_text": "原文" * 20, "confidence": "high", "investors": [investor]}
    return {"company": {"company_name": "公司", "stock_code": "688001"}, "financing_events": [base | event]}


def docs_of(spark, **docs):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in docs.items()], "company string, raw string")


def test_shapes_and_verification(spark):
    old = {"company": {"company_name": "x", "financing_events": document()["financing_events"]}}
    less = document()
    del less["financing_events"][0]["currency"]
    docs = docs_of(spark, good=document(), old=old, bad="{", basic={"financing_events": [{"date": None}]}, less=less, null=document(currency=None))
    assert dict(rows(K.structured(docs), "company", "shape")) == {"good": "structured_flat", "old": "structured_nested", "bad": "invalid", "basic": "basic", "less": "structured_flat", "null": "structured_flat"}
    got = dict(rows(K.verify_keys(docs), "company", "status"))
    assert got["good"] == got["old"] == got["null"] == "PASS" and got["bad"] == "JSON_INVALID" and got["less"] == "FAIL"


def test_validation_verdicts(spark):
    lacking = document()
    del lacking["financing_events"][0]["investors"][0]["is_pevc"]
    docs = docs_of(spark, good=document(), month=document(event_date="2015-13"), text=document(event_date="20a5-01"), kind=document(event_type="其它"), short=document(evidence_text="短"), null=document(confidence=None), lacking=lacking, phrase=document(evidence_text="招股书显示" + "长" * 40))
    expected = spark.createDataFrame([("gone",), ("good",)], "company string")
    got = dict(rows(K.validate(docs, expected), "company", "overall"))
    assert got == {"good": "PASS", "month": "FAIL", "text": "FAIL", "kind": "WARN", "short": "WARN", "null": "FAIL", "lacking": "WARN", "phrase": "WARN", "gone": "FAIL"}


def test_profile(spark):
    doc = document(inferred_round="A轮轮", event_date="2015-2020", total_investment_amount=13.0, confidence="low", event_order="1", date_type="y")
    doc["company"] |= {"listing_date": "2020/1/1", "processing": {"download_status": "success"}}
    got = rows(N.profile(docs_of(spark, d=doc)), "type", "field", "severity")
    for want in [("数据录入错误", "inferred_round", "high"), ("日期跨度过大", "event_date", "high"), ("金额不一致", "total_investment_amount", "high"), ("低置信度", "confidence", "medium"), ("类型错误", "event_order", "high"), ("枚举值异常", "date_type", "medium"), ("日期格式错误", "listing_date", "high"), ("未审核", "review_status", "low"), ("处理未成功", "parse_status", "medium"), ("缺失必填字段", "exchange", "high")]:
        assert want in got
    assert ("处理未成功", "download_status", "medium") not in got and ("数据缺失", "financing_events", "critical") not in got
    basic = rows(N.profile(docs_of(spark, b={"financing_events": [{"date": None, "participants": []}]})), "type")
    assert basic == [("参与者缺失",), ("日期缺失",), ("缺少结构化数据",)]
    assert rows(N.severities(N.profile(docs_of(spark, b={"x": 1})), ["company"])) == [("b", 2, 0, 0, 0)]


# ---------------------------------------------------------------- acquisition


def test_prospectuses(spark):
    titles = ["招股说明书（申报稿）", "招股说明书（注册稿）", "招股说明书摘要", "招股意向书", None]
    ann = frame(spark, "stock_code string, announcementTitle string, adjunctUrl string, announcementDate string, ord long", *[("1", t, "a/b.pdf", "2020-01-02 10:00", i) for i, t in enumerate(titles)])
    got = A.prospectuses(ann, "https://x.org")
    assert rows(got, "title", "version", "priority", "date") == [("招股意向书", "正式稿", 4, "2020-01-02"), ("招股说明书（注册稿）", "注册稿", 3, "2020-01-02"), ("招股说明书（申报稿）", "申报稿", 1, "2020-01-02")]
    assert rows(A.best_prospectus(got), "title", "url") == [("招股说明书（申报稿）", "https://x.org/a/b.pdf")]


def test_attempts(spark):
    files = frame(spark, "path string, content binary, length long", ("a", b"%PDF-1.4", 2 << 20), ("b", b"<html>", 10))
    assert rows(A.attempt_log(files), "path", "status", "size_mb") == [("a", "success", 2.0), ("b", "failed", 0.0)]
    assert rows(files.select("path", A.file_accepted(F.col("content"), F.col("length")))) == [("a", True), ("b", False)]


def test_index_review_and_spread(spark):
    one, two = document(total_investment_amount=13.0, event_order=2), document(share_price=2.0, event_order=2)
    two["financing_events"][0]["investors"] = [dict(two["financing_events"][0]["investors"][0], shares_acquired=9.0, is_pevc="uncertain"), {"investment_amount": None}]
    doc = one | {"financing_events": one["financing_events"] + two["financing_events"]}
    docs = docs_of(spark, d=doc, e={"x": 1})
    assert rows(N.review(docs), "i", "rule") == [(0, "sum"), (1, "order"), (1, "peers"), (1, "price"), (1, "uncertain")]
    index = {r["company"]: r for r in N.summary_index(docs, N.profile(docs)).collect()}
    assert (index["d"]["shape"], index["d"]["events"], index["d"]["investors"], index["d"]["high_confidence"]) == ("structured_flat", 2, 3, 2) and index["e"]["critical"] == 2
    assert rows(N.spread(frame(spark, "a int", (1,), (5,), (2,)), ["a"])) == [("a", 1.0, 2.0, 5.0)]
