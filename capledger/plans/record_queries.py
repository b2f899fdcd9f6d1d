"""Record checks and structured documents over rows made from the driver's tables, each with SQL of its own.

Rows are made by expressions that Spark and ANSI SQL read alike, so both sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import constraints as K
from ..operators import crosscheck as X
from ..operators import profile as N
from .queries import _t, query

# ---------------------------------------------------------------- flows and snapshots of orders

_FLOW = (
    "concat('c', o_custkey) AS company", "o_orderkey AS ord", "concat('h', o_orderkey % 3) AS subscriber_name", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST((o_orderkey % 7) * 100 AS DOUBLE) END AS shares_subscribed",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(2.5 AS DOUBLE) END AS price_per_share", "CAST((o_orderkey % 7) * 250 + o_orderkey % 4 AS DOUBLE) AS amount_subscribed",
)
_SNAP = (
    "concat('c', o_custkey) AS company", "o_orderkey AS ord", "CASE WHEN o_orderkey % 4 = 0 THEN 'A' ELSE 'B' END AS snapshot_type", "concat('h', o_orderkey % 3) AS shareholder_name", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey % 6) * 100 AS DOUBLE) END AS shares_held",
    "CAST((o_orderkey % 6) * 10 AS DOUBLE) AS capital_contribution", "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(500 + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS DOUBLE) END AS total_shares", "CAST(50 + o_orderkey % 2 AS DOUBLE) AS total_capital",
)
_YEAR = "CASE WHEN o_orderkey % 2 = 0 THEN concat(y, '-06') ELSE y END AS snapshot_date"
_FLOWS = f"(SELECT {', '.join(_FLOW)}, strftime(o_orderdate, '%Y-%m-%d') AS subscription_date FROM orders)"
_SNAPS = f"(SELECT {', '.join(_SNAP)}, {_YEAR} FROM (SELECT *, strftime(o_orderdate, '%Y') AS y FROM orders))"


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").selectExpr(*_FLOW, "date_format(o_orderdate, 'yyyy-MM-dd') AS subscription_date")


def _snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").withColumn("y", F.date_format("o_orderdate", "yyyy")).selectExpr(*_SNAP, _YEAR)


_GROUPS = rf"""(SELECT *, dense_rank() OVER (PARTITION BY company ORDER BY ym, ord) AS step FROM (SELECT company, snapshot_date, snapshot_type, CASE WHEN regexp_matches(snapshot_date, '^\d{{4}}-\d{{2}}') THEN left(snapshot_date, 7) ELSE snapshot_date END AS ym, min(ord) AS ord,
arg_min(total_shares, ord) FILTER (total_shares IS NOT NULL) AS total_shares, arg_min(total_capital, ord) FILTER (total_capital IS NOT NULL) AS total_capital, sum(shares_held) AS held, count(*) AS holders, count(DISTINCT total_shares) AS share_totals, count(DISTINCT total_capital) AS capital_totals
FROM {_SNAPS} GROUP BY company, snapshot_date, snapshot_type))"""


def _log(**columns: str) -> str:
    """The columns of a log row, null where not given."""
    kinds = {c: "DOUBLE" if c in X.LOG[4:10] else "VARCHAR" for c in X.LOG}
    return ", ".join(f"CAST({columns.get(c, 'NULL')} AS {k}) AS {c}" for c, k in kinds.items())


_REVIEW = "CASE WHEN {} THEN '待复核' ELSE 'PASS' END"
_MARK = "CASE WHEN {} THEN ' ←待复核' ELSE '' END"
_PRICE_LOG = f"""SELECT {_log(company="company", snapshot_date_from="''", snapshot_date_to="subscription_date", shareholder_name="subscriber_name", subscription_change="shares_subscribed", expected_shares="e", pdf_disclosed_shares="amount_subscribed", difference="e - amount_subscribed", status=_REVIEW.format("abs(e - amount_subscribed) > 1 OR abs(e - amount_subscribed) / amount_subscribed > 0.01"), detail="'price×shares vs amount diff=' || format('{:.1f}', abs(e - amount_subscribed) / amount_subscribed * 100) || '%'")}
FROM (SELECT *, price_per_share * shares_subscribed AS e FROM {_FLOWS}) WHERE e <> 0 AND amount_subscribed > 0"""
_TOTAL_LOG = f"""SELECT {_log(company="company", snapshot_date_from="''", snapshot_date_to="snapshot_date", shareholder_name="'[合计 ' || holders || '股东]'", expected_shares="held", pdf_disclosed_shares="total_shares", difference="held - total_shares", status=_REVIEW.format("abs(held - total_shares) > 0.01"), detail="'持股合计' || format('{:.1f}', held) || '万股 vs 总股本' || format('{:.1f}', total_shares) || '万股' || " + _MARK.format("abs(held - total_shares) > 0.01"))}
FROM {_GROUPS} WHERE held > 0 AND total_shares > 0"""


@query(_PRICE_LOG)
def q50_price_log(spark, sf_dir):
    return X.check_price(_flows(spark, sf_dir))


@query(_TOTAL_LOG)
def q51_total_log(spark, sf_dir):
    return X.check_totals(X.snapshot_groups(_snaps(spark, sf_dir)))


@query(f"""SELECT company, snapshot_date, snapshot_type, '总股本不一致' AS issue FROM {_GROUPS} WHERE share_totals > 1 UNION ALL SELECT company, snapshot_date, snapshot_type, '总出资额不一致' FROM {_GROUPS} WHERE capital_totals > 1""")
def q52_constancy_issues(spark, sf_dir):
    return X.check_constancy(X.snapshot_groups(_snaps(spark, sf_dir)))


def _adjacent(change: str) -> str:
    return f"""WITH g AS {_GROUPS}, h AS (SELECT * FROM {_SNAPS} QUALIFY row_number() OVER (PARTITION BY company, snapshot_date, snapshot_type, shareholder_name ORDER BY ord DESC) = 1), hs AS (SELECT h.*, g.step FROM h JOIN g USING (company, snapshot_date, snapshot_type)),
b AS (SELECT company, step + 1 AS step, shareholder_name, shares_held AS previous, capital_contribution AS previous_capital, true AS was FROM hs WHERE step < (SELECT max(step) FROM hs x WHERE x.company = hs.company)), a AS (SELECT company, step, shareholder_name, shares_held AS current, true AS is_ FROM hs WHERE step > 1),
p AS (SELECT company, step, shareholder_name, previous, previous_capital, current, coalesce(was, false) AS was, coalesce(is_, false) AS is_ FROM b FULL OUTER JOIN a USING (company, step, shareholder_name)),
q AS (SELECT p.*, t.snapshot_date AS date_to, f.snapshot_date AS date_from, t.ym AS ym_to, f.ym AS ym_from FROM p JOIN g t ON p.company = t.company AND p.step = t.step JOIN g f ON p.company = f.company AND p.step = f.step + 1),
m AS (SELECT * FROM {_FLOWS} WHERE shares_subscribed <> 0), c AS (SELECT q.*, {change} AS change FROM q)
SELECT {_log(company="company", snapshot_date_from="date_from", snapshot_date_to="date_to", shareholder_name="shareholder_name", previous_shares="previous", previous_capital="previous_capital", subscription_change="change", expected_shares="previous + change", pdf_disclosed_shares="current", difference="current - (previous + change)", status=_REVIEW.format("abs(current - (previous + change)) > 0.001"),
    detail="CASE WHEN was AND NOT is_ THEN '退出' WHEN is_ AND NOT was THEN '新增' WHEN previous IS NULL OR current IS NULL THEN '' WHEN current < previous THEN '稀释' WHEN current = previous THEN '保持' ELSE '增持' END || " + _MARK.format("abs(current - (previous + change)) > 0.001"))} FROM c"""


_FIRST_ANY = "(SELECT arg_min(shares_subscribed, ord) FROM m WHERE m.company = q.company AND m.subscriber_name = q.shareholder_name)"
_PERIOD = "(SELECT sum(shares_subscribed) FROM m WHERE m.company = q.company AND m.subscriber_name = q.shareholder_name AND left(subscription_date, 7) > ym_from AND left(subscription_date, 7) <= ym_to)"


@query(_adjacent(_FIRST_ANY))
def q53_adjacent_log(spark, sf_dir):
    snaps = _snaps(spark, sf_dir)
    return X.check_adjacent(_flows(spark, sf_dir), snaps, X.snapshot_groups(snaps))


@query(_adjacent(_PERIOD))
def q54_adjacent_period_log(spark, sf_dir):
    snaps = _snaps(spark, sf_dir)
    return X.check_adjacent(_flows(spark, sf_dir), snaps, X.snapshot_groups(snaps), mode="period")


def _delta(before: str, after: str, name: str, detail: str) -> str:
    return f"""SELECT {_log(company="company", snapshot_date_from="date_from", snapshot_date_to="date_to", shareholder_name=f"'{name}'", previous_shares=before, subscription_change="subscribed", expected_shares=f"{before} + subscribed", pdf_disclosed_shares=after, difference=f"subscribed - ({after} - {before})", status=_REVIEW.format(f"abs(subscribed - ({after} - {before})) > 0.01"), detail=detail)}
FROM d WHERE {after} <> {before} AND subscribed > 0"""


_SHARES_TOLD = "'认购合计' || format('{:.1f}', subscribed) || '万股 vs 股本变化' || format('{:.1f}', total_shares - shares_before) || '万股' || " + _MARK.format("abs(subscribed - (total_shares - shares_before)) > 0.01")
_CAPITAL_TOLD = "'认购合计' || format('{:.1f}', subscribed) || '万股 vs 出资额变化' || format('{:.1f}', total_capital - capital_before) || '万元'"
_DELTAS = f"""WITH m AS (SELECT company, left(subscription_date, 7) AS ym, sum(shares_subscribed) AS subscribed FROM {_FLOWS} WHERE shares_subscribed <> 0 GROUP BY ALL),
s AS (SELECT *, snapshot_date AS date_to, lag(snapshot_date) OVER w AS date_from, lag(total_shares) OVER w AS shares_before, lag(total_capital) OVER w AS capital_before FROM {_GROUPS} WINDOW w AS (PARTITION BY company ORDER BY step)),
d AS (SELECT s.*, m.subscribed FROM (SELECT * FROM s WHERE step > 1) s ASOF LEFT JOIN m ON s.company = m.company AND s.ym >= m.ym)
{_delta("shares_before", "total_shares", "[股本变化合计]", _SHARES_TOLD)} UNION ALL {_delta("capital_before", "total_capital", "[出资额变化合计]", _CAPITAL_TOLD)}"""


@query(_DELTAS)
def q55_delta_log(spark, sf_dir):
    return X.check_deltas(_flows(spark, sf_dir), X.snapshot_groups(_snaps(spark, sf_dir)))


_CORRESPONDENCE = f"""WITH s AS (SELECT s.*, g.ord AS group_ord FROM {_SNAPS} s JOIN {_GROUPS} g USING (company, snapshot_date, snapshot_type)),
c AS (SELECT f.*, s.shares_held FROM {_FLOWS} f JOIN s ON f.company = s.company AND f.subscriber_name = s.shareholder_name AND s.snapshot_date >= left(f.subscription_date, 7) QUALIFY row_number() OVER (PARTITION BY f.ord ORDER BY s.group_ord, s.ord) = 1)
SELECT {_log(company="company", snapshot_date_from="''", snapshot_date_to="subscription_date", shareholder_name="subscriber_name || ' (认缴→存量)'", subscription_change="shares_subscribed", expected_shares="shares_subscribed", pdf_disclosed_shares="shares_held", difference="shares_held - shares_subscribed", status=_REVIEW.format("abs(shares_held - shares_subscribed) > 0.01"), detail="'认购数 vs 存量持股数' || " + _MARK.format("abs(shares_held - shares_subscribed) > 0.01"))}
FROM c WHERE shares_held <> 0 AND shares_subscribed <> 0"""


@query(_CORRESPONDENCE)
def q56_correspondence_log(spark, sf_dir):
    snaps = _snaps(spark, sf_dir)
    return X.check_correspondence(_flows(spark, sf_dir), snaps, X.snapshot_groups(snaps))


_DIFFER = f"SELECT * FROM ({_PRICE_LOG}) WHERE difference <> 0 ORDER BY company, abs(difference) DESC, shareholder_name, snapshot_date_to LIMIT 5"


@query(_DIFFER)
def q57_first_differences(spark, sf_dir):
    return X.differences(X.check_price(_flows(spark, sf_dir)))


# ---------------------------------------------------------------- records as text, with faults

_LONG = "甲方以货币方式认购新增注册资本并完成工商变更登记手续"
_RECORD = {
    "company": "concat('f', o_orderkey % 40)", "line": "o_orderkey", "record_type": "CASE WHEN o_orderkey % 10 = 0 THEN 'note' WHEN o_orderkey % 47 = 0 THEN NULL WHEN o_orderkey % 10 < 5 THEN 'subscription_flow' ELSE 'equity_snapshot' END",
    "company_name": "CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE '甲公司' END", "stock_code": "CASE WHEN o_orderkey % 19 = 0 THEN '68801' ELSE '688001' END", "source_page": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'p1' END",
    "evidence_text": f"CASE WHEN o_orderkey % 13 = 0 THEN 'short' WHEN o_orderkey % 29 = 0 THEN '招股书显示{_LONG}' ELSE '{_LONG}' END", "subscription_date": "CASE WHEN o_orderkey % 11 = 0 THEN '2020-1' ELSE '2020-01' END", "subscriber_name": "CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'x' END",
    "shares_subscribed": "CASE WHEN o_orderkey % 7 = 0 THEN 'abc' ELSE '100' END", "amount_subscribed": "CASE WHEN o_orderkey % 37 = 0 THEN '-1' ELSE '5' END", "event_context": "CASE WHEN o_orderkey % 41 = 0 THEN '未知' ELSE '增资' END",
    "snapshot_date": "CASE WHEN o_orderkey % 11 = 1 THEN '2020/03' ELSE concat('20', 10 + o_orderkey % 13, '-03-01') END", "snapshot_type": "'t'", "shareholder_name": "CASE WHEN o_orderkey % 31 = 1 THEN NULL ELSE 'y' END", "total_shares": "CASE WHEN o_orderkey % 7 = 1 THEN '1,000' ELSE '1000' END",
    "shares_held": "'10'", "shareholder_type_detail": "'外部PE'", "is_original_founder": "CASE WHEN o_orderkey % 43 = 0 THEN 'maybe' ELSE 'no' END", "snapshot_order": "'1'",
}
_RECORDS = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _RECORD.items()) + " FROM orders)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _t(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _RECORD.items()])
    names = [f.split()[0] for f in schemas.RAW_RECORD.split(", ")]
    return some.select("company", "line", *[F.col(n) if n in _RECORD else F.lit(None).cast("string").alias(n) for n in names])


_is = lambda *conditions: " + ".join(f"coalesce(CAST({c} AS INT), 0)" for c in conditions)
_SHARED = ("company_name IS NULL", "length(company_name) < 1", "stock_code IS NULL", r"NOT regexp_matches(stock_code, '^\d{6}$')", "source_page IS NULL", "length(source_page) < 1", "evidence_text IS NULL", "length(evidence_text) < 20", "starts_with(evidence_text, '招股书显示')")
_DATE = r"NOT regexp_matches({0}, '^\d{{4}}-\d{{2}}(-\d{{2}})?$')"
_ERRORS = {
    "subscription_flow": _is(*_SHARED, "length(subscription_date) < 7", _DATE.format("subscription_date"), "length(subscriber_name) < 1", "try_cast(shares_subscribed AS DOUBLE) IS NULL", "CAST(amount_subscribed AS DOUBLE) < 0", "event_context = '未知'"),
    "equity_snapshot": _is(*_SHARED, "length(snapshot_date) < 7", _DATE.format("snapshot_date"), "shareholder_name IS NULL", "try_cast(total_shares AS DOUBLE) IS NULL", "is_original_founder = 'maybe'"),
}
_REQUIRED = [f"SELECT company, record_type, 'required_{c}' AS check_type, 'FAIL' AS status, 'line=' || line AS detail, true AS critical FROM r WHERE record_type = '{k}' AND coalesce({c}, '') = ''" for k, cs in K.REQUIRED.items() for c in cs]
_NUMERIC = [f"SELECT company, record_type, 'numeric_{c}', 'FAIL', 'line=' || line, false FROM r WHERE record_type = '{k}' AND {c} IS NOT NULL AND try_cast({c} AS DOUBLE) IS NULL" for k, c in (("subscription_flow", "shares_subscribed"), ("subscription_flow", "amount_subscribed"), ("equity_snapshot", "total_shares"), ("equity_snapshot", "shares_held"))]
_SCHEMA_LOG = f"""SELECT * FROM (WITH r AS {_RECORDS}, n AS (SELECT *, CASE record_type WHEN 'subscription_flow' THEN {_ERRORS["subscription_flow"]} WHEN 'equity_snapshot' THEN {_ERRORS["equity_snapshot"]} END AS errors FROM r)
{" UNION ALL ".join(_REQUIRED + _NUMERIC)}
UNION ALL SELECT company, coalesce(record_type, 'unknown'), 'record_type', 'FAIL', 'line=' || line, true FROM r WHERE coalesce(record_type, '') NOT IN ('subscription_flow', 'equity_snapshot')
UNION ALL SELECT company, record_type, 'schema', CASE WHEN errors = 0 THEN 'PASS' ELSE 'FAIL' END, 'line=' || line || CASE WHEN errors = 0 THEN '' ELSE ', errors=' || errors END, false FROM n WHERE errors IS NOT NULL
UNION ALL SELECT company, 'equity_snapshot', 't0_check', CASE WHEN count(*) FILTER (v) > 0 THEN 'PASS' ELSE 'WARN' END, CASE WHEN count(*) FILTER (v) > 0 THEN '最早快照: ' || (arg_min(snapshot_date, line) FILTER (v)) ELSE '无股权存量记录' END, false FROM (SELECT *, coalesce(record_type = 'equity_snapshot' AND errors = 0, false) AS v FROM n) GROUP BY company)"""


@query(_SCHEMA_LOG)
def q58_schema_log(spark, sf_dir):
    return K.schema_log(_records(spark, sf_dir))


@query(f"""SELECT company, line AS ord, CAST(shares_subscribed AS DOUBLE) AS shares_subscribed, CAST(amount_subscribed AS DOUBLE) AS amount_subscribed, event_context FROM (SELECT *, {_ERRORS["subscription_flow"]} AS errors FROM {_RECORDS} WHERE record_type = 'subscription_flow') WHERE errors = 0""")
def q59_typed_flows(spark, sf_dir):
    return K.typed(_records(spark, sf_dir), "subscription_flow", schemas.FLOW).select("company", "ord", "shares_subscribed", "amount_subscribed", "event_context")


@query(f"""WITH i AS (SELECT company, critical OR check_type = 'schema' AS critical FROM ({_SCHEMA_LOG}) WHERE status = 'FAIL') SELECT company, coalesce(issues, 0) AS issues, CASE WHEN critical THEN 'FAIL' WHEN issues > 0 THEN 'WARN' ELSE 'PASS' END AS verdict
FROM (SELECT DISTINCT company FROM {_RECORDS}) LEFT JOIN (SELECT company, count(*) AS issues, bool_or(critical) AS critical FROM i GROUP BY company) USING (company)""")
def q60_record_verdicts(spark, sf_dir):
    records = _records(spark, sf_dir)
    log = K.schema_log(records)
    none = X.check_price(_flows(spark, sf_dir)).where("status is null")
    return X.file_verdict(K.record_issues(log, none), records.select("company").distinct())


# ---------------------------------------------------------------- structured documents


def _pick(*options: tuple[int, int, str], default: str) -> str:
    """A CASE over the remainders of a customer's key."""
    return "CASE " + " ".join(f"WHEN c_custkey % {m} = {r} THEN '{v}'" for m, r, v in options) + f" ELSE '{default}' END"


#: Places of the document below, and what they hold by the customer's key.
_PLACES = {
    "@DATE@": _pick((6, 1, "2015-13"), (6, 2, "1985-01"), (6, 3, "20x5-01"), (6, 4, "2015"), default="2016-05"), "@TYPE@": _pick((4, 1, "设立"), (4, 2, "奇怪"), default="增资"),
    "@EVIDENCE@": _pick((3, 1, "短"), (3, 2, f"根据招股书{_LONG}{_LONG}"), default=_LONG + _LONG), "@CONFIDENCE@": _pick((5, 0, ""), (5, 1, '"confidence": null, '), (5, 2, '"confidence": "low", '), default='"confidence": "high", '),
    "@PARTY@": _pick((8, 1, ""), (8, 2, '"is_pevc": "maybe", '), default='"is_pevc": "yes", '), "@LAST@": _pick((10, 7, "2058-01"), default="2016-07"), "@AMOUNT@": _pick((9, 1, "100"), (9, 2, "null"), default="70"), "@PRICE@": _pick((12, 5, "3"), default="2"),
    "@ORDER@": _pick((7, 3, "1"), default="2"), "@BOARD@": _pick((6, 5, '"board": "火星板", '), (6, 0, ""), default='"board": "科创板", '), "@CODE@": _pick((11, 4, ""), (11, 5, " "), default="688001"),
}
_PARTY = '{"investor_original_name": "甲", "investor_short_name": "乙", "investor_type": "PE", @PARTY@"investment_amount": 70, "shares_acquired": 35, "shareholding_ratio_after_event": "5%", "exit_status_before_ipo": "未退出"}'
_EVENT = (
    '{"event_order": @N@, "event_date": "@D@", "date_type": "签约日", "event_type": "@T@", "disclosed_round": "A", "inferred_round": "A轮", "round_inference_basis": "x", "total_investment_amount": @AMOUNT@, "currency": "CNY", "share_price": @PRICE@, "pre_money_valuation": null, '
    '"post_money_valuation": null, "valuation_basis": null, "investors": [' + _PARTY + '], "source_section": "s", "source_page": "p", @C@"evidence_text": "@E@"}'
)
_FIRST = _EVENT.replace("@N@", "1").replace("@D@", "@DATE@").replace("@T@", "@TYPE@").replace("@C@", "@CONFIDENCE@").replace("@E@", "@EVIDENCE@")
_SECOND = _EVENT.replace("@N@", "@ORDER@").replace("@D@", "@LAST@").replace("@T@", "增资").replace("@C@", '"confidence": "high", ').replace("@E@", _LONG + _LONG)
_INFO = '"company_name": "甲", "stock_code": "@CODE@", "exchange": "上交所", @BOARD@"listing_date": "2020-01-01", "prospectus_title": "t", "prospectus_url": "u", "prospectus_version": "正式稿", "prospectus_date": "2020-01-01"'
_DOCUMENT = "{" + f'"company": {{{_INFO}}}, "financing_events": [{_FIRST}, {_SECOND}]' + "}"
_NESTED = "{" + f'"company": {{{_INFO}, "financing_events": [{_FIRST}, {_SECOND}]}}' + "}"
_FILLED = f"CASE WHEN c_custkey % 14 = 0 THEN '{{\"company\": ' WHEN c_custkey % 9 = 4 THEN '{_NESTED}' ELSE '{_DOCUMENT}' END"
for _place, _value in _PLACES.items():
    _FILLED = f"replace({_FILLED}, '{_place}', {_value})"
_VALID = "c_custkey % 14 <> 0"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table is a few MB, which would be one task; its documents are large.
    customers = _t(spark, sf_dir, "customer").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)
    return customers.selectExpr("concat('c', c_custkey) AS company", f"{_FILLED} AS raw")


def _issue_list(*issues: tuple[str, str]) -> str:
    """Issues whose condition holds, sorted and joined."""
    return "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in issues) + "], lambda x: x IS NOT NULL)), '|')"


_NO_CONFIDENCE, _OLD = f"{_VALID} AND c_custkey % 5 = 0", f"{_VALID} AND c_custkey % 9 = 4"
_VERIFY = _issue_list((_NO_CONFIDENCE, "'事件1缺少字段: confidence'"), (f"{_VALID} AND c_custkey % 3 = 2", "'事件1 evidence_text 疑似概括性语言，应为原文片段'"), (f"{_VALID} AND c_custkey % 8 = 1", "'事件1投资人1缺少字段: is_pevc'"), (f"{_VALID} AND c_custkey % 8 = 1", "'事件2投资人1缺少字段: is_pevc'"))


@query(f"SELECT 'c' || c_custkey AS company, CASE WHEN NOT ({_VALID}) THEN 'JSON_INVALID' WHEN issues <> '' THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN {_VALID} THEN 2 ELSE 0 END AS events, issues FROM (SELECT *, {_VERIFY} AS issues FROM customer)")
def q61_verify_keys(spark, sf_dir):
    return K.verify_keys(_documents(spark, sf_dir)).withColumn("issues", F.array_join("issues", "|"))


_VALIDATE = _issue_list(
    (f"NOT ({_VALID})", "'JSON格式错误'"), (_OLD, "'缺失顶层字段: financing_events'"), (_OLD, "'financing_events 在 company 对象内（旧格式），应提升到顶层'"), (f"{_VALID} AND c_custkey % 5 IN (0, 1)", "'event[0] 缺失关键字段: confidence'"), (f"{_VALID} AND c_custkey % 4 = 2", "'event[0] 非标准事件类型: 奇怪'"),
    (f"{_VALID} AND c_custkey % 6 = 3", "'event[0] 日期格式错误: 20x5-01'"), (f"{_VALID} AND c_custkey % 6 = 1", "'event[0] 日期异常: 2015-13'"), (f"{_VALID} AND c_custkey % 6 = 2", "'event[0] 日期异常: 1985-01'"), (f"{_VALID} AND c_custkey % 3 = 2", "'event[0] evidence_text 含概括性语言: 根据招股书'"),
    (f"{_VALID} AND c_custkey % 3 = 1", "'event[0] evidence_text 过短'"), (f"{_VALID} AND c_custkey % 10 = 7", "'event[1] 日期异常: 2058-01'"),
    *[(f"{_VALID} AND c_custkey % 8 = 1", f"'event[{i}]投资人[0]缺少字段: is_pevc'") for i in (0, 1)], *[(f"{_VALID} AND c_custkey % 8 = 2", f"'event[{i}]投资人[0] is_pevc 值非法: maybe'") for i in (0, 1)],
    (f"{_VALID} AND c_custkey % 10 = 7 AND try_cast(left(d, 4) AS INT) < 2018", "'融资跨度异常: ' || d || ' → 2058-01'"),
)
_DATES = f"(SELECT *, {_PLACES['@DATE@']} AS d, {_PLACES['@LAST@']} AS d2 FROM customer)"


@query(f"""SELECT company, CASE WHEN critical THEN 'FAIL' WHEN issues <> '' THEN 'WARN' ELSE 'PASS' END AS overall, issues, CASE WHEN {_VALID} THEN 2 ELSE 0 END AS event_count, {_VALID} AND c_custkey % 4 = 1 AS has_setup_event, CASE WHEN {_VALID} THEN least(d, d2) END AS first_date
FROM (SELECT *, 'c' || c_custkey AS company, {_VALIDATE} AS issues, NOT ({_VALID}) OR c_custkey % 9 = 4 OR c_custkey % 5 IN (0, 1) OR c_custkey % 6 IN (1, 2, 3) OR c_custkey % 10 = 7 AS critical FROM {_DATES}) UNION ALL SELECT 'gone', 'FAIL', '缺失文件', NULL, NULL, NULL""")
def q62_validate(spark, sf_dir):
    expected = spark.range(1).select(F.lit("gone").alias("company"))
    out = K.validate(_documents(spark, sf_dir), expected)
    return out.select("company", "overall", F.array_join("issues", "|").alias("issues"), *[F.col("details")[c].alias(c) for c in ("event_count", "has_setup_event", "first_date")])


_ROOT = "CASE WHEN c_custkey % 9 = 4 THEN '$.company.financing_events[' ELSE '$.financing_events[' END"


def _anomaly(where: str, path: str, field: str, kind: str, severity: str) -> str:
    return f"SELECT 'c' || c_custkey AS company, {path} AS path, '{field}' AS field, '{kind}' AS type, '{severity}' AS severity FROM customer WHERE {_VALID} AND ({where})"


_EVENT_0, _BOTH = f"{_ROOT} || '0]", [f"{_ROOT} || '{i}]" for i in (0, 1)]
_ANOMALIES = " UNION ALL ".join([
    _anomaly("c_custkey % 6 = 0", "'$.company.board'", "board", "缺失必填字段", "high"), _anomaly("c_custkey % 6 = 5", "'$.company.board'", "board", "枚举值异常", "medium"), _anomaly("c_custkey % 11 IN (4, 5)", "'$.company.stock_code'", "stock_code", "空字符串", "high"),
    *[_anomaly("true", f"'$.company.processing.{c}'", c, "处理未成功", "medium") for c in ("download_status", "parse_status", "locate_status", "extract_status")], _anomaly("true", "'$.company.processing.review_status'", "review_status", "未审核", "low"),
    _anomaly("c_custkey % 4 IN (1, 2)", f"{_EVENT_0}.event_type'", "event_type", "枚举值异常", "medium"), _anomaly("c_custkey % 5 IN (0, 1)", f"{_EVENT_0}.confidence'", "confidence", "缺失必填字段", "high"), _anomaly("c_custkey % 5 = 2", f"{_EVENT_0}.confidence'", "confidence", "低置信度", "medium").replace("].confidence'", "]'"),
    *[_anomaly("c_custkey % 9 = 1", f"{e}'", "total_investment_amount", "金额不一致", "high") for e in _BOTH], _anomaly("c_custkey % 9 = 2 AND c_custkey % 4 NOT IN (1, 2)", f"{_BOTH[0]}'", "total_investment_amount", "数据缺失", "medium"), _anomaly("c_custkey % 9 = 2", f"{_BOTH[1]}'", "total_investment_amount", "数据缺失", "medium"),
    *[_anomaly("c_custkey % 8 = 1", f"{e}.investors[0].is_pevc'", "is_pevc", "缺失必填字段", "high") for e in _BOTH], *[_anomaly("c_custkey % 8 = 2", f"{e}.investors[0].is_pevc'", "is_pevc", "枚举值异常", "medium") for e in _BOTH],
])


@query(_ANOMALIES)
def q63_profile(spark, sf_dir):
    return N.profile(_documents(spark, sf_dir)).drop("detail")


@query(f"""WITH a AS ({_ANOMALIES}), n AS (SELECT company, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in N.SEVERITIES)} FROM a GROUP BY company)
SELECT company, CASE WHEN NOT ({_VALID}) THEN 'invalid' WHEN c_custkey % 9 = 4 THEN 'structured_nested' ELSE 'structured_flat' END AS shape, CASE WHEN {_VALID} THEN 2 ELSE 0 END AS events, CASE WHEN {_VALID} THEN 2 ELSE 0 END AS investors, CASE WHEN NOT ({_VALID}) THEN 0 WHEN c_custkey % 5 > 2 THEN 2 ELSE 1 END AS high_confidence,
{", ".join(f"coalesce({s}, 0) AS {s}" for s in N.SEVERITIES)} FROM (SELECT *, 'c' || c_custkey AS company FROM customer) LEFT JOIN n USING (company)""")
def q64_summary_index(spark, sf_dir):
    docs = N.parsed(_documents(spark, sf_dir))
    return N.summary_index(docs, N.profile(docs))


_REVIEWED = " UNION ALL ".join(f"SELECT 'c' || c_custkey AS company, {i} AS i, '{rule}' AS rule FROM customer WHERE {_VALID} AND {where}" for i, rule, where in (
    (0, "sum", "c_custkey % 9 = 1"), (1, "sum", "c_custkey % 9 = 1"), (0, "price", "c_custkey % 12 = 5"), (1, "price", "c_custkey % 12 = 5"), (1, "order", "c_custkey % 7 = 3"),
))


@query(_REVIEWED)
def q65_review_rules(spark, sf_dir):
    return N.review(_documents(spark, sf_dir))


_BASIC = ('{"company": "甲", "financing_events": []}', '{"financing_events": [{"date": null, "participants": []}]}', '{"company": "甲", "financing_events": [{"date": "2015-01", "participants": ["x"]}, {"participants": ["y"]}]}')


@query("""SELECT 'n' || n_nationkey AS company, path, field, type, severity FROM nation JOIN (VALUES (0, '$.financing_events', 'financing_events', '无融资事件', 'critical'), (1, '$', 'structure', '缺少结构化数据', 'critical'), (1, '$.financing_events[0].date', 'date', '日期缺失', 'high'),
(1, '$.financing_events[0].participants', 'participants', '参与者缺失', 'medium'), (2, '$.financing_events[1].date', 'date', '日期缺失', 'high')) v(k, path, field, type, severity) ON n_nationkey % 3 = k""")
def q66_basic_profile(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(b) for b in _BASIC]), F.col("n_nationkey") % 3)
    return N.profile_basic(_t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("company"), raw.alias("raw"))).drop("detail")


_SHAPES = "CASE WHEN NOT (" + _VALID + ") THEN 'invalid' WHEN c_custkey % 9 = 4 THEN 'structured_nested' ELSE 'structured_flat' END"


@query(f"SELECT 'c' || c_custkey AS company, {_SHAPES} AS shape, CASE WHEN {_VALID} THEN 2 ELSE 0 END AS n_events, {_OLD} AS old_form FROM customer")
def q67_shapes(spark, sf_dir):
    s = K.structured(_documents(spark, sf_dir))
    return s.select("company", "shape", F.size("events").cast("long").alias("n_events"), F.coalesce("old_form", F.lit(False)).alias("old_form"))


@query("SELECT 'o_totalprice' AS metric, min(o_totalprice) AS least, median(o_totalprice) AS median, max(o_totalprice) AS most FROM orders UNION ALL SELECT 'o_custkey', min(o_custkey), median(o_custkey), max(o_custkey) FROM orders")
def q68_spread(spark, sf_dir):
    return N.spread(_t(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"])
