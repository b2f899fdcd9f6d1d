"""The operators over the driver's tables, each with SQL that says the same independently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import acquire as A
from ..operators import constraints as K
from ..operators import crosscheck as X
from ..operators import extract as E
from ..operators import profile as N
from ..operators import records as R
from ..operators import segment as G
from ..operators import select as S
from ..operators import tables as B

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", _day("ts").alias("day"))


_EVENTS = "(SELECT event_id, user_id, event_type, value, ts, strftime(ts, '%Y-%m-%d') AS day FROM events)"


# ---------------------------------------------------------------- keep-first, caps, groups


@query(f"SELECT event_id, user_id, day, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS n FROM {_EVENTS}) WHERE n = 1")
def q01_keep_first_by_key(spark, sf_dir):
    return S.keep_first(_events(spark, sf_dir), ["user_id", "day"], ["event_id"]).select("event_id", "user_id", "day", "event_type")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 30")
def q02_top_k_per_group(spark, sf_dir):
    return S.first_k(_events(spark, sf_dir), ["user_id"], ["event_id"], 30).select("event_id", "user_id", "event_type")


@query("""SELECT event_id, user_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) AS n FROM (SELECT *, nullif(event_type, 'error') AS kind FROM events))
WHERE n = 1 OR kind IS NULL""")
def q03_null_exempt_dedup(spark, sf_dir):
    kinds = _events(spark, sf_dir).select("event_id", "user_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return S.keep_first_or_null(kinds, "kind", ["event_id"], ["user_id"])


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def q04_group_to_list(spark, sf_dir):
    joined = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return S.group_list(joined, ["r_name"], ["n_name"], "n_name", "names").select("r_name", F.array_join("names", ",").alias("nations"))


@query(f"SELECT user_id, left(day, 7) AS ym, round(sum(value), 2) AS total FROM {_EVENTS} WHERE value IS NOT NULL AND value <> 0 GROUP BY user_id, left(day, 7)")
def q05_month_sum(spark, sf_dir):
    return S.month_sum(_events(spark, sf_dir), ["user_id"], F.col("day"), "value", "total").withColumn("total", F.round("total", 2))


@query("""SELECT user_id, string_agg(event_type || ':' || n, ', ' ORDER BY n DESC, event_type) AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def q06_category_distribution(spark, sf_dir):
    return S.distribution(_events(spark, sf_dir), ["user_id"], "event_type", "kinds")


@query("""SELECT o_custkey, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_date, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_date, max(year(o_orderdate)) - min(year(o_orderdate)) > 5 AS wide FROM orders GROUP BY o_custkey""")
def q07_span_check(spark, sf_dir):
    year = F.year("o_orderdate")
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(_day("o_orderdate")).alias("first_date"), F.max(_day("o_orderdate")).alias("last_date"), (F.max(year) - F.min(year) > 5).alias("wide"))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned, count(*) AS n_lines, count(*) FILTER (l_discount > 0.05) AS n_discounted FROM lineitem GROUP BY l_orderkey")
def q08_flag_rollup(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"))


# ---------------------------------------------------------------- cross-checks


#: A row's place in the table.  Totals that lie by 0.01 off are told from others by the last bit of their sum, so prices are
#: added in this order, as the SQL does on one thread; on more its own statuses change from run to run.
_PLACE = ["_file", "_row"]


def _placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _t(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 1)
    expected, difference, st = X.price_quantity(price, F.col("l_quantity"), F.col("l_extendedprice"))
    return _placed(spark, sf_dir, "lineitem").withColumns({"expected": expected, "difference": difference, "status": st})


_PRICED = """(SELECT *, CASE WHEN price <> 0 AND l_quantity <> 0 AND l_extendedprice > 0 THEN CASE WHEN abs(price * l_quantity - l_extendedprice) > 1.0 OR abs(price * l_quantity - l_extendedprice) / l_extendedprice > 0.01 THEN '待复核' ELSE 'PASS' END END AS status
FROM (SELECT *, round(l_extendedprice / l_quantity, 1) AS price FROM lineitem))"""


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, status FROM {_PRICED}")
def q09_price_qty_check(spark, sf_dir):
    return _priced(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "status")


@query(f"""SELECT strftime(o_orderdate, '%Y-%m') AS ym, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = '待复核') AS n_待复核 FROM {_PRICED} JOIN orders ON l_orderkey = o_orderkey GROUP BY ym""")
def q09b_verdicts_by_month(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"))
    return S.verdicts(_priced(spark, sf_dir).select("l_orderkey", "status").join(orders, "l_orderkey"), ["ym"], "status", [X.PASS, X.REVIEW])


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _placed(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(S.sum_in_order("l_extendedprice", _PLACE).alias("held"), F.count_distinct("l_returnflag").alias("flags"))
    return held.withColumn("total", F.round("held", 1)).withColumn("status", X.status(F.abs(F.col("held") - F.col("total")) > 0.01))


@query("SELECT l_orderkey, round(sum(l_extendedprice), 2) AS held, CASE WHEN abs(sum(l_extendedprice) - round(sum(l_extendedprice), 1)) > 0.01 THEN '待复核' ELSE 'PASS' END AS status FROM lineitem GROUP BY l_orderkey")
def q10_total_check(spark, sf_dir):
    return _totals(spark, sf_dir).select("l_orderkey", F.round("held", 2).alias("held"), "status")


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS flags, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'mixed' ELSE 'single' END AS kind FROM lineitem GROUP BY l_orderkey")
def q11_constancy_check(spark, sf_dir):
    return _totals(spark, sf_dir).select("l_orderkey", "flags", F.when(F.col("flags") > 1, "mixed").otherwise("single").alias("kind"))


def _of_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("company", F.col("user_id") % 50)


_DAILY = f"(SELECT *, user_id % 50 AS company, dense_rank() OVER (PARTITION BY user_id % 50 ORDER BY day) AS step FROM {_EVENTS})"


@query(f"SELECT a.company, b.step, a.day AS day_from, b.day AS day_to FROM (SELECT DISTINCT company, step, day FROM {_DAILY}) a JOIN (SELECT DISTINCT company, step, day FROM {_DAILY}) b ON a.company = b.company AND b.step = a.step + 1")
def q12_adjacent_snapshots(spark, sf_dir):
    # Steps are numbered after the rows of a day are one, so a company's events do not meet in a task.
    days = S.consecutive(_of_companies(spark, sf_dir).select("company", "day").distinct(), ["company"], ["day"])
    before = days.select("company", (F.col("step") + 1).alias("step"), F.col("day").alias("day_from"))
    return days.withColumnRenamed("day", "day_to").join(before, ["company", "step"]).select("company", "step", "day_from", "day_to")


_HELD = f"(SELECT company, step, event_type AS holder, count(*) AS held FROM {_DAILY} GROUP BY ALL)"


@query(f"""WITH h AS {_HELD}, last AS (SELECT company, max(step) AS m FROM h GROUP BY company), p AS (SELECT h.company, step + 1 AS step, holder, held AS previous FROM h JOIN last ON h.company = last.company WHERE step < m), c AS (SELECT company, step, holder, held AS current FROM h WHERE step > 1)
SELECT company, step, holder, previous, current, CASE WHEN current IS NULL THEN '退出' WHEN previous IS NULL THEN '新增' WHEN current < previous THEN '稀释' WHEN current = previous THEN '保持' ELSE '增持' END AS change FROM p FULL OUTER JOIN c USING (company, step, holder)""")
def q13_snapshot_diff(spark, sf_dir):
    held = _of_companies(spark, sf_dir).groupBy("company", "day", F.col("event_type").alias("holder")).agg(F.count(F.lit(1)).alias("held"))
    held = S.consecutive(held, ["company"], ["day"])
    pairs = X.diff_snapshots(held, ["company"], "holder", "held")
    return pairs.select("company", "step", "holder", "previous", "current", X.change_status(F.col("previous"), F.col("current"), F.col("was"), F.col("is")).alias("change"))


@query("SELECT user_id, first_purchase FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, arg_min(value, event_id) AS first_purchase FROM events WHERE event_type = 'purchase' AND value <> 0 GROUP BY user_id) USING (user_id)")
def q14_first_match_lookup(spark, sf_dir):
    events = _events(spark, sf_dir)
    return S.first_match(events.select("user_id").distinct(), events, ["user_id"], "value", ["event_id"], "first_purchase", (F.col("event_type") == "purchase") & X.nonzero(F.col("value")))


@query("""WITH m AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS ym, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <> 0 GROUP BY ALL)
SELECT o_orderkey, o.ym, round(m.total, 2) AS month_total FROM (SELECT *, strftime(o_orderdate, '%Y-%m') AS ym FROM orders) o ASOF LEFT JOIN m ON o.o_custkey = m.o_custkey AND o.ym >= m.ym""")
def q15_asof_month(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").withColumn("ym", F.date_format("o_orderdate", "yyyy-MM"))
    months = S.month_sum(orders.where("o_orderstatus = 'F'").drop("ym"), ["o_custkey"], F.date_format("o_orderdate", "yyyy-MM"), "o_totalprice", "total")
    return S.as_of(orders.select("o_orderkey", "o_custkey", "ym"), months, ["o_custkey"], "ym", "total", "month_total").select("o_orderkey", "ym", F.round("month_total", 2).alias("month_total"))


@query("""SELECT p.event_id, (SELECT v.event_id FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts >= p.ts ORDER BY v.ts, v.event_id LIMIT 1) AS later_view FROM events p WHERE p.event_type = 'purchase'""")
def q16_first_later_match(spark, sf_dir):
    events = _events(spark, sf_dir)
    bought, seen = (events.where(F.col("event_type") == k).select("event_id", "user_id", "ts") for k in ("purchase", "view"))
    return S.first_later(bought, seen, ["user_id"], "ts", "ts", ["ts", "event_id"], "event_id", "later_view").select("event_id", "later_view")


@query(f"""WITH d AS (SELECT company, step, any_value(day) AS day, sum(value) AS total FROM {_DAILY} GROUP BY company, step), f AS (SELECT company, day, sum(value) AS subscribed FROM {_DAILY} WHERE event_type = 'purchase' AND value <> 0 GROUP BY company, day),
s AS (SELECT d.company, d.step, d.day, d.total - lag(d.total) OVER (PARTITION BY d.company ORDER BY d.step) AS delta FROM d)
SELECT s.company, s.step, round(s.delta, 2) AS delta, round(f.subscribed, 2) AS subscribed, CASE WHEN abs(f.subscribed - s.delta) > 0.01 THEN '待复核' ELSE 'PASS' END AS status FROM s ASOF LEFT JOIN f ON s.company = f.company AND s.day >= f.day WHERE s.step > 1 AND f.subscribed > 0""")
def q17_delta_vs_flow(spark, sf_dir):
    daily = _of_companies(spark, sf_dir)
    totals = S.consecutive(daily.groupBy("company", "day").agg(F.sum("value").alias("total")), ["company"], ["day"])
    steps = totals.withColumn("delta", F.col("total") - F.lag("total").over(W.partitionBy("company").orderBy("step")))
    bought = daily.where("event_type = 'purchase' and value <> 0").groupBy("company", "day").agg(F.sum("value").alias("subscribed"))
    met = S.as_of(steps.where("step > 1"), bought, ["company"], "day", "subscribed", "subscribed").where("subscribed > 0")
    return met.select("company", "step", F.round("delta", 2).alias("delta"), F.round("subscribed", 2).alias("subscribed"), X.status(F.abs(F.col("subscribed") - F.col("delta")) > 0.01).alias("status"))


@query(f"""WITH i AS (SELECT l_orderkey, false AS critical FROM {_PRICED} WHERE status = '待复核' UNION ALL SELECT l_orderkey, false FROM lineitem GROUP BY l_orderkey HAVING abs(sum(l_extendedprice) - round(sum(l_extendedprice), 1)) > 0.01
UNION ALL SELECT l_orderkey, true FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 2), n AS (SELECT l_orderkey, count(*) AS issues, bool_or(critical) AS critical FROM i GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(issues, 0) AS issues, CASE WHEN critical THEN 'FAIL' WHEN issues > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN n USING (l_orderkey)""")
def q18_verdict_rollup(spark, sf_dir):
    # All three checks come from one aggregate by order, so lineitem is read and shuffled once.
    priced = _priced(spark, sf_dir).groupBy("l_orderkey").agg(F.count_if(F.col("status") == X.REVIEW).alias("prices"), S.sum_in_order("l_extendedprice", _PLACE).alias("held"), *[F.max((F.col("l_returnflag") == f).cast("int")).alias(f) for f in ("A", "N", "R")])
    off, mixed = F.abs(F.col("held") - F.round("held", 1)) > 0.01, F.col("A") + F.col("N") + F.col("R") > 2
    issues = F.col("prices") + off.cast("long") + mixed.cast("long")
    return priced.select("l_orderkey", issues.alias("issues"), X.verdict(mixed, issues).alias("verdict"))


# ---------------------------------------------------------------- records


@query("""WITH l AS (SELECT *, CASE WHEN l_discount > 0.05 THEN NULL ELSE l_extendedprice END AS amount, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT o_orderkey, l_linenumber, l_partkey, CASE WHEN amount IS NULL AND n = 1 AND o_totalprice <> 0 THEN o_totalprice ELSE amount END AS amount FROM orders JOIN l ON l_orderkey = o_orderkey""")
def q19_flow_explode(spark, sf_dir):
    line = F.struct("l_linenumber", "l_partkey", F.when(F.col("l_discount") > 0.05, None).otherwise(F.col("l_extendedprice")).alias("amount"))
    nested = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("parties")), "o_orderkey")
    each = nested.select("o_orderkey", "o_totalprice", F.size("parties").alias("n"), F.explode("parties").alias("p"))
    return each.select("o_orderkey", "p.l_linenumber", "p.l_partkey", R.fill_single(F.col("p.amount"), F.col("o_totalprice"), F.col("n")).alias("amount"))


_NESTED_EVENTS = """SELECT o_custkey::VARCHAR AS code, o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, o_orderpriority, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_discount > 0.08 THEN l_discount || '%' END AS ratio FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""


@query(f"""WITH e AS ({_NESTED_EVENTS}), k AS (SELECT code, o_orderkey, ym, o_orderpriority || '后' AS label FROM e GROUP BY ALL HAVING count(ratio) > 0), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY code, ym, label ORDER BY o_orderkey) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY o_orderkey) - 1 AS snapshot_order FROM f)
SELECT e.code AS stock_code, o.ym AS snapshot_date, o.label AS snapshot_type, o.snapshot_order, 'p' || l_partkey AS shareholder_name, l_extendedprice AS shares_held, CASE WHEN o.snapshot_order = 0 THEN 'yes' ELSE 'unknown' END AS is_original_founder FROM e JOIN o USING (code, o_orderkey) WHERE ratio IS NOT NULL""")
def q20_snapshot_build(spark, sf_dir):
    line = F.struct(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("investor_original_name"), F.lit(None).cast("string").alias("investor_short_name"), F.lit("PE").alias("investor_type"), F.lit(None).cast("double").alias("investment_amount"),
        F.col("l_extendedprice").alias("shares_acquired"), F.when(F.col("l_discount") > 0.08, F.concat(F.col("l_discount").cast("string"), F.lit("%"))).alias("shareholding_ratio_after_event"),
    )
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("investors"))
    events = _t(spark, sf_dir, "orders").join(lines, "o_orderkey").select(
        F.lit("c").alias("company_name"), F.col("o_custkey").cast("string").alias("stock_code"), F.col("o_orderkey").alias("event_no"), F.date_format("o_orderdate", "yyyy-MM").alias("event_date"), F.col("o_orderpriority").alias("event_type"), "investors",
        *[F.lit(None).cast(t).alias(n) for n, t in (("inferred_round", "string"), ("source_page", "string"), ("evidence_text", "string"), ("post_money_valuation", "double"), ("notes", "string"))],
    )
    out = R.snapshots(events)
    return out.select("stock_code", "snapshot_date", "snapshot_type", F.col("snapshot_order").cast("long").alias("snapshot_order"), "shareholder_name", "shares_held", "is_original_founder")


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' OR p_name LIKE '%gear%' THEN 'moving' WHEN p_name LIKE '%bolt%' THEN 'fixing' WHEN p_type = 'ECONOMY' THEN 'cheap' WHEN p_type = 'SMALL' THEN 'small' ELSE 'other' END AS kind FROM part""")
def q21_type_ladder(spark, sf_dir):
    name, kind = F.col("p_name"), F.col("p_type")
    return _t(spark, sf_dir, "part").select("p_partkey", T.ladder([(name.rlike("widget|gear"), "moving"), (name.contains("bolt"), "fixing"), (kind == "ECONOMY", "cheap"), (kind == "SMALL", "small")], "other").alias("kind"))


@query("""WITH m AS (SELECT c_custkey, c_nationkey, 'manual' AS source FROM customer WHERE c_nationkey % 2 = 0 AND c_acctbal > 0)
SELECT * FROM m UNION ALL SELECT c_custkey, c_nationkey, 'auto' FROM customer WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.c_nationkey = customer.c_nationkey)""")
def q22_source_precedence(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    manual = customers.where("c_nationkey % 2 = 0 and c_acctbal > 0").drop("c_acctbal").withColumn("source", F.lit("manual"))
    return S.precedence(manual, customers.drop("c_acctbal").withColumn("source", F.lit("auto")), ["c_nationkey"])


# ---------------------------------------------------------------- text


@query(r"""SELECT name, nullif(regexp_replace(regexp_replace(replace(name, 'Supplier#0', ''), 'md$', ''), '\d+$', ''), '') AS key, nullif(trim(regexp_replace(name, '\d+$', ''), '_'), '') AS key_coded
FROM (SELECT s_name AS name FROM supplier UNION ALL SELECT c_name || '_' FROM customer UNION ALL SELECT c_mktsegment || c_nationkey || 'md' FROM customer)""")
def q23_name_key(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer")
    names = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")).unionByName(customers.select(F.concat("c_name", F.lit("_")).alias("name"))).unionByName(customers.select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string"), F.lit("md")).alias("name")))
    return names.select("name", T.company_key(F.col("name"), "Supplier#0").alias("key"), T.company_key_coded(F.col("name")).alias("key_coded"))


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '!\[.*?\]\(.*?\)', '', 'g'), '<[^>]+>', '', 'g'), '(?s)```.*?```', '', 'g'), '#+\s*', '', 'g')"""


@query(rf"SELECT page_id, md5(regexp_replace({_CLEAN}, '^\s+|\s+$', '', 'g')) AS digest, length(regexp_replace({_CLEAN}, '^\s+|\s+$', '', 'g')) AS n FROM pages")
def q24_clean_text(spark, sf_dir):
    clean = _t(spark, sf_dir, "pages").select("page_id", T.clean(F.col("html")).alias("c"))
    return clean.select("page_id", F.md5("c").alias("digest"), F.length("c").cast("long").alias("n"))


@query(r"""WITH h AS (SELECT regexp_extract(url, '/([a-z]{2})/', 1) AS lang, page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS entry FROM pages), f AS (SELECT * FROM h WHERE entry <> '' QUALIFY row_number() OVER (PARTITION BY lang, entry ORDER BY page_id) = 1)
SELECT lang, entry, row_number() OVER (PARTITION BY lang ORDER BY page_id) AS entry_no FROM f""")
def q25_toc(spark, sf_dir):
    heads = _t(spark, sf_dir, "pages").select(F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"), "page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("entry")).where("entry <> ''")
    return S.keep_first(heads, ["lang", "entry"], ["page_id"]).select("lang", "entry", F.row_number().over(W.partitionBy("lang").orderBy("page_id")).cast("long").alias("entry_no"))


@query(r"""WITH c AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS section_id FROM conversations)
SELECT conv_id, section_id, min(turn) AS line_idx, md5(regexp_replace(string_agg(text, chr(10) ORDER BY turn), '^\s+|\s+$', '', 'g')) AS digest FROM c WHERE section_id > 0 GROUP BY conv_id, section_id""")
def q26_sections(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").withColumn("title", F.when(F.col("role") == "user", F.lit("user")))
    out = G.sections(turns, ["conv_id"], "title", ["turn"], "text")
    return out.select("conv_id", "section_id", "line_idx", F.md5("content").alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '^[A-Z][a-z]+ [a-z]+ ')) AS n1, count(*) FILTER (contains(line, '|')) AS n2, count(*) FILTER (contains(line, '.')) AS n3 FROM l GROUP BY doc_id)
SELECT doc_id, CASE WHEN n1 > 2 THEN 1 WHEN n2 > 0 THEN 2 ELSE 3 END::BIGINT AS tier, CASE WHEN n1 > 2 THEN n1 WHEN n2 > 0 THEN n2 ELSE n3 END AS boundaries FROM n""")
def q27_boundary_tiers(spark, sf_dir):
    tiers = G.tiered_lines(_t(spark, sf_dir, "documents"), ["doc_id"], "text", ((r"^([A-Z][a-z]+ [a-z]+ )", 1), (r"\|", 0), (r"\.", 0)))
    return tiers.groupBy("doc_id", "tier").agg(F.count("title").alias("boundaries"))


_WORDS = ("licen[sc]e", "tion and", "password|secret", "enen", r"\|")
_WORD_CASE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{w}') THEN {i}" for i, w in enumerate(_WORDS, 1)) + " END"


@query(f"SELECT doc_id, {_WORD_CASE}::BIGINT AS keyword_no FROM documents WHERE n_chars > 100 AND {_WORD_CASE} IS NOT NULL")
def q28_keyword_locate(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title"), F.col("n_chars").alias("length"))
    return G.locate(docs, _WORDS, 100).select("doc_id", "keyword_no")


_STRIP = "regexp_replace({}, '^[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g')"
_PLAIN = ("ouque", "entre", "the of", "ción", "ver")
_PLAIN_CASE = "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{w}'" for w in _PLAIN) + " END"


#: Lines that open a section of documents, and words of its title.
_KINDS, _TITLES = ((r"^([A-Z][a-z]+ [a-z]+ )", 1), (r"^(.*\|)", 1), (r"^(.*\.)", 1)), ("^[A-M]", "x")
_TITLE = " ".join(f"WHEN tier = {i} AND regexp_matches(line, '{p}') THEN {_STRIP.format(f"regexp_extract(line, '{p}', {g})")}" for i, (p, g) in enumerate(_KINDS, 1))


@query(rf"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents), m AS (SELECT *, CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '{_KINDS[0][0]}'))) > 2 THEN 1 WHEN len(list_filter(ls, lambda x: regexp_matches(x, '{_KINDS[1][0]}'))) > 0 THEN 2 ELSE 3 END AS tier FROM l),
e AS (SELECT doc_id, tier, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM m), t AS (SELECT *, CASE {_TITLE} END AS title FROM e), s AS (SELECT *, count(title) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM t),
g AS (SELECT doc_id, arg_min(title, line_no) AS title, min(line_no) AS line_idx, {_STRIP.format("string_agg(line, chr(10) ORDER BY line_no)")} AS content FROM s WHERE section > 0 GROUP BY doc_id, section),
h AS (SELECT doc_id, title, line_idx, content, 'title' AS method FROM g WHERE length(content) > 100 AND ({" OR ".join(f"regexp_matches(title, '{w}')" for w in _TITLES)})),
f AS (SELECT doc_id, text, {_PLAIN_CASE} AS word FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)), p AS (SELECT *, greatest(strpos(text, word) - 200, 1) AS start, strpos(text, word) + 2000 AS stop FROM f WHERE word IS NOT NULL),
a AS (SELECT * FROM h UNION ALL SELECT doc_id, '全文搜索: ' || word, length(left(text, start - 1)) - length(replace(left(text, start - 1), chr(10), '')), {_STRIP.format("substr(text, start, stop - start)")}, 'word' FROM p)
SELECT doc_id AS company, title, CAST(line_idx AS BIGINT) AS line_idx, method, md5(content) AS digest, length(content) AS length FROM a""")
def q29_fallback_search(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("company"), "text")
    return G.locate_all(docs, _TITLES, fallback_words=_PLAIN, kinds=_KINDS).select("company", "title", "line_idx", "method", F.md5("content").alias("digest"), "length")


@query(r"""WITH c AS (SELECT conv_id, turn, contains(text, 'que') AS hit, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 4 FOLLOWING) AS context FROM conversations)
SELECT conv_id, turn, md5(left(context, 500)) AS digest FROM c WHERE hit AND length(context) > 50""")
def q30_line_context(spark, sf_dir):
    out = G.line_context(_t(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", F.col("text").contains("que"))
    return out.select("conv_id", "turn", F.md5("context").alias("digest"))


@query(r"""SELECT doc_id, len(t) AS n, t[1] AS first_token, list_sum(list_transform(list_filter(t, lambda x: length(x) <= 9), lambda x: x::DOUBLE)) AS total FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS t FROM documents) WHERE len(t) > 0""")
def q31_number_tokens(spark, sf_dir):
    tokens = _t(spark, sf_dir, "documents").select("doc_id", T.every(F.col("text"), "[0-9]+").alias("t")).where(F.size("t") > 0)
    short = F.filter("t", lambda x: F.length(x) <= 9)
    total = F.when(F.size(short) > 0, F.aggregate(F.transform(short, T.number), F.lit(0.0), lambda a, x: a + x))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n"), F.get("t", F.lit(0)).alias("first_token"), total.alias("total"))


_RULES = (("licence", "(?i)licen[sc]e"), ("secret", "password|secret|token"), ("address", r"[0-9]+\.[0-9]+\.[0-9]+"), ("table", r" \| "), ("shout", "!!"))
_rules_sql = lambda rules: "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in rules) + " END"


@query(f"SELECT doc_id, {_rules_sql(_RULES)} AS forward, {_rules_sql(_RULES[::-1])} AS backward FROM documents")
def q32_event_type_rules(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.event_type(F.col("text"), _RULES).alias("forward"), T.event_type(F.col("text"), _RULES[::-1]).alias("backward"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{2,20}(?:tion|ble)')) AS name, generate_subscripts(regexp_extract_all(text, '[a-z]{2,20}(?:tion|ble)'), 1) AS i FROM documents), f AS (SELECT doc_id, name, min(i) AS i FROM t GROUP BY doc_id, name QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) <= 8)
SELECT doc_id, string_agg(name, ',' ORDER BY i) AS names FROM f GROUP BY doc_id""")
def q33_participants(spark, sf_dir):
    names = T.participants(F.col("text"), "([a-z]{2,20}(?:tion|ble))", 8)
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(names, ",").alias("names")).where("names <> ''")


@query(f"""WITH f AS (SELECT * FROM {_EVENTS} QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) = 1) SELECT user_id, day, event_id FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 40""")
def q34_timeline(spark, sf_dir):
    once = S.keep_first(_events(spark, sf_dir), ["user_id", "day"], ["event_id"])
    return S.first_k(once, ["user_id"], ["event_id"], 40).select("user_id", "day", "event_id")


@query(r"""SELECT page_id, unnest(range(len(c))) AS position, regexp_replace(regexp_replace(unnest(c), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') AS cell FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS c FROM pages)""")
def q35_html_rows(spark, sf_dir):
    cells = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(B.cells(F.col("html"), "(?s)<li>(.*?)</li>")).alias("position", "cell"))
    return cells.withColumn("position", F.col("position").cast("long"))


# ---------------------------------------------------------------- constraints and profiles


def _blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.when(F.col("c_nationkey") % 5 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).alias("balance"))


_BLANKED = "(SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal::VARCHAR END AS balance FROM customer)"


@query(" UNION ALL ".join(f"SELECT c_custkey, '{c}' AS field FROM {_BLANKED} WHERE {c} IS NULL OR {c} = ''" for c in ("segment", "name", "balance")))
def q36_required_fields(spark, sf_dir):
    return K.required(_blanked(spark, sf_dir), ["c_custkey"], ["segment", "name", "balance"])


_TAILS = r"""(SELECT page_id, nullif(regexp_extract(url, '/([^/?#]*)[^/]*$', 1), '') AS tail, regexp_extract(url, '^([a-z]+):', 1) AS scheme FROM pages)"""


@query(f"SELECT page_id, 'tail' AS field, tail AS value FROM {_TAILS} WHERE tail IS NOT NULL AND try_cast(tail AS DOUBLE) IS NULL UNION ALL SELECT page_id, 'scheme', scheme FROM {_TAILS} WHERE try_cast(scheme AS DOUBLE) IS NULL")
def q37_numeric_parse(spark, sf_dir):
    tails = _t(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("url", r"/([^/?#]*)[^/]*$", 1), F.lit("")).alias("tail"), F.regexp_extract("url", "^([a-z]+):", 1).alias("scheme"))
    return K.numeric(tails, ["page_id"], ["tail", "scheme"])


_CUSTOMER_RULES = [K.Rule("c_name", "pattern", r"^Customer#\d{9}$"), K.Rule("c_name", "length", 19), K.Rule("c_mktsegment", "member", ("BUILDING", "MACHINERY", "FURNITURE")), K.Rule("c_acctbal", "least", 1000), K.Rule("c_name", "not_prefix", ("Customer#00000001",))]


@query(r"""SELECT c_custkey, concat_ws(',', CASE WHEN NOT regexp_matches(c_name, '^Customer#\d{9}$') THEN 'c_name:pattern' END, CASE WHEN length(c_name) < 19 THEN 'c_name:length' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'c_mktsegment:member' END,
CASE WHEN c_acctbal < 1000 THEN 'c_acctbal:least' END, CASE WHEN starts_with(c_name, 'Customer#00000001') THEN 'c_name:not_prefix' END) AS errors FROM customer""")
def q38_constraints(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", F.array_join(K.errors(_CUSTOMER_RULES), ",").alias("errors"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS total, count({c}) AS present, count(*) - count({c}) AS \"null\", round(count({c}) * 100.0 / count(*), 1)::DOUBLE AS rate FROM {_BLANKED}" for c in ("segment", "name", "balance")))
def q39_completeness(spark, sf_dir):
    return S.completeness(_blanked(spark, sf_dir), ["segment", "name", "balance"])


@query("""SELECT l_returnflag, l_linestatus, count(*) FILTER (l_discount = 0 AND l_quantity > 45) AS critical, count(*) FILTER (l_tax > 0.07) AS high, count(*) FILTER (l_extendedprice < 2000) AS medium, count(*) FILTER (l_quantity <= 2) AS low
FROM lineitem WHERE (l_discount = 0 AND l_quantity > 45) OR l_tax > 0.07 OR l_extendedprice < 2000 OR l_quantity <= 2 GROUP BY ALL""")
def q40_anomalies(spark, sf_dir):
    checks = [(F.expr("l_discount = 0 and l_quantity > 45"), "critical"), (F.col("l_tax") > 0.07, "high"), (F.col("l_extendedprice") < 2000, "medium"), (F.col("l_quantity") <= 2, "low")]
    counts = [F.count_if(c).alias(s) for c, s in checks]
    some = F.col(N.SEVERITIES[0]) + F.col(N.SEVERITIES[1]) + F.col(N.SEVERITIES[2]) + F.col(N.SEVERITIES[3]) > 0
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*counts).where(some)


# ---------------------------------------------------------------- acquisition


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, 'example\\.(com|net)') AND NOT regexp_matches(url, 'utm_source|page=|adult')")
def q41_include_exclude(spark, sf_dir):
    return _t(spark, sf_dir, "pages").where(A.title_kept(F.col("url"), r"example\.(com|net)", ("utm_source", "page=", "adult"))).select("page_id", "url")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) = 1")
def q42_best_version(spark, sf_dir):
    return S.best(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1997) AS ordered FROM customer")
def q43_missing_companies(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1997).select(F.col("o_custkey").alias("c_custkey"))
    return S.has_partner(_t(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], "ordered")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1997)")
def q43b_without_download(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1997).select(F.col("o_custkey").alias("c_custkey"))
    return S.missing(_t(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"])


@query("""WITH s AS (SELECT s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'k' || s_suppkey END AS exact, 'n' || s_nationkey AS relaxed FROM supplier), e AS (SELECT exact, min(s_name) AS n FROM s WHERE exact IS NOT NULL GROUP BY exact), r AS (SELECT relaxed, min(s_name) AS n FROM s GROUP BY relaxed)
SELECT c_custkey, coalesce(e.n, r.n) AS supplier FROM customer LEFT JOIN e ON 'k' || c_custkey = e.exact LEFT JOIN r ON 'n' || c_nationkey = r.relaxed""")
def q44_patch_and_retry(spark, sf_dir):
    suppliers = _t(spark, sf_dir, "supplier").select("s_name", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("k"), F.col("s_suppkey").cast("string"))).alias("exact"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("relaxed"))
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    keys = (F.concat(F.lit("k"), F.col("c_custkey").cast("string")), "exact"), (F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "relaxed")
    return S.two_step_match(customers, suppliers, *keys, "s_name", "supplier").select("c_custkey", "supplier")


@query("SELECT c_custkey, CASE WHEN trim(coalesce(segment, '')) = '' THEN p.seg ELSE segment END AS segment FROM " + _BLANKED + " LEFT JOIN (SELECT c_custkey, 'patched-' || c_nationkey AS seg FROM customer WHERE c_custkey % 3 = 0) p USING (c_custkey)")
def q44b_patch_blank(spark, sf_dir):
    patch = _t(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("patched-"), F.col("c_nationkey").cast("string")).alias("segment"))
    return S.patch_blank(_blanked(spark, sf_dir).select("c_custkey", "segment"), patch, ["c_custkey"], ["segment"])


# ---------------------------------------------------------------- cells, names, dates, windows of text


@query(r"""SELECT o_orderkey, lpad(year(o_orderdate)::VARCHAR, 4, '0') || lpad(month(o_orderdate)::VARCHAR, 2, '0') || lpad(day(o_orderdate)::VARCHAR, 2, '0') AS file_date FROM orders""")
def q45_file_date(spark, sf_dir):
    shown = F.concat_ws("/", F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", T.file_date(shown).alias("file_date"))


@query("""SELECT page_id, CASE WHEN rel = '' OR starts_with(rel, 'http') THEN rel ELSE 'https://static.example.org/' || ltrim(rel, '/') END AS url FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^[a-z]+:/', '') END AS rel FROM pages)""")
def q46_absolute_url(spark, sf_dir):
    relative = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^[a-z]+:/", ""))
    return _t(spark, sf_dir, "pages").select("page_id", T.absolute_url(relative, "https://static.example.org").alias("url"))


@query(r"""SELECT event_id, nullif(try_cast(regexp_replace(props, '[^0-9.]', '', 'g') AS DOUBLE), 0) AS number FROM events""")
def q47_clean_number(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", T.clean_number(F.col("props")).alias("number"))


@query(r"""SELECT doc_id, left(regexp_replace(substr(text, greatest(pos - 100, 1), pos + length(hit) + 300 - greatest(pos - 100, 1)), '^\s+|\s+$', '', 'g'), 200) AS evidence FROM (SELECT doc_id, text, regexp_extract(text, '[0-9]{4,}') AS hit, strpos(text, regexp_extract(text, '[0-9]{4,}')) AS pos FROM documents WHERE regexp_matches(text, '[0-9]{4,}'))""")
def q48_evidence_window(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", T.window_around(F.col("text"), "[0-9]{4,}", 100, 300, 200).alias("evidence"))
    return docs.where("evidence is not null")


@query(r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]{5,6}') AS m, list_transform(string_split_regex(text, '[0-9]{5,6}'), lambda x: length(x)) AS gaps FROM documents WHERE regexp_matches(text, '[0-9]{5}')),
e AS (SELECT doc_id, text, i, m[i] AS hit, list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM t))
SELECT doc_id, i AS event_no, 'number' AS event_type, left(hit, 4) || '-' || lpad(substr(hit, 5), 2, '0') AS event_date, left(regexp_replace(substr(text, greatest(start - 60, 0)::BIGINT + 1, (start + length(hit) + 60 - greatest(start - 60, 0))::BIGINT), '^\s+|\s+$', '', 'g'), 500) AS evidence_text, 'number' AS notes FROM e""")
def q49_context_events(spark, sf_dir):
    rules = (("number", r"([0-9]{4})([0-9]{1,2})", 60, 60, "number", False),)
    return E.context_events(_t(spark, sf_dir, "documents"), ["doc_id"], "text", rules)
