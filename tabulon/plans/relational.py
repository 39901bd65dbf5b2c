"""Queries of the row algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import expr
from tabulon.operators import relational as R
from tabulon.plans.base import Registry

r = Registry()


@r.add(
    "flagship_monthly_revenue",
    """SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 1000 AND l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""",
    "lineitem",
    "orders",
)
def flagship(lineitem, orders):
    o = R.filter_rows(orders, "o_totalprice", "gt", 1000).select("o_orderkey", "o_orderdate")
    li = R.filter_rows(lineitem, "l_shipdate", "gte", "1995-01-01").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    j = R.inner_join(li, o, "l_orderkey", "o_orderkey").withColumn("period", expr.bucket_date(F.col("o_orderdate"), "month"))
    g = R.group_aggregate(j, "period", {"revenue": ("revenue", "sum")}).withColumn("revenue", F.round("revenue", 2))
    return R.top_rows(g, "revenue", 25, "period")


for op, sign in (("gt", ">"), ("lte", "<="), ("eq", "="), ("neq", "<>")):
    r.add(f"filter_numeric_{op}", f"SELECT p_partkey, p_size FROM part WHERE p_size {sign} 25", "part")(lambda part, op=op: R.filter_rows(part, "p_size", op, "25").select("p_partkey", "p_size"))

r.add("filter_date_gte", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01'", "orders")(lambda o: R.filter_rows(o, "o_orderdate", "gte", "1996-07-01").select("o_orderkey"))
r.add("filter_text_eq", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'", "customer")(lambda c: R.filter_rows(c, "c_mktsegment", "eq", "Building").select("c_custkey"))
_SOME = "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END"
_some = lambda o: o.withColumn("p", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")))
r.add("filter_text_neq_keeps_null", f"SELECT o_orderkey FROM orders WHERE lower(coalesce({_SOME}, '')) <> '1-urgent'", "orders")(lambda o: R.filter_rows(_some(o), "p", "neq", "1-URGENT").select("o_orderkey"))
r.add("filter_is_null", f"SELECT o_orderkey FROM orders WHERE {_SOME} IS NULL", "orders")(lambda o: R.filter_rows(_some(o), "p", "is_null").select("o_orderkey"))
r.add("filter_not_null", f"SELECT o_orderkey FROM orders WHERE {_SOME} IS NOT NULL", "orders")(lambda o: R.filter_rows(_some(o), "p", "not_null").select("o_orderkey"))
for op, sql in (("contains", "contains(lower(p_name), 're')"), ("starts_with", "starts_with(lower(p_type), 'eco')"), ("ends_with", "ends_with(lower(p_type), 'y')")):
    col = "p_name" if op == "contains" else "p_type"
    val = {"contains": "RE", "starts_with": "Eco", "ends_with": "Y"}[op]
    r.add(f"filter_{op}", f"SELECT p_partkey FROM part WHERE {sql}", "part")(lambda part, op=op, col=col, val=val: R.filter_rows(part, col, op, val).select("p_partkey"))

r.add("project_known", "SELECT n_nationkey, n_name FROM nation", "nation")(lambda n: R.project(n, ["n_nationkey", "n_name", "absent"]))
r.add("count_rows", "SELECT count(*) AS row_count FROM lineitem", "lineitem")(R.count_rows)

for grain, sql in (
    ("year", "strftime(o_orderdate, '%Y')"),
    ("quarter", "strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)"),
    ("month", "strftime(o_orderdate, '%Y-%m')"),
    ("week", "strftime(o_orderdate, '%G-W%V')"),
    ("day", "strftime(o_orderdate, '%Y-%m-%d')"),
):
    q = lambda o, grain=grain: o.groupBy(expr.bucket_date(F.col("o_orderdate"), grain).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    r.add(f"bucket_{grain}", f"SELECT {sql} AS bucket, count(*) AS n FROM orders GROUP BY 1", "orders")(q)

for op in ("count", "sum", "avg", "min", "max"):
    sql = "count(*)" if op == "count" else f"round({op}(l_extendedprice), 2)"
    q = lambda li, op=op: R.aggregate_rows(li, "l_returnflag", "l_extendedprice", op).withColumn(f"{op}_l_extendedprice", F.round(f"{op}_l_extendedprice", 2))
    r.add(f"group_{op}", f"SELECT l_returnflag, {sql} AS {op}_l_extendedprice FROM lineitem GROUP BY 1", "lineitem")(q)
r.add("group_400_keys_avg", "SELECT l_suppkey, round(avg(l_extendedprice), 2) AS avg_price FROM lineitem GROUP BY 1", "lineitem")(
    lambda li: R.group_aggregate(li, "l_suppkey", {"avg_price": ("l_extendedprice", "avg")}).withColumn("avg_price", F.round("avg_price", 2))
)
r.add("group_text_numbers", "SELECT o_orderstatus, round(sum(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1", "orders")(
    lambda o: R.group_aggregate(o.withColumn("t", F.when(F.col("o_orderkey") % 3 == 0, F.lit("none")).otherwise(F.format_number(F.round("o_totalprice", 2), 2))), "o_orderstatus", {"total": ("t", "sum")}).withColumn("total", F.round("total", 2))
)
r.add("top_10_price", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 10000 ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber LIMIT 10", "lineitem")(
    lambda li: R.top_rows(R.filter_rows(li, "l_extendedprice", "gt", 10000).withColumn("tie", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "l_extendedprice", 10, "tie").select("l_orderkey", "l_linenumber", "l_extendedprice")
)
r.add("lowest_5_balance", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5", "customer")(lambda c: R.top_rows(c, "c_acctbal", 5, "c_custkey", False).select("c_custkey", "c_acctbal"))
r.add("max_row", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1", "orders")(lambda o: R.max_row(o, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice"))
r.add("min_row", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1", "orders")(lambda o: R.max_row(o, "o_totalprice", "o_orderkey", lowest=True).select("o_orderkey", "o_totalprice"))
r.add("distinct_counts", "SELECT count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_returnflag) AS l_returnflag FROM lineitem", "lineitem")(lambda li: R.count_distinct(li, ["l_partkey", "l_returnflag"]))
r.add("duplicate_rows", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity)", "lineitem")(
    lambda li: R.duplicate_rows(li, ["l_returnflag", "l_linestatus", "l_quantity"])
)
r.add("nearest_rank", "WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT share, value FROM s, (VALUES (0.5), (0.95)) t(share) WHERE i = round_even(CAST(share AS DOUBLE) * (n - 1), 0)", "events")(
    lambda e: R.nearest_rank_percentile(e, "value", [0.5, 0.95])
)
r.add(
    "headline",
    """WITH g AS (SELECT c_mktsegment AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY v DESC, k) AS rn, sum(v) OVER () AS t, count(*) OVER () AS n FROM g)
    SELECT max(k) FILTER (rn = 1) AS leader, round(max(v) FILTER (rn = 1), 2) AS leader_value, round(max(v) FILTER (rn = 1) / max(t) * 100, 2) AS share_pct,
    round(max(v) FILTER (rn = 1) / max(t) * 100, 2) >= 50 AS more_than_rest, max(k) FILTER (rn = 2) AS runner_up, max(n) AS groups FROM s""",
    "customer",
)(lambda c: R.aggregate_headline(R.aggregate_rows(c, "c_mktsegment", "c_acctbal", "sum"), "c_mktsegment", "sum_c_acctbal").withColumn("leader_value", F.round("leader_value", 2)))

r.add("inner_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer")(lambda o, c: R.inner_join(o, c, "o_custkey", "c_custkey").select("o_orderkey", "c_name", "o_totalprice"))
r.add(
    "inner_join_null_keys",
    "WITH a AS (SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey END AS k FROM nation), b AS (SELECT r_name, CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END AS k FROM region) SELECT n_nationkey, r_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k",
    "nation",
    "region",
)(lambda n, g: R.join_sources(n.withColumn("k", F.when(F.col("n_regionkey") != 0, F.col("n_regionkey"))), g.withColumn("rk", F.when(F.col("r_regionkey") != 0, F.col("r_regionkey"))), "k", "rk", "region").select("n_nationkey", "r_name"))
r.add(
    "left_join_latest",
    "SELECT c_custkey, m.o_orderkey AS last_order, m.o_totalprice AS last_price FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) m ON c_custkey = o_custkey AND rn = 1",
    "customer",
    "orders",
)(lambda c, o: R.left_join_latest(c.select("c_custkey"), o.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "o_orderkey", ["o_orderkey", "o_totalprice"]).withColumnsRenamed({"o_orderkey": "last_order", "o_totalprice": "last_price"}))
r.add(
    "lookup_join",
    """WITH d AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0)
    SELECT CASE WHEN d.c_custkey IS NULL THEN NULL ELSE 'c_mktsegment' END AS attribute, c_mktsegment AS label, round(sum(o_totalprice), 2) AS total, count(*) AS rows FROM orders LEFT JOIN d ON o_custkey = c_custkey GROUP BY 1, 2""",
    "orders",
    "customer",
)(lambda o, c: R.lookup_join_aggregate(o, "o_custkey", c.filter("c_custkey % 5 <> 0"), "c_custkey", "o_totalprice", ["c_mktsegment"]).withColumn("total", F.round("total", 2)))

_INCOMING = "inc AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (5, 6) THEN o_orderstatus || 'x' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 >= 4), cur AS (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 < 7)"


def _parts(o):
    inc = o.filter("o_orderkey % 10 >= 4").select("o_orderkey", F.when((F.col("o_orderkey") % 10).isin(5, 6), F.concat("o_orderstatus", F.lit("x"))).otherwise(F.col("o_orderstatus")).alias("s"))
    cur = o.filter("o_orderkey % 10 < 7").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    return [x.withColumn("__row_hash", expr.row_hash(F.col("o_orderkey"), F.col("s"))) for x in (inc, cur)]


r.add("classify_merge", f"WITH {_INCOMING} SELECT inc.o_orderkey, CASE WHEN cur.o_orderkey IS NULL THEN 'insert' WHEN inc.s = cur.s THEN 'unchanged' ELSE 'update' END AS __change FROM inc LEFT JOIN cur USING (o_orderkey)", "orders")(
    lambda o: R.classify_merge(*_parts(o), ["o_orderkey"]).select("o_orderkey", "__change")
)
r.add("append_dedup", f"WITH {_INCOMING} SELECT o_orderkey, s FROM inc WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.o_orderkey = inc.o_orderkey AND cur.s = inc.s)", "orders")(lambda o: R.append_dedup(*_parts(o)).select("o_orderkey", "s"))
r.add(
    "join_coverage",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1), j AS (SELECT a.n AS na, b.n AS nb FROM a FULL JOIN b USING (k))
    SELECT count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL) AS overlap, count(na) AS distinct_a, count(nb) AS distinct_b, CAST(sum(na) AS BIGINT) AS rows_a, CAST(sum(nb) AS BIGINT) AS rows_b,
    CAST(sum(na) FILTER (nb IS NOT NULL) AS BIGINT) AS matched_a, CAST(sum(nb) FILTER (na IS NOT NULL) AS BIGINT) AS matched_b, round(sum(na) FILTER (nb IS NOT NULL) / sum(na), 6) AS rate_a, round(sum(nb) FILTER (na IS NOT NULL) / sum(nb), 6) AS rate_b FROM j""",
    "orders",
    "customer",
)(lambda o, c: R.join_coverage(o, "o_custkey", c.filter("c_custkey % 3 <> 0"), "c_custkey"))
r.add("latest_per_key", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1", "orders")(lambda o: R.latest_per_key(o, ["o_custkey"], "o_orderkey", ["o_orderkey"]))
r.add("top_values", "SELECT 'c_mktsegment' AS \"column\", c_mktsegment AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS rank FROM customer GROUP BY 2 QUALIFY rank <= 3", "customer")(lambda c: R.top_values(c, ["c_mktsegment"], 3).withColumn("rank", F.col("rank").cast("bigint")))
r.add(
    "period_change",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY p) AS rn, count(*) OVER () AS n, lag(v) OVER (ORDER BY p) AS pv FROM m),
    a AS (SELECT max(n) AS periods, max(v) FILTER (rn = n) AS lv, max(pv) FILTER (rn = n) AS pvv, avg(v) FILTER (rn <= n // 2) AS f, avg(v) FILTER (rn > n // 2) AS g FROM s)
    SELECT periods, round(lv, 2) AS last_value, round(pvv, 2) AS previous_value, round((lv - pvv) / abs(pvv) * 100, 2) AS change_pct, round((g - f) / abs(f) * 100, 2) AS half_pct,
    CASE WHEN round((g - f) / abs(f) * 100, 2) > 10 THEN 'growing' WHEN round((g - f) / abs(f) * 100, 2) < -10 THEN 'declining' ELSE 'steady' END AS trend FROM a""",
    "orders",
)(lambda o: R.period_change(o.groupBy(expr.bucket_date(F.col("o_orderdate"), "month").alias("p")).agg(F.sum("o_totalprice").alias("v")), "p", "v"))
r.add(
    "concentration",
    """WITH g AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY v DESC, k) AS rn, count(*) OVER () AS n FROM g),
    a AS (SELECT count(*) AS entities, round(sum(v) FILTER (rn <= 10) / sum(v) * 100, 2) AS top_share_pct, round(sum(v) FILTER (rn <= ceil(n * 0.2)) / sum(v) * 100, 2) AS pareto_share_pct FROM s) SELECT *, pareto_share_pct >= 60 AS concentrated FROM a""",
    "orders",
)(lambda o: R.concentration(o, "o_custkey", "o_totalprice"))
r.add("history_validity", "SELECT o_custkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS valid_to FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)", "orders")(
    lambda o: R.history_with_validity(o.select("o_custkey", "o_orderdate").distinct(), ["o_custkey"], "o_orderdate").withColumnRenamed("__valid_to", "valid_to")
)
r.add("history_as_of", "SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' GROUP BY 1", "orders")(
    lambda o: R.as_of(o.select("o_custkey", "o_orderdate").distinct(), ["o_custkey"], F.lit("1996-01-01").cast("timestamp_ntz"), "o_orderdate").select("o_custkey", "o_orderdate")
)
r.add("concat_align", "SELECT s_suppkey AS k, s_name AS name, NULL::DOUBLE AS size FROM supplier UNION ALL SELECT p_partkey, p_name, CAST(p_size AS DOUBLE) FROM part", "supplier", "part")(
    lambda s, p: R.concat(*[R.align_to_schema(x, [("k", "bigint"), ("name", "string"), ("size", "double")]) for x in (s.selectExpr("s_suppkey k", "s_name name"), p.selectExpr("p_partkey k", "p_name name", "p_size size"))])
)
r.add("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "lineitem")(lambda li: R.distinct_rows(li.select("l_returnflag", "l_linestatus")))
r.add("throughput", "SELECT event_id, round(CAST(json_extract(props, '$.k') AS DOUBLE) * 1000 / value, 4) AS per_s FROM events WHERE value > 0", "events")(
    lambda e: e.filter("value > 0").select("event_id", F.round(F.get_json_object("props", "$.k").try_cast("double") * 1000 / F.col("value"), 4).alias("per_s"))
)

QUERIES, SQL = r.queries, r.sql
