"""Queries of profiling, findings, cleaning, contracts, loads, marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon import session
from tabulon.functions import expr
from tabulon.operators import catalog, cleaning, insights, loads, marts, profile
from tabulon.operators import contract as C
from tabulon.operators import relational as R
from tabulon.plans.base import RATE_LIMIT_SQL, TEXT_ORDERS, Registry, text_orders
from tabulon.sources import files
from tabulon.streaming import streams

r = Registry()
_HOLES = "h AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS note FROM orders)"
_holes = lambda o: o.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("note"))

r.add("missingness", f"WITH {_HOLES} SELECT 'price' AS \"column\", count(*) FILTER (price IS NULL) AS missing, round(count(*) FILTER (price IS NULL) / count(*), 6) AS rate FROM h UNION ALL SELECT 'note', count(*) FILTER (note = ''), round(count(*) FILTER (note = '') / count(*), 6) FROM h", "orders")(lambda o: profile.missingness(_holes(o), ["price", "note"]))

_NUM = """SELECT '{c}' AS "column", count({c}) AS count, 0::BIGINT AS invalid, count(*) FILTER ({c} = 0) AS zeros, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
 round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max, round(stddev_pop({c}), 4) AS std,
 round((SELECT avg(power(x.{c} - m.a, 3)) / power(stddev_pop(x.{c}), 3) FROM {t} x, (SELECT avg({c}) AS a FROM {t}) m), 4) AS skewness FROM {t}"""
r.add("numeric_summary", " UNION ALL ".join(_NUM.format(c=c, t="lineitem") for c in ("l_quantity", "l_discount")), "lineitem")(lambda li: profile.numeric_summary(li, ["l_quantity", "l_discount"]))
r.add(
    "iqr_outliers",
    """WITH q AS (SELECT round(quantile_cont(o_totalprice, 0.25), 4) AS a, round(quantile_cont(o_totalprice, 0.75), 4) AS b FROM orders),
    s AS (SELECT count(*) AS n, count(*) FILTER (o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) AS f, avg(power(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 3)) / power(stddev_pop(o_totalprice), 3) AS sk FROM orders, q)
    SELECT 'o_totalprice' AS "column", n AS count, f AS outliers, round(f / n, 6) AS rate, CASE WHEN abs(sk) >= 1 OR f / n >= 0.1 THEN 'strongly_skewed_or_heavy_tailed' WHEN f > 0 THEN 'some_tail_values' ELSE 'no_iqr_tail_flags' END AS shape FROM s""",
    "orders",
)(lambda o: profile.iqr_outliers(o, ["o_totalprice"]))
r.add(
    "categorical_summary",
    """WITH g AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS rn FROM g)
    SELECT 'o_orderpriority' AS "column", CAST(sum(n) AS BIGINT) AS non_null, count(*) AS "distinct", sum(n) >= 50 AND count(*) / sum(n) > 0.5 AS high_cardinality, string_agg(v || '=' || n, ';' ORDER BY rn) FILTER (rn <= 5) AS top FROM s""",
    "orders",
)(lambda o: profile.categorical_summary(o, ["o_orderpriority"]))
_DAYS = "d AS (SELECT CASE WHEN o_orderkey % 50 > 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders), p AS (SELECT strftime(d, '%Y-%m') AS m, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY 1)"
_days = lambda o: o.select(F.when(F.col("o_orderkey") % 50 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon").alias("day"))
r.add(
    "time_summary",
    f"""WITH {_DAYS}, e AS (SELECT min(d) AS a, max(d) AS b, count(d) AS k, count(*) - count(d) AS bad FROM d)
    SELECT a AS first, b AS last, date_diff('day', a, b) AS span_days, k AS parsed, bad AS invalid, count(*) AS periods, arg_min(m, (-n, m)) AS busiest, max(n) AS busiest_rows, arg_min(m, (n, m)) AS quietest FROM p, e GROUP BY a, b, k, bad""",
    "orders",
)(lambda o: profile.time_summary(_days(o), "day").withColumn("span_days", F.col("span_days").cast("bigint")))
r.add("time_series", f"WITH {_DAYS} SELECT m AS period, n FROM p ORDER BY 1 DESC LIMIT 120", "orders")(lambda o: profile.time_series(_days(o), "day"))
_COR = "SELECT '{a}' AS \"column\", '{b}' AS other, count(*) AS n, round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) AS r FROM lineitem"
r.add("correlations", " UNION ALL ".join(_COR.format(a=a, b=b) for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))), "lineitem")(lambda li: profile.correlations(li, ["l_quantity", "l_extendedprice", "l_discount"]))
r.add("missingness_patterns", f"""WITH {_HOLES}, g AS (SELECT 'o_orderstatus' AS group_col, o_orderstatus AS v, count(*) AS n, count(*) FILTER (price IS NULL) AS m FROM h GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), count(*) FILTER (price IS NULL) FROM h GROUP BY 2),
    s AS (SELECT group_col, max(m / n) FILTER (n >= 5) - min(m / n) FILTER (n >= 5) AS strength FROM g GROUP BY 1 HAVING count(*) BETWEEN 2 AND 10 AND sum(m) >= 10 AND sum(m) >= 0.01 * sum(n))
    SELECT 'price' AS target, group_col, round(strength, 4) AS strength FROM s WHERE strength >= 0.5 ORDER BY s.strength DESC, group_col LIMIT 1""", "orders")(lambda o: profile.missingness_patterns(_holes(o), ["price"], ["o_orderstatus", "o_orderpriority"]))
_FOUND_IN = ("price", "net", "tail")
_TAILS = "SELECT '{0}' AS c, count(*) FILTER ({0} < a - 1.5 * (b - a) OR {0} > b + 1.5 * (b - a)) AS n FROM x, (SELECT quantile_cont({0}, 0.25) AS a, quantile_cont({0}, 0.75) AS b FROM x)"
_PAIR = "SELECT '{0}' AS a, '{1}' AS b, covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) AS r FROM x"
r.add(
    "report_findings",
    f"""WITH x AS (SELECT l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net, power(l_quantity, 4) AS tail, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag FROM lineitem),
    m AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, count(*) FILTER ({c} IS NULL) AS n FROM x" for c in (*_FOUND_IN, "flag"))}), d AS (SELECT CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM x GROUP BY price, net, tail, flag)),
    t AS ({" UNION ALL ".join(map(_TAILS.format, _FOUND_IN))}), c AS ({" UNION ALL ".join(_PAIR.format(*p) for p in (("price", "net"), ("price", "tail"), ("net", "tail")))})
    SELECT 'missing' AS kind, c || ' is missing in ' || n || ' rows' AS finding FROM (SELECT * FROM m WHERE n > 0 ORDER BY n DESC, c LIMIT 3) UNION ALL SELECT 'duplicates', n || ' rows repeat another' FROM d WHERE n > 0
    UNION ALL SELECT 'tails', c || ' has ' || n || ' values in its tails' FROM t WHERE n > 0 UNION ALL SELECT 'correlation', a || ' and ' || b || ' move together' FROM c WHERE abs(r) >= 0.8""",
    "lineitem",
)(
    lambda li: profile.findings(
        li.select(F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.pow("l_quantity", F.lit(4)).alias("tail"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag")),
        list(_FOUND_IN),
    )
)

r.add(
    "breakdown",
    """WITH g AS (SELECT p_brand AS k, sum(p_retailprice) AS t, count(*) AS n FROM part GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY t DESC, k) AS rn FROM g), p AS (SELECT least(rn, 9) AS place, CASE WHEN rn <= 8 THEN k ELSE 'Other' END AS label, sum(t) AS t, sum(n) AS n, count(*) AS c FROM s GROUP BY 1, 2)
    SELECT place, label, round(t, 2) AS value, CAST(n AS BIGINT) AS rows, c AS values, round(t / sum(t) OVER () * 100, 2) AS share_pct FROM p""",
    "part",
)(lambda p: insights.breakdown(p, "p_retailprice", "p_brand").withColumn("place", F.col("place").cast("bigint")))
r.add(
    "takeaway",
    """WITH g AS (SELECT p_brand AS k, sum(p_retailprice) AS t FROM part GROUP BY 1), s AS (SELECT k, round(t, 2) AS v, round(t / sum(t) OVER () * 100, 2) AS p, row_number() OVER (ORDER BY t DESC, k) AS rn FROM g),
    o AS (SELECT max(k) FILTER (rn = 1) AS leader, max(p) FILTER (rn = 1) AS share, max(v) FILTER (rn = 1) AS a, max(v) FILTER (rn = 2) AS b FROM s)
    SELECT leader, share, CASE WHEN share >= 50 THEN 'dominates' WHEN a < 1.1 * b THEN 'neck_and_neck' ELSE 'leads' END AS takeaway FROM o""",
    "part",
)(lambda p: insights.takeaway(insights.breakdown(p, "p_retailprice", "p_brand")))
r.add("trend", "SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS value, count(*) AS rows FROM orders GROUP BY 1", "orders")(lambda o: insights.trend(o, "o_totalprice", "o_orderdate"))
r.add("ranking", "WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS entity, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT row_number() OVER (ORDER BY v DESC, entity) AS rank, entity, round(v, 2) AS value, round(v / sum(v) OVER () * 100, 2) AS share_pct FROM g QUALIFY rank <= 10", "orders")(
    lambda o: insights.ranking(o, "o_totalprice", "o_custkey").withColumn("rank", F.col("rank").cast("bigint"))
)
r.add(
    "distribution",
    """WITH e AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 10 AS w FROM lineitem), c AS (SELECT CAST(least(floor((l_quantity - lo) / w), 9) AS INT) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
    SELECT CAST(b.bin AS INT) AS bin, round(lo + b.bin * w, 4) AS low, round(lo + (b.bin + 1) * w, 4) AS high, coalesce(n, 0) AS rows FROM e, range(10) b(bin) LEFT JOIN c ON c.bin = b.bin""",
    "lineitem",
)(lambda li: insights.distribution(li, "l_quantity"))
r.add("distribution_shape", "WITH s AS (SELECT count(*) AS n, avg(o_totalprice) AS a, median(o_totalprice) AS m FROM orders) SELECT n, round(a, 4) AS mean, round(m, 4) AS median, CASE WHEN a > 1.15 * m THEN 'right_skewed' WHEN a < 0.85 * m THEN 'left_skewed' ELSE 'balanced' END AS shape, (SELECT count(*) FROM orders, s WHERE o_totalprice > 2 * a) AS above_twice_mean FROM s", "orders")(
    lambda o: insights.distribution_shape(o, "o_totalprice")
)
r.add("quality_flags", f"WITH {_HOLES} SELECT 'price' AS \"column\", count(*) FILTER (price IS NULL) AS missing, round(count(*) FILTER (price IS NULL) / count(*), 4) AS rate FROM h UNION ALL SELECT 'note', count(*) FILTER (note = ''), round(count(*) FILTER (note = '') / count(*), 4) FROM h", "orders")(
    lambda o: insights.quality_flags(_holes(o), ["price", "note", "o_orderstatus"], ["price"])
)
r.add("cross_table", "WITH j AS (SELECT c_mktsegment AS label, sum(o_totalprice) AS t, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT 'c_mktsegment' AS attribute, label, round(t, 2) AS total, n AS rows, round(t / sum(t) OVER () * 100, 2) AS share_pct FROM j", "orders", "customer")(
    lambda o, c: insights.cross_table_breakdown(o, "o_custkey", c, "c_custkey", "o_totalprice", ["c_mktsegment"])
)
r.add("kpis", "SELECT count(*) AS rows, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS average, count(DISTINCT o_orderpriority) AS distinct_dim, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders", "orders")(
    lambda o: insights.kpis(o, "o_totalprice", "o_orderpriority", "o_orderdate")
)
r.add("column_catalog", None, "customer", "orders")(lambda c, o: catalog.column_catalog(c.sparkSession, {"customer": c, "orders": o}))
r.add("masked_customers", "SELECT c_custkey, '[REDACTED]' AS customer_name FROM customer", "customer")(lambda c: catalog.mask_columns(c.selectExpr("c_custkey", "c_name customer_name"), "masked"))

r.add("clean_preview", f"WITH {TEXT_ORDERS}, c AS (SELECT DISTINCT status, paid, grade FROM text_orders) SELECT (SELECT count(*) FROM text_orders) AS rows, count(*) FILTER (status <> 'n/a') AS trimmed_cells, count(*) FILTER (status = 'n/a') AS standardised_nulls, 0::BIGINT AS empty_rows, count(*) - (SELECT count(*) FROM c) AS duplicate_rows FROM text_orders", "orders")(
    lambda o: cleaning.clean_preview(text_orders(o).select("status", "paid", "grade"))
)
r.add("clean_apply", f"WITH {TEXT_ORDERS} SELECT DISTINCT CASE WHEN status = 'n/a' THEN NULL ELSE trim(status) END AS status, CASE paid WHEN 'Yes' THEN 'true' ELSE 'false' END AS paid, TRY_CAST(grade AS DOUBLE) AS grade FROM text_orders", "orders")(
    lambda o: cleaning.apply_cleaning(text_orders(o).select("status", "paid", "grade"), cleaning.CleaningActions(numbers=["grade"], booleans=["paid"]))
)
_DIRTY = ["status", "paid", "grade", "amount"]
_WRITE = cleaning.CleaningActions(numbers=["grade", "amount"], booleans=["paid"])


def _counters(o: DataFrame) -> DataFrame:
    """What the write of a cleaned copy counted, and the rows that it wrote."""
    spark, path = o.sparkSession, session.work_path(o.sparkSession, "cleaned")
    told = cleaning.write_cleaned(text_orders(o).select(*_DIRTY), _WRITE, path)
    cells = [F.lit(v).cast("bigint").alias(k) for k, v in sorted(told.items())]
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_read")).select("rows_read", *cells)


r.add(
    "clean_counters",
    f"""WITH {TEXT_ORDERS}, d AS (SELECT DISTINCT CASE WHEN status <> 'n/a' THEN trim(status) END, paid, CASE WHEN grade <> 'oops' THEN grade END, amount FROM text_orders)
    SELECT (SELECT count(*) FROM d) AS rows_read, (SELECT count(*) FROM d) AS output_rows, count(*) AS input_rows, count(*) FILTER (status <> 'n/a') AS trimmed_cells, count(*) FILTER (status = 'n/a') AS standardised_nulls,
    count(*) AS converted_numbers, count(*) FILTER (grade = 'oops') AS blanked_unparsed, count(*) AS converted_booleans, 0::BIGINT AS empty_rows FROM text_orders""",
    "orders",
)(_counters)
r.add(
    "cleaning_plan",
    f"""WITH {TEXT_ORDERS}, d AS (SELECT DISTINCT status, paid, grade, amount FROM text_orders), n AS (SELECT count(*) AS n, count(*) FILTER (status <> 'n/a') AS trims, count(*) FILTER (status = 'n/a') AS nulls, count(*) FILTER (CAST(id AS BIGINT) % 40 = 0) AS bad FROM text_orders)
    SELECT * FROM (SELECT 'normalize_headers' AS action, 2::BIGINT AS affected, '' AS columns UNION ALL SELECT 'trim_whitespace', trims, '' FROM n UNION ALL SELECT 'standardize_nulls', nulls, '' FROM n UNION ALL SELECT 'parse_numbers', n, 'amount' FROM n UNION ALL SELECT 'normalize_booleans', n, 'paid' FROM n
    UNION ALL SELECT 'remove_duplicates', n - (SELECT count(*) FROM d), '' FROM n UNION ALL SELECT 'repair_row_width', bad, '' FROM n) WHERE affected > 0""",
    "orders",
)(
    lambda o: cleaning.cleaning_plan(text_orders(o).select(*_DIRTY, F.when(F.col("id").cast("bigint") % 40 == 0, F.col("id")).alias("_corrupt")), ["status", " paid", "grade", "amount!"]).withColumn("columns", F.array_join("columns", ","))
)
r.add("missing_by_column", f"WITH {TEXT_ORDERS} SELECT 'status' AS \"column\", count(*) FILTER (status = 'n/a') AS missing FROM text_orders UNION ALL SELECT unnest(['paid', 'grade', 'amount']), 0", "orders")(lambda o: cleaning.missing_by_column(text_orders(o).select(*_DIRTY)))
r.add("formatted_examples", f"WITH {TEXT_ORDERS} SELECT 'amount' AS \"column\", array_to_string((SELECT list(amount ORDER BY amount)[1:3] FROM (SELECT DISTINCT amount FROM text_orders)), ';') AS examples", "orders")(
    lambda o: cleaning.formatted_examples(text_orders(o).select(*_DIRTY), ["amount", "grade"]).withColumn("examples", F.array_join("examples", ";"))
)


def _repaired(o: DataFrame) -> DataFrame:
    """Rows of another width, kept: short ones padded, long ones cut."""
    spark, path = o.sparkSession, session.work_path(o.sparkSession, "odd-rows")
    k = F.col("o_orderkey")
    line = F.concat_ws(",", k, F.when(k % 5 != 0, F.col("o_orderstatus")), F.when(k % 5 == 1, F.lit("extra")))
    head = spark.range(4).select(F.col("id").alias("bucket"), F.lit(-1).cast("bigint").alias("at"), F.lit("id,status").alias("value"))
    rows = o.select((k % 4).alias("bucket"), k.alias("at"), line.alias("value")).unionByName(head)
    rows.repartition("bucket").sortWithinPartitions("bucket", "at").select("bucket", "value").write.partitionBy("bucket").text(path)
    return files.repair_row_width(files.read_delimited(spark, [f"{path}/bucket={b}" for b in range(4)], ["id", "status"]))


r.add("repaired_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status FROM orders", "orders")(_repaired)


def _guarded(o: DataFrame) -> DataFrame:
    """Cleaning that is refused because the source changed, and cleaning of the same source."""
    t = text_orders(o).select("status", "paid")
    seen = tuple(cleaning.fingerprint(t).first())
    try:
        cleaning.apply_if_unchanged(t.filter("paid = 'Yes'"), cleaning.CleaningActions(), seen)
        refused = False
    except ValueError:
        refused = True
    return cleaning.apply_if_unchanged(t, cleaning.CleaningActions(), seen).withColumn("changed_refused", F.lit(refused))


r.add("guarded_cleaning", f"WITH {TEXT_ORDERS} SELECT DISTINCT CASE WHEN status <> 'n/a' THEN trim(status) END AS status, paid, true AS changed_refused FROM text_orders", "orders")(_guarded)


r.add("numeric_text_columns", f"WITH {TEXT_ORDERS} SELECT 'amount' AS \"column\", count(*) AS filled, count(*) AS numeric, count(*) AS formatted FROM text_orders", "orders")(lambda o: cleaning.numeric_text_columns(text_orders(o)))
r.add("boolean_text_columns", f"WITH {TEXT_ORDERS} SELECT 'paid' AS \"column\", count(*) AS filled FROM text_orders", "orders")(lambda o: cleaning.boolean_text_columns(text_orders(o)))
r.add("parse_currency", f"WITH {TEXT_ORDERS} SELECT id, CAST(replace(amount, '$', '') AS DOUBLE) AS amount FROM text_orders", "orders")(lambda o: text_orders(o).select("id", expr.parse_currency(F.col("amount")).alias("amount")))
r.add("parse_us_date", f"WITH {TEXT_ORDERS} SELECT id, CAST(day AS DATE) AS day FROM text_orders", "orders")(lambda o: text_orders(o).select("id", expr.typed(F.col("us_day"), "date", "date_us").alias("day")))
r.add("parse_unambiguous", f"WITH {TEXT_ORDERS} SELECT id, CASE WHEN month(CAST(day AS DATE)) <> day(CAST(day AS DATE)) AND day(CAST(day AS DATE)) <= 12 THEN NULL ELSE CAST(day AS TIMESTAMP) END AS day FROM text_orders", "orders")(
    lambda o: text_orders(o).select("id", expr.parse_date_unambiguous(F.col("us_day")).alias("day"))
)
_FITS = {  # how many values of a column are of each type, in the order in which types are tried
    "bool": "count(*) FILTER (lower(trim(v)) IN ('true', 't', 'yes', 'y', 'false', 'f', 'no', 'n'))",
    "int": "count(*) FILTER (regexp_full_match(trim(v), '[+-]?[0-9]+'))",
    "float": "count(*) FILTER (regexp_full_match(trim(v), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)'))",
    "currency": "count(*) FILTER (regexp_full_match(trim(v), '\\$?[0-9,]+(\\.[0-9]+)?'))",
    "date": "count(*) FILTER (regexp_full_match(trim(v), '[0-9]{4}-[0-9]{2}-[0-9]{2}'))",
    "date_us": "count(*) FILTER (regexp_full_match(trim(v), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}'))",
}
r.add(
    "contract_types",
    f"""WITH {TEXT_ORDERS}, l AS (UNPIVOT text_orders ON id, amount, day, status, paid, grade, us_day INTO NAME "column" VALUE v),
    m AS (SELECT "column", CASE WHEN trim(v) = 'n/a' THEN NULL ELSE v END AS v FROM l), c AS (SELECT "column", count(*) AS n, count(v) AS p, count(DISTINCT v) AS d, {", ".join(f"{q} AS {k}_n" for k, q in _FITS.items())} FROM m GROUP BY 1),
    t AS (SELECT *, CASE WHEN bool_n = p THEN 'bool' WHEN int_n = p THEN 'int' WHEN float_n = p THEN 'float' WHEN date_n = p THEN 'date' WHEN date_us_n = p THEN 'date_us' WHEN currency_n = p THEN 'currency'
      WHEN float_n >= 0.95 * p THEN 'float' WHEN currency_n >= 0.95 * p THEN 'currency' ELSE 'str' END AS k FROM c)
    SELECT "column", CASE k WHEN 'date_us' THEN 'date' WHEN 'currency' THEN 'float' ELSE k END AS kind, CASE WHEN k IN ('date_us', 'currency') THEN k END AS transform, p < n AS nullable, p = n AND d = n AND k IN ('int', 'str') AS candidate_key FROM t""",
    "orders",
)(
    lambda o: C.chosen_types(C.type_probe(text_orders(o)))
)
_TYPE_OF = "CASE WHEN count(TRY_CAST({0} AS BIGINT)) = count({0}) THEN 'int' WHEN count(TRY_CAST({0} AS DOUBLE)) = count({0}) THEN 'float' ELSE 'str' END"
r.add("simple_types", f"WITH {TEXT_ORDERS}, n AS (SELECT id, amount, nullif(status, 'n/a') AS status FROM text_orders) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_TYPE_OF.format(c)} AS kind FROM n" for c in ("id", "amount", "status")), "orders")(lambda o: C.infer_simple_types(text_orders(o).select("id", "amount", "status")))
_SHAPE = [C.ContractColumn("id", "int"), C.ContractColumn("amount", "float", "currency"), C.ContractColumn("status", "str"), C.ContractColumn("grade", "int")]
r.add("typed_rows", f"WITH {TEXT_ORDERS} SELECT CAST(id AS BIGINT) AS id, CAST(replace(amount, '$', '') AS DOUBLE) AS amount, CASE WHEN status = 'n/a' THEN NULL ELSE trim(status) END AS status, TRY_CAST(grade AS BIGINT) AS grade, 'L1' AS __load_id FROM text_orders", "orders")(
    lambda o: C.typed_rows(text_orders(o), _SHAPE, "L1").drop("__row_hash", "__loaded_at")
)
r.add(
    "quality_gate",
    f"""WITH {TEXT_ORDERS}, s AS (SELECT count(*) AS n, count(*) FILTER (grade = 'oops') AS f FROM text_orders) SELECT c AS "check", v AS severity, p AS passed, k AS rows FROM s,
    LATERAL (VALUES ('row_count', 'fail', true, n), ('malformed_rows', 'warn', true, 0), ('cast_failures', 'warn', false, f), ('empty_columns', 'warn', true, 0), ('key_not_null', 'fail', true, 0), ('key_unique', 'fail', true, 0), ('duplicate_rows', 'info', true, 0)) t(c, v, p, k)""",
    "orders",
)(lambda o: C.quality_gate(text_orders(o).select("id", "amount", "status", "grade"), _SHAPE, ["id"]))
r.add("load_counts", "SELECT CASE WHEN o_orderkey % 10 >= 7 THEN 'insert' WHEN o_orderkey % 10 IN (5, 6) THEN 'update' ELSE 'unchanged' END AS change, count(*) AS rows FROM orders WHERE o_orderkey % 10 >= 4 GROUP BY 1", "orders")(lambda o: loads.load_counts(R.classify_merge(*_merge_parts(o), ["o_orderkey"])))
r.add("load_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (5, 6) THEN o_orderstatus || 'x' ELSE o_orderstatus END AS s FROM orders", "orders")(lambda o: _merged(o))
r.add("load_append", "SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 < 7 UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (5, 6) THEN o_orderstatus || 'x' ELSE o_orderstatus END FROM orders WHERE o_orderkey % 10 >= 5", "orders")(
    lambda o: loads.load_append(*reversed(_merge_parts(o))).select("o_orderkey", "s")
)


def _merge_parts(o):
    from tabulon.plans.relational import _parts

    return _parts(o)


def _merged(o):
    inc, cur = _merge_parts(o)
    return loads.load_merge(cur, inc, ["o_orderkey"]).select("o_orderkey", "s")


_LOG = lambda e: e.select("event_id", "user_id", F.to_date("ts").alias("dt"), "event_type", F.col("value").alias("ms"))
r.add(
    "daily_mart",
    """SELECT CAST(ts AS DATE) AS dt, event_type, count(*) AS runs, count(*) FILTER (value >= 50) AS succeeded, count(*) FILTER (value < 50) AS failed, round(count(*) FILTER (value < 50) / count(*), 4) AS failure_rate,
    round(avg(value), 2) AS avg_duration, round(quantile_cont(value, 0.95), 4) AS p95_duration, max(value) AS max_duration FROM events GROUP BY 1, 2""",
    "events",
)(lambda e: marts.daily(_LOG(e), ["dt", "event_type"], F.col("ms") >= 50, F.col("ms") < 50, "ms"))
r.add("recent_days", "SELECT CAST(ts AS DATE) AS dt, count(*) AS n FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-13' AND CAST(ts AS DATE) <= DATE '2024-01-20' GROUP BY 1", "events")(
    lambda e: marts.recent_window(_LOG(e).groupBy("dt").agg(F.count(F.lit(1)).alias("n")), F.lit("2024-01-20").cast("date"), 7)
)
r.add("request_cap", "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS admitted FROM events", "events")(lambda e: marts.request_cap(e, 2).select("event_id", "admitted"))
r.add("token_cap", "SELECT event_id, coalesce(sum(CAST(round(value) AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 60 AS admitted FROM events", "events")(
    lambda e: marts.token_cap(e.withColumn("tokens", F.round("value").cast("bigint")), 60, "tokens").select("event_id", "admitted")
)
r.add("rate_limit_audit", RATE_LIMIT_SQL, "events")(lambda e: streams.rate_limit_audit(e, 2, 86_400.0).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
r.add(
    "usage_budget",
    """WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d, ts, CAST(round(value) AS BIGINT) AS t FROM events),
    u AS (SELECT *, row_number() OVER w - 1 < 3 AND coalesce(sum(t) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 150 AS own FROM e WINDOW w AS (PARTITION BY user_id, d ORDER BY ts, event_id)),
    g AS (SELECT *, coalesce(count(*) FILTER (own) OVER b, 0) >= 200 OR coalesce(sum(t) FILTER (own) OVER b, 0) >= 9900 AS shut FROM u WINDOW b AS (PARTITION BY d ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    a AS (SELECT *, own AND NOT shut AS admitted FROM g),
    c AS (SELECT *, coalesce(sum(t) FILTER (admitted) OVER (PARTITION BY d), 0) AS all_t, coalesce(sum(t) FILTER (admitted) OVER (PARTITION BY user_id, d), 0) AS user_t, count(*) FILTER (admitted) OVER (PARTITION BY user_id, d) AS user_n FROM a)
    SELECT event_id, admitted, CASE WHEN admitted THEN NULL WHEN shut AND all_t >= 9900 THEN 'global_tokens' WHEN user_t >= 150 THEN 'user_tokens' WHEN user_n >= 3 THEN 'user_requests' ELSE 'global_requests' END AS reason FROM c""",
    "events",
)(lambda e: marts.usage_budget(e.withColumn("tokens", F.round("value").cast("bigint")), 3, 150, 200, 9900, slice_seconds=600).select("event_id", "admitted", "reason"))
r.add("unique_violations", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1", "lineitem")(lambda li: C.expect_unique(li, ["l_orderkey"]))
r.add("accepted_violations", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')", "orders")(lambda o: C.expect_accepted(o, "o_orderstatus", ["F", "O"]).select("o_orderkey"))
_KNOWN = ", ".join(f"'{w}'" for w in ("[value]", "[number]", *sorted({*expr.INTENT_WORDS} - {*expr.STOP_WORDS})))
r.add(
    "goal_signature",
    rf"""WITH a AS (SELECT *, regexp_replace(lower(regexp_replace('Top ' || turn || ' rows grouped by "' || role || '" for a.b@c.org: ' || coalesce(text, ''), '\s+', ' ', 'g')), '\b[\w.+-]+@[\w.-]+\.[a-z]{{2,}}\b', ' [value] ', 'g') AS t FROM conversations),
    b AS (SELECT * EXCLUDE (t), regexp_replace(regexp_replace(t, 'https?://\S+', ' [value] ', 'g'), '"[^"]*"|''[^'']*''', ' [value] ', 'g') AS t FROM a),
    c AS (SELECT * EXCLUDE (t), regexp_extract_all(regexp_replace(t, '\b[-+]?\d+(?:\.\d+)?\b', ' [number] ', 'g'), '[a-z_][a-z0-9_]{{1,63}}|\[(?:value|number)\]') AS w FROM b),
    d AS (SELECT * EXCLUDE (w), left(array_to_string([x FOR x IN w IF x IN ({_KNOWN})][1:80], ' '), 800) AS s FROM c)
    SELECT * EXCLUDE (s), CASE WHEN s = '' THEN 'unspecified goal' ELSE s END AS signature FROM d""",
    "conversations",
)(lambda c: c.withColumn("signature", expr.redact_literals(F.concat(F.lit("Top "), "turn", F.lit(' rows grouped by "'), "role", F.lit('" for a.b@c.org: '), F.coalesce("text", F.lit(""))))))

QUERIES, SQL = r.queries, r.sql
