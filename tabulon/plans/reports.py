"""Queries of reports over several tables, verified links, column rules and the rules that data must keep."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import catalog, findings, links, report
from tabulon.operators import contract as C
from tabulon.operators import relational as R
from tabulon.plans.base import Registry, table

r = Registry()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# ---------------------------------------------------------------- what columns are, by their names


def _words(names: Iterable[str]) -> str:
    return "|".join(names)


_IS = lambda c, pattern: f"regexp_matches({c}, '{pattern}')"
_COLUMNS = f"""cols AS (SELECT table_name AS "table", column_name AS "column", lower(column_name) AS low, ordinal_position - 1 AS position,
    regexp_matches(data_type, '^(TINYINT|SMALLINT|INTEGER|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$') AS numeric FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)})),
  private AS (SELECT *, CASE {" ".join(f"WHEN {_IS('"column"', p)} THEN '{label}'" for label, p in catalog.PRIVACY)} ELSE 'ordinary' END AS privacy, {_IS('"column"', catalog.IDENTIFIER_NAME)} AS ident FROM cols),
  seen AS (SELECT *, {_IS("low", _words(catalog.TEMPORAL))} AND NOT numeric AS temporal,
    CASE WHEN privacy = 'credential' THEN 'credential' WHEN ident OR privacy IN ('direct_identifier', 'identifier') THEN 'identifier' WHEN privacy = 'unstructured_text' THEN 'free_text' WHEN {_IS('"column"', catalog.TIME_NAME)} THEN 'datetime'
      WHEN {_IS('"column"', catalog.TIME_PART_NAME)} THEN 'temporal_component' WHEN numeric THEN 'numeric_measure' ELSE 'categorical' END AS role,
    CASE WHEN numeric AND NOT ident AND NOT {_IS("low", _words(catalog.NOT_MEASURE))} THEN CASE WHEN {_IS("low", _words(catalog.STRONG_MEASURE))} THEN 4 WHEN {_IS("low", _words(catalog.MEASURE))} THEN 3 WHEN {_IS("low", _words(catalog.WEAK_MEASURE))} THEN 1 ELSE 2 END END AS measure_score
    FROM private),
  scored AS (SELECT *, CASE WHEN NOT numeric AND NOT ident AND NOT temporal AND NOT {_IS("low", _words(catalog.NOT_DIMENSION))} THEN CASE WHEN {_IS("low", _words(catalog.DIMENSION))} THEN 3 ELSE 2 END END AS dimension_score,
    NOT numeric AND NOT ident AND NOT temporal AND {_IS("low", _words(catalog.ENTITY))} AND NOT {_IS("low", _words(catalog.NOT_ENTITY))} AS entity,
    measure_score IS NOT NULL AND (measure_score = 1 OR {_IS("low", _words(catalog.PER_UNIT))}) AS average_only FROM seen)"""


def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.column_table(spark, {t: table(spark, sf_dir, t) for t in TABLES}).drop("type").withColumn("position", F.col("position").cast("bigint"))


def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's rows and nulls; distinct values are estimates and are judged by their error."""
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "orders", "part")}
    about = catalog.column_catalog(spark, tables)
    exact = None
    for t, df in tables.items():
        one = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_distinct(F.col(c)).alias("distinct")) for c in df.columns]).alias("c")).select(F.lit(t).alias("table"), F.inline("c"))
        exact = one if exact is None else exact.unionByName(one)
    close = F.abs(F.col("distinct_about") - F.col("distinct")) <= 0.1 * F.col("distinct") + 1
    return about.join(exact, ["table", "column"]).select("table", "column", "rows", "nulls", "distinct", close.alias("estimate_is_close"))


for f in (column_roles, column_counts):
    r.queries[f.__name__] = f
r.sql["column_roles"] = f'WITH {_COLUMNS} SELECT "table", "column", numeric, position, privacy, role, measure_score, dimension_score, temporal, entity, average_only FROM scored'
r.sql["column_counts"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", name AS "column", n AS rows, n - filled AS nulls, d AS distinct, true AS estimate_is_close FROM (SELECT count(*) AS n, {", ".join(f"[count({c}), count(DISTINCT {c})] AS {c}" for c in cols)} FROM {t}) UNPIVOT (v FOR name IN ({", ".join(cols)})), LATERAL (SELECT v[1] AS filled, v[2] AS d)"""
    for t, cols in {
        "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
        "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
        "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    }.items()
)


# ---------------------------------------------------------------- a shop of three tables


def _shop(o: DataFrame, c: DataFrame, p: DataFrame) -> dict[str, DataFrame]:
    """Orders with a total, customers and products, named as users name them; some cells are empty or unread."""
    k = F.col("o_orderkey")
    orders = o.select(
        k.alias("order_id"), F.when(k % 11 > 0, F.col("o_custkey")).alias("customer_id"), F.when(k % 9 > 0, F.col("o_totalprice")).alias("total_amount"), F.col("o_orderstatus").alias("status"),
        F.when(k % 10 > 0, F.col("o_orderpriority")).alias("priority"), F.when(k % 50 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon").alias("order_date"),
    )
    customers = c.filter(F.col("c_custkey") % 20 > 0).select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("c"), (F.col("c_nationkey") % 10).cast("string")).alias("country"), F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("email"))
    products = p.select((-F.col("p_partkey")).alias("customer_id"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("unit_price"))
    return {"orders": orders, "customers": customers, "products": products}


_SHOP = """orders_ AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS customer_id, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END AS total_amount, o_orderstatus AS status,
    CASE WHEN o_orderkey % 10 > 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 50 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END AS order_date FROM orders),
  customers_ AS (SELECT c_custkey AS customer_id, c_mktsegment AS segment, 'c' || (c_nationkey % 10) AS country, 'x' || c_custkey AS email FROM customer WHERE c_custkey % 20 > 0),
  products_ AS (SELECT -p_partkey AS customer_id, p_brand AS brand, p_retailprice AS unit_price FROM part)"""
_DECLARED = [("orders", "customer_id", "products", "customer_id"), ("orders", "order_id", "returns", "order_id"), ("orders", "lost", "customers", "customer_id")]


def _verified(o: DataFrame, c: DataFrame, p: DataFrame) -> DataFrame:
    """A found link, a declared one whose keys never meet, one to a table that was not read, and none of an unknown column."""
    shop = _shop(o, c, p)
    shop["archived_customers"] = shop["customers"].select((F.col("customer_id") + 10**9).alias("customer_id"))  # fits by name only
    return links.verify_links(shop | {"returns": None}, _DECLARED, {"returns": ["order_id"]})


_COVER = """SELECT '{a}' AS from_table, '{c}' AS from_column, '{b}' AS to_table, '{c}' AS to_column, {known} AS declared, 'data_verified' AS status, count(*) FILTER (x.n > 0 AND y.n > 0) AS overlap, count(x.n) AS distinct_a, count(y.n) AS distinct_b,
    CAST(sum(x.n) AS BIGINT) AS rows_a, CAST(sum(y.n) AS BIGINT) AS rows_b, CAST(coalesce(sum(x.n) FILTER (y.n > 0), 0) AS BIGINT) AS matched_a, CAST(coalesce(sum(y.n) FILTER (x.n > 0), 0) AS BIGINT) AS matched_b,
    round(coalesce(sum(x.n) FILTER (y.n > 0), 0) / sum(x.n), 6) AS rate_a, round(coalesce(sum(y.n) FILTER (x.n > 0), 0) / sum(y.n), 6) AS rate_b
  FROM (SELECT {c} AS k, count(*) AS n FROM {a}_ WHERE {c} IS NOT NULL GROUP BY 1) x FULL JOIN (SELECT {c} AS k, count(*) AS n FROM {b}_ GROUP BY 1) y ON x.k = y.k"""
r.add(
    "verified_links",
    f"""WITH {_SHOP}, archived_customers_ AS (SELECT customer_id + 1000000000 AS customer_id FROM customers_),
    found AS ({_COVER.format(a="orders", b="customers", c="customer_id", known="false")} UNION ALL {_COVER.format(a="orders", b="archived_customers", c="customer_id", known="false")})
    SELECT * FROM found WHERE rate_a >= 0.5 UNION ALL {_COVER.format(a="orders", b="products", c="customer_id", known="true")}
    UNION ALL SELECT 'orders', 'order_id', 'returns', 'order_id', true, 'schema_validated_not_data_verified', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
    "orders",
    "customer",
    "part",
)(_verified)


# ---------------------------------------------------------------- the profiling report


def _facts(rep: report.Report) -> DataFrame:
    """A report as ``table, section, item, metric, value``: what its sections hold, under one another."""
    out = rep.overview.select(F.lit("").alias("table"), F.lit("overview").alias("section"), F.lit("").alias("item"), F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in rep.overview.columns])))

    def add(df: DataFrame, t: str, section: str, item: str | None, metrics: tuple[str, ...]) -> None:
        nonlocal out
        shown = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in metrics]
        out = out.unionByName(df.select(F.lit(t).alias("table"), F.lit(section).alias("section"), (F.col(item) if item else F.lit("")).alias("item"), F.inline(F.array(*shown))))

    for t, s in rep.sections.items():
        add(s["missingness"], t, "missingness", "column", ("missing",))
        add(s["duplicates"], t, "duplicates", None, ("duplicate_rows",))
        if "numeric" in s:
            add(s["numeric"], t, "numeric", "column", ("count", "invalid", "zeros"))
            add(s["outliers"], t, "outliers", "column", ("outliers", "shape"))
        if "categorical" in s:
            add(s["categorical"], t, "categorical", "column", ("non_null", "distinct", "high_cardinality", "redacted"))
        for name in [n for n in s if n.startswith("time:")]:
            add(s[name], t, "time", None, ("periods", "busiest", "busiest_rows", "quietest", "invalid", "span_days"))
            series = s[name.replace("time:", "series:")]
            add(series.groupBy(F.lit("last 120").alias("of")).agg(F.count(F.lit(1)).alias("listed"), F.sum("n").alias("rows")), t, "series", "of", ("listed", "rows"))
    for df, section, item, metric in ((rep.tables, "table", None, "status"), (rep.sensitive, "sensitive", "column", "classification")):
        out = out.unionByName(df.select("table", F.lit(section).alias("section"), (F.col(item) if item else F.lit("")).alias("item"), F.lit(metric).alias("metric"), F.col(metric).alias("value")))
    told = rep.findings.filter("kind <> 'correlation'").select("table", F.lit("findings").alias("section"), F.col("kind").alias("item"), F.lit("finding").alias("metric"), F.col("finding").alias("value"))
    related = rep.relationships.select(F.col("from_table").alias("table"), F.lit("links").alias("section"), F.col("to_table").alias("item"), F.lit("status").alias("metric"), F.col("status").alias("value"))
    return out.unionByName(told).unionByName(related)


_MISSING = lambda t, cols: " UNION ALL ".join(f"SELECT '{t}' AS t, 'missingness' AS s, '{c}' AS i, 'missing' AS m, CAST(count(*) FILTER ({c} IS NULL) AS VARCHAR) AS v FROM {t}_" for c in cols)
_CATEGORY = lambda t, c: f"""SELECT '{t}' AS t, 'categorical' AS s, '{c}' AS i, unnest(['non_null', 'distinct', 'high_cardinality', 'redacted']) AS m, unnest([CAST(count({c}) AS VARCHAR), CAST(count(DISTINCT {c}) AS VARCHAR), CAST(count({c}) >= 50 AND count(DISTINCT {c}) / count({c}) > 0.5 AS VARCHAR), 'false']) AS v FROM {t}_"""
_NUMBER = lambda t, c: f"""SELECT '{t}', 'numeric', '{c}', unnest(['count', 'invalid', 'zeros']), unnest([CAST(count({c}) AS VARCHAR), '0', CAST(count(*) FILTER ({c} = 0) AS VARCHAR)]) FROM {t}_
    UNION ALL SELECT '{t}', 'outliers', '{c}', unnest(['outliers', 'shape']), unnest([CASE WHEN n >= 30 THEN CAST(found AS VARCHAR) END, CASE WHEN n < 30 THEN 'insufficient_sample' WHEN skew >= 1 OR round(found / n, 6) >= 0.1 THEN 'strongly_skewed_or_heavy_tailed' WHEN found > 0 THEN 'some_tail_values' ELSE 'no_iqr_tail_flags' END])
      FROM (SELECT count({c}) AS n, count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS found, abs(any_value(k)) AS skew FROM {t}_, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t}_),
        (SELECT round(avg(power({c} - mu, 3)) / power(any_value(sd), 3), 4) AS k FROM {t}_, (SELECT avg({c}) AS mu, stddev_pop({c}) AS sd FROM {t}_)))"""  # noqa: E731
_REPEATED = lambda t: f"SELECT '{t}' AS t, 'duplicates' AS s, '' AS i, 'duplicate_rows' AS m, CAST((SELECT count(*) FROM {t}_) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t}_)) AS VARCHAR) AS v"
r.add(
    "eda_report",
    f"""WITH {_SHOP}, days AS (SELECT TRY_CAST(order_date AS DATE) AS d FROM orders_), span AS (SELECT min(d) AS a, max(d) AS b, count(*) FILTER (d IS NULL) AS bad FROM days),
    p AS (SELECT CASE WHEN b - a > 92 THEN strftime(d, '%Y-%m') ELSE strftime(d, '%Y-%m-%d') END AS period, count(*) AS n, any_value(bad) AS bad, any_value(b - a) AS span FROM days, span WHERE d IS NOT NULL GROUP BY 1),
    miss AS ({_MISSING("orders", ("order_id", "customer_id", "total_amount", "status", "priority", "order_date"))} UNION ALL {_MISSING("customers", ("customer_id", "segment", "country", "email"))} UNION ALL {_MISSING("products", ("customer_id", "brand", "unit_price"))}),
    rep AS ({" UNION ALL ".join(map(_REPEATED, ("orders", "customers", "products")))}), num AS ({_NUMBER("orders", "total_amount")} UNION ALL {_NUMBER("products", "unit_price")}), nums AS (SELECT * FROM num AS x(t, s, i, m, v)),
    f AS (SELECT * FROM miss UNION ALL SELECT * FROM rep UNION ALL SELECT * FROM nums UNION ALL {" UNION ALL ".join(_CATEGORY(t, c) for t, c in (("orders", "status"), ("orders", "priority"), ("customers", "segment"), ("customers", "country"), ("products", "brand")))}
      UNION ALL SELECT 'orders', 'time', '', unnest(['periods', 'busiest', 'busiest_rows', 'quietest', 'invalid', 'span_days']), unnest([CAST(count(*) AS VARCHAR), arg_min(period, (-n, period)), CAST(max(n) AS VARCHAR), arg_min(period, (n, period)), CAST(any_value(bad) AS VARCHAR), CAST(any_value(span) AS VARCHAR)]) FROM p
      UNION ALL SELECT 'orders', 'series', 'last 120', unnest(['listed', 'rows']), unnest([CAST(count(*) AS VARCHAR), CAST(sum(n) AS VARCHAR)]) FROM (SELECT * FROM p ORDER BY period DESC LIMIT 120)
      UNION ALL SELECT t, 'table', '', 'status', CASE WHEN t = 'returns' THEN 'error' ELSE 'ok' END FROM (SELECT unnest(['orders', 'customers', 'products', 'returns']) AS t)
      UNION ALL SELECT 'orders', 'sensitive', unnest(['order_id', 'customer_id']), 'classification', 'identifier' UNION ALL SELECT 'customers', 'sensitive', unnest(['customer_id', 'email']), 'classification', unnest(['identifier', 'direct_identifier']) UNION ALL SELECT 'products', 'sensitive', 'customer_id', 'classification', 'identifier'
      UNION ALL SELECT 'orders', 'links', unnest(['products', 'returns']), 'status', unnest(['data_verified', 'schema_validated_not_data_verified'])
      UNION ALL SELECT '', 'overview', '', unnest(['status', 'table_count', 'profiled_table_count', 'scanned_rows', 'column_count', 'relationship_count']), unnest(['partial', '4', '3', CAST((SELECT count(*) FROM orders_) + (SELECT count(*) FROM customers_) + (SELECT count(*) FROM products_) AS VARCHAR), '14', '2']))
    SELECT t AS "table", s AS section, i AS item, m AS metric, v AS value FROM f
    UNION ALL SELECT t, 'findings', 'missing', 'finding', i || ' is missing in ' || v || ' rows' FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY CAST(v AS BIGINT) DESC, i) AS rn FROM miss WHERE v <> '0') WHERE rn <= 3
    UNION ALL SELECT t, 'findings', 'duplicates', 'finding', v || ' rows repeat another' FROM rep WHERE v <> '0' UNION ALL SELECT t, 'findings', 'tails', 'finding', i || ' has ' || v || ' values in its tails' FROM nums WHERE m = 'outliers' AND v <> '0'""",
    "orders",
    "customer",
    "part",
)(lambda o, c, p: _facts(report.eda_report(o.sparkSession, _shop(o, c, p) | {"returns": None}, _DECLARED, {t: report.TablePlan() if t != "returns" else report.TablePlan(["order_id"]) for t in ("orders", "customers", "products", "returns")}, {"returns": ["order_id"]})))


# ---------------------------------------------------------------- findings over tables

_PCT = lambda a, b: f"printf('%.1f%%', coalesce(round(100.0 * ({a}) / nullif({b}, 0), 1), 0))"
_SHOWN = lambda v: f"CASE WHEN abs({v}) >= 1e6 THEN format('{{:,.2f}}M', {v} / 1e6) WHEN abs({v}) >= 1e4 THEN format('{{:,.0f}}', {v}) WHEN abs({v}) >= 100 THEN format('{{:,.1f}}', {v}) WHEN {v} = floor({v}) THEN format('{{:,.0f}}', {v}) ELSE format('{{:,.2f}}', {v}) END"


def _group_sql(name: str, t: str, column: str, value: str, metric: str, averaged: bool = False, tail: str = "''", source: str | None = None) -> str:
    """A breakdown's row: id, table, kind, takeaway, distinct."""
    highest = f"max(k) FILTER (rn = 1) || ' has the highest {metric} at ' || max({_SHOWN('v')}) FILTER (rn = 1) || ' (from ' || format('{{:,}}', max(c) FILTER (rn = 1)) || ' rows); ' || arg_max(k, rn) FILTER (rn <= 8) || ' the lowest shown at ' || arg_max({_SHOWN('v')}, rn) FILTER (rn <= 8) || '.'"
    a, b, first, second = "max(v) FILTER (rn = 1)", "max(v) FILTER (rn = 2)", "max(k) FILTER (rn = 1)", "max(k) FILTER (rn = 2)"
    said = highest if averaged else f"""CASE WHEN round(100.0 * {a} / sum(v), 1) >= 50 THEN {first} || ' accounts for ' || {_PCT(a, "sum(v)")} || ' of {metric} — more than everything else combined.' WHEN {b} > 0 AND {a} / {b} < 1.1
      THEN {first} || ' and ' || {second} || ' are neck and neck at ' || {_PCT(a, "sum(v)")} || ' and ' || {_PCT(b, "sum(v)")} || ' of {metric}.' ELSE {first} || ' leads with ' || {_PCT(a, "sum(v)")} || ' of {metric}; ' || {second} || ' is next at ' || {_PCT(b, "sum(v)")} || '.' END"""
    return f"""SELECT '{name}' AS id, '{t}' AS t, 'bar' AS kind, {said} || {tail} AS takeaway, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY v DESC, k) AS rn FROM (SELECT {column} AS k, {value} AS v, count(*) AS c FROM {source or t + "_"} WHERE {column} IS NOT NULL GROUP BY 1))"""


_VIA = "(SELECT o.total_amount, c.* FROM orders_ o JOIN customers_ c ON o.customer_id = c.customer_id WHERE total_amount IS NOT NULL)"
_LOST = "(SELECT ' ' || format('{:,}', count(*)) || ' orders rows had no matching customers row.' FROM orders_ WHERE customer_id IS NULL OR customer_id NOT IN (SELECT customer_id FROM customers_))"
_MONTHS = f"""SELECT 'orders.order_date.trend' AS id, 'orders' AS t, 'line' AS kind, 'Best month ' || arg_max(k, (v, -i)) || ' (' || max({_SHOWN("v")}) FILTER (v = best) || '); latest month ' || max(k) || ' is ' || CASE WHEN any_value(ch) > 0 THEN 'up' ELSE 'down' END || printf(' %.1f%%', abs(any_value(ch))) || ' vs ' || max(k) FILTER (i = n - 1)
    || ' (the latest month may be incomplete); overall ' || CASE WHEN any_value(dr) > 10 THEN 'growing' WHEN any_value(dr) < -10 THEN 'declining' ELSE 'roughly flat' END || ' (' || CASE WHEN any_value(dr) > 0 THEN '+' ELSE '' END || printf('%.1f%%', any_value(dr)) || ' second half vs first). ' || format('{{:,}}', any_value(odd)) || ' rows had unreadable dates and were left out.' AS takeaway, 0 AS n
  FROM (SELECT *, round(100.0 * (max(v) FILTER (i = n) OVER () - max(v) FILTER (i = n - 1) OVER ()) / max(v) FILTER (i = n - 1) OVER (), 1) AS ch, round(100.0 * (avg(v) FILTER (i > n // 2) OVER () - avg(v) FILTER (i <= n // 2) OVER ()) / avg(v) FILTER (i <= n // 2) OVER (), 1) AS dr, max(v) OVER () AS best
    FROM (SELECT strftime(TRY_CAST(order_date AS DATE), '%Y-%m') AS k, round(sum(coalesce(total_amount, 0)), 2) AS v, row_number() OVER (ORDER BY k) AS i, count(*) OVER () AS n FROM orders_ WHERE TRY_CAST(order_date AS DATE) IS NOT NULL GROUP BY 1), (SELECT count(*) AS odd FROM orders_ WHERE order_date = 'soon'))"""
_SPREAD = f"""SELECT 'orders.total_amount.distribution' AS id, 'orders' AS t, 'histogram' AS kind, 'Typical total amount is ' || {_SHOWN("md")} || ' (median) vs a mean of ' || {_SHOWN("mn")} || '; ' || CASE WHEN mn > md * 1.15 THEN 'right-skewed: a few large values pull the mean above the median' WHEN md > mn * 1.15 THEN 'left-skewed' ELSE 'fairly symmetric' END || '. ' || format('{{:,}}', over) || ' rows (' || {_PCT("over", "n")} || ') exceed twice the mean.' AS takeaway, 0 AS n
  FROM (SELECT round(any_value(a), 4) AS mn, round(any_value(m), 4) AS md, count(*) AS n, count(*) FILTER (total_amount > 2 * a) AS over FROM orders_, (SELECT avg(total_amount) AS a, median(total_amount) AS m FROM orders_) WHERE total_amount IS NOT NULL)"""
_HOLES = """SELECT 'orders.quality' AS id, 'orders' AS t, 'bar' AS kind, replace(arg_max(c, (p, -j)), '_', ' ') || ' is missing in ' || printf('%.1f%%', max(q)) || ' of rows' || CASE WHEN count(*) > 2 THEN '; ' || (count(*) - 1) || ' more columns miss at least 5%.' WHEN count(*) = 2 THEN '; 1 more column miss at least 5%.' ELSE '.' END || ' Missing values are excluded from totals above.' AS takeaway, 0 AS n
  FROM (SELECT unnest(['customer_id', 'total_amount', 'priority']) AS c, unnest([1, 2, 4]) AS j, unnest([count(*) FILTER (customer_id IS NULL), count(*) FILTER (total_amount IS NULL), count(*) FILTER (priority IS NULL)]) AS p, round(100.0 * p / any_value(whole), 1) AS q FROM orders_, (SELECT count(*) AS whole FROM orders_)) WHERE p > 0 AND q >= 5"""
r.add(
    "auto_insights",
    f"""WITH {_SHOP}, f AS ({_group_sql("orders.status.breakdown", "orders", "status", "sum(coalesce(total_amount, 0))", "total total amount")} UNION ALL {_group_sql("orders.priority.breakdown", "orders", "priority", "sum(coalesce(total_amount, 0))", "total total amount")}
      UNION ALL {_MONTHS} UNION ALL {_SPREAD} UNION ALL {_HOLES}
      UNION ALL {_group_sql("customers.segment.breakdown", "customers", "segment", "count(*)", "rows")} UNION ALL {_group_sql("customers.country.breakdown", "customers", "country", "count(*)", "rows")}
      UNION ALL {_group_sql("products.brand.breakdown", "products", "brand", "sum(unit_price) / count(*)", "average unit price", True)}
      UNION ALL {_group_sql("orders.customer_id->customers.segment", "orders", "segment", "sum(total_amount)", "total total amount", tail=_LOST, source=_VIA)} UNION ALL {_group_sql("orders.customer_id->customers.country", "orders", "country", "sum(total_amount)", "total total amount", tail=_LOST, source=_VIA)}),
    s AS (SELECT 'orders' AS t, count(*) AS rows FROM orders_ UNION ALL SELECT 'customers', count(*) FROM customers_ UNION ALL SELECT 'products', count(*) FROM products_)
    SELECT row_number() OVER (ORDER BY rows DESC, CASE kind WHEN 'line' THEN 0 WHEN 'bar' THEN 1 ELSE 3 END, contains(id, '->') DESC, n DESC, id DESC) AS priority, id, kind, takeaway, n AS distinct FROM f JOIN s USING (t)""",
    "orders",
    "customer",
    "part",
)(lambda o, c, p: findings.auto_insights(o.sparkSession, _shop(o, c, p)).findings.select(F.col("priority").cast("bigint").alias("priority"), "id", "kind", "takeaway", "distinct"))


# ---------------------------------------------------------------- rows, columns and rules


def _refused(call, *args: object) -> bool:
    try:
        call(*args)
    except ValueError:
        return True
    return False


r.add("filter_where", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'", "orders")(lambda o: R.filter_where(o, (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") != "F")).select("o_orderkey", "o_orderpriority"))
r.add("select_columns", "SELECT r_name, r_regionkey, true AS unknown_refused FROM region", "region")(lambda g: R.select_columns(g, ["r_name", "r_regionkey"]).withColumn("unknown_refused", F.lit(_refused(R.select_columns, g, ["r_nme"]))))
r.add("guard_size", "SELECT o_orderstatus, count(*) AS n, true AS rows_refused FROM orders GROUP BY 1", "orders")(
    lambda o: R.guard_size(o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), 500).withColumn("rows_refused", F.lit(_refused(R.guard_size, o, 100)))
)
r.add("not_null_violations", "SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0", "orders")(lambda o: C.expect_not_null(o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice")).alias("price")), "price").select("o_orderkey"))
r.add("between_violations", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_quantity BETWEEN 5 AND 45", "lineitem")(lambda li: C.expect_between(li, "l_quantity", 5, 45).select("l_orderkey", "l_linenumber"))
_MASKABLE = ("c_custkey", "c_name AS customer_name", "c_acctbal AS balance", "c_mktsegment AS api_key")


def _masks(c: DataFrame) -> DataFrame:
    """Every mode's rows under one another, as text."""
    import hashlib

    df, out = c.selectExpr(*_MASKABLE), None
    for mode in ("full", "masked", "aggregate_only", "classified", "aliases"):
        m = catalog.mask_columns(df, mode)
        cells = F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in m.columns if "bal" not in n and n != f"column_{hashlib.sha256(b'balance').hexdigest()[:10]}"])
        one = m.select(F.lit(mode).alias("mode"), cells.alias("cells"))
        out = one if out is None else out.unionByName(one)
    return out


_ALIAS = lambda n: f"'column_' || left(sha256('{n}'), 10)"
r.add(
    "mask_modes",
    f"""SELECT 'full' AS mode, 'c_custkey=' || c_custkey || '|customer_name=' || c_name || '|api_key=' || c_mktsegment AS cells FROM customer UNION ALL SELECT 'masked', 'c_custkey=' || c_custkey || '|customer_name=[REDACTED]|api_key=[REDACTED]' FROM customer
    UNION ALL SELECT 'classified', 'c_custkey=' || c_custkey || '|customer_name=' || c_name FROM customer UNION ALL SELECT 'aliases', {_ALIAS("c_custkey")} || '=' || c_custkey || '|' || {_ALIAS("customer_name")} || '=' || c_name || '|' || {_ALIAS("api_key")} || '=' || c_mktsegment FROM customer""",
    "customer",
)(_masks)

QUERIES, SQL = r.queries, r.sql
