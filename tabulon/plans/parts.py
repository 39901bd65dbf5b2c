"""Queries of single parts: hashes, slugs, masks, times, links, sources, writers, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon import session
from tabulon.functions import expr
from tabulon.operators import catalog, cleaning, insights, loads
from tabulon.operators import contract as C
from tabulon.plans.base import TEXT_ORDERS, Registry, text_orders
from tabulon.plans.flows import _loaded, _orders_text
from tabulon.sources import files

r = Registry()


# ---------------------------------------------------------------- expressions

r.add("row_hash", "SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR) || chr(31) || c_name || chr(31) || c_mktsegment) AS hash FROM customer", "customer")(
    lambda c: c.select("c_custkey", expr.row_hash(F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")).alias("hash"))
)
r.add("value_digest", "SELECT c_mktsegment, count(*) AS n, count(*) AS same FROM customer GROUP BY 1", "customer")(
    lambda c: c.withColumn("d", expr.value_digest(F.col("c_mktsegment"))).groupBy("d").agg(F.min("c_mktsegment").alias("c_mktsegment"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") == expr.value_digest(F.col("c_mktsegment"))).alias("same")).drop("d")
)
r.add("dataset_slug", "SELECT p_partkey, rtrim(substr(trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), '-') AS slug FROM part", "part")(
    lambda p: p.select("p_partkey", expr.dataset_slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(").csv"))).alias("slug"))
)
_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
r.add("ulid_timestamp", "SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events", "events")(
    lambda e: e.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).select(
        "event_id", expr.ulid_timestamp_ms(F.concat(*[F.substring(F.lit(_BASE32), (F.shiftright("ms", 45 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(10)], F.lit("0000000000000000"))).alias("ms")
    )
)
r.add("display_round", "SELECT event_id, round(value / 3, 4) AS shown FROM events", "events")(lambda e: e.select("event_id", expr.display_round(F.col("value") / 3).alias("shown")))
r.add("parse_datetime", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS t FROM orders", "orders")(
    lambda o: o.select("o_orderkey", expr.parse_datetime(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))).alias("t"))
)


def _headers(p: DataFrame) -> DataFrame:
    """Part names with odd signs and cases as the headers of a file: told apart, cleaned, numbered."""
    odd = p.select(F.col("p_partkey").alias("k"), F.concat(F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")), F.lit("!  ~"), F.lit(" x\t")).alias("raw"))
    return cleaning.cleaned_header_table(odd, "k", "raw")


r.add(
    "clean_headers",
    """WITH h AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END || ' x' AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY k) AS nth FROM h)
    SELECT k, CASE WHEN nth = 1 THEN base ELSE base || '_' || nth END AS name FROM n""",
    "part",
)(_headers)


# ---------------------------------------------------------------- links, contracts, findings

r.add("infer_links", "SELECT DISTINCT 'orders' AS from_table, 'customer_id' AS from_column, 'customers' AS to_table, 'customer_id' AS to_column FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer")(
    lambda o, c: catalog.infer_links(catalog.column_catalog(o.sparkSession, {"orders": o.select("o_orderkey", F.col("o_custkey").alias("customer_id")), "customers": c.select(F.col("c_custkey").alias("customer_id"), "c_name")}))
)


def _contract(df: DataFrame, dataset: str) -> DataFrame:
    return C.chosen_types(C.type_probe(df)).select(F.lit(dataset).alias("dataset"), "column", "kind")


def _diff(o: DataFrame) -> DataFrame:
    """A first contract against one of the same data with a wider, a narrower, a new and a lost column."""
    t = text_orders(o)
    then = t.select("id", "day", F.lit("1.5").alias("grade"), "paid", F.lit("1").alias("width"))
    now = t.select("id", "day", (F.col("id").cast("bigint") % 7).cast("string").alias("grade"), "status", F.lit("x").alias("width"))
    return C.diff_contract(_contract(then, "orders"), _contract(now, "orders"))


r.add(
    "diff_contract",
    f"""WITH {TEXT_ORDERS}, t AS (SELECT count(*) AS n, count(DISTINCT status) AS s FROM text_orders) SELECT 'orders' AS dataset, x."column", x.change FROM t,
    LATERAL (VALUES ('id', 'same'), ('day', 'same'), ('grade', 'narrowed'), ('paid', 'removed'), ('status', CASE WHEN s > 0 THEN 'added' END), ('width', 'blocked')) x("column", change)""",
    "orders",
)(_diff)
r.add(
    "dedupe_findings",
    "WITH g AS (SELECT o_orderpriority AS k, round(sum(o_totalprice), 4) AS v FROM orders GROUP BY 1) SELECT min(o_orderkey) AS id, CAST(row_number() OVER (ORDER BY min(o_orderkey)) AS INT) AS priority FROM orders GROUP BY o_orderpriority",
    "orders",
)(lambda o: _deduped(o))


def _deduped(o: DataFrame) -> DataFrame:
    """Every order finds its priority's total; one finding of each total stays."""
    sums = o.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    found = o.join(sums, "o_orderpriority").select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("table"), F.lit("bar").alias("kind"), F.array("v").alias("values"), F.lit(False).alias("cross"), F.lit(1).alias("table_rows"))
    return insights.dedupe_findings(found).select("id", "priority")


# ---------------------------------------------------------------- files

_EVENTS = "SELECT event_id, user_id, event_type, value FROM events"


def _curated(e: DataFrame) -> DataFrame:
    path = session.work_path(e.sparkSession, "curated") + ".parquet"
    files.write_typed_parquet(e.select("event_id", "user_id", "event_type", "value").withColumn("__load_id", F.lit("L1")), path)
    return files.read_table(e.sparkSession, path)


def _mart(e: DataFrame) -> DataFrame:
    root = session.work_path(e.sparkSession, "marts")
    files.write_mart(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "by_type", root)
    return files.read_curated(e.sparkSession, f"{root}/by_type.parquet")


def _event_log(e: DataFrame) -> DataFrame:
    path = session.work_path(e.sparkSession, "event-log")
    files.write_jsonl_events(e.select(F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("user_id")), path)
    return files.read_event_log(e.sparkSession, path).groupBy("dt", "event").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


r.add("read_curated", _EVENTS, "events")(_curated)
r.add("write_mart", "SELECT event_type, count(*) AS n FROM events GROUP BY 1", "events")(_mart)
r.add("event_log", "SELECT CAST(ts AS DATE) AS dt, event_type AS event, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2", "events")(_event_log)
r.add("extract_incremental", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT median(o_totalprice) FROM orders)", "orders")(
    lambda o: files.extract_incremental(o, "o_totalprice", o.agg(F.percentile("o_totalprice", 0.5)).first()[0], 1 << 30)[0].select("o_orderkey")
)
r.add("sheet_snapshot", "SELECT p_partkey AS place, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS brand FROM part", "part")(lambda p: _sheet(p))


def _sheet(p: DataFrame) -> DataFrame:
    """Parts as ragged rows of cells below a header row."""
    cells = F.when(F.col("p_partkey") % 3 == 0, F.array("p_name")).otherwise(F.array("p_name", "p_brand", "p_type"))
    grid = p.select(F.col("p_partkey").alias("place"), cells.alias("cells"))
    head = p.agg((F.min("p_partkey") - 1).alias("place"), F.array(F.lit("name"), F.lit("brand")).alias("cells"))
    return files.sheet_snapshot(grid.unionByName(head), "place", "cells", ["name", "brand"])


r.add("validate_source", "SELECT 'f' || r_regionkey AS path, CASE r_regionkey WHEN 0 THEN 'empty' WHEN 1 THEN 'too_large' WHEN 2 THEN 'wrong_extension' ELSE 'no_header' END AS reason FROM region WHERE r_regionkey < 4", "region")(lambda g: _checked(g))


def _checked(g: DataFrame) -> DataFrame:
    k = F.col("r_regionkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k == 2, ".pdf").otherwise(".csv"))
    listed = g.select(name.alias("path"), F.when(k == 0, 0).when(k == 1, 1 << 40).otherwise(10).cast("long").alias("length"))
    sniffed = g.select(name.alias("path"), F.when(k == 3, F.array(F.lit(""))).otherwise(F.array("r_name")).alias("header"))
    return files.validate_source(listed, sniffed).withColumn("path", F.substring_index("path", ".", 1))


# ---------------------------------------------------------------- versions


def _snapshots(o: DataFrame) -> DataFrame:
    c = F.col("counts")
    return _loaded(o).snapshots("orders").select("load_id", "mode", "is_current", F.coalesce(c["inserted"], c["insert"]).alias("inserted"), c["update"].alias("updated"))


def _compacted(o: DataFrame) -> DataFrame:
    lake = loads.Lake(o.sparkSession, session.work_path(o.sparkSession, "lake"))
    lake.run_load("orders", _orders_text(o).repartition(9, "id"), "replace", "L1", ["id"])
    lake.compact("orders", "L2", min_files=2)
    return lake.current("orders").select("id", "status")


def _quarantined(o: DataFrame) -> DataFrame:
    """Rows with a repeated key are kept apart, and nothing is loaded."""
    spark, root = o.sparkSession, session.work_path(o.sparkSession, "lake")
    lake = loads.Lake(spark, root)
    lake.run_load("orders", _orders_text(o).unionByName(_orders_text(o)), "replace", "L1", ["id"])
    return spark.read.parquet(f"{root}/orders/_quarantine/L1").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


r.add(
    "lake_snapshots",
    "SELECT 'L1' AS load_id, 'replace' AS mode, count(*) FILTER (o_orderkey % 10 >= 5) = 0 AS is_current, count(*) FILTER (o_orderkey % 10 < 7) AS inserted, NULL::BIGINT AS updated FROM orders UNION ALL SELECT 'L2', 'merge', count(*) FILTER (o_orderkey % 10 >= 5) > 0, count(*) FILTER (o_orderkey % 10 >= 7), count(*) FILTER (o_orderkey % 10 IN (5, 6)) FROM orders",
    "orders",
)(_snapshots)
r.add("lake_compact", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders", "orders")(_compacted)
r.add("lake_quarantine", "SELECT o_orderstatus AS status, 2 * count(*) AS n FROM orders GROUP BY 1", "orders")(_quarantined)

QUERIES, SQL = r.queries, r.sql
