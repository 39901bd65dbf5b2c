"""Queries of sources, versioned loads, telemetry marts, run checks and streams.

Each writes what it reads again (files, a lake, a stream's output) to the folder
that the cluster shares, under a name of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon import session
from tabulon.operators import loads, marts
from tabulon.plans.base import RATE_LIMIT_SQL, TEXT_ORDERS, Registry, table, text_orders
from tabulon.sources import files
from tabulon.streaming import streams

r = Registry()


# ---------------------------------------------------------------- delimited files


def _delimited(o: DataFrame) -> DataFrame:
    spark, path = o.sparkSession, session.work_path(o.sparkSession, "orders-csv")
    files.write_delimited(text_orders(o).select("id", "amount", "day", "status", "paid"), path)
    found = files.sniff_files(spark, [path]).first()  # all parts have one writer
    return files.split_malformed(files.read_delimited(spark, path, found["header"], found["delimiter"], found["encoding"]))[0]


r.add("delimited_orders", f"WITH {TEXT_ORDERS} SELECT id, amount, day, trim(status) AS status, paid FROM text_orders", "orders")(_delimited)


# ---------------------------------------------------------------- versioned loads


def _orders_text(o: DataFrame) -> DataFrame:
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"))


def _loaded(o: DataFrame) -> loads.Lake:
    """A lake with a first load of most orders and a merge of the others and some changed ones."""
    lake, raw = loads.Lake(o.sparkSession, session.work_path(o.sparkSession, "lake")), _orders_text(o)
    last = F.col("id").cast("bigint") % 10
    changed = raw.filter(last >= 5).withColumn("status", F.when(last < 7, F.concat("status", F.lit("x"))).otherwise(F.col("status")))
    lake.run_load("orders", raw.filter(last < 7), "replace", "L1", ["id"], history=True)
    lake.run_load("orders", changed, "merge", "L2", ["id"], history=True)
    return lake


def _rolled_back(o: DataFrame) -> DataFrame:
    lake = _loaded(o)
    lake.rollback("orders", "L2")
    return lake.current("orders").select("id", "status")


r.add("lake_merge", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 IN (5, 6) THEN o_orderstatus || 'x' ELSE o_orderstatus END AS status FROM orders", "orders")(lambda o: _loaded(o).current("orders").select("id", "status"))
r.add("lake_history", "SELECT CASE WHEN c = 1 THEN 'insert' ELSE 'update' END AS change, count(*) AS rows FROM (SELECT 1 AS c FROM orders UNION ALL SELECT 2 FROM orders WHERE o_orderkey % 10 IN (5, 6)) GROUP BY 1", "orders")(
    lambda o: loads.load_counts(_loaded(o).history("orders"))
)
r.add("lake_rollback", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 < 7", "orders")(_rolled_back)


def _with_bad_lines(o: DataFrame, every: int, buckets: int = 4) -> str:
    """Orders as four CSV files, or more; of each ``every`` lines one has a field too many and one lacks a field."""
    k, path = F.col("o_orderkey"), session.work_path(o.sparkSession, "bad-lines")
    line = F.concat_ws(",", k, "o_orderstatus", F.when(k % every != 1, F.concat(F.lit('"'), "o_orderpriority", F.lit(', say"'))), F.when(k % every == 0, F.lit("more")))
    rows = o.select((k % buckets).alias("bucket"), k.alias("at"), line.alias("value"))
    head = o.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(-1).cast("bigint").alias("at"), F.lit("id,status,priority").alias("value"))
    rows.unionByName(head).repartition("bucket").sortWithinPartitions("bucket", "at").select("bucket", "value").write.partitionBy("bucket").text(path)
    return path


def _bad_lines(o: DataFrame) -> DataFrame:
    found = files.malformed_lines(o.sparkSession, _with_bad_lines(o, 32), 3)
    return found.select(F.regexp_extract("file", "bucket=([0-9])", 1).cast("bigint").alias("bucket"), "line", "fields")


def _loads_with_bad_lines(o: DataFrame) -> DataFrame:
    """Files with a thirty-second of bad lines are loaded without them, those with an eighth are quarantined."""
    spark = o.sparkSession
    lake = loads.Lake(spark, session.work_path(spark, "lake"))
    buckets = 4 * -(-o.count() // 1_000_000)  # as large exports come, in files of a quarter of a million lines
    for load_id, every in (("F1", 64), ("F2", 16)):
        path = _with_bad_lines(o, every, buckets)
        lake.load_files("orders", [f"{path}/bucket={b}" for b in range(buckets)], "replace", load_id, ["id"])
    loaded = lake.current("orders").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), F.max("priority").alias("last")).withColumn("load_id", F.lit("F1"))
    gate = F.explode(F.from_json("checks", "checks array<struct<check:string,severity:string,rows:bigint>>, malformed_samples array<struct<line:bigint,fields:int>>")["checks"])
    told = lake.loads("orders").withColumn("samples", F.size(F.from_json("checks", "malformed_samples array<struct<line:bigint,fields:int>>")["malformed_samples"]))
    bad = told.select("load_id", "status", "samples", gate.alias("c")).filter("c.check = 'malformed_rows'").select("load_id", "status", "samples", F.col("c.rows").alias("malformed"), "c.severity")
    return bad.join(loaded, "load_id", "left")


r.add("malformed_lines", "SELECT bucket, line, fields FROM (SELECT o_orderkey AS k, o_orderkey % 4 AS bucket, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) + 1 AS line, CAST(CASE WHEN o_orderkey % 32 = 0 THEN 4 ELSE 2 END AS INTEGER) AS fields FROM orders) WHERE k % 32 IN (0, 1)", "orders")(_bad_lines)
r.add(
    "malformed_loads",
    """WITH b AS (SELECT 'F1' AS load_id, 64 AS every UNION ALL SELECT 'F2', 16),
    c AS (SELECT load_id, count(*) FILTER (o_orderkey % every IN (0, 1)) AS malformed, count(*) AS n, count(*) FILTER (o_orderkey % every NOT IN (0, 1)) AS rows, max(o_orderpriority || ', say') FILTER (o_orderkey % every NOT IN (0, 1)) AS last FROM orders, b GROUP BY 1)
    SELECT load_id, CASE WHEN malformed > 0.05 * n THEN 'quarantined' ELSE 'succeeded' END AS status, CAST(least(malformed, 20) AS INTEGER) AS samples, malformed, CASE WHEN malformed > 0.05 * n THEN 'fail' ELSE 'warn' END AS severity,
      CASE WHEN malformed <= 0.05 * n THEN rows END AS rows, CASE WHEN malformed <= 0.05 * n THEN rows END AS ids, CASE WHEN malformed <= 0.05 * n THEN last END AS last FROM c""",
    "orders",
)(_loads_with_bad_lines)


# ---------------------------------------------------------------- pulls with a stored cursor


def _pulled(o: DataFrame) -> loads.Lake:
    """Orders pulled by key in thirds; the second pull dies once before its version, and is run again after the source grew."""
    lake = loads.Lake(o.sparkSession, session.work_path(o.sparkSession, "lake"))
    rows = _orders_text(o).withColumn("id", F.col("id").cast("bigint"))
    limit = -(-rows.count() // 3)
    lake.pull("orders", "shop", rows, "id", "P1", limit=limit)
    whole, lake.run_load = lake.run_load, _dies
    try:
        lake.pull("orders", "shop", rows, "id", "P2", limit=limit)
    except InterruptedError:
        lake.run_load = whole
    for load_id in ("P2", "P2", "P3", "P4"):
        lake.pull("orders", "shop", rows, "id", load_id, limit=limit + 7 * (load_id == "P2"))  # a new limit does not move a recorded range
    return lake


def _dies(*_: object, **__: object) -> str:
    raise InterruptedError


r.add("cursor_pulls", "SELECT o_orderkey AS id, o_orderstatus AS status, 'P' || CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // CAST(ceil(count(*) OVER () / 3) AS BIGINT) + 1 AS VARCHAR) AS load_id FROM orders", "orders")(
    lambda o: _pulled(o).current("orders").select("id", "status", F.col("__load_id").alias("load_id"))
)
r.add("connector_state", "SELECT 'orders' AS dataset, 'shop' AS source, CAST(max(o_orderkey) AS VARCHAR) AS \"cursor\", 4::BIGINT AS runs, 'empty' AS last_status, 'P3' AS last_load_id, count(*) - 2 * CAST(ceil(count(*) / 3) AS BIGINT) AS last_rows FROM orders", "orders")(
    lambda o: _pulled(o).connector_state("orders").drop("last_run_at")
)


def _versions(o: DataFrame) -> DataFrame:
    """Two loads, one that brings nothing new, and rollbacks of all but the first: loads, versions and what is current."""
    lake = _loaded(o)
    last = F.col("id").cast("bigint") % 10
    lake.run_load("orders", _orders_text(o).filter(last < 5), "append", "L3", ["id"])
    lake.rollback("orders", "L3")
    lake.rollback("orders", "L2")
    n = lake.current("orders").count()
    return lake.loads("orders").join(lake.snapshots("orders").select("load_id", "is_current"), "load_id", "left").select("load_id", "status", F.col("version").isNotNull().alias("has_version"), "is_current", F.when(F.col("is_current"), n).alias("rows"), F.col("counts")["inserted"].alias("inserted"), F.col("counts")["skipped"].alias("skipped"))


r.add(
    "lake_versions",
    """SELECT 'L1' AS load_id, 'succeeded' AS status, true AS has_version, true AS is_current, count(*) FILTER (o_orderkey % 10 < 7) AS rows, count(*) FILTER (o_orderkey % 10 < 7) AS inserted, NULL::BIGINT AS skipped FROM orders
    UNION ALL SELECT 'L2', 'rolled_back', true, false, NULL, NULL, NULL UNION ALL SELECT 'L3', 'rolled_back', false, NULL, NULL, 0, count(*) FROM orders WHERE o_orderkey % 10 < 5""",
    "orders",
)(_versions)


# ---------------------------------------------------------------- the load ledger and its marts


def _ledger(o: DataFrame) -> DataFrame:
    """Orders as load records in JSON lines, read back as a ledger."""
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").otherwise("quarantined")
    k = F.col("o_orderkey")
    rows = o.select(
        F.lpad(k.cast("string"), 12, "0").alias("load_id"),
        F.concat(F.lit("p"), k % 3).alias("project_id"),
        F.col("o_orderpriority").alias("dataset"),
        status.alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        (k % 100).alias("duration_ms"),
        F.when(k % 7 > 0, k * 10).alias("raw_bytes"),
        F.struct((k % 1000).alias("rows_in"), (k % 900).alias("rows_out"), F.when(k % 5 > 0, k % 13).alias("rows_rejected")).alias("counts"),
        F.struct(F.element_at(F.array(*map(F.lit, ("passed", "warned", None))), (k % 3 + 1).cast("int")).alias("status")).alias("quality"),
    )
    path = session.work_path(o.sparkSession, "ledger-json")
    rows.write.json(path)
    return files.read_load_ledger(o.sparkSession, path, lines=True)


_LOADS = """l AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS load_id, 'p' || CAST(o_orderkey % 3 AS VARCHAR) AS project_id, o_orderpriority AS dataset,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'quarantined' END AS status, CAST(o_orderdate AS DATE) AS dt, o_orderkey % 100 AS duration_ms, o_orderkey % 900 AS rows_out,
  CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey * 10 END AS raw_bytes, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 13 END AS rows_rejected, ['passed', 'warned', NULL][o_orderkey % 3 + 1] AS quality_status FROM orders)"""

r.add("fct_loads", f"WITH {_LOADS} SELECT load_id, project_id, dataset, status, dt, duration_ms, rows_out, CASE WHEN duration_ms > 0 THEN round(rows_out * 1000 / duration_ms, 2) END AS rows_per_s FROM l", "orders")(
    lambda o: marts.fct_loads(_ledger(o)).select("load_id", "project_id", "dataset", "status", "dt", "duration_ms", "rows_out", "rows_per_s")
)
r.add(
    "daily_pipeline",
    f"""WITH {_LOADS} SELECT dt, project_id, count(*) AS loads, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status = 'failed') AS failed,
    round(count(*) FILTER (status = 'quarantined') / count(*), 4) AS quarantine_rate, CAST(coalesce(sum(rows_out), 0) AS BIGINT) AS rows_loaded, CAST(coalesce(sum(rows_rejected), 0) AS BIGINT) AS rows_rejected, CAST(coalesce(sum(raw_bytes), 0) AS BIGINT) AS raw_bytes,
    round(avg(duration_ms)) AS avg_duration_ms, CAST(quantile_cont(duration_ms, 0.95) AS DOUBLE) AS p95_duration_ms, max(duration_ms) AS max_duration_ms FROM l GROUP BY 1, 2""",
    "orders",
)(lambda o: marts.daily_pipeline(marts.fct_loads(_ledger(o))))
r.add(
    "dataset_health",
    f"""WITH {_LOADS}, latest AS (SELECT project_id, dataset, max(load_id) AS last_success_load_id FROM l WHERE status = 'succeeded' GROUP BY 1, 2)
    SELECT project_id, dataset, count(*) AS loads, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status = 'failed') AS failed,
    min(dt) AS first_load_at, max(dt) AS last_load_at, last_success_load_id, max(CASE WHEN load_id = last_success_load_id THEN rows_out END) AS last_rows_out, max(CASE WHEN load_id = last_success_load_id THEN quality_status END) AS last_quality_status,
    CAST(coalesce(sum(rows_rejected), 0) AS BIGINT) AS rows_rejected_total, round(avg(duration_ms)) AS avg_duration_ms FROM l LEFT JOIN latest USING (project_id, dataset) GROUP BY project_id, dataset, last_success_load_id""",
    "orders",
)(lambda o: marts.dataset_health(_ledger(o)).withColumns({c: F.to_date(c) for c in ("first_load_at", "last_load_at")}))
_DONE = "count(*) FILTER (status IN ('succeeded', 'quarantined', 'failed'))"
r.add(
    "load_report",
    f"""WITH {_LOADS}, s AS (SELECT * FROM l WHERE status = 'succeeded'), p AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) - 1 AS pos, count(*) OVER () - 1 AS n FROM s),
    a AS (SELECT count(*) AS loads_total, count(*) FILTER (dt >= DATE '1998-01-01') AS loads_24h, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status = 'failed') AS failed, 0 AS rolled_back, 0 AS other_status,
      sum(rows_out) FILTER (status = 'succeeded') AS rows_loaded, sum(rows_rejected) AS rows_rejected, sum(raw_bytes) AS raw_bytes, floor(avg(duration_ms) FILTER (status = 'succeeded')) AS avg_ms, max(duration_ms) FILTER (status = 'succeeded') AS max_ms,
      round(sum(rows_out) FILTER (status = 'succeeded') / (sum(duration_ms) FILTER (status = 'succeeded') / 1000), 1) AS rows_per_s, round(count(*) FILTER (status = 'quarantined') / {_DONE}, 4) AS quarantine_rate, round(count(*) FILTER (status = 'failed') / {_DONE}, 4) AS failure_rate,
      (SELECT max(duration_ms) FROM p WHERE pos = round_even(0.5 * n, 0)) AS p50, (SELECT max(duration_ms) FROM p WHERE pos = round_even(0.95 * n, 0)) AS p95 FROM l)
    SELECT metric, CAST(value AS DOUBLE) AS value FROM (SELECT {{}} FROM a) UNPIVOT (value FOR metric IN (COLUMNS(*)))""".replace(
        "{}", ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("loads_total", "loads_24h", "succeeded", "quarantined", "failed", "rolled_back", "other_status", "rows_loaded", "rows_rejected", "raw_bytes", "avg_ms", "max_ms", "rows_per_s", "quarantine_rate", "failure_rate", "p50", "p95"))
    ),
    "orders",
)(lambda o: loads.load_report(_ledger(o), F.lit("1998-01-02").cast("timestamp")))
r.add(
    "loads_by_dataset",
    f"""WITH {_LOADS}, m AS (SELECT *, (dt, load_id) AS o FROM l) SELECT dataset, count(*) AS loads, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status = 'failed') AS failed,
    arg_max(load_id, o) AS last_load_id, arg_max(status, o) AS last_status, arg_max_null(rows_out, o) FILTER (status = 'succeeded') AS rows_current, arg_max_null(quality_status, o) FILTER (status = 'succeeded') AS quality_status FROM m GROUP BY 1""",
    "orders",
)(lambda o: loads.loads_by_dataset(_ledger(o)).drop("last_mode", "last_finished_at"))
r.add("recent_loads", f"WITH {_LOADS} SELECT load_id, dataset, status, rows_out FROM l ORDER BY dt DESC, load_id DESC LIMIT 20", "orders")(lambda o: loads.recent_loads(_ledger(o)).select("load_id", "dataset", "status", "rows_out"))


# ---------------------------------------------------------------- runs


def _runs(o: DataFrame, li: DataFrame) -> DataFrame:
    """Orders as runs of an assistant: their lines are the steps, most end with ``finish``. An order has few lines."""
    failed = (F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 7 == 0)
    line = F.struct("l_linenumber", F.col("l_returnflag").alias("tool"), F.when(failed, "error").otherwise("ok").alias("status"))
    steps = li.groupBy(F.col("l_orderkey").alias("request_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    k = F.col("request_id")
    one_of = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    head = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderstatus").alias("answer"), F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("dt"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("user_id"))
    trace = F.transform("lines", lambda x: F.struct(x["tool"].alias("tool"), x["status"].alias("status")))
    finish = F.array(F.struct(F.lit("finish").alias("tool"), F.lit("ok").alias("status")))
    runs = head.join(steps, "request_id").withColumn("trace", F.when(k % 6 == 0, trace).otherwise(F.concat(trace, finish))).drop("lines")
    kind = one_of(None, "table", "dataframe", "aggregate", "number", "aggregate", "table", "number")
    runs = runs.withColumns({
        "case_id": k, "project_id": k % 3, "status": one_of("text", "failed", "finished", "finished", "finished"), "query": one_of("total price of orders", "average price", "hello there", "MAX_price by customer"),
        "result_kind": kind, "result_rows": k % 50, "result_columns": k % 5, "result_operation": one_of("sum", "avg", "max"), "result_value": F.when(k % 16 == 4, float("nan")).otherwise(F.col("price")),
        "verified": k % 2 == 0, "feedback": one_of("up", "down", None), "turns": k % 9, "tool_calls": F.size("trace"), "duration_ms": k % 100, "model_name": one_of("m0", "m1", None, "m1"), "routing_tier": one_of("advanced", "basic"),
        "retries": k % 3, "self_corrections": k % 4, "input_tokens": k % 1000, "output_tokens": k % 100, "cost_usd": (k % 50) / 1000.0,
    })
    return runs.withColumn("error_type", F.when(F.col("status") == "failed", one_of("timeout", "no_result")))


_RUNS = """t AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS has_r, bool_or(l_returnflag = 'A') AS has_a, bool_or(l_linenumber = 1 AND l_orderkey % 7 = 0) AS tool_failed, count(*) AS lines FROM lineitem GROUP BY 1),
  run AS (SELECT o_orderkey AS k, o_custkey AS user_id, o_orderdate AS created_at, o_orderstatus AS answer, tool_failed, has_r, has_a, CAST(o_orderdate AS DATE) AS dt, o_orderkey % 3 AS project_id, o_orderkey % 6 <> 0 AS finish, lines + CASE WHEN o_orderkey % 6 <> 0 THEN 1 ELSE 0 END AS tool_calls,
    ['text', 'failed', 'finished', 'finished', 'finished'][o_orderkey % 5 + 1] AS status, o_orderkey % 4 AS query, [NULL, 'table', 'dataframe', 'aggregate', 'number', 'aggregate', 'table', 'number'][o_orderkey % 8 + 1] AS kind,
    ['up', 'down', NULL][o_orderkey % 3 + 1] AS feedback, ['sum', 'avg', 'max'][o_orderkey % 3 + 1] AS operation FROM orders JOIN t ON l_orderkey = o_orderkey),
  f AS (SELECT *, status = 'finished' AS fin, ['sum', 'avg', NULL, 'max'][query + 1] AS wanted FROM run),
  c AS (SELECT *, list_filter([
      CASE WHEN fin THEN ('finish_selected', finish) END, CASE WHEN fin THEN ('named_result', kind IS NOT NULL) END,
      CASE WHEN fin AND kind IS NOT NULL THEN ('bounded_output', k % 50 <= 25 OR kind IN ('dataframe', 'aggregate')) END,
      CASE WHEN fin AND kind IN ('table', 'dataframe', 'aggregate') THEN ('columns_present', k % 5 > 0) END,
      CASE WHEN fin AND kind = 'aggregate' AND wanted IS NOT NULL THEN ('aggregate_operation', operation = wanted) END,
      CASE WHEN fin AND kind = 'number' THEN ('finite_number', k % 16 <> 4) END,
      CASE WHEN status = 'text' THEN ('text_is_appropriate', query NOT IN (0, 1)) END], lambda x: x IS NOT NULL) AS checks FROM f)"""
_GRADED = """len(checks) > 0 AND len(list_filter(checks, lambda x: NOT x[2])) = 0 AS passed, CASE WHEN len(checks) > 0 THEN round(len(list_filter(checks, lambda x: x[2])) / len(checks), 3) ELSE 0.0 END AS score,
    array_to_string(list_transform(list_filter(checks, lambda x: NOT x[2]), lambda x: x[1]), ',') AS failed"""


def _cases(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    words = lambda *w: F.array(*map(F.lit, w))
    return o.select(
        k.alias("case_id"), F.when(k % 2 == 0, words("R", "finish")).alias("expected_tools"), F.when(k % 3 == 0, words("A")).alias("forbidden_tools"),
        F.when(k % 8 == 1, "table").alias("expected_kind"), F.when(k % 4 == 0, 6).alias("max_turns"), F.when(k % 4 == 1, 5).alias("max_tool_calls"), F.when(k % 5 == 2, "F").alias("expected_answer"), (k % 10 == 3).alias("required_correction"),
    )


def _suite(o: DataFrame, li: DataFrame) -> DataFrame:
    return marts.evaluate_suite(_cases(o), _runs(o, li))


_SUITE = f"""{_RUNS}, e AS (SELECT o_orderkey AS case_id, c.* EXCLUDE (checks), CASE WHEN k IS NULL THEN [('ran', false)] ELSE checks || list_filter([
    CASE WHEN k % 2 = 0 THEN ('expected_tool_sequence', has_r AND finish) END, CASE WHEN k % 3 = 0 THEN ('forbidden_tools', NOT has_a) END, CASE WHEN k % 8 = 1 THEN ('result_kind', kind = 'table') END,
    CASE WHEN k % 4 = 0 THEN ('turn_efficiency', k % 9 <= 6) END, CASE WHEN k % 4 = 1 THEN ('tool_efficiency', tool_calls <= 5) END, CASE WHEN k % 5 = 2 THEN ('answer_accuracy', answer = 'F') END,
    CASE WHEN k % 10 = 3 THEN ('self_correction_success', fin AND k % 4 > 0) END], lambda x: x IS NOT NULL) END AS checks FROM orders LEFT JOIN c ON k = o_orderkey)"""

r.add("verify_runs", f"WITH {_RUNS} SELECT k AS request_id, {_GRADED}, tool_failed FROM c", "orders", "lineitem")(lambda o, li: marts.verify_runs(_runs(o, li)).withColumn("failed", F.array_join("failed", ",")))
r.add("evaluate_suite", f"WITH {_SUITE} SELECT case_id, {_GRADED.replace('checks) > 0 AND', 'checks) > 0 AND k IS NOT NULL AND')} FROM e WHERE k IS NOT NULL", "orders", "lineitem")(
    lambda o, li: _suite(o, li).join(li.select(F.col("l_orderkey").alias("case_id")).distinct(), "case_id", "left_semi").withColumn("failed", F.array_join("failed", ","))
)
r.add(
    "suite_metrics",
    f"""WITH {_SUITE}, g AS (SELECT *, {_GRADED} FROM e WHERE k IS NOT NULL) SELECT count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(avg(score), 3) AS average_score, round(count(*) FILTER (fin) / count(*), 3) AS execution_success_rate,
    round(count(*) FILTER (passed) / count(*), 3) AS answer_accuracy_rate, round(count(*) FILTER (fin AND k % 4 > 0) / count(*) FILTER (k % 4 > 0), 3) AS self_correction_success_rate, CAST(sum(k % 3) AS BIGINT) AS retries,
    CAST(round(avg(k % 100)) AS BIGINT) AS average_latency_ms, CAST(sum(k % 1000 + k % 100) AS BIGINT) AS tokens, round(sum((k % 50) / 1000.0), 6) AS cost_usd FROM g""",
    "orders",
    "lineitem",
)(lambda o, li: marts.suite_metrics(marts.evaluate_suite(_cases(o).join(li.select(F.col("l_orderkey").alias("case_id")).distinct(), "case_id", "left_semi"), _runs(o, li)), _runs(o, li)))

_PAIRS = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws("=", p["value"], p["n"].cast("string"))), ";")
r.add(
    "run_metrics",
    f"""WITH {_RUNS}, d AS (SELECT status IN ('finished', 'text') AS done, * FROM run),
    m AS (SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) AS s FROM (SELECT ['m0', 'm1', 'unknown', 'm1'][k % 4 + 1] AS v, count(*) AS n FROM d GROUP BY 1)),
    x AS (SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) AS s FROM (SELECT ['timeout', 'no_result'][k % 2 + 1] AS v, count(*) AS n FROM d WHERE status = 'failed' GROUP BY 1)),
    u AS (SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) AS s FROM (SELECT v, count(*) AS n FROM (SELECT l_returnflag AS v FROM lineitem JOIN run ON k = l_orderkey UNION ALL SELECT 'finish' FROM run WHERE finish) GROUP BY 1))
    SELECT count(*) AS runs, count(*) FILTER (done) AS completed, round(count(*) FILTER (done) / count(*), 3) AS success_rate, round(count(*) FILTER (done AND k % 2 = 0) / count(*) FILTER (done), 3) AS verified_rate,
      round(count(*) FILTER (feedback = 'up') / count(*) FILTER (feedback IS NOT NULL), 3) AS positive_rate, round(avg(k % 9), 2) AS avg_turns, round(avg(tool_calls), 2) AS avg_tool_calls, CAST(round(avg(k % 100)) AS BIGINT) AS avg_ms,
      CAST(sum(k % 3) AS BIGINT) AS retries, CAST(sum(k % 4) AS BIGINT) AS self_corrections, CAST(sum(k % 1000) AS BIGINT) AS input_tokens, CAST(sum(k % 100) AS BIGINT) AS output_tokens, round(sum((k % 50) / 1000.0), 6) AS cost_usd,
      (SELECT s FROM x) AS failures, (SELECT s FROM m) AS models, (SELECT s FROM u) AS top_tools FROM d""",
    "orders",
    "lineitem",
)(lambda o, li: marts.run_metrics(_runs(o, li)).withColumns({c: _PAIRS(c) for c in ("failures", "models", "top_tools")}))
r.add(
    "daily_agent",
    f"""WITH {_RUNS} SELECT dt, project_id, count(*) AS runs, count(*) FILTER (status = 'finished') AS finished, round(count(*) FILTER (status = 'finished') / count(*), 4) AS success_rate, round(avg(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END), 4) AS verification_pass_rate,
    count(*) FILTER (k % 2 = 0) AS advanced_runs, CAST(sum(k % 1000) AS BIGINT) AS input_tokens, CAST(sum(k % 100) AS BIGINT) AS output_tokens, round(sum((k % 50) / 1000.0), 6) AS cost_usd, round(avg(k % 100)) AS avg_duration_ms,
    quantile_cont(k % 100, 0.95) AS p95_duration_ms, round(avg(tool_calls), 2) AS avg_tool_calls FROM run GROUP BY 1, 2""",
    "orders",
    "lineitem",
)(lambda o, li: marts.daily_agent(_runs(o, li)))
_GOALS = ("total price per customer", "Show the average of 12 orders", "rank 'A B' by price, top 5", "mail me@x.org the trend")


def _similar(o: DataFrame, li: DataFrame) -> DataFrame:
    """For each order as a new request, what to learn from its customer's other orders."""
    goal = F.element_at(F.array(*map(F.lit, _GOALS)), (F.col("request_id") % 4 + 1).cast("int"))
    runs = _runs(o, li).withColumn("goal", goal)
    now = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.element_at(F.array(*map(F.lit, _GOALS)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("goal"))
    return marts.similar_runs(now, runs, schema_words=("price", "customer", "orders"))


r.add(
    "similar_runs",
    f"""WITH {_RUNS}, g AS (SELECT [['total', 'price', 'per', 'customer'], ['average', 'number', 'orders'], ['rank', 'value', 'price', 'top', 'number'], ['value', 'trend']] AS w),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, k DESC) AS age FROM run WHERE status IN ('finished', 'text') AND coalesce(feedback, '') <> 'down'),
    j AS (SELECT o_orderkey AS id, p.k AS request_id, age, w[o_orderkey % 3 + 1] AS a, w[p.k % 4 + 1] AS b, feedback FROM orders JOIN p ON p.user_id = o_custkey, g WHERE age <= 100 AND p.k % 2 = 0),
    s AS (SELECT *, round(len(list_intersect(a, b)) / len(list_distinct(a || b)) + CASE WHEN feedback = 'up' THEN 0.15 ELSE 0 END, 6) AS score FROM j),
    q AS (SELECT id, request_id, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, age) AS INT) AS rank FROM s)
    SELECT * FROM q WHERE rank <= 3 AND (score > 0 OR rank = 1)""",
    "orders",
    "lineitem",
)(_similar)


# ---------------------------------------------------------------- streams


def _arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _events(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(rows: DataFrame, mode: str) -> DataFrame:
    """All that a stream yields from what has arrived; ``complete`` output replaces, ``append`` adds."""
    spark, path = rows.sparkSession, session.work_path(rows.sparkSession, "stream")
    keep = "overwrite" if mode == "complete" else "append"
    out = rows.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode(keep).parquet(f"{path}/rows"))
    out.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _finished(streams.windowed_counts(_events(_arriving(spark, sf_dir, "events"))), "complete")
    return days.select(F.to_date("start").alias("day"), "event_type", "n", "total", "peak")


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted = _finished(streams.rate_limit_stream(_arriving(spark, sf_dir, "events"), 2, 86_400.0), "append")
    return admitted.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _late_mart(spark: SparkSession, sf_dir: str) -> streams.WindowedMart:
    """Events in two arrivals: the second half of the month first, then the others."""
    e, path = _events(table(spark, sf_dir, "events")), session.work_path(spark, "late")
    mart = streams.WindowedMart(spark, f"{path}/mart", delay="3 days")
    for early in (False, True):
        e.filter((F.to_date("ts") < F.lit("2024-01-15").cast("date")) == early).write.mode("append").parquet(f"{path}/in")
        mart.run(spark.readStream.schema(e.schema).parquet(f"{path}/in"), f"{path}/checkpoint").awaitTermination()
    return mart


def stream_late_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on time with their counts, and days of late rows: together all events."""
    mart = _late_mart(spark, sf_dir)
    on_time = mart.counts().select(F.to_date("start").alias("day"), "event_type", "n", "total", "peak", F.lit(False).alias("late"))
    late = mart.late_rows().select(F.to_date("start").alias("day"), F.lit(None).cast("string").alias("event_type"), "n", F.lit(None).cast("double").alias("total"), F.lit(None).cast("double").alias("peak"), F.lit(True).alias("late"))
    return on_time.unionByName(late)


def stream_event_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through the sink's hourly JSON files and back: runs by day."""
    live = _events(_arriving(spark, sf_dir, "events"))
    path = session.work_path(spark, "events-json")
    event = F.when(F.col("event_id") % 2 == 0, "agent.run").otherwise(F.col("event_type"))
    rows = live.select(event.alias("event"), "ts", F.col("user_id").cast("string").alias("user_id"), F.col("event_id").alias("input_tokens"))
    streams.sink_events(rows, f"{path}/events", f"{path}/checkpoint", once=True).awaitTermination()
    runs = marts.fct_agent_runs(files.read_event_log(spark, f"{path}/events"))
    return runs.groupBy("dt").agg(F.count(F.lit(1)).alias("runs"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that arrive as files become loads of a lake."""
    path = session.work_path(spark, "lake")
    lake = loads.Lake(spark, path)
    streams.load_on_arrival(_orders_text(_arriving(spark, sf_dir, "orders")), lake, "orders", "append", ["id"], f"{path}-checkpoint").awaitTermination()
    return lake.current("orders").select("id", "status")


for f in (stream_daily_counts, stream_late_counts, stream_rate_limit, stream_event_sink, stream_load):
    r.queries[f.__name__] = f
r.sql |= {
    "stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS peak FROM events GROUP BY 1, 2",
    "stream_late_counts": """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, value, ts < TIMESTAMP '2024-01-15' AND CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM events WHERE ts >= TIMESTAMP '2024-01-15') - INTERVAL 3 DAY AS late FROM events)
    SELECT day, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS peak, false AS late FROM e WHERE NOT coalesce(late, false) GROUP BY 1, 2 UNION ALL SELECT day, NULL, count(*), NULL, NULL, true FROM e WHERE late GROUP BY 1""",
    "stream_rate_limit": RATE_LIMIT_SQL,
    "stream_event_sink": "SELECT CAST(ts AS DATE) AS dt, count(*) AS runs, CAST(sum(event_id) AS BIGINT) AS input_tokens, 0::BIGINT AS output_tokens FROM events WHERE event_id % 2 = 0 GROUP BY 1",
    "stream_load": "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders",
}

QUERIES, SQL = r.queries, r.sql
