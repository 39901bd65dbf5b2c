"""Pulls, ceilings, late rows, expiring state, malformed lines, rollbacks, links, reports, findings on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import catalog, cleaning, findings, links, loads, marts, report
from tabulon.operators import contract as C
from tabulon.plans import flows
from tabulon.sources import files
from tabulon.streaming import streams

START = dt.datetime(2024, 1, 1)


# ---------------------------------------------------------------- ceilings


def sequential(events, ur, ut, gr, gt):
    """Each request in turn against running counters."""
    counts, out = {}, {}
    for user, event, ts, tokens in sorted(events, key=lambda e: (e[2], e[1])):
        day = ts.date()
        get = lambda *k, day=day: counts.get((day, *k), 0)
        reason = None
        if gt and get("gt") >= gt:
            reason = "global_tokens"
        elif ut and get("ut", user) >= ut:
            reason = "user_tokens"
        elif ur and get("ur", user) + 1 > ur:
            reason = "user_requests"
        elif gr and get("gr") + 1 > gr:
            reason = "global_requests"
        if reason is None:
            for key, n in ((("gt",), max(0, tokens or 0)), (("ut", user), max(0, tokens or 0)), (("ur", user), 1), (("gr",), 1)):
                counts[day, *key] = get(*key) + n
        out[event] = (reason is None, reason)
    return out


@pytest.mark.parametrize("caps", [(3, 40, 60, 900), (2, 0, 25, 0), (0, 30, 0, 500), (0, 0, 10, 0), (0, 0, 0, 0)])
def test_global_ceilings_equal_a_loop(spark, caps):
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, 3, 4, 5, 6, 7, None]) if k % 3 else 1, k, START + dt.timedelta(minutes=rng.randint(0, 2800)), rng.choice([None, -5, 0, 7, 13, 50])) for k in range(400)]
    df = spark.createDataFrame(rows, "user_id int, event_id int, ts timestamp_ntz, tokens int")
    for seconds in (60, 86_400):
        got = {r["event_id"]: (r["admitted"], r["reason"]) for r in marts.usage_budget(df, *caps, slice_seconds=seconds).collect()}
        assert got == sequential(rows, *caps)
    assert marts.usage_budget(df.limit(0), *caps).count() == 0


# ---------------------------------------------------------------- streams


def test_late_rows_are_counted(spark, tmp_path):
    mart = streams.WindowedMart(spark, f"file://{tmp_path}/mart", delay="1 day")
    schema = "event_type string, ts timestamp, value double"
    at = lambda d, h=1: START + dt.timedelta(days=d, hours=h)
    batches = [[("a", at(9), 1.0), ("b", at(5), 2.0)], [("a", at(9, 2), 3.0), ("a", at(7, 23), 4.0), ("a", at(6), 5.0), ("b", None, 1.0)], [("b", at(9), 9.0)]]
    for k, rows in enumerate(batches):
        mart.add(spark.createDataFrame(rows, schema), k)
        mart.add(spark.createDataFrame(rows, schema), k)  # a repeated batch replaces itself
    on_time = {(r["start"].day, r["event_type"]): (r["n"], r["total"]) for r in mart.counts().collect()}
    # After the first batch the watermark is day 9, 1:00, of which windows up to day 8 end at or before.
    assert on_time == {(10, "a"): (2, 4.0), (6, "b"): (1, 2.0), (10, "b"): (1, 9.0)}
    assert sum(n for n, _ in on_time.values()) + mart.late_rows().agg(F.sum("n")).first()[0] == sum(map(len, batches))


def test_audit_equals_a_loop_over_batches(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]) if k % 3 else 7, k, START + dt.timedelta(seconds=rng.randint(0, 900))) for k in range(500)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "13")
    try:
        got = {r["event_id"]: r["admitted"] for r in streams.rate_limit_audit(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp"), 3, 60.0).collect()}
    finally:
        spark.conf.set(key, before)
    want = {}
    for u in {r[0] for r in rows}:
        times = []
        for _, e, ts in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1])):
            want[e], times = streams.admit(times, (ts - START).total_seconds(), 3, 60.0)
    assert got == want


def test_limiter_forgets_idle_users(spark, tmp_path):
    rng = random.Random(3)
    rows = [(u, u * 1000 + k, START + dt.timedelta(seconds=int(t))) for u in range(4) for k, t in enumerate(sorted(rng.uniform(0, 300) for _ in range(30)))]
    late = [(9, 9999, START + dt.timedelta(seconds=5000))]
    schema = "user_id long, event_id long, ts timestamp"
    counts = []
    for part in (rows, late, [(9, 10000, START + dt.timedelta(seconds=5001))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = streams.rate_limit_stream(live, 3, 60.0, "1 minute").writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/out"))
        q = q.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        counts.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {r["event_id"]: r["admitted"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for u in {r[0] for r in rows}:
        times = []
        for _, e, ts in sorted((r for r in rows if r[0] == u), key=lambda r: r[2]):
            want[e], times = streams.admit(times, (ts - START).total_seconds(), 3, 60.0)
    assert got == want | {9999: True, 10000: True}
    assert counts[0] >= 4 and counts[-1] < counts[0]  # the four idle users are gone


# ---------------------------------------------------------------- loads


def lake_of(spark, tmp_path):
    return loads.Lake(spark, f"file://{tmp_path}/lake")


def text(spark, rows):
    return spark.createDataFrame([(str(i), s) for i, s in rows], "id string, status string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_rollbacks_in_a_row_and_loads_without_news(spark, tmp_path):
    lake = lake_of(spark, tmp_path)
    for load_id, rows in (("L1", [(1, "a")]), ("L2", [(2, "b")]), ("L3", [(3, "c")]), ("L4", [(3, "c")])):
        assert lake.run_load("d", text(spark, rows), "append", load_id) == "succeeded"
    assert [r["is_current"] for r in lake.snapshots("d").orderBy("load_id").collect()] == [False, False, True]  # L4 brought nothing
    with pytest.raises(ValueError, match="latest"):
        lake.rollback("d", "L3")
    for load_id, left in (("L4", [1, 2, 3]), ("L3", [1, 2]), ("L2", [1])):
        lake.rollback("d", load_id)
        assert ids(lake.current("d")) == left
    with pytest.raises(ValueError, match="parent"):
        lake.rollback("d", "L1")
    status = {r["load_id"]: r["status"] for r in lake.loads("d").collect()}
    assert status == {"L1": "succeeded", "L2": "rolled_back", "L3": "rolled_back", "L4": "rolled_back"}
    assert lake.run_load("d", text(spark, [(5, "e")]), "append", "L5") == "succeeded" and ids(lake.current("d")) == [1, 5]
    assert lake.run_load("d", text(spark, [(6, "f")]), "append", "L2") == "rolled_back"  # the same id does nothing


def test_pulls_lose_and_repeat_nothing(spark, tmp_path):
    lake = lake_of(spark, tmp_path)
    source = lambda n: spark.createDataFrame([(k // 2 + 1, f"r{k}") for k in range(n)], "at int, name string")
    assert lake.pull("d", "s", source(0), "at", "P0") == "empty"
    assert lake.pull("d", "s", source(5), "at", "P1", limit=3) == "succeeded"  # ties with the last come along
    whole, lake.run_load = lake.run_load, flows._dies
    with pytest.raises(InterruptedError):
        lake.pull("d", "s", source(6), "at", "P2", limit=2)
    lake.run_load = whole
    assert lake.connector_state("d").first()["cursor"] == "2"
    assert lake.pull("d", "s", source(12), "at", "P2", limit=9) == "succeeded"  # the range that was recorded
    assert sorted(r["name"] for r in lake.current("d").collect()) == [f"r{k}" for k in range(6)]
    assert lake.pull("d", "s", source(12), "at", "P2") == "succeeded"
    assert lake.pull("d", "s", source(12), "at", "P3") == "succeeded"
    assert lake.pull("d", "s", source(12), "at", "P4") == "empty"
    assert sorted(r["name"] for r in lake.current("d").collect()) == sorted(f"r{k}" for k in range(12))
    state = lake.connector_state("d").first()
    assert (state["cursor"], state["last_status"], state["last_load_id"], state["runs"]) == ("6", "empty", "P3", 5)
    assert lake.pull("d", "whole", source(2), None, "P5", mode="replace") == "succeeded" and lake.current("d").count() == 2


def test_malformed_lines_by_file_and_number(spark, tmp_path):
    path = tmp_path / "a.csv"
    lines = ["id,note", "1,x", "", '2,"a, b"', "3", "4,x,y", ' , ', '5,"say ""hi"", twice"']
    path.write_text("\n".join(lines) + "\n")
    got = [(r["line"], r["fields"]) for r in files.malformed_lines(spark, str(path), 2).orderBy("line").collect()]
    assert got == [(5, 1), (6, 3)]
    raw = files.read_delimited(spark, str(path), ["id", "note"])
    assert raw.count() == 5 and files.malformed_counts(raw).first()["malformed"] == 2
    lake = lake_of(spark, tmp_path)
    assert lake.load_files("d", [str(path)], "replace", "F1") == "quarantined"
    many = tmp_path / "b.csv"
    many.write_text("id,note\n" + "".join(f"{k},x\n" for k in range(60)) + "99\n")
    assert lake.load_files("d", [str(many)], "replace", "F2") == "succeeded" and lake.current("d").count() == 60
    assert '"line": 62' in lake.loads("d").filter("load_id = 'F2'").first()["checks"]


def test_large_files_are_split_and_heads_sniffed_by_tasks(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("id;note\n" + "".join(f"{k};{'y' * 40}\n" for k in range(40_000)))
    found = files.sniff_files(spark, [str(path)]).first()
    assert (found["delimiter"], found["header"]) == (";", ["id", "note"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = files.read_delimited(spark, str(path), ["id", "note"], ";")
        assert df.rdd.getNumPartitions() > 2 and df.count() == 40_000
        broken = tmp_path / "breaks.csv"
        broken.write_text('id,note\n1,"two\nlines"\n2,x\n')
        assert files.has_quoted_breaks(spark, str(broken)) and files.read_delimited(spark, str(broken), ["id", "note"]).count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# ---------------------------------------------------------------- cleaning


def test_counters_of_the_write_and_the_plan(spark, tmp_path):
    rows = [(" a ", "$1,000", "Yes"), ("n/a", "2", "no"), ("b", "oops", "true"), ("a", "$1,000", "yes"), (None, "", ""), ("c", "30%", "N"), ("d", "5", "Y")] + [("e", str(k), "y") for k in range(6)]
    df = spark.createDataFrame(rows, "name string, amount string, paid string")
    told = cleaning.write_cleaned(df, cleaning.CleaningActions(numbers=["amount"], booleans=["paid"]), f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert told == {"input_rows": 13, "trimmed_cells": 1, "standardised_nulls": 1, "converted_numbers": 3, "blanked_unparsed": 1, "converted_booleans": 11, "empty_rows": 1, "output_rows": out.count()}
    assert out.count() == 11 and dict(out.dtypes)["amount"] == "double"
    plan = {r["action"]: (r["affected"], r["columns"]) for r in cleaning.cleaning_plan(df, ["name", "amount", "paid?"]).collect()}
    assert plan == {"normalize_headers": (1, []), "trim_whitespace": (1, []), "standardize_nulls": (1, []), "parse_numbers": (3, ["amount"]), "normalize_booleans": (11, ["paid"]), "remove_empty_rows": (1, [])}
    assert cleaning.formatted_examples(df, ["amount"]).first()["examples"] == ["$1,000", "30%"]


# ---------------------------------------------------------------- contracts, links, reports


def test_probe_shuffles_no_cells(spark):
    df = spark.createDataFrame([(str(k), str(k % 3), None if k == 5 else f"x{k}") for k in range(200)], "id string, few string, gap string")
    got = {r["column"]: r for r in C.type_probe(df).collect()}
    assert (got["id"]["distinct"], got["few"]["distinct"], got["gap"]["distinct"]) == (200, None, None)
    assert [r["column"] for r in C.chosen_types(C.type_probe(df)).filter("candidate_key").collect()] == ["id"]
    counted = C._fits(df.select(F.col("few").alias("column"), F.col("id").alias("v")))
    plan = spark._jvm.PythonSQLUtils.explainString(counted._jdf.queryExecution(), "simple")
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "hashpartitioning(column" in exchanges[0]


def test_links_of_false_friends_go(spark):
    orders = spark.createDataFrame([(k, k % 50, k % 7) for k in range(400)], "order_id int, customer_id int, n int")
    customers = spark.createDataFrame([(k, f"n{k}") for k in range(50)], "customer_id int, name string")
    old = spark.createDataFrame([(k + 10_000, "x") for k in range(50)], "customer_id int, name string")
    got = links.verify_links({"orders": orders, "customers": customers, "old_customers": old, "gone": None}, [("orders", "order_id", "gone", "order_id"), ("orders", "nope", "customers", "customer_id")], {"gone": ["order_id"]})
    rows = {(r["from_table"], r["to_table"]): (r["declared"], r["status"], r["rate_a"]) for r in got.collect()}
    assert rows == {("orders", "customers"): (False, links.VERIFIED, 1.0), ("orders", "gone"): (True, links.BY_SCHEMA, None)}


def test_report_refuses_what_does_not_fit(spark):
    t = spark.createDataFrame([(1, "a@b.org", 2.5)], "order_id int, email string, amount double")
    for bad in ({"nope": report.TablePlan()}, {"t": report.TablePlan([])}, {"t": report.TablePlan(["amount", "amount"])}, {"t": report.TablePlan(["x"])}, {"t": report.TablePlan(analyses=("magic",))}, {"t": report.TablePlan(analyses=())}):
        with pytest.raises(report.PlanError):
            report.eda_report(spark, {"t": t}, plan=bad)
    rep = report.eda_report(spark, {"t": t})
    assert rep.overview.first()["status"] == "complete"
    assert {(r["column"], r["classification"]) for r in rep.sensitive.collect()} == {("order_id", "identifier"), ("email", "direct_identifier")}
    assert report.eda_report(spark, {"t": t, "u": None}).overview.first()["status"] == "partial"


def test_findings_over_three_tables(spark):
    orders = spark.createDataFrame([(k, k % 20, float(k % 13 + 1), ("open", "paid")[k % 2], START + dt.timedelta(days=k)) for k in range(240)], "order_id int, customer_id int, total_amount double, status string, order_date timestamp_ntz")
    customers = spark.createDataFrame([(k, f"c{k}", ("north", "south", "west")[k % 3], ("n", "s", "w")[k % 3]) for k in range(20)], "customer_id int, customer_name string, region string, area_code_kind string")
    notes = spark.createDataFrame([(k, None if k % 2 else "x") for k in range(40)], "note_id int, category string")
    got = findings.auto_insights(spark, {"orders": orders, "customers": customers, "notes": notes})
    rows = got.findings.orderBy("priority").collect()
    assert [r["priority"] for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0]["id"] == "orders.order_date.trend" and rows[0]["kind"] == "line"
    assert rows[1]["id"] == "orders.customer_id->customers.region" and rows[1]["cross"]
    assert not any(r["id"].endswith("area_code_kind") for r in rows)  # the same numbers again
    assert got.headline.count() == 3
    assert {r["id"] for r in rows if r["table"] == "notes"} == {"notes.quality"}
    few = findings.auto_insights(spark, {"customers": customers}, max_groups=2)
    assert {r["column"] for r in few.skipped.collect()} >= {"region", "customer_name"}


def test_catalogue_names_no_values(spark):
    t = spark.createDataFrame([(1, "x")], "user_id int, password string")
    rows = {r["column"]: r["role"] for r in catalog.column_table(spark, {"t": t}).collect()}
    assert rows == {"user_id": "identifier", "password": "credential"}
