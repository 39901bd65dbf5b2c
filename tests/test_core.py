"""Row algebra, parsing, cleaning, contracts, loads, sources and streams on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulon.functions import expr
from tabulon.operators import catalog, cleaning, loads, marts, profile
from tabulon.operators import contract as C
from tabulon.operators import relational as R
from tabulon.sources import files
from tabulon.streaming import streams


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def text_table(spark, header, *data):
    return spark.createDataFrame([tuple(r) for r in data], ", ".join(f"`{h}` string" for h in header))


def test_groups_and_joins(spark):
    d = spark.createDataFrame([("HR", 100), ("HR", 200), ("ENG", 300), (None, 5)], "dept string, salary int")
    assert sorted(values(R.aggregate_rows(d, "dept", "salary", "sum"), "dept", "sum_salary")) == [("ENG", 300.0), ("HR", 300.0)]
    a = spark.createDataFrame([(1, "x"), (None, "y")], "id int, name string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "uid int, name string")
    assert R.inner_join(a, b, "id", "uid").count() == 2
    with pytest.raises(ValueError):
        R.inner_join(a, b.withColumn("uid", F.col("uid").cast("string")), "id", "uid")


def test_predicates(spark):
    t = text_table(spark, ["name", "amount", "day"], ("Acme", "9", "2026-01-01"), ("Beta", "10", "2026-02-01"), ("Gamma", "100", "2026-03-01"), ("Delta", None, None), ("Epsilon", "n/a", "not a date"))
    names = lambda *p: sorted(values(R.filter_rows(t, *p), "name"))
    assert names("amount", "gt", "9") == ["Beta", "Gamma"] and names("amount", "lt", "100") == ["Acme", "Beta"]
    assert names("day", "gte", "2026-02-01") == ["Beta", "Gamma"] and names("name", "eq", "acme") == ["Acme"] and names("name", "contains", "MM") == ["Gamma"]
    with pytest.raises(ValueError):
        names("name", "gt", "Acme")


def test_parsing(spark):
    t = text_table(spark, ["c"], ("2026-03-04",), ("03/04/2026",), ("25/12/2026",), ("7",))
    days = [r and r.date() for r in values(t.select(expr.parse_date_unambiguous(F.col("c")).alias("d")), "d")]
    assert days == [dt.date(2026, 3, 4), None, dt.date(2026, 12, 25), None]
    t = text_table(spark, ["c"], ("$1,234.50",), ("USD 954",), ("(20.00)",), ("12%",), ("1.234,5",), ("pending",), ("12d",))
    assert values(t.select(expr.parse_formatted_number(F.col("c")).alias("v")), "v") == [1234.5, 954.0, -20.0, 12.0, 1234.5, None, None]
    assert spark.range(1).select(expr.ulid_timestamp_ms(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"))).first()[0] == 1469922850259


def test_contract_and_gate(spark):
    cols = ["flag", "count", "ratio", "money", "iso", "us", "stamp", "text", "empty"]
    t = text_table(spark, cols, ("true", "1", "1.5", "$1,000.25", "2024-01-02", "1/2/2024", "2024-01-02 10:00:00", "a", ""), ("no", "2", "2", "(20)", "2024-02-03", "12/31/2024", "2024-01-02 11:00:00", "b", "n/a"), ("yes", "3", "3.25", "$15", "2024-03-04", "2/3/2024", "2024-01-02 12:00:00", "c", None))
    got = {c.name: (c.kind, c.transform) for c in C.infer_contract(t)}
    assert got == {"flag": ("bool", None), "count": ("int", None), "ratio": ("float", None), "money": ("float", "currency"), "iso": ("date", None), "us": ("date", "date_us"), "stamp": ("timestamp", None), "text": ("str", None), "empty": ("str", None)}
    assert values(C.typed_rows(t, C.infer_contract(t), "L").orderBy("count"), "money") == [1000.25, -20.0, 15.0]
    t = text_table(spark, ["v"], *[("1",)] * 98, *[("oops",)] * 2)
    assert C.infer_contract(t, 0.0)[0].kind == "str" and C.infer_contract(t, 0.05)[0].kind == "float"


def test_loads(spark, tmp_path):
    lake = loads.Lake(spark, f"file://{tmp_path}")
    one = text_table(spark, ["id", "name", "amount"], ("1", "a", "10"), ("2", "b", "20"))
    two = text_table(spark, ["id", "name", "amount", "region"], ("2", "b", "21", "west"), ("3", "c", "30", "east"))
    assert lake.run_load("items", one, "replace", "L1", ["id"], history=True) == "succeeded"
    assert lake.run_load("items", two, "merge", "L2", ["id"], history=True) == "succeeded"
    assert lake.run_load("items", two, "merge", "L2", ["id"]) == "succeeded"
    assert sorted(values(lake.current("items"), "id", "amount", "region")) == [(1, 10, None), (2, 21, "west"), (3, 30, "east")]
    assert lake.history("items").count() == 4
    lake.run_load("items", two, "append", "L3")
    assert lake.current("items").count() == 3
    twice = text_table(spark, ["id", "name", "amount"], ("1", "a", "10"), ("1", "b", "20"))
    assert lake.run_load("items", twice, "merge", "L4", ["id"]) == "quarantined"
    lake.rollback("items", "L3")
    assert values(lake.snapshots("items").filter("is_current"), "load_id") and lake.current("items").count() == 3


def test_cleaning(spark):
    t = text_table(spark, ["n", "a"], (" A ", "1"), ("A", "1"), ("N/A", "2"), ("", ""), ("B", "3"))
    p = cleaning.clean_preview(t).first()
    assert (p["rows"], p["empty_rows"], p["duplicate_rows"], p["standardised_nulls"]) == (5, 1, 1, 1)
    assert cleaning.apply_cleaning(t, cleaning.CleaningActions()).count() == 3
    assert cleaning.clean_headers(["Amount ($)", "amount", "", "x" * 100])[1:] == ["amount_2", "column_3", "x" * 64]


def test_profile_and_catalog(spark):
    t = spark.createDataFrame([(1.0,)] * 39 + [(100.0,)], "metric double")
    r = profile.iqr_outliers(t, ["metric"]).first()
    assert (r["outliers"], r["rate"], r["shape"]) == (1, 0.025, "strongly_skewed_or_heavy_tailed")
    assert profile.correlations(t.withColumn("k", F.lit(1)), ["metric", "k"]).count() == 0
    names = ["customer_id", "product_name", "notes", "year", "amount"]
    t = spark.createDataFrame([(1, "p", "n", 2024, 1.0)], "customer_id int, product_name string, notes string, year int, amount double")
    assert dict(values(catalog.column_table(spark, {"t": t}), "column", "role")) == dict(zip(names, ["identifier", "categorical", "free_text", "temporal_component", "numeric_measure"], strict=True))


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name;city\nJosé;München\n\nA;B;C\n\"x \"\"y\";z\n".encode("cp1252"))
    found = files.sniff_files(spark, [f"file://{tmp_path}/a.csv"]).first()
    assert (found["encoding"], found["delimiter"], found["header"]) == ("cp1252", ";", ["name", "city"])
    good, bad = files.split_malformed(files.read_delimited(spark, f"file://{tmp_path}/a.csv", found["header"], ";", "cp1252"))
    assert sorted(values(good, "name", "city")) == [("José", "München"), ('x "y', "z")] and bad.count() == 1
    assert files.read_event_log(spark, f"file://{tmp_path}/none").count() == 0


def test_incremental_takes_ties(spark):
    t = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 3), (5, None)], "id int, c int")
    got, end = files.extract_incremental(t, "c", None, 2)
    assert sorted(values(got, "id")) == [1, 2, 3] and end.first()["cursor"] == 2


def test_limits_and_runs(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, k, base + dt.timedelta(seconds=s), "x", 1.0) for k, s in enumerate([0, 1, 2, 11, 12])], "user_id long, event_id long, ts timestamp, event_type string, value double")
    want = [True, True, False, True, True]
    assert [r["admitted"] for r in streams.rate_limit_audit(e, 2, 10).orderBy("event_id").collect()] == want
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = streams.rate_limit_stream(live, 2, 10).writeStream.format("memory").queryName("admitted").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(90)
    assert [r["admitted"] for r in spark.table("admitted").orderBy("event_id").collect()] == want
    sub = spark.range(1).select(marts.subsequence(F.array(F.lit("a"), F.lit("c")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("x"), marts.subsequence(F.array(F.lit("c"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))).alias("y")).first()
    assert (sub["x"], sub["y"]) == (True, False)


def test_every_core_query_has_columns_and_rows(spark):
    from tabulon.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.queries()["flagship_monthly_revenue"](spark, "/root/testdata/sf0.001").count() == 25


def test_probe_of_an_empty_table_and_odd_names(spark):
    t = text_table(spark, ["a.b", "rows"], ("1", "x"), (None, "y"))
    assert [(c.name, c.kind, c.nullable) for c in C.infer_contract(t)] == [("a.b", "int", True), ("rows", "str", False)]
    assert [c.kind for c in C.infer_contract(t.limit(0))] == ["str", "str"]


def test_ledger_lines_and_files(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"load_id": "a", "duration_ms": 5, "counts": {"rows_in": 2}}\n{"load_id": "b", "duration_ms": "x"}\n{"project_id": "p"}\n')
    got = files.read_load_ledger(spark, f"file://{tmp_path}/l.json", lines=True)
    assert sorted(values(got, "load_id", "duration_ms", "rows_in")) == [("a", 5, 2), ("b", None, None)]
    assert values(files.read_load_ledger(spark, f"file://{tmp_path}/l.json"), "load_id") == ["a"]


def test_streams_agree_with_batches(spark):
    from tabulon.plans import flows

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    both = lambda df: sorted(map(tuple, df.collect()))
    assert both(flows.stream_rate_limit(spark, sf)) == both(streams.rate_limit_audit(events, 2, 86_400.0))
    batch = streams.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.to_date("start"))
    assert both(flows.stream_daily_counts(spark, sf)) == both(batch)


def test_grid_and_compaction(spark, tmp_path):
    grid = spark.createDataFrame([(0, ["id", "name"]), (1, ["1"]), (2, ["2", "b", "more"])], "n int, cells array<string>")
    assert sorted(values(files.sheet_snapshot(grid, "n", "cells", ["id", "name"]), "id", "name")) == [("1", ""), ("2", "b")]
    lake = loads.Lake(spark, f"file://{tmp_path}")
    lake.run_load("t", spark.range(40).selectExpr("cast(id as string) id").repartition(4), "replace", "L1", ["id"])
    assert lake.compact("t", "C1", min_files=2) and not lake.compact("t", "C2", min_files=2)
    assert lake.current("t").count() == 40 and lake.expired().count() == 0


def test_sniffing_reads_the_head_of_large_files(spark, tmp_path):
    (tmp_path / "large.csv").write_text("a;b\n" + "1;x\n" * 1_100_000)
    (tmp_path / "small.csv").write_text("c,d\n1,2\n")
    found = {r["path"].rpartition("/")[2]: (r["delimiter"], r["header"]) for r in files.sniff_files(spark, [str(tmp_path)]).collect()}
    assert found == {"large.csv": (";", ["a", "b"]), "small.csv": (",", ["c", "d"])}
