"""Findings of the third review: each test failed before its fix."""

from pyspark.sql import functions as F

from tabulon.functions import expr
from tabulon.operators import contract as C
from tabulon.operators import cleaning, findings
from tabulon.operators import relational as R
from tabulon.sources import files


def test_insights_use_links_of_which_few_keys_meet(spark):
    orders = spark.createDataFrame([(k, k, float(k + 1)) for k in range(60)], "order_id int, customer_id int, total_amount double")
    customers = spark.createDataFrame([(k, ("north", "south", "west")[k % 3]) for k in range(10)], "customer_id int, region string")
    products = spark.createDataFrame([(-k - 1, f"b{k % 2}", 1.0) for k in range(10)], "customer_id int, brand string, unit_price double")
    got = findings.auto_insights(spark, {"orders": orders, "customers": customers, "products": products}).findings.filter("cross").collect()
    assert [(r["id"], r["labels"]) for r in got] == [("orders.customer_id->customers.region", ["north", "west", "south"])]
    assert got[0]["values"] == [22.0, 18.0, 15.0] and got[0]["takeaway"].endswith(" 50 orders rows had no matching customers row.")


def test_far_limits_of_pulls_gather_no_rows(spark):
    rows = spark.range(0, 900_000, 1, 4).select((F.col("id") * 7 % 450_000).alias("c"))
    got, end = files.extract_incremental(rows, "c", 9, 300_000)
    assert end.first()["cursor"] == 150_009 and got.count() == 300_000
    assert files.extract_incremental(rows, "c", 9, 1 << 30)[1].first()["cursor"] == 449_999
    assert files.extract_incremental(rows, "c", 450_000, 1 << 30)[1].first()["cursor"] is None
    plan = spark._jvm.PythonSQLUtils.explainString(end._jdf.queryExecution(), "simple")
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


CELLS = ["7", "+7", " -12\t", "9" * 30, "1.5", ".5", "1e400", "1e5", "$1,200", "(20.00)", "1,200", "yes", " No\n", "maybe", "2024-01-05", "2024-13-05", "2024-01-05 10:11", "1/5/2024", "1/5/99", "n/a", "-", "", None, "x9", "１２"]


def test_probe_counts_what_every_type_takes(spark):
    df = spark.createDataFrame([(c,) for c in CELLS], "v string")
    whole = df.select(*[F.count(expr.typed(F.col("v"), k, t)).alias(t or k) for k, t in C.LADDER]).first().asDict()
    got = C.type_probe(df, ["v"], keys=False).first().asDict()
    assert {k: got[k] for k in whole} == whole and got["present"] == len(CELLS) - 4
    plan = spark._jvm.PythonSQLUtils.explainString(df.select(expr.strip(F.col("v")))._jdf.queryExecution(), "simple")
    assert "regexp_replace" not in plan  # a pattern a cell and type was what the probe's time went to


def test_ranks_have_one_set_of_range_ends(spark):
    rows = spark.range(0, 200_000, 1, 8).select(F.lit("x").alias("by"), (F.col("id") * 7919 % 200_003).alias("value"), F.lit(1).alias("n"))
    plan = spark._jvm.PythonSQLUtils.explainString(R.running_totals(rows, "by", "value", "n")._jdf.queryExecution(), "simple")
    assert "percentile_approx" not in plan  # worked out twice, the ends may differ, and ranks with them


def test_formatted_numbers_by_their_looks(spark):
    want = {"7": 7.0, " -1.5\t": -1.5, "+.5": 0.5, "(USD 1,200.50)": -1200.5, "1.234,5 eur": 1234.5, "12 %": 12.0, "€ 3": 3.0, "- 4": -4.0, "(5)": -5.0, "$": None, "usd": None, "1,2,3": None, "x1": None, "": None, None: None}
    df = spark.createDataFrame([(c,) for c in want], "v string")
    got = {r["v"]: r["n"] for r in df.select("v", expr.parse_formatted_number(F.col("v")).alias("n")).collect()}
    assert got == want
    found = {r["column"]: (r["filled"], r["numeric"], r["formatted"]) for r in cleaning.text_column_probe(df).collect()}
    assert found == {"v": (13, 9, 6)}
