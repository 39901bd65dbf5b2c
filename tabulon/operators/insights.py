"""Automatic findings: breakdowns, trends, rankings, distributions, key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import expr
from tabulon.operators import relational as R


def breakdown(df: DataFrame, measure: str, dim: str, op: str = "sum", top: int = 8) -> DataFrame:
    """``label, value, rows, share_pct``: the top values of ``dim`` and the others together."""
    v = R._numeric(df, measure)
    label = expr.strip(F.col(dim).cast("string"))
    g = df.filter(~expr.is_blank(F.col(dim)) & v.isNotNull()).groupBy(label.alias("label")).agg(F.sum(v).alias("total"), F.count(v).alias("rows"))
    value = F.col("total") if op == "sum" else F.col("total") / F.col("rows")
    g = g.withColumn("value", value)
    # Only the top values meet in one task; the others are what the sum of all leaves.
    best = g.orderBy(F.desc("value"), "label").limit(top)
    best = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "label")))
    first = best.select("place", "label", "total", "rows", F.lit(1).cast("long").alias("values"))
    sums = [F.sum("total").alias("total"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("values")]
    rest = g.join(F.broadcast(first.select(F.col("label").alias("shown"))), F.col("label") == F.col("shown"), "left_anti").agg(*sums).filter("values > 0")
    out = first.unionByName(rest.select(F.lit(top + 1).alias("place"), F.lit("Other").alias("label"), "total", "rows", "values"))
    value = F.col("total") if op == "sum" else F.col("total") / F.col("rows")
    share = F.round(F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy())) * 100, 2)
    return out.select("place", "label", F.round(value, 2).alias("value"), "rows", "values", share.alias("share_pct"))


def takeaway(parts: DataFrame) -> DataFrame:
    """One sentence on a breakdown: dominates, neck and neck, or leads."""
    top = parts.filter("place <= 2 and label <> 'Other'").agg(F.max_by("label", -F.col("place")).alias("leader"), F.max(F.when(F.col("place") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("place") == 2, F.col("value"))).alias("b"), F.max(F.when(F.col("place") == 1, F.col("share_pct"))).alias("share"))
    kind = F.when(F.col("share") >= 50, "dominates").when(F.col("a") < 1.1 * F.col("b"), "neck_and_neck").otherwise("leads")
    return top.select("leader", "share", kind.alias("takeaway"))


def trend(df: DataFrame, measure: str, date: str) -> DataFrame:
    """``period, value, rows`` by month."""
    t = F.col(date) if dict(df.dtypes)[date] in ("timestamp_ntz", "timestamp", "date") else expr.parse_date_unambiguous(F.col(date))
    v = R._numeric(df, measure)
    g = df.groupBy(expr.bucket_date(t, "month").alias("period")).agg(F.sum(v).alias("value"), F.count(v).alias("rows"))
    return g.filter("period is not null").select("period", F.round("value", 2).alias("value"), "rows")


def ranking(df: DataFrame, measure: str, entity: str, top: int = 10) -> DataFrame:
    """The top entities with their shares; empty if there are fewer than three."""
    g = df.filter(~expr.is_blank(F.col(entity))).groupBy(F.col(entity).cast("string").alias("entity")).agg(F.sum(R._numeric(df, measure)).alias("v")).filter("v is not null")
    best = g.orderBy(F.desc("v"), "entity").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("v"), "entity")))
    r = best.join(F.broadcast(g.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("all"))), F.lit(True))  # one row
    return r.filter("n >= 3").select("rank", "entity", F.round("v", 2).alias("value"), F.round(F.try_divide(F.col("v"), F.col("all")) * 100, 2).alias("share_pct"))


def distribution(df: DataFrame, measure: str, bins: int = 10) -> DataFrame:
    """``bin, low, high, rows``: equal-width bins, the last one closed; empty bins are listed."""
    v = df.select(R._numeric(df, measure).alias("v")).filter("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).filter("n >= 20 and hi > lo")
    ends = ends.withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    at = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    counts = v.join(F.broadcast(ends), F.lit(True)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    all_bins = ends.select("lo", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = all_bins.join(counts, "bin", "left")
    return out.select("bin", F.round(F.col("lo") + F.col("bin") * F.col("w"), 4).alias("low"), F.round(F.col("lo") + (F.col("bin") + 1) * F.col("w"), 4).alias("high"), F.coalesce("rows", F.lit(0)).alias("rows"))


def distribution_shape(df: DataFrame, measure: str) -> DataFrame:
    """Mean, median, skew label (15 % apart) and rows above twice the mean."""
    v = R._numeric(df, measure)
    middle = R.quantiles(df, {measure: v}, [0.5]).select(F.col("value").alias("median"))
    s = df.agg(F.avg(v).alias("mean"), F.count(v).alias("n")).join(F.broadcast(middle), F.lit(True), "left")  # one row each
    label = F.when(F.col("mean") > 1.15 * F.col("median"), "right_skewed").when(F.col("mean") < 0.85 * F.col("median"), "left_skewed").otherwise("balanced")
    above = df.select(v.alias("v")).join(F.broadcast(s), F.lit(True)).filter(F.col("v") > 2 * F.col("mean")).agg(F.count(F.lit(1)).alias("above_twice_mean"))
    return s.join(above, F.lit(True)).select("n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), label.alias("shape"), "above_twice_mean")


def quality_flags(df: DataFrame, columns: list[str], measures: list[str], least: float = 0.05) -> DataFrame:
    """Columns with at least ``least`` of their rows blank (measures: without a number)."""
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(R._numeric(df, c).isNull() if c in measures else expr.is_blank(F.col(c))).alias("missing")) for c in columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.array(*cells).alias("c"))
    return row.select("n", F.inline("c")).filter(F.col("missing") >= least * F.col("n")).select("column", "missing", F.round(F.col("missing") / F.col("n"), 4).alias("rate"))


def cross_table_breakdown(fact: DataFrame, key: str, dim: DataFrame, dim_key: str, measure: str, attributes: list[str]) -> DataFrame:
    """The measure by each attribute of a lookup table, with shares; null attribute: not found."""
    t = R.lookup_join_aggregate(fact, key, dim, dim_key, measure, attributes)
    share = F.round(F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy("attribute"))) * 100, 2)
    return t.select("attribute", "label", F.round("total", 2).alias("total"), "rows", share.alias("share_pct"))


def kpis(df: DataFrame, measure: str, dim: str, date: str) -> DataFrame:
    v = R._numeric(df, measure)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum(v), 2).alias("total"),
        F.round(F.avg(v), 4).alias("average"),
        F.count_distinct(F.col(dim)).alias("distinct_dim"),
        F.min(F.to_date(date)).alias("first_day"),
        F.max(F.to_date(date)).alias("last_day"),
    )


def dedupe_findings(found: DataFrame) -> DataFrame:
    """Drop findings of the same values on one table and kind; the rest in order of priority.

    ``found``: ``id, table, kind, values array<double>, cross boolean, table_rows``.
    """
    key = F.sha2(F.array_join(F.transform("values", lambda v: F.format_number(v, 4)), "|"), 256)
    scope = F.when(F.col("cross"), F.lit("*")).otherwise(F.concat_ws("|", "table", "kind"))
    order = F.when(F.col("kind") == "line", 0).when(F.col("kind") == "bar", 1).otherwise(2)
    one = found.withColumn("rn", F.row_number().over(Window.partitionBy(scope, key).orderBy("id"))).filter("rn = 1").drop("rn")
    by = [F.desc("table_rows"), order, F.desc("cross"), F.desc(F.size(F.array_distinct("values"))), F.col("id")]
    return one.withColumn("priority", F.row_number().over(Window.orderBy(*by)))
