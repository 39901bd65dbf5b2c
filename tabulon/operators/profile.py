"""Profiling: missing values, distributions, tails, categories, time, correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import expr
from tabulon.operators import relational as R


def long_form(df: DataFrame, columns: list[str], value: str = "value") -> DataFrame:
    """``column, value``: the columns as text under one another."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(value)) for c in columns])))


def unpivot_row(row: DataFrame, parts: list[tuple[str, list[tuple[str, Column]]]], label: str = "column") -> DataFrame:
    """One aggregated row as one row per label."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias(label), *[c.alias(k) for k, c in cells]) for n, cells in parts])))


Parts = list[tuple[str, list[tuple[str, Column]]]]


def _missing_cells(df: DataFrame, columns: list[str]) -> tuple[list[Column], Parts]:
    """Aggregates of missing values, and how their row is told by column."""
    text = {c for c, t in df.dtypes if t == "string"}
    q = lambda c: F.col(f"`{c}`")
    cells = [F.count(F.lit(1)).alias("n"), *[F.count_if(q(c).isNull() | (q(c) == "") if c in text else q(c).isNull()).alias(f"m{k}") for k, c in enumerate(columns)]]
    rate = lambda k: F.round(F.coalesce(F.try_divide(F.col(f"m{k}"), F.col("n")), F.lit(0.0)), 6)
    return cells, [(c, [("missing", F.col(f"m{k}")), ("rate", rate(k))]) for k, c in enumerate(columns)]


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, missing, rate``; missing is null or empty text. One pass."""
    cells, parts = _missing_cells(df, columns or df.columns)
    return unpivot_row(df.agg(*cells), parts)


def _moment_cells(df: DataFrame, columns: list[str], digits: int | None) -> tuple[list[Column], Parts]:
    """Aggregates of numbers, and how their row is told by column."""
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    cells, parts = [], []
    for k, c in enumerate(columns):
        v = R._numeric(df, c)
        calls = {
            "count": F.count(v),
            "invalid": F.count_if(F.col(c).isNotNull() & v.isNull()),
            "min": F.min(v),
            "mean": F.avg(v),
            "max": F.max(v),
            "std": F.stddev_pop(v),
            "m3": F.skewness(v),
            "zeros": F.count_if(v == 0),
        }
        cells += [x.alias(f"{n}{k}") for n, x in calls.items()]
        skew = F.when((F.col(f"count{k}") > 2) & (F.col(f"std{k}") > 0), F.round(finite_or_null(F.col(f"m3{k}")), 4))
        plain = [(n, F.col(f"{n}{k}")) for n in ("count", "invalid", "zeros")]
        parts.append((c, [*plain, *[(n, shown(F.col(f"{n}{k}"))) for n in ("min", "mean", "max", "std")], ("skewness", skew)]))
    return cells, parts


def _with_quartiles(df: DataFrame, columns: list[str], digits: int | None, moments: DataFrame) -> DataFrame:
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    q = R.quantiles(df, {c: R._numeric(df, c).cast("double") for c in columns}, list(quarters.values()))
    q = q.groupBy(F.col("column").alias("of")).agg(*[shown(F.max(F.when(F.col("share") == s, F.col("value")))).alias(n) for n, s in quarters.items()])
    both = moments.join(q, F.col("column") == F.col("of"), "left")  # one row a column
    return both.select("column", "count", "invalid", "zeros", "min", "q1", "median", "mean", "q3", "max", "std", "skewness")


def numeric_summary(df: DataFrame, columns: list[str], digits: int | None = 4) -> DataFrame:
    """Count, invalid, quartiles, moments (population) and zeros of each column; rounded to ``digits`` unless None.

    Quartiles are exact and come from ranks of the distinct values, all else
    from one pass.
    """
    cells, parts = _moment_cells(df, columns, digits)
    return _with_quartiles(df, columns, digits, unpivot_row(df.agg(*cells), parts))


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def iqr_outliers(df: DataFrame, columns: list[str], least: int = 30) -> DataFrame:
    """Values beyond 1.5 IQR of the quartiles and a label of the tails; needs ``least`` values."""
    return tails(df, columns, numeric_summary(df, columns, digits=None), least)


def tails(df: DataFrame, columns: list[str], summary: DataFrame, least: int = 30) -> DataFrame:
    """`iqr_outliers` by an unrounded `numeric_summary` that is there already."""
    q = summary.select("column", "count", "q1", "q3", "skewness")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), R._numeric(df, c).alias("v")) for c in columns])
    span = F.col("q3") - F.col("q1")
    out = F.count_if((F.col("v") < F.col("q1") - 1.5 * span) | (F.col("v") > F.col("q3") + 1.5 * span))
    s = df.select(F.inline(pairs)).filter("v is not null").join(F.broadcast(q), "column").groupBy("column").agg(F.first("count").alias("count"), out.alias("found"), F.first("skewness").alias("skewness"))
    enough = F.col("count") >= least
    rate = F.round(F.col("found") / F.col("count"), 6)
    heavy = (F.abs(F.coalesce("skewness", F.lit(0.0))) >= 1) | (rate >= 0.1)
    shape = F.when(~enough, "insufficient_sample").when(heavy, "strongly_skewed_or_heavy_tailed").when(F.col("found") > 0, "some_tail_values").otherwise("no_iqr_tail_flags")
    return s.select("column", "count", F.when(enough, F.col("found")).alias("outliers"), F.when(enough, rate).alias("rate"), shape.alias("shape"))


def categorical_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, non_null, distinct, high_cardinality, top``; top is ``value=count``, five at most."""
    counts = long_form(df, columns).filter("value is not null and value <> ''").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("distinct"))
    top = counts.withColumn("r", rank).filter("r <= 5").groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value", "n"))), lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), ";").alias("top"))
    high = (F.col("non_null") >= 50) & (F.col("distinct") / F.col("non_null") > 0.5)
    return totals.join(top, "column").select("column", "non_null", "distinct", high.alias("high_cardinality"), "top")


def _days(df: DataFrame, column: str) -> DataFrame:
    """``d, given, n``: rows by day; a given cell that is no date has no day."""
    t = F.col(column) if dict(df.dtypes)[column] in ("timestamp_ntz", "timestamp", "date") else expr.parse_datetime(F.col(column))
    given = ~expr.is_blank(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column).isNotNull()
    return df.select(F.to_date(t).alias("d"), given.alias("given")).groupBy("d", "given").agg(F.count(F.lit(1)).alias("n"))


def _periods(days: DataFrame) -> DataFrame:
    """``period, n`` and figures of the whole: months if the span is over 92 days, else days."""
    ends = days.agg(F.min("d").alias("first"), F.max("d").alias("last"), F.coalesce(F.sum(F.when(F.col("d").isNotNull(), F.col("n"))), F.lit(0)).alias("parsed"), F.coalesce(F.sum(F.when(F.col("given"), F.col("n"))), F.lit(0)).alias("given_rows"))
    ends = ends.filter("parsed >= 0.8 * given_rows and parsed > 0").withColumns({"span_days": F.datediff("last", "first"), "invalid": F.col("given_rows") - F.col("parsed")})
    both = days.filter("d is not null").join(F.broadcast(ends), F.lit(True))  # one row
    period = F.when(F.col("span_days") > 92, F.date_format("d", "yyyy-MM")).otherwise(F.date_format("d", "yyyy-MM-dd"))
    return both.groupBy(period.alias("period")).agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("first", "last", "span_days", "parsed", "invalid")])


def time_summary(df: DataFrame, column: str) -> DataFrame:
    """Span and busiest and quietest period of a time column: months if over 92 days, else days."""
    whole = ("first", "last", "span_days", "parsed", "invalid")
    return _periods(_days(df, column)).groupBy(*whole).agg(
        F.count(F.lit(1)).alias("periods"),
        F.min_by("period", F.struct((-F.col("n")).alias("n"), "period")).alias("busiest"),
        F.max("n").alias("busiest_rows"),
        F.min_by("period", F.struct("n", "period")).alias("quietest"),
    )


def time_series(df: DataFrame, column: str, last: int = 120) -> DataFrame:
    """``period, n``: rows of the last ``last`` periods that have any."""
    return _periods(_days(df, column)).select("period", "n").orderBy(F.desc("period")).limit(last)


def _pair_cells(df: DataFrame, columns: list[str]) -> tuple[list[Column], Parts]:
    """Aggregates of pairs of columns, and how their row is told by pair."""
    cells, parts = [], []
    for k, (a, b) in enumerate(combinations(columns, 2)):
        x, y = R._numeric(df, a), R._numeric(df, b)
        ok = x.isNotNull() & y.isNotNull()
        x, y = F.when(ok, x), F.when(ok, y)
        cells += [F.count(x).alias(f"n{k}"), F.covar_pop(x, y).alias(f"c{k}"), F.stddev_pop(x).alias(f"x{k}"), F.stddev_pop(y).alias(f"y{k}")]
        r = F.round(F.try_divide(F.col(f"c{k}"), F.col(f"x{k}") * F.col(f"y{k}")), 6)
        parts.append((a, [("other", F.lit(b)), ("n", F.col(f"n{k}")), ("r", F.when(F.col(f"n{k}") >= 3, r))]))
    return cells, parts


def correlations(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """Pearson's r of each pair of columns over rows that hold both; constants have none. The ``top`` strongest, by default ten."""
    cells, parts = _pair_cells(df, columns)
    return _strongest(unpivot_row(df.agg(*cells), parts), top)


def _strongest(pairs: DataFrame, top: int) -> DataFrame:
    return pairs.filter("r is not null").orderBy(F.desc(F.abs("r")), "column", "other").limit(top)


def missingness_patterns(df: DataFrame, targets: list[str], groups: list[str]) -> DataFrame:
    """For each target, the group column whose groups differ most in its missing rate (by half or more)."""
    miss = F.array(*[F.struct(F.lit(t).alias("target"), F.when(expr.is_blank(F.col(t)), 1).otherwise(0).alias("m")) for t in targets])
    keys = F.array(*[F.struct(F.lit(g).alias("group_col"), F.col(g).cast("string").alias("value")) for g in groups])
    long = df.select(miss.alias("ms"), keys.alias("gs")).select("ms", F.inline("gs")).filter("value is not null").select("group_col", "value", F.inline("ms"))
    g = long.groupBy("target", "group_col", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"))
    s = g.withColumn("rate", F.col("m") / F.col("n")).groupBy("target", "group_col").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("m").alias("missing"),
        F.sum("n").alias("rows"),
        (F.max(F.when(F.col("n") >= 5, F.col("rate"))) - F.min(F.when(F.col("n") >= 5, F.col("rate")))).alias("strength"),
    )
    s = s.filter("k between 2 and 10 and missing >= 10 and missing >= 0.01 * rows and strength >= 0.5 and group_col <> target")
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("strength"), "group_col"))
    return s.withColumn("rank", rank).filter("rank = 1").select("target", "group_col", F.round("strength", 4).alias("strength"))


def findings(df: DataFrame, numeric: list[str], columns: list[str] | None = None) -> DataFrame:
    """Sentences on missing values, duplicates, tails and strong correlations."""
    return told(missingness(df, columns), R.duplicate_rows(df, columns), iqr_outliers(df, numeric), correlations(df, numeric))


def told(missing: DataFrame, duplicates: DataFrame, outliers: DataFrame | None, pairs: DataFrame | None) -> DataFrame:
    """`findings` of sections that are there already."""
    m = missing.filter("missing > 0").orderBy(F.desc("missing"), "column").limit(3)
    out = m.select(F.lit("missing").alias("kind"), F.format_string("%s is missing in %d rows", "column", "missing").alias("finding"))
    out = out.unionByName(duplicates.filter("duplicate_rows > 0").select(F.lit("duplicates").alias("kind"), F.format_string("%d rows repeat another", "duplicate_rows").alias("finding")))
    if outliers is not None:
        out = out.unionByName(outliers.filter("outliers > 0").select(F.lit("tails").alias("kind"), F.format_string("%s has %d values in its tails", "column", "outliers").alias("finding")))
    if pairs is not None:
        out = out.unionByName(pairs.filter("abs(r) >= 0.8").select(F.lit("correlation").alias("kind"), F.format_string("%s and %s move together", "column", "other").alias("finding")))
    return out
