"""Row algebra: predicates, projection, joins, grouping, ranking, set operations.

All operators return DataFrames; they are lazy, but for the ends of ranges in
`running_totals`. Ties are broken by an explicit
column, since a scan has no order on a cluster.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon import session
from tabulon.functions import expr

ORDERED = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
COMPARE = {"eq": "__eq__", "neq": "__ne__"} | ORDERED


# ---------------------------------------------------------------- rows and columns


def filter_where(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.filter(condition)


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """The requested columns that exist."""
    return df.select([c for c in columns if c in df.columns])


def select_columns(df: DataFrame, columns: list[str], limit: int = 25) -> DataFrame:
    """Strict projection of the first ``limit`` rows, in no order; an unknown column raises."""
    if unknown := [c for c in columns if c not in df.columns]:
        raise ValueError(f"unknown columns: {unknown}")
    return df.select(*columns).limit(limit)


def _literal_date(value: object):
    text = str(value).strip()
    m = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})(?:[T ]\d{2}:\d{2}(?::\d{2})?)?", text)
    return text.replace("T", " ") if m else None


def predicate(column: str, op: str, value: object = None) -> Column:
    """One of eleven predicates; how values compare is chosen once, by ``value``.

    Numbers compare as numbers and text that is no number never matches; dates
    compare in time; other text is equal or not without regard to case, where
    null counts as empty, so ``neq`` keeps nulls.
    """
    c = F.col(column)
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    if op in ("is_null", "not_null"):
        return expr.is_blank(c) if op == "is_null" else ~expr.is_blank(c)
    if op in ("contains", "starts_with", "ends_with"):
        call = {"contains": text.contains, "starts_with": text.startswith, "ends_with": text.endswith}[op]
        return call(str(value).lower())
    if op not in COMPARE:
        raise ValueError(f"unknown operator {op!r}")
    plain = str(value).replace(",", "").strip()
    if not isinstance(value, bool) and re.fullmatch(expr.PLAIN_NUMBER, plain):
        return F.coalesce(getattr(expr.number(c), COMPARE[op])(float(plain)), F.lit(False))
    if (day := _literal_date(value)) is not None:
        return F.coalesce(getattr(_as_time(c), COMPARE[op])(F.lit(day).cast("timestamp_ntz")), F.lit(False))
    if op in ORDERED:
        raise ValueError(f"text cannot be ordered: {value!r}")
    return getattr(text, COMPARE[op])(str(value).lower())


def _as_time(c: Column) -> Column:
    return expr.parse_date_unambiguous(c)


def filter_rows(df: DataFrame, column: str, op: str, value: object = None) -> DataFrame:
    """`predicate` as a filter; typed time columns are compared as they are, so it reaches the scan."""
    if column not in df.columns:
        raise ValueError(f"unknown column: {column}")
    kind = dict(df.dtypes)[column]
    if kind in ("timestamp_ntz", "timestamp", "date") and op in COMPARE and (day := _literal_date(value)):
        return df.filter(getattr(F.col(column), COMPARE[op])(F.lit(day).cast(kind)))
    plain = str(value).replace(",", "").strip()
    if kind in ("int", "bigint", "smallint", "float", "double") and op in COMPARE and re.fullmatch(expr.PLAIN_NUMBER, plain):
        return df.filter(getattr(F.col(column), COMPARE[op])(float(plain)))
    return df.filter(predicate(column, op, value))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def guard_size(df: DataFrame, most: int) -> DataFrame:
    """``df``, after a check that it has at most ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


# ---------------------------------------------------------------- joins


def inner_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, prefix: str = "right.") -> DataFrame:
    """Equi-join in which null keys match null keys; the right key is dropped.

    Columns of the right side whose name is taken get ``prefix``. Which side is
    broadcast, if any, is Spark's choice by size.
    """
    text = {"string", "varchar"}
    if (dict(left.dtypes)[left_on] in text) != (dict(right.dtypes)[right_on] in text):
        raise ValueError("a text key cannot be joined to a key of another type")
    names = {c: f"{prefix}{c}" if c in left.columns else c for c in right.columns if c != right_on}
    r = right.select(F.col(f"`{right_on}`").alias("__key"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return left.join(r, left[left_on].eqNullSafe(r["__key"])).drop("__key")


def join_sources(left: DataFrame, right: DataFrame, left_on: str, right_on: str, right_name: str) -> DataFrame:
    return inner_join(left, right, left_on, right_on, f"{right_name}_")


def left_join_latest(facts: DataFrame, events: DataFrame, keys: list[str], order: str, keep: list[str]) -> DataFrame:
    """``facts`` with the columns ``keep`` of the latest event of each key."""
    return facts.join(latest_per_key(events, keys, order, keep), keys, "left")


def latest_per_key(df: DataFrame, keys: list[str], order: str, keep: list[str]) -> DataFrame:
    best = F.max(F.struct(order, *[c for c in keep if c != order])).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in keep])


def lookup_join_aggregate(fact: DataFrame, key: str, dim: DataFrame, dim_key: str, measure: str, attributes: list[str], last_by: str | None = None) -> DataFrame:
    """``attribute, label, total, rows``: the measure by each attribute of a lookup table.

    Keys compare as trimmed text and null keys match nothing; of dimension rows
    with the same key the last by ``last_by`` counts. The attribute ``None``
    holds the rows whose key was not found.
    """
    d = dim.filter(F.col(dim_key).isNotNull()).withColumn("__k", expr.strip(F.col(dim_key).cast("string")))
    d = d.groupBy("__k").agg(F.max_by(F.struct(*attributes), F.struct(*[last_by or dim_key, *attributes])).alias("__d"))
    f = fact.select(expr.strip(F.col(key).cast("string")).alias("__k"), expr.number(F.col(measure)).alias("__v"))
    both = f.groupBy("__k").agg(F.sum("__v").alias("total"), F.count("__v").alias("rows"), F.count(F.lit(1)).alias("all")).join(d, "__k", "left")
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), expr.strip(F.col(f"__d.{a}").cast("string")).alias("label")) for a in attributes])
    none = F.array(F.struct(F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("label")))
    long = both.withColumn("__p", F.explode(F.when(F.col("__d").isNull(), none).otherwise(pairs)))
    long = long.select("__p.attribute", "__p.label", "total", "rows", "all")
    long = long.filter(F.col("attribute").isNull() | ~expr.is_blank(F.col("label")))
    rows = F.sum(F.when(F.col("attribute").isNull(), F.col("all")).otherwise(F.col("rows")))
    return long.groupBy("attribute", "label").agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), rows.alias("rows"))


def classify_merge(incoming: DataFrame, existing: DataFrame, keys: list[str], hash_col: str = "__row_hash") -> DataFrame:
    """``incoming`` with ``__change``: insert, update or unchanged.

    The existing side is reduced to one row per key, so repeated keys there do
    not multiply rows.
    """
    old = existing.groupBy(*[F.col(k).alias(f"__old_{k}") for k in keys]).agg(F.collect_set(hash_col).alias("__hashes"), F.count(F.lit(1)).alias("__n"))
    on = reduce(lambda a, b: a & b, [incoming[k].eqNullSafe(old[f"__old_{k}"]) for k in keys])
    change = F.when(F.col("__n").isNull(), "insert").when(F.array_contains("__hashes", F.col(hash_col)), "unchanged").otherwise("update")
    return incoming.join(old, on, "left").withColumn("__change", change).select(*incoming.columns, "__change")


def append_dedup(incoming: DataFrame, existing: DataFrame, hash_col: str = "__row_hash", dedupe_batch: bool = False) -> DataFrame:
    """The incoming rows that the table lacks; duplicates within the batch stay unless asked otherwise."""
    rows = incoming.dropDuplicates([hash_col]) if dedupe_batch else incoming
    return rows.join(existing.select(hash_col), hash_col, "left_anti").select(*incoming.columns)


def join_coverage(a: DataFrame, col_a: str, b: DataFrame, col_b: str) -> DataFrame:
    """Distinct and matched keys and rows of both sides, in one row."""

    def counts(df: DataFrame, c: str, n: str) -> DataFrame:
        key = F.trim(F.col(c).cast("string"))
        return df.filter(F.col(c).isNotNull()).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias(n))

    both = counts(a, col_a, "na").join(counts(b, col_b, "nb"), "k", "full_outer")
    match = F.col("na").isNotNull() & F.col("nb").isNotNull()
    out = both.agg(
        F.count_if(match).alias("overlap"),
        F.count("na").alias("distinct_a"),
        F.count("nb").alias("distinct_b"),
        F.coalesce(F.sum("na"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum("nb"), F.lit(0)).alias("rows_b"),
        F.coalesce(F.sum(F.when(match, F.col("na"))), F.lit(0)).alias("matched_a"),
        F.coalesce(F.sum(F.when(match, F.col("nb"))), F.lit(0)).alias("matched_b"),
    )
    rate = lambda m, n: F.round(F.coalesce(F.try_divide(F.col(m), F.col(n)), F.lit(0.0)), 6)
    return out.withColumns({"rate_a": rate("matched_a", "rows_a"), "rate_b": rate("matched_b", "rows_b")})


# ---------------------------------------------------------------- aggregation


def aggregate(c: Column, op: str) -> Column:
    """count counts rows; sum and avg of nothing are 0; min and max of nothing are null."""
    value = expr.number(c)
    if op == "count":
        return F.count(F.lit(1))
    if op in ("sum", "avg"):
        return F.coalesce((F.sum if op == "sum" else F.avg)(value), F.lit(0.0))
    if op in ("min", "max"):
        return (F.min if op == "min" else F.max)(value)
    raise ValueError(f"unknown aggregate {op!r}")


def _numeric(df: DataFrame, column: str) -> Column:
    """A numeric column as a finite double; text is parsed."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    return expr.finite(c.cast("double")) if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else expr.number(c)


def group_aggregate(df: DataFrame, key: str | list[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """Group by ``key`` (null keys dropped); ``measures`` maps output to (column, op)."""
    keys = [key] if isinstance(key, str) else key
    out = []
    for name, (column, op) in measures.items():
        value = F.lit(1.0) if op == "count" else _numeric(df, column)
        call = {"count": F.count(F.lit(1)), "sum": F.coalesce(F.sum(value), F.lit(0.0)), "avg": F.coalesce(F.avg(value), F.lit(0.0)), "min": F.min(value), "max": F.max(value)}
        out.append(call[op].alias(name))
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(*out)


def aggregate_rows(df: DataFrame, group_by: str, value: str, op: str) -> DataFrame:
    return group_aggregate(df, group_by, {f"{op}_{value}": (value, op)})


def max_row(df: DataFrame, column: str, tie: str, lowest: bool = False) -> DataFrame:
    """The one row with the extreme value; the least ``tie`` wins."""
    v = _numeric(df, column)
    order = F.struct((v if lowest else -v).alias("v"), F.col(tie).alias("t"))
    best = df.filter(v.isNotNull()).agg(F.min_by(F.struct(*df.columns), order).alias("r"))
    return best.filter("r is not null").select("r.*")


def count_distinct(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    call = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[call(c).alias(c) for c in columns])


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    groups = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def running_totals(counts: DataFrame, by: str, value: str, n: str, ranges: int = 64, wanted: Callable[[Column], list[Column]] | None = None) -> DataFrame:
    """``counts`` with ``before``, the sum of ``n`` over smaller values of the same ``by``, and ``total``, that over all.

    Values are cut into ranges at their quantiles; ranks run within a range and
    start at the sums of the ranges before, so no task sorts all values. The
    ends of the ranges are one small row for each ``by``. Where only the rows at
    some places are ``wanted`` (indexes, given the total), ranges that hold none
    of them are left out before anything is sorted.
    """
    shares = [k / ranges for k in range(1, ranges)]
    ends = counts.groupBy(by).agg(F.percentile_approx(value, shares).alias("__ends"), F.sum(n).alias("total"))
    # Written, since the approximate ends may come out differently each time and both uses below must have the same.
    path = session.work_path(counts.sparkSession, "range-ends")
    ends.write.parquet(path)
    ends = counts.sparkSession.read.schema(ends.schema).parquet(path)
    placed = counts.join(F.broadcast(ends), by).withColumn("__range", F.size(F.filter("__ends", lambda e: e < F.col(value)))).drop("__ends")
    earlier = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(by, "__range").agg(F.sum(n).alias("__sum"))
    sums = sums.select(by, "__range", "__sum", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    within = Window.partitionBy(by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(sums), [by, "__range"])
    if wanted is not None:
        held = [(at >= F.col("__start")) & (at < F.col("__start") + F.col("__sum")) for at in wanted(F.col("total"))]
        out = out.filter(reduce(lambda a, b: a | b, held))
    return out.withColumn("before", F.col("__start") + F.coalesce(F.sum(n).over(within), F.lit(0))).drop("__range", "__start", "__sum")


def ranked_values(df: DataFrame, columns: dict[str, Column], wanted: Callable[[Column], list[Column]] | None = None) -> DataFrame:
    """``column, value, n, before, total``: how often each distinct value of the named expressions occurs, and its place."""
    pairs = F.array(*[F.struct(F.lit(name).alias("column"), c.alias("value")) for name, c in columns.items()])
    counts = df.select(F.inline(pairs)).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, "column", "value", "n", wanted=wanted)


def _element(at: Column) -> Column:
    """The value at index ``at`` of the sorted rows, of a group of `ranked_values`."""
    return F.max(F.when((at >= F.col("before")) & (at < F.col("before") + F.col("n")), F.col("value")))


def nearest_rank_percentile(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """``share, value``: the element at index round(share * (n - 1)) of the sorted column."""
    at = lambda total: [F.bround(F.lit(float(s)) * (total - 1)) for s in shares]
    found = ranked_values(df, {column: F.col(column)}, at).groupBy("column").agg(*[_element(x).alias(f"v{k}") for k, x in enumerate(at(F.col("total")))])
    return found.select(F.inline(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"v{k}").alias("value")) for k, s in enumerate(shares)])))


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> DataFrame:
    """``column, share, value``: exact quantiles, interpolated between the two nearest values."""
    places = lambda total: [F.lit(float(s)) * (total - 1) for s in shares]
    both = lambda total: [f(at) for at in places(total) for f in (F.floor, F.ceil)]
    cells = [_element(at).alias(f"e{k}") for k, at in enumerate(both(F.col("total")))]
    found = ranked_values(df, columns, both).groupBy("column").agg(F.max("total").alias("total"), *cells)
    told = []
    for k, (s, at) in enumerate(zip(shares, places(F.col("total")), strict=True)):
        low, high = F.col(f"e{2 * k}"), F.col(f"e{2 * k + 1}")
        told.append(F.struct(F.lit(float(s)).alias("share"), (low + (high - low) * (at - F.floor(at))).alias("value")))
    return found.select("column", F.inline(F.array(*told)))


def aggregate_headline(df: DataFrame, label: str, value: str) -> DataFrame:
    """Leader, runner-up and share of the leader of an aggregate, in one row."""
    v = F.col(value)
    ranked = df.select(F.col(label).cast("string").alias("label"), v.cast("double").alias("v")).filter("v is not null")
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("v")).alias("o"), "label", "v"))), 1, 2)
    best = ranked.orderBy(F.desc("v"), "label").limit(2).agg(top.alias("top"))
    total = ranked.agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("groups"))
    both = best.join(total, F.lit(True))  # one row each
    lead, second = F.try_element_at("top", F.lit(1)), F.try_element_at("top", F.lit(2))
    share = F.round(F.try_divide(lead["v"], F.col("total")) * 100, 2)
    return both.select(
        lead["label"].alias("leader"),
        lead["v"].alias("leader_value"),
        share.alias("share_pct"),
        (share >= 50).alias("more_than_rest"),
        second["label"].alias("runner_up"),
        "groups",
    )


# ---------------------------------------------------------------- ranking


def top_rows(df: DataFrame, column: str, limit: int, tie: str, descending: bool = True) -> DataFrame:
    """The k highest or lowest rows by number; rows without one are skipped."""
    v = _numeric(df, column)
    return df.filter(v.isNotNull()).orderBy(v.desc() if descending else v.asc(), tie).limit(limit)


def history_with_validity(history: DataFrame, keys: list[str], start: str = "__valid_from") -> DataFrame:
    return history.withColumn("__valid_to", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def as_of(history: DataFrame, keys: list[str], moment: Column, start: str = "__valid_from") -> DataFrame:
    """The version of each key that was valid at ``moment``."""
    h = history_with_validity(history, keys, start)
    return h.filter((F.col(start) <= moment) & (F.col("__valid_to").isNull() | (F.col("__valid_to") > moment)))


def top_values(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """``column, value, count, rank``: the most common values of each column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.inline(pairs)).filter("value is not null and value <> ''")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def period_change(df: DataFrame, period: str, value: str) -> DataFrame:
    """Change of the last period and of the second half against the first, with a label."""
    order = Window.orderBy(period)
    p = df.select(period, value).withColumn("rn", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).withColumn("prev", F.lag(value).over(order))
    half = F.floor(F.col("n") / 2)
    out = p.agg(
        F.count(F.lit(1)).alias("periods"),
        F.max(F.when(F.col("rn") == F.col("n"), F.col(value))).alias("last_value"),
        F.max(F.when(F.col("rn") == F.col("n"), F.col("prev"))).alias("previous_value"),
        F.avg(F.when(F.col("rn") <= half, F.col(value))).alias("first_half"),
        F.avg(F.when(F.col("rn") > half, F.col(value))).alias("second_half"),
    )
    pct = lambda a, b: F.round(F.try_divide(F.col(a) - F.col(b), F.abs(F.col(b))) * 100, 2)
    out = out.withColumn("change_pct", pct("last_value", "previous_value")).withColumn("half_pct", pct("second_half", "first_half"))
    label = F.when(F.col("half_pct") > 10, "growing").when(F.col("half_pct") < -10, "declining").otherwise("steady")
    return out.select("periods", F.round("last_value", 2).alias("last_value"), F.round("previous_value", 2).alias("previous_value"), "change_pct", "half_pct", label.alias("trend"))


def concentration(df: DataFrame, entity: str, measure: str, top: int = 10, share: float = 0.2) -> DataFrame:
    """Share of the top entities and of the top fifth of them (Pareto), in one row."""
    totals = df.filter(~expr.is_blank(F.col(entity))).groupBy(entity).agg(F.sum(_numeric(df, measure)).alias("v")).filter("v is not null")
    # Entities of one value are one row: the running sums go over distinct values, and a value on the edge counts in part.
    values = totals.groupBy((-F.col("v")).alias("less"), "v").agg(F.count(F.lit(1)).alias("k"))
    ranked = running_totals(values.withColumn("all", F.lit(0)), "all", "less", "k").withColumnRenamed("total", "n")
    held = lambda most: F.greatest(F.lit(0), F.least(F.col("k"), most - F.col("before"))) * F.col("v")
    part = lambda most: F.round(F.try_divide(F.sum(held(most)), F.sum(F.col("k") * F.col("v"))) * 100, 2)
    out = ranked.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("entities"), part(F.lit(top)).alias("top_share_pct"), part(F.ceil(F.col("n") * share)).alias("pareto_share_pct"))
    return out.withColumn("concentrated", F.col("pareto_share_pct") >= 60)


# ---------------------------------------------------------------- set operations


def concat(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(columns)


def align_to_schema(df: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    """Columns in the order and types of ``schema``: missing ones null, others dropped."""
    return df.select([(F.col(f"`{n}`").try_cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in schema])
