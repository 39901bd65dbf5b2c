"""Dataset contracts: inference, comparison, typed rows, the quality gate, data tests."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import expr

# Which type may take the place of which, and Spark's types.
WIDENS_TO = {
    "bool": ("bool", "str"),
    "int": ("int", "float", "str"),
    "float": ("float", "str"),
    "date": ("date", "timestamp", "str"),
    "timestamp": ("timestamp", "str"),
    "str": ("str",),
}
SPARK_TYPE = {"bool": "boolean", "int": "bigint", "float": "double", "date": "date", "timestamp": "timestamp_ntz", "str": "string"}
#: Candidates from the narrowest on: type and transform.
LADDER = (("bool", None), ("int", None), ("float", None), ("date", None), ("timestamp", None), ("date", "date_us"), ("date", "date_us_short"), ("float", "currency"))
BOOKKEEPING = ("__load_id", "__row_hash", "__loaded_at")


@dataclass(frozen=True)
class ContractColumn:
    name: str
    kind: str
    transform: str | None = None
    nullable: bool = True

    def value(self, c: Column) -> Column:
        return expr.typed(c, self.kind, self.transform)


def _fits(cells: DataFrame) -> DataFrame:
    """``column, rows, present, about`` and a count for each candidate type, of ``cells`` (column, v).

    Most cells are told by their looks: of plain digits only numbers can come,
    and of text without a digit only booleans; the others try every type.
    """
    v, looks = F.col("v"), F.col("looks")
    cells = cells.select("column", "v", F.when(v.rlike(expr.PLAIN_INT), "digits").when(v.rlike("[0-9]"), "mixed").otherwise("words").alias("looks"))
    finite = expr.finite(v.try_cast("double"))
    quick = {"bool": ("words", expr.parse_bool(v)), "int": ("digits", v.try_cast("bigint")), "float": ("digits", finite), "currency": ("digits", finite)}

    def fit(k: str, t: str | None) -> Column:
        look, value = quick.get(t or k, ("mixed", None))
        slow = F.when(looks == "mixed", expr.typed(v, k, t)) if (t or k) not in ("bool", "int") else F.lit(None)
        return slow if value is None else F.when(looks == look, value).otherwise(slow)

    fits = [F.count(fit(k, t)).alias(t or k) for k, t in LADDER]
    return cells.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("present"), F.approx_count_distinct("v", 0.03).alias("about"), *fits)


def type_probe(df: DataFrame, columns: list[str] | None = None, keys: bool = True) -> DataFrame:
    """``column, rows, present, distinct`` and how many values fit each candidate type.

    One pass in long form, so the generated code does not grow with the columns;
    partial counts meet by column, no cell is shuffled. ``distinct`` is exact,
    and null where a sketch of the same pass shows that the column is no key:
    only columns without nulls whose estimate comes near the row count have
    their values counted (with ``keys``), by one shuffle of theirs.
    """
    columns = columns or df.columns
    spark = df.sparkSession
    cells = lambda names: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("v")) for c in names]))).withColumn("v", expr.null_if_marker(F.col("v")))
    found = _fits(cells(columns))
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    told = names.join(found, "column", "left").na.fill(0)
    told = spark.createDataFrame(told.collect(), told.schema)  # one row a column
    likely = [r["column"] for r in told.filter("present = rows and about >= 0.85 * rows").collect()] if keys else []
    if not likely:
        return told.withColumn("distinct", F.when(F.col("rows") == 0, 0).cast("bigint")).drop("about")
    values = cells(likely).groupBy("column", "v").agg(F.lit(1).alias("one"))
    exact = values.groupBy("column").agg(F.count("v").alias("distinct"))
    return told.join(exact, "column", "left").drop("about")


def chosen_types(probe: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """``column, kind, transform, nullable, candidate_key`` from a probe.

    The first type that all values fit; else the first, int left out, that all
    but ``tolerance`` of them fit; else text. Bool text that is only 0 and 1
    counts as int by its place in the ladder.
    """
    pick = F.lit("str")
    for k, t in reversed([x for x in LADDER if x[0] != "int" or x[1]]):
        pick = F.when(F.col(t or k) >= (1 - tolerance) * F.col("present"), t or k).otherwise(pick)
    for k, t in reversed(LADDER):
        pick = F.when(F.col(t or k) == F.col("present"), t or k).otherwise(pick)
    pick = F.when(F.col("present") == 0, "str").otherwise(pick)
    kind = F.when(pick.isin("date_us", "date_us_short"), "date").when(pick == "currency", "float").otherwise(pick)
    transform = F.when(pick.isin("date_us", "date_us_short", "currency"), pick)
    key = (F.col("present") == F.col("rows")) & F.coalesce(F.col("distinct") == F.col("rows"), F.lit(False)) & kind.isin("int", "str")
    return probe.select("column", kind.alias("kind"), transform.alias("transform"), (F.col("present") < F.col("rows")).alias("nullable"), key.alias("candidate_key"))


def infer_contract(df: DataFrame, tolerance: float = 0.05) -> list[ContractColumn]:
    found = {r["column"]: r for r in chosen_types(type_probe(df, keys=False), tolerance).collect()}  # one row per column
    return [ContractColumn(c, found[c]["kind"], found[c]["transform"], found[c]["nullable"]) for c in df.columns]


def infer_simple_types(df: DataFrame) -> DataFrame:
    """``column, kind`` on the ladder int, float, str; never-seen columns are str."""
    kind = F.when(F.col("present") == 0, "str").when(F.col("int") == F.col("present"), "int").when(F.col("float") == F.col("present"), "float").otherwise("str")
    return type_probe(df, keys=False).select("column", kind.alias("kind"))


def diff_contract(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``dataset, column, change`` of contract tables ``(dataset, column, kind)``, for any number of datasets.

    ``narrowed`` values are cast up to the stored type; ``blocked`` are wider than it.
    """
    a, b = stored.select("dataset", "column", F.col("kind").alias("was")), incoming.select("dataset", "column", F.col("kind").alias("now"))
    wide = F.map_from_arrays(F.array(*map(F.lit, WIDENS_TO)), F.array(*[F.array(*map(F.lit, v)) for v in WIDENS_TO.values()]))
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("was") == F.col("now"), "same")
        .when(F.array_contains(F.element_at(wide, F.col("now")), F.col("was")), "narrowed")
        .otherwise("blocked")
    )
    return a.join(b, ["dataset", "column"], "full_outer").select("dataset", "column", change.alias("change"))


def evolve_contract(stored: list[ContractColumn], incoming: list[ContractColumn]) -> list[ContractColumn]:
    """Stored columns, absent ones made nullable, then the added ones; a wider type raises."""
    now = {c.name: c for c in incoming}
    out = []
    for c in stored:
        new = now.pop(c.name, None)
        if new and c.kind not in WIDENS_TO[new.kind]:
            raise ValueError(f"{c.name}: {new.kind} does not fit {c.kind}")
        out.append(ContractColumn(c.name, c.kind, c.transform if new is None else new.transform, c.nullable or new is None or new.nullable))
    return out + [ContractColumn(c.name, c.kind, c.transform, True) for c in now.values()]


def typed_rows(raw: DataFrame, contract: list[ContractColumn], load_id: str, loaded_at: Column | None = None, keep: str | None = None) -> DataFrame:
    """Contract columns in their types (absent ones null) and the three bookkeeping columns.

    ``keep`` names a struct that holds each row's raw values beside them.
    """
    cols = [(c.value(F.col(f"`{c.name}`")) if c.name in raw.columns else F.lit(None)).cast(SPARK_TYPE[c.kind]).alias(c.name) for c in contract]
    t = raw.select(*cols, *([F.struct(*[F.col(f"`{c}`") for c in raw.columns]).alias(keep)] if keep else []))
    stamp = loaded_at if loaded_at is not None else F.current_timestamp()
    return t.withColumn("__load_id", F.lit(load_id)).withColumn("__row_hash", expr.row_hash(*[F.col(f"`{c.name}`") for c in contract])).withColumn("__loaded_at", stamp)


def quality_gate(raw: DataFrame, contract: list[ContractColumn], keys: list[str], malformed: int = 0, limit: float = 0.05) -> DataFrame:
    """``check, severity, passed, rows`` of a batch: casts are judged on raw and typed value in one row."""
    rows = F.count(F.lit(1))
    cells = [rows.alias("n")]
    for k, c in enumerate(contract):
        v = expr.null_if_marker(F.col(f"`{c.name}`"))
        cells += [F.count(v).alias(f"p{k}"), F.count_if(v.isNotNull() & c.value(F.col(f"`{c.name}`")).isNull()).alias(f"f{k}")]
    blank = reduce(lambda a, b: a | b, [expr.null_if_marker(F.col(f"`{k}`")).isNull() for k in keys]) if keys else F.lit(False)
    one = raw.agg(*cells, F.count_if(blank).alias("key_null"))
    total = lambda p: reduce(lambda a, b: a + b, [F.col(f"{p}{k}") for k in range(len(contract))])
    empty = reduce(lambda a, b: a + b, [F.when(F.col(f"p{k}") == 0, 1).otherwise(0) for k in range(len(contract))])
    dup = raw.groupBy(*raw.columns).agg(rows.alias("__c")).agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).alias("dup"))
    twice = raw.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(rows.alias("__c")).agg(F.coalesce(F.sum(F.when(F.col("__c") > 1, F.col("__c"))), F.lit(0)).alias("twice")) if keys else raw.limit(0).agg(F.lit(0).alias("twice"))
    both = one.join(dup, F.lit(True)).join(twice, F.lit(True))
    bad, share = F.lit(malformed), lambda b, n: F.coalesce(F.try_divide(b, n), F.lit(0.0))

    def check(name: str, severity: Column | str, passed: Column, count: Column) -> Column:
        s = F.lit(severity) if isinstance(severity, str) else severity
        return F.struct(F.lit(name).alias("check"), s.alias("severity"), passed.alias("passed"), count.cast("bigint").alias("rows"))

    grade = lambda b, n: F.when(share(b, n) > limit, "fail").otherwise("warn")
    checks = [
        check("row_count", "fail", F.col("n") > 0, F.col("n")),
        check("malformed_rows", grade(bad, F.col("n") + bad), bad == 0, bad),
        check("cast_failures", grade(total("f"), total("p")), total("f") == 0, total("f")),
        check("empty_columns", "warn", empty == 0, empty),
        check("key_not_null", "fail", F.col("key_null") == 0, F.col("key_null")),
        check("key_unique", "fail", F.col("twice") == 0, F.col("twice")),
        check("duplicate_rows", "info", F.col("dup") == 0, F.col("dup")),
    ]
    return both.select(F.inline(F.array(*checks)))


# ---------------------------------------------------------------- data tests: the rows that break a rule


def expect_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def expect_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def expect_accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def expect_between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(~F.col(column).between(low, high))
