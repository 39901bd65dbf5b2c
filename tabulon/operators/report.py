"""The profiling report of several tables: checked plan, sections, links, findings, status.

A table is scanned a bounded number of times, however many columns it has: once
for all counts, moments and pairs, once for repeated rows, once for categories,
and the passes of exact quantiles and of the tails.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import catalog, links
from tabulon.operators import profile as P
from tabulon.operators import relational as R

# The parts of a report that may be asked for.
ANALYSES = ("overview", "data_quality", "numeric_summary", "categorical_summary", "time_summary", "correlations")


class PlanError(ValueError):
    """What is asked of a report does not fit its tables."""


@dataclass
class TablePlan:
    """One table's columns and analyses; by default all."""

    columns: list[str] | None = None
    analyses: tuple[str, ...] = ANALYSES


@dataclass
class Report:
    """Lazy frames of a report; ``sections`` holds those of each table by name."""

    overview: DataFrame
    tables: DataFrame
    columns: DataFrame
    sensitive: DataFrame
    relationships: DataFrame
    findings: DataFrame
    sections: dict[str, dict[str, DataFrame]] = field(default_factory=dict)


def check_plan(plan: dict[str, TablePlan], tables: dict[str, DataFrame | None], schema: dict[str, list[str]]) -> None:
    """Refuse unknown tables, unknown, repeated or no columns, and unknown, repeated or no analyses."""
    if not plan:
        raise PlanError("a report needs at least one table")
    for name, step in plan.items():
        if name not in tables:
            raise PlanError(f"unknown table: {name}")
        columns = schema[name] if step.columns is None else step.columns
        if not columns or len(set(columns)) != len(columns):
            raise PlanError(f"{name}: columns must be named, each once")
        if unknown := [c for c in columns if c not in schema[name]]:
            raise PlanError(f"{name}: unknown columns {unknown}")
        if not step.analyses or len(set(step.analyses)) != len(step.analyses) or (set(step.analyses) - set(ANALYSES)):
            raise PlanError(f"{name}: unsupported analyses {step.analyses}")


def _one_row(df: DataFrame) -> DataFrame:
    """An aggregate's single row, worked out once; it has some figures a column."""
    return df.sparkSession.createDataFrame([df.first()], df.schema)


def table_sections(df: DataFrame, roles: dict[str, str], privacy: dict[str, str], analyses: tuple[str, ...] = ANALYSES) -> dict[str, DataFrame]:
    """The sections of one table as frames.

    ``roles`` and ``privacy`` are those of the column catalogue. Values of
    columns that are not ordinary are not shown: their top values are withheld.
    """
    by = lambda *r: [c for c in df.columns if roles.get(c) in r]
    numeric, categorical, times = by("numeric_measure"), by("categorical"), by("datetime")
    moments = numeric if "numeric_summary" in analyses else []
    pairs = numeric if "correlations" in analyses and len(numeric) > 1 else []
    built = {"missingness": P._missing_cells(df, df.columns), "numeric": P._moment_cells(df, moments, None), "correlations": P._pair_cells(df, pairs)}
    row = _one_row(df.agg(*[c for cells, _ in built.values() for c in cells]))
    told = {n: P.unpivot_row(row, parts) for n, (_, parts) in built.items() if parts}
    out = {"overview": row.select(F.col("n").alias("rows"), F.lit(len(df.columns)).alias("columns"))}
    if "data_quality" in analyses:
        out |= {"missingness": told["missingness"], "duplicates": R.duplicate_rows(df)}
    if moments:
        exact = P._with_quartiles(df, moments, None, told["numeric"])
        out["numeric"] = exact.select(*[F.round(c, 4).alias(c) if c in ("min", "q1", "median", "mean", "q3", "max", "std") else c for c in exact.columns])
        out["outliers"] = P.tails(df, moments, exact)
    if pairs:
        out["correlations"] = P._strongest(told["correlations"], 10)
    if categorical and "categorical_summary" in analyses:
        hidden = F.col("column").isin([c for c in categorical if privacy.get(c) != "ordinary"])
        out["categorical"] = P.categorical_summary(df, categorical).withColumns({"top": F.when(~hidden, F.col("top")), "redacted": hidden})
    if "time_summary" in analyses:
        out |= {f"time:{c}": P.time_summary(df, c) for c in times} | {f"series:{c}": P.time_series(df, c) for c in times}
    return out


def eda_report(spark: SparkSession, tables: dict[str, DataFrame | None], relationships: list[links.Link] | None = None, plan: dict[str, TablePlan] | None = None, schema: dict[str, list[str]] | None = None) -> Report:
    """The report of ``tables``; one whose frame is None could not be read and makes it partial.

    ``schema`` names the columns of tables that were not read.
    """
    read = {t: df for t, df in tables.items() if df is not None}
    schema = {t: [] for t in tables} | {t: df.columns for t, df in read.items()} | (schema or {})
    plan = plan or {t: TablePlan() for t in read}
    check_plan(plan, tables, schema)
    columns = catalog.column_table(spark, read)
    known = {(r["table"], r["column"]): r for r in columns.select("table", "column", "role", "privacy").collect()}  # the schema
    sections = {}
    for t, step in plan.items():
        if t in read:
            df = read[t].select(*[f"`{c}`" for c in step.columns or read[t].columns])
            of = lambda what, t=t, df=df: {c: known[t, c][what] for c in df.columns}
            sections[t] = table_sections(df, of("role"), of("privacy"), step.analyses)

    state = [(t, "ok" if t in read else "error", len((plan[t].columns or schema[t])) if t in plan else None) for t in sorted(plan)]
    status = spark.createDataFrame(state, "table string, status string, columns int")
    rows = [s["overview"].select(F.lit(t).alias("table"), "rows") for t, s in sorted(sections.items())]
    rows = reduce(DataFrame.unionByName, rows, spark.createDataFrame([], "table string, rows bigint"))
    told = status.join(rows, "table", "left")
    found = [
        P.told(s["missingness"], s["duplicates"], s.get("outliers"), s.get("correlations")).select(F.lit(t).alias("table"), "kind", "finding")
        for t, s in sorted(sections.items())
        if "missingness" in s
    ]
    found = reduce(DataFrame.unionByName, found, spark.createDataFrame([], "table string, kind string, finding string"))
    related = links.verify_links(tables, relationships or [], schema, discover=False)
    partial = any(t not in read for t in plan) or len(plan) < len(tables)
    overview = rows.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("scanned_rows")).select(
        F.lit("partial" if partial else "complete").alias("status"),
        F.lit(len(tables)).alias("table_count"),
        F.lit(len(sections)).alias("profiled_table_count"),
        "scanned_rows",
        F.lit(sum(len(schema[t]) for t in tables)).alias("column_count"),
        F.lit(len(links._known(tables, schema, relationships or []))).alias("relationship_count"),
    )
    sensitive = columns.filter("privacy <> 'ordinary'").select("table", "column", F.col("privacy").alias("classification"))
    return Report(overview, told, columns, sensitive, related, found, sections)
