"""Cleaning of spreadsheet-like text: preview, decisions, application."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tabulon.functions import expr


def clean_headers(names: list[str], longest: int = 64) -> list[str]:
    """Normalised, trimmed, without control and odd characters, unique without regard to case."""
    out, seen = [], set()
    for k, name in enumerate(names, 1):
        n = unicodedata.normalize("NFKC", name or "").replace("﻿", "")
        n = re.sub(r"\s+", " ", re.sub(r"[^\w\s.%#&/()$-]", "", "".join(c for c in n if c.isprintable() or c.isspace()))).strip()
        n = re.sub(r"\s*\(\W*\)\s*$", "", n)[:longest].strip() or f"column_{k}"
        base, i = n, 2
        while n.casefold() in seen:
            n, i = f"{base}_{i}", i + 1
        seen.add(n.casefold())
        out.append(n)
    return out


def cleaned_header_table(names: DataFrame, order: str, raw: str) -> DataFrame:
    """`clean_headers` for a table of any number of headers: ``order`` and ``name``.

    Each name is cleaned where it lies; equal ones, without regard to case, are
    numbered in their order. (A number that meets a name of its own kind, such as
    a second ``a_2``, is for `clean_headers` to resolve.)
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(name=[clean_headers([n])[0] if str(n or "").strip() else "" for n in f[raw]])[[order, "name"]]

    kind = names.schema[order].dataType.simpleString()
    each = names.select(order, raw).mapInPandas(run, f"`{order}` {kind}, name string")
    nth = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(order))
    n = F.col("nth").cast("string")
    return each.withColumn("nth", nth).select(order, F.when(F.col("nth") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), n)).alias("name"))


@dataclass
class CleaningActions:
    trim: bool = True
    nulls: bool = True
    numbers: list[str] = field(default_factory=list)
    booleans: list[str] = field(default_factory=list)
    drop_empty: bool = True
    drop_duplicates: bool = True


def _standard(c, actions: CleaningActions):
    v = expr.strip(c) if actions.trim else c
    return F.when(~F.lower(expr.strip(v)).isin(*expr.CLEANING_NULLS), v) if actions.nulls else v


def text_column_probe(df: DataFrame) -> DataFrame:
    """``column, filled, numeric, formatted, boolean, canonical``: what converting would change. One pass.

    In long form, so each cell is parsed once and the generated code does not grow
    with the columns; partial counts meet by column.
    """
    v, n, names = F.col("v"), F.col("n"), df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns])))
    cells = cells.withColumn("v", _standard(v, CleaningActions())).withColumn("n", expr.parse_formatted_number(v))
    counts = [F.count(v).alias("filled"), F.count(n).alias("numeric"), F.count_if(n.isNotNull() & ~v.rlike(expr.PLAIN_NUMBER)).alias("formatted"), F.count(expr.parse_bool(v)).alias("boolean"), F.count_if(v.isin("true", "false")).alias("canonical")]
    return names.join(cells.groupBy("column").agg(*counts), "column", "left").na.fill(0)


def numeric_text_columns(df: DataFrame) -> DataFrame:
    return text_column_probe(df).filter("filled >= 3 and formatted >= 1 and numeric >= 0.9 * filled").select("column", "filled", "numeric", "formatted")


def formatted_examples(df: DataFrame, columns: list[str], n: int = 3) -> DataFrame:
    """``column, examples``: the first ``n`` formatted numbers of each column in the order of their text."""
    v = lambda c: _standard(F.col(f"`{c}`"), CleaningActions())
    cells = [F.struct(F.lit(c).alias("column"), v(c).alias("v")) for c in columns]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, examples array<string>")
    shown = df.select(F.inline(F.array(*cells))).filter(~F.col("v").rlike(expr.PLAIN_NUMBER) & expr.parse_formatted_number(F.col("v")).isNotNull())
    first = shown.distinct().withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("v"))).filter(F.col("k") <= n)
    return first.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("examples"))


def boolean_text_columns(df: DataFrame) -> DataFrame:
    return text_column_probe(df).filter("filled >= 3 and boolean = filled and canonical < filled").select("column", "filled")


def clean_preview(df: DataFrame) -> DataFrame:
    """One row of counts: cells to trim and standardise, empty and duplicate rows."""
    a = CleaningActions()
    std = [_standard(F.col(c), a).alias(c) for c in df.columns]
    trimmed = reduce(lambda x, y: x + y, [F.count_if(F.col(c) != expr.strip(F.col(c))) for c in df.columns])
    nulled = reduce(lambda x, y: x + y, [F.count_if((expr.strip(F.col(c)) != "") & _standard(F.col(c), a).isNull()) for c in df.columns])
    empty = reduce(lambda x, y: x & y, [_standard(F.col(c), a).isNull() for c in df.columns])
    counts = df.agg(F.count(F.lit(1)).alias("rows"), trimmed.alias("trimmed_cells"), nulled.alias("standardised_nulls"), F.count_if(empty).alias("empty_rows"))
    kept = df.filter(~empty).select(*std)
    dup = kept.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))
    return counts.join(dup, F.lit(True))


def missing_by_column(df: DataFrame) -> DataFrame:
    """``column, missing``: cells that are empty once standardised."""
    names = _data_columns(df)
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(F.coalesce(_standard(F.col(f"`{c}`"), CleaningActions()), F.lit("")) == "").alias("missing")) for c in names]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def cleaning_plan(df: DataFrame, header: list[str] | None = None) -> DataFrame:
    """``action, affected, columns``: what cleaning would do, in the order it is done; nothing that affects no cell.

    ``header`` is the file's own; rows of another width have ``_corrupt`` set.
    """
    names = _data_columns(df)
    data = df.select(*[f"`{c}`" for c in names])
    counts = clean_preview(data)
    probe = text_column_probe(data).agg(
        *[
            F.struct(F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("n"), F.array_sort(F.collect_list(F.when(ok, F.col("column")))).alias("columns")).alias(name)
            for name, ok, n in (
                ("numbers", (F.col("filled") >= 3) & (F.col("formatted") >= 1) & (F.col("numeric") >= 0.9 * F.col("filled")), F.col("formatted")),
                ("booleans", (F.col("filled") >= 3) & (F.col("boolean") == F.col("filled")) & (F.col("canonical") < F.col("filled")), F.col("filled") - F.col("canonical")),
            )
        ]
    )
    bad = df.agg(F.count_if(F.col("_corrupt").isNotNull()).alias("malformed")) if "_corrupt" in df.columns else df.limit(0).agg(F.count(F.lit(1)).alias("malformed"))
    changed = sum(a != b for a, b in zip(header or names, clean_headers(header or names), strict=True))
    none = F.array().cast("array<string>")
    rows = [
        ("normalize_headers", F.lit(changed), none),
        ("trim_whitespace", F.col("trimmed_cells"), none),
        ("standardize_nulls", F.col("standardised_nulls"), none),
        ("parse_numbers", F.col("numbers.n"), F.col("numbers.columns")),
        ("normalize_booleans", F.col("booleans.n"), F.col("booleans.columns")),
        ("remove_duplicates", F.col("duplicate_rows"), none),
        ("remove_empty_rows", F.col("empty_rows"), none),
        ("repair_row_width", F.col("malformed"), none),
    ]
    told = F.array(*[F.struct(F.lit(a).alias("action"), n.cast("bigint").alias("affected"), c.alias("columns")) for a, n, c in rows])
    return counts.join(probe, F.lit(True)).join(bad, F.lit(True)).select(F.inline(told)).filter("affected > 0")


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "_corrupt"]


def _cleaned(df: DataFrame, actions: CleaningActions) -> dict[str, Column]:
    def value(c: str) -> Column:
        v = _standard(F.col(f"`{c}`"), actions)
        if c in actions.numbers:
            return expr.parse_formatted_number(v)
        # What is no boolean stays as it is; all cells of a chosen column are.
        return F.lower(expr.parse_bool(v).cast("string")) if c in actions.booleans else v

    return {c: value(c) for c in _data_columns(df)}


def apply_cleaning(df: DataFrame, actions: CleaningActions) -> DataFrame:
    """The cleaned rows: trimmed, nulls standardised, numbers and booleans converted, empty and repeated rows gone."""
    out = df.select(*[v.alias(c) for c, v in _cleaned(df, actions).items()])
    if actions.drop_empty:
        out = out.filter(reduce(lambda x, y: x | y, [F.col(f"`{c}`").isNotNull() for c in out.columns]))
    return out.dropDuplicates() if actions.drop_duplicates else out


def write_cleaned(df: DataFrame, actions: CleaningActions, path: str) -> dict[str, int]:
    """Write the cleaned rows as Parquet under ``path``; what was done is counted by the write itself.

    Counters: input_rows, output_rows, trimmed_cells, standardised_nulls,
    converted_numbers, blanked_unparsed (cells of number columns that are none),
    converted_booleans, empty_rows. A task that runs twice, as on a lost
    executor, may be counted twice; the rows written are not.
    """
    names, cells = _data_columns(df), _cleaned(df, actions)
    # Parsed once; the counts below read the results.
    wide = df.select(*[F.struct(F.col(f"`{c}`").alias("raw"), _standard(F.col(f"`{c}`"), actions).alias("std"), v.alias("v")).alias(c) for c, v in cells.items()])
    part = lambda c, f: F.col(f"`{c}`.{f}")
    total = lambda counted: reduce(lambda a, b: a + b, [F.count_if(x) for x in counted], F.lit(0))
    numbers, booleans = [c for c in names if c in actions.numbers], [c for c in names if c in actions.booleans]
    empty = reduce(lambda a, b: a & b, [part(c, "v").isNull() for c in names]) if actions.drop_empty else F.lit(False)
    seen, kept = Observation(), Observation()
    out = wide.observe(
        seen,
        F.count(F.lit(1)).alias("input_rows"),
        total([part(c, "raw") != expr.strip(part(c, "raw")) for c in names if actions.trim]).alias("trimmed_cells"),
        total([(expr.strip(part(c, "raw")) != "") & part(c, "std").isNull() for c in names]).alias("standardised_nulls"),
        total([part(c, "v").isNotNull() & ~expr.strip(part(c, "std")).rlike(expr.PLAIN_NUMBER) for c in numbers]).alias("converted_numbers"),
        total([(F.coalesce(expr.strip(part(c, "std")), F.lit("")) != "") & part(c, "v").isNull() for c in numbers]).alias("blanked_unparsed"),
        total([part(c, "v").isNotNull() & ~expr.strip(part(c, "std")).isin("true", "false") for c in booleans]).alias("converted_booleans"),
        F.count_if(empty).alias("empty_rows"),
    ).select(*[part(c, "v").alias(c) for c in names])
    if actions.drop_empty:
        out = out.filter(reduce(lambda x, y: x | y, [F.col(f"`{c}`").isNotNull() for c in names]))
    out = out.dropDuplicates() if actions.drop_duplicates else out
    out.observe(kept, F.count(F.lit(1)).alias("output_rows")).write.option("compression", "zstd").parquet(path)
    return seen.get | kept.get


def fingerprint(df: DataFrame) -> DataFrame:
    """Count and order-free content hash; equal before and after if nothing changed."""
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).alias("content"))


def apply_if_unchanged(df: DataFrame, actions: CleaningActions, seen: tuple) -> DataFrame:
    if tuple(fingerprint(df).first()) != tuple(seen):
        raise ValueError("the source changed since the preview")
    return apply_cleaning(df, actions)
