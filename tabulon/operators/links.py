"""Links between tables: sketches of keys pick the candidates, exact coverage verifies them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import catalog
from tabulon.operators import relational as R

Link = tuple[str, str, str, str]  # from_table, from_column, to_table, to_column

LINK = "from_table string, from_column string, to_table string, to_column string"
MEASURED = ("overlap", "distinct_a", "distinct_b", "rows_a", "rows_b", "matched_a", "matched_b", "rate_a", "rate_b")
VERIFIED, BY_SCHEMA = "data_verified", "schema_validated_not_data_verified"


def _key(c: str) -> Column:
    """Keys are compared as trimmed text, as the coverage does."""
    return F.trim(F.col(f"`{c}`").cast("string"))


def key_sketches(tables: dict[str, DataFrame], columns: dict[str, list[str]], size: int = 12) -> DataFrame:
    """``table, column, keys, sketch``: a theta sketch of 2**size hashes of each column's keys, one pass a table."""
    found = []
    for t, names in sorted(columns.items()):
        if names:
            cells = [F.struct(F.lit(c).alias("column"), F.theta_sketch_agg(_key(c), size).alias("sketch")) for c in names]
            found.append(tables[t].agg(F.array(*cells).alias("cells")).select(F.lit(t).alias("table"), F.inline("cells")))
    if not found:
        raise ValueError("no columns to sketch")
    return reduce(DataFrame.unionByName, found).select("table", "column", F.theta_sketch_estimate("sketch").alias("keys"), "sketch")


def identifiers(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Columns that name themselves identifiers, by table; no data is read."""
    spark = next(iter(tables.values())).sparkSession
    rows = catalog.column_table(spark, tables).filter("role = 'identifier'").select("table", "column").orderBy("table", "column").collect()
    out: dict[str, list[str]] = {t: [] for t in tables}
    for r in rows:
        out[r["table"]].append(r["column"])
    return out


def link_candidates(tables: dict[str, DataFrame], least: float = 0.5, size: int = 12) -> DataFrame:
    """Links that nobody declared: ``from_table, .., keys_found``, the estimated share of the source's keys that the target holds.

    Names propose (`catalog.infer_links`), sketches dispose: a pair stays if the
    intersection of its sketches holds ``least`` of the source's keys, less a
    margin of four standard errors, and the target has about as many keys as rows.
    """
    names = identifiers(tables)
    sketches = key_sketches(tables, names, size)
    sizes = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows") for t, df in sorted(tables.items())])
    sketches = sketches.join(F.broadcast(sizes), "table")  # one row a table
    side = lambda p: sketches.select(*[F.col(c).alias(f"{p}_{c}") for c in sketches.columns])
    spark = sketches.sparkSession
    both = catalog.infer_links(catalog.column_table(spark, tables)).join(side("from"), ["from_table", "from_column"]).join(side("to"), ["to_table", "to_column"])
    share = F.try_divide(F.theta_sketch_estimate(F.theta_intersection("from_sketch", "to_sketch")), F.col("from_keys"))
    margin = 4 / 2 ** (size / 2)
    found = both.withColumn("keys_found", F.round(F.coalesce(share, F.lit(0.0)), 4))
    found = found.filter((F.col("keys_found") >= least - margin) & (F.col("to_keys") >= (1 - margin) * F.col("to_rows")))
    return found.select(*[f.split()[0] for f in LINK.split(", ")], "keys_found")


def _known(tables: dict[str, DataFrame | None], schema: dict[str, list[str]], declared: list[Link]) -> list[Link]:
    return [x for x in dict.fromkeys(declared) if x[1] in schema.get(x[0], ()) and x[3] in schema.get(x[2], ())]


def named_links(spark: SparkSession, tables: dict[str, DataFrame], declared: list[Link]) -> list[Link]:
    """The declared links of known columns, then those that names propose, however many of their keys meet."""
    known = _known(tables, {t: df.columns for t, df in tables.items()}, declared)
    found = catalog.infer_links(catalog.column_table(spark, tables)).orderBy("from_table", "from_column", "to_table").collect()  # schema-sized
    return list(dict.fromkeys(known + [tuple(r) for r in found]))


def verify_links(tables: dict[str, DataFrame | None], declared: list[Link], schema: dict[str, list[str]] | None = None, discover: bool = True, least: float = 0.5) -> DataFrame:
    """Each declared link, and with ``discover`` each found one, with its exact coverage and status.

    A declared link whose columns are in ``schema`` is ``data_verified`` once both
    tables were read; ``schema_validated_not_data_verified`` where one is None. Links
    of unknown columns are left out. Found links stay if at least ``least`` of
    the source's rows match.
    """
    read = {t: df for t, df in tables.items() if df is not None}
    spark = next(iter(read.values())).sparkSession
    schema = {t: df.columns for t, df in read.items()} | (schema or {})
    links = {x: True for x in _known(tables, schema, declared)}
    if discover and len(read) > 1 and any(identifiers(read).values()):
        for r in link_candidates(read, least).select(*[f.split()[0] for f in LINK.split(", ")]).collect():  # schema-sized
            links.setdefault(tuple(r), False)
    frames = []
    for (a, ca, b, cb), known in sorted(links.items()):
        head = [F.lit(x).alias(n.split()[0]) for x, n in zip((a, ca, b, cb), LINK.split(", "), strict=True)] + [F.lit(known).alias("declared")]
        if a in read and b in read:
            one = R.join_coverage(read[a], ca, read[b], cb)
            one = one.select(*head, F.lit(VERIFIED).alias("status"), *[F.col(c).alias(n) for c, n in zip(one.columns, MEASURED, strict=True)])
            frames.append(one if known else one.filter(F.col("rate_a") >= least))
        else:
            frames.append(spark.range(1).select(*head, F.lit(BY_SCHEMA).alias("status"), *[F.lit(None).cast("double" if n.startswith("rate") else "bigint").alias(n) for n in MEASURED]))
    empty = spark.createDataFrame([], LINK + ", declared boolean, status string, " + ", ".join(f"{n} {'double' if n.startswith('rate') else 'bigint'}" for n in MEASURED))
    return reduce(DataFrame.unionByName, frames, empty)
