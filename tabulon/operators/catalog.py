"""Column catalogue: privacy class, analysis role and scores from names and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name patterns of the privacy classes and roles, and name hints.
PRIVACY = (
    ("credential", r"(?i)(^|_)(password|secret|token|api_key|credential)(_|$)"),
    ("direct_identifier", r"(?i)(^|_)(email|phone|address|ssn|sin|passport)(_|$)|^(name|customer_name|contact_first_name|contact_last_name|first_name|last_name|full_name|person_name|relationship_manager|sales_rep)$"),
    ("identifier", r"(?i)^(customer_id|client_id|user_id|employee_id|transaction_id|ticket_id|order_id|invoice_id)$"),
    ("financial", r"(?i)(^|_)(account|routing|iban|card|credit|salary|wage)(_|$)"),
    ("unstructured_text", r"(?i)^(free_text|free_text_summary|notes?|comments?|narrative|text_summary)$"),
)
IDENTIFIER_NAME = r"(?i)(^id$|_id$|_key$|^key$)"
TIME_PART_NAME = r"(?i)^(year|month|day|week|quarter|hour)$"
TIME_NAME = r"(?i)(^|_)(date|time|timestamp|created|updated|modified|occurred|completed)(_|$)"
STRONG_MEASURE = ("total", "amount", "revenue", "sales", "price", "spend", "profit", "income", "salary", "value", "balance", "gmv", "turnover")
MEASURE = ("cost", "quantity", "qty", "fee", "units", "volume", "score", "rating", "duration", "hours", "minutes", "count", "weight", "distance", "discount", "tax", "margin", "clicks", "views", "visits")
WEAK_MEASURE = ("age", "year", "month", "day", "week", "pct", "percent", "rate", "ratio", "temperature", "height", "bmi")
PER_UNIT = ("unit_", "price", "_per_", "per_unit", "rating", "score")
NOT_MEASURE = ("code", "number", "phone", "zip", "postal", "lat", "lon", "longitude", "latitude", "ssn")
DIMENSION = ("status", "category", "type", "segment", "channel", "region", "state", "country", "city", "gender", "department", "class", "tier", "plan", "source", "method", "kind", "group", "brand", "product", "team", "stage", "priority", "level", "industry", "role", "market", "store", "branch")
NOT_DIMENSION = ("name", "email", "address", "description", "comment", "note", "url", "title", "phone", "id", "uuid", "hash", "token", "password")
TEMPORAL = ("date", "time", "timestamp", "_at", "_on", "created", "updated", "year", "month")
ENTITY = ("name", "title", "product", "customer", "vendor", "supplier", "employee", "item", "sku", "company", "merchant")
NOT_ENTITY = ("first", "last", "surname", "given", "middle", "nick")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def privacy_class(name: Column) -> Column:
    out = F.lit("ordinary")
    for label, pattern in reversed(PRIVACY):
        out = F.when(name.rlike(pattern), label).otherwise(out)
    return out


def role(name: Column, numeric: Column) -> Column:
    p = privacy_class(name)
    return (
        F.when(p == "credential", "credential")
        .when(name.rlike(IDENTIFIER_NAME) | p.isin("direct_identifier", "identifier"), "identifier")
        .when(p == "unstructured_text", "free_text")
        .when(name.rlike(TIME_NAME), "datetime")
        .when(name.rlike(TIME_PART_NAME), "temporal_component")
        .when(numeric, "numeric_measure")
        .otherwise("categorical")
    )


def column_table(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``table, column, type, numeric, privacy, role`` and scores for every column; no data is read."""
    rows = [(t, c, kind, kind in NUMERIC or kind.startswith("decimal"), k) for t, df in sorted(tables.items()) for k, (c, kind) in enumerate(df.dtypes)]
    base = spark.createDataFrame(rows, "table string, column string, type string, numeric boolean, position int")
    name, low = F.col("column"), F.lower("column")
    ident = name.rlike(IDENTIFIER_NAME)
    temporal = low.rlike("|".join(TEMPORAL)) & ~F.col("numeric")
    measure = F.when(F.col("numeric") & ~ident & ~low.rlike("|".join(NOT_MEASURE)), F.when(low.rlike("|".join(STRONG_MEASURE)), 4).when(low.rlike("|".join(MEASURE)), 3).when(low.rlike("|".join(WEAK_MEASURE)), 1).otherwise(2))
    dimension = F.when(~F.col("numeric") & ~ident & ~temporal & ~low.rlike("|".join(NOT_DIMENSION)), F.when(low.rlike("|".join(DIMENSION)), 3).otherwise(2))
    entity = ~F.col("numeric") & ~ident & ~temporal & low.rlike("|".join(ENTITY)) & ~low.rlike("|".join(NOT_ENTITY))
    return base.select(
        "table",
        "column",
        "type",
        "numeric",
        "position",
        privacy_class(name).alias("privacy"),
        role(name, F.col("numeric")).alias("role"),
        measure.alias("measure_score"),
        dimension.alias("dimension_score"),
        temporal.alias("temporal"),
        entity.alias("entity"),
        (measure.isNotNull() & ((measure == 1) | low.rlike("|".join(PER_UNIT)))).alias("average_only"),
    )


def column_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """`column_table` with row, null and distinct counts: one aggregate per table."""
    counted = None
    for t, df in sorted(tables.items()):
        cells = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c, 0.02).alias("distinct_about")) for c in df.columns]
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*cells).alias("cells")).select(F.lit(t).alias("table"), "rows", F.inline("cells"))
        counted = one if counted is None else counted.unionByName(one)
    return column_table(spark, tables).join(counted, ["table", "column"])


def infer_links(columns: DataFrame) -> DataFrame:
    """Candidate links: identifier columns of one name, where the name's stem is in the other table's name."""
    ids = columns.filter(F.col("column").rlike(IDENTIFIER_NAME)).select("table", "column")
    a, b = ids.toDF("from_table", "column"), ids.toDF("to_table", "column")
    stem, to = F.regexp_replace(F.lower("column"), "_*(id|key)$", ""), F.lower("to_table")
    bare = lambda c: F.regexp_replace(c, "s+$", "")
    both = a.join(b, "column").filter("from_table <> to_table")
    fits = (stem != "") & (F.contains(to, stem) | (bare(to) == bare(stem)))
    return both.filter(fits).select("from_table", F.col("column").alias("from_column"), "to_table", F.col("column").alias("to_column"))


def mask_columns(df: DataFrame, mode: str) -> DataFrame:
    """``full``, ``masked``, ``aggregate_only`` for results; ``classified``, ``aliases`` for exports."""
    import hashlib
    import re

    def of(c: str) -> str:
        return next((label for label, p in PRIVACY if re.search(p, c)), "ordinary")

    if mode == "full":
        return df
    if mode == "masked":
        return df.select([F.col(c) if of(c) == "ordinary" else F.lit("[REDACTED]").alias(c) for c in df.columns])
    if mode == "aggregate_only":
        return df.limit(0)
    if mode == "classified":
        return df.select([c for c in df.columns if of(c) != "credential"])
    if mode == "aliases":
        return df.toDF(*[f"column_{hashlib.sha256(c.encode()).hexdigest()[:10]}" for c in df.columns])
    raise ValueError(f"unknown mode {mode!r}")
